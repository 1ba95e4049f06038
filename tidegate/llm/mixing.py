"""Mixing sources to target weights along a curriculum.

Each source has a weight schedule, a line through two or more knots (time, weight) over training
time 0 to 1.
The area under it is the source's weight; targets share the budget by these weights.  The part
of the area up to a time is the share of the source's target that is due by then: a document is
placed where the running sum of its source's words meets that demand, and documents are sorted
by this time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.common import WORD, packed, stored

# Rows whose running sum is formed at a time, about; a source's rows are spread over such buckets.
BUCKET_ROWS = 4_096
# Words are taken at most so many times.
MAX_EPOCHS = 2

SCHEDULE = "array<struct<time:double,weight:double>>"


def area(schedule: Column) -> Column:
    """Area under the line through the knots, from the first to the last."""
    return F.aggregate(_segments(schedule), F.lit(0.0), lambda s, x: s + x["area"])


def _segments(schedule: Column) -> Column:
    """start, width, from, to and area of each piece of the line."""
    def piece(i: Column) -> Column:
        a, b = F.get(schedule, i), F.get(schedule, i + 1)
        width = b["time"] - a["time"]
        return F.struct(a["time"].alias("start"), width.alias("width"), a["weight"].alias("low"),
                        b["weight"].alias("high"), (width * (a["weight"] + b["weight"]) / 2).alias("area"))
    return F.transform(F.sequence(F.lit(0), F.size(schedule) - 2), piece)


def invert(schedule: Column, share: Column) -> Column:
    """The time by which ``share`` (0 to 1) of the area is reached."""
    want = share * area(schedule)
    # Walk over the pieces; the first that reaches the wanted area holds the time.
    walked = F.aggregate(
        _segments(schedule),
        F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("time"), F.lit(0.0).alias("end")),
        lambda s, x: F.struct(
            (s["sum"] + x["area"]).alias("sum"),
            F.coalesce(s["time"], F.when(
                (s["sum"] + x["area"] >= want) & (x["area"] > 0), x["start"] + _within(x, want - s["sum"]))).alias("time"),
            (x["start"] + x["width"]).alias("end")),
    )
    return F.coalesce(walked["time"], walked["end"])


def _within(x: Column, part: Column) -> Column:
    """Distance from the piece's start to where ``part`` of its area is reached."""
    slope = (x["high"] - x["low"]) / x["width"]
    root = F.sqrt(F.greatest(x["low"] * x["low"] + 2 * slope * part, F.lit(0.0)))
    bottom = x["low"] + root
    return F.when(bottom > 0, 2 * part / bottom).otherwise(0.0)


def sized(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``source``, ``size`` (words of the whole text), ``draw`` (a hash that orders the rows
    of a source) and ``key`` (a hash of id, source and text), stored."""
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    draw = F.md5(F.concat_ws("/", F.col(id_col).cast("string"), size.cast("string"))).alias("draw")
    return stored(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), draw,
        row_key(id_col, source_col, text_col).alias("key")), "mix-sizes")


def row_key(id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> Column:
    """Tells rows apart; rows that share it are one document that occurs several times."""
    return F.xxhash64(id_col, source_col, text_col)


def targets(sizes: DataFrame, schedules: DataFrame, budget: float) -> DataFrame:
    """``source``, ``source_size``, ``schedule`` and ``target`` of each source.

    ``schedules`` has ``source`` and ``schedule``.  The budget is ``budget`` times all words, shared by
    weight; no target is above ``MAX_EPOCHS`` times its source's words, and what is cut off is
    shared again among the others until none is above.  Each round is one aggregation over the
    sources, of which one number reaches the driver.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    sources = stored(
        by_source.join(schedules.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        .select("source", "source_size", "schedule", area(F.col("schedule")).alias("weight"),
                (F.col("source_size") * float(MAX_EPOCHS)).alias("limit")), "mix-sources")
    total = (sources.agg(F.sum("source_size")).first()[0] or 0) * budget
    rate, capped = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(rate) > F.col("limit")
        n, fixed, weight = sources.agg(
            F.count_if(above), F.sum(F.when(above, F.col("limit")).otherwise(0.0)),
            F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        if n == capped or not weight:
            break
        capped, rate = n, (total - fixed) / weight
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(rate), F.col("limit")))


def mix(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """Every row of ``sizes`` with ``source_size``, ``target``, ``taken`` and ``copies``.

    A source's rows are taken in the order of ``draw``, over again in further epochs, until the
    words come to its target (rounded down); the row in which that happens is taken in part.  A
    copy has ``epoch``, ``words``, ``first`` (it is its source's first) and ``time``, the moment by which its source's schedule
    demands its first word.  Rows without words have no copies.  The order depends on ids and
    sizes alone, so that reruns agree.

    Running sums are formed in two steps, over hash buckets of a source and within a bucket:
    a source that holds most rows is spread like any other.
    """
    buckets = max(1, -(-sizes.count() // BUCKET_ROWS))
    # The leading digits of the hash, so that the order of buckets is that of the hash.
    prefix = F.conv(F.substring("draw", 1, 8), 16, 10).cast("long")
    rows = sizes.withColumn("bucket", F.floor(prefix * F.lit(buckets) / F.lit(1 << 32)).cast("long"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    ahead = sums.select("source", "bucket", (
        F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words")).alias("ahead")).alias("a")
    # One row for each bucket, with what concerns its source.
    known = ahead.join(goals.alias("g"), F.col("a.source").eqNullSafe(F.col("g.source"))).select(
        "a.source", "a.bucket", "a.ahead", "g.source_size", "g.target", "g.schedule").alias("k")
    order = Window.partitionBy("source", "bucket").orderBy("draw", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("upto", F.sum("size").over(order))
    offset = F.col("k.ahead") + F.col("p.upto") - F.col("p.size")
    joined = (
        placed.alias("p")
        .join(known, F.col("p.source").eqNullSafe(F.col("k.source")) & (F.col("p.bucket") == F.col("k.bucket")))
        .select("p.doc_id", "p.source", "p.size", "p.draw", "p.key", "k.source_size", "k.target", "k.schedule",
                offset.alias("offset"))
    )
    goal = F.floor("target").cast("long")

    def copy(epoch: int) -> Column:
        at = F.col("offset") + F.col("source_size") * epoch
        words = F.greatest(F.least(F.col("size"), goal - at), F.lit(0)).cast("long")
        return F.struct(F.lit(epoch).alias("epoch"), words.alias("words"), (at == 0).alias("first"),
                        F.when(words > 0, invert(F.col("schedule"), at / F.col("target"))).alias("time"))

    copies = F.filter(F.array(*map(copy, range(MAX_EPOCHS))), lambda c: c["words"] > 0)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda s, c: s + c["words"])
    return joined.withColumn("copies", copies).select(
        "doc_id", "source", "size", "draw", "key", "source_size", "target", taken.alias("taken"), "copies")


def in_order(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", source_col: str = "source",
             text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` as often as ``mixed`` takes them, whole and in the order of training,
    sorted by range over the partitions.

    A copy of which less than half is taken is left out, unless it is its source's first: no source
    with a positive target is lost.  Rows equal in id, source and text are
    one document that occurs several times.
    """
    copy = F.explode(F.filter("copies", lambda c: c["first"] | (c["words"] * 2 >= F.col("size"))))
    times = mixed.select("doc_id", "key", "draw", copy.alias("copy"))
    rows = packed(docs).withColumn("row_key", row_key(f"row.{id_col}", f"row.{source_col}", f"row.{text_col}"))
    if not mixed.groupBy("doc_id", "key").count().where("count > 1").isEmpty():
        rows = rows.dropDuplicates(["row_key"])
    return (
        rows.join(times, F.col(f"row.{id_col}").eqNullSafe(F.col("doc_id")) & (F.col("row_key") == F.col("key")))
        .orderBy("copy.time", "draw", "key").select("row.*")
    )


def cycle(sizes: DataFrame, schedules: list[list[tuple[float, float]]]) -> DataFrame:
    """``source`` and ``schedule``: the schedules in turn over the sources by code point, null last."""
    ranked = sizes.select("source").distinct().select("source", F.row_number().over(
        Window.orderBy(F.col("source").asc_nulls_last())).alias("rank"))
    turns = F.array(*(
        F.array(*(F.struct(F.lit(float(t)).alias("time"), F.lit(float(w)).alias("weight")) for t, w in s))
        for s in schedules))
    return ranked.select("source", F.get(turns, (F.col("rank") - 1) % len(schedules)).cast(SCHEDULE).alias("schedule"))
