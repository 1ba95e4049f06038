"""Consumer lag and drain progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.operators.blocks import previous
from tidegate.operators.skew import HOT_ROWS

# The order in which components are torn down.
DRAIN_ORDER = ("dedup", "join", "sink")
NO_CONSUMER = "consumer does not exist"


def stream_counts(names: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages per stream, 0 for a stream that holds or is nothing."""
    counts = messages.groupBy("stream").agg(F.count(F.lit(1)).alias("msgs"))
    return names.select("stream").join(counts, "stream", "left").select(
        "stream", F.coalesce("msgs", F.lit(0)).alias("msgs")
    )


def lag(
    requests: DataFrame, messages: DataFrame, consumers: DataFrame, deliveries: DataFrame, acks: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Lag per requested (stream, consumer): undelivered (pending) and delivered but not acked.

    ``deliveries`` and ``acks`` are (stream, seq, consumer), repeats allowed; a message has one
    (stream, seq).  Pending is what the stream holds less what was delivered of it, so messages
    are counted and never paired with consumers.  Deliveries and acks meet the messages in one
    shuffle on (stream, seq), which no group is heavy in.  A requested consumer that does not
    exist comes back in the second frame with an error.
    """
    known = consumers.select("stream", "consumer").distinct()
    asked = requests.select("stream", "consumer").distinct()

    def marked(df: DataFrame, sent: int, acked: int) -> DataFrame:
        return df.select("stream", "seq", "consumer", F.lit(sent).alias("sent"), F.lit(acked).alias("acked"))

    counted = (
        marked(deliveries, 1, 0).unionByName(marked(acks, 0, 1)).repartition("stream", "seq")
        .groupBy("stream", "seq", "consumer").agg(F.max("sent").alias("sent"), F.max("acked").alias("acked"))
        .where("sent = 1")
        .join(messages.select("stream", "seq"), ["stream", "seq"], "left_semi")
        .groupBy("stream", "consumer").agg(F.count(F.lit(1)).alias("sent"), F.count_if(F.col("acked") == 0).alias("unacked"))
    )
    held = messages.groupBy("stream").agg(F.count(F.lit(1)).alias("held"))
    good = (
        asked.join(known, ["stream", "consumer"], "left_semi")
        .join(held, "stream", "left").join(counted, ["stream", "consumer"], "left")
        .select(
            "stream", "consumer",
            (F.coalesce("held", F.lit(0)) - F.coalesce("sent", F.lit(0))).alias("pending"),
            F.coalesce("unacked", F.lit(0)).alias("unacked"),
        )
    )
    missing = asked.join(known, ["stream", "consumer"], "left_anti").withColumn("error", F.lit(NO_CONSUMER))
    return good, missing


def lag_total(lags: DataFrame) -> DataFrame:
    """Total per pipeline, and per component below it; ``component`` is null on the total row."""
    return (
        lags.rollup("pipeline_id", "component")
        .agg(F.sum(F.col("pending") + F.col("unacked")).alias("total"))
        .where("pipeline_id is not null")
    )


def drain_blocker(lags: DataFrame) -> DataFrame:
    """First component in drain order that still has lag; null when the pipeline is drained."""
    stage = F.lit(None).cast("int")
    for number, name in enumerate(DRAIN_ORDER):
        stage = F.when(F.col("component") == name, F.lit(number)).otherwise(stage)
    busy = (F.col("pending") + F.col("unacked")) > 0
    first = F.min(F.when(busy, stage))
    blocker: Column = F.lit(None).cast("string")
    for number, name in enumerate(DRAIN_ORDER):
        blocker = F.when(F.col("_tg_first") == number, F.lit(name)).otherwise(blocker)
    return lags.groupBy("pipeline_id").agg(first.alias("_tg_first")).select(
        "pipeline_id", blocker.alias("blocker")
    )


def drain_progress(samples: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each check against the one before: ``extend`` while the total falls, else ``stalled``."""
    prev = previous(samples, ["pipeline_id"], ["ts", "check_id"], ["total"], "_tg_prev", hot_rows=hot_rows)
    before = F.col("_tg_prev.total")
    return prev.select(
        *samples.columns, before.alias("previous_total"),
        F.when(before.isNull() | (F.col("total") < before), "extend").otherwise("stalled").alias("outcome"),
    )
