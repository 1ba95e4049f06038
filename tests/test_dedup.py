import random
import sys
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tidegate.operators.dedup import dedup, dedup_all

SCHEMA = "k string, g int, t long, id long"


def kept_ids(rows, width):
    """The rule, read literally."""
    anchors, kept = {}, []
    for k, g, t, i in sorted((r for r in rows if None not in r[:2]), key=lambda r: (r[0], r[1], r[2], r[3])):
        if (k, g) not in anchors or t >= anchors[k, g] + width:
            anchors[k, g] = t
            kept.append(i)
    return sorted(kept + [r[3] for r in rows if None in r[:2]])


def frame(spark, rows, partitions=4):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("t")).repartition(partitions)


def run(spark, rows, width, hot_rows):
    out = dedup(frame(spark, rows), ["k", "g"], "ts", timedelta(seconds=width), ["id"], hot_rows=hot_rows)
    return sorted(r.id for r in out.select("id").collect())


def make(seed, n, span, step=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = ("hot", 1) if rnd.random() < 0.6 else (rnd.choice(["a", "b", None]), rnd.choice([1, 2, None]))
        rows.append((*key, rnd.randrange(span) // step * step, i))
    return rows


@pytest.mark.parametrize("hot_rows", [10**9, 0], ids=["by key", "sliced"])
@pytest.mark.parametrize(
    "seed, span, step, width",
    [(1, 3000, 1, 10), (2, 3000, 1, 500), (3, 3000, 1, 5000), (4, 100000, 1, 50), (5, 3000, 10, 30), (6, 300, 1, 1)],
)
def test_matches_the_rule(spark, seed, span, step, width, hot_rows):
    rows = make(seed, 2000, span, step)
    assert run(spark, rows, width, hot_rows) == kept_ids(rows, width)


@pytest.mark.parametrize("way", ["_follow", "_double"])
def test_many_slices_of_one_key(spark, monkeypatch, way):
    """More slices than windows, and more windows than slices; both ways to find the anchors."""
    module = sys.modules["tidegate.operators.dedup"]
    follow, double = module._follow, module._double
    monkeypatch.setattr(module, "_follow", lambda r, o, w, s: double(r, o, w, s, 64) if way == "_double" else follow(r, o, w, s))
    monkeypatch.setattr(module, "_double", lambda r, o, w, s, n: follow(r, o, w, s) if way == "_follow" else double(r, o, w, s, n))
    rows = [("x", 1, t, t) for t in range(4000)] + make(11, 1000, 4000)
    monkeypatch.setattr(sys.modules["tidegate.operators.blocks"], "SLICE_ROWS", 100)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        for width in (7, 30, 700):
            assert run(spark, rows, width, 0) == kept_ids(rows, width)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("hot_rows", [10**9, 0])
def test_copies_and_empty_input(spark, hot_rows):
    """A third of all rows are copies of one row."""
    rows = make(7, 1000, 2000) + [("copy", 1, 50, 1)] * 500
    assert run(spark, rows, 20, hot_rows) == kept_ids(rows, 20)
    assert run(spark, rows[:0], 20, hot_rows) == []


@pytest.mark.parametrize("hot_rows", [10**9, 0])
def test_no_two_kept_rows_are_closer_than_the_window(spark, hot_rows):
    out = dedup(frame(spark, make(8, 3000, 9000)), ["k", "g"], "ts", timedelta(seconds=25), ["id"], hot_rows=hot_rows)
    gaps = out.where("k IS NOT NULL AND g IS NOT NULL").selectExpr(
        "t - lag(t) OVER (PARTITION BY k, g ORDER BY t, id) AS gap")
    assert gaps.agg(F.min("gap")).first()[0] >= 25


def test_boundary_and_types(spark):
    """A row exactly one window later is kept; the other columns pass unchanged."""
    rows = [("x", 1, 0, 1), ("x", 1, 9, 2), ("x", 1, 10, 3), ("x", 1, 10, 4)]
    df = frame(spark, rows).withColumns({"tags": F.array("k"), "price": F.lit("1.50").cast("decimal(9,2)"),
                                         "local": F.col("ts").cast("timestamp_ntz")})
    for hot_rows in (10**9, 0):
        out = dedup(df, ["k"], "local", timedelta(seconds=10), ["id"], hot_rows=hot_rows)
        assert out.schema == df.schema
        assert sorted(out.collect()) == sorted(df.where("id IN (1, 3)").collect())


def test_float_keys(spark):
    nan = float("nan")
    df = spark.createDataFrame([(nan, 0, 1), (nan, 1, 2), (0.0, 0, 3), (-0.0, 1, 4)], "k double, t long, id long")
    df = df.withColumn("ts", F.timestamp_seconds("t"))
    out = dedup(df, ["k"], "ts", timedelta(seconds=10), ["id"])
    assert sorted(r.id for r in out.collect()) == [1, 3]


def test_nested_keys_are_refused(spark):
    df = frame(spark, make(1, 5, 5)).withColumn("a", F.array("k"))
    with pytest.raises(TypeError):
        dedup(df, ["a"], "ts", timedelta(seconds=1), ["id"])


TYPED = [
    "CASE WHEN id % 5 < 2 THEN timestamp'2024-01-01 00:00:00' ELSE timestamp'2024-01-01 00:00:00.000001' END AS at",
    "CASE WHEN id % 5 < 2 THEN -0.0D WHEN id % 5 = 2 THEN 0.0D ELSE double('NaN') END AS real",
    "CASE WHEN id % 5 < 2 THEN X'00FF' ELSE X'00FE' END AS raw",
    "CASE WHEN id % 5 < 2 THEN 1.10BD ELSE 1.1000000001BD END AS price",
]


@pytest.mark.parametrize("key", ["at", "real", "raw", "price"])
def test_one_answer_for_typed_keys(spark, key):
    """Keys a microsecond, a byte or a digit apart are different keys in either plan."""
    df = spark.range(0, 600).selectExpr("id", "timestamp_seconds(id div 3) AS ts", *TYPED)
    value = {r.id: str(r.v) for r in df.select("id", (F.hex(key) if key == "raw" else F.col(key).cast("string")).alias("v")).collect()}
    value = {i: "0.0" if v == "-0.0" else v for i, v in value.items()}
    anchors, want = {}, []
    for i in range(600):
        if value[i] not in anchors or i // 3 >= anchors[value[i]] + 9:
            anchors[value[i]] = i // 3
            want.append(i)
    for hot_rows in (10**9, 0):
        out = dedup(df.repartition(3), [key], "ts", timedelta(seconds=9), ["id"], hot_rows=hot_rows)
        assert sorted(r.id for r in out.collect()) == want


@pytest.mark.parametrize("hot_rows", [10**9, 0])
@pytest.mark.parametrize("width", [0, 10])
def test_null_times_are_kept(spark, hot_rows, width):
    rows = [("a", 1, None, 0), ("a", 1, None, 1), ("b", 1, None, 2), (None, 1, None, 3)]
    rows += [("a", 1, t, 10 + t) for t in range(0, 40, 2)] + [("b", 1, t, 100 + t) for t in range(0, 40, 3)]
    want = sorted([0, 1, 2, 3] + kept_ids([r for r in rows if r[2] is not None], width or 10**9))
    df = frame(spark, rows, 1).union(frame(spark, [], 1))
    out = dedup(df, ["k", "g"], "ts", timedelta(seconds=width), ["id"], hot_rows=hot_rows)
    assert sorted(r.id for r in out.collect()) == want


def test_a_hot_key_is_split_whatever_the_total(spark):
    """Many keys below the bound add up to far more than it; only the one above it is hot."""
    from tidegate.operators.skew import hot_filter
    df = spark.range(0, 60_000).selectExpr("CASE WHEN id < 200 THEN -1 ELSE id div 60 END AS k")
    hot = hot_filter(df, ["k"], 100)
    assert hot.rows == 200 and df.where(hot.condition).distinct().count() == 1
    assert hot_filter(df, ["k"], 200) is None


def test_window_zero_keeps_the_first(spark):
    rows = make(9, 500, 100)
    expected = kept_ids(rows, 10**9)
    assert sorted(r.id for r in dedup_all(frame(spark, rows), ["k", "g"], "ts", ["id"]).collect()) == expected
    assert run(spark, rows, 0, 10**9) == expected
