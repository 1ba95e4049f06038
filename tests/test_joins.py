import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tidegate.operators.joins import consumer_map_join, latest_join, temporal_join
from tidegate.operators.skew import lookup_join, salt_both, salt_for_join, spread_by


def sides(spark, n=400, span=600, seed=1):
    rnd = random.Random(seed)
    key = lambda: rnd.choice(["hot", "hot", "a", "b", None])
    left = [(key(), rnd.randrange(-span, span), i) for i in range(n)] + [("hot", 5, 10_000)] * 50
    right = [(key(), rnd.randrange(-span, span), i) for i in range(n)] + [("hot", 7, 10_000)] * 50
    return left, right


def frames(spark, left, right):
    l = spark.createDataFrame(left, "k string, lt long, lid long").withColumn("lts", F.timestamp_seconds("lt"))
    r = spark.createDataFrame(right, "k string, rt long, rid long").withColumn("rts", F.timestamp_seconds("rt"))
    return l, r


@pytest.mark.parametrize("hot_rows", [10**9, 0, 60], ids=["plain", "salted", "partly salted"])
@pytest.mark.parametrize("left_ttl, right_ttl", [(20, 5), (0, 0), (0, 30)])
def test_temporal_join(spark, left_ttl, right_ttl, hot_rows):
    left, right = sides(spark)
    expected = sorted(
        (lid, rid) for lk, lt, lid in left for rk, rt, rid in right
        if lk is not None and lk == rk and -right_ttl <= rt - lt <= left_ttl
    )
    l, r = frames(spark, left, right)
    out = temporal_join(l, r, ["k"], "lts", "rts", timedelta(seconds=left_ttl), timedelta(seconds=right_ttl), hot_rows)
    assert sorted((x.lid, x.rid) for x in out.collect()) == expected
    assert out.columns == ["k", "lt", "lid", "lts", "rt", "rid", "rts"]


def test_temporal_join_refuses_clashing_columns(spark):
    l, r = frames(spark, [("a", 1, 1)], [("a", 1, 1)])
    with pytest.raises(ValueError):
        temporal_join(l.withColumn("x", F.lit(1)), r.withColumn("x", F.lit(1)), ["k"], "lts", "rts",
                      timedelta(1), timedelta(1))


@pytest.mark.parametrize("hot_rows", [10**9, 0], ids=["one task per key", "slices"])
@pytest.mark.parametrize("ttl", [0, 7, 100000])
def test_latest_join(spark, ttl, hot_rows):
    left, right = sides(spark, n=300)
    right = list({(k, t): (k, t, i) for k, t, i in right}.values())
    expected = []
    for k, t, i in left:
        seen = [(rt, rid) for rk, rt, rid in right if k is not None and rk == k and t - ttl <= rt <= t]
        if seen:
            expected.append((i, max(seen)[1]))
    l, r = frames(spark, left, right)
    out = latest_join(l, r, ["k"], "lts", "rts", timedelta(seconds=ttl), ["rid"], hot_rows)
    assert sorted((x.lid, x.rid) for x in out.collect()) == sorted(expected)


def test_salt_splits_copies(spark):
    """Copies of one row get several salts, so that they spread."""
    facts = spark.createDataFrame([("x", 1)] * 400, "k string, v int").repartition(8)
    table = spark.createDataFrame([("x", "label")], "k string, name string")
    heavy, other, cols = salt_for_join(facts, table, ["k"], floor=50)
    assert cols == ["k", "_tg_salt"]
    assert heavy.select("_tg_salt").distinct().count() > 1
    assert other.count() == 8
    assert heavy.join(other, cols).count() == 400


def test_salting_grows_with_the_rows(spark):
    """Rows that are repeated per part of a hot key grow in proportion, not with the product of the sides."""
    def repeated(n):
        left = spark.range(n).selectExpr("'x' AS k", "id AS a")
        right = spark.range(n).selectExpr("'x' AS k", "id AS b")
        l, r, cols = salt_both(left, right, ["k"], 0)
        assert l.join(r, cols).count() == n * n
        assert l.select("_tg_salt_l").distinct().count() > 1 and r.select("_tg_salt_r").distinct().count() > 1
        return l.count() + r.count()

    assert repeated(600) <= 3 * repeated(200)


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_lookup_join_is_the_same_large_or_small(spark, how):
    facts = spark.range(600).selectExpr("id", "CASE WHEN id < 400 THEN 'hot' ELSE 'k' || (id % 7) END AS k")
    table = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3)], "k string, n int")
    small = lookup_join(facts, table, ["k"], how)
    large = lookup_join(facts, table, ["k"], how, small=1, floor=20)
    assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, large.select(*small.columns).collect()), key=str)
    assert "_tg_salt" not in large.columns


def test_spread_by_keeps_rows(spark):
    df = spark.range(500).selectExpr("id", "id % 3 AS shard")
    for floor in (10, 10**9):
        assert sorted(r.id for r in spread_by(df, ["shard"], floor).collect()) == list(range(500))


def test_consumer_map(spark):
    msgs = spark.createDataFrame([("s1", 1), ("s2", 2), ("s3", 3)], "stream string, seq long")
    plan = spark.createDataFrame([("s1", "dedup"), ("s2", "sink")], "stream string, component string")
    good, unmapped = consumer_map_join(msgs, plan)
    assert sorted((r.stream, r.component) for r in good.collect()) == [("s1", "dedup"), ("s2", "sink")]
    assert [r.stream for r in unmapped.collect()] == ["s3"]
