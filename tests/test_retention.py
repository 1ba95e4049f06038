"""Limits on streams of messages against the rule read literally."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from tidegate.operators import retention


def make(spark, seed=0, n=300):
    rnd = random.Random(seed)
    rows, seqs = [], {}
    for _ in range(n):
        stream = rnd.choice(["a", "b", None])
        seqs[stream] = seqs.get(stream, 0) + rnd.randint(1, 4)
        rows.append((stream, seqs[stream], "x" * rnd.choice([0, 1, 3, 10, 40]) if rnd.random() > .05 else None))
    return rows, spark.createDataFrame(rows, "stream string, seq long, data string")


def walk(rows, limit, size, rule):
    """Kept (stream, seq); ``rule``: prefix, fitting, or last (from the newest back)."""
    kept, used, full = set(), {}, set()
    for stream, seq, data in sorted(rows, key=lambda r: -r[1] if rule == "last" else r[1]):
        total = used.get(stream, 0) + size(data)
        if stream in full or total > limit:
            if rule != "fitting":
                full.add(stream)
            continue
        used[stream] = total
        kept.add((stream, seq))
    return kept


def keys(df):
    return {(r.stream, r.seq) for r in df.select("stream", "seq").collect()}


BYTES, ONE = (lambda d: len(d or "")), (lambda d: 1)


@pytest.mark.parametrize("limit", [1, 57, 300, 10**6])
def test_limits(spark, limit):
    rows, df = make(spark)
    for rule in ("prefix", "fitting"):
        kept, refused = retention.admit_bytes(df, limit, rule=rule)
        assert keys(kept) == walk(rows, limit, BYTES, rule)
        assert keys(kept) | keys(refused) == {r[:2] for r in rows} and not keys(kept) & keys(refused)
    assert keys(retention.trim_bytes(df, limit)) == walk(rows, limit, BYTES, "last")
    assert keys(retention.admit_msgs(df, limit)[0]) == walk(rows, limit, ONE, "prefix")
    assert keys(retention.trim_msgs(df, limit)) == walk(rows, limit, ONE, "last")


@pytest.mark.parametrize("limit", [1, 40, 57, 300, 2000, 10**6])
def test_fitting_over_many_blocks(spark, monkeypatch, limit):
    """Few rows to a block, a stream with most of all rows, and one that holds a null."""
    monkeypatch.setattr(retention, "SEQ_BLOCK", 16)
    rows, df = make(spark, seed=3, n=400)
    hot = [("hot", 7 * i + 1, "x" * (i * 37 % 90)) for i in range(500)]
    both = df.unionByName(spark.createDataFrame(hot, df.schema))
    kept, refused = retention.admit_bytes(both, limit, rule="fitting")
    assert keys(kept) == walk(rows + hot, limit, BYTES, "fitting")
    assert kept.count() + refused.count() == len(rows) + len(hot)


def test_take_fitting():
    rnd = random.Random(5)
    for n in range(60):
        sizes, room = [rnd.randrange(12) for _ in range(n)], rnd.randrange(60)
        taken, left = retention.take_fitting(np.array(sizes, np.int64), room)
        expected, at = [], room
        for s in sizes:
            expected.append(s <= at)
            at -= s if s <= at else 0
        assert taken.tolist() == expected and left == at


def test_null_streams_are_limited(spark):
    df = spark.createDataFrame([(None, i, "0123456789") for i in range(5)], "stream string, seq long, data string")
    assert keys(retention.admit_msgs(df, 2)[0]) == {(None, 0), (None, 1)}
    assert keys(retention.retain(df, "Limits", max_bytes=20, discard="old")) == {(None, 3), (None, 4)}
    assert keys(retention.retain(df, "Limits", max_bytes=20)) == {(None, 0), (None, 1)}
    assert retention.admit_msgs(df, 0)[0].count() == 5 and retention.trim_bytes(df, -1).count() == 5


def test_age_count_and_size_together(spark):
    at = datetime(2024, 1, 10)
    df = spark.createDataFrame([("s", i, "xx", at + timedelta(days=i)) for i in range(10)],
                               "stream string, seq long, data string, time timestamp")
    rows = retention.retain(df, "Limits", max_age=timedelta(days=6), as_of=at + timedelta(days=9), max_msgs=5, max_bytes=6,
                            discard="old")
    assert keys(rows) == {("s", 7), ("s", 8), ("s", 9)}


def test_unknown_rule_is_refused(spark):
    with pytest.raises(ValueError):
        retention.admit_bytes(make(spark)[1], 5, rule="other")
