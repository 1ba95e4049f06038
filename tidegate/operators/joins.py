"""Temporal join (J1; J2 on streams), latest-value join (J3) and label lookup."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.functions.exprs import block_of, interval, micros, to_micros
from tidegate.operators.blocks import latest
from tidegate.operators.skew import HOT_ROWS, lookup_join, salt_both

_BUCKET = "_tg_time"


def temporal_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_ts: str, right_ts: str,
    left_ttl: timedelta, right_ttl: timedelta, hot_rows: int = HOT_ROWS,
    left_load: DataFrame | None = None, right_load: DataFrame | None = None,
) -> DataFrame:
    """Inner join on equal keys where ``-right_ttl <= right time - left time <= left_ttl``.

    A key with a long history would pair all its rows before the time test.  So time is cut
    into buckets as wide as the whole interval: a right row lies in one bucket, a left row
    looks into the at most two its interval touches, and (key, bucket) is an equi-join.
    Each pair meets in exactly one bucket.  Hot (key, bucket) groups are salted; their
    rows are counted on ``left_load`` and ``right_load`` if given, frames with the same key
    and time columns that are cheaper to read than the sides themselves.  The same plan
    serves two streams, where watermarks on both times bound the state.
    """
    clash = set(left.columns) & set(right.columns) - set(on)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    before, after = to_micros(right_ttl), to_micros(left_ttl)
    if before < 0 or after < 0:
        raise ValueError("a buffer time must not be negative")
    width = max(before + after, 1)

    def look_into(df: DataFrame) -> DataFrame:
        at = micros(F.col(left_ts))
        first, last = block_of(at - F.lit(before), width), block_of(at + F.lit(after), width)
        return df.withColumn(_BUCKET, F.explode(F.sequence(first, last)))

    def lie_in(df: DataFrame) -> DataFrame:
        return df.withColumn(_BUCKET, block_of(micros(F.col(right_ts)), width))

    left_rows, right_rows, cols = look_into(left), lie_in(right), [*on, _BUCKET]
    if not (left.isStreaming or right.isStreaming):
        # A null key joins nothing, so it must not count as a hot one.
        loads = (left if left_load is None else left_load, right if right_load is None else right_load)
        counted = [df.dropna(subset=list(on)) for df in loads]
        left_rows, right_rows, cols = salt_both(
            left_rows, right_rows, cols, hot_rows, look_into(counted[0]), lie_in(counted[1])
        )
    l, r = left_rows.alias("l"), right_rows.alias("r")
    cond = F.col(f"l.{cols[0]}") == F.col(f"r.{cols[0]}")
    for c in cols[1:]:
        cond = cond & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    cond = (
        cond
        & (F.col(f"r.{right_ts}") >= F.col(f"l.{left_ts}") - interval(right_ttl))
        & (F.col(f"r.{right_ts}") <= F.col(f"l.{left_ts}") + interval(left_ttl))
    )
    out = [F.col(f"l.{c}") for c in left.columns] + [F.col(f"r.{c}") for c in right.columns if c not in on]
    return l.join(r, cond, "inner").select(*out)


def latest_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_ts: str, right_ts: str, ttl: timedelta,
    right_tie: Sequence[str], hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Each left row with the newest right row of its key at or before it and at most ``ttl`` old.

    Both sides go into one ordered run per key and the last right row is carried down it:
    no pairs are formed.  Hot keys are cut into slices (see ``blocks``).
    Left rows that find nothing, or have a null key, drop out.
    """
    clash = set(left.columns) & set(right.columns) - set(on)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    rest = [c for c in right.columns if c not in on]
    found = F.struct(*[F.col(c) for c in rest])
    right_rows = right.select(
        *on, F.col(right_ts).alias("_tg_at"), F.lit(0).alias("_tg_side"),
        F.struct(*[F.col(c) for c in right_tie]).alias("_tg_tie"), found.alias("_tg_right"),
    )
    left_rows = left.select(
        *on, F.col(left_ts).alias("_tg_at"), F.lit(1).alias("_tg_side"),
        F.struct(*[F.col(c) for c in left.columns if c not in on]).alias("_tg_left"),
    )
    both = right_rows.unionByName(left_rows, allowMissingColumns=True)
    for c in on:
        both = both.where(F.col(c).isNotNull())
    order = [F.col("_tg_at"), F.col("_tg_side"), F.col("_tg_tie")]
    filled = latest(both, on, order, F.col("_tg_right"), "_tg_found", hot_rows=hot_rows)
    return (
        filled.where("_tg_side = 1")
        .where(F.col(f"_tg_found.{right_ts}") >= F.col("_tg_at") - interval(ttl))
        .select(*on, "_tg_left.*", "_tg_found.*")
    )


def consumer_map_join(messages: DataFrame, consumers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Label each stored message with the component that reads its stream.

    ``consumers`` has one row (stream, component) per stream.  Returns the labelled messages
    and those of streams nobody reads, which are an error for the caller.
    """
    labelled = lookup_join(messages, consumers.select("stream", "component"), ["stream"])
    return labelled.where("component is not null"), labelled.where("component is null").drop("component")
