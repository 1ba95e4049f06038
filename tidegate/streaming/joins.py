"""Temporal join of two streams."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame

from tidegate.operators.joins import temporal_join


def temporal_join_stream(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_ts: str, right_ts: str,
    left_ttl: timedelta, right_ttl: timedelta, delay: str,
) -> DataFrame:
    """As ``temporal_join``; each side's rows stay in state until no partner can come.

    Spark derives that time from the watermarks and the interval test, so the state of a
    side holds its buffer time plus ``delay`` and no more.  The time bucket in the join key
    spreads one busy key over several state partitions.
    """
    return temporal_join(
        left.withWatermark(left_ts, delay), right.withWatermark(right_ts, delay),
        on, left_ts, right_ts, left_ttl, right_ttl,
    )
