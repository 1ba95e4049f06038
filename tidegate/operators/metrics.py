"""Labelled counters (M1-M3), the duration histogram (M4) and windowed export (M5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Histogram bounds in seconds, and the export interval.
DURATION_BOUNDS = (0.1, 1.0, 5.0, 10.0, 30.0, 60.0, 300.0, 600.0)
EXPORT_INTERVAL = "10 seconds"


def counter(df: DataFrame, labels: Sequence[str], out: str = "n") -> DataFrame:
    """Rows per label set; combines map-side, so a frequent label set is no hot key."""
    return df.groupBy(*labels).agg(F.count(F.lit(1)).alias(out))


def histogram(
    df: DataFrame, value: str, labels: Sequence[str], bounds: Sequence[float] = DURATION_BOUNDS
) -> DataFrame:
    """Rows per bucket and up to it, for every bucket, also the empty ones.

    ``le`` is the bucket's inclusive upper bound, null for the last one.  One pass counts
    the rows up to each bound, map-side; a bucket is the difference of two such counts.
    """
    v = F.col(value)
    up_to = [F.count_if(v <= F.lit(float(b))) for b in bounds] + [F.count(v)]
    counted = df.groupBy(*labels).agg(F.array(*up_to).alias("_tg_n"))
    rows = []
    for i, bound in enumerate([*bounds, None]):
        here = F.col("_tg_n")[i]
        rows.append(F.struct(
            F.lit(i).alias("bucket"),
            F.lit(bound).cast("double").alias("le"),
            (here if i == 0 else here - F.col("_tg_n")[i - 1]).alias("n"),
            here.alias("cumulative"),
        ))
    return counted.select(*labels, F.inline(F.array(*rows)))


def counter_stream(
    df: DataFrame, ts: str, labels: Sequence[str], every: str = EXPORT_INTERVAL, late: str | None = None
) -> DataFrame:
    """Increment per export interval.  On a stream, ``late`` is the watermark delay."""
    rows = df.withColumn("_tg_at", F.col(ts).cast("timestamp"))
    if late is not None:
        rows = rows.withWatermark("_tg_at", late)
    return (
        rows.groupBy(F.window("_tg_at", every).alias("w"), *labels).agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.col("w.start").cast("timestamp_ntz").alias("window_start"),
            F.col("w.end").cast("timestamp_ntz").alias("window_end"), *labels, "n",
        )
    )
