"""Shard routing as partitioned table layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions.exprs import short_hash
from tidegate.operators.blocks import row_index
from tidegate.operators.skew import HOT_ROWS, spread_by


def shard_count(writers: int, readers: int) -> int:
    """As many shards as the wider of the two sides needs."""
    return max(writers, readers, 1)


def shard_by_key(df: DataFrame, keys: Sequence[str], n: int, out: str = "shard", portable: bool = True) -> DataFrame:
    """Equal keys land in one shard.

    ``portable`` takes the first 32 bits of MD5, which any system can recompute; otherwise
    the engine's own 64-bit hash.
    """
    if not portable:
        return df.withColumn(out, F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int"))
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    head = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")
    return df.withColumn(out, F.pmod(head, F.lit(n)).cast("int"))


def lay_out(df: DataFrame, shard: str = "shard", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Physical layout before a partitioned write: a shard's rows together, a hot one over several tasks."""
    return spread_by(df, [shard], hot_rows)


def shard_round_robin(
    df: DataFrame, order: Sequence[Column], block: Column, sources: int, targets: int
) -> DataFrame:
    """Add ``subject`` (row number modulo subjects) and ``shard`` (subject modulo targets).

    The row number comes from per-block counts, so no task sees all rows; ``block`` must be
    non-decreasing along ``order``.
    """
    subjects = shard_count(sources, targets)
    return (
        row_index(df, [], order, block, "_tg_row")
        .withColumn("subject", F.pmod(F.col("_tg_row") - 1, F.lit(subjects)).cast("int"))
        .withColumn("shard", F.pmod(F.col("subject"), F.lit(targets)).cast("int"))
        .drop("_tg_row")
    )


def reshard(df: DataFrame, old_n: int, new_n: int, shard: str = "shard", dedup: bool = False) -> DataFrame:
    """Shrink: shards above the new count fold onto ``i mod new``; the others stay.

    Refused while the pipeline deduplicates (``dedup``): the anchors of keys that move would stay
    behind with their old shard, and copies would get through.
    """
    if new_n >= old_n:
        return df
    if dedup:
        raise ValueError(f"cannot shrink from {old_n} to {new_n} shards while deduplication is on")
    return df.withColumn(
        shard, F.when(F.col(shard) >= new_n, F.pmod(F.col(shard), F.lit(new_n))).otherwise(F.col(shard)).cast("int")
    )


def reshard_check(before: DataFrame, after: DataFrame, new_n: int, shard: str = "shard") -> DataFrame:
    """Per new shard: rows expected from the old layout, rows found, and whether they agree."""
    expected = before.groupBy(F.pmod(F.col(shard), F.lit(new_n)).cast("int").alias("shard")).agg(
        F.count(F.lit(1)).alias("expected")
    )
    found = after.groupBy(F.col(shard).cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("found"))
    return (
        expected.join(found, "shard", "full")
        .select("shard", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("found", F.lit(0)).alias("found"))
        .withColumn("conserved", F.col("expected") == F.col("found"))
    )


def stale_shards(existing: DataFrame, planned: DataFrame) -> DataFrame:
    """Names that exist but are not planned.  The dead-letter table counts as planned."""
    return existing.select("name").join(planned.select("name"), "name", "left_anti")


def old_shard_count(existing: DataFrame) -> DataFrame:
    """How many shards there were: all names but the dead-letter one, never below zero."""
    return existing.agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(0)).cast("bigint").alias("old_count"))


def list_shards(names: DataFrame, prefix: str, pipelines: DataFrame) -> DataFrame:
    """The names that belong to the pipelines: those of the form ``prefix-hash-...``.

    The hash is cut out of each name, so this is an equi-join and not a prefix test per pair.
    The hash is short: two pipelines may share it, and then share their names.  A name exists once
    however often it is listed, so each row of ``pipelines`` gets it once.
    """
    head = f"{prefix}-"
    found = F.when(
        F.col("name").startswith(head) & (F.substring("name", len(head) + 9, 1) == "-"),
        F.substring("name", len(head) + 1, 8),
    )
    owners = pipelines.select("pipeline_id", short_hash(F.col("pipeline_id")).alias("_tg_hash"))
    return names.distinct().withColumn("_tg_hash", found).join(owners, "_tg_hash").drop("_tg_hash")
