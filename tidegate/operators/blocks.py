"""Running values over an ordered group that may be too big for one task.

A plain window gives each group to one task.  Here the group is cut into blocks along its
order.  Each block's end state is a small aggregate; running over those gives the state
every block starts from.  That state joins the block as one more row at its head, so a
window per block yields the running value, and the rows are shuffled once.

A block column must be non-decreasing in the order columns.  Where rows carry a unique
number, blocks of that number do; otherwise ``slices`` cuts the rows by range.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions.exprs import block_of
from tidegate.operators.skew import HOT_ROWS, hot_filter, lookup_join
from tidegate.session import cut_lineage

SEQ_BLOCK = 1 << 20
SLICE_ROWS = 1_000_000

_BLOCK, _VALUE, _REAL, _SLICE, _COPY = "_tg_block", "_tg_value", "_tg_real", "_tg_slice", "_tg_copy"


def slices(
    df: DataFrame, rows: int, part: Sequence[str], order: Sequence[Column | str], name: str = _SLICE, copy: str = _COPY
) -> DataFrame:
    """Cut the rows into sorted slices of about equal size along (part, order), however they lie.

    There are as many slices as ``rows`` need at ``SLICE_ROWS`` each, at least one per core.

    Adds the slice number and a ``copy`` column: the partition a row comes from, which ends
    the order and tells copies of one row apart, so that they can be cut as well.  The
    slices are written once, so that every later step sees the same cuts.
    """
    spark = df.sparkSession
    count = max(spark.sparkContext.defaultParallelism, ceil(rows / SLICE_ROWS))
    return cut_lineage(
        df.withColumn(copy, F.spark_partition_id())
        .repartitionByRange(count, *part, *order, copy)
        .sortWithinPartitions(*part, *order, copy)
        .withColumn(name, F.spark_partition_id())
    )


def _over_blocks(
    rows: DataFrame, heads: DataFrame, part: Sequence[str], order: Sequence[Column | str], value: str, out: str, run
) -> DataFrame:
    """Put each block's head row before its own rows and evaluate ``run(window)`` there."""
    both = rows.withColumn(_REAL, F.lit(1)).unionByName(
        heads.withColumnRenamed("head", value).withColumn(_REAL, F.lit(0)), allowMissingColumns=True
    )
    window = Window.partitionBy(*part, _BLOCK).orderBy(_REAL, *order)
    return both.withColumn(out, run(window)).where(f"{_REAL} = 1").drop(_REAL, _BLOCK, value)


def _up_to_here(window):
    return window.rowsBetween(Window.unboundedPreceding, 0)


def running_sum(
    df: DataFrame, part: Sequence[str], order: Sequence[Column], block: Column, value: Column, out: str
) -> DataFrame:
    """Add ``out``: the sum of ``value`` up to and including the row, within ``part``."""
    rows = df.withColumn(_BLOCK, block).withColumn(_VALUE, value.cast("bigint"))
    before = Window.partitionBy(*part).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    heads = rows.groupBy(*part, _BLOCK).agg(F.sum(_VALUE).alias("total")).select(
        *part, _BLOCK, F.sum("total").over(before).alias("head")
    )
    return _over_blocks(rows, heads, part, order, _VALUE, out, lambda w: F.sum(_VALUE).over(_up_to_here(w)))


def row_index(df: DataFrame, part: Sequence[str], order: Sequence[Column], block: Column, out: str) -> DataFrame:
    """Add ``out``: 1-based position within ``part``."""
    return running_sum(df, part, order, block, F.lit(1), out)


def previous(
    df: DataFrame, part: Sequence[str], order: Sequence[str], cols: Sequence[str], out: str,
    block: Column | None = None, hot_rows: int = HOT_ROWS, measure: DataFrame | None = None,
) -> DataFrame:
    """Add ``out``: a struct of ``cols`` from the row before, null on the first row of ``part``.

    Without ``block`` the rows are counted first (or those of ``measure``, see ``skew``), and only
    hot groups are sliced.
    """
    value = F.struct(*[F.col(c) for c in cols])
    if block is None:
        hot = hot_filter(df if measure is None else measure, part, hot_rows)
        rest = df if hot is None else df.where(~hot.condition)
        plain = rest.withColumn(out, F.lag(value).over(Window.partitionBy(*part).orderBy(*order)))
        if hot is None:
            return plain
        cut = slices(df.where(hot.condition), hot.rows, part, order)
        return plain.unionByName(
            previous(cut, part, [*order, _COPY], cols, out, F.col(_SLICE)).drop(_SLICE, _COPY))
    rows = df.withColumn(_BLOCK, block).withColumn(_VALUE, value)
    across = Window.partitionBy(*part).orderBy(_BLOCK)
    heads = (
        rows.groupBy(*part, _BLOCK)
        .agg(F.max_by(F.col(_VALUE), F.struct(*[F.col(c) for c in order])).alias("tail"))
        .select(*part, _BLOCK, F.lag("tail").over(across).alias("head"))
    )
    return _over_blocks(rows, heads, part, order, _VALUE, out, lambda w: F.lag(_VALUE).over(w))


def latest(
    df: DataFrame, part: Sequence[str], order: Sequence[Column], value: Column, out: str,
    block: Column | None = None, hot_rows: int = HOT_ROWS, measure: DataFrame | None = None,
) -> DataFrame:
    """Add ``out``: the newest non-null ``value`` at or before the row within ``part``."""
    if block is None:
        hot = hot_filter(df if measure is None else measure, part, hot_rows)
        rest = df if hot is None else df.where(~hot.condition)
        here = Window.partitionBy(*part).orderBy(*order)
        plain = rest.withColumn(out, F.last_value(value, True).over(_up_to_here(here)))
        if hot is None:
            return plain
        cut = slices(df.where(hot.condition), hot.rows, part, order)
        return plain.unionByName(
            latest(cut, part, [*order, F.col(_COPY)], value, out, F.col(_SLICE)).drop(_SLICE, _COPY))
    rows = df.withColumn(_BLOCK, block).withColumn(_VALUE, value)
    before = Window.partitionBy(*part).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    # Rows without a value have a null ordering, which max_by passes over.
    tail = F.max_by(F.col(_VALUE), F.when(F.col(_VALUE).isNotNull(), F.struct(*order)))
    heads = rows.groupBy(*part, _BLOCK).agg(tail.alias("tail")).select(
        *part, _BLOCK, F.last_value("tail", True).over(before).alias("head")
    )
    return _over_blocks(
        rows, heads, part, order, _VALUE, out, lambda w: F.last_value(_VALUE, True).over(_up_to_here(w))
    )


def admit(
    df: DataFrame, part: Sequence[str], number: str, block_rows: int, value: Column, limit: int, out: str,
    last: bool = False,
) -> DataFrame:
    """Add the boolean ``out``: is the running sum of ``value`` up to the row at most ``limit``?

    Rows of a group run by their unique ``number``, from the first on or from the ``last`` one
    back; ``value`` must not be negative.  A null group is a group like any other.  Block
    totals tell in which one block a group passes the limit; only that block's numbers and
    values are sorted, which gives the number at which the group passes.  All rows are then
    judged by that number alone, in one pass without a shuffle where the groups are few.
    """
    run, n, v, total, upto = "_tg_run", "_tg_number", "_tg_value", "_tg_total", "_tg_upto"
    # Equal as a whole also where fields are null.
    group = F.struct(*[F.col(c) for c in part]) if part else F.struct(F.lit(0).alias("one"))
    signed = -F.col(number) if last else F.col(number)
    slim = df.select(group.alias(run), signed.alias(n), value.cast("bigint").alias(v)).withColumn(
        _BLOCK, block_of(F.col(n), block_rows))
    before = Window.partitionBy(run).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, 0)
    cuts = (
        slim.groupBy(run, _BLOCK).agg(F.sum(v).alias(total)).withColumn(upto, F.sum(total).over(before))
        .where(F.col(upto) > limit).groupBy(run)
        .agg(F.min_by(F.struct(F.col(_BLOCK).alias("block"), (F.col(upto) - F.col(total)).alias("base")), _BLOCK).alias("cut"))
        .select(run, F.col("cut.block").alias(_BLOCK), F.col("cut.base").alias("base"))
    )
    inside = lookup_join(slim, cuts, [run, _BLOCK], "inner").withColumn(
        upto, F.col("base") + F.sum(v).over(_up_to_here(Window.partitionBy(run).orderBy(n))))
    ends = inside.where(F.col(upto) > limit).groupBy(run).agg(F.min(n).alias("_tg_end"))
    judged = lookup_join(df.withColumn(run, group), ends, [run])
    return judged.withColumn(out, F.coalesce(signed < F.col("_tg_end"), F.lit(True))).select(*df.columns, out)
