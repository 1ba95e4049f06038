"""Windowed deduplication (D1), unbounded deduplication (D3) and per-side use.

Rule: the rows of a key are read in (event time, tie-break) order.  A row is kept when no
row of its key was kept before, or when at least ``window`` has passed since the last kept
one; dropped rows do not move that anchor.  Rows with a null key or a null event time have no
place in that order and are always kept.

Plan: one shuffle on the key, a sort inside the partition, and a fold over Arrow batches
that keeps one anchor per task.  Keys too heavy for a task are range-partitioned by
(key, time) instead, so that each is cut into slices of equal size, and the anchor that
enters each slice is worked out first (``_entry_anchors``).
"""

from __future__ import annotations

import sys
from bisect import bisect_left
from collections.abc import Sequence
from datetime import timedelta
from functools import reduce
from math import ceil, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.functions.exprs import identity, to_micros
from tidegate.operators.blocks import slices
from tidegate.operators.skew import HOT_ROWS, hot_filter
from tidegate.session import cut_lineage, new_run_dir

_LOOSE, _SLICE, _COPY = "_tg_loose", "_tg_slice", "_tg_copy"
# So many steps at most are followed one by one.
FOLLOW_STEPS = 16

# The partition functions below travel with the job: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def dedup(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    window: timedelta,
    tie: Sequence[str],
    hot_rows: int = HOT_ROWS,
    measure: DataFrame | None = None,
) -> DataFrame:
    """Keep the first row of each key, then the next one at least ``window`` later, and so on.

    ``measure`` may name a cheaper frame with the same keys to count, see ``skew``.
    """
    width = to_micros(window)
    if width <= 0:
        return dedup_all(df, keys, ts, tie)
    for key in keys:
        if isinstance(df.schema[key].dataType, (T.StructType, T.ArrayType, T.MapType)):
            raise TypeError(f"dedup key {key} must be an atomic column")
    loose = _any_null([*keys, ts])
    hot = hot_filter((df if measure is None else measure).where(~_any_null(keys)), keys, hot_rows)
    rest = df if hot is None else df.where(loose | ~hot.condition)
    # Rows without a key never meet, so they are spread evenly.
    spread = F.when(loose, F.xxhash64(ts, *tie, F.spark_partition_id())).otherwise(F.xxhash64(*keys))
    placed = rest.withColumn(_LOOSE, loose).repartition(spread).sortWithinPartitions(*keys, ts, *tie)
    kept = placed.mapInArrow(_fold(list(keys), ts, width), df.schema)
    if hot is None:
        return kept
    heavy = slices(df.where(~loose & hot.condition), hot.rows, keys, [ts, *tie], _SLICE, _COPY)
    anchors = _entry_anchors(heavy, keys, ts, width)
    return kept.unionByName(heavy.mapInArrow(_fold(list(keys), ts, width, anchors), df.schema))


def dedup_all(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str]) -> DataFrame:
    """Window 0: only the first row of each key.  Aggregates map-side, so no key is heavy."""
    loose = _any_null([*keys, ts])
    first = F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(ts, *tie))
    kept = df.where(~loose).groupBy(*keys).agg(first.alias("_tg_first"))
    return kept.select("_tg_first.*").unionByName(df.where(loose))


def dedup_sides(
    left: DataFrame, right: DataFrame, ts: str, tie: Sequence[str],
    left_rule: tuple[Sequence[str], timedelta] | None = None,
    right_rule: tuple[Sequence[str], timedelta] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Each of two topics has its own switch, keys and window."""

    def side(df: DataFrame, rule: tuple[Sequence[str], timedelta] | None) -> DataFrame:
        return df if rule is None else dedup(df, rule[0], ts, rule[1], tie)

    return side(left, left_rule), side(right, right_rule)


def _any_null(keys: Sequence[str]):
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])


def _changes(col: pa.Array) -> np.ndarray:
    """For each value but the first: does it differ from the one before (nulls differ)?"""
    a, b = col.slice(1), col.slice(0, len(col) - 1)
    diff = pc.fill_null(pc.not_equal(a, b), True).to_numpy(zero_copy_only=False)
    if pa.types.is_floating(col.type):
        both_nan = pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False)
        diff = diff & ~both_nan.to_numpy(zero_copy_only=False)
    return diff


def _micros(col: pa.Array) -> np.ndarray:
    return col.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)


def _walk(time: np.ndarray, i: int, end: int, width: int, keep: np.ndarray) -> None:
    """Mark row ``i`` and every next row at least ``width`` later, up to ``end``."""
    if i >= end:
        return
    part = time[i:end]
    onward = np.searchsorted(part, part + width).tolist()
    at, marks = 0, []
    while at < len(onward):
        marks.append(at)
        at = onward[at]
    keep[i + np.array(marks)] = True


def _fold(keys: list[str], ts: str, width: int, anchors: dict[int, int] | None = None):
    """Partition function: rows sorted by (keys, time) in, kept rows out.

    ``anchors`` gives, per slice, the anchor its first key brings along from earlier slices.
    """

    def run(batches):
        last_key = last_time = anchor = None
        last_loose = False
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            table = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            time = _micros(table[ts])
            loose = table[_LOOSE].to_numpy(zero_copy_only=False) if _LOOSE in table else np.zeros(n, bool)
            # A row without a key or a time stands for itself and says nothing about the next one.
            new = loose | np.append(last_loose, loose[:-1])
            last_loose = bool(loose[-1])
            for key in keys:
                new[1:] |= _changes(table[key])
            if last_key is not None:
                new[0] |= any(
                    _changes(pa.concat_arrays([a, table[key].slice(0, 1)]))[0] for a, key in zip(last_key, keys)
                )
            else:
                anchor = anchors.get(table[_SLICE][0].as_py()) if anchors else None
                new[0] |= anchor is None
            # A gap of a whole window restarts the rule whatever came before.
            start = new.copy()
            start[1:] |= (time[1:] - time[:-1]) >= width
            if last_time is not None and time[0] - last_time >= width:
                start[0] = True
            keep = start.copy()
            cuts = np.flatnonzero(start)
            ends = np.append(cuts[1:], n)
            if len(cuts) == 0 or cuts[0] > 0:
                end = cuts[0] if len(cuts) else n
                _walk(time, int(np.searchsorted(time[:end], anchor + width)), end, width, keep)
            if len(cuts):
                long_runs = time[ends - 1] - time[cuts] >= width
                for s, e in zip(cuts[long_runs], ends[long_runs]):
                    _walk(time, s, e, width, keep)
            kept = np.flatnonzero(keep)
            if len(kept):
                anchor = int(time[kept[-1]])
            last_key = [table[key].slice(n - 1, 1) for key in keys]
            last_time = int(time[-1])
            yield batch.filter(pa.array(keep)).drop_columns([c for c in (_LOOSE, _SLICE, _COPY) if c in table])

    return run


# --- keys too heavy for one task -------------------------------------------------------


def _entry_anchors(sliced: DataFrame, keys: Sequence[str], ts: str, width: int) -> dict[int, int]:
    """For each slice that begins inside a key: the last kept time before it.

    Where the rule leaves a slice depends only on the row it enters at, and it enters
    within one window of the slice's first row.  So each slice reports, for those rows,
    where a walk from there ends (``runs``).  Linking each end to the entry it leads to
    gives a graph with at most one step per slice and per window, which is followed from
    each key's first row.  What reaches the driver is at most two rows per slice.
    """
    spark = sliced.sparkSession
    path = new_run_dir(spark, "dedup-runs")
    schema = "key string, slice int, t bigint, ends bigint"
    sliced.select(identity(sliced, keys).alias("key"), F.col(ts), F.col(_SLICE)).mapInArrow(
        _slice_runs(width), schema
    ).write.partitionBy("slice").parquet(path)
    runs = spark.read.schema(schema).parquet(path)

    bounds = runs.groupBy("key", "slice").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("t").alias("n"))
    split = bounds.withColumn("parts", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("parts > 1")
    spans: dict[str, list[Row]] = {}
    for row in split.orderBy("key", "slice").collect():
        spans.setdefault(row["key"], []).append(row)
    if not spans:
        return {}

    # The keys that were cut, at most one per slice.
    cut = runs.join(F.broadcast(split.select("key").distinct()), "key", "left_semi")
    roots = cut.groupBy("key").agg(F.min_by(F.struct("slice", "ends"), F.struct("t", "slice")).alias("r"))
    roots = roots.select("key", "r.slice", "r.ends")
    steps = max(min(len(parts), (parts[-1]["hi"] - parts[0]["lo"]) // width + 2) for parts in spans.values())
    # A step is one small job on one slice per key; doubling shuffles all reported rows.
    if steps <= FOLLOW_STEPS:
        reached = _follow(runs, roots, width, spans)
    else:
        reached = _double(cut, roots, width, spans, steps)

    done: dict[str, list[tuple[int, int]]] = {}
    for key, number, end in reached:
        done.setdefault(key, []).append((number, end))
    return {
        row["slice"]: max(end for number, end in done[key] if number < row["slice"])
        for key, parts in spans.items() for row in parts[1:]
    }


def _follow(runs: DataFrame, roots: DataFrame, width: int, spans: dict[str, list[Row]]) -> list[tuple[str, int, int]]:
    """Step by step, all keys at once; a step reads only the slices it leads to."""
    numbers = {key: ([row["hi"] for row in parts], [row["slice"] for row in parts]) for key, parts in spans.items()}
    reached = [tuple(row) for row in roots.collect()]
    front = reached
    while front:
        asked = []
        for key, _, end in front:
            at = bisect_left(numbers[key][0], end + width)
            if at < len(numbers[key][0]):
                asked.append((key, numbers[key][1][at], end + width))
        if not asked:
            break
        asks = F.broadcast(runs.sparkSession.createDataFrame(asked, "key string, slice int, at bigint"))
        found = (
            runs.where(F.col("slice").isin(sorted({number for _, number, _ in asked})))
            .join(asks, ["key", "slice"]).where("t >= at")
            .groupBy("key", "slice").agg(F.min(F.struct("t", "ends")).alias("r"))
        )
        front = [tuple(row) for row in found.select("key", "slice", "r.ends").collect()]
        reached.extend(front)
    return reached


def _double(
    runs: DataFrame, roots: DataFrame, width: int, spans: dict[str, list[Row]], steps: int
) -> list[tuple[str, int, int]]:
    """By pointer doubling: log2(steps) joins, spread over all tasks.

    Walks that meet stay together, so a slice has few distinct ends when it holds many
    windows, and the graph is small where there are many steps.
    """
    reached, jump = cut_lineage(roots), cut_lineage(_link_ends(runs, width, spans))
    for _ in range(ceil(log2(steps)) + 1):
        step = reached.join(jump, ["key", "slice", "ends"]).select(
            "key", F.col("to_slice").alias("slice"), F.col("to_ends").alias("ends")
        )
        reached = cut_lineage(reached.unionByName(step).distinct())
        onward = jump.toDF("key", "to_slice", "to_ends", "far_slice", "far_ends")
        jump = cut_lineage(
            jump.join(onward, ["key", "to_slice", "to_ends"]).select(
                "key", "slice", "ends", F.col("far_slice").alias("to_slice"), F.col("far_ends").alias("to_ends")
            )
        )
    return [tuple(row) for row in reached.select("key", "slice", "ends").collect()]


def _slice_runs(width: int):
    """Per slice: the possible entries of its first key with their ends, and its last key's start."""

    def ends_of(time):
        nxt = np.searchsorted(time, time + width)
        hop = np.where(nxt < len(time), nxt, np.arange(len(time)))
        while not np.array_equal(further := hop[hop], hop):
            hop = further
        return time[hop]

    def report(key, number, pieces, leading):
        time = np.concatenate(pieces)
        m = min(int(np.searchsorted(time, time[0] + width)) + 1, len(time)) if leading else 1
        return pa.RecordBatch.from_arrays(
            [pa.array([key] * m, pa.string()), pa.array(np.full(m, number, np.int32)),
             pa.array(time[:m]), pa.array(ends_of(time)[:m])],
            names=["key", "slice", "t", "ends"],
        )

    def run(batches):
        key = number = None
        pieces, leading = [], True
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            col, time = batch.column(0), _micros(batch.column(1))
            if number is None:
                number, key = batch.column(2)[0].as_py(), col[0].as_py()
            cuts = np.flatnonzero(np.append(col[0].as_py() != key, _changes(col)))
            if len(cuts):
                if leading:
                    yield report(key, number, [*pieces, time[: cuts[0]]], True)
                leading, pieces = False, [time[cuts[-1]:]]
            else:
                pieces.append(time)
            key = col[n - 1].as_py()
        if key is not None:
            yield report(key, number, pieces, leading)

    return run


def _link_ends(runs: DataFrame, width: int, spans: dict[str, list[Row]]) -> DataFrame:
    """(key, slice, end) -> the slice and end of the walk that goes on from there.

    The next entry is the first reported row at or after ``end + width``.  The slice it
    lies in follows from the slice bounds; inside it one sorted pass finds the row.
    """
    tops = {
        key: (np.array([row["slice"] for row in parts]), np.array([row["hi"] for row in parts]))
        for key, parts in spans.items()
    }

    def aim(batches):
        for batch in batches:
            probe = batch.column(2).to_numpy() + width
            target = np.full(batch.num_rows, -1, np.int32)
            codes = batch.column(0).dictionary_encode()
            for code, key in enumerate(codes.dictionary.to_pylist()):
                if key not in tops:
                    continue
                numbers, tops_of_key = tops[key]
                mine = np.flatnonzero(codes.indices.to_numpy() == code)
                at = np.searchsorted(tops_of_key, probe[mine])
                inside = at < len(numbers)
                target[mine[inside]] = numbers[at[inside]]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(probe), pa.array(target)], names=["key", "slice", "ends", "at", "to_slice"]
            )

    probes = (
        runs.select("key", "slice", "ends").distinct()
        .mapInArrow(aim, "key string, slice int, ends bigint, at bigint, to_slice int")
        .where("to_slice >= 0")
        .withColumn("to_ends", F.lit(None).cast("bigint"))
    )
    entries = runs.select(
        "key", F.lit(None).cast("int").alias("slice"), F.lit(None).cast("bigint").alias("ends"),
        F.col("t").alias("at"), F.col("slice").alias("to_slice"), F.col("ends").alias("to_ends"),
    )
    # From late to early, entries before probes of the same time: the newest seen is the next one.
    downward = (
        Window.partitionBy("key", "to_slice").orderBy(F.desc("at"), F.desc_nulls_last("to_ends"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        probes.unionByName(entries)
        .withColumn("to_ends", F.last_value("to_ends", True).over(downward))
        .where("slice is not null")
        .select("key", "slice", "ends", "to_slice", "to_ends")
    )
