"""Tables in the shared folder, units of bounded size for pair work, connected components."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.session import new_run_dir

# Large cells up to this number are sent to all tasks.
BROADCAST_CELLS = 100_000

# A run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written below ``spark.checkpoint.dir`` and read again: computed once, and
    still there when executors are lost."""
    path = new_run_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, name: str = "row") -> DataFrame:
    """All columns of ``df`` as one, so that no name can clash with those added to it; ``name.*``
    gives them back."""
    return df.select(F.struct(*(df[f"`{c}`"] for c in df.columns)).alias(name))


def deal(rows: DataFrame, cell: list[str], home: Column, salt: Column, limit: int,
         within: bool = True) -> DataFrame:
    """Units of bounded size that together hold every pair of home and other rows of a cell.

    A cell with at most ``limit`` rows of either kind is one unit.  A larger one is cut into
    chunks by ``salt``, and each pair of chunks is a unit, so no task ever gets the whole
    cell.  Adds ``unit_i`` and ``unit_j`` (with ``cell`` the unit), ``side`` (0: left, 1:
    right) and ``inner`` (the left rows of this unit are also compared with one another).
    ``within`` false leaves out the pairs of two home rows.
    """
    rows = rows.withColumn("_home", home)
    big = stored(
        rows.groupBy(*cell)
        .agg(F.count_if("_home").alias("_h"), F.count_if(~F.col("_home")).alias("_g"))
        .where((F.col("_h") > limit) | (F.col("_g") > limit))
        .select(*cell, F.greatest(F.ceil(F.col("_h") / limit), F.lit(1)).cast("int").alias("_k"),
                F.ceil(F.col("_g") / limit).cast("int").alias("_f")), "large-cells")
    # Counted: where few cells are large the rows need not be shuffled to learn of it.
    big = F.broadcast(big) if big.count() <= BROADCAST_CELLS else big
    k, f, i = F.col("_k"), F.col("_f"), F.col("_i")

    def unit(a, b, side: int, inner) -> Column:
        return F.struct(F.lit(a).cast("int").alias("unit_i") if isinstance(a, int) else a.cast("int").alias("unit_i"),
                        b.cast("int").alias("unit_j"), F.lit(side).alias("side"), inner.alias("inner"))

    def upto(start: Column, end: Column, make) -> Column:
        """``make`` of start, ..., end - 1."""
        return F.when(end > start, F.transform(F.sequence(start, end - 1), make))

    none = F.array().cast("array<struct<unit_i:int,unit_j:int,side:int,inner:boolean>>")
    pairs = [upto(k, k + f, lambda j: unit(i, j, 0, F.lit(False)))]
    if within:
        pairs += [upto(i, k, lambda j: unit(i, j, 0, i == j)),
                  upto(F.lit(0), i, lambda j: unit(j, i, 1, F.lit(False)))]
    own = F.concat(*(F.coalesce(p, none) for p in pairs))
    guest = F.coalesce(upto(F.lit(0), k, lambda a: unit(a, k + i, 1, F.lit(False))), none)
    whole = F.array(F.struct(F.lit(0).alias("unit_i"), F.lit(0).alias("unit_j"),
                             F.when(F.col("_home"), 0).otherwise(1).alias("side"),
                             F.lit(within).alias("inner")))
    chunks = F.when(F.col("_home"), k).otherwise(F.greatest(f, F.lit(1)))
    return (
        rows.join(big, cell, "left")
        .withColumn("_i", F.pmod(F.xxhash64(salt, F.lit(1)), chunks).cast("int"))
        .withColumn("_u", F.explode(F.when(k.isNull(), whole).when(F.col("_home"), own).otherwise(guest)))
        .select("*", "_u.*").drop("_home", "_k", "_f", "_i", "_u")
    )


_resident: list = [None, None]


def resident(build: Callable, *args):
    """``build(*args)``, made once in a Python worker and kept until another is asked for: workers
    serve one query after the other, and should hold the tables of one operator at a time."""
    key = (build, args)
    if _resident[0] != key:
        _resident[:] = None, None
        _resident[:] = key, build(*args)
        # The tables stay as they are: the garbage collector need not look through them again.
        gc.collect()
        gc.freeze()
    return _resident[1]


def portions(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that what is made of a text need not be held for many."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the nodes of the links a-b that are not
    that smallest node themselves."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a):]
    root = np.arange(len(ids))
    while True:
        rx, ry = root[x], root[y]
        open_ = rx != ry
        if not open_.any():
            break
        x, y, rx, ry = x[open_], y[open_], rx[open_], ry[open_]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while (root[root] != root).any():
            root = root[root]
    moved = root != np.arange(len(ids))
    return ids[moved], ids[root[moved]]


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from batches sorted by ``keys``, with the rows' group numbers.
    Only the last, still open group is held back, so memory follows a batch and a group."""
    held: list[pa.RecordBatch] = []

    def numbers(table: pa.Table) -> np.ndarray:
        new = np.zeros(len(table), dtype=bool)
        for key in keys:
            v = table[key].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.cumsum(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if all(batch[k][0] == batch[k][-1] == held[0][k][-1] for k in keys):
            continue  # still the one open group
        table = pa.Table.from_batches(held).combine_chunks()
        number = numbers(table)
        end = int(np.searchsorted(number, number[-1]))
        if end:
            yield table.slice(0, end), number[:end]
        held = table.slice(end).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, numbers(table)


def components(edges: DataFrame, label: str) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) of every node of the links
    ``a``-``b``.

    Alternating large and small stars: each round is a few shuffles on nodes, the number of
    rounds grows with the logarithm of the longest path, and nothing is collected.  A node
    with many links is split by the adaptive skew join.  Links with a null end or from a node
    to itself are ignored; repeated links count once.
    """
    lo, hi, u, v, m = (F.col(c) for c in ("lo", "hi", "u", "v", "m"))
    e = (
        edges.where(F.col("a") != F.col("b"))
        .select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    )
    while True:
        e = stored(e, label)
        ends = e.select(hi.alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
            e.select(lo.alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        chains = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if chains.where("up > 1 OR up = 1 AND down = 1").isEmpty():
            break
        both = e.select(hi.alias("u"), lo.alias("v")).unionAll(e.select(lo.alias("u"), hi.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(v > u).join(least, "u").select(v.alias("hi"), m.alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        e = (
            large.join(least, "hi").where(lo != m).select(m.alias("lo"), lo.alias("hi"))
            .unionAll(least.select(m.alias("lo"), hi)).distinct()
        )
    return e.select(hi.alias("node"), lo.alias("component")).unionAll(
        e.select(lo.alias("node"), lo.alias("component")).distinct())
