"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with a cosine of at least c are at a squared distance of at most 2 (1 - c).  After a
rotation the coordinates are cut into blocks; a block's budget is its share of that distance, by
its dimensions.  A pair within the distance is within budget in some block, so each block is
range-joined for itself: rows fall into cells of the block's leading coordinates and visit the
cells that a ball of the budget's radius touches.  Pairs within the budget are checked exactly
on the original vectors.  A pair counts in the first block that finds it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import components, deal, forest, grouped, stored
from tidegate.llm.vectors import cosine, matrix, norms, usable

BLOCK_DIMS = 16
# Different vectors in a cell, about, and rows of either kind that one task compares at a time.
CELL_ROWS = 8_192
UNIT_ROWS = 8_192
# Rounding in the coordinates of unit vectors stays far below.
SLACK = 1e-7
_TILE = 1 << 21
_PAIRS = 1 << 15


def rotate(unit: np.ndarray, seed: int = 7) -> np.ndarray:
    """Random signs and a Walsh-Hadamard transform: an orthogonal map that spreads each vector
    over all coordinates.  Sums are formed row by row in a fixed order, so that a vector has
    the same coordinates in every task."""
    n, dim = unit.shape
    width = 1 << max(dim - 1, 0).bit_length()
    signs = np.random.default_rng(seed).integers(0, 2, dim) * 2.0 - 1
    x = np.zeros((n, width))
    x[:, :dim] = unit * signs
    half = 1
    while half < width:
        y = x.reshape(n, -1, 2, half)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        half *= 2
    return x / math.sqrt(width)


def blocks(dim: int, block_dims: int) -> list[slice]:
    width = 1 << max(dim - 1, 0).bit_length()
    return [slice(at, min(at + block_dims, width)) for at in range(0, width, block_dims)]


def cell_bits(rows: int, cell_rows: int = CELL_ROWS) -> int:
    return max(0, math.ceil(math.log2(max(rows, 1) / cell_rows)))


def cells(coords: np.ndarray, bits: int, radius2: float, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, cell, own cell) for every cell that a ball around a row touches.

    ``bits`` bits are dealt over the coordinates in turn; a coordinate with b bits has 2^b
    intervals that a rotated unit vector falls into equally often.
    """
    n, dims = coords.shape
    row = np.arange(n)
    cell, own, gap2 = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    for d in range(min(dims, bits)):
        count = 1 << (bits // dims + (d < bits % dims))
        cuts = np.array([NormalDist().inv_cdf(i / count) for i in range(1, count)]) / math.sqrt(width)
        low, high = np.concatenate([[-np.inf], cuts]), np.concatenate([cuts, [np.inf]])
        x = coords[row, d]
        home = np.searchsorted(cuts, x, side="right")
        parts = []
        for i in range(count):
            gap = np.maximum(np.maximum(low[i] - x, x - high[i]), 0)
            total = gap2 + gap * gap
            near = total <= radius2
            parts.append((row[near], cell[near] * count + i, (own * count + home)[near], total[near]))
        row, cell, own, gap2 = (np.concatenate(p) for p in zip(*parts))
    yield row, cell, own


def _visits(threshold: float, block_dims: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy()
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                part = batch.take(pa.array(rows))
                x = matrix(part.column(1))
                turned = rotate(x / norms(x)[:, None])
                width = turned.shape[1]
                for b, span in enumerate(blocks(dim, block_dims)):
                    share = (span.stop - span.start) / width
                    budget = 2 * (1 - threshold) * share + SLACK
                    for row, cell, own in cells(turned[:, span], bits, budget, width):
                        keep = cell <= own  # of two cells the lower one is where a pair meets
                        row, cell, own = row[keep], cell[keep], own[keep]
                        for at in range(0, len(row), 8_192):
                            r, c, o = row[at: at + 8_192], cell[at: at + 8_192], own[at: at + 8_192]
                            taken = part.take(pa.array(r))
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(r), dim, np.int32)), pa.array(np.full(len(r), b, np.int32)),
                                 pa.array(c), pa.array(c == o), *taken.columns],
                                ["dim", "block", "cell", "home", "id", "vec", "n"])

    return run


def _unit(x: np.ndarray, ids: np.ndarray, n: np.ndarray, side: np.ndarray, inner: bool, block: int,
          threshold: float, block_dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links counted by row, and spanning links, of one unit."""
    length = norms(x)
    unit = x / length[:, None]
    turned = rotate(unit)
    spans = blocks(x.shape[1], block_dims)
    budgets = [2 * (1 - threshold) * (s.stop - s.start) / turned.shape[1] + SLACK for s in spans]
    left = np.flatnonzero(side == 0)
    right = np.concatenate([left, np.flatnonzero(side == 1)]) if inner else np.flatnonzero(side == 1)
    own = turned[:, spans[block]].astype(np.float32)
    square = (own * own).sum(axis=1)
    links = np.zeros(len(x), np.int64)
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    step = max(1, _TILE // max(len(right), 1))
    for at in range(0, len(left), step):
        tile = left[at: at + step]
        others = right[at:] if inner else right
        apart = square[tile][:, None] + square[others][None, :] - 2 * (own[tile] @ own[others].T)
        i, j = np.nonzero(apart <= budgets[block] + 1e-5)
        if inner:
            later = (j > i) | (j >= len(left) - at)
            i, j = i[later], j[later]
        found = []
        for s in range(0, len(i), _PAIRS):
            p, q = tile[i[s: s + _PAIRS]], others[j[s: s + _PAIRS]]
            # Not what an earlier block finds, and within this block's budget.
            for k in range(block + 1):
                gap = turned[p, spans[k]] - turned[q, spans[k]]
                near = (gap * gap).sum(axis=1) <= budgets[k]
                p, q = (p[near], q[near]) if k == block else (p[~near], q[~near])
            near = cosine(x[p], x[q], length[p], length[q]) >= threshold
            found.append((p[near], q[near]))
        if found:
            p, q = (np.concatenate(v) for v in zip(*found))
            links += np.bincount(p, weights=n[q], minlength=len(x)).astype(np.int64)
            links += np.bincount(q, weights=n[p], minlength=len(x)).astype(np.int64)
            a, b = forest(np.concatenate([a, ids[p]]), np.concatenate([b, ids[q]]))
    return links, a, b


def _compare(threshold: float, block_dims: int):
    keys = ["dim", "block", "cell", "unit_i", "unit_j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in grouped(batches, keys):
            bounds = np.concatenate([np.flatnonzero(np.diff(group, prepend=group[0] - 1)), [len(group)]])
            for s, e in zip(bounds[:-1], bounds[1:]):
                part = table.slice(s, e - s)
                side = part["side"].to_numpy()
                ids, n = part["id"].to_numpy(), part["n"].to_numpy()
                inner = bool(part["inner"].to_numpy(zero_copy_only=False)[side == 0].any())
                links, a, b = _unit(matrix(part["vec"]), ids, n, side, inner, part["block"][0].as_py(),
                                    threshold, block_dims)
                has = links > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([ids[has], a])),
                     pa.array(np.concatenate([links[has], np.zeros(len(a), np.int64)])),
                     pa.concat_arrays([pa.nulls(int(has.sum()), pa.int64()), pa.array(b)])], ["a", "links", "b"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, block_dims: int = BLOCK_DIMS,
                    cell_rows: int = CELL_ROWS, unit_rows: int = UNIT_ROWS, id_col: str = "vec_id",
                    vector_col: str = "embedding") -> DataFrame:
    """``vec_id``, ``n_links`` (other rows with a cosine of at least ``threshold``) and ``component_id``
    (smallest id reachable over links, the own included) of every row.

    Equal vectors are linked and meet as one before anything is paired.  Vectors that are null,
    empty or zero or hold a null or non-finite component are returned without links; vectors of
    different lengths are never linked.  Repeated ids are rows of their own.  Null ids are
    returned and counted, but are never a smallest id.  Other columns are not read.

    A group of near copies is compared in units of bounded size over many tasks; only counts and
    spanning links leave a task, never its pairs.  The exact number of links of each row costs
    as many checks as there are links between different vectors.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<float>").alias("vec"))
    good = rows.where(usable(F.col("vec")))
    classes = stored(
        good.groupBy("vec").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"))
        .select(F.monotonically_increasing_id().alias("id"), "vec", "first_id", "n"), "vector-classes")
    bits = cell_bits(classes.count(), cell_rows)
    visits = classes.select("id", "vec", "n").mapInArrow(
        _visits(threshold, block_dims, bits),
        "dim int, block int, cell long, home boolean, id long, vec array<float>, n long")
    cell = ["dim", "block", "cell"]
    dealt = deal(stored(visits, "vector-cells"), cell, F.col("home"), F.col("id"), unit_rows)
    keys = [*cell, "unit_i", "unit_j"]
    found = stored(
        dealt.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "side", "inner", "id", "vec", "n")
        .mapInArrow(_compare(threshold, block_dims), "a long, links long, b long"), "vector-links")
    counts = found.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    reach = components(found.where("b IS NOT NULL").select("a", "b"), "vector-components")
    labelled = (
        classes.drop("vec").join(counts, "id", "left").join(reach, F.col("id") == F.col("node"), "left")
        .select("id", "first_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                F.coalesce("component", "id").alias("component"))
    )
    smallest = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = labelled.join(smallest, "component").select("id", "n_links", "component_id").join(
        classes.select("id", "vec"), "id").drop("id")
    joined = good.join(named, "vec").select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable(F.col("vec"))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionAll(alone)
