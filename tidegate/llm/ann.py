"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample, and every row is filed into a leaf.  A query takes nodes
from a priority queue by the cosine with their centres; inner nodes are replaced by their
children, leaves are visited.  How many leaves is found by widening the visits until the true
neighbours of calibration queries, found by brute force among all rows, are reached.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.common import deal, grouped, stored
from tidegate.llm.vectors import cosine, matrix, norms, usable

# Bounds of what reaches the driver: rows that the tree is fitted on, and calibration queries.
FIT_ROWS = 16_384
CALIBRATION_ROWS = 400
LEAF_ROWS = 1_024
BRANCHES = 8
# Share of the calibration queries' true neighbours that the visits must reach.
RECALL = 0.97
UNIT_ROWS = 8_192


@dataclass(frozen=True)
class Tree:
    """Unit centres by node, and the nodes' children; node 0 is the root, leaves have none."""

    centres: np.ndarray
    children: tuple[tuple[int, ...], ...]

    def leaves(self) -> int:
        return sum(not c for c in self.children)

    def file(self, unit: np.ndarray) -> np.ndarray:
        """The leaf of each row, by the nearest centre on each level."""
        node = np.zeros(len(unit), np.int64)
        open_ = [0]
        while open_:
            at = open_.pop()
            if self.children[at]:
                rows = np.flatnonzero(node == at)
                if len(rows):
                    ways = np.array(self.children[at])
                    node[rows] = ways[np.argmax(unit[rows] @ self.centres[ways].T, axis=1)]
                    open_.extend(self.children[at])
        return node

    def visits(self, query: np.ndarray, most: int, rows: dict[int, int] | None = None, need: int = 0) -> list[int]:
        """The first ``most`` leaves of a best-bin-first search, and further ones until they hold
        ``need`` rows; ``rows`` has the number in each leaf."""
        queue, out, held = [(-2.0, 0)], [], 0
        while queue and (len(out) < most or held < need):
            _, node = heapq.heappop(queue)
            if self.children[node]:
                ways = self.children[node]
                for score, way in zip((self.centres[list(ways)] @ query).tolist(), ways):
                    heapq.heappush(queue, (-score, way))
            else:
                out.append(node)
                held += rows.get(node, 0) if rows else 0
        return out


def _split(unit: np.ndarray, rng: np.random.Generator, branches: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Centres and memberships of spherical k-means."""
    centres = unit[rng.choice(len(unit), branches, replace=False)]
    for _ in range(rounds):
        member = np.argmax(unit @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, member, unit)
        length = norms(sums)
        centres = np.where(length[:, None] > 1e-9, sums / np.maximum(length, 1e-9)[:, None], centres)
    return centres, np.argmax(unit @ centres.T, axis=1)


def grow(unit: np.ndarray, leaf_rows: int, branches: int = BRANCHES, seed: int = 11) -> Tree:
    """A tree whose leaves hold at most ``leaf_rows`` of the sample, except where rows are too much
    alike to be split."""
    rng = np.random.default_rng(seed)
    centres, children = [np.zeros(unit.shape[1])], [()]
    todo = [(0, np.arange(len(unit)))]
    while todo:
        node, rows = todo.pop()
        if len(rows) <= max(leaf_rows, branches):
            continue
        found, member = _split(unit[rows], rng, branches)
        parts = [(c, rows[member == i]) for i, c in enumerate(found) if (member == i).any()]
        if len(parts) < 2:
            continue
        children[node] = tuple(range(len(centres), len(centres) + len(parts)))
        for centre, part in parts:
            todo.append((len(centres), part))
            centres.append(centre)
            children.append(())
    return Tree(np.array(centres), tuple(children))


def _best(queries: np.ndarray, q_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int,
          tile: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query's place, row's place, score) of each query's ``k`` best rows, its own excepted.

    Matrix products only preselect; scores, and with them ties, come from each pair alone.
    """
    q_norm, r_norm = norms(queries), norms(rows)
    unit_q, unit_r = queries / q_norm[:, None], rows / r_norm[:, None]
    for at in range(0, len(queries), max(1, tile // max(len(rows), 1))):
        part = slice(at, at + max(1, tile // max(len(rows), 1)))
        near = unit_q[part] @ unit_r.T
        near[q_ids[part][:, None] == ids[None, :]] = -np.inf
        if near.shape[1] > k:
            bar = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
        else:
            bar = np.full(len(near), -2.0)
        # Rows that only rounding could tell from the k-th stay in.
        i, j = np.nonzero((near >= bar[:, None] - 1e-9) & (near > -np.inf))
        score = np.empty(len(i))
        for s in range(0, len(i), 1 << 15):
            p, q = i[s: s + (1 << 15)] + at, j[s: s + (1 << 15)]
            score[s: s + (1 << 15)] = cosine(queries[p], rows[q], q_norm[p], r_norm[q])
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        yield i[rank < k] + at, j[rank < k], score[rank < k]


def _top(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each query with their ranks; combined before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


_FOUND = "query_id long, vec_id long, score double, leaf int"


def _records(q_ids, ids, scores, leaves) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(q_ids), pa.array(ids), pa.array(scores), pa.array(np.asarray(leaves, np.int32))],
        ["query_id", "vec_id", "score", "leaf"])


def calibrate(filed: DataFrame, tree: Tree, k: int, recall: float, rows: int) -> int:
    """Leaves to visit.  The queries are the ``rows`` rows with the smallest hash of their id."""
    sample = filed.select("vec_id", "vec").orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(rows).collect()
    if not sample:
        return 1
    q_ids = np.array([r.vec_id for r in sample])
    queries = np.array([r.vec for r in sample], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, leaf = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for i, j, score in _best(queries, q_ids, matrix(batch.column(1)), ids, k):
                yield _records(q_ids[i], ids[j], score, leaf[j])

    true = _top(filed.select("vec_id", "vec", "leaf").mapInArrow(run, _FOUND), k).select("query_id", "leaf").collect()
    unit = queries / norms(queries)[:, None]
    order = {q: {leaf: at + 1 for at, leaf in enumerate(tree.visits(unit[i], tree.leaves()))}
             for i, q in enumerate(q_ids.tolist())}
    needed = sorted(order[r.query_id][r.leaf] for r in true)
    return needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)] if needed else 1


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, recall: float = RECALL, fit_rows: int = FIT_ROWS,
           leaf_rows: int = LEAF_ROWS, calibration_rows: int = CALIBRATION_ROWS, unit_rows: int = UNIT_ROWS,
           id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` (cosine in double precision) of the ``k`` nearest
    rows found for each row of ``queries``, best first, ties to the smaller id.

    Both tables have an id and a vector; a row with the query's own id is no candidate of it.
    Vectors that are null, empty or zero or hold a null or non-finite component take no part, nor
    do rows without an id.  Vectors of different lengths have no cosine: each length has a tree of
    its own, and a query's candidates are those of its length.  Repeated rows are candidates of
    their own and may take several ranks.  Empty tables give no rows.

    A tree is fitted on the ``fit_rows`` rows with the smallest hash of their id.  Every row is
    filed.  A query visits leaves until the calibrated number and ``k`` candidates are reached.  A
    leaf's rows and the queries that visit it are compared in units of bounded size.
    """
    def prepared(table: DataFrame) -> DataFrame:
        rows = table.select(F.col(id_col).cast("long").alias("vec_id"),
                            F.col(vector_col).cast("array<float>").alias("vec"))
        return rows.where(usable(F.col("vec")) & F.col("vec_id").isNotNull())

    rows, asked = prepared(vectors), prepared(queries)
    dim = F.size("vec")
    lengths = sorted(r.dim for r in asked.select(dim.alias("dim")).distinct().collect())
    found = [_search(rows.where(dim == n), asked.where(dim == n), n, k, recall, fit_rows, leaf_rows, calibration_rows,
                     unit_rows) for n in lengths]
    if not found:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionAll, found)


def _search(rows: DataFrame, asked: DataFrame, dim: int, k: int, recall: float, fit_rows: int, leaf_rows: int,
            calibration_rows: int, unit_rows: int) -> DataFrame:
    """``search`` among vectors of one length."""
    total = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows).collect()
    unit = np.array([r.vec for r in sample], np.float64).reshape(len(sample), dim)
    unit = unit / norms(unit)[:, None]
    tree = grow(unit, max(1, leaf_rows * len(sample) // max(total, 1)))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            leaf = tree.file(x / norms(x)[:, None]) if len(x) else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.asarray(leaf, np.int32))], ["vec_id", "vec", "leaf"])

    schema = "vec_id long, vec array<float>, leaf int"
    filed = stored(rows.mapInArrow(file, schema), "ann-leaves")
    most = calibrate(filed, tree, k, recall, calibration_rows)
    held = {r.leaf: r.n for r in filed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, own = matrix(batch.column(1)), batch.column(2).to_numpy()
            for s in range(0, len(x), 64):
                part = x[s: s + 64] / norms(x[s: s + 64])[:, None]
                ways = [tree.visits(q, most, held, k + n) for q, n in zip(part, own[s: s + 64].tolist())]
                at = np.repeat(np.arange(s, s + len(part)), [len(w) for w in ways])
                yield pa.RecordBatch.from_arrays(
                    [*batch.select([0, 1]).take(pa.array(at)).columns, pa.array(np.concatenate(ways).astype(np.int32))],
                    ["vec_id", "vec", "leaf"])

    # Rows with a query's own id are no candidates of it.
    own = filed.join(asked.select("vec_id"), "vec_id", "left_semi").groupBy("vec_id").agg(F.count("*").alias("own"))
    asked = asked.join(own, "vec_id", "left").select("vec_id", "vec", F.coalesce("own", F.lit(0)).alias("own")) \
        .mapInArrow(route, schema)
    both = filed.withColumn("candidate", F.lit(True)).unionAll(asked.withColumn("candidate", F.lit(False)))
    dealt = deal(stored(both, "ann-visits"), ["leaf"], F.col("candidate"), F.col("vec_id"), unit_rows, within=False)
    keys = ["leaf", "unit_i", "unit_j"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in grouped(batches, keys):
            bounds = np.concatenate([np.flatnonzero(np.diff(group, prepend=group[0] - 1)), [len(group)]])
            for s, e in zip(bounds[:-1], bounds[1:]):
                part = table.slice(s, e - s)
                side, ids, x = part["side"].to_numpy(), part["vec_id"].to_numpy(), matrix(part["vec"])
                own, asks = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                if len(own) and len(asks):
                    for i, j, score in _best(x[asks], ids[asks], x[own], ids[own], k):
                        yield _records(ids[asks][i], ids[own][j], score, np.full(len(i), part["leaf"][0].as_py()))

    found = dealt.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "side", "vec_id", "vec").mapInArrow(
        compare, _FOUND)
    return _top(found, k).select("query_id", "rank", "vec_id", "score")
