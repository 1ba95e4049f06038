"""SimHash near-duplicates by the generalised pigeonhole principle.

The bits of the fingerprints are dealt into partitions, correlated bits together.  If two
fingerprints differ in at most k bits and the partitions' thresholds t_i add up to
k - m + 1 (t_i = -1: not probed), then in some partition they differ in at most t_i bits.  The
thresholds are chosen by dynamic programming over the expected number of candidate pairs and
of probes, both from counts over all fingerprints.  Each partition is probed, candidates are
checked on all bits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import components, deal, forest, grouped, packed, portions, stored

BITS = 64
SEED = 42
# What a probe (a row in a shuffle) costs, in candidate checks.
PROBE_COST = 60
# The same where rows go through a Python task and their pairs are compared there: measured, some 3 us
# for a row and 8 ns for a pair.
ROW_COST = 400
# Rows of either side that one task compares at a time.
UNIT_ROWS = 16_384
# Bytes of sketches or sets that one task checks pairs of at a time.
UNIT_BYTES = 16 << 20
# Groups up to this size are compared together, by shifted copies of the batch.
SMALL_GROUP = 96
_TILE = 1 << 20
# Buckets of a sketch of a set of shingles.
SKETCH = 128
# Shingles of a text that are hashed at a time.
_SHINGLES = 1 << 16
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def _digests(text: bytes | None, words: int) -> Iterator[bytes]:
    """Hashes of the word shingles of a whole text, A-Z in lower case, repeats included."""
    tokens = text.lower().split() if text else []
    if not tokens:
        return
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(len(tokens) - words + 1, 1)
    digest, seed = xxhash.xxh64_digest, SEED
    ends = ends[min(words, len(tokens)) - 1:]
    for at in range(0, n, _SHINGLES):
        yield b"".join([
            digest(joined[s:e], seed)
            for s, e in zip(starts[at: min(at + _SHINGLES, n)].tolist(), ends[at: at + _SHINGLES].tolist())
        ])


def _majority(digests: Iterable[bytes]) -> int:
    n, set_ = 0, np.zeros(BITS, np.int64)
    for hashes in digests:
        columns = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
        n += len(columns)
        if len(columns) < 256:
            set_ += np.unpackbits(columns, axis=1).sum(axis=0, dtype=np.int64)
        else:
            set_ += np.concatenate([np.bincount(columns[:, c], minlength=256) @ _BYTE_BITS for c in range(8)])
    return int.from_bytes(np.packbits(2 * set_ > n).tobytes(), "big")


def fingerprint(text: bytes | None, words: int = 4) -> int:
    """SimHash of the word shingles of a whole text, A-Z in lower case, repeats included."""
    return _majority(_digests(text, words))


def _set_of(digests: Iterable[bytes]) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(digests), np.uint64))


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``key`` (hash of the text, as ``xxhash64`` gives it) and ``fp`` (the 64 bits as a
    signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            keys, found = np.full(batch.num_rows, SEED, np.uint64), np.zeros(batch.num_rows, np.uint64)
            for i, value in enumerate(batch.column(1).cast(pa.large_binary())):
                if (text := value.as_py()) is not None:
                    keys[i], found[i] = xxhash.xxh64_intdigest(text, SEED), fingerprint(text, words)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys.view(np.int64)), pa.array(found.view(np.int64))], ["doc_id", "key", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, key long, fp long")


def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each two bits how many have both set."""
    upper = np.triu_indices(BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for batch in batches:
            bits = np.unpackbits(
                batch.column(0).to_numpy().view(np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1
            ).astype(np.float32)
            total += bits.T @ bits
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(upper[0]))), pa.array(total[upper].astype(np.int64))], ["pos", "n"])

    # A fixed number of counters, combined over the tasks before they reach the driver.
    sums = prints.select("fp").mapInArrow(run, "pos long, n long").groupBy("pos").agg(F.sum("n").alias("n")).collect()
    both = np.zeros((BITS, BITS))
    for pos, n in sums:
        both[upper[0][pos], upper[1][pos]] = both[upper[1][pos], upper[0][pos]] = n
    return prints.count(), both


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of nearly equal width; each takes, one by one, the free bit that is most
    correlated with what it has."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    strength = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    free, groups = set(range(BITS)), []
    for left in range(parts, 0, -1):
        width = math.ceil(len(free) / left)
        group = [max(sorted(free), key=lambda b: strength[b, sorted(free - {b})].sum())]
        free.discard(group[0])
        while len(group) < width:
            best = max(sorted(free), key=lambda b: strength[b, group].sum())
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def allocate(n: int, both: np.ndarray, groups: list[list[int]], k: int, bands: list[int] | None = None) -> tuple[float, list[int]]:
    """Thresholds with the least expected work, and that work.

    Candidates of a partition at threshold t are all pairs times the chance that at most t of
    its bits differ, from the bits' frequencies; probes are the values within t of each one.
    With ``bands``, the numbers of rows by length band, only pairs in one band or in neighbouring
    ones meet, and rows visit the next band too.
    """
    # In an empty table a probe still costs something, else thresholds of any size would do.
    n = max(n, 1)
    pairs, own, visits, cost_of_row = n * (n - 1) / 2, 1.0, 0.5, PROBE_COST
    if bands is not None:
        pairs = sum(x * x / 2 + x * y for x, y in zip(bands, [0, *bands]))
        own, visits, cost_of_row = 2.0, 1.5, ROW_COST
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for group in groups:
        dist = np.zeros(len(group) + 1)
        dist[0] = 1
        for b in group:
            dist[1:] = dist[1:] * (1 - differ[b]) + dist[:-1] * differ[b]
            dist[0] *= 1 - differ[b]
        cost = [0.0] + [
            pairs * dist[: t + 1].sum()
            + cost_of_row * n * (own + sum(math.comb(len(group), x) for x in range(1, t + 1)) * visits)
            for t in range(min(k, len(group)) + 1)
        ]
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (so_far, chosen) in best.items():
            for units, c in enumerate(cost):
                total = min(used + units, k + 1)
                if total not in step or so_far + c < step[total][0]:
                    step[total] = (so_far + c, [*chosen, units - 1])
        best = step
    return best[k + 1]


def plan(n: int, both: np.ndarray, k: int, bands: list[int] | None = None) -> list[tuple[int, int, list[int]]]:
    """(mask, threshold, flips) of the partitions that are probed; the number of partitions is
    the one with the least expected work.  ``bands`` as of ``allocate``."""
    options = []
    for parts in range(1, min(k + 1, BITS) + 1):
        groups = group_bits(n, both, parts)
        if max(map(len, groups)) > 40 and k > 1:
            continue  # too many values within the threshold
        cost, thresholds = allocate(n, both, groups, k, bands)
        options.append((cost, parts, groups, thresholds))
    _, _, groups, thresholds = min(options, key=lambda o: o[:2])
    signed = lambda x: x - (1 << BITS) if x >> (BITS - 1) else x
    probes = []
    for group, t in zip(groups, thresholds):
        bits = [1 << (BITS - 1 - b) for b in group]
        if t >= 0:
            flips = [signed(sum(c)) for x in range(1, t + 1) for c in combinations(bits, x)]
            probes.append((signed(sum(bits)), t, flips))
    return probes


def _near(fp: np.ndarray, other: np.ndarray, k: int) -> np.ndarray:
    return np.bitwise_count(fp ^ other) <= k


def _unit_links(fp: np.ndarray, side: np.ndarray, inner: bool, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of one large unit; rows already known to hang together are not listed again."""
    left = fp[side == 0]
    right = np.concatenate([left, fp[side == 1]]) if inner else fp[side == 1]
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    step = max(1, _TILE // max(len(right), 1))
    for at in range(0, len(left), step):
        tile = left[at: at + step]
        first = at if inner else 0
        x, y = np.nonzero(_near(tile[:, None], right[None, first:], k))
        x, y = tile[x].view(np.int64), right[first + y].view(np.int64)
        distinct = x != y
        a, b = forest(np.concatenate([a, x[distinct]]), np.concatenate([b, y[distinct]]))
    return a, b


def _links(k: int):
    keys = ["part", "cell", "unit_i", "unit_j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in grouped(batches, keys):
            fp = table["fp"].to_numpy().view(np.uint64)
            side, inner = table["side"].to_numpy(), table["inner"].to_numpy()
            sizes = np.bincount(group)
            large = sizes[group] > SMALL_GROUP
            found = []
            s_fp, s_group, s_side = fp[~large], group[~large], side[~large]
            s_inner = inner[~large]
            for d in range(1, int(min(sizes.max(), SMALL_GROUP))):
                # Home rows are compared with one another where the unit says so, and with the others.
                ok = (s_group[d:] == s_group[:-d]) & np.where(
                    s_side[d:] == s_side[:-d], s_inner[d:] & (s_side[d:] == 0), True)
                ok &= _near(s_fp[d:], s_fp[:-d], k)
                at = np.flatnonzero(ok)
                if len(at):
                    found.append((s_fp[at].view(np.int64), s_fp[at + d].view(np.int64)))
            starts = np.searchsorted(group, np.flatnonzero(sizes > SMALL_GROUP))
            for s in starts:
                e = s + sizes[group[s]]
                found.append(_unit_links(fp[s:e], side[s:e], bool(inner[s:e][side[s:e] == 0].any()), k))
            if found:
                a, b = forest(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _units(prints: DataFrame, probes: list[tuple[int, int, list[int]]], cols: list[str], salt: str,
           unit_rows: int, band: Column | None = None) -> DataFrame:
    """Every row in its own cell of each partition and in those it visits, dealt into units.

    With a ``band``, cells are those of a band, its number times 64 in ``part``; a row is at home in
    its own and visits all it may meet in the band below.
    """
    rows = None
    for part, (mask, _, flips) in enumerate(probes):
        own = F.col("fp").bitwiseAND(F.lit(mask))
        if band is not None:
            # Of its own band: its cell, and of those within the threshold the smaller ones.
            values = F.array(F.lit(0).cast("long"), *map(F.lit, flips))
            visits = prints.select(*cols, own.alias("own"), (band * BITS + part).alias("here"), F.explode(values).alias("flip")).withColumn(
                "cell", F.col("own").bitwiseXOR(F.col("flip")))
            to = F.array(*(F.struct(p.alias("part"), h.alias("home"), ok.alias("ok")) for p, h, ok in (
                (F.col("here"), F.col("flip") == 0, F.col("cell") <= F.col("own")),
                (F.col("here") - BITS, F.lit(False), F.lit(True)))))
            cells = visits.select(*cols, "cell", F.explode(F.filter(to, lambda t: t["ok"])).alias("to")).select(
                *cols, "to.part", "cell", "to.home")
            rows = cells if rows is None else rows.unionAll(cells)
            continue
        cells = prints.select(*cols, F.lit(part).alias("part"), own.alias("cell"), F.lit(True).alias("home"))
        if flips:
            # Of two values that differ, the larger visits the smaller.
            other = F.explode(F.array(*map(F.lit, flips)))
            visits = (
                prints.select(*cols, other.alias("flip"), own.alias("own"))
                .withColumn("cell", F.col("own").bitwiseXOR(F.col("flip"))).where("cell < own")
                .select(*cols, F.lit(part).alias("part"), "cell", F.lit(False).alias("home"))
            )
            cells = cells.unionAll(visits)
        rows = cells if rows is None else rows.unionAll(cells)
    dealt = deal(rows, ["part", "cell"], F.col("home"), F.col(salt), unit_rows)
    keys = ["part", "cell", "unit_i", "unit_j"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).select(*cols, *keys, "side", "inner")


def links(prints: DataFrame, k: int = 4, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """Links ``a``-``b`` that connect all fingerprints within ``k`` bits of one another.

    ``prints`` holds different fingerprints in ``fp`` and should be a stored table.  Links that
    add nothing to the components of a unit are left out.
    """
    n, both = bit_counts(prints)
    probes = plan(n, both, k)
    return _units(prints, probes, ["fp"], "fp", unit_rows).mapInArrow(_links(k), "a long, b long")


def sets(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``key``, ``fp`` as ``fingerprints`` gives them, ``node`` (hash of the text's set of
    shingles), ``n`` (their number) and ``sketch`` (``n`` and how many fall into each of 128 buckets,
    at most 255) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            keys, found = np.full(batch.num_rows, SEED, np.uint64), np.zeros(batch.num_rows, np.uint64)
            nodes, n, sketches = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.int64), []
            for i, value in enumerate(batch.column(1).cast(pa.large_binary())):
                if (text := value.as_py()) is not None:
                    keys[i] = xxhash.xxh64_intdigest(text, SEED)
                digests = list(_digests(text, words))
                found[i], own = _majority(digests), _set_of(digests)
                nodes[i], n[i] = xxhash.xxh64_intdigest(own.tobytes(), SEED), len(own)
                buckets = np.bincount((own & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
                sketches.append(n[i].tobytes() + np.minimum(buckets, 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x.view(np.int64)) for x in (keys, found, nodes)), pa.array(n),
                 pa.array(sketches, pa.binary())], ["doc_id", "key", "fp", "node", "n", "sketch"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"doc_id {kind}, key long, fp long, node long, n long, sketch binary")


def _pairs(k: int, probes: list[tuple[int, int, list[int]]], similarity: float, most: int | None):
    """Pairs of different labels within ``k`` bits whose numbers of shingles allow the similarity, each
    from the first partition that finds it; of a row's pairs in a unit the ``most`` nearest, with
    ``more`` where there are others.

    A record holds what one row ``a`` of a ``unit`` is paired with, ``b``; each row of a unit that is in
    a pair has a record, if only an empty one.
    """
    keys = ["part", "cell", "unit_i", "unit_j"]
    masks = [np.uint64(mask % (1 << BITS)) for mask, _, _ in probes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in grouped(batches, keys):
            fp, node, label = (table[c].to_numpy() for c in ("fp", "node", "label"))
            fp, n, part = fp.view(np.uint64), table["n"].to_numpy(), table["part"].to_numpy() % BITS
            side, inner, unit = (table[c].to_numpy() for c in ("side", "inner", "unit"))
            first_of, partner = np.zeros(len(fp), bool), np.zeros(len(fp), bool)

            def records(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
                ok = (label[x] != label[y]) & (
                    np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]) - 1e-9)
                x, y = x[ok], y[ok]
                bits = fp[x] ^ fp[y]
                new = np.ones(len(x), bool)
                for p, (mask, (_, t, _)) in enumerate(zip(masks, probes)):
                    new &= (part[x] <= p) | (np.bitwise_count(bits & mask) > t)
                x, y, far = x[new], y[new], np.bitwise_count(bits[new])
                order = np.lexsort((far, x))
                x, y = x[order], y[order]
                rows, first = np.unique(x, return_index=True)
                counts = np.diff(np.r_[first, len(x)])
                more = np.zeros(len(rows), bool)
                if most is not None:
                    near = np.arange(len(x)) - np.repeat(first, counts) < most
                    more, y, counts = counts > most, y[near], np.minimum(counts, most)
                first_of[rows], partner[y] = True, True
                partners = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(node[y]))
                return pa.RecordBatch.from_arrays(
                    [pa.array(unit[rows]), pa.array(node[rows]), partners, pa.array(more)], ["unit", "a", "b", "more"])

            sizes = np.bincount(group)
            small = np.flatnonzero(sizes[group] <= SMALL_GROUP)
            s_fp, s_group, s_side, s_inner, found = fp[small], group[small], side[small], inner[small], []
            for d in range(1, int(min(sizes.max(), SMALL_GROUP))):
                ok = (s_group[d:] == s_group[:-d]) & np.where(
                    s_side[d:] == s_side[:-d], s_inner[d:] & (s_side[d:] == 0), True)
                at = np.flatnonzero(ok & _near(s_fp[d:], s_fp[:-d], k))
                found.append((small[at], small[at + d]))
            if found:
                yield records(*(np.concatenate(z) for z in zip(*found)))
            for g in np.flatnonzero(sizes > SMALL_GROUP):
                at = np.arange(*np.searchsorted(group, [g, g + 1]))
                left, right = at[side[at] == 0], at[side[at] == 1]
                within = len(left) and inner[left].any()
                right = np.concatenate([left, right]) if within else right
                step = max(1, _TILE // max(len(right), 1))
                for s in range(0, len(left), step):
                    tile, first = left[s: s + step], s if within else 0
                    x, y = np.nonzero(_near(fp[tile][:, None], fp[right[first:]][None, :], k))
                    # Inside a unit each pair once, and no row with itself.
                    ok = (y > x) if within else np.ones(len(x), bool)
                    yield records(tile[x[ok]], right[first + y[ok]])
            only = np.flatnonzero(partner & ~first_of)
            empty = pa.ListArray.from_arrays(pa.array(np.zeros(len(only) + 1), pa.int32()), pa.array([], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(unit[only]), pa.array(node[only]), empty, pa.array(np.zeros(len(only), bool))],
                ["unit", "a", "b", "more"])

    return run


def _bands(similarity: float) -> Column:
    """Number of the length band: sets whose sizes allow the similarity are in one band or in
    neighbouring ones."""
    return F.floor(F.log(F.greatest(F.col("n"), F.lit(1))) / F.lit(-math.log(similarity)) + 1e-9).cast("int")


def _in_units(pairs: DataFrame, payload: DataFrame, test: Callable, label: str) -> DataFrame:
    """The pairs (``unit``, ``a``, a list of ``b``) whose ends' ``payload`` passes ``test``, as ``a``-``b``.

    ``test`` gets a list of payloads and, for every pair, two places in it.  The payload of a node
    goes to each unit that has pairs of it once, not once a pair: every node of a unit's pairs has
    a record of its own, so the lists need not be spread out to learn which nodes there are.
    """
    needed = pairs.select(F.col("unit").alias("to"), F.col("a").alias("node")).distinct().join(
        payload.select("node", "payload"), "node")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        nodes = right["node"].to_numpy()
        order = np.argsort(nodes)
        b = left["b"].combine_chunks()
        ends = np.repeat(left["a"].to_numpy(), b.value_lengths().to_numpy()), b.flatten().to_numpy()
        ok = test([x.as_py() for x in right["payload"]], *(order[np.searchsorted(nodes, x, sorter=order)] for x in ends))
        return pa.table({"a": pa.array(ends[0][ok]), "b": pa.array(ends[1][ok])})

    return stored(pairs.select("unit", "a", "b").groupBy("unit").cogroup(needed.groupBy("to")).applyInArrow(
        run, "a long, b long").distinct(), label)


def _gathered(pairs: DataFrame, payload: DataFrame, size: Column, label: str) -> DataFrame:
    """The pairs ``a``-``b`` in units for ``_in_units`` whose payload is bounded.

    Nodes are put together by their smallest neighbour, so that most pairs of a group stay in its
    unit; a large group is cut into chunks, and its pairs are dealt by pairs of chunks.
    """
    both = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(
        pairs.select(F.col("b").alias("node"), F.col("a").alias("other")))
    near = both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("group"))
    held = stored(near.join(payload.select("node", size.cast("long").alias("size")), "node"), f"{label}-nodes")
    chunks = max(1, -(-(held.agg(F.sum("size")).first()[0] or 0) // UNIT_BYTES))
    parts = held.groupBy("group").agg(F.ceil(F.sum("size") / UNIT_BYTES).alias("parts"))
    placed = held.join(parts, "group").select("node", F.pmod(F.xxhash64(
        "group", F.pmod(F.xxhash64("node"), F.col("parts"))), F.lit(chunks)).alias("chunk"))
    ends = pairs.select("a", "b")
    for end in ("a", "b"):
        ends = ends.join(placed.select(F.col("node").alias(end), F.col("chunk").alias(f"{end}_chunk")), end)
    unit = F.xxhash64(F.least("a_chunk", "b_chunk"), F.greatest("a_chunk", "b_chunk"))
    ends = ends.withColumn("unit", unit)
    # A record for each node of a unit's pairs: nulls are not collected, so it may be empty.
    alone = ends.select("unit", F.col("b").alias("a"), F.lit(None).cast("long").alias("b")).distinct()
    return stored(ends.select("unit", "a", "b").unionAll(alone).groupBy("unit", "a").agg(F.collect_list("b").alias("b")), label)


def _similar(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, similarity: float, id_col: str,
             text_col: str) -> DataFrame:
    """The pairs whose sets of shingles have at least the Jaccard similarity.

    What two sets share is at most what their sketches share; only pairs that this allows are
    checked on their sets.
    """
    def enough(shared, n_a, n_b):
        return shared >= similarity * (n_a + n_b - shared) - 1e-9

    def allowed(sketches: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        # The number of shingles stands before the sketch.
        table = np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, 8 + SKETCH)
        n, table = np.ascontiguousarray(table[:, :8]).view(np.int64).ravel(), table[:, 8:]
        full = (table == 255).any(axis=1)
        ok = np.empty(len(a), bool)
        for at in range(0, len(a), 8_192):
            x, y = a[at: at + 8_192], b[at: at + 8_192]
            shared = np.minimum(table[x], table[y]).sum(axis=1, dtype=np.int64)
            ok[at: at + 8_192] = full[x] | full[y] | enough(shared, n[x], n[y])
        return ok

    def equal(found: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        of = [np.frombuffer(x, np.uint64) for x in found]
        return np.array([enough(len(np.intersect1d(of[x], of[y], assume_unique=True)), len(of[x]), len(of[y]))
                         for x, y in zip(a, b)], bool)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            found = [_set_of(_digests(t.as_py(), words)).tobytes() for t in batch["text"].cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(found, pa.binary())], ["node", "payload"])

    open_ = _in_units(pairs, nodes.withColumnRenamed("sketch", "payload"), allowed, "simhash-open")
    needed = open_.select(F.col("a").alias("node")).unionAll(open_.select("b")).distinct().join(nodes, "node").select(
        "node", "first.doc_id", "first.key")
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    sets_ = stored(
        given.join(needed, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("text_key") == F.col("key")))
        .select("node", "text").dropDuplicates(["node"]).mapInArrow(hashed, "node long, payload binary"), "simhash-needed")
    return _in_units(_gathered(open_, sets_, F.octet_length("payload"), "simhash-gathered"), sets_, equal, "simhash-similar")


def similar_documents(docs: DataFrame, words: int = 5, k: int = 16, similarity: float = 0.8, id_col: str = "doc_id",
                      text_col: str = "text", most: int = 16, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """``doc_id``, ``key``, ``fp`` and ``component_id`` as of ``near_duplicates``, but linked are texts
    whose fingerprints differ in at most ``k`` bits and whose sets of shingles have at least
    the Jaccard ``similarity``, checked exactly.

    Texts with one set of shingles meet as one, also those without words.  Each row is checked
    against the nearest others of its units first.  Where that left any out, all pairs that these
    links have not yet joined are checked in a second pass: a dense group is not paired in full.
    """
    rows = stored(sets(docs, words, id_col, text_col), "simhash-sets")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    nodes = stored(rows.groupBy("node").agg(
        F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), first.alias("first")),
        "simhash-nodes")
    n, both = bit_counts(nodes)
    band = _bands(similarity)
    sizes = dict(nodes.groupBy(band.alias("band")).count().collect())  # some hundred bands at most
    probes = plan(n, both, k, [sizes.get(b, 0) for b in range(max(sizes, default=0) + 1)])

    def paired(labelled: DataFrame, most: int | None) -> DataFrame:
        cols = ["fp", "node", "n", "label"]
        units = _units(labelled.select(*cols), probes, cols, "node", unit_rows, band).withColumn(
            "unit", F.xxhash64("part", "cell", "unit_i", "unit_j"))
        return stored(units.mapInArrow(_pairs(k, probes, similarity, most), "unit long, a long, b array<long>, more boolean"), "simhash-pairs")

    def reached(links: DataFrame) -> DataFrame:
        reach = components(links, "simhash-links").withColumnRenamed("node", "end")
        return nodes.join(reach, nodes.node == F.col("end"), "left").withColumn(
            "label", F.coalesce("component", "node")).drop("end", "component")

    pairs = paired(nodes.withColumn("label", F.col("node")), most)
    found = _similar(pairs, nodes, docs, words, similarity, id_col, text_col)
    if not pairs.where("more").isEmpty():
        rest = paired(stored(reached(found), "simhash-labels"), None)
        found = found.unionAll(_similar(rest, nodes, docs, words, similarity, id_col, text_col))
    named = stored(reached(found).select("node", "label", F.col("first.doc_id").alias("first_id")), "simhash-classes")
    smallest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    return rows.join(named.join(smallest, "label").select("node", "component_id"), "node").select(
        "doc_id", "key", "fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = 4, k: int = 4, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``doc_id``, ``key``, ``fp`` and ``component_id`` (smallest id reachable over links of at most
    ``k`` differing bits) of every row; ``key`` is the hash of its text.

    Copies meet as one fingerprint before anything is paired.  A text without words, empty or
    null, has fingerprint zero and is linked like any other.  Repeated rows are returned as
    often as they occur; null ids are returned too but are never a group's smallest id, which
    is null only where a whole group has none.  Further columns of ``docs`` are not read.
    """
    rows = stored(fingerprints(docs, words, id_col, text_col), "simhash-prints")
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    reach = components(links(prints, k), "simhash-links")
    classes = prints.join(reach, prints.fp == reach.node, "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("component"))
    smallest = classes.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = classes.join(smallest, "component").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "key", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = 4, k: int = 4, id_col: str = "doc_id",
             text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """The rows of ``docs`` that are their group's first: one document of each group.

    With a ``similarity`` the groups are those of ``similar_documents``.

    Rows that share id and text are one document.  Where a group's smallest id occurs with several
    texts, or no row of it has an id, one row of each such text stays.
    """
    if similarity is None:
        marked = near_duplicates(docs, words, k, id_col, text_col)
    else:
        marked = similar_documents(docs, words, k, similarity, id_col, text_col)
    firsts = stored(
        marked.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("doc_id", "key").agg(F.count("*").alias("n_rows")), "simhash-firsts")
    kept = packed(docs).withColumn("text_key", F.xxhash64(f"row.{text_col}")).join(
        firsts, F.col(f"row.{id_col}").eqNullSafe(F.col("doc_id")) & (F.col("text_key") == F.col("key")))
    if firsts.where("n_rows > 1").isEmpty():
        return kept.select("row.*")
    once = kept.where("n_rows = 1").select("row.*")
    return once.unionAll(kept.where("n_rows > 1").select("row.*").dropDuplicates([id_col, text_col]))
