"""A Merkle manifest of a data set: digests of rows, their trees, and proofs read from them.

The leaves of each source, in the order of their ids, are the bottom of a tree in which three
neighbours make a parent; the roots of the sources are the leaves of a last tree.  Trees are kept
as content-addressed records, digest to children.  One record of a segment holds six levels
below its digest.  Requests for leaves start at the root.  At each node the next digit of the
leaf's rank selects a child, and the other children are collected.  Requests for leaves of one
segment go together as one until they enter it, so no node is visited by every leaf's request.
What was collected, reversed, is the leaf's proof.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StringType, StructType

from tidegate.llm.common import stored

# Neighbours that make a parent.
FAN_OUT = 3
# Levels of a segment: the subtree that one record holds.
HEIGHT = 6

_PATH = "array<struct<left:string,right:string>>"
_PATH_TYPE = ArrayType(StructType().add("left", StringType()).add("right", StringType()))


def framed(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Digest of the framed values, as lowercase hex text."""
    return F.sha2(F.concat(*map(framed, values)), 256)


def _hash(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(size: int) -> int:
    """Levels above ``size`` nodes up to the one root."""
    n = 0
    while size > 1:
        size, n = -(-size // FAN_OUT), n + 1
    return n


def _grow(digests: list[str], height: int) -> tuple[str, dict[bytes, bytes]]:
    """The digest ``height`` levels above the nodes, and the children of all nodes between."""
    below: dict[bytes, bytes] = {}
    for _ in range(height):
        parents = []
        for at in range(0, len(digests), FAN_OUT):
            family = digests[at: at + FAN_OUT]
            parents.append(_hash(family))
            below[bytes.fromhex(parents[-1])] = bytes.fromhex("".join(family))
        digests = parents
    return digests[0], below


def _descend(below: dict[bytes, bytes], root: str, rank: int, height: int) -> tuple[str, list[dict]]:
    """From ``root`` by the digits of ``rank``, the first of them first: the node reached, and the
    children not selected, left and right of each selected one."""
    node, path = bytes.fromhex(root), []
    for level in range(height - 1, -1, -1):
        digit, family = rank // FAN_OUT ** level % FAN_OUT, below[node]
        node = family[32 * digit: 32 * digit + 32]
        path.append({"left": family[: 32 * digit].hex(), "right": family[32 * digit + 32:].hex()})
    return node.hex(), path


def fold(leaf_digest: str, path: list[dict]) -> str:
    """The root that a leaf and its proof, from the leaf up, lead to."""
    for step in path:
        leaf_digest = _hash([step["left"], leaf_digest, step["right"]])
    return leaf_digest


def numbered(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """Stored rows with their ``rank`` in ``tree`` from 0, and the tree's ``size``.

    Rows are sorted by range over the partitions, so that a tree with most rows is spread; only
    counts of (tree, partition) go through a window.
    """
    keys = [F.col(c).asc_nulls_first() for c in ["tree", *order]]
    placed = stored(
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), label)
    # The upper bits are the partition, the lower ones the row in it.
    part = F.shiftright("at", 33)
    runs = placed.groupBy("tree", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy("tree")
    starts = runs.select(
        F.col("tree").alias("_tree"), F.col("part").alias("_part"),
        (F.sum("n").over(whole.orderBy("part")) - F.col("n") - F.col("first")).alias("_shift"),
        F.sum("n").over(whole).alias("size"))
    return placed.join(starts, F.col("tree").eqNullSafe(F.col("_tree")) & (part == F.col("_part"))).select(
        *rows.columns, (F.col("at") + F.col("_shift")).alias("rank"), "size")


def _segments(nodes: DataFrame, most: int) -> DataFrame:
    """A record for each 3^``most`` neighbours of a tree (``tree``, ``rank``, ``size``, the nodes beside one
    another, ``leaves`` of the whole tree, ``digest``): ``rank`` and ``size`` in segments, the digest
    above them and the digest-to-children pairs of all nodes between."""
    span = FAN_OUT ** most
    kind = nodes.schema["tree"].dataType.simpleString()
    pairs = pa.list_(pa.struct([("digest", pa.binary()), ("below", pa.binary())]))

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        size = table["size"][0].as_py()
        digest, below = _grow(table["digest"].to_pylist(), min(most, levels_of(size)))
        return pa.table({
            "tree": table["tree"].slice(0, 1), "rank": pa.array([table["rank"][0].as_py() // span]),
            "size": pa.array([-(-size // span)]), "leaves": table["leaves"].slice(0, 1), "digest": [digest],
            "children": pa.array([[{"digest": d, "below": b} for d, b in below.items()]], pairs)})

    block = F.floor(F.col("rank") / span).alias("block")
    return stored(
        nodes.select("tree", "rank", "size", "leaves", "digest", block).groupBy("tree", "block").applyInArrow(
            build, f"tree {kind}, rank long, size long, leaves long, digest string, "
                   "children array<struct<digest:binary,below:binary>>"),
        "merkle-segments")


def _trees(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """Segments of all trees, the lowest first, and ``tree``, ``size`` in leaves and ``digest`` of the
    roots."""
    passes, roots = [], None
    while True:
        passes.append(_segments(nodes, most))
        # A tree of one segment ends here; a lone leaf is its own root.
        done = passes[-1].where("size = 1").select("tree", F.col("leaves").alias("size"), "digest")
        roots = done if roots is None else roots.unionAll(done)
        nodes = passes[-1].where("size > 1").select("tree", "rank", "size", "leaves", "digest")
        if nodes.isEmpty():
            return passes, roots


def _at(requests: DataFrame, records: DataFrame) -> DataFrame:
    """Requests with the children that are known by their digest.  Equal segments are one record."""
    return requests.join(records.select("digest", "children").dropDuplicates(["digest"]), "digest")


def _split(requests: DataFrame, records: DataFrame, level: int, most: int) -> DataFrame:
    """Requests at segments of the ``level``, led down to a request for each node at their bottom."""
    span = FAN_OUT ** most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = batch.schema
            for row in batch.to_pylist():
                below = {x["digest"]: x["below"] for x in row["children"]}
                width = -(-row["size"] // span ** level)
                height, first = min(most, levels_of(width)), row["rank"] * span
                ranks = range(first, min(first + span, width))
                found = [_descend(below, row["digest"], r - first, height) for r in ranks]
                same = {c: pa.array([row[c]] * len(ranks), types.field(c).type) for c in ("tree", "size", "subroot", "root")}
                yield pa.RecordBatch.from_pydict(same | {
                    "rank": pa.array(ranks, pa.int64()), "digest": pa.array([d for d, _ in found], pa.string()),
                    "path": pa.array([row["path"] + p for _, p in found], types.field("path").type)})

    kind = requests.schema["tree"].dataType.simpleString()
    return _at(requests, records).mapInArrow(
        run, f"tree {kind}, size long, subroot string, root string, rank long, digest string, path {_PATH}")


def _walk(roots: DataFrame, passes: list[DataFrame], most: int) -> DataFrame:
    """Requests at the roots of trees of ``size`` leaves, led down to the lowest segments."""
    requests, span = None, FAN_OUT ** most
    for level in range(len(passes) - 1, -1, -1):
        # Trees whose topmost segment is of this level.
        reach = (F.col("size") <= span ** (level + 1)) & ((F.col("size") > span ** level) | F.lit(level == 0))
        start = roots.where(reach).withColumn("rank", F.lit(0).cast("long"))
        requests = start if requests is None else requests.unionByName(start)
        if level:
            requests = stored(_split(requests, passes[level], level, most), "merkle-requests")
    return requests


def proofs(rows: DataFrame, most: int = HEIGHT, paths: bool = True) -> DataFrame:
    """A proof for every row: ``id``, ``leaf``, ``subroot``, ``root``, ``path`` (the siblings from leaf to root,
    left and right of it at each level; null unless ``paths``), ``proof_sha256`` (their digest, left
    to right), ``folded_root`` (where ``shown`` and the proof lead) and ``verified`` (that is the root).

    ``rows`` has ``tree`` (the source), ``id`` (orders a source's rows), ``leaf`` (the digest in the
    manifest) and ``shown`` (the digest that is to be verified).  Sources are ordered by code
    point, null first; null ids come before others, and rows with one id follow each other by
    leaf.  Equal rows are leaves of their own with different proofs.  A lone row's digest is its
    source's subroot; with one source that is the root, and a lone row's proof is empty.  A null
    ``shown`` leads nowhere and is not verified.  An empty table has no root and gives no rows.
    Segments have ``most`` levels.
    """
    span = FAN_OUT ** most
    # Rows that are equal in all else are told apart, so that many of them can be spread.
    leaves = numbered(stored(rows.select("tree", "id", "leaf", "shown").withColumn(
        "row", F.monotonically_increasing_id()), "merkle-leaves"), ["id", "leaf", "row"], "merkle-sorted")
    leaves = stored(leaves.drop("row").withColumn("block", F.floor(F.col("rank") / span)), "merkle-ranked")
    passes, subroots = _trees(leaves.select("tree", "rank", "size", F.col("size").alias("leaves"), F.col("leaf").alias("digest")), most)
    sources = stored(numbered(subroots.select(
        F.lit(0).alias("tree"), F.col("tree").alias("source"), "digest", F.col("size").alias("n")), ["source"], "merkle-roots"),
        "merkle-sources")
    top, root = _trees(sources.select("tree", "rank", "size", F.col("size").alias("leaves"), "digest"), most)

    # From the root to the subroots, from there to the lowest segments.
    start = root.select("tree", "size", F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"),
                        "digest", F.array().cast(_PATH).alias("path"))
    reached = _split(_walk(start, top, most), top[0], 0, most).select("rank", "root", "digest", "path")
    start = reached.join(sources.select("rank", "source", "n"), "rank").select(
        F.col("source").alias("tree"), F.col("n").alias("size"), F.col("digest").alias("subroot"), "root", "digest", "path")
    segments = _at(_walk(stored(start, "merkle-subroots"), passes, most), passes[0]).withColumnRenamed("rank", "block")

    def read(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return shape.empty_table()
        at = right.to_pylist()[0]
        below = {x["digest"]: x["below"] for x in at["children"]}
        height, first = min(most, levels_of(at["size"])), at["block"] * span
        out: list[list] = [[] for _ in range(5)]
        for rank, digest, shown in zip(*(left[c].to_pylist() for c in ("rank", "leaf", "shown"))):
            found, path = _descend(below, at["digest"], rank - first, height)
            if found != digest:
                raise ValueError(f"the manifest leads to another leaf at rank {rank}")
            path = (at["path"] + path)[::-1]
            folded = fold(shown, path) if shown is not None else None
            siblings = [x[side] for x in path for side in ("left", "right")]
            for column, value in zip(out, (path if paths else None, _hash(siblings), folded, folded == at["root"], at["root"])):
                column.append(value)
        names = ["path", "proof_sha256", "folded_root", "verified", "root"]
        columns = {n: pa.array(c, shape.field(n).type) for n, c in zip(names, out)}
        columns |= {"id": left["id"], "leaf": left["leaf"], "subroot": pa.array([at["subroot"]] * len(left), pa.string())}
        return pa.table([columns[n] for n in shape.names], schema=shape)

    schema = rows.select("id").schema.add("leaf", "string").add("subroot", "string").add("root", "string").add(
        "path", _PATH_TYPE).add("proof_sha256", "string").add("folded_root", "string").add("verified", "boolean")
    shape = to_arrow_schema(schema)
    return leaves.select("tree", "block", "rank", "id", "leaf", "shown").groupBy("tree", "block").cogroup(
        segments.groupBy("tree", "block")).applyInArrow(read, schema)
