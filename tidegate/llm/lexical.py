"""Ranked lexical search by pipelined term partitioning.

The terms of the items are dealt among a few owners, the rarest first, so that each owner's share of
the work is a multiple of the one before.  Documents are read once; blocks of them keep the postings
of the items' terms, divided by owner.  A bundle of items starts at each block with an empty sparse
accumulator and goes through the owners one after the other: at each it meets the owner's postings
of its block by cogroup and adds integer contributions.  Only what the rare terms have touched is
carried on; the owner of the most frequent terms comes last, and there each bundle's best documents
are chosen.  The best of all blocks are ranked at the end.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.common import portions, stored

# Documents of a block, and items of a bundle: an accumulator has at most so many entries as both give.
BLOCK = 4_096
BUNDLE = 256
# Words of a block, about.
BLOCK_WORDS = 4 << 20
# Shares of the expected additions up to which each owner's terms reach.
OWNERS = (1 / 64, 1 / 8, 1.0)
# Characters of the items whose terms are held at a time; more items go through in further rounds.
ROUND_CHARS = 32 << 20
# Constants of the score.
SCALE, TF_SCALE, LENGTH_WEIGHT = 1_000_000_000, 1_000, 75

# Separators (all ASCII but letters and digits) become blanks, A-Z become lower case.
_TERMS = bytes(32 if c < 128 and not chr(c).isalnum() else ord(chr(c).lower()) if c < 128 else c for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The runs of ASCII letters, digits and other characters above ASCII, A-Z in lower case."""
    return text.encode().translate(_TERMS).split() if text else []


def weight(total: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))


def _queries(items: DataFrame) -> tuple[list[bytes], list[dict[int, int]]]:
    """Terms of one round's items, and of each item, in order of ``nr``, its terms and their repeats."""
    number: dict[bytes, int] = {}
    rows = items.orderBy("nr").select("item.text").collect()
    wanted = [Counter(number.setdefault(t, len(number)) for t in terms(r.text)) for r in rows]
    return list(number), wanted


def _postings(docs: DataFrame, names: list[bytes]) -> DataFrame:
    """Blocks of documents that have a term: ``ids``, ``sizes`` (terms with repeats) and the postings
    ``term``, ``doc`` (place in the block) and ``tf`` of the terms asked for, ordered by term."""
    ids = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(names)}
        kind = None
        doc_ids, sizes, found = [], [], []

        def block() -> pa.RecordBatch:
            places = np.concatenate([np.full(len(t), i, np.int32) for i, (t, _) in enumerate(found)])
            term, tf = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            order = np.argsort(term, kind="stable")
            return pa.RecordBatch.from_pydict({
                "ids": pa.array([doc_ids], pa.list_(kind)), "sizes": pa.array([sizes], pa.list_(pa.int64())),
                "term": pa.array([term[order].tobytes()], pa.binary()), "doc": pa.array([places[order].tobytes()], pa.binary()),
                "tf": pa.array([tf[order].tobytes()], pa.binary())})

        words = 0
        for batch in portions(batches):
            kind = batch.column(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = terms(text.as_py())
                if not own:
                    continue
                counts = Counter(map(number.get, own))
                counts.pop(None, None)
                doc_ids.append(doc)
                sizes.append(len(own))
                found.append((np.fromiter(counts.keys(), np.int32, len(counts)), np.fromiter(counts.values(), np.int32, len(counts))))
                words += len(own)
                if len(doc_ids) == BLOCK or words >= BLOCK_WORDS:
                    yield block()
                    doc_ids, sizes, found, words = [], [], [], 0
        if doc_ids:
            yield block()

    rows = docs.select("doc_id", "text").mapInArrow(
        run, f"ids array<{ids}>, sizes array<long>, term binary, doc binary, tf binary")
    return stored(rows.withColumn("block", F.monotonically_increasing_id()), "lexical-postings")


def _statistics(postings: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, their terms with repeats, and for each term asked for the documents
    that hold it.  Counts of a task are combined before they reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            for row in batch.column(0):
                df += np.bincount(np.frombuffer(row.as_py(), np.int32), minlength=n_terms)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], ["term", "n"])

    total, size = postings.select(
        F.sum(F.size("sizes")), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x))).first()
    df = np.zeros(n_terms, np.int64)
    for term, n in postings.select("term").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect():
        df[term] = n
    return total or 0, size or 0, df


def owners(df: np.ndarray, items_with: np.ndarray, shares: tuple[float, ...] = OWNERS) -> np.ndarray:
    """The owner of each term: the rarest terms, up to each share of all (item, document) additions."""
    order = np.argsort(df, kind="stable")
    work = np.cumsum((df * items_with)[order])
    owner = np.empty(len(df), np.int64)
    owner[order] = np.searchsorted(np.array(shares[:-1]) * (work[-1] if len(work) else 0), work, side="left")
    return owner


def _round(docs: DataFrame, items: DataFrame, k: int, shares: tuple[float, ...], bundle: int) -> DataFrame:
    """``nr`` of the item, ``doc_id`` and ``score`` of the best documents of every block."""
    names, wanted = _queries(items)
    postings = _postings(docs, names)
    total, size, df = _statistics(postings, len(names))
    # Additions of an owner: for each term the items that hold it and how often, with the weight.
    weights = np.array([weight(total, int(x)) for x in df], np.int64)
    items_of: list[list[tuple[int, int]]] = [[] for _ in names]
    for nr, own in enumerate(wanted):
        for term, times in own.items():
            items_of[term].append((nr, times * int(weights[term])))
    owner = owners(df, np.array([len(x) for x in items_of], np.int64), shares)
    bundles = max(1, -(-len(wanted) // bundle))
    needed = [np.unique([t for own in wanted[b * bundle: (b + 1) * bundle] for t in own]).astype(np.int32) for b in range(bundles)]
    ids = docs.schema["doc_id"].dataType.simpleString()

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Postings by owner and bundle."""
        for batch in portions(batches, 1):
            row = batch.to_pylist()[0]
            term, doc, tf = (np.frombuffer(row[c], np.int32) for c in ("term", "doc", "tf"))
            for b in range(bundles):
                here = np.isin(term, needed[b]) if bundles > 1 else np.ones(len(term), bool)
                for o in range(len(shares)):
                    at = here & (owner[term] == o)
                    if at.any():
                        yield pa.RecordBatch.from_pydict({
                            "bundle": pa.array([b], pa.int32()), "block": [row["block"]], "owner": pa.array([o], pa.int32()),
                            "term": [term[at].tobytes()], "doc": [doc[at].tobytes()], "tf": [tf[at].tobytes()]})

    def added(left: pa.Table, right: pa.Table) -> tuple[dict, np.ndarray, np.ndarray]:
        """The bundle's accumulator (``nr`` in the bundle and place of the document as one number, and
        score) with the contributions of one owner."""
        row = left.to_pylist()[0]
        n = len(row["sizes"])
        first = row["bundle"] * bundle
        key, score = np.frombuffer(row["key"], np.int32), np.frombuffer(row["score"], np.int64)
        if not len(right):
            return row, key, score
        post = right.to_pylist()[0]
        term, doc, tf = (np.frombuffer(post[c], np.int32) for c in ("term", "doc", "tf"))
        m = 100 - LENGTH_WEIGHT + (LENGTH_WEIGHT * np.array(row["sizes"], np.int64) * total) // size
        tf = tf.astype(np.int64)
        part = SCALE * tf // (TF_SCALE * tf + 8 * m[doc])
        sums = np.zeros(min(bundle, len(wanted) - first) * n, np.int64)
        sums[key] = score
        # Postings are ordered by term, and a term has a document once: no place is added to twice.
        starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else []
        for s, e in zip(starts, np.r_[starts[1:], len(term)].astype(np.int64)):
            for nr, w in items_of[term[s]]:
                if first <= nr < first + bundle:
                    sums[(nr - first) * n + doc[s:e]] += w * part[s:e]
        key = np.flatnonzero(sums).astype(np.int32)
        return row, key, sums[key]

    def carry(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return left
        _, key, score = added(left, right)
        return left.set_column(left.schema.get_field_index("key"), "key", pa.array([key.tobytes()], pa.binary())).set_column(
            left.schema.get_field_index("score"), "score", pa.array([score.tobytes()], pa.binary()))

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = left.schema.field("ids").type.value_type
        out: tuple[list, list, list] = ([], [], [])
        if len(left):
            row, key, score = added(left, right)
            item, place = key // len(row["sizes"]), key % len(row["sizes"])
            first = np.searchsorted(item, np.arange(item[-1] + 2)) if len(item) else []
            for nr in range(len(first) - 1):
                s, p = score[first[nr]: first[nr + 1]], place[first[nr]: first[nr + 1]]
                # All that tie with the last of the best: ids decide among them.
                at = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k]) if len(s) > k else np.arange(len(s))
                rows = sorted(((-int(s[i]), row["ids"][p[i]] is None, row["ids"][p[i]]) for i in at),
                              key=lambda r: (r[0], r[1], 0 if r[1] else r[2]))[:k]
                for value, _, doc in rows:
                    for column, x in zip(out, (row["bundle"] * bundle + nr, doc, -value)):
                        column.append(x)
        return pa.table({"nr": pa.array(out[0], pa.int64()), "doc_id": pa.array(out[1], kind), "score": pa.array(out[2], pa.int64())})

    owned = stored(postings.select("block", "term", "doc", "tf").mapInArrow(
        dealt, "bundle int, block long, owner int, term binary, doc binary, tf binary"), "lexical-owners")
    nothing = F.lit(b"")
    state = postings.select(
        F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))).alias("bundle"), "block", "ids", "sizes",
        nothing.alias("key"), nothing.alias("score"))
    for o in range(len(shares)):
        both = state.groupBy("bundle", "block").cogroup(owned.where(F.col("owner") == o).groupBy("bundle", "block"))
        last = o == len(shares) - 1
        state = both.applyInArrow(choose if last else carry, f"nr long, doc_id {ids}, score long" if last else state.schema)
    return state


def rank(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text: str = "text", shares: tuple[float, ...] = OWNERS, bundle: int = BUNDLE,
         round_chars: int = ROUND_CHARS) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id`` and ``score`` of the ``k`` best documents of each item.

    With N documents that hold a term, L their terms and df the documents that hold a given one, an
    item's term weighs floor(1000 ln((2N+2)/(2df+1))) and adds that times 10^9 tf div (1000 tf + 8 m),
    m = 25 + 75 n N div L, n the document's terms.  Only scores above 0 count.  Equal scores are
    ordered by id, null ids last; rows with one id are documents of their own.

    Null and empty texts have no terms: such documents are not counted, such items find nothing.  A
    repeated item (also one without an id) is ranked as often as it occurs.  A very long text is one
    document of its block, which then ends.  Without documents or items there are no rows.  Further
    columns are not read.  Items go through in rounds of at most ``round_chars`` characters (or one
    item), whose terms every task holds.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    given = stored(items.select(F.struct(F.col(item_col).alias("id"), F.col(item_text).alias("text")).alias("item")), "lexical-items")
    chars = given.agg(F.sum(F.length("item.text"))).first()[0] or 0
    rounds = -(-chars // round_chars)
    # A repeated item gets a number of its own, so that it may be in any round.
    placed = stored(given.withColumn("row", F.monotonically_increasing_id()), "lexical-rows")
    found = None
    for r in range(rounds):
        own = placed.where(F.pmod(F.xxhash64("row"), F.lit(rounds)) == r)
        numbered = stored(own.withColumn("nr", F.row_number().over(Window.orderBy("row")).cast("long") - 1), "lexical-round")
        best = _round(docs, numbered, k, shares, bundle)
        best = best.join(numbered.select("nr", "row", F.col("item.id").alias("item_id")), "nr").drop("nr")
        found = best if found is None else found.unionAll(best)
    kind, doc_kind = given.select("item.id").schema["id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    if found is None:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id {doc_kind}, score long")
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "item_id", "rank", "doc_id", "score")
