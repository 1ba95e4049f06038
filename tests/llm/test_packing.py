"""Packing: every id in one piece, no padding, and edge cases."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.test_text_operators import DOCS, EDGES
from tidegate.llm import packing, queries

SF = "/root/testdata/sf0.001"


def lay_out(rows, window):
    """Sequences by number: pieces must follow without a gap; only powers of two may be shorter."""
    sequences = {}
    for r in rows:
        assert r.length == len(r.ids) // 4 > 0
        sequences.setdefault(r.sequence_id, []).append(r)
    for row in sequences.values():
        row.sort(key=lambda r: r.offset)
        at = 0
        for r in row:
            assert r.offset == at
            at += r.length
        assert at == window or at < window and at & (at - 1) == 0
    return sequences


def test_all_ids_are_packed(spark):
    library = Tokenizer.from_str(queries.vocabulary())
    docs = queries.table(spark, SF, "documents").repartition(7)
    rows = packing.pack(docs, queries.vocabulary()).collect()
    sequences = lay_out(rows, packing.WINDOW)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    texts = dict(docs.select("doc_id", "text").collect())
    assert set(by_doc) == set(texts)
    total = 0
    for doc, text in texts.items():
        own = sorted(by_doc[doc], key=lambda r: r.start)
        want = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert b"".join(bytes(r.ids) for r in own) == want.tobytes()
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own[:-1])]).tolist()
        assert {r.doc_tokens for r in own} == {len(want)}
        total += len(want)
    assert len(sequences) <= total // packing.WINDOW + bin(total % packing.WINDOW).count("1")


def test_query_gives_digests(spark):
    rows = queries.QUERIES["op11_bounded_space_packing"](spark, SF).collect()
    ids = {(r.doc_id, r.start): bytes(r.ids) for r in packing.pack(queries.table(spark, SF, "documents"), queries.vocabulary()).collect()}
    assert {(r.doc_id, r.start): r.ids_crc32 for r in rows} == {k: zlib.crc32(v) for k, v in ids.items()}


@pytest.mark.parametrize("window,most", [(16, 3), (64, 1), (8, 40)])
def test_rounds_of_leftovers(spark, window, most):
    rnd = random.Random(window)
    words = [(i % 40 or None, " ".join(rnd.choices(["the", "cat", "a", "dog"], k=rnd.choice([0, 1, 3, 7, 30, 200])))) for i in range(300)]
    docs = spark.createDataFrame(words, "doc_id long, text string").repartition(23)
    rows = packing.pack(docs, queries.vocabulary(), window=window, open_windows=most, fan_in=3).collect()
    lay_out(rows, window)
    assert sum(r.length for r in rows) == sum(len(t.split()) + 1 for _, t in words)
    # Rows with one id are told apart by what they hold only: compare the ids of all pieces together.
    assert sum(np.frombuffer(r.ids, "<u4").tolist().count(1) for r in rows) == len(words)


def test_best_fit_and_fullest():
    packer = packing.Packer(10, 2)
    piece = lambda n, doc: packing._Piece(doc, 0, n, memoryview(bytes(4 * n)))
    for n, doc in ((7, "a"), (5, "b"), (3, "c")):  # c completes a, the fuller one
        packer.add(piece(n, doc))
    assert [[p.doc for p in row] for row in packer.done] == [["a", "c"]]
    for n, doc in ((8, "d"), (6, "e")):  # e fits neither b nor d: d is topped up, the rest goes to b
        packer.add(piece(n, doc))
    assert [[(p.doc, p.start, p.size) for p in row] for row in packer.done[1:]] == [[("d", 0, 8), ("e", 0, 2)]]
    assert [(w.free, [p.doc for p in w.pieces]) for w in packer.open] == [(1, ["b", "e"])]
    assert [sum(p.size for p in row) for row in packing._powers([piece(5, 1), piece(6, 2)])] == [8, 2, 1]


def test_edges(spark):
    edges = spark.createDataFrame(EDGES, DOCS).withColumns({"sequence_id": F.lit(1), "leftover": F.lit(2), "start": F.lit("x")})
    rows = packing.pack(edges, queries.vocabulary()).collect()
    lay_out(rows, packing.WINDOW)
    tokens = {}
    for r in rows:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    assert tokens[1] == tokens[2] == tokens[3] == 1 and tokens[6] == 2 * 3 and tokens[None] == 4
    assert tokens[5] == 40_000 * 10 + 1
    assert packing.pack(edges.limit(0), queries.vocabulary()).collect() == []
