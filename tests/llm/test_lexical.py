"""Ranked lexical search against a plain computation, in rounds and bundles, and edge cases."""

import math
import random
import re
from collections import Counter

import pytest

from tidegate.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, item_id long, score string, rank long"
ITEMS = "item_id long, text string, doc_id string, nr long"


def plain_terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(lower)


def plain_ranks(docs, items, k=10):
    held = [(d, Counter(plain_terms(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c, n in held:
            m = 25 + 75 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in plain_terms(text) if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, *_, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(map(str, out))


def ranked(spark, docs, items, **how):
    got = lexical.rank(spark.createDataFrame([(*d, 1, "x", 2) for d in docs], DOCS).repartition(5),
                       spark.createDataFrame([(*i, "x", 3) for i in items], ITEMS), **how)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(str((r.item_id, r.rank, r.doc_id, r.score)) for r in got.collect())


def test_terms():
    for text in ("", "A_b-C9", "Straße ÄÖ x y", "\x00a\x7fb[]", "漢字 kana", None, "İK"):
        assert [t.decode() for t in lexical.terms(text)] == plain_terms(text)


@pytest.mark.parametrize("how", [{}, {"bundle": 3, "shares": (0.1, 0.5, 1.0)}, {"round_chars": 300, "shares": (1.0,)}])
def test_ranks(spark, monkeypatch, how):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["The", "the", "É", "é"]
    weights = [60 / (i + 1) for i in range(60)] + [200, 200, 5, 5]
    text = lambda n: " ".join(rnd.choices(words, weights, k=n))
    docs = [(i, text(rnd.choice([1, 5, 30, 200]))) for i in range(400)]
    docs += [(7, "tie w1"), (7, "tie w1"), (None, "tie w1"), (None, None), (900, ""), (901, "--"), (3, "tie w1"), (902, "tie " + "w2 " * 300_000)]
    items = [(i, text(12)) for i in range(12)] + [(1, "tie"), (1, "tie"), (None, "tie tie w9"), (50, None), (51, ""), (52, "unknown")]
    assert ranked(spark, docs, items, **how) == plain_ranks(docs, items)


def test_hot_and_empty(spark):
    same = [(i, "one and the same text") for i in range(500)] + [(1000, "another text")]
    assert ranked(spark, same, [(1, "same another")]) == plain_ranks(same, [(1, "same another")])
    assert ranked(spark, [], [(1, "a")]) == ranked(spark, same, []) == ranked(spark, [(1, None)], [(1, "a")]) == []


def test_small_blocks(spark):
    docs = [(i, f"a b{i % 7} c{i % 50}") for i in range(300)]
    items = [(i, f"a b{i} c{i} c{i + 1}") for i in range(9)]
    assert ranked(spark, docs, items, k=3) == plain_ranks(docs, items, 3)
