"""Near-duplicates, nearest neighbours and the helpers they share, against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tidegate.llm import ann, embed_dedup, queries, simhash
from tidegate.llm.common import components, deal, forest

SF = "/root/testdata/sf0.001"


def smallest(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(0)
    links = [(i, i + 1) for i in range(60)] + [(rnd.randrange(100, 400), rnd.randrange(100, 400)) for _ in range(150)]
    links += [(500, x) for x in range(501, 560)] + [(7, 7), (None, 3), (1, None)] + [(-5, 900), (900, -5)]
    frame = spark.createDataFrame(links, "a long, b long")
    want = smallest([x for x in links if None not in x], {n for x in links for n in x if n is not None})
    got = {r.node: r.component for r in components(frame, "t").collect()}
    assert got == {n: c for n, c in want.items() if any(n in x and x[0] != x[1] and None not in x for x in links)}
    assert components(frame.limit(0), "t").collect() == []


def test_forest():
    rnd = random.Random(1)
    links = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(160)]
    a, b = forest(*(np.array(x) for x in zip(*links)))
    want = smallest(links, {n for x in links for n in x})
    assert dict(zip(a.tolist(), b.tolist())) == {n: r for n, r in want.items() if n != r}


@pytest.mark.parametrize("within", [True, False])
def test_units_hold_every_pair_once(spark, within):
    rows = [("x", i, i % 3 != 0) for i in range(50)] + [("y", 100 + i, True) for i in range(3)] + [("z", 200, False)]
    frame = spark.createDataFrame(rows, "cell string, id int, home boolean")
    dealt = deal(frame, ["cell"], F.col("home"), F.col("id"), 7, within=within).collect()
    units = {}
    for r in dealt:
        units.setdefault((r.cell, r.unit_i, r.unit_j), []).append(r)
    pairs = []
    for unit in units.values():
        left, right = [r for r in unit if r.side == 0], [r for r in unit if r.side == 1]
        assert max(len(left), len(right)) <= 20
        pairs += [frozenset((a.id, b.id)) for a in left for b in right]
        if any(r.inner for r in left):
            pairs += [frozenset((a.id, b.id)) for i, a in enumerate(left) for b in left[i + 1:]]
    want = [frozenset((a[1], b[1])) for i, a in enumerate(rows) for b in rows[i + 1:]
            if a[0] == b[0] and (a[2] != b[2] or within and a[2])]
    assert sorted(map(sorted, pairs)) == sorted(map(sorted, want))


# SimHash

def plain_fingerprint(text, words=4):
    tokens = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not tokens:
        return 0
    shingles = [b" ".join(tokens[i: i + words]) for i in range(max(len(tokens) - words + 1, 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def test_fingerprints():
    rnd = random.Random(4)
    texts = [None, "", " \n", "one", "One TWO", "ÄÖ a b c d", "same " * 500, "a\x1cb c\x85d e"]
    texts += [" ".join(rnd.choices("abcdefgh", k=rnd.randint(1, 900))) for _ in range(20)]
    for t in texts:
        assert simhash.fingerprint(t.encode() if t is not None else None) == plain_fingerprint(t)


def brute_components(ids, prints, k):
    links = [(i, j) for i in range(len(ids)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= k]
    root = smallest(links, range(len(ids)))
    first = {}
    for i, r in root.items():
        first[r] = min((x for x in (first.get(r), ids[i]) if x is not None), default=None)
    return [first[root[i]] for i in range(len(ids))]


def test_simhash_query(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    prints = [plain_fingerprint(r.text) for r in docs]
    got = sorted(queries.QUERIES["op4_simhash_near_dedup"](spark, SF).collect())
    assert [r.fingerprint for r in got] == [f"{p:016x}" for p in prints]
    assert [r.component_id for r in got] == brute_components([r.doc_id for r in docs], prints, 4)


@pytest.mark.parametrize("k, cost, rows", [(4, 60, 16_384), (4, 0.001, 5), (3, 60, 4), (7, 60, 50), (0, 60, 3), (1, 60, 16)])
def test_links_connect_what_is_near(spark, monkeypatch, k, cost, rows):
    monkeypatch.setattr(simhash, "PROBE_COST", cost)
    rnd = random.Random(k)
    centres = [rnd.getrandbits(64) for _ in range(60)]
    prints = {0, 2 ** 64 - 1}
    for c in centres:
        for _ in range(8):
            c ^= sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 6))) & (2 ** 64 - 1)
            prints.add(c)
    prints |= {centres[0] ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)}  # one dense group
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    frame = spark.createDataFrame([(p,) for p in prints], "fp long").repartition(4)
    reach = {r.node: r.component for r in components(simhash.links(frame, k, rows), "t").collect()}
    links = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if ((a ^ b) & (2 ** 64 - 1)).bit_count() <= k]
    want = smallest(links, prints)
    assert {p: reach.get(p, p) for p in prints} == want


def test_thresholds_add_up():
    rnd = np.random.default_rng(1)
    bits = (rnd.random((500, 64)) < np.linspace(0.02, 0.5, 64)).astype(float)
    both = bits.T @ bits
    for k in (0, 1, 4, 7):
        for parts in range(1, k + 2):
            groups = simhash.group_bits(500, both, parts)
            assert sorted(b for g in groups for b in g) == list(range(64))
            _, thresholds = simhash.allocate(500, both, groups, k)
            assert len(thresholds) == parts and sum(t + 1 for t in thresholds) >= k + 1


def test_simhash_edges(spark):
    long = "the quick brown fox jumps " * 50_000
    rows = [(3, None, "a"), (2, "", "b"), (9, " ", "c"), (5, long, "d"), (4, long, "e"), (7, "one two three four five", "f"),
            (7, "one two three four five", "f"), (None, "one two three four five", "g"), (None, "only null ids here", "h"),
            (None, "only null ids here", "i"), (8, "quite another text than those", "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, first_id string") \
        .withColumn("n_rows", F.lit(1)).withColumn("component_id", F.lit(2)).withColumn("row", F.lit("r"))
    got = simhash.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == sorted(
        [("2", "2"), ("3", "2"), ("9", "2"), ("5", "4"), ("4", "4"), ("7", "7"), ("7", "7"), ("None", "7"),
         ("None", "None"), ("None", "None"), ("8", "8")])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "4", "7", "8", "None"]
    assert simhash.near_duplicates(docs.limit(0)).collect() == [] and simhash.keep_one(docs.limit(0)).collect() == []


def five_word_sets(texts):
    tokens = [(t or "").lower().split() for t in texts]
    return [{" ".join(t[i: i + 5]) for i in range(max(len(t) - 4, 1))} if t else set() for t in tokens]


def similar_links(sets, prints, k):
    """Pairs of equal sets, and those at 0.8 or more whose fingerprints lie within ``k`` bits."""
    return [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a == b or (
        min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) - 1e-9
        and (prints[i] ^ prints[j]).bit_count() <= k and len(a & b) >= 0.8 * len(a | b) - 1e-9)]


def test_similarity_edges(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, "a b c d e f", 1, "x", 2), (1, "a b c d e f", 1, "x", 2), (None, "a b c d e f", 1, "x", 2), (None, None, 1, "x", 2),
            (3, "", 1, "x", 2), (4, long, 1, "x", 2), (5, long + " end", 1, "x", 2), (6, "other words of a clean text", 1, "x", 2), (None, "no id", 1, "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node long, unit string, component_id long")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.similar_documents(docs).collect())
    assert got == sorted([("1", "1"), ("1", "1"), ("None", "1"), ("None", "3"), ("3", "3"), ("4", "4"), ("5", "4"), ("6", "6"), ("None", "None")])
    kept = simhash.keep_one(docs, words=5, k=16, similarity=0.8)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "6", "None"]
    empty = docs.limit(0)
    assert simhash.similar_documents(empty).collect() == [] and simhash.keep_one(empty, words=5, k=16, similarity=0.8).collect() == []


@pytest.mark.parametrize("n", [1_000_000, 100_000_000])
def test_bands_lower_the_rows_of_a_plan(n):
    both = np.full((64, 64), n / 4)
    np.fill_diagonal(both, n / 2)
    sent = lambda probes, own, visits: sum(own + visits * len(flips) for _, _, flips in probes)
    banded = sent(simhash.plan(n, both, 14, [n // 20] * 20), 2, 1.5)
    assert banded < 0.6 * sent(simhash.plan(n, both, 14), 1, 0.5)


@pytest.mark.parametrize("most, unit", [(16, 16_384), (1, 40), (0, 5)])
def test_near_duplicates_are_checked_by_similarity(spark, most, unit):
    rnd = random.Random(8)
    texts = [None, "", "one", "One", "one two three four five six"]
    for size in (30, 60, 60, 200):
        base = [f"w{rnd.randrange(5000)}" for _ in range(size)]
        for _ in range(40):  # some at 0.8 or more, some below
            own = list(base)
            for _ in range(rnd.randint(0, size // 20)):
                own[rnd.randrange(size)] = f"x{rnd.randrange(5000)}"
            texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = simhash.similar_documents(docs, k=14, most=most, unit_rows=unit)
    sets, prints = five_word_sets(texts), [plain_fingerprint(t, 5) for t in texts]
    want = smallest(similar_links(sets, prints, 14), range(len(texts)))
    assert {r.doc_id: r.component_id for r in got.collect()} == want
    assert len(set(want.values())) > 20


def test_pipeline_drops_similar_and_keeps_other_documents(spark):
    rnd = random.Random(3)
    docs = []
    for at in range(30):
        base = [f"w{rnd.randrange(5000)}" for _ in range(90)]
        docs += [(2 * at, " ".join(base)), (2 * at + 1, " ".join([*base[:40], "other", *base[41:]]))]
    prints = [plain_fingerprint(t) for _, t in docs]
    assert any((a ^ b).bit_count() > 4 for a, b in zip(prints[::2], prints[1::2]))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicate_filter(spark, frame, SF)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 60, 2))


# Embeddings

def vectors(seed, n=400, dim=24):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(12, dim))
    x = np.concatenate([rnd.normal(size=(n, dim)), *(c + rnd.normal(size=(25, dim)) * s for c, s in zip(centres, np.linspace(0, .4, 12)))])
    x[-40:] *= 7.5
    return x.astype(np.float32)


def cosines(x):
    x = x.astype(np.float64)
    length = np.sqrt((x * x).sum(axis=1))
    return np.array([[float((a * b).sum() / (p * q)) for b, q in zip(x, length)] for a, p in zip(x, length)])


@pytest.mark.parametrize("dims, cell, unit", [(16, 8192, 8192), (8, 60, 40), (5, 20, 15), (32, 16, 100)])
def test_links_of_vectors(spark, dims, cell, unit):
    x = vectors(dims)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = embed_dedup.near_duplicates(frame.repartition(3), 0.95, dims, cell, unit).orderBy("vec_id").collect()
    near = cosines(x) >= 0.95
    np.fill_diagonal(near, False)
    assert [r.n_links for r in got] == near.sum(axis=1).tolist()
    want = smallest(list(zip(*np.nonzero(near))), range(len(x)))
    assert [r.component_id for r in got] == [want[i] for i in range(len(x))]


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]),
            (8, []), (9, [1.0]), (9, [3.0]), (None, [1.0, 0.0]), (10, [0.0, 1.0]), (0, [1.0, 0.01])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("vec", F.lit("x"))
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in embed_dedup.near_duplicates(frame).collect())
    assert got == sorted([("1", 3, "0"), ("2", 3, "0"), ("0", 3, "0"), ("None", 3, "0"), ("3", 0, "3"), ("4", 0, "4"), ("5", 0, "5"),
                          ("6", 0, "6"), ("7", 0, "7"), ("8", 0, "8"), ("9", 1, "9"), ("9", 1, "9"), ("10", 0, "10")])
    assert embed_dedup.near_duplicates(frame.limit(0)).collect() == []
    found = ann.search(frame, frame.where("vec_id in (1, 3, 9)"), k=2).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in found] == [(1, 1, 2), (1, 2, 0)]
    assert ann.search(frame.limit(0), frame, k=2).collect() == []
    assert ann.search(frame, frame.limit(0), k=2).collect() == []


def test_embedding_query(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    near = cosines(np.array([r.embedding for r in table], np.float32)) >= 0.95
    np.fill_diagonal(near, False)
    got = queries.QUERIES["op1_embedding_near_dedup"](spark, SF).orderBy("vec_id").collect()
    assert [r.n_links for r in got] == near.sum(axis=1).tolist()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


@pytest.mark.parametrize("leaf, unit", [(5000, 8192), (200, 8192), (20, 30)])
def test_recall_and_scores(spark, leaf, unit):
    x = np.concatenate([vectors(2), vectors(3, n=1200)])
    x[5] = x[900] = x[905] = x[50] * 2  # ties
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.search(frame, frame.where("vec_id % 50 = 0"), 5, leaf_rows=leaf, unit_rows=unit).collect()
    by = {}
    for r in sorted(got):
        by.setdefault(r.query_id, []).append(r)
    assert sorted(by) == list(range(0, len(x), 50))
    score = cosines(x)
    hits = 0
    for q, found in by.items():
        order = sorted((i for i in range(len(x)) if i != q), key=lambda i: (-score[q, i], i))[:5]
        assert [r.rank for r in found] == [1, 2, 3, 4, 5]
        assert [r.score for r in found] == [score[q, r.vec_id] for r in found]
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        hits += len({r.vec_id for r in found} & set(order))
    assert hits >= 0.9 * 5 * len(by)
    if leaf == 5000:  # one leaf
        assert hits == 5 * len(by)


def test_outliers_among_groups_of_copies_get_all_ranks(spark, monkeypatch):
    monkeypatch.setattr(ann, "calibrate", lambda *_: 1)  # as where most rows lie in groups of copies
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(20, 16))
    x = np.concatenate([np.repeat(centres, 100, axis=0) + rnd.normal(size=(2000, 16)) * 0.001, rnd.normal(size=(40, 16))])
    ids = [*range(2030), *[2030] * 10]  # ten rows of one id
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    got = ann.search(frame, frame.where("vec_id >= 2000").dropDuplicates(["vec_id"]), 5, leaf_rows=5)
    ranks = got.groupBy("query_id").agg(F.sort_array(F.collect_list("rank")).alias("ranks")).collect()
    assert {r.query_id: r.ranks for r in ranks} == {i: [1, 2, 3, 4, 5] for i in range(2000, 2031)}


def test_every_length_is_searched(spark):
    """Queries of a rare length get the nearest of that length."""
    short, long_ = vectors(7, n=300), np.random.default_rng(8).normal(size=(40, 3)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate([*short, *long_])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(frame, frame.where("vec_id % 50 = 0"), 5, recall=1.0).collect()
    for base, part in ((0, short), (len(short), long_)):
        score = cosines(part)
        for q in range(0, len(part), 50):
            order = sorted((i for i in range(len(part)) if i != q), key=lambda i: (-score[q, i], i))[:5]
            found = sorted(r for r in ((r.rank, r.vec_id, r.query_id) for r in got) if r[2] == base + q)
            assert [r[1] - base for r in found] == order
    assert len(got) == 5 * 13


@pytest.mark.parametrize("size", [5, 300], ids=["small unit", "large unit"])
def test_each_node_of_a_pair_has_a_record(size):
    """Which nodes a unit needs is read off its records, without spreading the lists of partners."""
    import pyarrow as pa

    same = {c: np.zeros(size, np.int64) for c in ("part", "cell", "unit_i", "unit_j", "side", "unit")}
    ids = np.arange(1, size + 1)
    batch = pa.RecordBatch.from_pydict({
        **same, "fp": ids % 7, "node": ids, "label": ids, "n": np.full(size, 9), "inner": np.ones(size, bool)})
    found = [r for b in simhash._pairs(16, [(-1, 16, [])], 0.8, 4)(iter([batch])) for r in b.to_pylist()]
    assert {r["a"] for r in found} == set(ids.tolist()) and len(found) == size
    assert max(len(r["b"]) for r in found) == 4 and min(len(r["b"]) for r in found) == 0
