"""Merkle manifest against a tree built whole, with many segments, and edge cases."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidegate.llm import merkle

sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
ROWS = "id long, tree string, leaf string, shown string, root string, path long"


def plain_leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(digests):
    """Root, and for each leaf its siblings from the leaf up."""
    at, paths, level = list(range(len(digests))), [[] for _ in digests], list(digests)
    while len(level) > 1:
        for leaf, x in enumerate(at):
            run = level[x // 3 * 3: x // 3 * 3 + 3]
            paths[leaf].append(("".join(run[: x % 3]), "".join(run[x % 3 + 1:])))
            at[leaf] = x // 3
        level = [sha("".join(level[i: i + 3])) for i in range(0, len(level), 3)]
    return level[0], paths


def plain_proofs(rows):
    """Counted (id, leaf, subroot, root, proof digest, folded root) of all rows."""
    key = lambda r: ((r[0] is not None, r[0] or 0), r[2])
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append(r)
    sources = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: plain_tree([r[2] for r in sorted(trees[s], key=key)]) for s in sources}
    root, tops = plain_tree([built[s][0] for s in sources])
    out = []
    for s, top in zip(sources, tops):
        subroot, paths = built[s]
        for r, path in zip(sorted(trees[s], key=key), paths):
            folded = r[3]
            for left, right in path + top:
                folded = folded and sha(left + folded + right)
            out.append((str(r[0]), r[2], subroot, root, sha("".join(a + b for a, b in path + top)), str(folded)))
    return sorted(out)


@pytest.mark.parametrize("most", [1, 2, merkle.HEIGHT])
def test_proofs(spark, most):
    rnd = random.Random(most)
    rows = []
    for source, n in (("hot", 130), ("a", 1), (None, 9), ("", 10), ("é", 27), ("Z", 28), ("b", 2), ("c", 3)):
        for i in rnd.sample(range(1000), n):
            leaf = sha(f"{source}{i}")
            rows.append((i, source, leaf, leaf if rnd.random() < .5 else sha("x"), "mine", 7))
    # Repeated rows, one id with several texts, no id, nothing to be shown.
    rows += [(5, "hot", sha("s"), sha("s"), "", 0)] * 40 + [(5, "hot", sha("t"), sha("t"), "", 0)] + [(None, "hot", sha("n"), None, "", 0)] * 3
    rnd.shuffle(rows)
    got = merkle.proofs(spark.createDataFrame(rows, ROWS).repartition(6), most).collect()
    assert sorted((str(r.id), r.leaf, r.subroot, r.root, r.proof_sha256, str(r.folded_root)) for r in got) == plain_proofs(rows)
    for r in got:
        assert r.verified == (r.folded_root == r.root)
        assert merkle.fold(r.leaf, r.path) == r.root
        assert sha("".join(x.left + x.right for x in r.path)) == r.proof_sha256


def test_lone_rows_and_empty_tables(spark):
    lone = [(1, "s", sha("x"), sha("x"), "", 0)]
    got = merkle.proofs(spark.createDataFrame(lone, ROWS)).collect()
    assert [(r.leaf, r.subroot, r.root, r.path, r.proof_sha256, r.verified) for r in got] == [(sha("x"), sha("x"), sha("x"), [], sha(""), True)]
    assert merkle.proofs(spark.createDataFrame([], ROWS)).collect() == []


def test_many_sources(spark):
    rows = [(i, f"s{i}", sha(str(i)), sha(str(i)), "", 0) for i in range(60)]
    got = merkle.proofs(spark.createDataFrame(rows, ROWS), 2).collect()
    assert sorted((str(r.id), r.leaf, r.subroot, r.root, r.proof_sha256, str(r.folded_root)) for r in got) == plain_proofs(rows)


def test_leaves(spark):
    values = [(1, "s", "en", 3, "añ\n"), (None, None, None, None, None), (-2, "", "", 0, ""), (4, "s", "x", 1, "w" * 3_000_000)]
    docs = spark.createDataFrame(values, "doc_id long, source string, lang string, n_chars long, text string")
    got = docs.select(merkle.leaf(*map(F.col, docs.columns)).alias("leaf")).collect()
    assert [r.leaf for r in got] == [plain_leaf(*v) for v in values]
