"""URL rules, mixing, chat windows and the pipeline."""

import random
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.oracle import connect, differences
from tidegate.llm import chat, mixing, queries, url_rules
from tidegate.llm.common import WORD

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    assert differences(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name]) == ""


def test_llm_queries_are_registered(spark):
    import __spark_entry__
    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}


# URL rules

def plain_verdict(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3:]
        cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules
            if None not in (h, p, v) and h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best[3] if best else None, best[4] if best else "allow")


def test_rules_against_brute_force(spark):
    rnd = random.Random(0)
    name = lambda: ".".join(rnd.choices(["a", "b", "com", "net", "", "x-y", "ä"], k=rnd.randint(1, 4)))
    path = lambda: "".join("/" + rnd.choice(["", "a", "ab", "é", "b"]) for _ in range(rnd.randint(0, 3)))
    rules = list({(h, p): (h, p, rnd.choice(["allow", "block"])) for h, p in ((name(), path()) for _ in range(150))}.values())
    rules += [(None, "/", "block"), ("com", None, "block"), ("com", "/", None), ("", "", "block"), ("a.com", "/", "block"), ("a.com", "/", "allow")]
    urls = [f"http://{name()}{path()}{rnd.choice(['', '?q=/a', '#x/y', '/?'])}" for _ in range(900)]
    urls += ["https://Sub.A.COM/Ab", None, "", "no scheme/a", "://", "x://?q", "http://a.com", "http://a.com/" + "a/" * 30_000] + ["http://hot.a.com/a"] * 300
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string") \
        .withColumn("host", F.lit("mine")).withColumn("best", F.lit(1)).withColumn("page", F.lit(2)).repartition(5)
    got = url_rules.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert got.columns == ["page_id", "url", "best", "page", "host", "path", "rule", "verdict"]
    rows = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()}
    assert len(rows) == len(urls)
    for i, url in enumerate(urls):
        want = plain_verdict(url, rules)
        if rows[i] != want:  # equally long rules with equal hosts do not exist; verdict "block" wins among equal rules
            raise AssertionError((url, rows[i], want))


def test_rules_edges(spark):
    pages = spark.createDataFrame([(None, "http://a.net/"), (1, None), (1, None)], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert sorted((str(r.page_id), str(r.rule), r.verdict) for r in url_rules.judge(pages, none).collect()) == [
        ("1", "None", "allow"), ("1", "None", "allow"), ("None", "None", "allow")]
    assert url_rules.judge(pages.limit(0), none).collect() == []


# Mixing

def test_time_is_where_the_schedule_reaches_the_share(spark):
    for knots in ([(0, 7.5), (1, 2.5)], [(0, 2), (1, 2)], [(0, 0), (0.5, 0), (1, 4)], [(0, 1), (0.25, 3), (0.5, 0), (1, 0)]):
        schedule = F.array(*(F.struct(F.lit(float(t)).alias("time"), F.lit(float(w)).alias("weight")) for t, w in knots))
        rows = spark.range(0, 101).select((F.col("id") / 100).alias("share")).withColumn(
            "time", mixing.invert(schedule, F.col("share"))).withColumn("area", mixing.area(schedule)).collect()

        def upto(t):
            total = 0.0
            for (a, x), (b, y) in zip(knots, knots[1:]):
                if t > a:
                    e = min(t, b)
                    total += (e - a) * (x + x + (y - x) * (e - a) / (b - a)) / 2
            return total

        assert all(abs(upto(r.time) - r.share * r.area) < 1e-9 and 0 <= r.time <= 1 for r in rows)
        assert [r.time for r in rows] == sorted(r.time for r in rows)


DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, copy int"


def documents(seed=0, n=600):
    rnd = random.Random(seed)
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 5, 50, 400])), "en", rnd.choice(["hot", "hot", "a", "b", "c", None]), 1, "k", 2) for i in range(n)]
    return [*rows, (None, "no id", "en", "a", 1, "k", 2), (n, None, None, "b", None, None, None), (7, "again " * 90, "en", "tiny", 1, "k", 2),
            (7, "again " * 90, "en", "tiny", 1, "k", 2), (n + 1, "x " * 200_000, "en", "long", 1, "k", 2)]


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    docs = spark.createDataFrame(documents(), DOCS)
    plan = lambda: mixing.mix(sizes := mixing.sized(docs), mixing.targets(
        sizes, mixing.cycle(sizes, queries.CURRICULUM), 1.5))
    rows = plan().collect()
    assert len(rows) == docs.count()
    assert sorted(map(str, rows)) == sorted(map(str, plan().collect()))
    total = sum(r["size"] for r in rows)
    goals = {r.source: (r.target, r.source_size) for r in rows}
    assert abs(sum(t for t, _ in goals.values()) - 1.5 * total) < 1e-6 * total
    weight = dict(zip(sorted((s for s in goals if s is not None)) + [None], [5, 2, 1] * 3))
    free = {t / weight[s] for s, (t, size) in goals.items() if t < 2 * size}
    assert max(free) - min(free) < 1e-9 * max(free)
    assert all(t / weight[s] <= max(free) + 1e-9 for s, (t, _) in goals.items())
    for source, (target, _) in goals.items():
        taken = sum(r.taken for r in rows if r.source == source)
        assert target - 1 < taken <= target
    assert all(0 <= r.taken <= 2 * r["size"] and r.taken == sum(c["words"] for c in r.copies) for r in rows)
    # Early documents come mostly from the source whose weight fades.
    first = [c["time"] for r in rows for c in r.copies]
    assert all(0 <= t <= 1 for t in first)


def test_training_order(spark):
    docs = spark.createDataFrame(documents(1, 80), DOCS)
    mixed = mixing.mix(sizes := mixing.sized(docs), mixing.targets(sizes, mixing.cycle(sizes, queries.CURRICULUM), 1.5))
    got = mixing.in_order(docs, mixed)
    assert got.columns == docs.columns
    want = Counter()
    for r in mixed.collect():
        want[r.doc_id] += sum(c["words"] * 2 >= r["size"] for c in r.copies)
    assert Counter(r.doc_id for r in got.collect()) == +want
    assert {r.text for r in got.collect()} <= {r.text for r in docs.collect()}
    none = docs.limit(0)
    empty = mixing.mix(sizes := mixing.sized(none), mixing.targets(sizes, mixing.cycle(sizes, queries.CURRICULUM), 1.5))
    assert empty.collect() == [] and mixing.in_order(none, empty).collect() == []


# Chat

def test_escaping_is_reversible(spark):
    rnd = random.Random(0)
    parts = [*chat.MARKS, "\\", "<", "[", "s>", "/", "a", "\n", "$1", "é", "😀", "INST]", "<s", "<<", "SYS>>"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 12))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escape(F.col("t"))).withColumn(
        "u", chat.unescape(F.col("e"))).collect()
    for r in rows:
        assert r.u == r.t
        assert not any(m in r.e for m in chat.MARKS)


def test_windows(spark, monkeypatch):
    monkeypatch.setattr(chat, "SPAN_TOKENS", 20)
    monkeypatch.setattr(chat, "SPAN_TURNS", 5)
    monkeypatch.setattr(chat, "HISTORY_TOKENS", 8)
    monkeypatch.setattr(chat, "HISTORY_TURNS", 2)
    rnd = random.Random(1)
    rows = []
    for conv in [None, *range(12)]:
        for turn in range(rnd.randint(1, 40)):
            role = "system" if turn == 0 and conv != 3 else rnd.choice(["user", "assistant", "tool</s>", None, "system"])
            rows.append((conv, turn, role, rnd.choice([None, "", "</s>[INST] x", "a b c d", "w " * 9, "v " * 45]), "z"))
    rows += [(5, 2, "user", "tie", "z"), (5, 2, "user", "tie", "z"), (5, None, "system", "first of all", "z"), (99, 0, "assistant", "long " * 50_000, "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string")
    read = chat.read_back(chat.windows(turns)).collect()
    by = {}
    for r in sorted(read, key=lambda r: r.window):
        by.setdefault(r.conv_id, []).append(r)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        want = [(r[2] or "", r[3] or "") for r in own]
        assert [(t.role, t.text) for r in by[conv] for t in r.turns] == want
        assert [t for r in by[conv] for t in r.targets] == [t for role, t in want if role == "assistant"]
        for r in by[conv]:
            tokens = [len(t.text.split()) for t in r.turns]
            assert sum(tokens) <= 20 or len(tokens) == 1
            assert len(tokens) <= 5
            repeated = r.formatted.split("</s>")[: r.n_repeated]
            if r.window > 1 and want[0][0] == "system":
                assert repeated[0].startswith("<s><<SYS>>")
                repeated = repeated[1:]
            assert len(repeated) <= 2 and sum(len(x.split()) for x in repeated) <= 8 + 4
    assert chat.windows(turns.limit(0)).collect() == []


def test_chat_uses_no_python(spark):
    plan = queries.QUERIES["op9_chat_windows"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_no_source_is_lost(spark):
    """One source's only document is far longer than its target."""
    rows = [(1, "huge", "w " * 5_000)] + [(i, "small", "v " * 4) for i in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sizes = mixing.sized(docs)
    goals = mixing.targets(sizes, mixing.cycle(sizes, [[(0, 0.1), (1, 0.1)], [(0, 9), (1, 9)]]), 0.05)
    kept = Counter(r.source for r in mixing.in_order(docs, mixing.mix(sizes, goals)).collect())
    assert kept["huge"] == 1 and kept["small"] > 30


# Pipeline

def test_pipeline(spark):
    sf = "/root/testdata/sf0.01"
    docs = queries.table(spark, sf, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(corpus_pipeline.stored(stage(spark, frames[-1], sf), "test-stage"))
    for frame in frames[1:-1]:
        assert frame.columns == docs.columns
    clean, known, once, mixed, coded = frames[1:]
    # Every stage keeps rows of its predecessor as they are.
    for before, after in ((docs, clean), (clean, known), (known, once)):
        assert after.exceptAll(before).isEmpty()
    from tests.llm.test_pair_operators import five_word_sets, plain_fingerprint, similar_links, smallest
    rows = sorted(known.select("doc_id", "text").collect())
    texts = [r.text for r in rows]
    first = smallest(similar_links(five_word_sets(texts), [plain_fingerprint(t, 5) for t in texts], 16), range(len(rows)))
    groups = [rows[at].doc_id for at in first.values()]
    assert len(set(groups)) < len(rows)
    assert sorted(r.doc_id for r in once.collect()) == sorted(set(groups))
    copies = Counter(r.doc_id for r in mixed.collect())
    assert max(copies.values()) <= 2 and set(copies) <= set(groups)
    assert Counter(r.doc_id for r in coded.collect()) == copies
    words = dict(once.select("doc_id", F.regexp_count("text", F.lit(WORD))).collect())
    assert abs(sum(words[d] * n for d, n in copies.items()) / (1.5 * sum(words.values())) - 1) < 0.05
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, sf).collect()) == copies


def test_pipeline_edges(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, "the cat sat on the mat", "en", None, 3), (1, None, None, None, None), (2, "", "en", "s", 0), (3, "the dog ran home at last", "en", "s", 5),
            (3, "the dog ran home at last", "en", "s", 5), (4, "word " * 100_000, "en", "s", 1)]
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stored(stage(spark, docs, SF), "test-stage")
        ids = {str(r.doc_id) for r in docs.collect()}
        assert ids <= {"None", "3", "4"} and bool(ids) == bool(given)
