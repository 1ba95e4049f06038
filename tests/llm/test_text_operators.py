"""Language ID, toxicity, BPE and token counts against brute force, and their edge cases."""

import json
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidegate.llm import bpe, langid, queries, token_counts, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, severity string, ids long"
LONG = "The quick brown fox jumps over the lazy dog. " * 40_000
EDGES = [
    (1, None, "en", "s", 0, "x", 1), (2, "", "en", "s", 0, "x", 1), (3, "  \n\t ", None, None, None, None, None),
    (4, "12 !? 34", "en", "s", 1, "x", 1), (5, LONG, "en", "s", 1, "x", 1), (6, "same text", "en", "s", 1, "x", 1),
    (6, "same text", "en", "s", 1, "x", 1), (None, "no id here", "en", "s", 1, "x", 1),
]


@pytest.fixture(scope="module")
def spec():
    return queries.vocabulary()


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# BPE

POOL = ["abcdefghijklmnopqrstuvwxyz", "aaab ", "éèñß ÀÉ Σσς İı ﬁ", "\x1c\x1d\x85\xa0 　​", "漢字かなカナ한국어",
        "😀👍🏽̣́å", "0123456789²½Ⅷ", "'s't're've'll'd'M'S", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>",
        "!?.,;:-_/()[]{}@#$%^&*+=~`|\\\"", "\n\t\r\x00\x0b\x0c", "\U00010400İẞΣ"]


def test_bpe_is_what_the_library_gives(spec):
    library, own = Tokenizer.from_str(spec), bpe.WordBPE(spec)
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(POOL) if rnd.random() < .05 else rnd.choice(rnd.choice(POOL))
                     for _ in range(rnd.randint(0, 60))) for _ in range(4000)]
    texts += [" ".join(texts[:2000]) + " x" * 900_000, "a" * 3000, "ab" * 2000, "thethethe" * 300, " ".join(["internationalization"] * 50)]
    for text, ids in zip(texts, own.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_bpe_forgets_and_learns_again(spec, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNKS", 50)
    monkeypatch.setattr(bpe, "WORDS", 30)
    monkeypatch.setattr(bpe, "_TRIE_CHARS", 100)
    own, library = bpe.WordBPE(spec), Tokenizer.from_str(spec)
    texts = [" ".join(f"word{i * j % 97}x{i}" for j in range(20)) for i in range(40)]
    assert own.encode(texts) == [
        np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_bpe_without_special_tokens(spec):
    given = json.loads(spec)
    given["added_tokens"] = []
    text = json.dumps(given)
    library, own = Tokenizer.from_str(text), bpe.WordBPE(text)
    for words in ("", "two words", "<|endoftext|> Größe, 12!"):
        ids = library.encode(words, add_special_tokens=False).ids
        assert np.frombuffer(own.encode([words])[0], "<u4").tolist() == ids


@pytest.mark.parametrize("change", [
    {"decoder": {"type": "BPEDecoder", "suffix": "</w>"}},
    {"post_processor": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}},
    {"added_tokens": [{"id": 49407, "content": "<|endoftext|>", "single_word": False, "lstrip": True,
                       "rstrip": False, "normalized": False, "special": True}]},
])
def test_bpe_refuses_what_it_does_not_follow(spec, change):
    with pytest.raises(ValueError, match="not supported"):
        bpe.WordBPE(json.dumps({**json.loads(spec), **change}))


def test_bpe_query(spark, spec):
    import hashlib
    library = Tokenizer.from_str(spec)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op7_bpe_trie_round_trip"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_edges(edges, empty, spec):
    encoded = bpe.encode(edges, spec, decoded=True)
    rows = encoded.collect()
    assert len(rows) == len(EDGES)
    assert all(r.n_tokens == 0 and r.decoded == "" for r in rows if r.doc_id in (1, 2, 3))
    assert sum(r.doc_id == 6 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    assert [r.n_tokens for r in rows if r.doc_id == 5] == [40_000 * 10]
    back = {r.doc_id: r.text for r in bpe.decode(encoded, spec).collect()}
    assert back[1] == "" and back[6] == "same</w> text</w>"
    assert bpe.encode(empty, spec).collect() == []


# Token counts

def greedy(word, begin, inner):
    n, at, pieces = 0, 0, begin
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 0
        n, at, pieces = n + 1, end, inner
    return n


def test_counts_are_those_of_greedy_pieces():
    rnd = random.Random(3)
    for _ in range(200):
        make = lambda k, size: {bytes(rnd.choices(b"abc", k=rnd.randint(1, size))) for _ in range(k)}
        begin, inner = make(rnd.randint(0, 8), 5), make(rnd.randint(0, 8), 5)
        counter = token_counts.PieceCounter(begin, inner)
        for _ in range(60):
            word = bytes(rnd.choices(b"abcd", [5, 5, 5, 1], k=rnd.randint(1, 14)))
            assert counter.count(word) == greedy(word, begin, inner), (begin, inner, word)


def test_count_query(spark):
    begin, inner = map(set, token_counts.byte_level_pieces(queries.vocabulary(queries.PIECES)))
    for r in (spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
              .join(queries.QUERIES["op3_linear_token_counts"](spark, SF), "doc_id").collect()):
        found = [greedy(w, begin, inner) for w in (r.text or "").encode().split()]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(found), sum(found) + found.count(0), found.count(0))


def test_count_edges(edges, empty):
    spec = queries.vocabulary(queries.PIECES)
    rows = token_counts.counts(edges, spec).collect()
    assert len(rows) == len(EDGES)
    assert all(r.n_words == r.n_tokens == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert [r.n_words for r in rows if r.doc_id == 5] == [40_000 * 9]
    assert token_counts.counts(empty, spec).collect() == []


# Language ID

def test_automaton_knows_exactly_the_substrings():
    rnd = random.Random(1)
    for _ in range(50):
        text = rnd.choices([3, 4, 5], k=rnd.randint(0, 12))
        ways = langid.suffix_automaton(text)
        parts = {tuple(text[i:j]) for i in range(len(text)) for j in range(i, len(text) + 1)} | {()}
        for n in range(6):
            for _ in range(20):
                word, state = rnd.choices([3, 4, 5], k=n), 0
                for c in word:
                    state = ways[state].get(c) if state is not None else None
                assert (state is not None) == (tuple(word) in parts)


def test_phrases_are_the_longest_matches(monkeypatch):
    monkeypatch.setattr(langid, "PIECE", 7)
    model = langid.LanguageModel((("a", "abra kadabra, abra"), ("b", "simsalabim bam ba")))
    rnd = random.Random(2)
    texts = ["".join(rnd.choices("abrkdsim lzé,", k=rnd.randint(0, 40))) for _ in range(100)]
    got, sizes = langid.phrases(texts, model.tables)
    for text, counts, size in zip(texts, got, sizes):
        symbols = langid.symbols_of([text], model.tables.symbol)[0].tolist()
        assert len(symbols) == size
        for (_, sample), count in zip(model.samples, counts):
            own = langid.symbols_of([sample], model.tables.symbol)[0].tolist()
            known = {tuple(own[i:j]) for i in range(len(own)) for j in range(i + 1, len(own) + 1)}
            want = 0
            for at in range(0, len(symbols), 7):
                piece, i = symbols[at: at + 7], 0
                while i < len(piece):
                    # The longest match; a symbol that the sample lacks is a phrase alone.
                    n = 1
                    while i + n < len(piece) and tuple(piece[i: i + n + 1]) in known:
                        n += 1
                    want, i = want + 1, i + n
            assert count == want


@pytest.mark.parametrize("letters", [250, 251, 600, 4_000, 20_000])
def test_every_letter_of_the_samples_counts(letters):
    """Beyond a byte's reach letters are spelled, each in its own way."""
    chars = [chr(c) for c in range(0x110000) if chr(c).isalpha() and chr(c).lower() == chr(c)][:letters]
    rnd = random.Random(4)
    first, second = chars[::2], chars[1::2]
    model = langid.LanguageModel((("a", "".join(first)), ("b", "".join(second))))
    spelt = langid.symbols_of(chars, model.tables.symbol, model.tables.spelled)
    words = np.split(spelt[0], np.cumsum(spelt[1])[:-1])
    assert len({tuple(w.tolist()) for w in words}) == letters and spelt[0].min() > langid.OTHER
    assert (spelt[1] == 1).all() == (letters <= langid.LETTER_SYMBOLS)
    # Runs of either sample are known to that language alone.
    texts = [" ".join("".join(own[i: i + 8]) for i in rnd.choices(range(len(own) - 8), k=5)) for own in (first, second)]
    assert [x for x, _ in langid.classify(texts, model)] == ["a", "b"]
    together = langid.symbols_of(["".join(chars[:50]) + " - " + chars[-1]], model.tables.symbol, model.tables.spelled)[0]
    apart = [langid.symbols_of([c], model.tables.symbol, model.tables.spelled)[0] for c in [*chars[:50], " ", chars[-1]]]
    assert together.tolist() == np.concatenate(apart).tolist()


def test_long_texts_are_parsed_whole(monkeypatch):
    model = langid.LanguageModel((("a", "abra kadabra, abra"), ("b", "simsalabim bam ba")))
    text = "abra ka " * 100 + "simsalabim " * 400
    whole = langid.classify([text, "abra"], model)
    monkeypatch.setattr(langid, "_STEP_SYMBOLS", 512)
    cut = langid.classify([text, "abra"], model)
    assert [x for x, _ in cut] == [x for x, _ in whole] == ["b", "a"] and abs(cut[0][1] - whole[0][1]) < 0.02


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in queries.QUERIES["op6_cross_parsing_language_id"](spark, sf).collect()]
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(langs) and 200 < len(held) < 300
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark, edges, empty):
    model = langid.fit(spark.createDataFrame(
        [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "de"), (4, "x", None), (5, "123", "xx")],
        "doc_id long, text string, lang string"))
    assert [lang for lang, _ in model.samples] == ["en", "fr"]
    rows = langid.predict(edges, model).collect()
    assert len(rows) == len(EDGES)
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (1, 2, 3, 4))
    assert [r.lang_pred for r in rows if r.doc_id == 5] == ["en"]
    kept = langid.keep_known(edges, model)
    assert kept.columns == edges.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["5", "6", "6", "None"]
    nothing = langid.fit(empty.select("doc_id", "text", "lang"))
    assert {r.lang_pred for r in langid.predict(edges, nothing).collect()} == {"und"}
    assert langid.predict(empty, model).collect() == []


# Toxicity

def test_ordinal_fit_orders_thresholds_and_grades():
    rnd = np.random.default_rng(0)
    rows = [np.flatnonzero(rnd.random(6) < 0.4) for _ in range(3000)]
    score = np.array([3.0 * (0 in r) + 1.5 * (1 in r) for r in rows]) + rnd.logistic(size=len(rows))
    y = (score > 1).astype(int) + (score > 3)
    w, theta = toxicity.fit_ordinal(rows, y, 6)
    assert theta[0] < theta[1] and abs(theta[0] - 1) < 0.3 and abs(theta[1] - 3) < 0.4
    assert abs(w[0] - 3) < 0.5 and abs(w[1] - 1.5) < 0.4 and np.abs(w[2:]).max() < 0.3


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    odd = F.crc32(F.col("doc_id").cast("string")) % 2 == 1
    model = toxicity.fit(docs, queries.grades(labels.where(~odd)))
    # Labels of junk are noise here; judged are texts of good quality.
    rows = toxicity.severity(docs, model).join(labels.where(odd & (F.col("quality") == 1)), "doc_id").collect()
    toxic = [r for r in rows if r.toxic]
    clean = [r for r in rows if not r.toxic]
    assert sum(r.severity >= toxicity.REJECT for r in toxic) >= 0.85 * len(toxic)
    assert sum(r.severity < toxicity.REJECT for r in clean) >= 0.995 * len(clean)


def test_toxicity_edges(spark, edges, empty):
    bad = [(i, f"you are a stupid idiot number {i}", 1) for i in range(40)]
    good = [(100 + i, f"this is a fine day number {i}", 0) for i in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in bad + good] + [(None, "stupid"), (500, None)], "doc_id long, text string")
    grades = spark.createDataFrame(
        [(i, g) for i, _, g in bad + good] + [(None, 1), (500, 1), (1, None), (999, 1)], "doc_id long, grade int")
    model = toxicity.fit(docs, grades)
    assert model.severity("What a STUPID idiot, stupid!") > 0.5 > model.severity("a fine day")
    rows = toxicity.severity(edges, model).collect()
    assert len(rows) == len(EDGES) and all(r.severity < toxicity.REJECT for r in rows)
    kept = toxicity.keep_clean(edges, model)
    assert kept.columns == edges.columns and kept.count() == len(EDGES)
    for none in (grades.limit(0), grades.where("grade = 0")):
        assert toxicity.fit(docs, none).severity("stupid idiot") == 0
    assert toxicity.severity(empty, model).collect() == []
