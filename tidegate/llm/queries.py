"""The registered queries ``opN_<name>`` and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from tidegate.llm import (
    ann, bpe, chat, embed_dedup, langid, lexical, merkle, mixing, packing, simhash, token_counts, toxicity, url_rules,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


# Where the public vocabularies are.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("byte_bpe_50k.json")

# Weights 5, 2 and 1 as areas: the first fades, the second is level, the third grows.
CURRICULUM = [[(0, 7.5), (1, 2.5)], [(0, 2), (1, 2)], [(0, 0.5), (1, 1.5)]]
BUDGET = 1.5


def vocabulary(path: str = VOCABULARY) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"),
             ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query("op2_url_rules", r"""
WITH cut AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
    SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1), '') AS path
    FROM cut
), rules(rule_host, rule_path, rule_verdict) AS (
    VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), judged AS (
    SELECT *, (SELECT {rule: rule_host || rule_path, verdict: rule_verdict} FROM rules
               WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
               ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC LIMIT 1) AS best
    FROM parts
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM judged
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four nested rules against the url of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


@query("op3_linear_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy word pieces of all documents, pieces from a public byte-level vocabulary."""
    return token_counts.counts(table(spark, sf_dir, "documents"), vocabulary(PIECES))


@query("op4_simhash_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles, links at four bits or fewer, over all documents."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, k=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op5_curriculum_mix", """
WITH RECURSIVE sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
    FROM documents
), src AS (
    SELECT source, sum(size)::BIGINT AS source_size, sum(size)::BIGINT * 2.0::DOUBLE AS lim,
           [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS weight
    FROM sized GROUP BY source
), total AS (SELECT sum(source_size) * 1.5::DOUBLE AS words FROM src
), rounds(step, rate, capped, done) AS (
    SELECT 0, 0.0::DOUBLE, -1::BIGINT, false
    UNION ALL
    SELECT r.step + 1,
        CASE WHEN x.n = r.capped OR x.weight = 0 THEN r.rate ELSE ((SELECT words FROM total) - x.fixed) / x.weight END,
        x.n, x.n = r.capped OR x.weight = 0
    FROM rounds r, LATERAL (
        SELECT count(*) FILTER (weight * r.rate > lim) AS n,
               coalesce(sum(CASE WHEN weight * r.rate > lim THEN lim ELSE 0 END), 0) AS fixed,
               coalesce(sum(CASE WHEN weight * r.rate > lim THEN 0 ELSE weight END), 0) AS weight FROM src) x
    WHERE NOT r.done
), goals AS (
    SELECT source, source_size, least(weight * (SELECT rate FROM rounds ORDER BY step DESC LIMIT 1), lim) AS target FROM src
), placed AS (
    SELECT s.doc_id, s.size, g.source_size, g.target, sum(s.size) OVER (
        PARTITION BY s.source ORDER BY md5(concat_ws('/', s.doc_id::VARCHAR, s.size::VARCHAR)), s.doc_id, s.size
        ROWS UNBOUNDED PRECEDING) - s.size AS ahead
    FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       (greatest(least(size, floor(target)::BIGINT - ahead), 0)
        + greatest(least(size, floor(target)::BIGINT - ahead - source_size), 0))::BIGINT AS taken
FROM placed
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights 5, 2, 1 in turn, 150 % of all words, each source along its curriculum."""
    sizes = mixing.sized(table(spark, sf_dir, "documents"))
    mixed = mixing.mix(sizes, mixing.targets(sizes, mixing.cycle(sizes, CURRICULUM), BUDGET))
    first = F.array_min(F.transform("copies", lambda c: c["time"]))
    return mixed.orderBy(first.asc_nulls_last(), "draw", "doc_id").select(
        "doc_id", "size", "source_size", "target", "taken")


@query("op6_cross_parsing_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from the documents that are not held out, predict the language of all."""
    documents = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.fit(documents.where(~held_out).select("doc_id", "text", "lang"))
    found = langid.predict(documents, model)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op7_bpe_trie_round_trip")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode all documents; digests of ids and of the decoded text."""
    found = bpe.encode(table(spark, sf_dir, "documents"), vocabulary(), decoded=True)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


# The template's own strings in both turns of an extra conversation.
CONTROL = "</s>[INST] ok [/INST]"


@query("op9_chat_windows", r"""
WITH given AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized AS (
    SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS tokens,
        length(replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'),
            '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'),
            '<<SYS>>', '<\<SYS>>'), '<</SYS>>', '<\</SYS>>'), '[ROLE]', '[\ROLE]'), '[/ROLE]', '[\/ROLE]'))
        + CASE role WHEN 'user' THEN 20 WHEN 'system' THEN 22 WHEN 'assistant' THEN 7 ELSE 20 + length(role) END AS chars
    FROM given
), placed AS (
    SELECT *, row_number() OVER o AS nr, sum(tokens) OVER o - tokens AS start
    FROM sized WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
), cells AS (
    SELECT *, start // 512 AS a, greatest(start, start + tokens - 1) // 512 AS b, (nr - 1) // 64 AS c FROM placed
), heads AS (
    SELECT *, coalesce(lag(a) OVER o <> a OR lag(b) OVER o <> b OR lag(c) OVER o <> c, true) AS head,
        first(role = 'system') OVER o AS led, first(chars) OVER o AS led_chars
    FROM cells WINDOW o AS (PARTITION BY conv_id ORDER BY nr)
), repeated AS (
    SELECT h.conv_id, h.nr, CASE WHEN h.led AND h.nr > 1 THEN h.led_chars ELSE 0 END
        + coalesce((SELECT sum(p.chars) FROM heads p WHERE p.conv_id IS NOT DISTINCT FROM h.conv_id
            AND p.nr BETWEEN h.nr - 4 AND h.nr - 1 AND p.start >= h.start - 128 AND NOT (h.led AND p.nr = 1)), 0) AS chars
    FROM heads h WHERE h.head
), extra AS (SELECT conv_id, sum(chars) AS chars FROM repeated GROUP BY conv_id
), whole AS (
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nr)) AS turns_sha256,
        coalesce(string_agg(text, '' ORDER BY nr) FILTER (role = 'assistant'), '') AS loss, sum(chars) AS chars
    FROM heads GROUP BY conv_id
)
SELECT w.conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
    (w.chars + e.chars)::BIGINT AS formatted_chars
FROM whole w JOIN extra e ON w.conv_id IS NOT DISTINCT FROM e.conv_id
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that consists of control strings, read back from the windows."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{CONTROL}'), (-7L, 1L, 'assistant', '{CONTROL}')")
    read = chat.read_back(chat.windows(turns.unionAll(extra.toDF("conv_id", "turn", "role", "text"))))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    whole = read.groupBy("conv_id").agg(
        F.sum(F.size("turns")).alias("n_turns"), F.sum(F.length("formatted")).alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct(
            "window", lines.alias("turns"), F.array_join("targets", "").alias("targets")))).alias("parts"))
    joined = lambda field: F.array_join(F.transform("parts", lambda p: p[field]), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(joined("turns"), 256).alias("turns_sha256"),
        F.length(joined("targets")).cast("long").alias("loss_chars"), F.sha2(joined("targets"), 256).alias("loss_sha256"),
        "formatted_chars")


def grades(labels: DataFrame) -> DataFrame:
    """Severity: 0 not toxic, 1 toxic, 2 toxic and of low quality."""
    return labels.select("doc_id", F.when(F.col("toxic") == 0, 0).when(
        F.col("toxic") == 1, F.when(F.col("quality") == 0, 2).otherwise(1)).alias("grade"))


@query("op10_ordinal_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on the labelled documents, expected severity of all documents."""
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, grades(table(spark, sf_dir, "labels")))
    return toxicity.severity(documents, model).select(
        "doc_id", "severity", (F.col("severity") >= toxicity.REJECT).alias("toxic"))


@query("op1_embedding_near_dedup", """
WITH RECURSIVE given AS (
    SELECT vec_id, embedding::DOUBLE[] AS e, coalesce(len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS usable FROM embeddings
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM given a JOIN given b ON a.usable AND b.usable AND len(a.e) = len(b.e)
        AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach(a, b) AS (
    SELECT vec_id, vec_id FROM given UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT g.vec_id, coalesce(c.n, 0) AS n_links, r.component_id, g.vec_id = r.component_id AS kept
FROM given g LEFT JOIN counts c ON c.a = g.vec_id
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = g.vec_id
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at a cosine of 0.95 or more between all vectors."""
    found = embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


@query("op8_kmeans_tree_search")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest of all vectors for each whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 50 = 0"), k=5)


@query("op11_bounded_space_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 ids, each followed by id 1."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary(), end_id=1, window=2048, with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op12_pipelined_lexical_search", r"""
WITH terms AS (
    SELECT row_nr, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
    FROM (SELECT row_number() OVER () AS row_nr, doc_id, text FROM documents)
), sized AS (SELECT row_nr, doc_id, len(t)::BIGINT AS n FROM terms WHERE len(t) > 0
), total AS (SELECT count(*)::BIGINT AS n_docs, coalesce(sum(n), 0)::BIGINT AS n_terms FROM sized
), tf AS (SELECT row_nr, term, count(*)::BIGINT AS tf FROM (SELECT row_nr, unnest(t) AS term FROM terms) GROUP BY row_nr, term
), weights AS (
    SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
    FROM tf, total GROUP BY term, n_docs
), wanted AS (
    SELECT item_id, item_nr, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS item_nr, item_id, text FROM benchmark)
), scores AS (
    SELECT item_id, item_nr, doc_id, row_nr,
        sum(w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM wanted JOIN weights USING (term) JOIN tf USING (term) JOIN sized USING (row_nr), total GROUP BY ALL
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item_nr ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
    FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for each benchmark item."""
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


@query("op13_merkle_manifest", r"""
WITH RECURSIVE given AS (
    SELECT *, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
        lambda crc, c: list_reduce([xor(crc, c), 0, 0, 0, 0, 0, 0, 0, 0],
            lambda a, z: xor(a >> 1, 3988292384::BIGINT * (a & 1)))) AS crc
    FROM documents
), framed AS (
    SELECT doc_id, source, text, coalesce(xor(crc, 4294967295) % 2 = 0, false) AS tampered,
        coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-')
        || coalesce(octet_length(encode(source)) || ':' || source, '-')
        || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
        || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head,
        replace(text, chr(10), '') AS cut
    FROM given
), leaves AS (
    SELECT doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
        CASE WHEN tampered THEN sha256(head || coalesce(octet_length(encode(cut)) || ':' || cut, '-'))
             ELSE sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) END AS shown
    FROM framed
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank,
        count(*) OVER (PARTITION BY source) AS size
    FROM leaves
), levels(lvl, source, rank, size, digest) AS (
    SELECT 0, source, rank, size, leaf FROM ranked
    UNION ALL
    SELECT lvl + 1, source, rank // 3, (size + 2) // 3, sha256(string_agg(digest, '' ORDER BY rank))
    FROM levels WHERE size > 1 GROUP BY lvl, source, rank // 3, size
), subroots AS (
    SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS rank, count(*) OVER () AS size
    FROM levels WHERE size = 1
), tops(lvl, rank, size, digest) AS (
    SELECT 0, rank, size, subroot FROM subroots
    UNION ALL
    SELECT lvl + 1, rank // 3, (size + 2) // 3, sha256(string_agg(digest, '' ORDER BY rank))
    FROM tops WHERE size > 1 GROUP BY lvl, rank // 3, size
), siblings AS (
    SELECT l.source, l.rank AS pos, s.lvl AS step, s.rank > (l.rank // (3 ** s.lvl)::BIGINT) AS after, s.rank, s.digest
    FROM ranked l JOIN levels s ON l.source IS NOT DISTINCT FROM s.source AND s.size > 1
        AND s.rank // 3 = l.rank // (3 ** (s.lvl + 1))::BIGINT AND s.rank <> l.rank // (3 ** s.lvl)::BIGINT
    UNION ALL
    SELECT l.source, l.rank, 1000 + s.lvl, s.rank > r.rank // (3 ** s.lvl)::BIGINT, s.rank, s.digest
    FROM ranked l JOIN subroots r ON l.source IS NOT DISTINCT FROM r.source JOIN tops s ON s.size > 1
        AND s.rank // 3 = r.rank // (3 ** (s.lvl + 1))::BIGINT AND s.rank <> r.rank // (3 ** s.lvl)::BIGINT
), steps AS (
    SELECT l.source, l.rank AS pos, row_number() OVER (PARTITION BY l.source, l.rank ORDER BY n.step) AS nr, n.step
    FROM ranked l JOIN (
        SELECT DISTINCT source, lvl AS step FROM levels WHERE size > 1
        UNION ALL SELECT s.source, 1000 + t.lvl FROM subroots s JOIN (SELECT DISTINCT lvl FROM tops WHERE size > 1) t ON true
    ) n ON l.source IS NOT DISTINCT FROM n.source
), paths AS (
    SELECT t.source, t.pos, t.nr, coalesce(string_agg(s.digest, '' ORDER BY s.rank) FILTER (NOT s.after), '') AS l,
        coalesce(string_agg(s.digest, '' ORDER BY s.rank) FILTER (s.after), '') AS r
    FROM steps t LEFT JOIN siblings s ON t.source IS NOT DISTINCT FROM s.source AND t.pos = s.pos AND t.step = s.step
    GROUP BY t.source, t.pos, t.nr
), folds(source, pos, nr, digest) AS (
    SELECT source, rank, 0::BIGINT, shown FROM ranked
    UNION ALL
    SELECT f.source, f.pos, p.nr, sha256(p.l || f.digest || p.r)
    FROM folds f JOIN paths p ON f.source IS NOT DISTINCT FROM p.source AND f.pos = p.pos AND p.nr = f.nr + 1
), ends AS (SELECT source, pos, arg_max(digest, nr) AS folded_root FROM folds GROUP BY source, pos
), proofs AS (SELECT source, pos, string_agg(l || r, '' ORDER BY nr) AS proof FROM paths GROUP BY source, pos
), root AS (SELECT digest AS root FROM tops WHERE size = 1)
SELECT k.doc_id, k.leaf, s.subroot, root.root, sha256(coalesce(p.proof, '')) AS proof_sha256, e.folded_root,
    e.folded_root = root.root AS verified
FROM ranked k JOIN subroots s ON k.source IS NOT DISTINCT FROM s.source
JOIN ends e ON k.source IS NOT DISTINCT FROM e.source AND k.rank = e.pos
LEFT JOIN proofs p ON k.source IS NOT DISTINCT FROM p.source AND k.rank = p.pos, root
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of all documents; every second one, by its id's checksum, is shown without its line ends."""
    text = F.col("text")
    fields = lambda body: merkle.leaf(*map(F.col, ("doc_id", "source", "lang", "n_chars")), body)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    rows = table(spark, sf_dir, "documents").select(
        F.col("source").alias("tree"), F.col("doc_id").alias("id"), fields(text).alias("leaf"),
        F.when(tampered, fields(F.replace(text, F.lit("\n"), F.lit("")))).otherwise(fields(text)).alias("shown"))
    return merkle.proofs(rows, paths=False).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
