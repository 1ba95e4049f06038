"""From raw documents to token ids in five stages, each written and read again.

Every stage works on all rows that its predecessor kept.  All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import bpe, langid, mixing, queries, simhash, toxicity
from tidegate.llm.common import stored


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go: those whose expected severity is ``toxicity.REJECT`` or more."""
    grades = queries.grades(queries.table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, toxicity.fit(docs, grades))


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null, empty, or without a letter."""
    return langid.keep_known(docs, langid.fit(docs.select("doc_id", "text", "lang")))


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id.

    Near-duplicates share four fifths of their five-word shingles; their fingerprints differ in
    up to 16 bits.
    """
    return simhash.keep_one(docs, words=5, k=16, similarity=0.8)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of training.

    Texts stay whole: a copy of which the mix takes less than half is left out.
    """
    sizes = mixing.sized(docs)
    mixed = mixing.mix(sizes, mixing.targets(sizes, mixing.cycle(sizes, queries.CURRICULUM), queries.BUDGET))
    return mixing.in_order(docs, stored(mixed, "mix-copies"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, digests of the ids and of the text decoded from them."""
    found = bpe.encode(docs, queries.vocabulary(), decoded=True)
    return found.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity_filter),
    ("language ID", language_filter),
    ("SimHash near-dedup", near_duplicate_filter),
    ("mixing sources to target weights", mixture),
    ("BPE encoding and decoding", encoding),
]

# Learned filters and BPE cannot be written in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
