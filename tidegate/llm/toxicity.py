"""Toxicity as a cumulative-link (proportional odds) regression on the words of a text.

P(grade >= k) = sigmoid(w x - theta_k): one weight per word, shared by all thresholds, which
are kept in order.  The severity of a text is the expected grade, the sum of those chances.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import portions, resident, stored

_WORDS = re.compile(r"[^\W\d_]+").findall
# Beginnings of words that are features beside whole words: insults come with many endings.
PREFIXES = (4, 5, 7)
# A feature says of a term: it occurs; it occurs twice; twice and in this share of the words.
LEVELS = 3
DENSE = 0.005
# Expected grade from which a text counts as toxic.
REJECT = 0.35
# Words whose terms a Python worker remembers.
_REMEMBERED = 100_000


def terms(word: str) -> list[str]:
    """The word and its beginnings, marked by a star."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)]


class _Known(dict):
    """The numbers of a word's terms that are features."""

    def __init__(self, number: dict[str, int]):
        super().__init__()
        self.number = number

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= _REMEMBERED:
            self.clear()
        found = self[word] = tuple(self.number[t] for t in terms(word) if t in self.number)
        return found


def features(text: str | None, known: _Known) -> list[int]:
    """The features that a whole text has."""
    words = _WORDS(text.lower()) if text else []
    counts = Counter(t for w in words if (found := known[w]) for t in found)
    return [
        t * LEVELS + level for t, n in sorted(counts.items())
        for level in range(1 if n < 2 else 3 if n >= DENSE * len(words) else 2)
    ]


@dataclass(frozen=True)
class OrdinalModel:
    """The terms, ``LEVELS`` weights for each, and the thresholds between the grades."""

    terms: tuple[str, ...]
    weights: tuple[float, ...]
    thresholds: tuple[float, ...]

    def severity(self, text: str | None) -> float:
        score = sum(self.weights[f] for f in features(text, resident(_known, self.terms)))
        return sum(_sigmoid(score - t) for t in self.thresholds)


def _known(chosen: tuple[str, ...]) -> _Known:
    return _Known({t: i for i, t in enumerate(chosen)})


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(x / 2))


def _terms(docs: DataFrame) -> DataFrame:
    """``grade`` and the different ``terms`` of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 128):
            found = [sorted({t for w in set(_WORDS(x.lower())) for t in terms(w)}) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.string()))], ["grade", "terms"])

    return docs.select("grade", "text").mapInArrow(run, "grade int, terms array<string>")


def _features(docs: DataFrame, chosen: tuple[str, ...]) -> DataFrame:
    """``grade`` and ``features`` of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = resident(_known, chosen)
        for batch in portions(batches, 128):
            found = [features(t, known) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["grade", "features"])

    return docs.select("grade", "text").mapInArrow(run, "grade int, features array<int>")


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_features: int, l2: float = 0.03,
                steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of the likelihood of ``grades``, given the features that
    each row has.  Grades are 0..K-1 and each occurs."""
    k = int(grades.max())
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    cols = np.concatenate(rows) if len(at) else np.empty(0, np.int64)
    share = np.array([(grades >= g).mean() for g in range(1, k + 1)])
    first = np.log((1 - share) / share)
    # theta_1 is free, the gaps to the next ones are exponentials.
    x = np.concatenate([np.zeros(n_features), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    mean, square = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        w, gaps = x[:n_features], np.exp(x[n_features + 1:])
        theta = x[n_features] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(at, weights=w[cols], minlength=len(rows))
        upper = np.where(grades == 0, 1.0, _sigmoid(score - theta[np.maximum(grades - 1, 0)]))
        lower = np.where(grades == k, 0.0, _sigmoid(score - theta[np.minimum(grades, k - 1)]))
        likely = np.maximum(upper - lower, 1e-12)
        d_up, d_low = upper * (1 - upper) / likely, lower * (1 - lower) / likely
        d_theta = np.zeros(k)
        np.add.at(d_theta, np.maximum(grades - 1, 0), np.where(grades > 0, d_up, 0.0))
        np.add.at(d_theta, np.minimum(grades, k - 1), np.where(grades < k, -d_low, 0.0))
        tail = np.cumsum(d_theta[::-1])[::-1]
        gradient = np.concatenate([
            -np.bincount(cols, weights=(d_up - d_low)[at], minlength=n_features) + l2 * w,
            tail[:1], tail[1:] * gaps])
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient ** 2
        x -= 0.1 * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)
    gaps = np.exp(x[n_features + 1:])
    return x[:n_features], x[n_features] + np.concatenate([[0.0], np.cumsum(gaps)])


def fit(docs: DataFrame, grades: DataFrame, fit_rows: int = 16_000, max_terms: int = 1_500) -> OrdinalModel:
    """Fit on the labelled documents.

    ``docs`` has ``doc_id`` and ``text``, ``grades`` has ``doc_id`` and ``grade`` (0: clean).  At
    most ``fit_rows`` labels are used, those with the smallest hash of their id; rows with a
    null id, text or grade teach nothing, and equal texts count once, with the highest grade.
    A term becomes a feature if it sets the graded texts apart more than the strongest of as
    many random terms would (log likelihood ratio above the logarithm of their number; the 20
    best where fewer are), at most ``max_terms``.  Grades that do not occur share the threshold
    of the next one.  Without two different grades the model has none, and every severity is 0.
    """
    sample = (
        grades.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id")
        .agg(F.max("grade").cast("int").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    )
    # At most fit_rows rows of two numbers: a proven bound.
    taught = stored(
        docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(sample), "doc_id")
        .groupBy("text").agg(F.max("grade").alias("grade")), "toxicity-sample")
    totals = dict(taught.groupBy("grade").count().collect())
    n, n1 = sum(totals.values()), sum(c for g, c in totals.items() if g > 0)
    if len(totals) < 2 or not 0 < n1 < n:
        return OrdinalModel((), (), ())
    base = n1 / n
    d1, d = F.col("d1"), F.col("d")
    ratio = d1 * F.log(d1 / (d * base)) + F.when(d > d1, (d - d1) * F.log((d - d1) / (d * (1 - base)))).otherwise(0.0)
    counted = stored(
        _terms(taught).select("grade", F.explode("terms").alias("term")).groupBy("term")
        .agg(F.count("*").cast("double").alias("d"), F.count_if(F.col("grade") > 0).cast("double").alias("d1"))
        .where("d >= 3"), "toxicity-terms")
    top = counted.where((d1 >= 3) & (d1 > d * base)).select("term", ratio.alias("ratio")).orderBy(
        F.desc("ratio"), "term").limit(max_terms).collect()
    bar = math.log(max(counted.count(), 2))
    chosen = tuple(r.term for i, r in enumerate(top) if r.ratio >= bar or i < 20)
    rows = _features(taught, chosen).collect()
    present = sorted({r.grade for r in rows})
    y = np.array([present.index(r.grade) for r in rows])
    weights, theta = fit_ordinal([np.array(r.features, np.int64) for r in rows], y, len(chosen) * LEVELS)
    thresholds = tuple(float(theta[sum(p < g for p in present) - 1]) for g in range(1, present[-1] + 1))
    return OrdinalModel(chosen, tuple(map(float, weights)), thresholds)


def severity(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """``doc_id`` and ``severity`` (expected grade) of every row; a null or empty text has that of
    a text without any of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 128):
            found = [model.severity(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "severity"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, severity double")


def keep_clean(docs: DataFrame, model: OrdinalModel, limit: float = REJECT) -> DataFrame:
    """The rows of ``docs`` whose severity is below ``limit``, with all their columns."""
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 128):
            yield batch.filter(pa.array([model.severity(t.as_py()) < limit for t in batch.column(text)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
