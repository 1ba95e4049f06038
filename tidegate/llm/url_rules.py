"""URL filter rules by a sort-merge range join.

A host is written from its last label to its first.  So the urls under a rule are those whose
key begins with the rule's key, which is an interval in sorted order, and intervals nest: one
sweep over urls and rules sorted together needs no more than a stack of the rules around it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import packed
from tidegate.session import cut_lineage

ALLOW, BLOCK = "allow", "block"
# Ends the host in a key.
_END = "\x01"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*(/[^?#]*)", 1), F.lit(""))


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def _key(labels: Column, path_: Column) -> Column:
    """The labels from the last to the first, each with its dot, and the path."""
    return F.concat(F.array_join(F.reverse(labels), "."), F.lit("." + _END), path_)


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """All rows and columns of ``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict``.  A rule fits its host and all subdomains where
    the url's path begins with the rule's; the one with the most characters wins, of equally
    long ones that with the longer host, and of equal ones with different verdicts the one that
    blocks.  Urls without a rule, null and malformed ones too, are allowed and their ``rule`` is
    null.  Rules with a null field or an empty host fit nothing.  Columns of ``pages`` with the new
    names are replaced.

    Different (host, path) pairs are judged once.  A url takes part with its host and those
    parent hosts that have no more labels than a rule.  Keys are sorted by range, however many
    share a host; a partition's sweep begins with the rules that are prefixes of its first key.
    """
    url = F.col(f"page.{url_col}")
    table = packed(pages, "page").select("page", host(url).alias("host"), path(url).alias("path"))
    known = (
        rules.where("host <> '' AND path IS NOT NULL AND verdict IS NOT NULL")
        .select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict")
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
        .withColumn("labels", F.split("host", r"\."))
        .withColumn("key", _key(F.col("labels"), F.col("path")))
    )
    depth = known.agg(F.max(F.size("labels"))).first()[0] or 0
    urls = table.select("host", "path").where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    # The host's last 1, 2, ... labels.
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(depth, 1)))),
        lambda n: F.slice(labels, F.size(labels) - n + 1, n))
    asked = urls.select("host", "path", F.explode(suffixes).alias("labels")).select(
        _key(F.col("labels"), F.col("path")).alias("key"), F.lit(1).alias("kind"), "host", "path",
        F.lit(None).cast("string").alias("verdict"))
    events = asked.unionByName(known.select("key", F.lit(0).alias("kind"), "host", "path", "verdict"))
    ordered = cut_lineage(
        events.repartitionByRange("key", "kind", "host").sortWithinPartitions("key", "kind"))
    fits = ordered.mapInArrow(_sweep(_around(ordered, known)),
                              "host string, path string, rule_host string, rule_path string, verdict string")
    size = F.struct(F.length(F.concat("rule_host", "rule_path")), F.length("rule_host"))
    best = fits.groupBy("host", "path").agg(F.max_by(
        F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), size).alias("best"))
    given = [F.col(f"page.`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return table.join(best, ["host", "path"], "left").select(
        *given, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(ALLOW)).alias("verdict"))


def _around(ordered: DataFrame, rules: DataFrame) -> dict[int, list[tuple[str, str, str, str]]]:
    """By partition the rules, widest first, that its first key lies within and that come before it.

    The driver gets a partition's first key's rules: as many as rules nest in one another.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        found = next((b.column(0)[0].as_py() for b in batches if b.num_rows), None)
        if found is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "first": [found]})

    heads = ordered.select("key").mapInArrow(first, "part int, first string")
    sizes = rules.agg(F.sort_array(F.collect_set(F.length("key")))).first()[0]
    if not sizes:
        return {}
    starts = heads.select("part", F.explode(F.transform(
        F.filter(F.array(*map(F.lit, sizes)), lambda n: n <= F.length("first")),
        lambda n: F.col("first").substr(F.lit(1), n))).alias("key"))
    around: dict[int, list[tuple[str, str, str, str]]] = {}
    found = starts.join(rules, "key").select("part", "key", "host", "path", "verdict").collect()
    for part, *rule in sorted(found, key=lambda r: (r.part, len(r.key))):
        around.setdefault(part, []).append(tuple(rule))
    return around


def _sweep(around: dict[int, list[tuple[str, str, str, str]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = list(around.get(TaskContext.get().partitionId(), []))
        for batch in batches:
            out: list[tuple] = []
            for key, kind, host_, path_, verdict in zip(*(c.to_pylist() for c in batch.columns)):
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, host_, path_, verdict))
                elif stack:
                    out.append((host_, path_, *stack[-1][1:]))
            names = ["host", "path", "rule_host", "rule_path", "verdict"]
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names)

    return run
