"""Telemetry feeds (S2 logs, S3 traces, S4 metrics): nested export batches to flat rows.

A payload is one JSON export request: resources, each with scopes, each with records.
The caller gives the schemas of resource, scope and record; the operator parses only
those fields and unnests by path.  A payload that does not parse becomes a dead letter.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.functions.exprs import compute_once
from tidegate.operators.deadletters import envelope, to_dlq
from tidegate.schemas import Schema, as_struct

_CORRUPT = "_corrupt_record"

# The array names of the public telemetry JSON encoding, outermost first.
PATHS = {
    "logs": ("resourceLogs", "scopeLogs", "logRecords"),
    "traces": ("resourceSpans", "scopeSpans", "spans"),
    "metrics": ("resourceMetrics", "scopeMetrics", "metrics"),
}
POINT_KINDS = ("gauge", "sum", "histogram", "exponentialHistogram", "summary")

KEY_VALUES = "array<struct<key: string, value: struct<stringValue: string, intValue: string, doubleValue: double, boolValue: boolean>>>"
RESOURCE = f"attributes {KEY_VALUES}"
SCOPE = "name string, version string"


def _array(name: str, fields: list[T.StructField]) -> T.StructField:
    return T.StructField(name, T.ArrayType(T.StructType(fields)))


# What the data points of each kind hold, as far as the public encoding names it.
_POINT = f"attributes {KEY_VALUES}, startTimeUnixNano string, timeUnixNano string"
_BUCKETS = "struct<offset: int, bucketCounts: array<string>>"
POINTS = {
    "gauge": f"{_POINT}, asDouble double, asInt string",
    "sum": f"{_POINT}, asDouble double, asInt string",
    "histogram": f"{_POINT}, count string, sum double, bucketCounts array<string>, explicitBounds array<double>, min double, max double",
    "exponentialHistogram": f"{_POINT}, count string, sum double, scale int, zeroCount string, positive {_BUCKETS}, negative {_BUCKETS}",
    "summary": f"{_POINT}, count string, sum double, quantileValues array<struct<quantile: double, value: double>>",
}


def _leaf(signal: str, record: Schema | Mapping[str, Schema] | None) -> tuple[list[T.StructField], dict[str, T.StructType]]:
    """Fields of the innermost records, and for metrics the schema of each kind's points."""
    if signal != "metrics":
        if record is None:
            raise ValueError(f"{signal} need the schema of a record")
        return as_struct(record).fields, {}
    given = POINTS if record is None else record
    points = {k: as_struct(s) for k, s in given.items()} if isinstance(given, Mapping) else {
        k: as_struct(given) for k in POINT_KINDS}
    unknown = set(points) - set(POINT_KINDS)
    if unknown:
        raise ValueError(f"unknown metric kinds {sorted(unknown)}")
    return [T.StructField("name", T.StringType()), T.StructField("unit", T.StringType())] + [
        T.StructField(k, T.StructType([T.StructField("dataPoints", T.ArrayType(s))])) for k, s in points.items()
    ], points


def _parse(df: DataFrame, signal: str, leaf: list[T.StructField], value: str, resource: Schema, scope: Schema) -> tuple[DataFrame, Column]:
    """The input with its parsed payload, and which rows do not parse."""
    outer, middle, inner = PATHS[signal]
    schema = T.StructType([
        _array(outer, [T.StructField("resource", as_struct(resource)),
                       _array(middle, [T.StructField("scope", as_struct(scope)), _array(inner, leaf)])]),
        T.StructField(_CORRUPT, T.StringType()),
    ])
    body = F.from_json(F.col(value).cast("string"), schema, {"columnNameOfCorruptRecord": _CORRUPT})
    return compute_once(df, "_tg_v", body), F.col("_tg_v").isNull() | F.col(f"_tg_v.{_CORRUPT}").isNotNull()


def _points(points: dict[str, T.StructType], one: bool) -> Column:
    """All points of a metric as one array of (kind, columns)."""
    def of_kind(kind: str) -> Column:
        def point(p: Column) -> Column:
            if one:
                return F.struct(F.lit(kind).alias("kind"), p.alias("record"))
            columns = [(p if k == kind else F.lit(None).cast(s)).alias(k) for k, s in points.items()]
            return F.struct(F.lit(kind).alias("kind"), *columns)
        found = F.transform(F.col(f"_i.{kind}.dataPoints"), point)
        return F.coalesce(found, F.filter(F.array(point(F.lit(None).cast(points[kind]))), lambda p: F.lit(False)))

    return reduce(F.concat, [of_kind(k) for k in points])


def otlp_source(
    df: DataFrame, signal: str, record: Schema | Mapping[str, Schema] | None = None, value: str = "value",
    resource: Schema = RESOURCE, scope: Schema = SCOPE, component: str = "otlp", error: str = "malformed payload",
) -> tuple[DataFrame, DataFrame]:
    """The records, and a dead letter for each payload that does not parse (a null one too).

    Records have the columns besides ``value``, then signal, resource, scope and record.  For
    metrics ``record`` gives the schema of the data points by kind (default: ``POINTS``, all
    five); there is one row per point with its metric's name and unit, its kind, and a column
    for each kind, null but for its own.  With one schema for all kinds that column is
    ``record``.  A request without records gives no row and no letter.  Where both frames are
    used, ``otlp_tagged`` parses once for both.
    """
    if signal not in PATHS:
        raise ValueError(f"unknown signal {signal}")
    outer, middle, inner = PATHS[signal]
    leaf, points = _leaf(signal, record)
    parsed, bad = _parse(df, signal, leaf, value, resource, scope)
    others = [c for c in df.columns if c != value]
    letters = to_dlq(parsed.where(bad), F.lit(component), F.col(value).cast("string"), error=F.lit(error))
    tag = F.lit(signal).alias("signal")
    rows = (
        parsed.where(~bad).select(*others, F.explode(F.col(f"_tg_v.{outer}")).alias("_r"))
        .select(*others, F.col("_r.resource").alias("resource"), F.explode(F.col(f"_r.{middle}")).alias("_s"))
        .select(*others, "resource", F.col("_s.scope").alias("scope"), F.explode(F.col(f"_s.{inner}")).alias("_i"))
    )
    if signal != "metrics":
        return rows.select(*others, tag, "resource", "scope", F.col("_i").alias("record")), letters
    one = record is not None and not isinstance(record, Mapping)
    return rows.select(
        *others, tag, "resource", "scope", F.col("_i.name").alias("name"), F.col("_i.unit").alias("unit"),
        F.inline(_points(points, one)),
    ), letters


def otlp_tagged(
    df: DataFrame, signal: str, record: Schema | Mapping[str, Schema] | None = None, value: str = "value",
    resource: Schema = RESOURCE, scope: Schema = SCOPE, component: str = "otlp", error: str = "malformed payload",
) -> DataFrame:
    """Records and dead letters of one parse, for a sink that splits them.

    The columns are those of ``otlp_source``'s records and ``dead_letter``, which is null on
    a record; on a letter all columns but it and the input's own are null.
    """
    if signal not in PATHS:
        raise ValueError(f"unknown signal {signal}")
    outer, middle, inner = PATHS[signal]
    leaf, points = _leaf(signal, record)
    parsed, bad = _parse(df, signal, leaf, value, resource, scope)
    others = [c for c in df.columns if c != value]
    letter = F.when(bad, envelope(F.lit(component), F.col(value).cast("string"), F.lit(error))).alias("dead_letter")
    kept = [*others, "dead_letter"]
    flat = (
        # A payload that does not parse may be parsed in part; none of it counts.
        parsed.select(*others, letter, F.explode_outer(F.when(~bad, F.col(f"_tg_v.{outer}"))).alias("_r"))
        .select(*kept, F.col("_r.resource").alias("resource"), F.explode_outer(F.col(f"_r.{middle}")).alias("_s"))
        .select(*kept, "resource", F.col("_s.scope").alias("scope"), F.posexplode_outer(F.col(f"_s.{inner}")).alias("_at", "_i"))
    )
    tag = F.when(F.col("dead_letter").isNull(), F.lit(signal)).alias("signal")
    if signal != "metrics":
        found = flat.where("_at IS NOT NULL OR dead_letter IS NOT NULL")
        return found.select(*others, tag, "resource", "scope", F.col("_i").alias("record"), "dead_letter")
    one = record is not None and not isinstance(record, Mapping)
    found = flat.select(*kept, "resource", "scope", "_i", F.posexplode_outer(_points(points, one)).alias("_at", "_p")).where(
        "_at IS NOT NULL OR dead_letter IS NOT NULL")
    return found.select(*others, tag, "resource", "scope", F.col("_i.name").alias("name"), F.col("_i.unit").alias("unit"),
                        "_p.*", "dead_letter")


def attribute(attributes: Column, key: str) -> Column:
    """The string value of an attribute, null when absent."""
    match = F.filter(attributes, lambda a: a["key"] == key)
    return F.try_element_at(match, F.lit(1))["value"]["stringValue"]
