"""Stateless stage: filter (P1), transform (P2), payload decode (P3), effective limits."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.functions.exprs import compute_once, parse_bytes
from tidegate.operators.deadletters import to_dlq
from tidegate.schemas import Schema, as_struct

_CORRUPT = "_corrupt_record"

# Limits of a stream whose spec sets none (7 days, 100 GB, 500,000 messages).
DEFAULT_LIMITS = {"max_age_ns": 168 * 3600 * 10**9, "max_bytes": 107374182400, "max_msgs": 500_000}


def filter_stage(df: DataFrame, condition: str | Column) -> DataFrame:
    """Keep the rows for which the condition is true."""
    return df.where(condition)


def transform_stage(df: DataFrame, columns: Mapping[str, str | Column], keep_rest: bool = False) -> DataFrame:
    """Project, rename and compute: exactly ``columns``, or added to what is there."""
    exprs = {name: F.expr(e) if isinstance(e, str) else e for name, e in columns.items()}
    if keep_rest:
        return df.withColumns(exprs)
    return df.select(*[e.alias(name) for name, e in exprs.items()])


def decode(df: DataFrame, schema: Schema, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Split JSON payloads: (decoded columns beside the other ones, rows that do not parse).

    Both frames are narrow branches over the same input; only their own part is computed.
    """
    schema = as_struct(schema)
    with_corrupt = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    others = [c for c in df.columns if c != value]
    body = F.from_json(F.col(value).cast("string"), with_corrupt, {"columnNameOfCorruptRecord": _CORRUPT})
    parsed = compute_once(df, "_tg_v", body)
    bad = F.col("_tg_v").isNull() | F.col(f"_tg_v.{_CORRUPT}").isNotNull()
    good_cols = [F.col(f"_tg_v.{f.name}").alias(f.name) for f in schema.fields]
    return parsed.where(~bad).select(*others, *good_cols), parsed.where(bad).drop("_tg_v")


def decode_or_dlq(
    df: DataFrame, schema: Schema, component: str, value: str = "value", error: str = "malformed payload"
) -> tuple[DataFrame, DataFrame]:
    """Decoded rows, and one dead letter per failed row under the failing component's name."""
    good, bad = decode(df, schema, value)
    return good, to_dlq(bad, F.lit(component), F.col(value).cast("string"), error=F.lit(error))


def effective_limits(specs: DataFrame, defaults: Mapping[str, int] = DEFAULT_LIMITS) -> DataFrame:
    """A limit set in the spec wins unless it is unset or zero; -1 (unlimited) is a set value."""
    return specs.withColumns(
        {name: F.coalesce(F.nullif(F.col(name), F.lit(0)), F.lit(value)).cast("bigint")
         for name, value in defaults.items()}
    )


def stream_defaults(
    settings: DataFrame, defaults: Mapping[str, int] = DEFAULT_LIMITS
) -> DataFrame:
    """Operator settings as texts: an unreadable size or count, or a count below -1, becomes the default."""
    msgs = F.when(F.col("max_msgs").rlike(r"^[+-]?[0-9]+$"), F.col("max_msgs").try_cast("bigint"))
    return settings.withColumns({
        "max_bytes": F.coalesce(parse_bytes(F.col("max_bytes")), F.lit(defaults["max_bytes"]).cast("bigint")),
        "max_msgs": F.coalesce(F.when(msgs >= -1, msgs), F.lit(defaults["max_msgs"]).cast("bigint")),
    })
