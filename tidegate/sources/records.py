"""Pipeline specs stored as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.functions.exprs import compute_once
from tidegate.schemas import PIPELINE_SPEC, Schema, as_struct

# Source kinds, sink kinds and the shortest pipeline id.
SOURCE_TYPES = ("kafka", "otlp.logs", "otlp.traces", "otlp.metrics")
SINK_TYPES = ("clickhouse",)
MIN_ID_LENGTH = 5
MAX_TOPICS = 2

_CORRUPT = "_corrupt_record"


def read_specs(df: DataFrame, schema: Schema = PIPELINE_SPEC) -> tuple[DataFrame, DataFrame]:
    """Typed specs and rejected rows with a ``reason``.

    The stored config counts whenever it is there, even if blank; the inline one only
    stands in for a missing one.  ``df``: (pipeline_id, stored_config, inline_config).
    """
    inline = F.nullif(F.col("inline_config"), F.lit(""))
    config = F.coalesce(F.col("stored_config"), inline)
    body = T.StructType(
        [f for f in as_struct(schema).fields if f.name != "pipeline_id"] + [T.StructField(_CORRUPT, T.StringType())]
    )
    parsed = F.from_json("_tg_config", body, {"columnNameOfCorruptRecord": _CORRUPT})
    rows = compute_once(df.withColumn("_tg_config", config), "_tg_spec", parsed)
    spec = F.col("_tg_spec")
    reason = (
        F.when(F.col("_tg_config").isNull(), "no config")
        .when(F.col("_tg_config") == "", "empty config")
        .when(spec.isNull() | spec[_CORRUPT].isNotNull(), "malformed config")
        .when(F.length("pipeline_id") < MIN_ID_LENGTH, "pipeline id too short")
        .when(~F.coalesce(spec["sources"]["type"].isin(list(SOURCE_TYPES)), F.lit(False)), "unknown source type")
        .when(F.size(F.coalesce(spec["sources"]["topics"], F.array())) > MAX_TOPICS, "too many topics")
        .when(~F.coalesce(spec["sink"]["type"].isin(list(SINK_TYPES)), F.lit(False)), "unknown sink type")
    )
    judged = rows.withColumn("reason", reason)
    good = judged.where("reason is null").select(
        "pipeline_id", *[F.col(f"_tg_spec.{f.name}").alias(f.name) for f in body.fields if f.name != _CORRUPT]
    )
    bad = judged.where("reason is not null").select("pipeline_id", "stored_config", "inline_config", "reason")
    return good, bad
