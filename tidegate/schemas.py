"""Record types the operators read and write, as DDL text."""

from __future__ import annotations

from pyspark.sql import types as T


Schema = T.StructType | str


def as_struct(schema: Schema) -> T.StructType:
    """A schema given as type or as DDL text; the text needs an active session."""
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


PIPELINE_SPEC = (
    "pipeline_id STRING, "
    "sources STRUCT<type: STRING, topics: ARRAY<STRUCT<topic_name: STRING, dedup_window: BIGINT, "
    "deduplication: STRUCT<enabled: BOOLEAN, storage_size: STRING, storage_class: STRING>>>>, "
    "join STRUCT<type: STRING, enabled: BOOLEAN, left_buffer_ttl: BIGINT, right_buffer_ttl: BIGINT>, "
    "sink STRUCT<type: STRING>, "
    "transform STRUCT<is_dedup_enabled: BOOLEAN, is_filter_enabled: BOOLEAN, "
    "is_stateless_transform_enabled: BOOLEAN>"
)
DEAD_LETTER = ("component STRING, error STRING, original_message STRING, reason STRING")
SIGNAL = ("pipeline_id STRING, reason STRING, text STRING, component STRING")
NOTIFICATION = (
    "notification_id STRING, pipeline_id STRING, timestamp STRING, severity STRING, event_type STRING, "
    "title STRING, message STRING, "
    "metadata STRUCT<source: STRING, tags: ARRAY<STRING>, custom_fields: MAP<STRING, STRING>>"
)
