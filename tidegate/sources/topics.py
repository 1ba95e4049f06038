"""Topic sources (S1): one reader per topic, live or replayed from files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.operators.stages import decode_or_dlq
from tidegate.schemas import Schema


def kafka_topic(
    spark: SparkSession, topic: str, options: Mapping[str, str], streaming: bool = True
) -> DataFrame:
    """Raw rows of a topic: topic, partition, offset, time, key, value (text).

    ``options`` go to the connector: servers, security, ``maxOffsetsPerTrigger`` for
    back-pressure.  The connector package must be on the session's class path.
    """
    reader = (spark.readStream if streaming else spark.read).format("kafka").option("subscribe", topic)
    return reader.options(**options).load().select(
        "topic", "partition", "offset", F.col("timestamp").alias("time"), F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
    )


def kafka_source(
    spark: SparkSession, topic: str, schema: Schema, options: Mapping[str, str], streaming: bool = True
) -> tuple[DataFrame, DataFrame]:
    """A topic decoded with the caller's schema, and dead letters for what does not parse."""
    return decode_or_dlq(kafka_topic(spark, topic, options, streaming), schema, "ingestor")


def replay(
    spark: SparkSession, path: str, schema: Schema | None = None, pattern: str | None = None,
    streaming: bool = True, files_per_batch: int | None = None, fmt: str = "parquet",
) -> DataFrame:
    """Rows of a topic stored as files, as a table or as a stream in file order."""
    if not streaming:
        reader = spark.read.format(fmt)
    else:
        if schema is None:
            raise ValueError("a streaming replay needs a schema")
        reader = spark.readStream.format(fmt)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if schema is not None:
        reader = reader.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)
