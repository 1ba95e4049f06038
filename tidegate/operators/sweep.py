"""Orphan sweep: what is left in the internal streams of a stopped pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.operators.deadletters import RETRY_EXHAUSTED_ON_STOP, to_dlq
from tidegate.operators.joins import consumer_map_join
from tidegate.operators.skew import lookup_join
from tidegate.sources.messages import seq_gaps, seq_range

# Outcome labels.
SWEPT, SWEEP_FAILED, STREAM_EMPTY, ALREADY_DELETED = "swept", "sweep_failed", "stream_empty", "already_deleted"


def sweep(messages: DataFrame, consumers: DataFrame, already: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Every message still stored becomes a dead letter named after its consumer.

    Returns (stream, seq, dead_letter) and the messages of streams without a consumer.
    ``already`` lists (stream, seq) swept before: a second run leaves them out, so each
    message is written once however often the sweep is repeated.
    """
    left = messages if already is None else messages.join(
        already.select("stream", "seq"), ["stream", "seq"], "left_anti"
    )
    labelled, unmapped = consumer_map_join(left, consumers)
    letters = to_dlq(
        labelled, F.col("component"), F.col("data").cast("string"),
        error=F.lit(RETRY_EXHAUSTED_ON_STOP), keep=("stream", "seq"),
    )
    return letters, unmapped


def sweep_outcomes(streams: DataFrame, messages: DataFrame, failed: DataFrame) -> DataFrame:
    """Outcome of every sequence from a stream's first to its last.

    Deleted sequences are ``already_deleted``, those in ``failed`` (stream, seq) are
    ``sweep_failed``, the rest ``swept``; a stream without messages gives one
    ``stream_empty`` row with a null sequence.
    """
    stored = lookup_join(messages, streams.select("stream"), ["stream"], "left_semi")
    tried = (
        stored.select("stream", "seq")
        .join(failed.select("stream", "seq").distinct().withColumn("_tg_bad", F.lit(True)), ["stream", "seq"], "left")
        .select("stream", "seq", F.when(F.col("_tg_bad"), SWEEP_FAILED).otherwise(SWEPT).alias("outcome"))
    )
    gone = seq_gaps(stored).withColumn("outcome", F.lit(ALREADY_DELETED))
    return tried.unionByName(gone).unionByName(_empty_streams(streams, stored))


def sweep_counts(streams: DataFrame, messages: DataFrame, failed: DataFrame) -> DataFrame:
    """Messages by pipeline and outcome; ``streams`` is (stream, pipeline_id).

    Deleted sequences are counted from the range, not spelled out.
    """
    stored = lookup_join(messages, streams.select("stream"), ["stream"], "left_semi")
    ranges = seq_range(stored)
    bad = (
        stored.select("stream", "seq")
        .join(failed.select("stream", "seq"), ["stream", "seq"], "left_semi")
        .groupBy("stream").agg(F.count(F.lit(1)).alias("bad"))
    )
    per_stream = (
        streams.select("stream", "pipeline_id").join(ranges, "stream", "left").join(bad, "stream", "left")
        .select(
            "pipeline_id",
            F.coalesce(F.col("msgs"), F.lit(0)).alias("msgs"),
            F.coalesce(F.col("bad"), F.lit(0)).alias("bad"),
            F.coalesce(F.col("last_seq") - F.col("first_seq") + 1 - F.col("msgs"), F.lit(0)).alias("gone"),
        )
    )
    counts = F.array(
        F.struct(F.lit(SWEPT).alias("outcome"), (F.col("msgs") - F.col("bad")).alias("n")),
        F.struct(F.lit(SWEEP_FAILED).alias("outcome"), F.col("bad").alias("n")),
        F.struct(F.lit(ALREADY_DELETED).alias("outcome"), F.col("gone").alias("n")),
        F.struct(F.lit(STREAM_EMPTY).alias("outcome"), (F.col("msgs") == 0).cast("bigint").alias("n")),
    )
    return (
        per_stream.select("pipeline_id", F.inline(counts))
        .groupBy("pipeline_id", "outcome").agg(F.sum("n").alias("n"))
        .where("n > 0")
    )


def _empty_streams(streams: DataFrame, stored: DataFrame) -> DataFrame:
    return streams.select("stream").join(stored.select("stream").distinct(), "stream", "left_anti").select(
        "stream", F.lit(None).cast("bigint").alias("seq"), F.lit(STREAM_EMPTY).alias("outcome")
    )
