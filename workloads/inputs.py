"""Inputs derived from the given tables, once for Spark and once as SQL text.

Each function reads whole tables; each SQL constant is the body of a CTE of the same rows.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = datetime(2024, 1, 31)
STATUS_NAMES = ("Created", "Running", "Stopping", "Stopped", "Resuming", "Terminating", "Failed", "Paused")
PREFIX = "etl"

EV = "ev AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """The events with ``k``, the number inside their payload."""
    return table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))


# --- stored messages ---------------------------------------------------------------------

MSGS = """msgs AS (
  SELECT 's_' || event_type AS stream, event_id AS seq,
         's_' || event_type || '.' || CAST(event_id % 4 AS VARCHAR) AS subject,
         props AS data, ts AS time, value
  FROM events)"""


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "'s_' || event_type AS stream", "event_id AS seq",
        "'s_' || event_type || '.' || CAST(event_id % 4 AS STRING) AS subject",
        "props AS data", "ts AS time", "value",
    )


# Two consumers per stream: ``a`` gets the cheap half of the values, ``b`` the dear ones.
CONSUMERS = "consumers AS (SELECT DISTINCT stream, c.consumer FROM msgs, (VALUES ('a'), ('b')) c(consumer))"
DELIVERIES = """deliveries AS (
  SELECT stream, seq, 'a' AS consumer FROM msgs WHERE value < 100
  UNION ALL SELECT stream, seq, 'b' FROM msgs WHERE value >= 20)"""
ACKS = """acks AS (
  SELECT stream, seq, 'a' AS consumer FROM msgs WHERE value < 40
  UNION ALL SELECT stream, seq, 'b' FROM msgs WHERE value >= 30)"""


def consumers(msgs: DataFrame) -> DataFrame:
    return msgs.select("stream").distinct().withColumn("consumer", F.explode(F.array(F.lit("a"), F.lit("b"))))


def _marks(msgs: DataFrame, a: str, b: str) -> DataFrame:
    names = F.array_compact(F.array(F.when(F.expr(a), "a"), F.when(F.expr(b), "b")))
    return msgs.select("stream", "seq", F.explode(names).alias("consumer"))


def deliveries(msgs: DataFrame) -> DataFrame:
    return _marks(msgs, "value < 100", "value >= 20")


def acks(msgs: DataFrame) -> DataFrame:
    return _marks(msgs, "value < 40", "value >= 30")


COMPONENTS = """components AS (
  SELECT DISTINCT stream, CASE stream WHEN 's_view' THEN 'dedup' WHEN 's_click' THEN 'dedup'
                                      WHEN 's_purchase' THEN 'join' ELSE 'sink' END AS component
  FROM msgs WHERE stream <> 's_error')"""


def components(msgs: DataFrame) -> DataFrame:
    """Who reads which stream; nobody reads ``s_error``."""
    return msgs.where("stream <> 's_error'").select("stream").distinct().selectExpr(
        "stream",
        "CASE stream WHEN 's_view' THEN 'dedup' WHEN 's_click' THEN 'dedup' "
        "WHEN 's_purchase' THEN 'join' ELSE 'sink' END AS component",
    )


# --- status changes ----------------------------------------------------------------------

CHANGES = f"""{EV}, changes AS (
  SELECT 'pipe-' || user_id AS pipeline_id, ts, event_id AS seq,
         ([{', '.join(f"'{n}'" for n in STATUS_NAMES)}])[1 + k % 8] AS status,
         CASE WHEN event_type = 'error' THEN props END AS error,
         CASE event_type WHEN 'click' THEN 'asked by user' WHEN 'view' THEN '' END AS reason
  FROM ev)"""


def status_changes(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in STATUS_NAMES])
    return events(spark, sf).select(
        F.concat(F.lit("pipe-"), F.col("user_id").cast("string")).alias("pipeline_id"),
        "ts", F.col("event_id").alias("seq"),
        F.element_at(names, (F.col("k") % 8 + 1).cast("int")).alias("status"),
        F.expr("CASE WHEN event_type = 'error' THEN array(props) END").alias("errors"),
        F.expr("CASE event_type WHEN 'click' THEN 'asked by user' WHEN 'view' THEN '' END").alias("reason"),
    )


PIPELINES = """pipelines AS (
  SELECT 'pipe-' || c_custkey AS id, 'Created' AS status, TIMESTAMP '2023-12-31 00:00:00' AS updated_at
  FROM customer WHERE c_mktsegment <> 'BUILDING')"""


def pipelines(spark: SparkSession, sf: str) -> DataFrame:
    """The known pipelines: customers outside one segment, so that some changes miss."""
    return table(spark, sf, "customer").where("c_mktsegment <> 'BUILDING'").selectExpr(
        "'pipe-' || CAST(c_custkey AS STRING) AS id", "'Created' AS status",
        "TIMESTAMP_NTZ '2023-12-31 00:00:00' AS updated_at",
    )


# --- signals, outcomes, samples ----------------------------------------------------------

SIGNALS = """sigs AS (
  SELECT event_id, ts, value > 150 AS malformed, 'pipe-' || user_id AS pipeline_id,
         CASE WHEN event_type = 'view' THEN 'stream back-pressure' ELSE 'failure' END AS reason,
         CASE WHEN event_type = 'click' THEN '' ELSE event_type END AS text, 'sink' AS component
  FROM events)"""


def raw_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Signals as JSON; those with a high value are cut short and do not parse."""
    good = F.to_json(F.expr(
        "named_struct('pipeline_id', 'pipe-' || CAST(user_id AS STRING), "
        "'reason', CASE WHEN event_type = 'view' THEN 'stream back-pressure' ELSE 'failure' END, "
        "'text', CASE WHEN event_type = 'click' THEN '' ELSE event_type END, 'component', 'sink')"
    ))
    return table(spark, sf, "events").select(
        "event_id", "ts", F.when(F.col("value") > 150, F.lit('{"pipeline_id": "pipe-')).otherwise(good).alias("value")
    )


OUTCOMES = """outcomes AS (
  SELECT event_id, CASE event_type WHEN 'signup' THEN 'create' WHEN 'view' THEN 'resume' WHEN 'click' THEN 'edit'
                                   WHEN 'purchase' THEN 'stop' ELSE 'unknown' END AS operation,
         CASE WHEN value > 100 THEN 'failure' ELSE 'success' END AS status,
         'pipe-' || user_id AS pipeline_id, ts AS ended, value AS seconds,
         CASE WHEN value > 100 THEN 'k ' || k END AS error,
         CASE WHEN k < 50 THEN 'stopped at k ' || k ELSE '' END AS message
  FROM ev)"""


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).selectExpr(
        "event_id",
        "CASE event_type WHEN 'signup' THEN 'create' WHEN 'view' THEN 'resume' WHEN 'click' THEN 'edit' "
        "WHEN 'purchase' THEN 'stop' ELSE 'unknown' END AS operation",
        "CASE WHEN value > 100 THEN 'failure' ELSE 'success' END AS status",
        "'pipe-' || CAST(user_id AS STRING) AS pipeline_id", "ts AS ended", "value AS seconds",
        "CASE WHEN value > 100 THEN 'k ' || CAST(k AS STRING) END AS error",
        "CASE WHEN k < 50 THEN 'stopped at k ' || CAST(k AS STRING) ELSE '' END AS message",
    )


LAGS = f"""{MSGS}, lags AS (
  SELECT 'pipe-' || e.user_id AS pipeline_id,
         CASE e.event_type WHEN 'view' THEN 'dedup' WHEN 'click' THEN 'dedup' WHEN 'purchase' THEN 'join' ELSE 'sink' END AS component,
         CAST(SUM(CASE WHEN value >= 100 THEN 1 ELSE 0 END) AS BIGINT) AS pending,
         CAST(SUM(CASE WHEN value >= 40 AND value < 100 THEN 1 ELSE 0 END) AS BIGINT) AS unacked
  FROM events e GROUP BY ALL)"""


def lags(spark: SparkSession, sf: str) -> DataFrame:
    """Lag per pipeline and component, counted as consumer ``a`` sees it."""
    return (
        table(spark, sf, "events")
        .selectExpr(
            "'pipe-' || CAST(user_id AS STRING) AS pipeline_id",
            "CASE event_type WHEN 'view' THEN 'dedup' WHEN 'click' THEN 'dedup' "
            "WHEN 'purchase' THEN 'join' ELSE 'sink' END AS component",
            "value",
        )
        .groupBy("pipeline_id", "component")
        .agg(
            F.count_if(F.col("value") >= 100).alias("pending"),
            F.count_if((F.col("value") >= 40) & (F.col("value") < 100)).alias("unacked"),
        )
    )


# --- shard names -------------------------------------------------------------------------

NAMES = f"""named AS (
  SELECT c_custkey, c_nationkey, 'pipe-' || c_custkey AS pipeline_id,
         '{PREFIX}-' || substr(sha256('pipe-' || c_custkey), 1, 8) AS head FROM customer),
existing AS (
  SELECT pipeline_id, head || '-ingestor_0-out_' || s AS name FROM named, (VALUES (0), (1), (2), (3)) v(s)
  UNION ALL SELECT pipeline_id, head || '-DLQ' FROM named),
planned AS (
  SELECT head || '-ingestor_0-out_' || s AS name FROM named, (VALUES (0), (1), (2), (3)) v(s) WHERE s <= c_nationkey
  UNION ALL SELECT head || '-DLQ' FROM named)"""
