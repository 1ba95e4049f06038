"""Notifications (N2, N3, K4) and usage events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions.exprs import blank_to_null, compute_once, format_rfc3339, format_rfc3339_nano, random_id

# Operation -> (severity, event type, title, message).
SUCCESS = {
    "create": ("info", "pipeline_deployed", "Pipeline Deployed Successfully", "Pipeline has been deployed successfully"),
    "resume": ("info", "pipeline_resumed", "Pipeline Resumed", "Pipeline has been resumed"),
    "stop": ("warn", "pipeline_stopped", "Pipeline Stopped", "Pipeline has been stopped"),
    "terminate": ("warn", "pipeline_stopped", "Pipeline Terminated", "Pipeline has been terminated"),
    "edit": ("info", "pipeline_deployed", "Pipeline Updated Successfully", "Pipeline has been updated successfully"),
    "delete": ("warn", "pipeline_deleted", "Pipeline Deleted", "Pipeline has been deleted"),
    "helm-uninstall": ("warn", "pipeline_deleted", "Pipeline Uninstalled", "Pipeline has been uninstalled"),
}
BACKPRESSURE = (
    "warn", "pipeline_backpressure", "Pipeline Back-Pressure Detected",
    "Your OTLP pipeline is under back-pressure — the stream buffer is full. Scale up your sink to resume normal ingestion.",
)
REQUIRED = ("notification_id", "pipeline_id", "timestamp", "event_type", "title", "message")


def _pick(field: int) -> Column:
    out = F.lit(None).cast("string")
    for operation, values in SUCCESS.items():
        out = F.when(F.col("operation") == operation, values[field]).otherwise(out)
    return out


def _frame(df: DataFrame, severity: Column, event_type: Column, title: Column, message: Column,
           tags: Column, custom: Column, source: str, at: Column) -> DataFrame:
    return df.select(
        random_id().alias("notification_id"),
        F.col("pipeline_id"),
        format_rfc3339_nano(at).alias("timestamp"),
        severity.alias("severity"), event_type.alias("event_type"), title.alias("title"), message.alias("message"),
        F.struct(F.lit(source).alias("source"), tags.alias("tags"), custom.alias("custom_fields")).alias("metadata"),
    )


def build_notifications(outcomes: DataFrame, source: str, provider: str, at: str = "ended") -> DataFrame:
    """One notification per operation outcome.

    ``outcomes``: (operation, status, pipeline_id, error, message, <at>).  A success of an
    unknown operation gives none; only a stop takes its message from the outcome.  A
    failure names the operation and the error, whatever the operation.
    """
    failed = F.col("status") == "failure"
    operation, error = F.col("operation"), F.coalesce(F.col("error"), F.lit(""))
    own_message = F.when(operation == "stop", blank_to_null(F.col("message")))
    custom = F.when(
        failed,
        F.create_map(
            F.lit("operation"), operation, F.lit("status"), F.lit("failure"),
            F.lit("error"), error, F.lit("cluster_provider"), F.lit(provider)),
    ).otherwise(F.create_map(
        F.lit("operation"), operation, F.lit("status"), F.lit("success"), F.lit("cluster_provider"), F.lit(provider)))
    return _frame(
        outcomes.where(failed | operation.isin(list(SUCCESS))),
        F.when(failed, "error").otherwise(_pick(0)),
        F.when(failed, "pipeline_failed").otherwise(_pick(1)),
        F.when(failed, F.concat(F.lit("Pipeline Operation Failed: "), operation)).otherwise(_pick(2)),
        F.when(failed, F.concat(F.lit("Operation "), operation, F.lit(" failed: "), error))
        .otherwise(F.coalesce(own_message, _pick(3))),
        F.when(failed, F.array(F.lit("deployment"), F.lit("error"))).otherwise(F.array(F.lit("deployment"))),
        custom, source, F.col(at),
    )


def backpressure_notifications(routed: DataFrame, source: str, at: str) -> DataFrame:
    """One notification per signal routed to ``notify``."""
    severity, event_type, title, message = (F.lit(v) for v in BACKPRESSURE)
    return _frame(
        routed.where(F.col("action") == "notify"), severity, event_type, title, message,
        F.array(F.lit("backpressure")), F.lit(None).cast("map<string,string>"), source, F.col(at),
    )


def validate_notifications(df: DataFrame) -> DataFrame:
    """Add ``invalid``: the first required field that is empty, or null when all are there."""
    reason = F.lit(None).cast("string")
    for field in reversed(REQUIRED):
        reason = F.when(blank_to_null(F.col(field)).isNull(), F.lit(f"{field} is required")).otherwise(reason)
    return df.withColumn("invalid", reason)


def notification_json(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Valid notifications as JSON; empty tags and custom fields are left out."""
    fields = ("notification_id", "pipeline_id", "timestamp", "severity", "event_type", "title", "message", "metadata")
    rows = compute_once(df.select(*keep, *fields), "_tg_n", F.struct(*fields))
    n = F.col("_tg_n")
    for field in REQUIRED:
        rows = rows.where(n[field] != "")
    tags, custom = n["metadata"]["tags"], n["metadata"]["custom_fields"]
    body = F.struct(
        *[n[field].alias(field) for field in fields[:-1]],
        F.struct(
            n["metadata"]["source"].alias("source"),
            F.when(F.size(tags) > 0, tags).alias("tags"),
            F.when(F.size(custom) > 0, custom).alias("custom_fields"),
        ).alias("metadata"),
    )
    return rows.select(*keep, F.to_json(body).alias("payload"))


def usage_events(outcomes: DataFrame, installation_id: str, provider: str, at: str = "ended") -> DataFrame:
    """One usage event per reconcile outcome, with the pipeline id hashed."""
    failed = F.col("status") == "failure"
    common = [
        F.lit("pipeline_id_hash"), F.md5(F.col("pipeline_id").cast("binary")),
        F.lit("operation"), F.col("operation"), F.lit("status"),
    ]
    props = F.when(failed, F.create_map(
        *common, F.lit("failure"), F.lit("error"), F.coalesce(F.col("error"), F.lit("")),
        F.lit("cluster_provider"), F.lit(provider),
    )).otherwise(F.create_map(*common, F.lit("success"), F.lit("cluster_provider"), F.lit(provider)))
    return _usage(outcomes, F.when(failed, "reconcile_error").otherwise("reconcile_success"), props, installation_id, at)


def status_usage_events(changes: DataFrame, installation_id: str, provider: str, at: str = "ts") -> DataFrame:
    """One usage event per real status change."""
    props = F.create_map(
        F.lit("pipeline_id_hash"), F.md5(F.col("pipeline_id").cast("binary")),
        F.lit("status"), F.col("status"), F.lit("cluster_provider"), F.lit(provider),
    )
    return _usage(changes, F.lit("pipeline_status_change"), props, installation_id, at)


def _usage(df: DataFrame, name: Column, properties: Column, installation_id: str, at: str) -> DataFrame:
    return df.select(
        F.lit(installation_id).alias("installation_id"), name.alias("event_name"),
        F.lit("operator").alias("event_source"), format_rfc3339(F.col(at)).alias("timestamp"),
        properties.alias("properties"),
    )


def usage_json(events: DataFrame) -> DataFrame:
    return events.select(F.to_json(F.struct(*[F.col(c) for c in events.columns])).alias("payload"))
