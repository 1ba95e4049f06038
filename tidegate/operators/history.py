"""Pipeline status and its history (H1-H8, K5).

A status change has (pipeline_id, ts, seq, status); ``seq`` breaks ties.  Functions that
look at the row before first count rows; where a pipeline has too many of them for a task
(``hot_rows``), the histories are cut into slices.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions.exprs import blank_to_null, interval, parse_rfc3339
from tidegate.operators.blocks import previous
from tidegate.operators.skew import HOT_ROWS, lookup_join

# Status names and the moves allowed from each.
TRANSITIONS = {
    "Created": ("Running", "Terminating", "Failed"),
    "Running": ("Stopping", "Terminating", "Failed"),
    "Resuming": ("Running", "Terminating", "Failed"),
    "Stopping": ("Stopped", "Terminating", "Failed"),
    "Stopped": ("Resuming", "Failed"),
    "Terminating": ("Stopped", "Failed"),
    "Failed": ("Resuming",),
}
IN_TRANSITION = ("Resuming", "Stopping", "Terminating")
OK, UNKNOWN, INVALID, BUSY = "ok", "unknown status", "invalid status transition", "pipeline already in transition"
NOT_FOUND = "pipeline not found"
STOP_CEILING, OTHER_CEILING = timedelta(minutes=5), timedelta(minutes=15)

_ORDER = ["ts", "seq"]


def allowed(source: Column, target: Column) -> Column:
    """True where the matrix allows the move."""
    moves = [(a, b) for a, targets in TRANSITIONS.items() for b in targets]
    return F.concat_ws(">", source, target).isin([f"{a}>{b}" for a, b in moves])


def recorded_check(source: Column, target: Column) -> Column:
    """The matrix alone."""
    return (
        F.when(~F.coalesce(source.isin(list(TRANSITIONS)), F.lit(False)), UNKNOWN)
        .when(F.coalesce(allowed(source, target), F.lit(False)), OK)
        .otherwise(INVALID)
    )


def requested_check(source: Column, target: Column) -> Column:
    """A request: equal passes, a pipeline in transition only terminates, then the matrix."""
    return (
        F.when(source == target, OK)
        .when(source.isin(list(IN_TRANSITION)) & (target != "Terminating"), BUSY)
        .otherwise(recorded_check(source, target))
    )


def latest_status(changes: DataFrame) -> DataFrame:
    """Newest status per pipeline; aggregates map-side."""
    return (
        changes.groupBy("pipeline_id")
        .agg(F.max_by(F.struct("status", "ts"), F.struct(*_ORDER)).alias("r"))
        .select("pipeline_id", "r.status", F.col("r.ts").alias("updated_at"))
    )


def _with_previous(changes: DataFrame, hot_rows: int) -> DataFrame:
    return previous(changes, ["pipeline_id"], _ORDER, ["status"], "_tg_prev", hot_rows=hot_rows).withColumn(
        "from_status", F.col("_tg_prev.status")
    )


def check_transitions(changes: DataFrame, mode: str = "recorded", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Verdict on each status against the one before it; a pipeline's first row has none."""
    check = {"recorded": recorded_check, "requested": requested_check}[mode]
    return (
        _with_previous(changes, hot_rows)
        .where("_tg_prev is not null")
        .select("pipeline_id", *_ORDER, "from_status", F.col("status").alias("to_status"),
                check(F.col("from_status"), F.col("status")).alias("verdict"))
    )


def drop_unchanged(changes: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """A status equal to the one before is neither an update nor a history row."""
    return _with_previous(changes, hot_rows).where(
        F.col("_tg_prev").isNull() | ~F.col("status").eqNullSafe(F.col("from_status"))
    ).select(*changes.columns)


def transition_counts(changes: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Real transitions by from, to and pipeline."""
    return (
        _with_previous(changes, hot_rows)
        .where(F.col("_tg_prev").isNotNull() & ~F.col("status").eqNullSafe(F.col("from_status")))
        .groupBy("from_status", F.col("status").alias("to_status"), "pipeline_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def history_events(changes: DataFrame) -> DataFrame:
    """History rows: type ``error`` when there are errors, and the event as JSON.

    ``errors`` is written even when null; ``reason`` only when it is not empty.
    """
    kind = F.when(F.size(F.col("errors")) > 0, "error").otherwise("status")
    fields = [
        kind.alias("type"),
        F.struct(F.struct(F.col("status").alias("overall_status")).alias("status")).alias("pipeline"),
        F.col("errors"),
    ]
    keep_nulls = {"ignoreNullFields": "false"}
    event = F.when(blank_to_null(F.col("reason")).isNull(), F.to_json(F.struct(*fields), keep_nulls)).otherwise(
        F.to_json(F.struct(*fields, F.col("reason")), keep_nulls)
    )
    return changes.select("pipeline_id", *_ORDER, kind.alias("type"), event.alias("event"))


def history_status(history: DataFrame) -> DataFrame:
    """Read the overall status back out of the event."""
    return history.withColumn("overall_status", F.get_json_object("event", "$.pipeline.status.overall_status"))


def apply_status(pipelines: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Update the status table and append history as one logical write.

    Returns the new table (same columns), the history rows of known pipelines, and the
    changes to ids that do not exist.  The newest change per pipeline is picked map-side
    before the join, so a pipeline with many changes is no hot key.
    """
    newest = latest_status(changes).toDF("id", "_tg_status", "_tg_at")
    state = pipelines.join(newest, "id", "left").select(
        "id",
        F.when(F.col("_tg_at").isNotNull(), F.col("_tg_status")).otherwise(F.col("status")).alias("status"),
        F.coalesce("_tg_at", "updated_at").alias("updated_at"),
    )
    ids = pipelines.select(F.col("id").alias("pipeline_id"))
    known = lookup_join(changes, ids, ["pipeline_id"], "left_semi")
    missing = lookup_join(changes, ids, ["pipeline_id"], "left_anti").select(
        "pipeline_id", *_ORDER, "status", F.lit(NOT_FOUND).alias("error")
    )
    return state, history_events(known), missing


def delete_pipelines(pipelines: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table without ``ids``, and the ids that were not in it."""
    wanted = ids.select("id").distinct()
    remaining = pipelines.join(wanted, "id", "left_anti")
    absent = wanted.join(pipelines.select("id"), "id", "left_anti").withColumn("error", F.lit(NOT_FOUND))
    return remaining, absent


def overruns(
    ops: DataFrame, as_of: datetime, stop_ceiling: timedelta = STOP_CEILING, other_ceiling: timedelta = OTHER_CEILING
) -> DataFrame:
    """Operations running longer than their ceiling at ``as_of``.

    ``started`` is RFC3339 text; without a readable start an operation is not timed out.
    """
    begun = parse_rfc3339(F.col("started"))
    now = F.lit(as_of).cast("timestamp")
    ceiling = F.when(F.col("operation") == "stop", interval(stop_ceiling)).otherwise(interval(other_ceiling))
    return ops.withColumns({
        "elapsed_us": F.unix_micros(now) - F.unix_micros(begun),
        "timed_out": F.coalesce(now > begun + ceiling, F.lit(False)),
    })


