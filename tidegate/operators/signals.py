"""Component signals: decode (S5) and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.functions.exprs import blank_to_null
from tidegate.operators.history import OK, TRANSITIONS, requested_check
from tidegate.operators.skew import lookup_join
from tidegate.operators.stages import decode
from tidegate.schemas import SIGNAL, as_struct

# The back-pressure reason, the state a signal asks for, and the actions.
BACKPRESSURE = "stream back-pressure"
STOPPING = "Stopping"
RETRY, NOTIFY, SKIP, STOP = "retry", "notify", "ack", "stop"


def signals(raw: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Decoded signals, absent fields empty; and the malformed rows, to be delivered again."""
    good, bad = decode(raw, SIGNAL, value)
    return good.withColumns({f: F.coalesce(f, F.lit("")) for f in as_struct(SIGNAL).fieldNames()}), bad


def route_signals(decoded: DataFrame, pipelines: DataFrame) -> DataFrame:
    """What to do with each decoded signal; ``pipelines`` is (pipeline_id, status).

    Back-pressure notifies, whatever the pipeline.  An unknown pipeline is acknowledged.
    A stop that the current status does not allow is retried, else the pipeline stops with
    the signal's text as its reason.  A blank or unknown stored status counts as Created.
    """
    table = pipelines.select("pipeline_id", F.struct(F.col("status").alias("status")).alias("_tg_row"))
    joined = lookup_join(decoded, table, ["pipeline_id"])
    stored = F.col("_tg_row.status")
    current = F.when(stored.isin(list(TRANSITIONS)), stored).otherwise("Created")
    action = (
        F.when(F.col("reason") == BACKPRESSURE, NOTIFY)
        .when(F.col("_tg_row").isNull(), SKIP)
        .when(requested_check(current, F.lit(STOPPING)) == OK, STOP)
        .otherwise(RETRY)
    )
    return joined.withColumn("action", action).withColumn(
        "stop_reason", F.when(F.col("action") == STOP, blank_to_null(F.col("text")))
    ).drop("_tg_row")


def retry_rows(bad: DataFrame) -> DataFrame:
    """Malformed signals in the shape of a routing result."""
    return bad.withColumn("action", F.lit(RETRY))
