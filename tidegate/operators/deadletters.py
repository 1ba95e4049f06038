"""Dead letters: the JSON envelope of a failed row (K2, X5) and its way back (K3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions.exprs import blank_to_null
from tidegate.schemas import DEAD_LETTER

# Fixed values of the wire format.
RETRY_EXHAUSTED_ON_STOP = "retry_exhausted_on_stop"
DLQ_SUBJECT_SUFFIX = "failed"


def dlq_subject(stream: Column) -> Column:
    return F.concat(stream, F.lit(f".{DLQ_SUBJECT_SUFFIX}"))


def envelope(component: Column, original: Column, error: Column | None = None, reason: Column | None = None) -> Column:
    """``error`` and ``reason`` are left out when empty; the other two are always written."""
    nothing = F.lit(None).cast("string")
    return F.to_json(F.struct(
        F.coalesce(component, F.lit("")).alias("component"),
        (nothing if error is None else blank_to_null(error)).alias("error"),
        F.coalesce(original, F.lit("")).alias("original_message"),
        (nothing if reason is None else blank_to_null(reason)).alias("reason"),
    ))


def to_dlq(
    df: DataFrame, component: Column, original: Column, error: Column | None = None, reason: Column | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One envelope per row; ``keep`` names identifying columns to carry along."""
    return df.select(*keep, envelope(component, original, error, reason).alias("dead_letter"))


def from_dlq(df: DataFrame, value: str = "dead_letter") -> DataFrame:
    """Envelope back to columns; unknown fields are ignored, absent ones become empty."""
    others = [c for c in df.columns if c != value]
    parsed = F.from_json(F.col(value), DEAD_LETTER)
    fields = [F.coalesce(parsed[f], F.lit("")).alias(f) for f in ("component", "error", "original_message", "reason")]
    return df.select(*others, *fields)
