"""Column expressions shared by the operators (ids X1-X6 of the blueprint)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Unit suffixes (powers of 1024) and the size used when a text is unreadable.
BYTE_UNITS = {"KB": 1024, "MB": 1024**2, "GB": 1024**3, "TB": 1024**4}
DEFAULT_BYTES = 107374182400
MAX_NAME_BYTES = 256


def to_micros(span: timedelta) -> int:
    """Whole microseconds of a duration (Spark's timestamp resolution)."""
    return span // timedelta(microseconds=1)


def from_nanos(ns: int) -> timedelta:
    """Durations in pipeline specs are nanoseconds; what is below a microsecond is cut."""
    return timedelta(microseconds=ns // 1000)


def interval(span: timedelta) -> Column:
    """A constant day-time interval."""
    return F.expr(f"INTERVAL '{to_micros(span) / 1e6:.6f}' SECOND")


def micros(ts: Column) -> Column:
    """Microseconds since the epoch; zone-less timestamps are read in the session zone (UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def identity(df: DataFrame, cols: Sequence[str]) -> Column:
    """One text per key, the same exactly where all values are: timestamps to the microsecond, and
    -0.0 is 0.0."""
    def exact(name: str) -> Column:
        kind, col = df.schema[name].dataType, F.col(name)
        if isinstance(kind, T.TimestampType):
            return F.unix_micros(col).alias(name)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return (col + F.lit(0.0).cast(kind)).alias(name)
        if isinstance(kind, (T.TimestampNTZType, T.DayTimeIntervalType, T.YearMonthIntervalType)):
            return col.cast("string").alias(name)
        return col
    return F.to_json(F.struct(*[exact(c) for c in cols]))


def block_of(value: Column, width: int) -> Column:
    """Index of the half-open block of ``width`` holding an integer, exact below zero too."""
    return F.call_function("div", value - F.pmod(value, F.lit(width)), F.lit(width))


def compute_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters and projections will use several times.

    Filters are pushed through a projection by repeating its expression, which would parse
    a payload once per use; they are not pushed through a generator, here of one row.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def short_hash(value: Column) -> Column:
    """First eight hex digits of SHA-256."""
    return F.substring(F.sha2(value, 256), 1, 8)


def clean_name(value: Column) -> Column:
    """Dots, spaces and slashes become underscores."""
    return F.translate(value, ". /", "___")


def cut_name(value: Column) -> Column:
    """Cut at 256 bytes; names are ASCII in practice, so bytes and characters agree."""
    return F.when(F.octet_length(value) <= MAX_NAME_BYTES, value).otherwise(
        F.substring(value.cast("binary"), 1, MAX_NAME_BYTES).cast("string")
    )


def shard_prefix(prefix: str, pipeline_id: Column, node: Column, suffix: str = "out") -> Column:
    """``prefix-hash-node-suffix``: the name shared by all output shards of a node."""
    return cut_name(
        F.concat(F.lit(f"{prefix}-"), short_hash(pipeline_id), F.lit("-"), clean_name(node), F.lit(f"-{suffix}"))
    )


def shard_name(prefix: str, pipeline_id: Column, node: Column, shard: Column) -> Column:
    return F.concat(shard_prefix(prefix, pipeline_id, node), F.lit("_"), shard.cast("string"))


def parse_bytes(text: Column) -> Column:
    """Bytes of ``"1024"`` or ``"1.5GB"`` (any case, outer blanks allowed with a unit); null = invalid.

    No blank may stand between number and unit, and a plain number takes no blanks at all.
    """
    plain = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))
    trimmed = F.upper(F.regexp_replace(text, r"^\s+|\s+$", ""))
    pattern = r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:E[+-]?[0-9]+)?)(KB|MB|GB|TB)$"
    unit = F.regexp_extract(trimmed, pattern, 2)
    factor = F.lit(None).cast("bigint")
    for name, size in BYTE_UNITS.items():
        factor = F.when(unit == name, F.lit(size)).otherwise(factor)
    number = F.regexp_extract(trimmed, pattern, 1).try_cast("double")
    return F.coalesce(plain, (number * factor).try_cast("bigint"))


def parse_bytes_or_default(text: Column, default: int = DEFAULT_BYTES) -> Column:
    """Lenient form: unreadable sizes become the default."""
    return F.coalesce(parse_bytes(text), F.lit(default).cast("bigint"))


def parse_rfc3339(text: Column) -> Column:
    """RFC3339 text to timestamp, null when malformed; digits past microseconds are cut."""
    shape = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})$"
    return F.when(text.rlike(shape), F.translate(text, ",", ".").try_cast("timestamp"))


def format_rfc3339(ts: Column) -> Column:
    """Whole seconds, UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def format_rfc3339_nano(ts: Column) -> Column:
    """Fraction without trailing zeros, UTC."""
    full = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.rtrim(F.rtrim(full, F.lit("0")), F.lit(".")), F.lit("Z"))


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def random_id() -> Column:
    """Random id per row; differs from run to run."""
    return F.uuid()
