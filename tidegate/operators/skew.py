"""Hot groups: cheap detection, and joins and layouts that split them.

Rows are counted per hash bucket first: the result has at most ``BUCKETS`` rows whatever the
data holds, and it combines map-side.  Only where a bucket holds more than ``floor`` rows are
the keys inside it counted, by their hash; those with more than ``floor`` rows are hot.  The
bound is absolute, so what one task gets does not grow with the data, and there are at most
rows / ``floor`` hot keys.  Two keys with one hash are split together, which stays exact.

The other side of a join is repeated for every part of a hot key, so many small parts would
cost the product of the two sides.  A key is split into at most ``FEW`` parts of ``floor`` rows;
into more only as parts of ``PIECE_ROWS`` or, if that is more, ``floor`` rows.

The counting jobs run when the plan is built and read only the key columns.  Where a
frame is costly to compute, pass ``measure``: any frame with the same key columns whose
rows include those of the frame (say, the rows before deduplication).
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.session import cut_lineage

HOT_ROWS = 2_000_000
BUCKETS = 4096
FEW = 8
PIECE_ROWS = HOT_ROWS // FEW
# A lookup table is broadcast up to so many rows and bytes (as JSON text).
SMALL_ROWS = 200_000
SMALL_BYTES = 64 << 20

_HASH, _PARTS, _SALT = "_tg_hash", "_tg_parts", "_tg_salt"


def _hash(cols: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(c) for c in cols])


def _bucket(cols: Sequence[str]) -> Column:
    return F.pmod(_hash(cols), F.lit(BUCKETS)).cast("int")


class Hot(NamedTuple):
    """The hot keys: by hash their rows, and the columns they are made of."""

    keys: dict[int, int]
    cols: list[str]

    @property
    def rows(self) -> int:
        return sum(self.keys.values())

    @property
    def condition(self) -> Column:
        """Which rows of a frame they are."""
        return _hash(self.cols).isin(sorted(self.keys))


def hot_filter(df: DataFrame, cols: Sequence[str], floor: int = HOT_ROWS) -> Hot | None:
    """The keys with more than ``floor`` rows, or None."""
    buckets = df.groupBy(_bucket(cols).alias("b")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > floor).collect()
    if not buckets:
        return None
    inside = df.where(_bucket(cols).isin(sorted(row["b"] for row in buckets)))
    counts = inside.groupBy(_hash(cols).alias("h")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > floor)
    keys = {row["h"]: row["n"] for row in counts.collect()}
    return Hot(keys, list(cols)) if keys else None


def _parts(rows: int, floor: int) -> int:
    """How many ways a hot key is split."""
    return max(ceil(rows / max(floor, PIECE_ROWS)), min(ceil(rows / max(floor, 1)), FEW))


def _with_parts(df: DataFrame, cols: Sequence[str], hot: Hot, floor: int) -> DataFrame:
    """How many ways each row's key is split.  There are at most rows / floor hot keys: fit to broadcast."""
    parts = df.sparkSession.createDataFrame(
        [(h, _parts(n, floor)) for h, n in hot.keys.items()], f"{_HASH} bigint, {_PARTS} int")
    joined = df.withColumn(_HASH, _hash(cols)).join(F.broadcast(parts), _HASH, "left")
    return joined.withColumn(_PARTS, F.coalesce(_PARTS, F.lit(1))).drop(_HASH)


def _row_salt(df: DataFrame) -> Column:
    """Spreads rows, also copies of one row, and is the same when a task is run again.

    The partition number tells copies apart; unlike a row number or a random value it does
    not depend on the order in which rows arrive.
    """
    hashable = [F.col(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    row = F.xxhash64(*hashable, F.spark_partition_id())
    return F.pmod(row, F.col(_PARTS)).cast("int")


def salt_for_join(
    heavy: DataFrame, other: DataFrame, on: Sequence[str], floor: int = HOT_ROWS,
    measure: DataFrame | None = None, salt: str = _SALT,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Spread hot join keys: ``heavy`` rows get a salt, ``other`` rows are repeated per salt.

    Every heavy row has one salt and every other row is present under it once, so an inner
    join, or any left join from ``heavy``, gives exactly the unsalted rows.  Returns both
    sides and the columns to join on; nothing changes when no bucket is hot.
    """
    hot = hot_filter(heavy if measure is None else measure, on, floor)
    return _salted(heavy, other, on, on, hot, floor, salt)


def _salted(
    heavy: DataFrame, other: DataFrame, on: Sequence[str], cols: Sequence[str], hot: Hot | None, floor: int, salt: str
) -> tuple[DataFrame, DataFrame, list[str]]:
    if hot is None:
        return heavy, other, list(cols)
    salted = _with_parts(heavy, on, hot, floor).withColumn(salt, _row_salt(heavy)).drop(_PARTS)
    repeated = _with_parts(other, on, hot, floor).withColumn(
        salt, F.explode(F.sequence(F.lit(0), F.col(_PARTS) - F.lit(1)))
    )
    return salted, repeated.drop(_PARTS), [*cols, salt]


def salt_both(
    left: DataFrame, right: DataFrame, on: Sequence[str], floor: int = HOT_ROWS,
    left_measure: DataFrame | None = None, right_measure: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """For inner joins whose hot keys may be on either side, or on both.

    Both sides are counted as they come in, before either is repeated.
    """
    hot_left = hot_filter(left if left_measure is None else left_measure, on, floor)
    hot_right = hot_filter(right if right_measure is None else right_measure, on, floor)
    right, left, cols = _salted(right, left, on, on, hot_right, floor, "_tg_salt_r")
    return _salted(left, right, on, cols, hot_left, floor, "_tg_salt_l")


def lookup_join(
    facts: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left", small: int = SMALL_ROWS,
    floor: int = HOT_ROWS,
) -> DataFrame:
    """Join facts with a lookup table (unique on ``on``), from the left side.

    The table's first ``small`` rows are computed once and kept; if that is all of it, and
    they have at most ``SMALL_BYTES``, it is broadcast.  A larger one is joined by shuffle, with
    hot fact keys salted.
    """
    head = cut_lineage(table.limit(small + 1))
    rows, size = head.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    if rows <= small and (size or 0) <= SMALL_BYTES:
        return facts.join(F.broadcast(head), list(on), how)
    heavy, other, cols = salt_for_join(facts, table, on, floor)
    return heavy.join(other, cols, how).drop(_SALT)


def spread_by(
    df: DataFrame, cols: Sequence[str], floor: int = HOT_ROWS, measure: DataFrame | None = None
) -> DataFrame:
    """Repartition by ``cols``, hot groups over as many tasks as their rows need."""
    hot = hot_filter(df if measure is None else measure, cols, floor)
    if hot is None:
        return df.repartition(*cols)
    salted = _with_parts(df, cols, hot, floor).withColumn(_SALT, _row_salt(df))
    return salted.drop(_PARTS).repartition(*cols, _SALT).drop(_SALT)
