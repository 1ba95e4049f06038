"""Deduplication of two streams and their temporal join in one stateful step.

Where both topics are deduplicated by the keys they are joined on, all rows that can meet are
in one group of keys.  So a row goes through the state once, and what is kept is joined there:
no tables between, and no state entry for each row and time bucket.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.functions.exprs import to_micros
from tidegate.streaming.dedup_stream import (
    JSON, NEVER, OUT_ROWS, _Grouped, _packed, _Side, _unpacked, default_groups, state_rows, state_width,
)

# Equal in the state exactly where SQL calls them equal.
_PLAIN = (T.IntegralType, T.FractionalType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _pairs(left: pa.Table, right: pa.Table, before: int, after: int):
    """Row numbers of the pairs of one name with ``-before <= right time - left time <= after``, some at a time."""
    if not (len(left) and len(right)):
        return
    names = pa.concat_tables([left.select(["name"]), right.select(["name"])])["name"].combine_chunks()
    codes = names.dictionary_encode().indices.to_numpy().astype(np.int64)
    l_at, r_at = left["at"].to_numpy(), right["at"].to_numpy()
    times = np.unique(r_at)
    # A name and a time as one number, by the time's rank.
    l_code, place = codes[:len(left)] * (len(times) + 1), codes[len(left):] * (len(times) + 1) + np.searchsorted(times, r_at)
    order = np.argsort(place, kind="stable")
    place = place[order]
    start = np.searchsorted(place, l_code + np.searchsorted(times, l_at - before, "left"), "left")
    end = np.searchsorted(place, l_code + np.searchsorted(times, l_at + after, "right"), "left")
    upto = np.cumsum(end - start)
    for at in range(0, int(upto[-1]), OUT_ROWS):
        pair = np.arange(at, min(at + OUT_ROWS, int(upto[-1])))
        l = np.searchsorted(upto, pair, "right")
        yield l, order[end[l] - (upto[l] - pair)]


class _DedupJoin(_Grouped):
    """State of one group of keys: of each stream its rows and anchors, and the kept rows that may find a partner yet."""

    def __init__(self, widths: Sequence[int], tie_type: T.DataType, spans: Sequence[int]):
        self.sides = [_Side(width, tie_type) for width in widths]
        self.spans = [min(span, NEVER) for span in spans]
        self.rows = self.sides[0].rows
        self.kept = pa.schema([self.rows.field(name) for name in ("name", "at", "body")])

    def init(self, handle):
        super().init(handle)
        for number, side in enumerate(self.sides):
            side.init(handle, f"_{number}")
        self.stored = [handle.getListState(f"kept_{number}", "chunk binary") for number in range(2)]

    def handleInputRows(self, key, rows, timerValues):
        tables = ([], [])
        for frame in rows:
            table, side = pa.Table.from_pandas(frame[self.rows.names], self.rows, preserve_index=False), frame["side"].to_numpy()
            for number in range(2):
                if len(part := table.filter(pa.array(side == number))):
                    tables[number].append(part)
        self.wake(*[side.add(new) for side, new in zip(self.sides, tables) if new])
        return iter(())

    def passed(self, limit):
        after, before = self.spans
        new, wakes = zip(*[side.keep(limit) for side in self.sides])
        new = [rows.select(self.kept.names) for rows in new]
        old = [_unpacked(stored.get(), self.kept) for stored in self.stored]
        for number, span in enumerate(self.spans):
            wakes += (self.store(number, old[number], new[number], span, limit),)
        self.wake(*wakes)
        for left, right in ((new[0], pa.concat_tables([old[1], new[1]])), (old[0], new[1])):
            left, right = left.combine_chunks(), right.combine_chunks()
            for l, r in _pairs(left, right, before, after):
                yield pd.DataFrame({"l": left["body"].take(pa.array(l)).to_pandas(), "r": right["body"].take(pa.array(r)).to_pandas()})

    def store(self, number, old, new, span, limit):
        """Rows stay until the watermark is a whole span past them; when the last goes, or None."""
        live = lambda rows: rows.filter(pc.greater_equal(pc.add(rows["at"], span), limit))
        fresh, still = live(new), live(old)
        if len(still) < len(old):
            if len(rest := pa.concat_tables([still, fresh])):
                self.stored[number].put([_packed(rest)])
            else:
                self.stored[number].clear()
        elif len(fresh):
            self.stored[number].appendList([_packed(fresh)])
        last = [pc.max(rows["at"]).as_py() for rows in (fresh, still) if len(rows)]
        return max(last) + span + 1 if last else None


def fits(left: DataFrame, right: DataFrame, on: Sequence[str], rules: Sequence) -> bool:
    """Whether two topics are deduplicated by the very keys they are joined on, keys and ties being of one plain type."""
    if not all(rule is not None and set(rule.keys) == set(on) for rule in rules):
        return False
    kinds = [(left.schema[k].dataType, right.schema[k].dataType) for k in on]
    ties = {df.schema[rule.tie].dataType for df, rule in zip((left, right), rules)}
    return len(ties) == 1 and all(a == b and (a == T.StringType() or isinstance(a, _PLAIN)) for a, b in kinds)


def dedup_join_stream(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_ts: str, right_ts: str,
    windows: Sequence[timedelta], ties: Sequence[str], left_ttl: timedelta, right_ttl: timedelta, delay: str,
    groups: int | None = None,
) -> DataFrame:
    """``dedup_stream`` of each side by ``on``, in its own window, and ``temporal_join_stream`` of what is kept.

    Rows count once the lower of the two watermarks has passed them.  See ``fits`` for the keys and
    ``dedup_stream`` for times, ties and ``groups``.
    """
    clash = set(left.columns) & set(right.columns) - set(on)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    after, before = to_micros(left_ttl), to_micros(right_ttl)
    if before < 0 or after < 0:
        raise ValueError("a buffer time must not be negative")
    groups = groups or default_groups(left)
    both = None
    for number, (df, ts, tie) in enumerate(((left, left_ts, ties[0]), (right, right_ts, ties[1]))):
        # A row without a key or a time joins nothing.
        rows = state_rows(df.withWatermark(ts, delay).dropna(subset=[*on, ts]), list(on), ts, tie, groups)
        rows = rows.withColumn("side", F.lit(number))
        both = rows if both is None else both.union(rows)
    processor = _DedupJoin([state_width(w) for w in windows], left.schema[ties[0]].dataType, (after, before))
    return (
        both.groupBy("bucket").transformWithStateInPandas(processor, "l string, r string", "Append", "EventTime")
        .select(F.from_json("l", left.schema, JSON).alias("l"), F.from_json("r", right.schema, JSON).alias("r"))
        .select("l.*", *[F.col(f"r.{c}") for c in right.columns if c not in on])
    )
