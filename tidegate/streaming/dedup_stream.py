"""Windowed deduplication on a stream (D2), the same rule as in batch.

Rows may reach a key out of time order, so each is held in state until the watermark has
passed it; then the held rows are read in order against the key's anchor.  What arrives
later than the watermark is dropped by Spark, so the result does not depend on how the
input was cut into micro-batches.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Sequence
from datetime import timedelta
from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import DataType

from tidegate.functions.exprs import identity, micros, to_micros

# Rows travel through the state as JSON, which keeps integers and microseconds exact.
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}

GROUPS_PER_PARTITION = 32
# Rows that go back to Spark at a time.
OUT_ROWS = 10_000
# Microseconds: a window that no later row is beyond.
NEVER = 1 << 61

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _packed(table: pa.Table) -> tuple[bytes]:
    """Rows as one value of the state: a call for each row would cost more than all else."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return (sink.getvalue().to_pybytes(),)


def _unpacked(chunks: Iterable[tuple], schema: pa.Schema) -> pa.Table:
    tables = [pa.ipc.open_stream(bytes(chunk)).read_all() for (chunk,) in chunks]
    return pa.concat_tables([schema.empty_table(), *tables]).combine_chunks()


def _in_order(table: pa.Table) -> pa.Table:
    """Sorted by name, time and tie."""
    keys = table.select(["name", "at", "tie"])
    while any(pa.types.is_struct(column.type) for column in keys.columns):
        keys = keys.flatten()
    return table.take(pc.sort_indices(keys, [(name, "ascending") for name in keys.column_names]))


class _Side:
    """What a group of keys holds of one stream, as Arrow: the rows waiting, and the anchors, last kept times."""

    def __init__(self, width: int, tie_type: DataType):
        self.width = width
        self.rows = pa.schema(
            [("name", pa.string()), ("at", pa.int64()), ("tie", to_arrow_type(tie_type)), ("body", pa.string())])
        self.times = pa.schema([("name", pa.string()), ("at", pa.int64())])

    def init(self, handle, suffix=""):
        self.held = handle.getListState(f"held{suffix}", "chunk binary")
        self.anchors = handle.getListState(f"anchors{suffix}", "chunk binary")

    def add(self, tables):
        """Let new rows wait; the time of the first, or None."""
        anchors, chunks, first = _unpacked(self.anchors.get(), self.times), [], None
        for table in tables:
            new = self.open(table, anchors)
            if len(new):
                start = pc.min(new["at"]).as_py()
                first = start if first is None else min(first, start)
                chunks.append(_packed(new))
        if chunks:
            self.held.appendList(chunks)
        return first

    def open(self, new, anchors):
        """The new rows that may be kept: not those that an anchor holds back already, and in an endless window
        only the first of each name."""
        if len(anchors):
            at = anchors["at"].take(pc.index_in(new["name"], anchors["name"].combine_chunks()))
            new = new.filter(pc.fill_null(pc.greater_equal(new["at"], pc.add(at, self.width)), True))
        if self.width >= NEVER and len(new):
            new = _in_order(new)
            names = new["name"].combine_chunks()
            new = new.filter(pa.concat_arrays([pa.array([True]), pc.not_equal(names[1:], names[:-1])]))
        return new

    def keep(self, limit):
        """The rows to keep of those up to ``limit``, and when to look again, or None."""
        held, before = _unpacked(self.held.get(), self.rows), _unpacked(self.anchors.get(), self.times)
        passed = pc.less_equal(held["at"], limit)
        due, waiting = _in_order(held.filter(passed)), held.filter(pc.invert(passed))
        del held
        anchors = dict(zip(before["name"].to_pylist(), before["at"].to_pylist()))
        kept = []
        for row, (name, at) in enumerate(zip(due["name"].to_pylist(), due["at"].to_pylist())):
            anchor = anchors.get(name)
            if anchor is None or at >= anchor + self.width:
                anchors[name] = at
                kept.append(row)
        # An anchor a whole window behind the watermark can hold no later row back.
        live = {name: at for name, at in anchors.items() if at + self.width > limit}
        if len(due):
            if len(waiting):
                self.held.put([_packed(waiting)])
            else:
                self.held.clear()
        if kept or len(live) < len(before):
            if live:
                self.anchors.put([_packed(pa.table([list(live), list(live.values())], self.times))])
            elif len(before):
                self.anchors.clear()
        wake = None
        if len(waiting):
            wake = pc.min(waiting["at"]).as_py()
        elif live:
            wake = min(max(live.values()) + self.width, NEVER)
        return due.take(pa.array(kept, pa.int64())), wake


class _Grouped(StatefulProcessor):
    """A group of keys that looks at its rows once the watermark has passed them."""

    def init(self, handle):
        self.handle, self.done = handle, {}

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        # Several timers of a key may expire together; the first has done it all.
        if self.done.get(key) == limit:
            return
        self.done[key] = limit
        yield from self.passed(limit)

    def passed(self, limit):
        raise NotImplementedError

    def wake(self, *times):
        """Timers fire once the watermark (milliseconds) is past them."""
        times = [at for at in times if at is not None]
        if times:
            self.handle.registerTimer(-(-min(times) // 1000))

    def close(self):
        pass


class _Dedup(_Grouped):
    """State of one group of keys: one stream's rows and anchors."""

    def __init__(self, width: int, tie_type: DataType):
        self.side = _Side(width, tie_type)
        self.rows = self.side.rows

    def init(self, handle):
        super().init(handle)
        self.side.init(handle)

    def handleInputRows(self, key, rows, timerValues):
        self.wake(self.side.add(pa.Table.from_pandas(f[self.rows.names], self.rows, preserve_index=False) for f in rows))
        return iter(())

    def passed(self, limit):
        kept, wake = self.side.keep(limit)
        self.wake(wake)
        for at in range(0, len(kept), OUT_ROWS):
            yield pd.DataFrame({"body": kept["body"][at: at + OUT_ROWS].to_pandas()})


def dedup_stream(
    df: DataFrame, keys: Sequence[str], ts: str, window: timedelta, tie: str, delay: str, groups: int | None = None
) -> DataFrame:
    """Streaming form of ``operators.dedup.dedup``; ``delay`` is how late a row may come.

    ``ts`` must be a timestamp with zone, ``tie`` a column without nulls that orders rows of
    equal time.  Rows with a null key or a null time go straight through.  Window 0 keeps the first
    row of each key for good, which takes one anchor per key for ever.  Needs the RocksDB state store.

    Each access to the state is a call out of the Python worker, so keys share ``groups``
    state entries by hash: more groups mean more calls, fewer mean that a worker holds more
    rows at a time and that more anchors are rewritten when one of them moves.  By default
    there are 32 per shuffle partition; like that setting, the number must stay the same for
    the life of a checkpoint.
    """
    groups = groups or default_groups(df)
    loose = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in [*keys, ts]])
    rows = df.withWatermark(ts, delay)
    kept = (
        state_rows(rows.where(~loose), keys, ts, tie, groups)
        .groupBy("bucket")
        .transformWithStateInPandas(_Dedup(state_width(window), df.schema[tie].dataType), "body string", "Append", "EventTime")
        .select(F.from_json("body", df.schema, JSON).alias("r"))
        .select("r.*")
    )
    return kept.unionByName(rows.where(loose))


def default_groups(df: DataFrame) -> int:
    return GROUPS_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def state_width(window: timedelta) -> int:
    """Microseconds between kept rows of a key."""
    width = to_micros(window)
    return width if width > 0 else NEVER


def state_rows(rows: DataFrame, keys: Sequence[str], ts: str, tie: str, groups: int) -> DataFrame:
    """Rows as a group of keys takes them."""
    # Spark hands these rows over as named tuples, so no name may begin with an underscore.
    return rows.select(
        F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("int").alias("bucket"),
        identity(rows, keys).alias("name"),
        F.col(ts).alias("event_time"),
        micros(F.col(ts)).alias("at"),
        F.col(tie).alias("tie"),
        F.to_json(F.struct(*[F.col(c) for c in rows.columns]), JSON).alias("body"),
    )
