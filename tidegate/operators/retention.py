"""Retention of message tables.

A stream's messages have unique, rising ``seq``; blocks of 2**20 sequence numbers bound
what one task holds, however large the stream is.  The count and size limits sort only the
one block of each stream in which the limit falls.  A limit of 0 or less is none, and rows
whose stream is null are a stream of their own.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions.exprs import block_of, interval
from tidegate.operators.blocks import SEQ_BLOCK, admit
from tidegate.operators.skew import lookup_join
from tidegate.session import cut_lineage


def trim_age(messages: DataFrame, age: timedelta, as_of: datetime, time: str = "time") -> DataFrame:
    """Drop rows older than ``as_of - age``; zero keeps all.  A plain filter, pushed to the scan."""
    if age <= timedelta(0):
        return messages
    ntz = dict(messages.dtypes)[time] == "timestamp_ntz"
    limit = F.lit(as_of).cast("timestamp_ntz" if ntz else "timestamp") - interval(age)
    return messages.where(F.col(time) >= limit)


def _limited(messages: DataFrame, value: Column, limit: int, last: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows within the limit, the rest); a limit of 0 or less is none."""
    if limit <= 0:
        return messages, messages.where(F.lit(False))
    judged = admit(messages, ["stream"], "seq", SEQ_BLOCK, value, limit, "_tg_in", last)
    return judged.where("_tg_in").drop("_tg_in"), judged.where("NOT _tg_in").drop("_tg_in")


def _size(data: str) -> Column:
    return F.coalesce(F.octet_length(F.col(data)), F.lit(0))


def admit_msgs(messages: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Refuse-new: the first ``n`` messages of each stream, and the refused ones."""
    return _limited(messages, F.lit(1), n)


def trim_msgs(messages: DataFrame, n: int) -> DataFrame:
    """Drop-old: the last ``n`` messages of each stream."""
    return _limited(messages, F.lit(1), n, last=True)[0]


def admit_bytes(messages: DataFrame, limit: int, data: str = "data", rule: str = "prefix") -> tuple[DataFrame, DataFrame]:
    """Refuse-new by size.

    With ``rule`` "prefix" a stream is full at the first row that lifts its running total over
    ``limit``.  With "fitting" later rows that still fit in what is left are taken, one by one in
    the order of arrival, as a log does that refuses single messages.
    """
    if rule not in ("prefix", "fitting"):
        raise ValueError(f"unknown rule {rule}")
    if rule == "prefix" or limit <= 0:
        return _limited(messages, _size(data), limit)
    return _fitting(messages, limit, data)


def take_fitting(sizes: np.ndarray, room: int) -> tuple[np.ndarray, int]:
    """Which of ``sizes`` are taken one by one while they fit in ``room``, and what room is left.

    Goes from one refused row to the next: between them the taken rows are a running sum.
    """
    taken, at = np.zeros(len(sizes), bool), 0
    ahead = np.flatnonzero(sizes <= room)
    while at < len(ahead):
        run = np.cumsum(sizes[ahead[at:]])
        fits = int(np.searchsorted(run, room, "right"))
        taken[ahead[at:at + fits]] = True
        room -= int(run[fits - 1]) if fits else 0
        # The row that did not fit, and all that are too big by now, are out.
        rest = ahead[at + fits + 1:]
        ahead, at = rest[sizes[rest] <= room], 0
    return taken, room


def _fitting(messages: DataFrame, limit: int, data: str) -> tuple[DataFrame, DataFrame]:
    """Round by round: all blocks of what could still fit that fit as a whole are taken by their
    totals; the one block that does not is walked through, for each stream in a task of its own.

    A round moves a stream past the block it walks, so there are at most as many rounds as
    blocks; mostly far fewer, since each leaves less room and so fewer rows that could fit.  What
    is kept are spans of blocks with the room that counted there, and the numbers taken in walked blocks.
    """
    run, block, size, room, after = "_tg_run", "_tg_block", "_tg_size", "_tg_room", "_tg_after"
    # Text of the stream that is also there for a null one.
    keyed = messages.withColumns({
        run: F.to_json(F.struct("stream")), block: block_of(F.col("seq"), SEQ_BLOCK), size: _size(data).cast("bigint")})
    slim = cut_lineage(keyed.select(run, block, "seq", size).where(F.col(size) <= limit))
    upto = F.sum("total").over(Window.partitionBy(run).orderBy(block).rowsBetween(Window.unboundedPreceding, 0))
    ahead = slim.withColumns({room: F.lit(limit).cast("bigint"), after: F.lit(None).cast("bigint")})

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        taken, left = take_fitting(rows[size].to_numpy(), int(rows[room].iloc[0]))
        return rows.assign(taken=taken, **{room: left})[[run, block, "seq", room, "taken"]]

    spans, walked = [], []
    while True:
        totals = ahead.groupBy(run, block).agg(F.sum(size).alias("total"), F.max(room).alias(room), F.max(after).alias(after))
        totals = totals.withColumn("upto", upto)
        over = F.when(F.col("upto") > F.col(room), F.col(block))
        rounds = cut_lineage(totals.groupBy(run).agg(
            F.max(room).alias(room), F.max(after).alias(after), F.min(over).alias("end"),
            F.min_by(F.col(room) - F.col("upto") + F.col("total"), over).alias("inside")))
        spans.append(rounds.select(run, F.struct(after, "end", room).alias("span")))
        stops = rounds.where("end IS NOT NULL").select(run, F.col("end").alias(block), F.col("inside").alias(room))
        inside = lookup_join(ahead.select(run, block, "seq", size), stops, [run, block], "inner")
        done = cut_lineage(inside.groupBy(run).applyInPandas(
            walk, f"{run} string, {block} bigint, seq bigint, {room} bigint, taken boolean"))
        if done.isEmpty():
            break
        walked.append(done.where("taken").select(run, "seq", F.lit(True).alias("_tg_taken")))
        state = done.groupBy(run).agg(F.max(block).alias(after), F.min(room).alias(room))
        ahead = lookup_join(slim, state, [run], "inner").where((F.col(block) > F.col(after)) & (F.col(size) <= F.col(room)))
    by_run = reduce(DataFrame.unionByName, spans).groupBy(run).agg(F.collect_list("span").alias("_tg_spans"))
    judged = lookup_join(keyed, by_run, [run])
    good = F.exists("_tg_spans", lambda s: (
        (s[after].isNull() | (F.col(block) > s[after])) & (s["end"].isNull() | (F.col(block) < s["end"]))
        & (F.col(size) <= s[room])))
    good = F.coalesce(good, F.lit(False))
    if walked:
        judged = lookup_join(judged, reduce(DataFrame.unionByName, walked), [run, "seq"])
        good = good | F.coalesce("_tg_taken", F.lit(False))
    return judged.where(good).select(*messages.columns), judged.where(~good).select(*messages.columns)


def trim_bytes(messages: DataFrame, limit: int, data: str = "data") -> DataFrame:
    """Drop-old by size: the newest rows of each stream that together have at most ``limit`` bytes."""
    return _limited(messages, _size(data), limit, last=True)[0]


def retain_workqueue(messages: DataFrame, acks: DataFrame) -> DataFrame:
    """Consumed rows leave: anti-join on the unique (stream, seq)."""
    return messages.join(acks.select("stream", "seq"), ["stream", "seq"], "left_anti")


def retain_interest(messages: DataFrame, consumers: DataFrame, acks: DataFrame) -> DataFrame:
    """A row leaves when every consumer of its stream has acked it.

    ``consumers``: (stream, consumer); ``acks``: (stream, seq, consumer), repeats allowed.
    A stream without consumers keeps nothing, as nobody is interested.  One
    shuffle on (stream, seq) serves the distinct acks, their count and the join.
    """
    wanted = consumers.select("stream", "consumer").distinct()
    need = wanted.groupBy("stream").agg(F.count(F.lit(1)).alias("_tg_need"))
    have = (
        lookup_join(acks.select("stream", "seq", "consumer"), wanted, ["stream", "consumer"], "left_semi")
        .repartition("stream", "seq")
        .distinct()
        .groupBy("stream", "seq").agg(F.count(F.lit(1)).alias("_tg_have"))
    )
    counted = lookup_join(messages, need, ["stream"], "left").join(have, ["stream", "seq"], "left")
    left_over = F.coalesce("_tg_have", F.lit(0)) < F.coalesce("_tg_need", F.lit(0))
    return counted.where(left_over).drop("_tg_need", "_tg_have")


def retain(
    messages: DataFrame, policy: str, acks: DataFrame | None = None, consumers: DataFrame | None = None,
    max_age: timedelta = timedelta(0), as_of: datetime | None = None, max_msgs: int = 0, max_bytes: int = 0,
    discard: str = "new",
) -> DataFrame:
    """Apply a policy by name, then the limits; an unknown name means work-queue.

    Age goes first, then count, then bytes.  ``Limits`` ignores acks.
    """
    rows = messages
    if policy == "Interest":
        rows = retain_interest(rows, consumers, acks)
    elif policy != "Limits":
        rows = retain_workqueue(rows, acks)
    if max_age > timedelta(0):
        rows = trim_age(rows, max_age, as_of)
    if max_msgs > 0:
        rows = admit_msgs(rows, max_msgs)[0] if discard == "new" else trim_msgs(rows, max_msgs)
    return admit_bytes(rows, max_bytes)[0] if discard == "new" else trim_bytes(rows, max_bytes)
