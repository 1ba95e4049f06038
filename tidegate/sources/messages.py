"""Stored messages read by sequence range (S6).  A table has (stream, seq, subject, data, time)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.functions.exprs import block_of
from tidegate.operators.blocks import SEQ_BLOCK, previous
from tidegate.operators.skew import lookup_join


def scan_messages(messages: DataFrame, stream: str | None = None, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Messages with ``lo <= seq <= hi``; deleted sequences are simply absent.  Filters push down."""
    rows = messages
    if stream is not None:
        rows = rows.where(F.col("stream") == stream)
    if lo is not None:
        rows = rows.where(F.col("seq") >= lo)
    if hi is not None:
        rows = rows.where(F.col("seq") <= hi)
    return rows


def scan_ranges(messages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Messages inside the range asked for their stream; ``ranges``: one (stream, lo, hi) per stream."""
    return (
        lookup_join(messages, ranges.select("stream", "lo", "hi"), ["stream"], "inner")
        .where(F.col("seq").between(F.col("lo"), F.col("hi")))
        .drop("lo", "hi")
    )


def seq_range(messages: DataFrame) -> DataFrame:
    """First and last sequence and message count per stream."""
    return messages.groupBy("stream").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("msgs")
    )


def seq_gap_ranges(messages: DataFrame) -> DataFrame:
    """The deleted sequences between a stream's first and last one as ranges: (stream, lo, hi, n).

    Ranges come from neighbouring sequences, block by block; a hot stream is spread over tasks.
    """
    block = block_of(F.col("seq"), SEQ_BLOCK)
    stepped = previous(messages.select("stream", "seq"), ["stream"], ["seq"], ["seq"], "_tg_prev", block)
    before = F.col("_tg_prev.seq")
    return stepped.where(F.col("seq") - before > 1).select(
        "stream", (before + 1).alias("lo"), (F.col("seq") - 1).alias("hi"), (F.col("seq") - before - 1).alias("n"))


def seq_gaps(messages: DataFrame) -> DataFrame:
    """Every deleted sequence, spelled out; prefer ``seq_gap_ranges`` where numbers are sparse.

    A long gap is cut into pieces of one block, spread over the tasks, before it is spelled out.
    """
    gaps = seq_gap_ranges(messages).drop("n")
    short = F.col("hi") - F.col("lo") < SEQ_BLOCK
    pieces = (
        gaps.where(~short)
        .withColumn("b", F.explode(F.sequence(block_of(F.col("lo"), SEQ_BLOCK), block_of(F.col("hi"), SEQ_BLOCK))))
        .select(
            "stream",
            F.greatest(F.col("lo"), F.col("b") * F.lit(SEQ_BLOCK)).alias("lo"),
            F.least(F.col("hi"), F.col("b") * F.lit(SEQ_BLOCK) + F.lit(SEQ_BLOCK - 1)).alias("hi"),
        )
        .repartition("stream", "lo")
    )
    return gaps.where(short).unionByName(pieces).select("stream", F.explode(F.sequence("lo", "hi")).alias("seq"))
