"""Table sink (K1), dead-letter and notification sinks (K2, K4)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegate.operators.notifications import notification_json, validate_notifications


def table_sink(
    df: DataFrame, target: str, mode: str = "append", writers: int | None = None, fmt: str = "parquet",
    options: Mapping[str, str] | None = None, partition_by: Sequence[str] = (),
) -> None:
    """Write a batch with ``writers`` parallel tasks (default: as the data is partitioned).

    ``target`` is a path, or the table name when ``fmt`` is ``jdbc``; the connection goes in
    ``options``.  Every shard of the input is written.
    """
    rows = df if writers is None else df.repartition(writers)
    out = rows.write.format(fmt).mode(mode).options(**(options or {}))
    if partition_by:
        out = out.partitionBy(*partition_by)
    if fmt == "jdbc":
        out.option("dbtable", target).save()
    else:
        out.save(target)


def stream_sink(
    df: DataFrame, target: str, checkpoint: str, writers: int | None = None, fmt: str = "parquet",
    options: Mapping[str, str] | None = None, output_mode: str = "append", available_now: bool = True,
) -> StreamingQuery:
    """Write a stream; a batch that is repeated after a failure replaces its own earlier output.

    File tables get one folder per batch id, written in overwrite mode.  JDBC is at least once:
    the batch id is written along, and it is the target that must drop repeats by it.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        if fmt == "jdbc":
            table_sink(batch.withColumn("_batch_id", F.lit(batch_id)), target, "append", writers, fmt, options)
        else:
            table_sink(batch, f"{target}/batch_id={batch_id}", "overwrite", writers, fmt, options)

    writer = df.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def split_sink(
    df: DataFrame, letter: str, target: str, letters: str, checkpoint: str, available_now: bool = True,
) -> StreamingQuery:
    """Write a stream's rows to ``target`` and those with a ``letter`` to ``letters``, that column alone.

    Each micro-batch is computed once and kept on the executors for the second write.  Both
    tables have a folder per batch id, which a repeated batch replaces.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            table_sink(kept.where(F.col(letter).isNull()).drop(letter), f"{target}/batch_id={batch_id}", "overwrite")
            table_sink(kept.where(F.col(letter).isNotNull()).select(letter), f"{letters}/batch_id={batch_id}", "overwrite")
        finally:
            kept.unpersist()

    writer = df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def append_letters(letters: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Dead letters are only ever appended; no retention limit applies to their table."""
    table_sink(letters, path, "append", partition_by=partition_by)


def notify_sink(notifications: DataFrame, path: str) -> DataFrame:
    """Append valid notifications as JSON payloads; returns the invalid ones with the reason."""
    table_sink(notification_json(notifications), path)
    return validate_notifications(notifications).where("invalid IS NOT NULL")
