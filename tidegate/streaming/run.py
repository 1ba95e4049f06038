"""Running streams: one query into a table, or a whole flow."""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegate.plans.flows import LETTER, Flow, Topic
from tidegate.session import ENGINE_CONF, new_run_dir
from tidegate.sinks.tables import split_sink, stream_sink
from tidegate.sources.topics import replay

_IS_LETTER = "_tg_is_letter"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb_state(spark: SparkSession, partitions: int | None = None):
    """Queries started inside keep state in RocksDB, in ``partitions`` parts if given.

    Each part costs some time in every micro-batch, and its number is fixed by the first
    run of a checkpoint.  The session's settings are put back.
    """
    settings = {_PROVIDER: ENGINE_CONF[_PROVIDER]}
    if partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def read_table(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table a stream has written, with the stream's columns."""
    return spark.read.schema(like.schema).option("basePath", path).parquet(path).select(*like.columns)


def drain(df: DataFrame, label: str, output_mode: str = "append", partitions: int | None = None) -> DataFrame:
    """Process all available input in micro-batches and return the table that was written."""
    spark = df.sparkSession
    run = new_run_dir(spark, label)
    with rocksdb_state(spark, partitions):
        stream_sink(df, f"{run}/table", f"{run}/checkpoint", output_mode=output_mode).awaitTermination()
    return read_table(spark, f"{run}/table", df)


def _stage_table(topic: Topic, delay: str, path: str, available_now: bool) -> tuple[StreamingQuery, Topic]:
    """Deduplicate a topic into a table, and read that table as the topic.

    Spark's own file sink logs which files belong to a finished batch, and its file source
    reads by that log, so nothing is lost or doubled between the two queries.
    """
    rows = topic.dedup.apply(topic.rows, topic.ts, delay)
    writer = rows.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").option(
        "path", f"{path}/rows")
    query = (writer.trigger(availableNow=True) if available_now else writer).start()
    if available_now:
        query.awaitTermination()
    return query, replace(topic, rows=replay(rows.sparkSession, f"{path}/rows", rows.schema), dedup=None)


def _run_feed(flow: Flow, target: str, letters: str, work: str, available_now: bool) -> list[StreamingQuery]:
    """A telemetry flow: payloads are parsed once, and both rows and letters are written.

    With deduplication the parsed rows become a table first, letters in a part of their own, and
    a query for each reads on from there.
    """
    tagged, rule = flow.tagged(), flow.stage.dedup if flow.stage is not None else None
    if rule is None:
        queries = [split_sink(tagged, LETTER, target, letters, f"{work}/sink", available_now)]
        if available_now:
            queries[0].awaitTermination()
        return queries
    parted = tagged.withColumn(_IS_LETTER, F.col(LETTER).isNotNull())
    writer = parted.writeStream.format("parquet").partitionBy(_IS_LETTER).option(
        "checkpointLocation", f"{work}/parsed/checkpoint").option("path", f"{work}/parsed/rows")
    queries = [(writer.trigger(availableNow=True) if available_now else writer).start()]
    if available_now:
        queries[0].awaitTermination()
    staged = replay(parted.sparkSession, f"{work}/parsed/rows", parted.schema)
    rows = rule.apply(staged.where(~F.col(_IS_LETTER)).drop(_IS_LETTER, LETTER), flow.feed.ts, flow.delay)
    for df, path, name in ((rows, target, "sink"), (staged.where(_IS_LETTER).select(LETTER), letters, "letters-sink")):
        queries.append(stream_sink(df, path, f"{work}/{name}", available_now=available_now))
        if available_now:
            queries[-1].awaitTermination()
    return queries


def run_flow(
    flow: Flow, target: str, work: str, available_now: bool = True, partitions: int | None = None,
    letters: str | None = None, groups: int | None = None,
) -> list[StreamingQuery]:
    """Start a streaming flow into a table at ``target``; state and checkpoints go below ``work``.

    A telemetry flow writes the letters of payloads that do not parse to ``letters`` (default:
    ``letters`` below ``work``).

    A join flow whose topics are deduplicated by the join's own keys is one query, with keys in
    ``groups`` as in ``dedup_join_stream``.  Any other runs as up to three: Spark takes no watermark
    after a custom stateful step, so each deduplicated topic becomes a table that the join reads on.
    With ``available_now`` the queries run one after the other over what is there.
    """
    spark = (flow.feed or flow.topics[0]).rows.sparkSession
    queries = []
    with rocksdb_state(spark, partitions):
        if flow.feed is not None:
            return _run_feed(flow, target, letters or f"{work}/letters", work, available_now)
        if flow.join is not None and not flow.in_one_step():
            topics = []
            for side, topic in zip(("left", "right"), flow.topics):
                if topic.dedup is not None:
                    query, topic = _stage_table(topic, flow.delay, f"{work}/{side}", available_now)
                    queries.append(query)
                topics.append(topic)
            flow = replace(flow, topics=topics)
        queries.append(stream_sink(flow.build(groups), target, f"{work}/sink", available_now=available_now))
        if available_now:
            queries[-1].awaitTermination()
    return queries
