"""Flows from source to sink, and the streaming forms."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.functions.exprs import micros
from tidegate.operators.metrics import counter_stream
from tidegate.plans.flows import DedupRule, Feed, Flow, Input, Stage, TemporalJoin, Topic
from tidegate.session import new_run_dir
from tidegate.sinks.tables import table_sink
from tidegate.sources.records import read_specs
from tidegate.sources.topics import replay
from tidegate.streaming.dedup_stream import dedup_stream
from tidegate.streaming.joins import temporal_join_stream
from tidegate.streaming.run import drain, run_flow
from workloads import inputs as I
from workloads.data_queries import JOIN_SQL, kept_sql, sides
from workloads.registry import query

H = timedelta(hours=1)
# Parts of the time that a table is replayed in.
PARTS = 4
# Rows of a replayed table that share an entry of the state.
GROUP_ROWS = 50_000
# A time after all data: its row lifts the watermark past everything and stays in state itself.
END_OF_TIME = "2100-01-01 00:00:00"


@query("pipe_plain", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def pipe_plain(spark: SparkSession, sf: str) -> DataFrame:
    rows = Flow("plain-flow", [Topic(I.table(spark, sf, "events"), "ts")]).build()
    target = new_run_dir(spark, "pipe-plain")
    table_sink(rows, target)
    return spark.read.parquet(target)


@query("pipe_stage", f"""
WITH RECURSIVE {I.EV}, big AS (SELECT event_id, ts, user_id, upper(event_type) AS kind, k FROM ev WHERE value > 5),
{kept_sql('user_id, kind', '6 HOURS', 'big')}
SELECT big.* FROM big SEMI JOIN kept USING (event_id)""")
def pipe_stage(spark: SparkSession, sf: str) -> DataFrame:
    stage = Stage(
        where="value > 5",
        columns={"event_id": "event_id", "ts": "ts", "user_id": "user_id", "kind": "upper(event_type)", "k": "k"},
        dedup=DedupRule(["user_id", "kind"], 6 * H, "event_id"),
    )
    return Flow("stage-flow", [Topic(I.events(spark, sf), "ts")], stage=stage).build()


PIPE_JOIN_SQL = f"""
WITH RECURSIVE views AS (SELECT * FROM events WHERE event_type <> 'purchase'),
buys AS (SELECT * FROM events WHERE event_type = 'purchase'),
{kept_sql('user_id', '1 HOUR', 'views', 'kept_views')}, {kept_sql('user_id', '6 HOURS', 'buys', 'kept_buys')}
SELECT l.user_id, l.event_id AS view_id, l.ts AS view_ts, l.value AS view_value,
       r.event_id AS buy_id, r.ts AS buy_ts, r.value AS buy_value
FROM (SELECT * FROM views SEMI JOIN kept_views USING (event_id)) l
JOIN (SELECT * FROM buys SEMI JOIN kept_buys USING (event_id)) r ON l.user_id = r.user_id
  AND r.ts BETWEEN l.ts - INTERVAL 12 HOURS AND l.ts + INTERVAL 24 HOURS"""


def _join_flow(left: DataFrame, right: DataFrame, delay: str = "0 seconds") -> Flow:
    """Two topics, each deduplicated in its own window, joined in time."""
    return Flow(
        "join-flow",
        [
            Topic(left, "view_ts", DedupRule(["user_id"], H, "view_id")),
            Topic(right, "buy_ts", DedupRule(["user_id"], 6 * H, "buy_id")),
        ],
        join=TemporalJoin(["user_id"], 24 * H, 12 * H),
        delay=delay,
    )


@query("pipe_join", PIPE_JOIN_SQL)
def pipe_join(spark: SparkSession, sf: str) -> DataFrame:
    return _join_flow(*sides(I.table(spark, sf, "events"))).build()


SPEC = """{"sources": {"type": "kafka", "topics": [
    {"topic_name": "views", "dedup_window": 3600000000000, "deduplication": {"enabled": true}},
    {"topic_name": "buys", "dedup_window": 21600000000000, "deduplication": {"enabled": true}}]},
  "join": {"type": "temporal", "enabled": true, "left_buffer_ttl": 86400000000000, "right_buffer_ttl": 43200000000000},
  "sink": {"type": "clickhouse"}, "transform": {}}"""


@query("pipe_from_spec", PIPE_JOIN_SQL)
def pipe_from_spec(spark: SparkSession, sf: str) -> DataFrame:
    """The joined flow as a stored spec describes it."""
    stored = spark.createDataFrame([("join-flow", SPEC, "")], "pipeline_id string, stored_config string, inline_config string")
    spec = read_specs(stored)[0].first()
    views, buys = sides(I.table(spark, sf, "events"))
    inputs = {"views": Input(views, "view_ts", ["user_id"], "view_id"), "buys": Input(buys, "buy_ts", ["user_id"], "buy_id")}
    return Flow.from_spec(spec, inputs, on=["user_id"]).build()


@query("pipe_otlp", f"""
WITH RECURSIVE kinds AS (SELECT event_id, ts, event_type AS kind, value FROM events WHERE value > 5),
{kept_sql('kind', '30 MINUTES', 'kinds')}
SELECT kinds.* FROM kinds SEMI JOIN kept USING (event_id)""")
def pipe_otlp(spark: SparkSession, sf: str) -> DataFrame:
    payload = F.expr("""to_json(named_struct('resourceLogs', array(named_struct('scopeLogs', array(named_struct(
        'scope', named_struct('name', event_type),
        'logRecords', array(named_struct('id', event_id, 'at', unix_micros(CAST(ts AS TIMESTAMP)), 'value', value))))))))""")
    feed = Feed(
        I.table(spark, sf, "events").select(payload.alias("value")), "logs",
        "id bigint, at bigint, value double",
        {"event_id": "record.id", "ts": "CAST(timestamp_micros(record.at) AS TIMESTAMP_NTZ)", "kind": "scope.name",
         "value": "record.value"},
        "ts",
    )
    stage = Stage(where="value > 5", dedup=DedupRule(["kind"], timedelta(minutes=30), "event_id"))
    return Flow("otlp-flow", feed=feed, stage=stage).build()


_REQUEST = """'{"resourceLogs":[{"scopeLogs":[{"scope":{"name":"' || event_type || '"},"logRecords":[{"id":' || %s || '}]}]}]}'"""
_CUT = """'{"resourceLogs":[{"scopeLogs":"' || %s || '"}]}'"""


@query("pipe_otlp_letters", f"""
SELECT event_id, event_type AS kind, CAST(NULL AS VARCHAR) AS dead_letter FROM events WHERE event_id % 4 <> 1 AND event_type <> 'view'
UNION ALL
SELECT NULL, NULL, '{{"component":"otlp-flow","error":"malformed payload","original_message":"' ||
  replace({_CUT % 'event_id'}, '"', '\\"') || '"}}' FROM events WHERE event_id % 4 = 1""")
def pipe_otlp_letters(spark: SparkSession, sf: str) -> DataFrame:
    """A telemetry flow on a stream: what its two tables hold, every fourth payload being malformed."""
    events = I.table(spark, sf, "events")
    payload = F.expr(f"CASE WHEN event_id % 4 = 1 THEN {_CUT % 'event_id'} ELSE {_REQUEST % 'event_id'} END")
    stream = _as_stream(events.select("ts", payload.alias("value")), "ts", "letters-input", _cuts(events, "ts"))
    feed = Feed(stream.select("value"), "logs", "id bigint", {"event_id": "record.id", "kind": "scope.name"}, "ts")
    run = new_run_dir(spark, "otlp-flow")
    run_flow(Flow("otlp-flow", feed=feed, stage=Stage(where="kind <> 'view'")), f"{run}/table", f"{run}/work",
             letters=f"{run}/letters")
    nothing = F.lit(None).cast("string")
    rows = spark.read.parquet(f"{run}/table").select("event_id", "kind", nothing.alias("dead_letter"))
    letters = spark.read.parquet(f"{run}/letters")
    return rows.unionByName(letters.select(F.lit(None).cast("bigint").alias("event_id"), nothing.alias("kind"), "dead_letter"))


# --- streams -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Cuts:
    """Times (microseconds) that cut a table into ``PARTS``, how late a row of a part may come, and the
    number of rows."""

    at: list[int]
    late: str
    rows: int = 0


def _cuts(rows: DataFrame, ts: str) -> Cuts:
    """Measured on the column, whatever span of time it covers."""
    at = micros(F.col(ts))
    shares = [i / PARTS for i in range(1, PARTS)]
    first, last, inner, n = rows.agg(F.min(at), F.max(at), F.percentile_approx(at, shares), F.count(F.lit(1))).first()
    if first is None:
        return Cuts([], "0 seconds")
    edges = [first, *inner, last]
    return Cuts(inner, f"{max(b - a for a, b in zip(edges, edges[1:])) // 10**6 + 2} seconds", n)


def _as_stream(rows: DataFrame, ts: str, label: str, cuts: Cuts, end_row: DataFrame | None = None) -> DataFrame:
    """Write the rows part by part as files and read them back in that order.

    Files of one part come in any order, so a row may be as late as the longest part is
    long.  Rows without a time come with the first part.
    """
    spark = rows.sparkSession
    path = new_run_dir(spark, label)
    part = F.size(F.filter(F.array(*map(F.lit, cuts.at)).cast("array<bigint>"), lambda c: c < micros(F.col(ts))))
    for number in range(PARTS):
        table_sink(rows.where(F.coalesce(part, F.lit(0)) == number if cuts.at else F.lit(number == 0)), f"{path}/{number}")
    if end_row is not None:
        table_sink(end_row.coalesce(1), f"{path}/end")
    return replay(spark, f"{path}/*", rows.schema, streaming=True, files_per_batch=_cores(spark))


def _cores(spark: SparkSession) -> int:
    """One part of the state per core of the cluster."""
    return spark.sparkContext.defaultParallelism


def _groups(spark: SparkSession, rows: int) -> int:
    """Groups of keys in the state: a few per part, and as many as keep the rows of one in bounds."""
    return max(4 * _cores(spark), -(-rows // GROUP_ROWS))


def _zoned(rows: DataFrame, *cols: str) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("timestamp") for c in cols})


def _plain(rows: DataFrame, *cols: str) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


def _end_row(rows: DataFrame, ts: str) -> DataFrame:
    """One row like the others but at the end of time."""
    return rows.limit(1).withColumn(ts, F.lit(END_OF_TIME).cast("timestamp"))


@query("dedup_stream", f"""
WITH RECURSIVE {kept_sql('user_id, event_type', '6 HOURS')} SELECT e.* FROM events e SEMI JOIN kept USING (event_id)""")
def dedup_stream_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _dedup_stream(spark, sf, ["user_id", "event_type"], 6 * H)


def _dedup_stream(spark: SparkSession, sf: str, keys: list[str], window: timedelta) -> DataFrame:
    rows = _zoned(I.table(spark, sf, "events"), "ts")
    cuts = _cuts(rows, "ts")
    stream = _as_stream(rows, "ts", "dedup-input", cuts, _end_row(rows, "ts"))
    kept = dedup_stream(stream, keys, "ts", window, "event_id", cuts.late, groups=_groups(spark, cuts.rows))
    return _plain(drain(kept, "dedup", partitions=_cores(spark)), "ts")


@query("dedup_stream_all", """
SELECT event_id, ts, user_id, event_type, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""")
def dedup_stream_all(spark: SparkSession, sf: str) -> DataFrame:
    """Window 0: the first row of each key for good."""
    return _dedup_stream(spark, sf, ["user_id", "event_type"], timedelta(0))


@query("temporal_join_stream", JOIN_SQL)
def temporal_join_stream_rows(spark: SparkSession, sf: str) -> DataFrame:
    events = _zoned(I.table(spark, sf, "events"), "ts")
    cuts = _cuts(events, "ts")
    left, right = sides(events)
    joined = temporal_join_stream(
        _as_stream(left, "view_ts", "join-left", cuts), _as_stream(right, "buy_ts", "join-right", cuts),
        ["user_id"], "view_ts", "buy_ts", 2 * H, H, cuts.late,
    )
    return _plain(drain(joined, "join", partitions=_cores(spark)), "view_ts", "buy_ts")


@query("pipe_join_stream", PIPE_JOIN_SQL)
def pipe_join_stream(spark: SparkSession, sf: str) -> DataFrame:
    events = _zoned(I.table(spark, sf, "events"), "ts")
    cuts = _cuts(events, "ts")
    left, right = sides(events)
    flow = _join_flow(
        _as_stream(left, "view_ts", "flow-left", cuts, _end_row(left, "view_ts")),
        _as_stream(right, "buy_ts", "flow-right", cuts, _end_row(right, "buy_ts")), cuts.late,
    )
    run = new_run_dir(spark, "flow")
    run_flow(flow, f"{run}/table", f"{run}/work", partitions=_cores(spark), groups=_groups(spark, cuts.rows))
    written = spark.read.option("basePath", f"{run}/table").parquet(f"{run}/table").drop("batch_id")
    return _plain(written, "view_ts", "buy_ts")


@query("counter_10s", """
SELECT time_bucket(INTERVAL 10 SECONDS, ts) AS window_start, time_bucket(INTERVAL 10 SECONDS, ts) + INTERVAL 10 SECONDS AS window_end,
       event_type, count(*) AS n FROM events GROUP BY ALL""")
def counter_10s(spark: SparkSession, sf: str) -> DataFrame:
    rows = _zoned(I.table(spark, sf, "events").select("ts", "event_type"), "ts")
    cuts = _cuts(rows, "ts")
    stream = _as_stream(rows, "ts", "counter-input", cuts, _end_row(rows, "ts"))
    return drain(counter_stream(stream, "ts", ["event_type"], late=cuts.late), "counter", partitions=_cores(spark))
