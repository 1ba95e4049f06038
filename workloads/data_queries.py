"""Sources, sinks, stateless stage, deduplication, joins and expressions."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.functions import exprs as X
from tidegate.operators import deadletters, joins, stages
from tidegate.operators.dedup import dedup, dedup_all, dedup_sides
from tidegate.session import new_run_dir
from tidegate.sinks.tables import table_sink
from tidegate.sources import messages as M
from tidegate.sources.otlp import attribute, otlp_source
from tidegate.sources.records import read_specs
from tidegate.sources.topics import replay
from tidegate.streaming.run import drain
from workloads import inputs as I
from workloads.registry import query

H = timedelta(hours=1)
PAYLOAD = "k bigint"


# --- sources -----------------------------------------------------------------------------


@query("src_topic", f"WITH {I.EV} SELECT event_id, ts, user_id, event_type, k FROM ev")
def src_topic(spark: SparkSession, sf: str) -> DataFrame:
    schema = I.table(spark, sf, "events").schema
    raw = replay(spark, sf, schema, pattern="events.parquet").select(
        "event_id", "ts", "user_id", "event_type", F.col("props").alias("value")
    )
    good, _ = stages.decode_or_dlq(raw, PAYLOAD, "ingestor")
    return drain(good, "src-topic")


def _requests(events: DataFrame, outer: str, middle: str, inner: str, *scopes: str) -> DataFrame:
    """Export requests of up to eight events: each event is a resource, with a scope for each entry of
    ``scopes`` (its version is the position), which is the SQL of its records."""
    found = ", ".join(
        f"named_struct('scope', named_struct('name', event_type, 'version', '{i}'), '{inner}', {records})"
        for i, records in enumerate(scopes))
    entry = F.expr(f"""named_struct(
        'resource', named_struct('attributes', array(
            named_struct('key', 'user.id', 'value', named_struct('stringValue', CAST(user_id AS STRING))),
            named_struct('key', 'event.id', 'value', named_struct('stringValue', CAST(event_id AS STRING))))),
        '{middle}', array({found}))""")
    return events.groupBy(F.expr("event_id div 8").alias("request")).agg(
        F.to_json(F.struct(F.collect_list(entry).alias(outer))).alias("value"))


def _resource(key: str):
    return attribute(F.col("resource.attributes"), key)


_NANOS = "CAST(unix_micros(CAST(ts AS TIMESTAMP)) * 1000 AS STRING)"
_LOGS = ("resourceLogs", "scopeLogs", "logRecords")


@query("otlp_logs", f"""
WITH {I.EV}, bodies AS (
  SELECT *, props AS body, 'INFO' AS severity, '0' AS version FROM ev UNION ALL SELECT *, 'k=' || k, 'WARN', '0' FROM ev
  UNION ALL SELECT *, event_type, 'DEBUG', '1' FROM ev)
SELECT event_id, 'logs' AS signal, CAST(user_id AS VARCHAR) AS user_id, event_type AS scope_name, version,
       severity, body, CAST(epoch_us(ts) * 1000 AS VARCHAR) AS nanos
FROM bodies""")
def otlp_logs(spark: SparkSession, sf: str) -> DataFrame:
    log = lambda severity, body: (f"named_struct('timeUnixNano', {_NANOS}, 'severityText', '{severity}', "  # noqa: E731
                                  f"'body', named_struct('stringValue', {body}))")
    requests = _requests(I.events(spark, sf), *_LOGS,
                         f"array({log('INFO', 'props')}, {log('WARN', 'concat(chr(107), chr(61), CAST(k AS STRING))')})",
                         f"array({log('DEBUG', 'event_type')})")
    record = "timeUnixNano string, severityText string, body struct<stringValue: string>"
    return otlp_source(requests, "logs", record)[0].select(
        _resource("event.id").cast("bigint").alias("event_id"), "signal", _resource("user.id").alias("user_id"),
        F.col("scope.name").alias("scope_name"), F.col("scope.version").alias("version"),
        F.col("record.severityText").alias("severity"), F.col("record.body.stringValue").alias("body"),
        F.col("record.timeUnixNano").alias("nanos"),
    )


@query("otlp_dlq", """
SELECT '{"component":"otlp","error":"malformed payload","original_message":"' || replace(raw, '"', '\\"') || '"}' AS dead_letter
FROM (SELECT CASE event_id % 4 WHEN 0 THEN '{"resourceLogs":[' WHEN 1 THEN 'no json ' || event_type ELSE
      '{"resourceLogs":[{"scopeLogs":"' || user_id || '"}]}' END AS raw FROM events WHERE event_id % 4 < 3)""")
def otlp_dlq(spark: SparkSession, sf: str) -> DataFrame:
    """Cut off, no JSON, of the wrong shape; every fourth request is good and gives no letter."""
    payload = F.expr("""CASE event_id % 4 WHEN 0 THEN '{"resourceLogs":[' WHEN 1 THEN concat('no json ', event_type)
        WHEN 2 THEN concat('{"resourceLogs":[{"scopeLogs":"', user_id, '"}]}')
        ELSE concat('{"resourceLogs":[{"scopeLogs":[{"logRecords":[{"severityText":"', event_type, '"}]}]}]}') END""")
    return otlp_source(I.table(spark, sf, "events").select(payload.alias("value")), "logs", "severityText string")[1]


@query("otlp_traces", """
SELECT event_id, 'traces' AS signal, CAST(user_id AS VARCHAR) AS user_id, event_type AS scope_name,
       md5(CAST(event_id AS VARCHAR)) AS trace_id, 'op ' || event_type AS name, value AS seconds
FROM events""")
def otlp_traces(spark: SparkSession, sf: str) -> DataFrame:
    requests = _requests(
        I.events(spark, sf), "resourceSpans", "scopeSpans", "spans",
        "array(named_struct('traceId', md5(CAST(CAST(event_id AS STRING) AS BINARY)), 'name', 'op ' || event_type, 'seconds', value))")
    record = "traceId string, name string, seconds double"
    return otlp_source(requests, "traces", record)[0].select(
        _resource("event.id").cast("bigint").alias("event_id"), "signal", _resource("user.id").alias("user_id"),
        F.col("scope.name").alias("scope_name"), F.col("record.traceId").alias("trace_id"),
        F.col("record.name").alias("name"), F.col("record.seconds").alias("seconds"),
    )


@query("otlp_metrics", f"""
WITH {I.EV}
SELECT event_id, 'metrics' AS signal, event_type AS scope_name, name, kind, point FROM (
  SELECT *, 'value' AS name, 'gauge' AS kind, CAST(value AS DOUBLE) AS point FROM ev
  UNION ALL SELECT *, 'k', 'sum', CAST(k AS DOUBLE) FROM ev
  UNION ALL SELECT *, 'spread', 'histogram', CAST(k + 1 AS DOUBLE) FROM ev
  UNION ALL SELECT *, 'fine', 'exponentialHistogram', CAST(k + 2 AS DOUBLE) FROM ev
  UNION ALL SELECT *, 'median', 'summary', CAST(value AS DOUBLE) FROM ev)""")
def otlp_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """All five kinds of points, in two scopes."""
    def metric(name: str, kind: str, point: str) -> str:
        return f"""'{{"name":"{name}","{kind}":{{"dataPoints":[{{{point}}}]}}}}'"""

    text = lambda sql: f"' || CAST({sql} AS STRING) || '"
    first = [metric("value", "gauge", f'"asDouble":{text("value")}'), metric("k", "sum", f'"asInt":"{text("k")}"')]
    second = [metric("spread", "histogram", f'"count":"{text("k + 1")}","bucketCounts":["1","2"],"explicitBounds":[0.5]'),
              metric("fine", "exponentialHistogram", f'"count":"{text("k + 2")}","scale":3,"positive":{{"offset":1,"bucketCounts":["4"]}}'),
              metric("median", "summary", f'"quantileValues":[{{"quantile":0.5,"value":{text("value")}}}]')]
    scope = lambda parts: (
        "'{\"scope\":{\"name\":\"' || event_type || '\"},\"metrics\":[' || " + " || ',' || ".join(parts) + " || ']}'")
    entry = F.expr(
        "'{\"resource\":{\"attributes\":[{\"key\":\"event.id\",\"value\":{\"stringValue\":\"' || event_id || "
        f"'\"}}}}]}},\"scopeMetrics\":[' || {scope(first)} || ',' || {scope(second)} || ']}}'")
    requests = I.events(spark, sf).groupBy(F.expr("event_id div 8").alias("request")).agg(F.concat(
        F.lit('{"resourceMetrics":['), F.array_join(F.collect_list(entry), ","), F.lit("]}")).alias("value"))
    point = (F.when(F.col("kind") == "gauge", F.col("gauge.asDouble"))
             .when(F.col("kind") == "sum", F.col("sum.asInt").cast("double"))
             .when(F.col("kind") == "histogram", F.col("histogram.count").cast("double"))
             .when(F.col("kind") == "exponentialHistogram", F.col("exponentialHistogram.count").cast("double"))
             .otherwise(F.col("summary.quantileValues")[0]["value"]))
    return otlp_source(requests, "metrics")[0].select(
        _resource("event.id").cast("bigint").alias("event_id"), "signal", F.col("scope.name").alias("scope_name"),
        "name", "kind", point.alias("point"))


@query("seq_scan", f"""
WITH {I.MSGS} SELECT m.stream, m.seq, m.subject, m.data, m.time
FROM msgs m JOIN (SELECT stream, (min(seq) + max(seq)) // 2 AS lo, max(seq) AS hi FROM msgs GROUP BY stream) r
  ON m.stream = r.stream AND m.seq BETWEEN r.lo AND r.hi""")
def seq_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The newer half of every stream's sequence range."""
    msgs = I.messages(spark, sf).drop("value")
    ranges = M.seq_range(msgs).selectExpr("stream", "(first_seq + last_seq) div 2 AS lo", "last_seq AS hi")
    return M.scan_ranges(msgs, ranges)


@query("seq_range", f"""
WITH {I.MSGS} SELECT stream, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS msgs FROM msgs GROUP BY stream""")
def seq_range(spark: SparkSession, sf: str) -> DataFrame:
    return M.seq_range(I.messages(spark, sf))


@query("seq_gap_ranges", f"""
WITH {I.MSGS}, steps AS (SELECT stream, seq, lag(seq) OVER (PARTITION BY stream ORDER BY seq) AS prev FROM msgs)
SELECT stream, prev + 1 AS lo, seq - 1 AS hi, seq - prev - 1 AS n FROM steps WHERE seq - prev > 1""")
def seq_gap_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return M.seq_gap_ranges(I.messages(spark, sf))


@query("seq_gaps", f"""
WITH {I.MSGS}, alls AS (
  SELECT stream, unnest(generate_series(min(seq), max(seq))) AS seq FROM msgs GROUP BY stream)
SELECT a.stream, a.seq FROM alls a ANTI JOIN msgs m ON a.stream = m.stream AND a.seq = m.seq""")
def seq_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return M.seq_gaps(I.messages(spark, sf))


@query("spec_decode", """
WITH s AS (SELECT 'p' || c_custkey AS pipeline_id, *, '{' AS brace FROM customer),
j AS (SELECT *, CASE WHEN c_mktsegment = 'BUILDING' THEN 'inline' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'blank'
                     WHEN c_mktsegment = 'MACHINERY' THEN 'broken' ELSE 'stored' END AS kind FROM s),
r AS (SELECT *, CASE WHEN kind = 'inline' AND c_acctbal < 0 THEN 'no config' WHEN kind = 'blank' THEN 'empty config'
                     WHEN kind = 'broken' THEN 'malformed config' WHEN length(pipeline_id) < 5 THEN 'pipeline id too short'
                     WHEN c_nationkey = 7 THEN 'unknown source type' ELSE '' END AS reason FROM j)
SELECT pipeline_id, reason, CASE WHEN reason = '' THEN 'kafka' ELSE '' END AS source_type,
       CASE WHEN reason = '' THEN 'orders.' || c_nationkey ELSE '' END AS topic_name,
       CASE WHEN reason = '' THEN CAST(c_nationkey AS BIGINT) * 60000000000 ELSE -1 END AS dedup_window,
       CASE WHEN reason = '' THEN c_acctbal > 1000 ELSE FALSE END AS dedup_enabled
FROM r""")
def spec_decode(spark: SparkSession, sf: str) -> DataFrame:
    config = F.expr("""to_json(named_struct(
        'sources', named_struct('type', CASE WHEN c_nationkey = 7 THEN 'files' ELSE 'kafka' END, 'topics', array(named_struct(
            'topic_name', 'orders.' || CAST(c_nationkey AS STRING), 'dedup_window', CAST(c_nationkey AS BIGINT) * 60000000000,
            'deduplication', named_struct('enabled', c_acctbal > 1000)))),
        'sink', named_struct('type', 'clickhouse'),
        'transform', named_struct('is_filter_enabled', true)))""")
    segment = F.col("c_mktsegment")
    rows = I.table(spark, sf, "customer").select(
        F.expr("'p' || CAST(c_custkey AS STRING)").alias("pipeline_id"),
        F.when(segment == "BUILDING", F.lit(None)).when(segment == "AUTOMOBILE", "")
        .when(segment == "MACHINERY", '{"sources": {"type": ').otherwise(config).alias("stored_config"),
        F.when((segment == "BUILDING") & (F.col("c_acctbal") >= 0), config).otherwise("").alias("inline_config"),
    )
    good, bad = read_specs(rows)
    topic = F.col("sources.topics")[0]
    return good.select(
        "pipeline_id", F.lit("").alias("reason"), F.col("sources.type").alias("source_type"),
        topic["topic_name"].alias("topic_name"), topic["dedup_window"].alias("dedup_window"),
        topic["deduplication"]["enabled"].alias("dedup_enabled"),
    ).unionByName(bad.select(
        "pipeline_id", "reason", F.lit("").alias("source_type"), F.lit("").alias("topic_name"),
        F.lit(-1).cast("bigint").alias("dedup_window"), F.lit(False).alias("dedup_enabled"),
    ))


# --- sinks and dead letters --------------------------------------------------------------


@query("sink_roundtrip", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def sink_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    target = new_run_dir(spark, "sink-roundtrip")
    table_sink(I.table(spark, sf, "events"), target, "append", writers=4)
    return spark.read.parquet(target)


def _letters(spark: SparkSession, sf: str) -> DataFrame:
    return deadletters.to_dlq(
        I.events(spark, sf), F.col("event_type"), F.col("props"),
        error=F.expr("CASE WHEN value > 50 THEN 'bad \"value\"' ELSE '' END"),
        reason=F.expr("CASE WHEN k < 50 THEN 'low' END"), keep=("event_id",),
    )


@query("dlq_encode", f"""
WITH {I.EV}
SELECT event_id, '{{"component":"' || event_type || '"' ||
       CASE WHEN value > 50 THEN ',"error":"bad \\"value\\""' ELSE '' END ||
       ',"original_message":"' || replace(props, '"', '\\"') || '"' ||
       CASE WHEN k < 50 THEN ',"reason":"low"' ELSE '' END || '}}' AS dead_letter
FROM ev""")
def dlq_encode(spark: SparkSession, sf: str) -> DataFrame:
    return _letters(spark, sf)


@query("dlq_decode", f"""
WITH {I.EV}
SELECT event_id, event_type AS component, CASE WHEN value > 50 THEN 'bad "value"' ELSE '' END AS error,
       props AS original_message, CASE WHEN k < 50 THEN 'low' ELSE '' END AS reason FROM ev""")
def dlq_decode(spark: SparkSession, sf: str) -> DataFrame:
    return deadletters.from_dlq(_letters(spark, sf))


# --- stateless stage ---------------------------------------------------------------------


@query("stage_filter", "SELECT * FROM events WHERE event_type <> 'error' AND value > 10")
def stage_filter(spark: SparkSession, sf: str) -> DataFrame:
    return stages.filter_stage(I.table(spark, sf, "events"), "event_type <> 'error' AND value > 10")


@query("stage_transform", f"""
WITH {I.EV} SELECT event_id AS id, 'user-' || user_id AS user_name, upper(event_type) AS kind, k * 2 AS twice FROM ev""")
def stage_transform(spark: SparkSession, sf: str) -> DataFrame:
    return stages.transform_stage(I.events(spark, sf), {
        "id": "event_id", "user_name": "'user-' || CAST(user_id AS STRING)", "kind": "upper(event_type)", "twice": "k * 2",
    })


def _half_broken(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads; those of ``error`` events have lost their closing brace."""
    return I.table(spark, sf, "events").select(
        "event_id", F.expr("CASE WHEN event_type = 'error' THEN rtrim('}', props) ELSE props END").alias("value")
    )


@query("decode_ok", f"WITH {I.EV} SELECT event_id, k FROM ev WHERE event_type <> 'error'")
def decode_ok(spark: SparkSession, sf: str) -> DataFrame:
    return stages.decode_or_dlq(_half_broken(spark, sf), PAYLOAD, "ingestor")[0]


@query("decode_dlq", """
SELECT '{"component":"ingestor","error":"malformed payload","original_message":"' ||
       replace(rtrim(props, '}'), '"', '\\"') || '"}' AS dead_letter
FROM events WHERE event_type = 'error'""")
def decode_dlq(spark: SparkSession, sf: str) -> DataFrame:
    return stages.decode_or_dlq(_half_broken(spark, sf), PAYLOAD, "ingestor")[1]


@query("limits_effective", """
SELECT c_custkey, CASE WHEN c_nationkey = 0 THEN 604800000000000 ELSE CAST(c_nationkey AS BIGINT) * 3600000000000 END AS max_age_ns,
       CASE WHEN c_acctbal < 0 OR c_custkey = 0 THEN 107374182400 ELSE CAST(c_custkey AS BIGINT) * 1024 END AS max_bytes,
       CASE WHEN c_mktsegment = 'BUILDING' THEN 500000 WHEN c_mktsegment = 'MACHINERY' THEN -1 WHEN c_custkey = 0 THEN 500000 ELSE c_custkey END AS max_msgs
FROM customer""")
def limits_effective(spark: SparkSession, sf: str) -> DataFrame:
    specs = I.table(spark, sf, "customer").selectExpr(
        "c_custkey", "CAST(c_nationkey AS BIGINT) * 3600000000000 AS max_age_ns",
        "CASE WHEN c_acctbal >= 0 THEN CAST(c_custkey AS BIGINT) * 1024 END AS max_bytes",
        "CASE c_mktsegment WHEN 'BUILDING' THEN 0L WHEN 'MACHINERY' THEN -1L ELSE c_custkey END AS max_msgs",
    )
    return stages.effective_limits(specs)


# --- deduplication -----------------------------------------------------------------------


def kept_sql(keys: str, span: str, source: str = "events", name: str = "kept") -> str:
    """CTEs that end in ``name(event_id)``: the rows the windowed rule keeps.

    Every row is linked to the first one a window later, then the links are followed.
    """
    return f"""{name}_rows AS (SELECT {keys}, ts, min(event_id) AS event_id FROM {source} GROUP BY {keys}, ts),
{name}_next AS (
  SELECT event_id, first_value(event_id) OVER (
    PARTITION BY {keys} ORDER BY ts RANGE BETWEEN INTERVAL {span} FOLLOWING AND UNBOUNDED FOLLOWING) AS next_id
  FROM {name}_rows),
{name} AS (
  SELECT arg_min(event_id, ts) AS event_id FROM {name}_rows GROUP BY {keys}
  UNION ALL SELECT n.next_id FROM {name} t JOIN {name}_next n ON t.event_id = n.event_id
  WHERE n.next_id IS NOT NULL)"""


@query("dedup_window", f"""
WITH RECURSIVE {kept_sql('user_id, event_type', '6 HOURS')} SELECT e.* FROM events e SEMI JOIN kept USING (event_id)""")
def dedup_window(spark: SparkSession, sf: str) -> DataFrame:
    return dedup(I.table(spark, sf, "events"), ["user_id", "event_type"], "ts", 6 * H, ["event_id"])


@query("dedup_hot_key", f"""
WITH RECURSIVE {kept_sql('event_type', '1 HOUR')} SELECT e.* FROM events e SEMI JOIN kept USING (event_id)""")
def dedup_hot_key(spark: SparkSession, sf: str) -> DataFrame:
    """Five keys share all rows: the plan that cuts heavy keys into slices, at any data size."""
    return dedup(I.table(spark, sf, "events"), ["event_type"], "ts", H, ["event_id"], hot_rows=0)


_TYPED = "date_trunc('hour', ts) + INTERVAL 1 MICROSECOND * (event_id % 3)"


@query("dedup_ts_key", f"""
WITH RECURSIVE typed AS (SELECT event_id, ts, {_TYPED} AS slot FROM events), {kept_sql('slot', '10 MINUTES', 'typed')}
SELECT typed.* FROM typed SEMI JOIN kept USING (event_id)""")
def dedup_ts_key(spark: SparkSession, sf: str) -> DataFrame:
    """Keys are times a microsecond apart."""
    return dedup(_typed(spark, sf), ["slot"], "ts", H / 6, ["event_id"])


@query("dedup_ts_key_hot", f"""
WITH RECURSIVE typed AS (SELECT event_id, ts, {_TYPED} AS slot FROM events), {kept_sql('slot', '10 MINUTES', 'typed')}
SELECT typed.* FROM typed SEMI JOIN kept USING (event_id)""")
def dedup_ts_key_hot(spark: SparkSession, sf: str) -> DataFrame:
    """The same through the plan for hot keys."""
    return dedup(_typed(spark, sf), ["slot"], "ts", H / 6, ["event_id"], hot_rows=0)


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    return I.table(spark, sf, "events").selectExpr(
        "event_id", "ts", "date_trunc('hour', ts) + make_dt_interval(0, 0, 0, CAST((event_id % 3) / 1e6 AS DECIMAL(18, 6))) AS slot"
    ).withColumn("slot", F.col("slot").cast("timestamp_ntz"))


@query("dedup_null_time", f"""
WITH RECURSIVE timed AS (SELECT event_id, event_type, CASE WHEN event_id % 10 > 0 THEN ts END AS ts FROM events),
known AS (SELECT * FROM timed WHERE ts IS NOT NULL), {kept_sql('event_type', '1 HOUR', 'known')}
SELECT timed.* FROM timed SEMI JOIN kept USING (event_id) UNION ALL SELECT * FROM timed WHERE ts IS NULL""")
def dedup_null_time(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without a time are kept and disturb no other."""
    timed = I.table(spark, sf, "events").selectExpr(
        "event_id", "event_type", "CASE WHEN event_id % 10 > 0 THEN ts END AS ts")
    return dedup(timed, ["event_type"], "ts", H, ["event_id"])


@query("dedup_all", """
SELECT event_id, ts, user_id, event_type, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""")
def dedup_all_rows(spark: SparkSession, sf: str) -> DataFrame:
    return dedup_all(I.table(spark, sf, "events"), ["user_id", "event_type"], "ts", ["event_id"])


@query("dedup_per_side", f"""
WITH RECURSIVE views AS (SELECT * FROM events WHERE event_type <> 'purchase'),
buys AS (SELECT * FROM events WHERE event_type = 'purchase'),
{kept_sql('user_id', '24 HOURS', 'views', 'kept_views')}
SELECT 'left' AS side, event_id, ts, user_id FROM views SEMI JOIN kept_views USING (event_id)
UNION ALL SELECT 'right', event_id, ts, user_id FROM buys""")
def dedup_per_side(spark: SparkSession, sf: str) -> DataFrame:
    """The left topic with a window of a day, the right one with its switch off."""
    ev = I.table(spark, sf, "events")
    left, right = dedup_sides(
        ev.where("event_type <> 'purchase'"), ev.where("event_type = 'purchase'"), "ts", ["event_id"],
        left_rule=(["user_id"], 24 * H),
    )
    cols = ["event_id", "ts", "user_id"]
    return left.select(F.lit("left").alias("side"), *cols).unionByName(right.select(F.lit("right").alias("side"), *cols))


# --- joins -------------------------------------------------------------------------------


def sides(ev: DataFrame) -> tuple[DataFrame, DataFrame]:
    left = ev.where("event_type <> 'purchase'").select(
        "user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("view_ts"), F.col("value").alias("view_value"))
    right = ev.where("event_type = 'purchase'").select(
        "user_id", F.col("event_id").alias("buy_id"), F.col("ts").alias("buy_ts"), F.col("value").alias("buy_value"))
    return left, right


_SIDES = """l AS (SELECT user_id, event_id AS view_id, ts AS view_ts, value AS view_value FROM events WHERE event_type <> 'purchase'),
r AS (SELECT user_id, event_id AS buy_id, ts AS buy_ts, value AS buy_value FROM events WHERE event_type = 'purchase')"""
JOIN_SQL = f"""
WITH {_SIDES} SELECT l.*, r.buy_id, r.buy_ts, r.buy_value FROM l JOIN r ON l.user_id = r.user_id
  AND r.buy_ts BETWEEN l.view_ts - INTERVAL 1 HOUR AND l.view_ts + INTERVAL 2 HOURS"""


@query("temporal_join", JOIN_SQL)
def temporal_join(spark: SparkSession, sf: str) -> DataFrame:
    left, right = sides(I.table(spark, sf, "events"))
    return joins.temporal_join(left, right, ["user_id"], "view_ts", "buy_ts", 2 * H, H)


@query("temporal_join_orders", """
SELECT o_orderkey, o_custkey, o_orderdate, l_linenumber, l_shipdate, l_extendedprice
FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  AND l_shipdate BETWEEN o_orderdate - INTERVAL 1 DAY AND o_orderdate + INTERVAL 30 DAYS""")
def temporal_join_orders(spark: SparkSession, sf: str) -> DataFrame:
    left = I.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    right = I.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_shipdate", "l_extendedprice")
    return joins.temporal_join(
        left, right, ["o_orderkey"], "o_orderdate", "l_shipdate", timedelta(days=30), timedelta(days=1))


@query("latest_join", f"""
WITH {_SIDES}, dear AS (SELECT user_id, buy_ts, arg_max(buy_id, buy_id) AS buy_id, arg_max(buy_value, buy_id) AS buy_value
                        FROM r GROUP BY user_id, buy_ts)
SELECT l.*, d.buy_id, d.buy_ts, d.buy_value FROM l ASOF JOIN dear d ON l.user_id = d.user_id AND l.view_ts >= d.buy_ts
WHERE d.buy_ts >= l.view_ts - INTERVAL 6 HOURS""")
def latest_join(spark: SparkSession, sf: str) -> DataFrame:
    left, right = sides(I.table(spark, sf, "events"))
    return joins.latest_join(left, right, ["user_id"], "view_ts", "buy_ts", 6 * H, ["buy_id"])


_BY_KIND = """l AS (SELECT event_type AS kind, event_id AS cheap_id, ts AS cheap_ts FROM events WHERE value < 50),
r AS (SELECT event_type AS kind, event_id AS dear_id, ts AS dear_ts FROM events WHERE value >= 50)"""


def _by_kind(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    ev = I.table(spark, sf, "events")
    return (
        ev.where("value < 50").selectExpr("event_type AS kind", "event_id AS cheap_id", "ts AS cheap_ts"),
        ev.where("value >= 50").selectExpr("event_type AS kind", "event_id AS dear_id", "ts AS dear_ts"),
    )


@query("latest_join_hot_key", f"""
WITH {_BY_KIND}, d AS (SELECT kind, dear_ts, max(dear_id) AS dear_id FROM r GROUP BY kind, dear_ts)
SELECT l.*, d.dear_id, d.dear_ts FROM l ASOF JOIN d ON l.kind = d.kind AND l.cheap_ts >= d.dear_ts
WHERE d.dear_ts >= l.cheap_ts - INTERVAL 6 HOURS""")
def latest_join_hot_key(spark: SparkSession, sf: str) -> DataFrame:
    """Five keys share all rows: the plan that cuts them into slices, at any data size."""
    left, right = _by_kind(spark, sf)
    return joins.latest_join(left, right, ["kind"], "cheap_ts", "dear_ts", 6 * H, ["dear_id"], hot_rows=0)


@query("temporal_join_hot_key", f"""
WITH {_BY_KIND} SELECT l.*, r.dear_id, r.dear_ts FROM l JOIN r ON l.kind = r.kind
  AND r.dear_ts BETWEEN l.cheap_ts - INTERVAL 1 MINUTE AND l.cheap_ts + INTERVAL 2 MINUTES""")
def temporal_join_hot_key(spark: SparkSession, sf: str) -> DataFrame:
    """The same five keys in a temporal join, with both sides salted."""
    left, right = _by_kind(spark, sf)
    minute = timedelta(minutes=1)
    return joins.temporal_join(left, right, ["kind"], "cheap_ts", "dear_ts", 2 * minute, minute, hot_rows=0)


@query("consumer_label", f"""
WITH {I.MSGS}, {I.COMPONENTS}
SELECT m.stream, m.seq, coalesce(c.component, 'no consumer') AS component FROM msgs m LEFT JOIN components c ON m.stream = c.stream""")
def consumer_label(spark: SparkSession, sf: str) -> DataFrame:
    msgs = I.messages(spark, sf)
    good, bad = joins.consumer_map_join(msgs, I.components(msgs))
    return good.select("stream", "seq", "component").unionByName(
        bad.select("stream", "seq", F.lit("no consumer").alias("component")))


# --- expressions -------------------------------------------------------------------------


@query("x_short_hash", "SELECT DISTINCT user_id, substr(sha256('pipe-' || user_id), 1, 8) AS short FROM events")
def x_short_hash(spark: SparkSession, sf: str) -> DataFrame:
    pipeline = F.concat(F.lit("pipe-"), F.col("user_id").cast("string"))
    return I.table(spark, sf, "events").select("user_id", X.short_hash(pipeline).alias("short")).distinct()


@query("x_shard_name", """
SELECT p_partkey, substr('etl-' || substr(sha256(p_name), 1, 8) || '-' || translate(p_name || '/' || p_type || '.' || repeat('x', p_size * 6), '. /', '___') || '-out', 1, 256)
       || '_' || p_size AS name FROM part""")
def x_shard_name(spark: SparkSession, sf: str) -> DataFrame:
    node = F.expr("p_name || '/' || p_type || '.' || repeat('x', p_size * 6)")
    return I.table(spark, sf, "part").select(
        "p_partkey", X.shard_name(I.PREFIX, F.col("p_name"), node, F.col("p_size")).alias("name"))


@query("x_bytes", """
SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN p_size WHEN 1 THEN p_size * 1024 WHEN 2 THEN CAST(p_size * 1073741824 + 536870912 AS BIGINT)
       WHEN 3 THEN p_size * 1048576 WHEN 7 THEN CAST(p_size AS BIGINT) * 1099511627776 ELSE -1 END AS bytes,
       CASE p_partkey % 8 WHEN 0 THEN p_size WHEN 1 THEN p_size * 1024 WHEN 2 THEN CAST(p_size * 1073741824 + 536870912 AS BIGINT)
       WHEN 3 THEN p_size * 1048576 WHEN 7 THEN CAST(p_size AS BIGINT) * 1099511627776 ELSE 107374182400 END AS lenient
FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part)""")
def x_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes spelled in eight ways; three of them are invalid."""
    text = F.expr("""CASE p_partkey % 8 WHEN 0 THEN CAST(p_size AS STRING) WHEN 1 THEN CAST(p_size AS STRING) || 'KB'
        WHEN 2 THEN CAST(p_size AS STRING) || '.5gb' WHEN 3 THEN ' ' || CAST(p_size AS STRING) || 'Mb '
        WHEN 4 THEN CAST(p_size AS STRING) || ' GB' WHEN 5 THEN CAST(p_size AS STRING) || 'Gi'
        WHEN 6 THEN ' ' || CAST(p_size AS STRING) ELSE CAST(p_size AS STRING) || 'TB' END""")
    return I.table(spark, sf, "part").select(
        "p_partkey", F.coalesce(X.parse_bytes(text), F.lit(-1)).alias("bytes"),
        X.parse_bytes_or_default(text).alias("lenient"))


@query("x_rfc3339", """
SELECT event_id, regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0+$', '') || 'Z' AS nano,
       strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS plain, ts AS back, ts - INTERVAL 2 HOURS AS shifted,
       FALSE AS loose FROM events""")
def x_rfc3339(spark: SparkSession, sf: str) -> DataFrame:
    nano = X.format_rfc3339_nano(F.col("ts"))
    ahead = F.regexp_replace(nano, "Z$", "+02:00")
    return I.table(spark, sf, "events").select(
        "event_id", nano.alias("nano"), X.format_rfc3339(F.col("ts")).alias("plain"),
        X.parse_rfc3339(nano).cast("timestamp_ntz").alias("back"),
        X.parse_rfc3339(ahead).cast("timestamp_ntz").alias("shifted"),
        X.parse_rfc3339(F.translate(nano, "T", " ")).isNotNull().alias("loose"),
    )


@query("x_random_id", "SELECT count(*) AS n, TRUE AS all_distinct FROM events")
def x_random_id(spark: SparkSession, sf: str) -> DataFrame:
    ids = I.table(spark, sf, "events").select(X.random_id().alias("id"))
    per_id = ids.groupBy("id").agg(F.count(F.lit(1)).alias("c"))
    return per_id.agg(F.sum("c").alias("n"), (F.max("c") == 1).alias("all_distinct"))
