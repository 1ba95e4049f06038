"""Shards, retention, lag, sweep, status history, signals, notifications and metrics."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.functions.exprs import block_of, short_hash
from tidegate.operators import history as H
from tidegate.operators import lag as G
from tidegate.operators.blocks import SEQ_BLOCK
from tidegate.operators import metrics, notifications, retention, shards, signals, sweep
from tidegate.session import new_run_dir
from tidegate.sinks.tables import table_sink
from workloads import inputs as I
from workloads.registry import query

SHARDS = 6


# --- shards ------------------------------------------------------------------------------

_MD5_SHARD = "CAST(('0x' || substr(md5(CAST(user_id AS VARCHAR) || '|' || event_type), 1, 8))::BIGINT % {n} AS INTEGER)"


@query("shard_key", f"SELECT event_id, {_MD5_SHARD.format(n=SHARDS)} AS shard FROM events")
def shard_key(spark: SparkSession, sf: str) -> DataFrame:
    n = shards.shard_count(4, SHARDS)
    keyed = shards.shard_by_key(I.table(spark, sf, "events"), ["user_id", "event_type"], n)
    return shards.lay_out(keyed).select("event_id", "shard")


@query("sink_sharded", f"SELECT event_id, {_MD5_SHARD.format(n=SHARDS)} AS shard FROM events")
def sink_sharded(spark: SparkSession, sf: str) -> DataFrame:
    """Written with one folder per shard, a hot shard by several tasks, and read back whole."""
    target = new_run_dir(spark, "sink-sharded")
    sharded = shards.shard_by_key(I.table(spark, sf, "events"), ["user_id", "event_type"], SHARDS).select("event_id", "shard")
    table_sink(shards.lay_out(sharded), target, partition_by=["shard"])
    return spark.read.parquet(target).select("event_id", "shard")


@query("shard_rr", """
SELECT event_id, CAST((rn - 1) % 3 AS INTEGER) AS subject, CAST(((rn - 1) % 3) % 2 AS INTEGER) AS shard
FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS rn FROM events)""")
def shard_rr(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.table(spark, sf, "events")
    block = block_of(F.col("event_id"), SEQ_BLOCK)
    return shards.shard_round_robin(rows, [F.col("event_id")], block, sources=3, targets=2).select(
        "event_id", "subject", "shard")


_SHARDED = f"sharded AS (SELECT event_id, {_MD5_SHARD.format(n=SHARDS)} AS shard FROM events)"


@query("reshard", f"WITH {_SHARDED} SELECT event_id, CAST(CASE WHEN shard >= 4 THEN shard % 4 ELSE shard END AS INTEGER) AS shard FROM sharded")
def reshard(spark: SparkSession, sf: str) -> DataFrame:
    return shards.reshard(shard_key(spark, sf), SHARDS, 4)


@query("reshard_check", f"""
WITH {_SHARDED} SELECT CAST(shard % 4 AS INTEGER) AS shard, count(*) AS expected, count(*) AS found, TRUE AS conserved
FROM sharded GROUP BY shard % 4""")
def reshard_check(spark: SparkSession, sf: str) -> DataFrame:
    before = shards.shard_by_key(I.table(spark, sf, "events"), ["user_id", "event_type"], SHARDS)
    return shards.reshard_check(before, shards.reshard(before, SHARDS, 4), 4)


def _names(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pipelines, existing names, planned names): four shards exist, nation + 1 are planned."""
    owners = I.table(spark, sf, "customer").select(
        F.expr("'pipe-' || CAST(c_custkey AS STRING)").alias("pipeline_id"), "c_nationkey")
    head = F.concat(F.lit(f"{I.PREFIX}-"), short_hash(F.col("pipeline_id")))
    nodes = owners.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn(
        "name", F.concat(head, F.lit("-ingestor_0-out_"), F.col("s").cast("string")))
    letters = owners.select(F.concat(head, F.lit("-DLQ")).alias("name"))
    return (
        owners.select("pipeline_id"),
        nodes.select("name").unionByName(letters),
        nodes.where("s <= c_nationkey").select("name").unionByName(letters),
    )


@query("stale_shards", f"WITH {I.NAMES} SELECT name FROM existing ANTI JOIN planned USING (name)")
def stale_shards(spark: SparkSession, sf: str) -> DataFrame:
    _, existing, planned = _names(spark, sf)
    return shards.stale_shards(existing, planned)


@query("old_shard_count", f"WITH {I.NAMES} SELECT greatest(count(*) - 1, 0) AS old_count FROM existing")
def old_shard_count(spark: SparkSession, sf: str) -> DataFrame:
    return shards.old_shard_count(_names(spark, sf)[1])


@query("shards_of", f"WITH {I.NAMES} SELECT name, pipeline_id FROM existing")
def shards_of(spark: SparkSession, sf: str) -> DataFrame:
    pipelines, existing, _ = _names(spark, sf)
    strangers = pipelines.select(F.concat(F.lit("other-"), "pipeline_id").alias("name"))
    return shards.list_shards(existing.unionByName(strangers), I.PREFIX, pipelines)


# --- retention ---------------------------------------------------------------------------

_MSG_COLS = "stream, seq, subject, data, time"


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    return I.messages(spark, sf).drop("value")


@query("trim_age", f"WITH {I.MSGS} SELECT {_MSG_COLS} FROM msgs WHERE time >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAYS")
def trim_age(spark: SparkSession, sf: str) -> DataFrame:
    return retention.trim_age(_stored(spark, sf), timedelta(days=7), I.AS_OF)


@query("admit_msgs", f"""
WITH {I.MSGS} SELECT stream, seq, row_number() OVER (PARTITION BY stream ORDER BY seq) <= 1000 AS admitted FROM msgs""")
def admit_msgs(spark: SparkSession, sf: str) -> DataFrame:
    kept, refused = retention.admit_msgs(_stored(spark, sf), 1000)
    cols = ["stream", "seq"]
    return kept.select(*cols, F.lit(True).alias("admitted")).unionByName(
        refused.select(*cols, F.lit(False).alias("admitted")))


@query("trim_msgs", f"""
WITH {I.MSGS} SELECT {_MSG_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY stream ORDER BY seq DESC) AS rn FROM msgs) WHERE rn <= 1000""")
def trim_msgs(spark: SparkSession, sf: str) -> DataFrame:
    return retention.trim_msgs(_stored(spark, sf), 1000)


@query("admit_bytes", f"""
WITH {I.MSGS} SELECT stream, seq, sum(strlen(data)) OVER (PARTITION BY stream ORDER BY seq) <= 10240 AS admitted FROM msgs""")
def admit_bytes(spark: SparkSession, sf: str) -> DataFrame:
    kept, refused = retention.admit_bytes(_stored(spark, sf), 10240)
    cols = ["stream", "seq"]
    return kept.select(*cols, F.lit(True).alias("admitted")).unionByName(
        refused.select(*cols, F.lit(False).alias("admitted")))


@query("admit_bytes_fitting", f"""
WITH RECURSIVE {I.MSGS}, numbered AS (
  SELECT stream, seq, strlen(data) AS size, row_number() OVER (PARTITION BY stream ORDER BY seq) AS rn FROM msgs),
walk AS (
  SELECT stream, seq, rn, size <= 10240 AS admitted, CASE WHEN size <= 10240 THEN size ELSE 0 END AS used FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.stream, n.seq, n.rn, used + size <= 10240, CASE WHEN used + size <= 10240 THEN used + size ELSE used END
  FROM walk w JOIN numbered n ON n.stream = w.stream AND n.rn = w.rn + 1)
SELECT stream, seq, admitted FROM walk""")
def admit_bytes_fitting(spark: SparkSession, sf: str) -> DataFrame:
    """Single messages are refused, later ones that still fit are taken."""
    kept, refused = retention.admit_bytes(_stored(spark, sf), 10240, rule="fitting")
    cols = ["stream", "seq"]
    return kept.select(*cols, F.lit(True).alias("admitted")).unionByName(
        refused.select(*cols, F.lit(False).alias("admitted")))


@query("trim_bytes", f"""
WITH {I.MSGS} SELECT {_MSG_COLS} FROM (
  SELECT *, sum(strlen(data)) OVER (PARTITION BY stream ORDER BY seq DESC) AS run FROM msgs) WHERE run <= 10240""")
def trim_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return retention.trim_bytes(_stored(spark, sf), 10240)


@query("retain_drop_old", f"""
WITH {I.MSGS}, fresh AS (SELECT * FROM msgs WHERE time >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAYS),
lasts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY seq DESC) AS rn FROM fresh) WHERE rn <= 2000)
SELECT {_MSG_COLS} FROM (SELECT *, sum(strlen(data)) OVER (PARTITION BY stream ORDER BY seq DESC) AS run FROM lasts) WHERE run <= 6000""")
def retain_drop_old(spark: SparkSession, sf: str) -> DataFrame:
    """Age, count and size with the oldest messages dropped."""
    return retention.retain(_stored(spark, sf), "Limits", max_age=timedelta(days=14), as_of=I.AS_OF,
                            max_msgs=2000, max_bytes=6000, discard="old")


@query("retain_workqueue", f"WITH {I.MSGS} SELECT {_MSG_COLS} FROM msgs WHERE NOT (value < 40)")
def retain_workqueue(spark: SparkSession, sf: str) -> DataFrame:
    msgs = I.messages(spark, sf)
    return retention.retain_workqueue(msgs.drop("value"), I.acks(msgs).where("consumer = 'a'"))


@query("retain_interest", f"WITH {I.MSGS} SELECT {_MSG_COLS} FROM msgs WHERE NOT (value < 40 AND value >= 30)")
def retain_interest(spark: SparkSession, sf: str) -> DataFrame:
    msgs = I.messages(spark, sf)
    return retention.retain_interest(msgs.drop("value"), I.consumers(msgs), I.acks(msgs))


@query("retain_limits", f"""
WITH {I.MSGS}, fresh AS (SELECT * FROM msgs WHERE time >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAYS),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY seq) AS rn FROM fresh) WHERE rn <= 2000)
SELECT {_MSG_COLS} FROM (SELECT *, sum(strlen(data)) OVER (PARTITION BY stream ORDER BY seq) AS run FROM firsts) WHERE run <= 6000""")
def retain_limits(spark: SparkSession, sf: str) -> DataFrame:
    msgs = I.messages(spark, sf)
    return retention.retain(
        msgs.drop("value"), "Limits", I.acks(msgs), max_age=timedelta(days=14), as_of=I.AS_OF,
        max_msgs=2000, max_bytes=6000,
    )


# --- lag ---------------------------------------------------------------------------------


@query("lag_by_consumer", f"""
WITH {I.MSGS}, {I.CONSUMERS}, {I.DELIVERIES}, {I.ACKS}, n AS (SELECT stream, count(*) AS c FROM msgs GROUP BY stream),
d AS (SELECT d.stream, d.consumer, count(*) AS sent, count(*) - count(a.seq) AS unacked
      FROM deliveries d LEFT JOIN acks a ON d.stream = a.stream AND d.seq = a.seq AND d.consumer = a.consumer GROUP BY ALL)
SELECT c.stream, c.consumer, n.c - coalesce(d.sent, 0) AS pending, coalesce(d.unacked, 0) AS unacked, '' AS error
FROM consumers c JOIN n ON c.stream = n.stream LEFT JOIN d ON d.stream = c.stream AND d.consumer = c.consumer
UNION ALL SELECT DISTINCT stream, 'c', -1, -1, 'consumer does not exist' FROM msgs""")
def lag_by_consumer(spark: SparkSession, sf: str) -> DataFrame:
    msgs = I.messages(spark, sf)
    known = I.consumers(msgs)
    asked = known.unionByName(known.select("stream").distinct().withColumn("consumer", F.lit("c")))
    good, missing = G.lag(asked, msgs, known, I.deliveries(msgs), I.acks(msgs))
    none = F.lit(-1).cast("bigint")
    return good.withColumn("error", F.lit("")).unionByName(
        missing.select("stream", "consumer", none.alias("pending"), none.alias("unacked"), "error"))


@query("lag_total", f"""
WITH {I.LAGS} SELECT pipeline_id, coalesce(component, 'all') AS component, CAST(sum(pending + unacked) AS BIGINT) AS total
FROM lags GROUP BY GROUPING SETS ((pipeline_id, component), (pipeline_id))""")
def lag_total(spark: SparkSession, sf: str) -> DataFrame:
    return G.lag_total(I.lags(spark, sf)).withColumn("component", F.coalesce("component", F.lit("all")))


@query("drain_blocker", f"""
WITH {I.LAGS}, staged AS (SELECT *, CASE component WHEN 'dedup' THEN 0 WHEN 'join' THEN 1 ELSE 2 END AS stage FROM lags)
SELECT pipeline_id, coalesce(arg_min(component, stage) FILTER (WHERE pending + unacked > 0), 'none') AS blocker
FROM staged GROUP BY pipeline_id""")
def drain_blocker(spark: SparkSession, sf: str) -> DataFrame:
    return G.drain_blocker(I.lags(spark, sf)).withColumn("blocker", F.coalesce("blocker", F.lit("none")))


@query("drain_progress", """
WITH s AS (SELECT 'pipe-' || user_id AS pipeline_id, ts, event_id AS check_id, CAST(floor(value) AS BIGINT) AS total FROM events),
p AS (SELECT *, lag(total) OVER (PARTITION BY pipeline_id ORDER BY ts, check_id) AS prev FROM s)
SELECT pipeline_id, ts, check_id, total, coalesce(prev, -1) AS previous_total,
       CASE WHEN prev IS NULL OR total < prev THEN 'extend' ELSE 'stalled' END AS outcome FROM p""")
def drain_progress(spark: SparkSession, sf: str) -> DataFrame:
    samples = I.table(spark, sf, "events").selectExpr(
        "'pipe-' || CAST(user_id AS STRING) AS pipeline_id", "ts", "event_id AS check_id",
        "CAST(floor(value) AS BIGINT) AS total")
    return G.drain_progress(samples).withColumn(
        "previous_total", F.coalesce("previous_total", F.lit(-1)))


@query("stream_counts", f"""
WITH {I.MSGS}, names AS (SELECT DISTINCT stream FROM msgs UNION ALL SELECT DISTINCT 'old_' || stream FROM msgs)
SELECT n.stream, count(m.seq) AS msgs FROM names n LEFT JOIN msgs m ON n.stream = m.stream GROUP BY n.stream""")
def stream_counts(spark: SparkSession, sf: str) -> DataFrame:
    msgs = I.messages(spark, sf)
    return G.stream_counts(_streams(msgs), msgs)


def _streams(msgs: DataFrame) -> DataFrame:
    """The streams there are, and as many that hold nothing."""
    names = msgs.select("stream").distinct()
    return names.unionByName(names.select(F.concat(F.lit("old_"), "stream").alias("stream")))


# --- orphan sweep ------------------------------------------------------------------------

_LETTER = """'{"component":"' || c.component || '","error":"retry_exhausted_on_stop","original_message":"' ||
       replace(m.data, '"', '\\"') || '"}' AS dead_letter"""


@query("sweep_dlq", f"""
WITH {I.MSGS}, {I.COMPONENTS} SELECT m.stream, m.seq, {_LETTER} FROM msgs m JOIN components c ON m.stream = c.stream
UNION ALL SELECT m.stream, m.seq, 'nobody reads it' FROM msgs m WHERE NOT EXISTS (SELECT 1 FROM components c WHERE c.stream = m.stream)""")
def sweep_dlq(spark: SparkSession, sf: str) -> DataFrame:
    """Letters, and the messages of streams that nobody reads."""
    msgs = I.messages(spark, sf)
    letters, unmapped = sweep.sweep(msgs, I.components(msgs))
    return letters.unionByName(unmapped.select("stream", "seq", F.lit("nobody reads it").alias("dead_letter")))


@query("sweep_rerun", f"""
WITH {I.MSGS}, {I.COMPONENTS} SELECT m.stream, m.seq, {_LETTER} FROM msgs m JOIN components c ON m.stream = c.stream
WHERE NOT (m.value > 60)""")
def sweep_rerun(spark: SparkSession, sf: str) -> DataFrame:
    """A first run got as far as the messages with a high value."""
    msgs = I.messages(spark, sf)
    first, _ = sweep.sweep(msgs.where("value > 60"), I.components(msgs))
    return sweep.sweep(msgs, I.components(msgs), already=first)[0]


_SWEEP = f"""{I.MSGS}, alls AS (SELECT stream, unnest(generate_series(min(seq), max(seq))) AS seq FROM msgs GROUP BY stream),
outs AS (
  SELECT a.stream, a.seq, CASE WHEN m.seq IS NULL THEN 'already_deleted' WHEN m.value > 60 THEN 'sweep_failed' ELSE 'swept' END AS outcome
  FROM alls a LEFT JOIN msgs m ON a.stream = m.stream AND a.seq = m.seq
  UNION ALL SELECT DISTINCT 'old_' || stream, -1, 'stream_empty' FROM msgs)"""


@query("sweep_outcomes", f"WITH {_SWEEP} SELECT stream, seq, outcome FROM outs")
def sweep_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    msgs = I.messages(spark, sf)
    return sweep.sweep_outcomes(_streams(msgs), msgs, msgs.where("value > 60")).withColumn(
        "seq", F.coalesce("seq", F.lit(-1)))


@query("sweep_counts", f"""
WITH {_SWEEP} SELECT 'pipe-' || substr(stream, strpos(stream, '_') + 1, 1) AS pipeline_id, outcome, count(*) AS n FROM outs GROUP BY ALL""")
def sweep_counts(spark: SparkSession, sf: str) -> DataFrame:
    msgs = I.messages(spark, sf)
    owned = _streams(msgs).withColumn("pipeline_id", F.expr("'pipe-' || substr(stream, instr(stream, '_') + 1, 1)"))
    return sweep.sweep_counts(owned, msgs, msgs.where("value > 60"))


# --- status and history ------------------------------------------------------------------


@query("status_latest", f"""
WITH {I.CHANGES} SELECT pipeline_id, status, ts AS updated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY pipeline_id ORDER BY ts DESC, seq DESC) AS rn FROM changes) WHERE rn = 1""")
def status_latest(spark: SparkSession, sf: str) -> DataFrame:
    return H.latest_status(I.status_changes(spark, sf))


_PREV = f"""{I.CHANGES}, steps AS (
  SELECT *, lag(status) OVER (PARTITION BY pipeline_id ORDER BY ts, seq) AS prev,
         row_number() OVER (PARTITION BY pipeline_id ORDER BY ts, seq) AS rn FROM changes)"""
# Fixed values, written out: the oracle does not read the engine's own table.
_MATRIX = """matrix(a, b) AS (VALUES
  ('Created', 'Running'), ('Created', 'Terminating'), ('Created', 'Failed'),
  ('Running', 'Stopping'), ('Running', 'Terminating'), ('Running', 'Failed'),
  ('Resuming', 'Running'), ('Resuming', 'Terminating'), ('Resuming', 'Failed'),
  ('Stopping', 'Stopped'), ('Stopping', 'Terminating'), ('Stopping', 'Failed'),
  ('Stopped', 'Resuming'), ('Stopped', 'Failed'), ('Terminating', 'Stopped'), ('Terminating', 'Failed'),
  ('Failed', 'Resuming'))"""
_RECORDED = """CASE WHEN s.prev = 'Paused' THEN 'unknown status' WHEN x.a IS NOT NULL THEN 'ok' ELSE 'invalid status transition' END"""


@query("status_transitions", f"""
WITH {_PREV}, {_MATRIX}
SELECT s.pipeline_id, s.ts, s.seq, s.prev AS from_status, s.status AS to_status, {_RECORDED} AS verdict
FROM steps s LEFT JOIN matrix x ON x.a = s.prev AND x.b = s.status WHERE s.rn > 1""")
def status_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return H.check_transitions(I.status_changes(spark, sf), "recorded")


@query("status_transitions_hot", f"""
WITH {_PREV}, {_MATRIX}
SELECT s.pipeline_id, s.ts, s.seq, s.prev AS from_status, s.status AS to_status, {_RECORDED} AS verdict
FROM steps s LEFT JOIN matrix x ON x.a = s.prev AND x.b = s.status WHERE s.rn > 1""")
def status_transitions_hot(spark: SparkSession, sf: str) -> DataFrame:
    """The plan that cuts long histories into slices, at any data size."""
    return H.check_transitions(I.status_changes(spark, sf), "recorded", hot_rows=0)


@query("status_requests", f"""
WITH {_PREV}, {_MATRIX}
SELECT s.pipeline_id, s.ts, s.seq, s.prev AS from_status, s.status AS to_status,
       CASE WHEN s.prev = s.status THEN 'ok'
            WHEN s.prev IN ('Resuming', 'Stopping', 'Terminating') AND s.status <> 'Terminating' THEN 'pipeline already in transition'
            ELSE {_RECORDED} END AS verdict
FROM steps s LEFT JOIN matrix x ON x.a = s.prev AND x.b = s.status WHERE s.rn > 1""")
def status_requests(spark: SparkSession, sf: str) -> DataFrame:
    return H.check_transitions(I.status_changes(spark, sf), "requested")


@query("status_changes", f"WITH {_PREV} SELECT pipeline_id, ts, seq, status FROM steps WHERE rn = 1 OR status <> prev")
def status_changes(spark: SparkSession, sf: str) -> DataFrame:
    return H.drop_unchanged(I.status_changes(spark, sf)).select("pipeline_id", "ts", "seq", "status")


@query("transition_counts", f"""
WITH {_PREV} SELECT prev AS from_status, status AS to_status, pipeline_id, count(*) AS n
FROM steps WHERE rn > 1 AND status <> prev GROUP BY ALL""")
def transition_counts(spark: SparkSession, sf: str) -> DataFrame:
    return H.transition_counts(I.status_changes(spark, sf))


_EVENT = """'{"type":"' || CASE WHEN error IS NULL THEN 'status' ELSE 'error' END ||
  '","pipeline":{"status":{"overall_status":"' || status || '"}},"errors":' ||
  CASE WHEN error IS NULL THEN 'null' ELSE '["' || replace(error, '"', '\\"') || '"]' END ||
  CASE WHEN coalesce(reason, '') = '' THEN '' ELSE ',"reason":"' || reason || '"' END || '}'"""


@query("history_encode", f"""
WITH {I.CHANGES} SELECT pipeline_id, ts, seq, CASE WHEN error IS NULL THEN 'status' ELSE 'error' END AS type, {_EVENT} AS event
FROM changes""")
def history_encode(spark: SparkSession, sf: str) -> DataFrame:
    return H.history_events(I.status_changes(spark, sf))


@query("history_extract", f"WITH {I.CHANGES} SELECT pipeline_id, seq, status AS overall_status FROM changes")
def history_extract(spark: SparkSession, sf: str) -> DataFrame:
    history = H.history_events(I.status_changes(spark, sf))
    return H.history_status(history).select("pipeline_id", "seq", "overall_status")


@query("status_upsert", f"""
WITH {I.CHANGES}, {I.PIPELINES}, newest AS (
  SELECT pipeline_id, arg_max(status, (ts, seq)) AS status, max(ts) AS ts FROM changes GROUP BY pipeline_id)
SELECT p.id, coalesce(n.status, p.status) AS status, coalesce(n.ts, p.updated_at) AS updated_at
FROM pipelines p LEFT JOIN newest n ON n.pipeline_id = p.id""")
def status_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return H.apply_status(I.pipelines(spark, sf), I.status_changes(spark, sf))[0]


@query("status_history", f"""
WITH {I.CHANGES}, {I.PIPELINES}
SELECT pipeline_id, ts, seq, CASE WHEN error IS NULL THEN 'status' ELSE 'error' END AS type, {_EVENT} AS event
FROM changes SEMI JOIN pipelines ON pipelines.id = changes.pipeline_id""")
def status_history(spark: SparkSession, sf: str) -> DataFrame:
    return H.apply_status(I.pipelines(spark, sf), I.status_changes(spark, sf))[1]


@query("status_missing", f"""
WITH {I.CHANGES}, {I.PIPELINES}
SELECT pipeline_id, ts, seq, status, 'pipeline not found' AS error
FROM changes ANTI JOIN pipelines ON pipelines.id = changes.pipeline_id""")
def status_missing(spark: SparkSession, sf: str) -> DataFrame:
    return H.apply_status(I.pipelines(spark, sf), I.status_changes(spark, sf))[2]


@query("status_delete", f"""
WITH {I.PIPELINES}, gone AS (SELECT DISTINCT 'pipe-' || user_id AS id FROM events)
SELECT id, 'kept' AS outcome FROM pipelines ANTI JOIN gone USING (id)
UNION ALL SELECT id, 'pipeline not found' FROM gone ANTI JOIN pipelines USING (id)""")
def status_delete(spark: SparkSession, sf: str) -> DataFrame:
    ids = I.table(spark, sf, "events").selectExpr("'pipe-' || CAST(user_id AS STRING) AS id")
    kept, absent = H.delete_pipelines(I.pipelines(spark, sf), ids)
    return kept.select("id", F.lit("kept").alias("outcome")).unionByName(absent.select("id", F.col("error").alias("outcome")))


@query("op_overruns", f"""
WITH {I.EV}, {I.OUTCOMES}, o AS (SELECT *, status = 'failure' AS unreadable,
  epoch_us(TIMESTAMP '2024-01-30 23:59:00') - (epoch_us(ended) // 1000000) * 1000000 AS us FROM outcomes)
SELECT event_id, operation, CASE WHEN unreadable THEN -1 ELSE us END AS elapsed_us,
       NOT unreadable AND us > CASE WHEN operation = 'stop' THEN 300000000 ELSE 900000000 END AS timed_out FROM o""")
def op_overruns(spark: SparkSession, sf: str) -> DataFrame:
    ops = I.outcomes(spark, sf).select(
        "event_id", "operation",
        F.when(F.col("status") == "failure", "soon").otherwise(F.date_format("ended", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("started"))
    as_of = I.AS_OF - timedelta(minutes=1)
    return H.overruns(ops, as_of).select(
        "event_id", "operation", F.coalesce("elapsed_us", F.lit(-1)).alias("elapsed_us"), "timed_out")


# --- signals and notifications -----------------------------------------------------------


@query("signal_decode", f"""
WITH {I.SIGNALS} SELECT event_id, malformed, CASE WHEN malformed THEN '' ELSE pipeline_id END AS pipeline_id,
  CASE WHEN malformed THEN '' ELSE reason END AS reason, CASE WHEN malformed THEN '' ELSE text END AS text,
  CASE WHEN malformed THEN '' ELSE component END AS component FROM sigs""")
def signal_decode(spark: SparkSession, sf: str) -> DataFrame:
    good, bad = signals.signals(I.raw_signals(spark, sf))
    blank = [F.lit("").alias(c) for c in ("pipeline_id", "reason", "text", "component")]
    return good.select("event_id", F.lit(False).alias("malformed"), "pipeline_id", "reason", "text", "component").unionByName(
        bad.select("event_id", F.lit(True).alias("malformed"), *blank))


_STORED = """stored AS (SELECT 'pipe-' || c_custkey AS pipeline_id,
  ([%s, ''])[1 + CAST(c_nationkey AS BIGINT) %% 9] AS status FROM customer WHERE c_mktsegment <> 'BUILDING')""" % ", ".join(
    f"'{n}'" for n in I.STATUS_NAMES)


def _stored_status(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in I.STATUS_NAMES], F.lit(""))
    return I.table(spark, sf, "customer").where("c_mktsegment <> 'BUILDING'").select(
        F.expr("'pipe-' || CAST(c_custkey AS STRING)").alias("pipeline_id"),
        F.element_at(names, F.col("c_nationkey") % 9 + 1).alias("status"))


@query("signal_route", f"""
WITH {I.SIGNALS}, {_STORED}, routed AS (
  SELECT g.*, CASE WHEN malformed THEN 'retry' WHEN reason = 'stream back-pressure' THEN 'notify' WHEN s.pipeline_id IS NULL THEN 'ack'
                   WHEN s.status IN ('Running', 'Stopping') THEN 'stop' ELSE 'retry' END AS action
  FROM sigs g LEFT JOIN stored s ON s.pipeline_id = g.pipeline_id)
SELECT event_id, action, CASE WHEN action = 'stop' THEN text ELSE '' END AS stop_reason FROM routed""")
def signal_route(spark: SparkSession, sf: str) -> DataFrame:
    good, bad = signals.signals(I.raw_signals(spark, sf))
    routed = signals.route_signals(good, _stored_status(spark, sf))
    cols = ["event_id", "action"]
    return routed.select(*cols, F.coalesce("stop_reason", F.lit("")).alias("stop_reason")).unionByName(
        signals.retry_rows(bad).select(*cols, F.lit("").alias("stop_reason")))


# Fixed values, written out as above: severity, event type, title and message of each operation.
_CASES = [
    """CASE operation WHEN 'create' THEN 'info' WHEN 'resume' THEN 'info' WHEN 'edit' THEN 'info'
       WHEN 'stop' THEN 'warn' WHEN 'terminate' THEN 'warn' WHEN 'delete' THEN 'warn' WHEN 'helm-uninstall' THEN 'warn' END""",
    """CASE operation WHEN 'create' THEN 'pipeline_deployed' WHEN 'resume' THEN 'pipeline_resumed'
       WHEN 'stop' THEN 'pipeline_stopped' WHEN 'terminate' THEN 'pipeline_stopped' WHEN 'edit' THEN 'pipeline_deployed'
       WHEN 'delete' THEN 'pipeline_deleted' WHEN 'helm-uninstall' THEN 'pipeline_deleted' END""",
    """CASE operation WHEN 'create' THEN 'Pipeline Deployed Successfully' WHEN 'resume' THEN 'Pipeline Resumed'
       WHEN 'stop' THEN 'Pipeline Stopped' WHEN 'terminate' THEN 'Pipeline Terminated'
       WHEN 'edit' THEN 'Pipeline Updated Successfully' WHEN 'delete' THEN 'Pipeline Deleted'
       WHEN 'helm-uninstall' THEN 'Pipeline Uninstalled' END""",
    """CASE operation WHEN 'create' THEN 'Pipeline has been deployed successfully' WHEN 'resume' THEN 'Pipeline has been resumed'
       WHEN 'stop' THEN 'Pipeline has been stopped' WHEN 'terminate' THEN 'Pipeline has been terminated'
       WHEN 'edit' THEN 'Pipeline has been updated successfully' WHEN 'delete' THEN 'Pipeline has been deleted'
       WHEN 'helm-uninstall' THEN 'Pipeline has been uninstalled' END""",
]


_BUILT = f"""{I.EV}, {I.OUTCOMES}, built AS (
  SELECT *, status = 'failure' AS failed,
    regexp_replace(strftime(ended, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0+$', '') || 'Z' AS stamp,
    CASE WHEN status = 'failure' THEN 'error' ELSE {_CASES[0]} END AS severity,
    CASE WHEN status = 'failure' THEN 'pipeline_failed' ELSE {_CASES[1]} END AS event_type,
    CASE WHEN status = 'failure' THEN 'Pipeline Operation Failed: ' || operation ELSE {_CASES[2]} END AS title,
    CASE WHEN status = 'failure' THEN 'Operation ' || operation || ' failed: ' || error
         WHEN operation = 'stop' AND message <> '' THEN message ELSE {_CASES[3]} END AS msg
  FROM outcomes WHERE status = 'failure' OR operation <> 'unknown')"""


@query("notif_build", f"""
WITH {_BUILT} SELECT pipeline_id, stamp AS timestamp, severity, event_type, title, msg AS message, 'etl' AS source,
  CASE WHEN failed THEN 'deployment,error' ELSE 'deployment' END AS tags, operation, coalesce(error, '') AS error FROM built""")
def notif_build(spark: SparkSession, sf: str) -> DataFrame:
    built = notifications.build_notifications(I.outcomes(spark, sf), "etl", "local")
    fields = F.col("metadata.custom_fields")
    return built.select(
        "pipeline_id", "timestamp", "severity", "event_type", "title", "message", "metadata.source",
        F.array_join("metadata.tags", ",").alias("tags"), F.try_element_at(fields, F.lit("operation")).alias("operation"),
        F.coalesce(F.try_element_at(fields, F.lit("error")), F.lit("")).alias("error"))


@query("notif_backpressure", f"""
WITH {I.SIGNALS} SELECT pipeline_id, 'warn' AS severity, 'pipeline_backpressure' AS event_type, 'Pipeline Back-Pressure Detected' AS title,
  'backpressure' AS tags FROM sigs WHERE NOT malformed AND reason = 'stream back-pressure'""")
def notif_backpressure(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = signals.signals(I.raw_signals(spark, sf))
    routed = signals.route_signals(good, _stored_status(spark, sf))
    return notifications.backpressure_notifications(routed, "etl", "ts").select(
        "pipeline_id", "severity", "event_type", "title", F.array_join("metadata.tags", ",").alias("tags"))


@query("notif_validate", f"""
WITH {I.EV}, {I.OUTCOMES}
SELECT event_id, CASE WHEN seconds > 80 THEN 'pipeline_id is required' WHEN operation = 'stop' THEN 'title is required'
                      WHEN message = '' THEN 'message is required' ELSE '' END AS invalid FROM outcomes""")
def notif_validate(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.outcomes(spark, sf).select(
        "event_id", F.lit("id").alias("notification_id"),
        F.expr("CASE WHEN seconds <= 80 THEN pipeline_id END").alias("pipeline_id"),
        F.lit("2024-01-01T00:00:00Z").alias("timestamp"), F.lit("pipeline_stopped").alias("event_type"),
        F.expr("CASE WHEN operation = 'stop' THEN '' ELSE operation END").alias("title"), "message")
    return notifications.validate_notifications(rows).select("event_id", F.coalesce("invalid", F.lit("")).alias("invalid"))


@query("notif_encode", f"""
WITH {_BUILT}
SELECT '{{"notification_id":"' || md5(pipeline_id || stamp) || '","pipeline_id":"' || pipeline_id || '","timestamp":"' || stamp ||
  '","severity":"' || severity || '","event_type":"' || event_type || '","title":"' || title || '","message":"' || msg ||
  '","metadata":{{"source":"etl","tags":' || CASE WHEN failed THEN '["deployment","error"]' ELSE '["deployment"]' END ||
  ',"custom_fields":{{"operation":"' || operation || '","status":"' || status ||
  CASE WHEN failed THEN '","error":"' || error ELSE '' END || '","cluster_provider":"local"}}}}}}' AS payload FROM built""")
def notif_encode(spark: SparkSession, sf: str) -> DataFrame:
    """The random id is replaced by one that can be recomputed."""
    built = notifications.build_notifications(I.outcomes(spark, sf), "etl", "local")
    named = built.withColumn("notification_id", F.md5(F.concat("pipeline_id", "timestamp").cast("binary")))
    return notifications.notification_json(named)


@query("usage_events", f"""
WITH {I.EV}, {I.OUTCOMES}
SELECT '{{"installation_id":"inst-1","event_name":"' || CASE WHEN status = 'failure' THEN 'reconcile_error' ELSE 'reconcile_success' END ||
  '","event_source":"operator","timestamp":"' || strftime(ended, '%Y-%m-%dT%H:%M:%SZ') || '","properties":{{"pipeline_id_hash":"' ||
  md5(pipeline_id) || '","operation":"' || operation || '","status":"' || status ||
  CASE WHEN status = 'failure' THEN '","error":"' || error ELSE '' END || '","cluster_provider":"local"}}}}' AS payload FROM outcomes""")
def usage_events(spark: SparkSession, sf: str) -> DataFrame:
    return notifications.usage_json(notifications.usage_events(I.outcomes(spark, sf), "inst-1", "local"))


@query("status_usage_events", f"""
WITH {_PREV}
SELECT '{{"installation_id":"inst-1","event_name":"pipeline_status_change","event_source":"operator","timestamp":"' ||
  strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","properties":{{"pipeline_id_hash":"' || md5(pipeline_id) || '","status":"' || status ||
  '","cluster_provider":"local"}}}}' AS payload FROM steps WHERE rn = 1 OR status <> prev""")
def status_usage_events(spark: SparkSession, sf: str) -> DataFrame:
    real = H.drop_unchanged(I.status_changes(spark, sf))
    return notifications.usage_json(notifications.status_usage_events(real, "inst-1", "local"))


# --- metrics -----------------------------------------------------------------------------


@query("ops_counter", f"WITH {I.EV}, {I.OUTCOMES} SELECT operation, status, pipeline_id, count(*) AS n FROM outcomes GROUP BY ALL")
def ops_counter(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.counter(I.outcomes(spark, sf), ["operation", "status", "pipeline_id"])


@query("err_counter", f"""
WITH {I.EV}, {I.OUTCOMES} SELECT operation, error AS error_msg, pipeline_id, count(*) AS n FROM outcomes WHERE status = 'failure' GROUP BY ALL""")
def err_counter(spark: SparkSession, sf: str) -> DataFrame:
    failed = I.outcomes(spark, sf).where("status = 'failure'").withColumnRenamed("error", "error_msg")
    return metrics.counter(failed, ["operation", "error_msg", "pipeline_id"])


@query("store_counter", f"""
WITH {I.EV}, stores AS (SELECT CASE WHEN k < 50 THEN 'publish' ELSE 'delete' END AS operation,
  CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS status, 'pipe-' || user_id AS pipeline_id FROM ev)
SELECT operation, status, pipeline_id, count(*) AS n FROM stores GROUP BY ALL""")
def store_counter(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.events(spark, sf).selectExpr(
        "CASE WHEN k < 50 THEN 'publish' ELSE 'delete' END AS operation",
        "CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS status",
        "'pipe-' || CAST(user_id AS STRING) AS pipeline_id")
    return metrics.counter(rows, ["operation", "status", "pipeline_id"])


@query("duration_hist", f"""
WITH {I.EV}, {I.OUTCOMES}, bounds(bucket, le) AS (VALUES (0, 0.1::DOUBLE), (1, 1), (2, 5), (3, 10), (4, 30), (5, 60), (6, 300), (7, 600), (8, 1e308)),
labels AS (SELECT DISTINCT operation FROM outcomes),
up_to AS (SELECT operation, bucket, le, (SELECT count(*) FROM outcomes o WHERE o.operation = l.operation AND o.seconds <= b.le) AS cumulative
          FROM labels l, bounds b)
SELECT operation, bucket, CASE WHEN bucket = 8 THEN -1 ELSE le END AS le,
       cumulative - coalesce(lag(cumulative) OVER (PARTITION BY operation ORDER BY bucket), 0) AS n, cumulative FROM up_to""")
def duration_hist(spark: SparkSession, sf: str) -> DataFrame:
    hist = metrics.histogram(I.outcomes(spark, sf), "seconds", ["operation"])
    return hist.withColumn("le", F.coalesce("le", F.lit(-1.0)))
