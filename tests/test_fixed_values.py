"""Values that are fixed by the behaviour to be matched."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidegate.functions import exprs as X
from tidegate.operators import deadletters, history, lag, metrics, notifications, retention, shards, signals, stages, sweep
from tidegate.sinks.tables import append_letters, notify_sink
from tidegate.sources.records import read_specs


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("pipeline, short", [("pipe-1", "1528386a"), ("pipe-join", "2802cd7f")])
def test_short_hash_and_names(spark, pipeline, short):
    assert value(spark, X.short_hash(F.lit(pipeline))) == short
    name = X.shard_name("etl", F.lit(pipeline), F.lit("a.b c/d"), F.lit(2))
    assert value(spark, name) == f"etl-{short}-a_b_c_d-out_2"
    assert len(value(spark, X.shard_prefix("etl", F.lit(pipeline), F.lit("n" * 400)))) == 256


@pytest.mark.parametrize("text, size", [
    ("0", 0), ("42", 42), ("-1", -1), ("+7", 7), ("100GB", 107374182400), ("1.5gb", 1610612736), ("1kb", 1024),
    (" 2MB ", 2097152), ("1TB", 1099511627776), (".5KB", 512), ("1e1KB", 10240), ("-1KB", -1024), ("0.0001KB", 0),
    ("1 GB", None), (" 42", None), ("10Gi", None), ("", None), ("GB", None), ("12B", None), ("9223372036854775808", None),
    ("abc", None), (None, None),
])
def test_bytes(spark, text, size):
    assert value(spark, X.parse_bytes(F.lit(text).cast("string"))) == size
    assert value(spark, X.parse_bytes_or_default(F.lit(text).cast("string"))) == (107374182400 if size is None else size)


@pytest.mark.parametrize("text, expected", [
    ("2024-01-02T03:04:05Z", datetime(2024, 1, 2, 3, 4, 5)),
    ("2024-01-02T03:04:05.123456789Z", datetime(2024, 1, 2, 3, 4, 5, 123456)),
    ("2024-01-02T03:04:05+02:00", datetime(2024, 1, 2, 1, 4, 5)),
    ("2024-01-02 03:04:05Z", None), ("2024-01-02T03:04:05", None), ("2024-13-02T03:04:05Z", None), ("soon", None),
])
def test_rfc3339(spark, text, expected):
    assert value(spark, X.parse_rfc3339(F.lit(text))) == expected


@pytest.mark.parametrize("at, text", [
    (datetime(2024, 1, 2, 3, 0, 0), "2024-01-02T03:00:00Z"),
    (datetime(2024, 1, 2, 3, 0, 10, 500000), "2024-01-02T03:00:10.5Z"),
    (datetime(2024, 1, 2, 3, 0, 0, 10), "2024-01-02T03:00:00.00001Z"),
])
def test_rfc3339_nano(spark, at, text):
    assert value(spark, X.format_rfc3339_nano(F.lit(at))) == text


def test_dead_letter_round_trip(spark):
    df = spark.createDataFrame([('{"id":42}',)], "data string")
    letters = deadletters.to_dlq(df, F.lit("sink"), F.col("data"), error=F.lit("retry_exhausted_on_stop"))
    raw = letters.first().dead_letter
    assert json.loads(raw) == {"component": "sink", "error": "retry_exhausted_on_stop", "original_message": '{"id":42}'}
    back = deadletters.from_dlq(letters).first()
    assert tuple(back) == ("sink", "retry_exhausted_on_stop", '{"id":42}', "")
    extra = spark.createDataFrame([('{"component":"sink","original_message":"x","new":1}',)], "dead_letter string")
    assert tuple(deadletters.from_dlq(extra).first()) == ("sink", "", "x", "")
    assert value(spark, deadletters.dlq_subject(F.lit("etl-abc-DLQ"))) == "etl-abc-DLQ.failed"


@pytest.mark.parametrize("sources, targets, expected", [
    (2, 2, [(0, 0), (1, 1)]), (3, 2, [(0, 0), (1, 1), (2, 0)]), (1, 2, [(0, 0), (1, 1)]),
    (2, 5, [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4)]), (3, 1, [(0, 0), (1, 0), (2, 0)]),
])
def test_round_robin(spark, sources, targets, expected):
    rows = shards.shard_round_robin(spark.range(60), [F.col("id")], X.block_of(F.col("id"), 7), sources, targets)
    assert sorted((r.subject, r.shard) for r in rows.select("subject", "shard").distinct().collect()) == expected
    assert rows.groupBy("subject").count().select("count").distinct().count() == 1


def test_pipelines_with_one_hash_share_each_name_once(spark):
    owners = spark.createDataFrame([("pipe-19297",), ("pipe-120186",), ("pipe-1",)], "pipeline_id string")
    names = owners.select(F.concat(F.lit("etl-"), X.short_hash(F.col("pipeline_id")), F.lit("-DLQ")).alias("name"))
    found = shards.list_shards(names, "etl", owners).collect()
    assert sorted((r.name, r.pipeline_id) for r in found) == [
        ("etl-1528386a-DLQ", "pipe-1"), ("etl-53645748-DLQ", "pipe-120186"), ("etl-53645748-DLQ", "pipe-19297")]


def test_reshard_conserves_rows(spark):
    before = shards.shard_by_key(spark.range(500), ["id"], 5)
    after = shards.reshard(before, 5, 2)
    assert {r.shard for r in after.select("shard").distinct().collect()} == {0, 1}
    assert shards.reshard_check(before, after, 2).where("NOT conserved").count() == 0
    assert shards.reshard_check(before, after.limit(400), 2).where("NOT conserved").count() > 0
    assert shards.reshard(before, 2, 5) is before
    assert shards.reshard(before, 2, 5, dedup=True) is before
    with pytest.raises(ValueError, match="deduplication"):
        shards.reshard(before, 5, 2, dedup=True)


@pytest.mark.parametrize("source, target, recorded, requested", [
    ("Created", "Running", "ok", "ok"), ("Created", "Created", "invalid status transition", "ok"),
    ("Created", "Stopping", "invalid status transition", "invalid status transition"),
    ("Running", "Stopping", "ok", "ok"), ("Stopping", "Stopped", "ok", "pipeline already in transition"),
    ("Stopping", "Terminating", "ok", "ok"), ("Resuming", "Running", "ok", "pipeline already in transition"),
    ("Terminating", "Stopped", "ok", "pipeline already in transition"), ("Stopped", "Terminating", *["invalid status transition"] * 2),
    ("Failed", "Resuming", "ok", "ok"), ("Failed", "Terminating", *["invalid status transition"] * 2),
    ("Paused", "Running", "unknown status", "unknown status"), ("Paused", "Paused", "unknown status", "ok"),
    ("Running", "Paused", *["invalid status transition"] * 2), (None, "Running", "unknown status", "unknown status"),
])
def test_transitions(spark, source, target, recorded, requested):
    a, b = F.lit(source).cast("string"), F.lit(target)
    assert value(spark, history.recorded_check(a, b)) == recorded
    assert value(spark, history.requested_check(a, b)) == requested


def test_history_event(spark):
    rows = [("p", 1, 1, "Running", None, None), ("p", 2, 2, "Failed", ["a", "b"], "why"), ("p", 3, 3, "Stopped", [], "")]
    df = spark.createDataFrame(rows, "pipeline_id string, ts int, seq int, status string, errors array<string>, reason string")
    got = [(r.type, r.event) for r in history.history_events(df).orderBy("seq").collect()]
    assert got == [
        ("status", '{"type":"status","pipeline":{"status":{"overall_status":"Running"}},"errors":null}'),
        ("error", '{"type":"error","pipeline":{"status":{"overall_status":"Failed"}},"errors":["a","b"],"reason":"why"}'),
        ("status", '{"type":"status","pipeline":{"status":{"overall_status":"Stopped"}},"errors":[]}'),
    ]


def test_overruns(spark):
    as_of = datetime(2024, 1, 1, 12, 0, 0)
    rows = [("stop", "2024-01-01T11:55:00Z"), ("stop", "2024-01-01T11:54:59Z"), ("edit", "2024-01-01T11:45:00Z"),
            ("edit", "2024-01-01T11:44:59Z"), ("stop", None), ("stop", "yesterday"), ("create", "2023-12-31T12:00:00Z")]
    out = history.overruns(spark.createDataFrame(rows, "operation string, started string"), as_of)
    assert [r.timed_out for r in out.collect()] == [False, True, False, True, False, False, True]


def test_status_write(spark):
    pipelines = spark.createDataFrame([("a", "Created", 0), ("b", "Created", 0)], "id string, status string, updated_at int")
    changes = spark.createDataFrame(
        [("a", 1, 1, "Running", None, ""), ("a", 1, 2, "Stopping", None, ""), ("x", 1, 3, "Running", None, "")],
        "pipeline_id string, ts int, seq int, status string, errors array<string>, reason string")
    state, hist, missing = history.apply_status(pipelines, changes)
    assert sorted(map(tuple, state.collect())) == [("a", "Stopping", 1), ("b", "Created", 0)]
    assert sorted(r.seq for r in hist.collect()) == [1, 2]
    assert [(r.pipeline_id, r.error) for r in missing.collect()] == [("x", "pipeline not found")]
    kept, absent = history.delete_pipelines(pipelines, spark.createDataFrame([("a",), ("q",)], "id string"))
    assert [r.id for r in kept.collect()] == ["b"] and [r.id for r in absent.collect()] == ["q"]


def test_signal_routing(spark):
    pipelines = spark.createDataFrame(
        [("run", "Running"), ("stopping", "Stopping"), ("made", "Created"), ("odd", "Paused"), ("none", ""), ("null", None)],
        "pipeline_id string, status string")
    raw = [
        '{"pipeline_id":"run","reason":"failure","text":"boom","component":"sink"}',
        '{"pipeline_id":"run","reason":"failure"}',
        '{"pipeline_id":"stopping","reason":"x","text":"again"}',
        '{"pipeline_id":"made","reason":"x"}', '{"pipeline_id":"odd"}', '{"pipeline_id":"none"}', '{"pipeline_id":"null"}',
        '{"pipeline_id":"gone","reason":"x"}', '{"pipeline_id":"gone","reason":"stream back-pressure"}', "{bad", "[1]",
    ]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(raw)], "i int, value string")
    good, bad = signals.signals(df)
    routed = {r.i: (r.action, r.stop_reason) for r in signals.route_signals(good, pipelines).collect()}
    assert routed == {
        0: ("stop", "boom"), 1: ("stop", None), 2: ("stop", "again"), 3: ("retry", None), 4: ("retry", None),
        5: ("retry", None), 6: ("retry", None), 7: ("ack", None), 8: ("notify", None),
    }
    assert {r.i: r.action for r in signals.retry_rows(bad).collect()} == {9: "retry", 10: "retry"}


@pytest.mark.parametrize("operation, event_type, severity, title", [
    ("create", "pipeline_deployed", "info", "Pipeline Deployed Successfully"),
    ("resume", "pipeline_resumed", "info", "Pipeline Resumed"),
    ("stop", "pipeline_stopped", "warn", "Pipeline Stopped"),
    ("terminate", "pipeline_stopped", "warn", "Pipeline Terminated"),
    ("edit", "pipeline_deployed", "info", "Pipeline Updated Successfully"),
    ("delete", "pipeline_deleted", "warn", "Pipeline Deleted"),
    ("helm-uninstall", "pipeline_deleted", "warn", "Pipeline Uninstalled"),
])
def test_notifications(spark, operation, event_type, severity, title):
    schema = "operation string, status string, pipeline_id string, error string, message string, ended timestamp"
    at = datetime(2024, 1, 1)
    df = spark.createDataFrame([
        (operation, "success", "p", None, "drained", at), (operation, "failure", "p", "boom", "", at),
        ("other", "success", "p", None, "", at),
    ], schema)
    built = notifications.build_notifications(df, "me", "gke").orderBy("severity").collect()
    assert len(built) == 2
    bad, good = sorted(built, key=lambda r: r.severity != "error")
    assert (good.event_type, good.severity, good.title) == (event_type, severity, title)
    assert (good.message == "drained") == (operation == "stop")
    assert good.metadata.custom_fields == {"operation": operation, "status": "success", "cluster_provider": "gke"}
    assert (bad.event_type, bad.title) == ("pipeline_failed", f"Pipeline Operation Failed: {operation}")
    assert bad.message == f"Operation {operation} failed: boom" and bad.metadata.tags == ["deployment", "error"]
    assert good.notification_id != bad.notification_id


def test_notification_validation_order(spark):
    schema = "notification_id string, pipeline_id string, timestamp string, event_type string, title string, message string"
    full = ["n", "p", "t", "e", "ti", "m"]
    rows = [tuple(full)] + [tuple([*full[:i], "" if i % 2 else None, *full[i + 1:]]) for i in range(6)] + [tuple([None] * 6)]
    got = [r.invalid for r in notifications.validate_notifications(spark.createDataFrame(rows, schema)).collect()]
    names = ["notification_id", "pipeline_id", "timestamp", "event_type", "title", "message"]
    assert got == [None, *[f"{n} is required" for n in names], "notification_id is required"]


def test_usage_hash(spark):
    df = spark.createDataFrame([("create", "success", "p", None, datetime(2024, 1, 1))],
                               "operation string, status string, pipeline_id string, error string, ended timestamp")
    event = notifications.usage_events(df, "inst", "gke").first()
    assert event.properties["pipeline_id_hash"] == "83878c91171338902e0fe0fb97a8c47a"
    assert (event.event_name, event.event_source, event.timestamp) == ("reconcile_success", "operator", "2024-01-01T00:00:00Z")


def test_limits(spark):
    specs = spark.createDataFrame(
        [(None, None, None), (0, 0, 0), (5, 42, -1), (300, 1, 500)], "max_age_ns long, max_bytes long, max_msgs long")
    got = [tuple(r) for r in stages.effective_limits(specs).collect()]
    default = (604800 * 10**9, 107374182400, 500000)
    assert got == [default, default, (5, 42, -1), (300, 1, 500)]
    settings = spark.createDataFrame([("1GB", "7"), ("x", "-2"), ("5", "-1"), (None, "many")], "max_bytes string, max_msgs string")
    assert [tuple(r) for r in stages.stream_defaults(settings).collect()] == [
        (1073741824, 7), (107374182400, 500000), (5, -1), (107374182400, 500000)]


def test_histogram_bounds(spark):
    df = spark.createDataFrame([(v,) for v in (0.05, 0.1, 0.2, 1.0, 600.0, 601.0, None)], "s double")
    rows = metrics.histogram(df, "s", []).orderBy("bucket").collect()
    assert [r.le for r in rows] == [0.1, 1.0, 5.0, 10.0, 30.0, 60.0, 300.0, 600.0, None]
    assert [r.n for r in rows] == [2, 2, 0, 0, 0, 0, 0, 1, 1]
    assert rows[-1].cumulative == 6


@pytest.fixture(scope="module")
def msgs(spark):
    rows = [("a", s, "a.0", "x" * (s % 4), datetime(2024, 1, 1) + timedelta(hours=s)) for s in range(1, 40) if s % 5]
    rows += [("b", s, "b.0", "yy", datetime(2024, 1, 2)) for s in (3, 9)]
    return spark.createDataFrame(rows, "stream string, seq long, subject string, data string, time timestamp")


def test_retention(spark, msgs):
    as_of = datetime(2024, 1, 2, 12)
    assert retention.trim_age(msgs, timedelta(0), as_of).count() == msgs.count()
    assert retention.trim_age(msgs, timedelta(hours=12), as_of).agg(F.min("time")).first()[0] == datetime(2024, 1, 2)
    for n in (0, -1):
        kept, refused = retention.admit_msgs(msgs, n)
        assert (kept.count(), refused.count()) == (msgs.count(), 0)
        assert retention.trim_msgs(msgs, n).count() == msgs.count()
    for split in (retention.admit_msgs(msgs, 5), retention.admit_bytes(msgs, 5)):
        assert sum(part.count() for part in split) == msgs.count()
    kept = retention.admit_msgs(msgs, 5)[0].where("stream = 'a'")
    assert sorted(r.seq for r in kept.collect()) == [1, 2, 3, 4, 6]
    assert sorted(r.seq for r in retention.trim_msgs(msgs, 3).where("stream = 'a'").collect()) == [37, 38, 39]
    # 1 + 2 + 3 bytes; the next row would fit again but comes after a refused one.
    assert sorted(r.seq for r in retention.admit_bytes(msgs, 5)[0].where("stream = 'a'").collect()) == [1, 2]


def test_retention_policies(spark, msgs):
    acks = spark.createDataFrame([("a", 1, "c1"), ("a", 1, "c2"), ("a", 2, "c1"), ("b", 3, "c1"), ("b", 3, "c1")],
                                 "stream string, seq long, consumer string")
    consumers = spark.createDataFrame([("a", "c1"), ("a", "c2"), ("b", "c1")], "stream string, consumer string")
    n = msgs.count()
    assert retention.retain(msgs, "WorkQueue", acks, consumers).count() == n - 3
    assert retention.retain(msgs, "no such policy", acks, consumers).count() == n - 3
    assert retention.retain(msgs, "Interest", acks, consumers).count() == n - 2
    assert retention.retain(msgs, "Limits", acks, consumers).count() == n
    old = retention.retain(msgs, "Limits", max_msgs=4, discard="old").where("stream = 'a'")
    assert sorted(r.seq for r in old.collect()) == [36, 37, 38, 39]


def test_lag(spark, msgs):
    marks = "stream string, seq long, consumer string"
    deliveries = spark.createDataFrame([("a", 1, "c"), ("a", 2, "c"), ("a", 2, "c"), ("a", 500, "c")], marks)
    acks = spark.createDataFrame([("a", 1, "c")], marks)
    known = spark.createDataFrame([("a", "c"), ("b", "c"), ("empty", "c")], "stream string, consumer string")
    asked = known.unionByName(spark.createDataFrame([("a", "ghost")], known.schema))
    good, missing = lag.lag(asked, msgs, known, deliveries, acks)
    total = msgs.where("stream = 'a'").count()
    assert sorted(map(tuple, good.collect())) == [("a", "c", total - 2, 1), ("b", "c", 2, 0), ("empty", "c", 0, 0)]
    assert [(r.consumer, r.error) for r in missing.collect()] == [("ghost", "consumer does not exist")]


@pytest.mark.parametrize("hot_rows", [0, 10**9])
def test_drain(spark, hot_rows):
    rows = [("p", "dedup", 0, 0), ("p", "join", 0, 3), ("p", "sink", 9, 0), ("q", "sink", 0, 0), ("r", "sink", 1, 0), ("r", "dedup", 1, 0)]
    lags = spark.createDataFrame(rows, "pipeline_id string, component string, pending long, unacked long")
    assert {r.pipeline_id: r.blocker for r in lag.drain_blocker(lags).collect()} == {"p": "join", "q": None, "r": "dedup"}
    assert {r.pipeline_id: r.total for r in lag.lag_total(lags).where("component IS NULL").collect()} == {"p": 12, "q": 0, "r": 2}
    checks = [("p", datetime(2024, 1, 1, 0, 0, i), i, t) for i, t in enumerate([9, 5, 5, 4, 6])]
    samples = spark.createDataFrame(checks, "pipeline_id string, ts timestamp, check_id int, total long")
    got = lag.drain_progress(samples, hot_rows).orderBy("check_id").collect()
    assert [r.outcome for r in got] == ["extend", "extend", "stalled", "extend", "stalled"]


def test_sweep_conserves_messages(spark, msgs):
    plan = spark.createDataFrame([("a", "dedup")], "stream string, component string")
    letters, unmapped = sweep.sweep(msgs, plan)
    assert letters.count() + unmapped.count() == msgs.count()
    again, _ = sweep.sweep(msgs, plan, already=letters.where("seq < 10"))
    assert sorted(r.seq for r in again.collect()) == sorted(r.seq for r in letters.where("seq >= 10").collect())
    streams = spark.createDataFrame([("a", "p"), ("gone", "p"), ("b", "q")], "stream string, pipeline_id string")
    failed = msgs.where("seq = 2")
    counts = {(r.pipeline_id, r.outcome): r.n for r in sweep.sweep_counts(streams, msgs, failed).collect()}
    rows = sweep.sweep_outcomes(streams, msgs, failed).join(streams, "stream").groupBy("pipeline_id", "outcome").count()
    assert counts == {(r.pipeline_id, r.outcome): r["count"] for r in rows.collect()}
    assert counts["p", "stream_empty"] == 1 and counts["q", "already_deleted"] == 5


def test_specs(spark):
    ok = '{"sources":{"type":"otlp.logs"},"sink":{"type":"clickhouse"},"unknown":1}'
    rows = [("pipe-1", ok, None), ("pipe-2", None, ok), ("pipe-3", None, ""), ("pipe-4", "", ok), ("pipe-5", "{", ok),
            ("p", ok, None), ("pipe-6", ok.replace("otlp.logs", "files"), None), ("pipe-7", ok.replace("clickhouse", "x"), None)]
    good, bad = read_specs(spark.createDataFrame(rows, "pipeline_id string, stored_config string, inline_config string"))
    assert sorted(r.pipeline_id for r in good.collect()) == ["pipe-1", "pipe-2"]
    assert {r.pipeline_id: r.reason for r in bad.collect()} == {
        "pipe-3": "no config", "pipe-4": "empty config", "pipe-5": "malformed config", "p": "pipeline id too short",
        "pipe-6": "unknown source type", "pipe-7": "unknown sink type"}


def test_notify_sink(spark, tmp_path):
    schema = ("notification_id string, pipeline_id string, timestamp string, severity string, event_type string, title string, "
              "message string, metadata struct<source: string, tags: array<string>, custom_fields: map<string, string>>")
    rows = [("n1", "p", "t", "info", "e", "ti", "m", ("me", [], {})), ("n2", "", "t", "info", "e", "ti", "m", ("me", ["a"], {"k": "v"}))]
    invalid = notify_sink(spark.createDataFrame(rows, schema), str(tmp_path / "out"))
    assert [(r.notification_id, r.invalid) for r in invalid.collect()] == [("n2", "pipeline_id is required")]
    payloads = [json.loads(r.payload) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert payloads == [{"notification_id": "n1", "pipeline_id": "p", "timestamp": "t", "severity": "info", "event_type": "e",
                         "title": "ti", "message": "m", "metadata": {"source": "me"}}]


def test_dead_letters_are_appended(spark, tmp_path):
    letters = deadletters.to_dlq(spark.range(3), F.lit("sink"), F.col("id").cast("string"))
    for _ in range(2):
        append_letters(letters, str(tmp_path / "dlq"))
    assert spark.read.parquet(str(tmp_path / "dlq")).count() == 6
