"""Telemetry payloads lose nothing; flows follow stored specs."""

import json
from dataclasses import replace
from datetime import timedelta

import pytest

from tidegate.plans.flows import DedupRule, Feed, Flow, Input
from tidegate.sources.messages import seq_gap_ranges
from tidegate.sources.otlp import POINT_KINDS, POINTS, otlp_source
from tidegate.sources.records import read_specs


def payloads(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "id long, value string")


def logs(*scopes):
    return json.dumps({"resourceLogs": [{"resource": {"attributes": []}, "scopeLogs": [
        {"scope": {"name": name}, "logRecords": [{"severityText": s} for s in records]} for name, records in scopes]}]})


def test_every_payload_is_a_row_or_a_letter(spark):
    good = logs(("a", ["x", "y"]), ("b", []), ("c", ["z"]))
    df = payloads(spark, good, '{"resourceLogs": [', "no json", None, "{}", '{"resourceLogs": 7}', good)
    rows, letters = otlp_source(df, "logs", "severityText string", component="feed")
    assert sorted((r.id, r.scope.name, r.record.severityText) for r in rows.collect()) == [
        (i, s, t) for i in (0, 6) for s, t in (("a", "x"), ("a", "y"), ("c", "z"))]
    found = [json.loads(r.dead_letter) for r in letters.collect()]
    assert sorted(x["original_message"] for x in found) == sorted(['{"resourceLogs": [', "no json", "", '{"resourceLogs": 7}'])
    assert {(x["component"], x["error"]) for x in found} == {("feed", "malformed payload")}


def test_all_kinds_of_points(spark):
    body = {"gauge": {"asDouble": 1.5}, "sum": {"asInt": "7"}, "histogram": {"count": "3", "bucketCounts": ["1", "2"]},
            "exponentialHistogram": {"scale": 2, "positive": {"offset": 1, "bucketCounts": ["4"]}},
            "summary": {"quantileValues": [{"quantile": 0.5, "value": 9.0}]}}
    value = json.dumps({"resourceMetrics": [{"scopeMetrics": [{"metrics": [
        {"name": k, "unit": "s", k: {"dataPoints": [p, p]}} for k, p in body.items()]}]}]})
    rows, letters = otlp_source(payloads(spark, value), "metrics")
    got = rows.collect()
    assert letters.isEmpty() and sorted(r.kind for r in got) == sorted([*POINT_KINDS] * 2)
    for r in got:
        assert r.name == r.kind and r[r.kind] is not None
        assert all(r[k] is None for k in POINTS if k != r.kind)
    by = {r.kind: r for r in got}
    assert by["gauge"].gauge.asDouble == 1.5 and by["histogram"].histogram.bucketCounts == ["1", "2"]
    assert by["exponentialHistogram"].exponentialHistogram.positive.offset == 1
    assert by["summary"].summary.quantileValues[0].value == 9.0
    one, _ = otlp_source(payloads(spark, value), "metrics", "asDouble double")
    assert one.count() == 10 and "record" in one.columns
    two, _ = otlp_source(payloads(spark, value), "metrics", {"sum": "asInt string"})
    assert [r["sum"].asInt for r in two.collect()] == ["7", "7"]
    with pytest.raises(ValueError):
        otlp_source(payloads(spark, value), "metrics", {"other": "x int"})
    with pytest.raises(ValueError):
        otlp_source(payloads(spark, value), "logs")


def spec(spark, **body):
    config = json.dumps({"sink": {"type": "clickhouse"}, "transform": {}, **body})
    good, bad = read_specs(spark.createDataFrame([("some-flow", config, "")], "pipeline_id string, stored_config string, inline_config string"))
    assert bad.isEmpty()
    return good.first()


def topic(name, window=0, enabled=False):
    return {"topic_name": name, "dedup_window": window, "deduplication": {"enabled": enabled}}


def test_flows_from_specs(spark):
    rows = spark.range(5).selectExpr("id", "timestamp_seconds(id) AS ts", "id % 2 AS k")
    inputs = {n: Input(rows, "ts", ["k"], "id") for n in ("left", "right")}
    two = {"type": "kafka", "topics": [topic("left", 1_500_000_000, True), topic("right", 10**9)]}
    join = {"type": "temporal", "enabled": True, "left_buffer_ttl": 2 * 10**9, "right_buffer_ttl": 10**9}
    flow = Flow.from_spec(spec(spark, sources=two, join=join), inputs, on=["k"])
    assert flow.topics[0].dedup == DedupRule(["k"], timedelta(seconds=1.5), "id") and flow.topics[1].dedup is None
    assert (flow.join.left_ttl, flow.join.right_ttl, flow.stage) == (timedelta(seconds=2), timedelta(seconds=1), None)

    one = {"type": "kafka", "topics": [topic("left", 3 * 10**9, True)]}
    plain = Flow.from_spec(spec(spark, sources=one, join={"enabled": False}), inputs, where="id > 2")
    assert plain.stage is None and plain.topics[0].dedup is None and plain.build().count() == 5
    staged = Flow.from_spec(spec(spark, sources=one, transform={"is_filter_enabled": True, "is_dedup_enabled": True}),
                            inputs, where="id > 0", columns={"x": "id"})
    assert staged.stage.columns is None and staged.stage.dedup.window == timedelta(seconds=3)
    assert sorted(r.id for r in staged.build().collect()) == [1, 2]

    telemetry = spec(spark, sources={"type": "otlp.logs"}, transform={"is_stateless_transform_enabled": True})
    feed = Feed(payloads(spark, logs(("a", ["x"])), "broken"), "logs", "severityText string", {"level": "record.severityText"}, "ts")
    flow = Flow.from_spec(telemetry, {}, feed=feed, columns={"level": "upper(level)"})
    assert [r.level for r in flow.build().collect()] == ["X"] and flow.dead_letters().count() == 1
    deduped = spec(spark, sources={"type": "otlp.logs"}, transform={"is_dedup_enabled": True})
    with pytest.raises(ValueError, match="window"):
        Flow.from_spec(deduped, {}, feed=feed)
    twice = replace(
        feed, rows=payloads(spark, *[logs(("a", ["x"]))] * 2, logs(("a", ["y"]))),
        dedup=DedupRule(["level"], timedelta(minutes=1), "level"),
        columns={"level": "record.severityText", "ts": "timestamp_seconds(0)"})
    assert sorted(r.level for r in Flow.from_spec(deduped, {}, feed=twice).build().collect()) == ["x", "y"]
    with pytest.raises(ValueError):
        Flow.from_spec(telemetry, {})
    with pytest.raises(ValueError):
        Flow.from_spec(spec(spark, sources={"type": "otlp.traces"}), {}, feed=feed)


def test_gap_ranges(spark):
    df = spark.createDataFrame([("s", q) for q in (1, 2, 5, 6, 10**12)] + [(None, 3), (None, 5)], "stream string, seq long")
    assert sorted(map(tuple, seq_gap_ranges(df).collect()), key=str) == sorted(
        [("s", 3, 4, 2), ("s", 7, 10**12 - 1, 10**12 - 7), (None, 4, 4, 1)], key=str)
