"""Streams give what the batch operators give, however the input is cut into batches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidegate.operators.dedup import dedup
from tidegate.operators.joins import temporal_join
from tidegate.operators.metrics import counter_stream
from tidegate.plans.flows import DedupRule, Feed, Flow, Stage, TemporalJoin, Topic
from tidegate.sinks.tables import stream_sink
from tidegate.sources.topics import replay
from tidegate.streaming.dedup_stream import dedup_stream
from tidegate.streaming.joins import temporal_join_stream
from tidegate.streaming.run import drain, read_table, rocksdb_state, run_flow

SCHEMA = "k string, t long, id long, big long"
END = 10**9


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("t"))


def make(seed, n, span):
    """Time-ordered rows with keys, null keys and integers beyond a double's reach."""
    rnd = random.Random(seed)
    times = sorted(rnd.randrange(span) for _ in range(n))
    return [(rnd.choice(["a", "b", "c", None]), t, i, rnd.choice([None, 2**60 + i])) for i, t in enumerate(times)]


def write(spark, batches, path):
    for number, rows in enumerate(batches):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(f"{path}/{number:03d}")


def stream(spark, batches, path):
    write(spark, batches, path)
    return replay(spark, f"{path}/*", frame(spark, []).schema, files_per_batch=1)


def cut(rows, n, seed, late):
    """Cut into batches; rows move back by up to ``late`` seconds of arrival."""
    rnd = random.Random(seed)
    arrived = sorted(rows, key=lambda r: r[1] + rnd.randrange(late + 1))
    size = -(-len(arrived) // n)
    return [arrived[i:i + size] for i in range(0, len(arrived), size)]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=lambda r: r[2])


@pytest.mark.parametrize("batches, late", [(1, 0), (5, 0), (5, 300)])
def test_dedup_equals_batch(spark, tmp_path, batches, late):
    rows = make(1, 600, 4000)
    width = timedelta(seconds=100)
    expected = rows_of(dedup(frame(spark, rows), ["k"], "ts", width, ["id"]))
    source = stream(spark, [*cut(rows, batches, 2, late), [("end", END, -1, 0)]], str(tmp_path / "in"))
    got = drain(dedup_stream(source, ["k"], "ts", width, "id", f"{late + 1} seconds", groups=3), "t-dedup")
    assert rows_of(got.where("k IS NULL OR k <> 'end'")) == expected


def test_dedup_state_survives_a_restart(spark, tmp_path):
    """Two runs with one checkpoint; the second must know the anchors and rows of the first."""
    rows = make(3, 400, 3000)
    width = timedelta(seconds=250)
    expected = rows_of(dedup(frame(spark, rows), ["k"], "ts", width, ["id"]))
    first, second = rows[:200], rows[200:]
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batches in ([first], [second, [("end", END, -1, 0)]]):
        for part in batches:
            frame(spark, part).coalesce(1).write.mode("append").parquet(f"{path}/{part[0][2]}")
        source = replay(spark, f"{path}/*", frame(spark, []).schema, files_per_batch=1)
        kept = dedup_stream(source, ["k"], "ts", width, "id", "1 second")
        with rocksdb_state(spark):
            stream_sink(kept, out, str(tmp_path / "cp")).awaitTermination()
    assert rows_of(read_table(spark, out, kept)) == expected


def test_rows_behind_the_watermark_are_dropped_and_counted(spark, tmp_path):
    batches = [[("a", 1000, 1, 0)], [("a", 5000, 2, 0)], [("b", 10, 3, 0)], [("end", END, -1, 0)]]
    source = stream(spark, batches, str(tmp_path / "in"))
    kept = dedup_stream(source, ["k"], "ts", timedelta(seconds=60), "id", "1 second")
    with rocksdb_state(spark):
        query = stream_sink(kept, str(tmp_path / "out"), str(tmp_path / "cp"))
        query.awaitTermination()
    assert [r[2] for r in rows_of(read_table(spark, str(tmp_path / "out"), kept))] == [1, 2]
    assert sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators) == 1


def sides(df):
    left = df.where("id % 2 = 0").select("k", F.col("id").alias("lid"), F.col("ts").alias("lts"))
    right = df.where("id % 2 = 1").select("k", F.col("id").alias("rid"), F.col("ts").alias("rts"))
    return left, right


def test_join_equals_batch(spark, tmp_path):
    rows = make(4, 500, 3000)
    ttl = (timedelta(seconds=40), timedelta(seconds=15))
    expected = temporal_join(*sides(frame(spark, rows)), ["k"], "lts", "rts", *ttl)
    source = stream(spark, cut(rows, 4, 5, 100), str(tmp_path / "in"))
    got = drain(temporal_join_stream(*sides(source), ["k"], "lts", "rts", *ttl, "101 seconds"), "t-join")
    assert sorted((r.lid, r.rid) for r in got.collect()) == sorted((r.lid, r.rid) for r in expected.collect())


def test_join_state_is_bounded(spark, tmp_path):
    """Old rows leave the state once the watermark says that no partner can come."""
    batches = [[("a", t, t, 0) for t in range(s, s + 100)] for s in range(0, 5000, 1000)]
    source = stream(spark, batches, str(tmp_path / "in"))
    joined = temporal_join_stream(*sides(source), ["k"], "lts", "rts", timedelta(seconds=5), timedelta(seconds=5), "1 second")
    with rocksdb_state(spark):
        query = stream_sink(joined, str(tmp_path / "out"), str(tmp_path / "cp"))
        query.awaitTermination()
    assert max(op.numRowsTotal for p in query.recentProgress for op in p.stateOperators) < 400


def test_counter_stream(spark, tmp_path):
    rows = make(6, 300, 500)
    expected = counter_stream(frame(spark, rows), "ts", ["k"])
    source = stream(spark, [*cut(rows, 3, 7, 20), [("end", END, -1, 0)]], str(tmp_path / "in"))
    got = drain(counter_stream(source, "ts", ["k"], late="21 seconds"), "t-count")
    key = lambda r: (str(r[2]), r[0])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, expected.collect()), key=key)


def test_a_repeated_batch_replaces_its_output(spark, tmp_path):
    """The sink may be asked for the same batch twice; its rows must not double."""
    from tidegate.sinks.tables import table_sink

    rows = frame(spark, make(8, 50, 50))
    for _ in range(2):
        table_sink(rows, str(tmp_path / "out" / "batch_id=0"), "overwrite")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50


def test_flows_on_streams(spark, tmp_path):
    rows = make(9, 400, 3000)
    end = [("end", END, -1, 0)]
    stage = Stage("id <> 7", {"k": "k", "id": "id", "ts": "ts"}, DedupRule(["k"], timedelta(seconds=90), "id"))
    batch = Flow("stage-flow", [Topic(frame(spark, rows), "ts")], stage=stage).build()
    source = stream(spark, [*cut(rows, 3, 1, 50), end], str(tmp_path / "in"))
    run_flow(Flow("stage-flow", [Topic(source, "ts")], stage=stage, delay="51 seconds"), str(tmp_path / "o1"), str(tmp_path / "w1"))
    got = spark.read.parquet(str(tmp_path / "o1")).select("id")
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in batch.collect())

    def join_flow(left, right, delay="0 seconds"):
        return Flow("join-flow", [
            Topic(left, "lts", DedupRule(["k"], timedelta(seconds=30), "lid")),
            Topic(right, "rts"),
        ], join=TemporalJoin(["k"], timedelta(seconds=60), timedelta(seconds=20)), delay=delay)

    batch = join_flow(*sides(frame(spark, rows))).build()
    left, right = sides(stream(spark, [*cut(rows, 3, 1, 50), [("end", END, -2, 0)]], str(tmp_path / "in2")))
    run_flow(join_flow(left, right, "51 seconds"), str(tmp_path / "o2"), str(tmp_path / "w2"))
    got = spark.read.parquet(str(tmp_path / "o2"))
    assert sorted((r.lid, r.rid) for r in got.collect()) == sorted((r.lid, r.rid) for r in batch.collect())


BOTH_END = [("end", END, -2, 0), ("end", END, 10**6 + 1, 0)]


def both_deduplicated(left, right, delay="0 seconds", on=("k",), right_window=timedelta(seconds=20)):
    return Flow("join-flow", [
        Topic(left, "lts", DedupRule(["k"], timedelta(seconds=30), "lid")),
        Topic(right, "rts", DedupRule(["k"], right_window, "rid")),
    ], join=TemporalJoin(list(on), timedelta(seconds=60), timedelta(seconds=25)), delay=delay)


def ids(df):
    return sorted((r.lid, r.rid) for r in df.collect())


@pytest.mark.parametrize("batches, late, right_window", [(1, 0, 20), (5, 0, 0), (5, 300, 20)])
def test_topics_deduplicated_by_the_join_key_are_joined_in_one_step(spark, tmp_path, batches, late, right_window):
    """One query, and the state has entries for groups of keys and not for each row and time bucket."""
    rows, window = make(21, 600, 3000), timedelta(seconds=right_window)
    expected = ids(both_deduplicated(*sides(frame(spark, rows)), right_window=window).build())
    source = stream(spark, [*cut(rows, batches, 1, late), BOTH_END], str(tmp_path / "in"))
    flow = both_deduplicated(*sides(source), f"{late + 1} seconds", right_window=window)
    queries = run_flow(flow, str(tmp_path / "out"), str(tmp_path / "work"), partitions=2, groups=3)
    assert ids(spark.read.parquet(str(tmp_path / "out"))) == expected != []
    assert len(queries) == 1
    assert max(op.numRowsTotal for p in queries[0].recentProgress for op in p.stateOperators) < 100


def test_a_one_step_join_survives_a_restart(spark, tmp_path):
    """Kept rows wait for partners of the next run; a run without new rows repeats nothing."""
    rows = make(22, 500, 2500)
    expected = ids(both_deduplicated(*sides(frame(spark, rows))).build())
    path = str(tmp_path / "in")
    for name, part in (("0", rows[:250]), ("1", [*rows[250:], *BOTH_END]), ("2", [])):
        if part:
            frame(spark, part).coalesce(1).write.parquet(f"{path}/{name}")
        source = replay(spark, f"{path}/*", frame(spark, []).schema, files_per_batch=1)
        run_flow(both_deduplicated(*sides(source), "1 second"), str(tmp_path / "out"), str(tmp_path / "work"), partitions=2)
    assert ids(spark.read.parquet(str(tmp_path / "out"))) == expected


def test_a_one_step_join_forgets_rows_no_partner_can_meet(spark, tmp_path):
    batches = [[("a", t, t, 0) for t in range(s, s + 100)] for s in range(0, 5000, 1000)]
    source = stream(spark, [*batches, BOTH_END], str(tmp_path / "in"))
    query, = run_flow(both_deduplicated(*sides(source), "1 second"), str(tmp_path / "out"), str(tmp_path / "work"), partitions=1, groups=1)
    # The rows at the end and a timer are left.
    assert query.recentProgress[-1].stateOperators[0].numRowsTotal <= 2 * 2


def test_joins_by_other_keys_or_unequal_types_keep_a_table_for_each_topic(spark, tmp_path):
    rows = make(23, 400, 2000)
    left, right = sides(stream(spark, [*cut(rows, 3, 1, 50), BOTH_END], str(tmp_path / "in")))
    join = TemporalJoin(["k"], timedelta(seconds=60), timedelta(seconds=25))
    both = [Topic(left, "lts", DedupRule(["k", "lid"], timedelta(seconds=30), "lid")),
            Topic(right, "rts", DedupRule(["k"], timedelta(seconds=20), "rid"))]
    assert not Flow("join-flow", both, join=join).in_one_step()
    assert both_deduplicated(left, right).in_one_step()
    assert not both_deduplicated(left, right.withColumn("k", F.col("k").cast("long"))).in_one_step()
    assert not both_deduplicated(left, right.withColumn("rid", F.col("rid").cast("string"))).in_one_step()
    still = sides(frame(spark, rows))
    expected = Flow("join-flow", [Topic(df, t.ts, t.dedup) for df, t in zip(still, both)], join=join).build()
    queries = run_flow(Flow("join-flow", both, join=join, delay="51 seconds"), str(tmp_path / "out"), str(tmp_path / "work"), partitions=2)
    assert len(queries) == 3 and ids(spark.read.parquet(str(tmp_path / "out"))) == ids(expected)


def test_late_rows_of_a_one_step_join_are_dropped_and_counted(spark, tmp_path):
    batches = [[("a", 1000, 2, 0), ("a", 1005, 3, 0)], [("a", 5000, 4, 0), ("a", 5001, 5, 0)], [("b", 10, 6, 0), ("b", 11, 7, 0)], BOTH_END]
    source = stream(spark, batches, str(tmp_path / "in"))
    query, = run_flow(both_deduplicated(*sides(source), "1 second"), str(tmp_path / "out"), str(tmp_path / "work"), partitions=2)
    assert ids(spark.read.parquet(str(tmp_path / "out"))) == [(2, 3), (4, 5)]
    assert sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators) == 2


def test_pairs_in_slices_are_all_pairs(monkeypatch):
    import pyarrow as pa

    from tidegate.streaming import dedup_join as J

    monkeypatch.setattr(J, "OUT_ROWS", 7)
    rnd = random.Random(5)
    left, right = ([(rnd.choice("abc"), rnd.randrange(-40, 60)) for _ in range(n)] for n in (50, 30))
    tables = [pa.table({"name": [n for n, _ in side], "at": pa.array([at for _, at in side], pa.int64())}) for side in (left, right)]
    slices = list(J._pairs(*tables, before=4, after=9))
    assert all(len(l) == len(r) <= 7 for l, r in slices)
    got = [pair for l, r in slices for pair in zip(l.tolist(), r.tolist())]
    assert sorted(got) == [(i, j) for i, (n, a) in enumerate(left) for j, (m, b) in enumerate(right) if n == m and -4 <= b - a <= 9]
    assert list(J._pairs(tables[0], tables[1].slice(0, 0), 4, 9)) == []


def test_accepted_shapes(spark):
    topic = Topic(frame(spark, []), "ts")
    join = TemporalJoin.from_spec(["k"], 60 * 10**9, 120 * 10**9)
    assert (join.left_ttl, join.right_ttl) == (timedelta(minutes=1), timedelta(minutes=2))
    for bad in (
        dict(id="abc", topics=[topic]),
        dict(id="no-topic"),
        dict(id="two-topics", topics=[topic, topic]),
        dict(id="join-of-one", topics=[topic], join=join),
        dict(id="join-stage", topics=[topic, topic], join=join, stage=Stage(where="true")),
    ):
        with pytest.raises(ValueError):
            Flow(**bad)


def test_timestamps_keep_microseconds(spark, tmp_path):
    at = datetime(2024, 1, 1, 0, 0, 0, 123457)
    df = spark.createDataFrame([("a", 1, at)], "k string, id long, ts timestamp")
    df.write.parquet(str(tmp_path / "in" / "a"))
    df.withColumn("ts", F.lit("2100-01-01").cast("timestamp")).write.parquet(str(tmp_path / "in" / "b"))
    source = replay(spark, str(tmp_path / "in" / "*"), df.schema, files_per_batch=1)
    got = drain(dedup_stream(source, ["k"], "ts", timedelta(seconds=1), "id", "1 second"), "t-micros")
    assert [r.ts for r in got.collect()] == [at]


@pytest.mark.parametrize("groups", [1, 2])
def test_typed_keys_and_null_times_on_a_stream(spark, tmp_path, groups):
    """Keys a microsecond apart differ, however the state is divided; rows without a time are kept."""
    from tests.test_dedup import TYPED
    df = spark.range(0, 200).selectExpr(
        "id", "CASE WHEN id % 50 > 0 THEN timestamp_seconds(1000 + id div 3) END AS ts", TYPED[0], TYPED[1])
    df.write.parquet(str(tmp_path / "in" / "a"))
    df.limit(1).selectExpr("-1L AS id", "timestamp'2100-01-01' AS ts", "at", "real").write.parquet(str(tmp_path / "in" / "b"))
    for key in ("at", "real"):
        source = replay(spark, str(tmp_path / "in" / "*"), df.schema, files_per_batch=100)
        got = drain(dedup_stream(source, [key], "ts", timedelta(seconds=9), "id", "1 second", groups=groups), "t-typed")
        want = dedup(df, [key], "ts", timedelta(seconds=9), ["id"])
        assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())


def test_window_zero_on_a_stream(spark, tmp_path):
    rows = make(12, 300, 2000)
    source = stream(spark, [*cut(rows, 3, 2, 50), [("end", END, -1, 0)]], str(tmp_path / "in"))
    got = drain(dedup_stream(source, ["k"], "ts", timedelta(0), "id", "51 seconds", groups=3), "t-zero")
    want = dedup(frame(spark, rows), ["k"], "ts", timedelta(0), ["id"])
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())


@pytest.fixture(scope="module")
def two_months(spark, tmp_path_factory):
    """The events and a copy of them 31 days later."""
    path = str(tmp_path_factory.mktemp("sf"))
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    later = events.withColumn("ts", F.expr("ts + INTERVAL 31 DAYS")).withColumn("event_id", F.col("event_id") + 10**6)
    events.unionByName(later).coalesce(2).write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("stream_query, batch_query", [
    ("dedup_stream", "dedup_window"), ("temporal_join_stream", "temporal_join"), ("pipe_join_stream", "pipe_join"),
    ("dedup_stream_all", "dedup_all")])
def test_replays_cover_any_span_of_time(spark, two_months, stream_query, batch_query):
    from workloads import QUERIES
    got, want = QUERIES[stream_query](spark, two_months), QUERIES[batch_query](spark, two_months)
    rows = lambda df: sorted(map(str, df.select(*sorted(want.columns)).collect()))
    assert rows(got) == rows(want)


def test_counters_cover_any_span_of_time(spark, two_months):
    from workloads import QUERIES
    got = QUERIES["counter_10s"](spark, two_months).agg(F.sum("n")).first()[0]
    assert got == spark.read.parquet(f"{two_months}/events.parquet").count()


def payloads(spark, batches, path):
    """Three payloads a number: two records, a cut one, none; every record comes with its time."""
    for n, numbers in enumerate(batches):
        rows = []
        for i in numbers:
            record = lambda at: f'{{"id":{at},"at":{at},"kind":"k{at % 3}"}}'
            rows.append((f'{{"resourceLogs":[{{"scopeLogs":[{{"logRecords":[{record(2 * i)},{record(2 * i + 1)}]}}]}}]}}',))
            rows += [(f'{{"resourceLogs":[{i}',), ('{"resourceLogs":[]}',)]
        spark.createDataFrame(rows, "value string").coalesce(1).write.parquet(f"{path}/{n:03d}")
    return replay(spark, f"{path}/*", "value string", files_per_batch=1)


COLUMNS = {"id": "record.id", "ts": "timestamp_seconds(record.at + 1000)", "kind": "record.kind"}


@pytest.mark.parametrize("window, available_now", [(None, False), (timedelta(seconds=30), True)])
def test_a_streamed_feed_writes_rows_and_letters(spark, tmp_path, window, available_now):
    feed = Feed(payloads(spark, [range(20), [*range(20, 50), END]], f"{tmp_path}/in"), "logs", "id long, at long, kind string", COLUMNS, "ts")
    rule = window and DedupRule(["kind"], window, "id")
    flow = Flow("feed-flow", feed=feed, stage=Stage(where="kind <> 'k2'", dedup=rule))

    def run():
        queries = run_flow(flow, f"{tmp_path}/out", f"{tmp_path}/work", available_now, partitions=2)
        if not available_now:
            # Each query reads what the one before has written.
            for query in [q for _ in queries for q in queries]:
                query.processAllAvailable()
            for query in queries:
                query.stop()

    run()
    run()  # nothing new: a restart repeats nothing
    letters = spark.read.parquet(f"{tmp_path}/work/letters")
    assert letters.count() == 51 and letters.select("dead_letter").distinct().count() == 51
    # The rows at the end lift the watermark past all others.
    ids = [r.id for r in spark.read.parquet(f"{tmp_path}/out").select("id").collect()]
    still = spark.read.parquet(f"{tmp_path}/in/*")
    batch = Flow("feed-flow", feed=Feed(still, "logs", feed.record, COLUMNS, "ts"), stage=flow.stage)
    expected = {r.id for r in batch.build().collect()}
    assert len(ids) == len(set(ids))
    assert {i for i in ids if i < END} == {i for i in expected if i < END}
    assert {r.dead_letter for r in letters.collect()} == {r.dead_letter for r in batch.dead_letters().collect()}


class Held(list):
    """A list state without a store."""

    def __init__(self):
        self.get, self.appendList = lambda: list(self), self.extend

    def put(self, values):
        self[:] = values


class Handle:
    def __init__(self):
        self.state, self.timers = {}, []

    def getListState(self, name, schema):
        return self.state.setdefault(name, Held())

    def registerTimer(self, at):
        self.timers.append(at)


def given(width, *frames):
    """What a group holds after these frames."""
    import pandas as pd
    from pyspark.sql.types import LongType

    from tidegate.streaming import dedup_stream as D

    handle, group = Handle(), D._Dedup(width, LongType())
    group.init(handle)
    rows = [pd.DataFrame([(n, at, tie, f"{n}{at}") for n, at, tie in f], columns=["name", "at", "tie", "body"]) for f in frames]
    list(group.handleInputRows((0,), iter(rows), None))
    return handle, D._unpacked(handle.state["held"], group.rows).to_pylist()


def test_an_endless_window_holds_one_row_a_key():
    from tidegate.streaming.dedup_stream import NEVER

    handle, held = given(NEVER, [("a", 2000 + i, i) for i in range(500)] + [("b", 5000, 2), ("b", 5000, 1)])
    assert [(r["name"], r["at"], r["tie"]) for r in held] == [("a", 2000, 0), ("b", 5000, 1)]
    assert handle.timers == [2]


def test_groups_grow_with_the_rows(spark):
    from workloads.flow_queries import _groups

    assert _groups(spark, 10) == _groups(spark, 1000) < _groups(spark, 36 * 10**6) == 720


def test_a_frame_of_rows_is_one_value_of_the_state():
    handle, held = given(100, [("a", i, i) for i in range(500)], [("b", i, i) for i in range(500)])
    assert len(held) == 1000 and len(handle.state["held"]) == 2
