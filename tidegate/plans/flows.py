"""The four pipeline shapes (C1-C4) as DataFrame compositions.

A flow only declares steps; Catalyst plans them as one query.  Filter and projection fuse
into the scan, deduplication shuffles on its key, the join on key and time bucket.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tidegate.functions.exprs import from_nanos
from tidegate.operators.dedup import dedup
from tidegate.operators.joins import temporal_join
from tidegate.operators.stages import filter_stage, transform_stage
from tidegate.schemas import Schema
from tidegate.sources.otlp import otlp_source, otlp_tagged
from tidegate.streaming.dedup_join import dedup_join_stream, fits
from tidegate.streaming.dedup_stream import dedup_stream
from tidegate.streaming.joins import temporal_join_stream

MIN_ID_LENGTH = 5
LETTER = "dead_letter"


@dataclass(frozen=True)
class DedupRule:
    keys: Sequence[str]
    window: timedelta
    tie: str

    def apply(self, df: DataFrame, ts: str, delay: str) -> DataFrame:
        if df.isStreaming:
            return dedup_stream(df, self.keys, ts, self.window, self.tie, delay)
        return dedup(df, self.keys, ts, self.window, [self.tie])


@dataclass(frozen=True)
class Stage:
    """One stage: filter, then transform, then deduplication; each is optional."""

    where: str | Column | None = None
    columns: Mapping[str, str | Column] | None = None
    dedup: DedupRule | None = None

    def apply(self, df: DataFrame, ts: str, delay: str) -> DataFrame:
        if self.where is not None:
            df = filter_stage(df, self.where)
        if self.columns is not None:
            df = transform_stage(df, self.columns)
        if self.dedup is not None:
            df = self.dedup.apply(df, ts, delay)
        return df


@dataclass(frozen=True)
class Topic:
    rows: DataFrame
    ts: str
    dedup: DedupRule | None = None


@dataclass(frozen=True)
class TemporalJoin:
    on: Sequence[str]
    left_ttl: timedelta
    right_ttl: timedelta

    @staticmethod
    def from_spec(on: Sequence[str], left_buffer_ttl: int, right_buffer_ttl: int) -> TemporalJoin:
        """Buffer times as a spec gives them, in nanoseconds."""
        return TemporalJoin(on, from_nanos(left_buffer_ttl), from_nanos(right_buffer_ttl))


@dataclass(frozen=True)
class Feed:
    """A telemetry feed: payload rows, the signal kind and how to project its flat rows.

    ``dedup`` is for a stored spec without topics: what it deduplicates by, if it does.
    """

    rows: DataFrame
    signal: str
    record: Schema
    columns: Mapping[str, str | Column]
    ts: str
    dedup: DedupRule | None = None


@dataclass(frozen=True)
class Input:
    """What a stored spec does not say of a topic: its rows, their time, and what makes rows equal."""

    rows: DataFrame
    ts: str
    keys: Sequence[str] = ()
    tie: str = ""


@dataclass(frozen=True)
class Flow:
    """Topic(s) or feed to sink.  ``build`` returns what the sink would write."""

    id: str
    topics: Sequence[Topic] = ()
    feed: Feed | None = None
    stage: Stage | None = None
    join: TemporalJoin | None = None
    delay: str = field(default="0 seconds")

    def __post_init__(self):
        if len(self.id) < MIN_ID_LENGTH:
            raise ValueError(f"a pipeline id has at least {MIN_ID_LENGTH} characters")
        if self.feed is not None:
            if self.topics or self.join is not None:
                raise ValueError("a feed goes with neither topics nor a join")
        elif self.join is not None:
            if len(self.topics) != 2:
                raise ValueError("a join needs two topics")
            if self.stage is not None:
                raise ValueError("a joined flow takes deduplication per topic and no other stage")
        elif len(self.topics) != 1:
            raise ValueError("a flow without join has one topic")

    @staticmethod
    def from_spec(
        spec: Row, inputs: Mapping[str, Input], feed: Feed | None = None, on: Sequence[str] = (),
        where: str | Column | None = None, columns: Mapping[str, str | Column] | None = None, delay: str = "0 seconds",
    ) -> Flow:
        """The flow that a spec of ``sources.records.read_specs`` describes.

        ``inputs`` holds the spec's topics by name, ``feed`` the rows of a telemetry source.  A
        join that is enabled takes deduplication from each topic's own switch and window, both
        in nanoseconds, and joins on ``on``.  Any other source has one stage if a transform is
        enabled: ``where`` counts if filters are, ``columns`` if the stateless transform is, and
        deduplication if that is, in the first topic's window or, of a telemetry source without
        topics, by the feed's own rule.
        """
        flags = spec["transform"] or {}
        on_ = lambda name: bool(flags and flags[name])
        topics = list(spec["sources"]["topics"] or [])

        def rule(topic: Row, given: Input) -> DedupRule:
            return DedupRule(given.keys, from_nanos(topic["dedup_window"] or 0), given.tie)

        def read(topic: Row, dedup: bool) -> Topic:
            given = inputs[topic["topic_name"]]
            return Topic(given.rows, given.ts, rule(topic, given) if dedup else None)

        telemetry = spec["sources"]["type"].startswith("otlp.")
        joined = spec["join"]
        if not telemetry and joined and joined["enabled"]:
            join = TemporalJoin.from_spec(on, joined["left_buffer_ttl"] or 0, joined["right_buffer_ttl"] or 0)
            sides = [read(t, bool(t["deduplication"] and t["deduplication"]["enabled"])) for t in topics]
            return Flow(spec["pipeline_id"], sides, join=join, delay=delay)
        stage = None
        if any(map(on_, ("is_dedup_enabled", "is_filter_enabled", "is_stateless_transform_enabled"))):
            dedup = None
            if on_("is_dedup_enabled"):
                if topics:
                    dedup = rule(topics[0], inputs[topics[0]["topic_name"]])
                elif telemetry and feed is not None and feed.dedup is not None:
                    dedup = feed.dedup
                else:
                    raise ValueError("deduplication takes its window from a topic or the feed")
            stage = Stage(where if on_("is_filter_enabled") else None,
                          columns if on_("is_stateless_transform_enabled") else None, dedup)
        if telemetry:
            if feed is None or f"otlp.{feed.signal}" != spec["sources"]["type"]:
                raise ValueError(f"a feed of {spec['sources']['type']} is needed")
            return Flow(spec["pipeline_id"], feed=feed, stage=stage, delay=delay)
        return Flow(spec["pipeline_id"], [read(t, False) for t in topics], stage=stage, delay=delay)

    def in_one_step(self) -> bool:
        """Whether deduplication and join of two streams run as one stateful step."""
        if self.join is None or not all(topic.rows.isStreaming for topic in self.topics):
            return False
        left, right = self.topics
        return fits(left.rows, right.rows, self.join.on, (left.dedup, right.dedup))

    def build(self, groups: int | None = None) -> DataFrame:
        """What the sink would write; ``groups`` as in ``dedup_join_stream``."""
        if self.feed is not None:
            flat, _ = otlp_source(self.feed.rows, self.feed.signal, self.feed.record)
            rows = transform_stage(flat, self.feed.columns)
            return rows if self.stage is None else self.stage.apply(rows, self.feed.ts, self.delay)
        if self.join is not None:
            left, right = self.topics
            j = self.join
            if self.in_one_step():
                return dedup_join_stream(
                    left.rows, right.rows, j.on, left.ts, right.ts, (left.dedup.window, right.dedup.window),
                    (left.dedup.tie, right.dedup.tie), j.left_ttl, j.right_ttl, self.delay, groups,
                )
            l, r = self._deduped(left), self._deduped(right)
            if l.isStreaming or r.isStreaming:
                return temporal_join_stream(l, r, j.on, left.ts, right.ts, j.left_ttl, j.right_ttl, self.delay)
            # Load is measured before deduplication, which would otherwise run twice.
            return temporal_join(
                l, r, j.on, left.ts, right.ts, j.left_ttl, j.right_ttl, left_load=left.rows, right_load=right.rows
            )
        topic = self.topics[0]
        rows = self._deduped(topic)
        return rows if self.stage is None else self.stage.apply(rows, topic.ts, self.delay)

    def dead_letters(self) -> DataFrame:
        """Of a feed: one letter for each payload that does not parse."""
        if self.feed is None:
            raise ValueError("only a feed decodes payloads")
        return otlp_source(self.feed.rows, self.feed.signal, self.feed.record, component=self.id)[1]

    def tagged(self) -> DataFrame:
        """Of a feed: rows and letters of one parse, up to but not including deduplication.

        ``dead_letter`` is null on a row; on a letter the other columns mean nothing.
        """
        if self.feed is None:
            raise ValueError("only a feed decodes payloads")
        both = otlp_tagged(self.feed.rows, self.feed.signal, self.feed.record, component=self.id)
        both = transform_stage(both, {**self.feed.columns, LETTER: F.col(LETTER)})
        if self.stage is not None and self.stage.where is not None:
            where = self.stage.where
            both = filter_stage(both, F.col(LETTER).isNotNull() | (F.expr(where) if isinstance(where, str) else where))
        if self.stage is not None and self.stage.columns is not None:
            both = transform_stage(both, {**self.stage.columns, LETTER: F.col(LETTER)})
        return both

    def _deduped(self, topic: Topic) -> DataFrame:
        if topic.dedup is None:
            return topic.rows
        if topic.rows.isStreaming and self.join is not None:
            raise ValueError("run a streaming join of deduplicated topics with streaming.run.run_flow")
        return topic.dedup.apply(topic.rows, topic.ts, self.delay)
