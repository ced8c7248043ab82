"""Keyed state of streams: urls that are known, stories that run, and what came too late.

Both operators keep a small value per key in the state store, which a checkpoint recovers: a restarted query goes on where it
was, and a batch that is repeated gives the same rows. Values end by themselves, so the state is as large as the last days.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillstream.config import DEFAULT
from quillstream.functions.text import url_hash

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state(spark: SparkSession) -> None:
    """Settings for queries that start from now on: state with timers and expiry needs this store, and batches without data are
    off, as a query by the clock would have one after the other and never be through with what is available. So what a watermark
    ends is said with the next batch that has data."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")


def split_late(stream: DataFrame, hours: int = DEFAULT.lookback_hours) -> tuple[DataFrame, DataFrame]:
    """(on time, late) articles: late are those that were published more than so many hours before they were fetched. They are
    a stream of their own, to be stored or counted, and are not lost in the watermark; undated ones are on time."""
    late = F.coalesce(F.col("published_at") < F.col("fetched_at") - F.expr(f"INTERVAL {hours} HOURS"), F.lit(False))
    return stream.filter(~late), stream.filter(late)


class _Known(StatefulProcessor):
    def __init__(self, days: float) -> None:
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "at timestamp", int(self.days * 86_400_000))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = min(rows, key=lambda r: (r.fetched_at is None, r.fetched_at, r.published_at is None, r.published_at))
        known = self.seen.exists()
        self.seen.update((first.fetched_at or dt.datetime(1970, 1, 1),))  # seen again: known for as long again
        if not known:
            yield first

    def close(self) -> None:
        pass


def new_articles(stream: DataFrame, days: float = DEFAULT.continuity_days) -> DataFrame:
    """Articles (url, published_at, fetched_at, ...) whose url isn't known: of several in a batch the one fetched first. A url
    is known for so many days (by the clock) after it was last seen; null urls are one url."""
    use_state(stream.sparkSession)
    keyed = stream.withColumn("url_hash", url_hash(F.coalesce("url", F.lit(""))))
    return keyed.groupBy("url_hash").transformWithState(_Known(days), keyed.schema, "Append", "ProcessingTime")


#: Times are microseconds in the state, so that no worker's time zone matters.
_STORY = "key string, first_us long, last_us long, articles long, status string"


class _Running(StatefulProcessor):
    def __init__(self, days: float) -> None:
        self.gap = int(days * 86_400_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.story = handle.getValueState("story", "first_us long, last_us long, articles long")

    def _timer(self, last: int) -> int:
        return -(-(last + self.gap) // 1000)

    def _row(self, key, story: tuple[int, int, int], status: str) -> Row:
        return Row(key=key[0], first_us=story[0], last_us=story[1], articles=story[2], status=status)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        story, status = None, "new"
        if self.story.exists():
            story, status = tuple(self.story.get()), "running"
            self.handle.deleteTimer(self._timer(story[1]))
        for at in sorted(r.us for r in rows):
            if story and at - story[1] >= self.gap:
                yield self._row(key, story, "ended")
                story, status = None, "new"
            story = (min(story[0], at), max(story[1], at), story[2] + 1) if story else (at, at, 1)
        self.story.update(story)
        self.handle.registerTimer(self._timer(story[1]))
        yield self._row(key, story, status)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.story.exists():
            story = tuple(self.story.get())
            self.story.clear()
            yield self._row(key, story, "ended")

    def close(self) -> None:
        pass


def running_stories(stream: DataFrame, days: float = DEFAULT.continuity_days, hours: int = DEFAULT.lookback_hours) -> DataFrame:
    """What a stream of story members (key, event_ts) says of each story: a row for each batch that touches it (new, then
    running), and one when it ends, that is when its next member is `days` later, or when the watermark is. A key that comes
    back after that is a new story. Members without a time don't count."""
    use_state(stream.sparkSession)
    timed = stream.filter("event_ts is not null").withWatermark("event_ts", f"{hours} hours").withColumn("us", F.unix_micros("event_ts"))
    out = timed.groupBy("key").transformWithState(_Running(days), _STORY, "Append", "EventTime")
    at = lambda c, name: F.timestamp_micros(c).alias(name)
    return out.select("key", at("first_us", "first_seen"), at("last_us", "last_seen"), "articles", "status")
