"""Streaming ingest: known urls are dropped within the look-back, days are counted with late data bounded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillstream.config import DEFAULT
from quillstream.functions.text import url_hash


def distinct_articles(stream: DataFrame, hours: int = DEFAULT.lookback_hours) -> DataFrame:
    """Articles whose url wasn't seen within the look-back; state older than the watermark is dropped."""
    timed = stream.withColumn("event_ts", F.coalesce("published_at", "fetched_at")).withColumn("url_hash", url_hash(F.col("url")))
    return timed.withWatermark("event_ts", f"{hours} hours").dropDuplicatesWithinWatermark(["url_hash"])


def daily_counts(stream: DataFrame, key: str, ts: str = "event_ts", hours: int = DEFAULT.lookback_hours) -> DataFrame:
    return stream.withWatermark(ts, f"{hours} hours").groupBy(F.window(ts, "1 day").start.alias("day"), key).agg(F.count("*").alias("n"))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there and stop, as a scheduled micro-batch does; the checkpoint makes it exactly once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def batches_available(stream: DataFrame, path: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] = lambda df: df, mode: str = "update") -> StreamingQuery:
    """As run_available(), through a function of each micro-batch, such as a merge with a stored table. A batch has a folder
    of its own, which its repetition overwrites, so that it counts once also where the sink can't tell."""

    def write(batch: DataFrame, number: int) -> None:
        change(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
