"""Streams of audit events: idempotent delivery, a sliding rate limit and running traffic (an extension: the message
accounting as Structured Streaming)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_event_time(events: DataFrame, ts: str = "ts", delay: str = "2 minutes") -> DataFrame:
    """events with a watermark; timestamps without zone are read in the session's zone, since watermarks refuse them."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def delivered_once(events: DataFrame, message: str = "message_id", ts: str = "ts", delay: str = "2 minutes") -> DataFrame:
    """Each message once: repeats within the watermark are dropped; state is bounded by it."""
    return with_event_time(events, ts, delay).dropDuplicatesWithinWatermark([message])


def rate_limit(events: DataFrame, sender: str, limit: int, ts: str = "ts", window: str = "60 seconds", slide: str = "10 seconds", delay: str = "2 minutes") -> DataFrame:
    """(start, end, sender, requests, allowed) per sliding window."""
    counts = with_event_time(events, ts, delay).groupBy(F.window(ts, window, slide).alias("w"), sender).agg(F.count(F.lit(1)).alias("requests"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), sender, "requests", (F.col("requests") <= limit).alias("allowed"))


def traffic(events: DataFrame, ts: str = "ts", window: str = "1 hour", delay: str = "2 minutes") -> DataFrame:
    """(start, direction, party, messages, bytes) per tumbling window."""
    sums = with_event_time(events, ts, delay).groupBy(F.window(ts, window).alias("w"), "direction", "party").agg(F.count(F.lit(1)).alias("messages"), F.sum("bytes").cast("long").alias("bytes"))
    return sums.select(F.col("w.start").alias("start"), "direction", "party", "messages", "bytes")
