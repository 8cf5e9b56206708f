"""The trace fold as a stream: the same aggregate, kept up by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def observed_pairs(spans: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Counts of (caller, callee) by hour from a stream of spans (span_id, ts,
    caller, callee); a span that comes twice within the watermark counts once."""
    one = spans.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["span_id"])
    return one.groupBy(F.window("ts", "1 hour").alias("hour"), "caller", "callee").agg(F.count("*").alias("observed"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Process all input that is there, into the in-memory table ``name``."""
    return stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
