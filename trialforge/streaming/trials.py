"""Streaming forms: events around alignment events, and runs of close events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def around(events: DataFrame, align: str, before: str, after: str, late: str = "1 hour", key: str = "user_id", label: str = "event_type", ts: str = "ts", tie: str = "event_id", value: str = "value") -> DataFrame:
    """Samples within [-before, after] of each alignment event, as a stream-stream interval join.

    Both sides carry a watermark and the join bounds time on both sides, so
    state is dropped once the watermark has passed the window.
    """
    a = events.where(F.col(label) == align).select(F.col(key).alias("_k"), F.col(tie).alias("align_id"), F.col(ts).alias("align_ts")).withWatermark("align_ts", late)
    s = events.select(key, F.col(tie).alias("sample_id"), F.col(ts).alias("sample_ts"), value).withWatermark("sample_ts", late)
    near = (F.col(key) == F.col("_k")) & (F.col("sample_ts") >= F.col("align_ts") - F.expr(f"INTERVAL {before}")) & (F.col("sample_ts") <= F.col("align_ts") + F.expr(f"INTERVAL {after}"))
    return a.join(s, near).drop("_k")


def sessions(events: DataFrame, gap: str, late: str = "1 hour", key: str = "user_id", ts: str = "ts", value: str = "value") -> DataFrame:
    """Runs of events with less than ``gap`` between neighbours: first and end time, count and sum."""
    w = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w"))
    return w.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "total")


def tumbling(events: DataFrame, width: str, late: str = "1 hour", label: str = "event_type", ts: str = "ts", value: str = "value") -> DataFrame:
    """Counts and sums of each label per fixed window."""
    w = events.withWatermark(ts, late).groupBy(label, F.window(ts, width).alias("w"))
    return w.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(label, F.col("w.start").alias("start"), "n", "total")


def drained(stream: DataFrame, path: str) -> DataFrame:
    """All that the source holds now, run through the stream into ``path`` and read back."""
    q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/_state").option("path", f"{path}/rows").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
