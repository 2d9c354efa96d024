"""Extension: windowed counts of a stream of events with late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, ts: str = "ts", by: str = "event_type", value: str = "value", width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """start, by, n and total of each window; the same for a static table and for a stream."""
    at = F.col(ts).cast("timestamp")
    rows = events.withColumn("_ts", at)
    rows = rows.withWatermark("_ts", late) if events.isStreaming else rows
    w = F.window("_ts", width, slide) if slide else F.window("_ts", width)
    return rows.groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), by, "n", "total")


def sessions(events: DataFrame, ts: str = "ts", user: str = "user_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user, start, end and n of each session."""
    rows = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    rows = rows.withWatermark("_ts", late) if events.isStreaming else rows
    w = F.session_window("_ts", gap)
    return rows.groupBy(w.alias("w"), user).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")
