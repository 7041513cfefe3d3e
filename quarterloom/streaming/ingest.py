"""Continuous ingestion: forecasts with first-wins, and windows over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.scoring import KEYS

FORECAST_SCHEMA = "firm string, target string, origin long, horizon long, prediction float, arrived timestamp"


def forecast_stream(spark: SparkSession, folder: str, delay: str = "7 days") -> DataFrame:
    """New forecast files as a stream, the first row of a key only.

    Keys are remembered for ``delay`` behind the watermark on ``arrived``, so state stays bounded.
    """
    s = spark.readStream.schema(FORECAST_SCHEMA).parquet(folder)
    return s.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(list(KEYS))


def event_windows(events: DataFrame, width: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts and sums by type in tumbling or sliding windows; late rows beyond ``delay`` fall away in streams."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    e = events.withWatermark("ts", delay) if events.isStreaming else events
    g = e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n", "total")


def event_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of a user: events less than ``gap`` apart."""
    e = events.withWatermark("ts", delay) if events.isStreaming else events
    g = e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n_events"))
    return g.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def write_stream(df: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append to Parquet with exactly-once files; ``once`` handles what is there and stops."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return w.trigger(availableNow=True).start() if once else w.start()
