"""Windows over event streams. The same plan serves a stream and a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream over the Parquet files of a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def windowed(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "1 hour", time: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """Count and sum for each key in tumbling or sliding windows; events later than ``late`` are left out of a stream."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    w = F.window(time, length, slide) if slide else F.window(time, length)
    out = marked.groupBy(w.alias("w"), F.col(key)).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(18,4)")).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", time: str = "ts", key: str = "user_id") -> DataFrame:
    """Count of events in sessions of each key that end after a gap."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    out = marked.groupBy(F.session_window(time, gap).alias("w"), F.col(key)).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
