"""Structured Streaming over event files: windows with watermarks, sessions, deduplication.

These go beyond the batch operators: the same plans run on a static table and
on a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id LONG, ts TIMESTAMP_NTZ, user_id LONG, event_type STRING, value DOUBLE, props STRING"


def stream(spark: SparkSession, folder: str, schema: str = EVENTS, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream, with event time as a timestamp."""
    found = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return found.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; state is kept until the watermark passes a window's end."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user that end after a gap."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """Each key's event once: within the watermark for a stream, in all for a table."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Write all that is available to Parquet files, exactly once over restarts, then stop."""
    df.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
