"""The file-event stream: exclusion, debouncing, change application. Batch and stream share the same expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions import paths

SCHEMA = "event_id long, ts timestamp, kind string, path string, dest string"
INDEX_DELAY, GRAPH_DELAY = "2 seconds", "5 seconds"


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events from JSON files that appear in a folder."""
    return spark.readStream.schema(SCHEMA).json(folder)


def relevant(events: DataFrame) -> DataFrame:
    """Events of paths that are not excluded; a move stays if either end is not."""
    kept = ~paths.watch_excluded(F.col("path"))
    moved = (F.col("kind") == "moved") & F.col("dest").isNotNull() & ~paths.watch_excluded(F.coalesce("dest", F.lit("")))
    return events.filter(kept | moved)


def debounced(events: DataFrame, delay: str = INDEX_DELAY, late: str = "10 minutes") -> DataFrame:
    """(path, start, end, events): bursts of events of a path; a pause longer than the delay ends one.

    Every event resets the timer, which is a session window. On a stream, the watermark bounds the state.
    """
    if events.isStreaming:  # watermarks need time stamps with a zone; the session's is UTC
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.session_window("ts", delay)
    return events.groupBy("path", w).agg(F.count("*").alias("events")).select("path", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events of each kind a day: a tumbling window with a watermark."""
    if events.isStreaming:  # watermarks need time stamps with a zone; the session's is UTC
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return events.groupBy(F.window("ts", "1 day"), "kind").agg(F.count("*").alias("events")).select(F.col("window.start").alias("day"), "kind", "events")
