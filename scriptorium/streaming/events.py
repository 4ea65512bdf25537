"""Structured Streaming: windowed counts with late data, and resumable builds batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, kind, n, total) in tumbling windows; on a stream, events later than ``late`` are left out."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, width).alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total")).select(F.col("w.start").alias("window_start"), "kind", "n", "total")


def build_in_batches(stream: DataFrame, path: str, checkpoint: str, transform=lambda df: df):
    """Start a resumable build: each micro-batch is written to its own folder, so that a repeated batch replaces itself.

    Returns the query, which ends when all available input is taken.
    """

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
