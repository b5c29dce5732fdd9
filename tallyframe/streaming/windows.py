"""Windowed counts on a stream: minimum records per window and late arrivals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.streaming.clock import closed
from tallyframe.streaming.common import batch_path, read_batches, run_available


def count_windows(stream: DataFrame, at: str, window: str, watermark: str, out: str, checkpoint: str, *aggs, clock: str | None = None):
    """Counts (and further aggregates) per time window. Every batch writes the windows that it closes, so each
    window is written once and a batch costs as much as its rows, however long the stream has run."""
    counted = closed(stream, at, window, watermark, [], [F.count(F.lit(1)).alias("n_rows"), *aggs], clock)
    rows = counted.select(F.col("window.start").alias("window_start"), *[c for c in counted.columns if c != "window"])

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(batch_path(out, batch_id))

    return run_available(rows, write, checkpoint)


def closed_windows(spark, out: str) -> DataFrame:
    """All windows closed so far. Nothing is merged: no two batches hold the same window."""
    return read_batches(spark, out).drop("batch")


def too_few(windows: DataFrame, min_count: int) -> DataFrame:
    return windows.withColumn("failed", F.col("n_rows") < min_count)


def late_arrivals(stream: DataFrame, event_time: str, arrival_time: str, window: str, watermark: str, max_lag_minutes: int, out: str, checkpoint: str,
                  clock: str | None = None):
    """Rows and late rows per event-time window; a row is late when it arrives too long after its
    event. Rows behind the watermark are dropped by the engine and show in the query's progress."""
    lag = F.timestamp_diff("SECOND", F.col(event_time), F.col(arrival_time))
    flagged = stream.withColumn("__late", (lag > max_lag_minutes * 60).cast("long"))
    return count_windows(flagged, event_time, window, watermark, out, checkpoint, F.sum("__late").alias("late_rows"), clock=clock)


def dropped_rows(query) -> int:
    """Rows that arrived behind the watermark, over all batches of a query."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in p.get("stateOperators", []))
