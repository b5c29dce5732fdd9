"""Closing windows of a stream: append-mode aggregates and marks that move the watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IS_MARK = "__is_mark"


def advance(spark: SparkSession, clock: str, at) -> None:
    """Write a mark: no row before ``at``, less the watermark's delay, will follow. Streams that read
    the clock's folder close their windows up to there, also when no further rows arrive."""
    spark.range(1).select(F.lit(at).cast("timestamp").alias("at")).write.mode("append").parquet(clock)


def start_clock(spark: SparkSession, clock: str) -> str:
    """A new clock, whose first mark says nothing."""
    advance(spark, clock, "1970-01-01")
    return clock


def closed(stream: DataFrame, at: str, window: str, watermark: str, keys: Sequence[str], aggs: Sequence[Column], clock: str | None = None) -> DataFrame:
    """Aggregates per time window and keys, each given out once, when the watermark has passed the window.

    Spark adds up rows before they are shuffled, so a window or key with a great share of the rows
    costs no task more than others; state holds open windows alone. A mark makes a row of its own group,
    which is left out again."""
    rows = stream.withColumn(IS_MARK, F.lit(False))
    if clock:
        marks = stream.sparkSession.readStream.schema("at timestamp").parquet(clock)
        rows = rows.unionByName(marks.select(F.col("at").cast(stream.schema[at].dataType).alias(at), F.lit(True).alias(IS_MARK)), allowMissingColumns=True)
    # The filter reads an aggregate: one on the grouping column would be pushed down, and marks would never
    # reach the watermark.
    only_marks = "__only_marks"
    counted = rows.withWatermark(at, watermark).groupBy(F.window(at, window), *keys, IS_MARK).agg(*aggs, F.min(IS_MARK).alias(only_marks))
    return counted.where(~F.col(only_marks)).drop(only_marks, IS_MARK)
