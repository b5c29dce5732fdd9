"""Continuous application of change rows to a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators.changes import apply_changes
from tallyframe.sources.changefeed import META, last_change_per_key
from tallyframe.streaming.common import batch_path, read_batches, run_available


def collect_changes(stream: DataFrame, keys: Sequence[str], log: str, checkpoint: str):
    """Write the last change per key of every batch to a log next to the table.

    A batch costs as much as its changes, not as the table. Its folder is replaced when it is run
    again, and the version kept with each row decides between batches, so replays change nothing."""

    def write(df: DataFrame, batch_id: int) -> None:
        last_change_per_key(df, keys).write.mode("overwrite").parquet(batch_path(log, batch_id))

    return run_available(stream, write, checkpoint)


def current_state(spark: SparkSession, base: DataFrame, log: str, keys: Sequence[str]) -> DataFrame:
    """The table with all logged changes applied (merge on read)."""
    changes = read_batches(spark, log).select(*META, *base.columns)
    return apply_changes(base, changes, keys)


def high_water_mark(spark: SparkSession, log: str) -> DataFrame:
    return read_batches(spark, log).agg(F.max("_commit_version").alias("version"))


def compact(spark: SparkSession, base: DataFrame, log: str, keys: Sequence[str], out: str) -> DataFrame:
    """Write the current state as a new base table; the log up to it is no longer needed."""
    current_state(spark, base, log, keys).write.mode("overwrite").parquet(out)
    return spark.read.schema(base.schema).parquet(out)
