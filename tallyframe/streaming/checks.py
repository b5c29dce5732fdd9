"""Row checks on a stream with valid and quarantine outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators.checkset import Check, apply_checks
from tallyframe.streaming.common import batch_path, read_batches, run_available


def check_stream(stream: DataFrame, checks: Sequence[Check], out: str, checkpoint: str):
    """Write every batch once, passing rows below outcome=valid and failing rows, with the failed
    checks, below outcome=quarantine of the batch's folder."""

    def write(df: DataFrame, batch_id: int) -> None:
        checked = apply_checks(df, checks)
        outcome = F.when(F.size("_errors") == 0, "valid").otherwise("quarantine")
        checked.withColumn("outcome", outcome).write.mode("overwrite").partitionBy("outcome").parquet(batch_path(out, batch_id))

    return run_available(stream, write, checkpoint)


def outputs(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and quarantined rows with their failed checks, of all batches."""
    rows = read_batches(spark, out)
    good, bad = (rows.where(F.col("outcome") == x).drop("batch", "outcome") for x in ("valid", "quarantine"))
    return good.drop("_errors", "_warnings"), bad
