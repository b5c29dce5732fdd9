"""Running a stream over what is there and reading back its output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyframe.common import new_scratch_path


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(path)


def run_available(stream: DataFrame, write_batch, checkpoint: str, mode: str = "append", name: str | None = None):
    """Process all data that is there with a batch function, then stop; returns the finished query."""
    w = stream.writeStream.outputMode(mode).foreachBatch(write_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = (w.queryName(name) if name else w).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return q


def batch_path(base: str, batch_id: int) -> str:
    """A batch owns one folder; running it again replaces the folder, so a retry adds nothing."""
    return f"{base}/batch={batch_id}"


def scratch(spark: SparkSession, label: str) -> str:
    return new_scratch_path(spark, label)


def read_batches(spark: SparkSession, base: str, schema=None) -> DataFrame:
    r = spark.read.schema(schema) if schema is not None else spark.read
    return r.parquet(base)
