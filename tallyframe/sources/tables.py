"""Table scans, filtered and empty copies, appends and partitioned writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Read one table from a folder of parquet tables."""
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


def sql_source(spark: SparkSession, query: str, **views: DataFrame) -> DataFrame:
    """Any SQL text as a source; the frames it names are passed as keyword arguments."""
    return spark.sql(query, **views)


def filtered_copy(df: DataFrame, where: str | None = None) -> DataFrame:
    return df.where(F.expr(where)) if where else df


def schema_only_copy(df: DataFrame) -> DataFrame:
    """Same columns and types, no rows; the filter folds to an empty relation, so nothing is read."""
    return df.where(F.lit(False))


def select_tables(inventory: DataFrame, include: str | None = None, exclude: str | None = None,
                  name: str = "table_name") -> DataFrame:
    out = inventory
    if include:
        out = out.where(F.col(name).rlike(include))
    if exclude:
        out = out.where(~F.col(name).rlike(exclude))
    return out


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_partitioned(df: DataFrame, path: str, partition_cols: Sequence[str], rows_per_file: int = 5_000_000) -> None:
    """Partitioned write. Large partitions are split by maxRecordsPerFile; the rebalance hint lets
    AQE size the tasks, also when one partition value holds most of the rows."""
    (df.hint("rebalance", *partition_cols)
       .write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
       .partitionBy(*partition_cols).parquet(path))


def add_ingestion_columns(df: DataFrame, source_file, ingested_at) -> DataFrame:
    """`_ingested_at`, `_source_file` and a content-derived `_raw_id` (stable when a task is rerun)."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    return df.select(
        "*",
        ingested_at.alias("_ingested_at"),
        source_file.alias("_source_file"),
        F.md5(F.to_json(F.struct(*cols))).alias("_raw_id"),
    )
