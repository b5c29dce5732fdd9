"""Exports of subject data and of table metadata."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.common import union_all


def subject_rows(tables: Mapping[str, DataFrame], identifiers: Mapping[str, Sequence[str]], value) -> DataFrame:
    """All rows of a subject in all tables: source table, matched column and the row as JSON."""
    parts = []
    for name, df in tables.items():
        for col in identifiers.get(name, ()):
            hit = df.where(F.col(f"`{col}`").cast("string") == F.lit(str(value)))
            parts.append(hit.select(F.lit(name).alias("_source_table"), F.lit(col).alias("_matched_column"),
                                    F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("row_json")))
    return union_all(parts)


def write_export(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Write an export with one folder per source table, straight from the executors."""
    if fmt not in ("json", "csv"):
        raise ValueError(f"unknown export format {fmt!r}")
    df.write.mode("overwrite").partitionBy("_source_table").option("header", True).format(fmt).save(path)


def table_inventory(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: columns and rows."""
    return union_all([
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(n).alias("table_name"), F.lit(len(df.columns)).alias("n_columns"), "n_rows")
        for n, df in tables.items()])


def column_inventory(tables: Mapping[str, DataFrame], non_null_counts: bool = True) -> DataFrame:
    """One row per column with position, type and, if asked, its number of non-null values."""
    parts = []
    for name, df in tables.items():
        fields = df.schema.fields
        aggs = [F.count(F.col(f"`{f.name}`") if non_null_counts else F.lit(None)).alias(f"n{i}") for i, f in enumerate(fields)]
        rows: list[Column] = [
            F.struct(F.lit(name).alias("table_name"), F.lit(f.name).alias("column_name"), F.lit(i + 1).alias("ordinal_position"),
                     F.lit(f.dataType.simpleString()).alias("data_type"), F.col(f"n{i}").alias("non_null"))
            for i, f in enumerate(fields)]
        parts.append(df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*"))
    return union_all(parts)
