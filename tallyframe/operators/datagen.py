"""Synthetic tables, quality issues, seasons and medallion layers.

Values are functions of the row id (leading 32 bits of an md5), so a rerun task or another engine
gives the same rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.common import as_ts, top_rows

MIN_PARENT_ROWS = 100


def noise(ident: Column, name: str) -> Column:
    """Repeatable whole number 0 .. 2**32 - 1 for an id and a name."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(name), ident.cast("string"))), 1, 8), 16, 10).cast("long")


@dataclass(frozen=True)
class Choice:
    values: Sequence[str]

    def column(self, h: Column) -> Column:
        return F.get(F.array(*[F.lit(v) for v in self.values]), (h % len(self.values)).cast("int"))


@dataclass(frozen=True)
class Number:
    low: float
    high: float
    decimals: int = 2

    def column(self, h: Column) -> Column:
        steps = int(round((self.high - self.low) * 10 ** self.decimals)) + 1
        return F.round(F.lit(self.low) + (h % steps) / 10 ** self.decimals, self.decimals)


@dataclass(frozen=True)
class Day:
    start: str
    days: int

    def column(self, h: Column) -> Column:
        return F.date_add(F.lit(self.start).cast("date"), (h % self.days).cast("int"))


@dataclass(frozen=True)
class ForeignKey:
    parent_rows: int
    scale: float = 1.0

    @property
    def size(self) -> int:
        return max(MIN_PARENT_ROWS, int(self.parent_rows * self.scale))

    def column(self, h: Column) -> Column:
        return h % self.size + 1


def row_ids(spark: SparkSession, rows: int, scale: float = 1.0, partitions: int | None = None) -> DataFrame:
    """Ids 1 .. rows * scale, made on the executors."""
    n = max(1, int(rows * scale))
    return spark.range(1, n + 1, 1, partitions) if partitions else spark.range(1, n + 1)


def generate(ids: DataFrame, spec: Mapping[str, Choice | Number | Day | ForeignKey], offset: int = 0) -> DataFrame:
    """One generated row per id; a later chunk of the same table starts at another offset."""
    rid = F.col("id") + offset
    return ids.select(rid.alias("id"), *[s.column(noise(rid, name)).alias(name) for name, s in spec.items()])


def inject_issues(df: DataFrame, key: str, null_column: str, outlier_column: str, copies: int = 100) -> DataFrame:
    """1 % NULLs, 0.1 % values times 1000 and a number of repeated rows."""
    k = F.col(key)
    dirty = df.withColumns({
        null_column: F.when(noise(k, "null") % 100 != 0, F.col(null_column)),
        outlier_column: F.when(noise(k, "outlier") % 1000 == 0, F.col(outlier_column) * 1000).otherwise(F.col(outlier_column))})
    return dirty.unionByName(dirty.orderBy(noise(k, "copy"), key).limit(copies))


def add_season(df: DataFrame, key: str, day: str, first_month: int, last_month: int, share: int = 15) -> DataFrame:
    """Add copies of a share of the off-season rows, moved into the peak months of their year."""
    span = (last_month - first_month) % 12 + 1
    month = F.month(day)
    in_peak = ((month - first_month + 12) % 12) < span
    moved = df.where(~in_peak & (noise(F.col(key), "season") % 100 < share))
    shift = F.lit(first_month) + (noise(F.col(key), "month") % span).cast("int") - month
    return df.unionByName(moved.withColumn(day, F.add_months(day, shift).cast(df.schema[day].dataType)))


def bronze(df: DataFrame, source_file: Column, ingested_at) -> DataFrame:
    from tallyframe.sources.tables import add_ingestion_columns

    return add_ingestion_columns(df, source_file, as_ts(ingested_at))


def silver(df: DataFrame, key: str, newest: str, types: Mapping[str, str]) -> DataFrame:
    """Clean rows: a key, one row per key (the newest), declared types (NULL where a cast fails),
    without the ingestion columns."""
    from tallyframe.operators.reconcile import digest

    plain = [c for c in df.columns if c not in ("_ingested_at", "_source_file", "_raw_id")]
    typed = df.where(F.col(key).isNotNull()).select(*[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in plain])
    return top_rows(typed, [key], [F.desc(newest), digest([F.col(c) for c in plain])])


def version_history(df: DataFrame, key: str, update: Mapping[str, Column], versions: int, share: int, start: str) -> DataFrame:
    """Change feed of successive updates: at each version a share of the rows gets new values."""
    from tallyframe.common import union_all

    parts = []
    for v in range(1, versions + 1):
        hit = df.where(noise(F.col(key), f"v{v}") % 100 < share)
        at = F.timestamp_add("DAY", F.lit(v - 1), as_ts(start))
        for kind, row in (("update_preimage", hit), ("update_postimage", hit.withColumns(dict(update)))):
            parts.append(row.select(F.lit(kind).alias("_change_type"), F.lit(v).cast("long").alias("_commit_version"), at.alias("_commit_timestamp"), *df.columns))
    return union_all(parts)
