"""Registry of runnable queries: one Spark plan and, where SQL can say it, one SQL text per key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Lazy access to the tables of one folder: ``t.orders`` is a scan of orders."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base

    def __getattr__(self, name: str) -> DataFrame:
        from tallyframe.sources.tables import scan

        if name.startswith("_"):
            raise AttributeError(name)
        return scan(self.spark, self.base, name)


def query(key: str, sql: str | None = None):
    """Register a plan built from a Tables object."""

    def wrap(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = lambda spark, base: fn(Tables(spark, base))
        if sql:
            SQL[key] = sql.strip()
        return fn

    return wrap
