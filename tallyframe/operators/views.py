"""Shapes of business views."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.common import spread_join


def summary(df: DataFrame, by: Sequence, aggs: Sequence[Column], where: Column | None = None, having: Column | None = None) -> DataFrame:
    """Filter, group, aggregate, filter the groups."""
    rows = df if where is None else df.where(where)
    out = rows.groupBy(*by).agg(*aggs)
    return out if having is None else out.where(having)


def enrich(facts: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, how: str = "inner") -> DataFrame:
    """Facts with the row of their dimension; a hot dimension key is spread."""
    return spread_join(facts, dim.withColumnRenamed(dim_key, fact_key), [fact_key], how)


def counts_per_entity(entities: DataFrame, key: str, facts: Mapping[str, tuple[DataFrame, str, Column]]) -> DataFrame:
    """Distinct counts of several fact tables per entity. Each fact table is counted per key before
    the join, so the tables do not multiply each other's rows."""
    out = entities
    for name, (df, fk, what) in facts.items():
        n = df.groupBy(F.col(fk).alias(key)).agg(F.count_distinct(what).alias(name))
        out = out.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def trend(df: DataFrame, at: str, grain: str, by: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    period = F.date_format(F.date_trunc(grain, F.col(at)), "yyyy-MM-dd")
    return df.groupBy(period.alias("period"), *by).agg(*aggs)


def rate(cond: Column, decimals: int = 2) -> Column:
    """Share of rows that fulfil a condition, in percent."""
    return F.round(F.count_if(cond) * 100.0 / F.count(F.lit(1)), decimals)


def ratio_of_sums(a: Column, b: Column, decimals: int = 2) -> Column:
    from tallyframe.common import exact_sum

    return F.round(exact_sum(a) * 100 / F.greatest(exact_sum(b), F.lit(1.0)), decimals)
