"""Composite scores, category rates, incident feeds and event listings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.common import as_ts, union_all

# ---- Fixed values: weights of the scores ----
HEALTH_WEIGHTS = {"freshness": 0.4, "anomaly": 0.3, "reconciliation": 0.3}
OBSERVABILITY_WEIGHTS = {"freshness": 0.25, "volume": 0.15, "anomaly": 0.20, "sla": 0.25, "dq": 0.15}


def event_listing(events: DataFrame, kind: str, kinds: Sequence[str], at: str, start: str, end: str, scope: Column) -> DataFrame:
    """Events of some kinds within a scope and a period, newest first."""
    when = (F.col(at) >= as_ts(start)) & (F.col(at) < as_ts(end))
    return events.where(F.col(kind).isin(list(kinds)) & when & scope).orderBy(F.col(at).desc())


def anomaly_score(critical: Column, warning: Column) -> Column:
    """100 less ten points per critical and three per warning finding, not below 0."""
    return F.greatest(F.lit(0), 100 - F.least(F.lit(100), critical * 10 + warning * 3)).cast("double")


def composite_health(scores: DataFrame, weights: Mapping[str, float] = HEALTH_WEIGHTS) -> DataFrame:
    """Weighted mean of the dimensions that are present, with a status."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for d, w in weights.items():
        total = total + F.coalesce(F.col(d) * w, F.lit(0.0))
        weight = weight + F.when(F.col(d).isNotNull(), w).otherwise(0.0)
    raw = F.when(weight > 0, total / weight)
    status = F.when(raw.isNull(), "unknown").when(raw >= 90, "healthy").when(raw >= 70, "warning").otherwise("critical")
    return scores.select("*", F.round(raw, 1).alias("composite_score"), status.alias("status"))


def category_rates(checks: DataFrame, at: str, since: str) -> DataFrame:
    """Checks, passes and pass rate per category (columns category, passed) since a time; a
    category without checks counts as 100 % when the rates are combined."""
    return (checks.where(F.col(at) >= as_ts(since)).groupBy("category")
            .agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"))
            .withColumn("rate", F.round(F.col("passed") / F.col("total") * 100, 1)))


def observability_score(rates: DataFrame, weights: Mapping[str, float] = OBSERVABILITY_WEIGHTS) -> DataFrame:
    """Weighted score 0..100 of the category rates."""
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + F.coalesce(F.max(F.when(F.col("category") == c, F.col("rate"))), F.lit(100.0)) * w
    return rates.agg(F.greatest(F.lit(0), F.least(F.lit(100), F.round(total / sum(weights.values())))).cast("long").alias("score"))


def issue_feed(parts: Mapping[str, DataFrame], n: int) -> DataFrame:
    """Top issues over several sources (severity, seen_at, title), most severe and newest first."""
    u = union_all([df.select(F.lit(k).alias("source"), "severity", "seen_at", "title") for k, df in parts.items()])
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return u.orderBy(rank, F.desc("seen_at"), "source", "title").limit(n)


def daily_trend(checks: DataFrame, at: str) -> DataFrame:
    """Checks and mean pass rate per category and day."""
    return checks.groupBy("category", F.to_date(at).cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"),
        F.round(F.avg(F.col("passed").cast("double")) * 100, 1).alias("pass_rate"))


def catalog_health(ops: DataFrame, catalog: str, failed: Column, ok: Column, failed_tables: Column, at: str) -> DataFrame:
    """Score per catalog from its operations: deductions for the failure rate, for failed tables
    and for never having run."""
    g = ops.groupBy(F.col(catalog).alias("catalog")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(failed).alias("failed"),
        F.coalesce(F.sum(failed_tables), F.lit(0)).cast("long").alias("tables_failed"), F.max(at).alias("last_operation"))
    rate = F.col("failed") / F.greatest("total", F.lit(1))
    score = (100 - F.when(rate > 0.5, 30).when(rate > 0.2, 20).when(rate > 0, 10).otherwise(0)
             - F.when(F.col("tables_failed") > 5, 15).when(F.col("tables_failed") > 0, 5).otherwise(0)
             - F.when(F.col("last_operation").isNull(), 10).otherwise(0))
    return g.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), score)))
