"""Freshness of tables and service levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.common import as_ts, unpivot_stats
from tallyframe.operators.relational import latest_rows


def freshness(inventory: DataFrame, at: str, as_of, max_stale_hours: float) -> DataFrame:
    """Hours since the last change per table and whether it is fresh, stale or unknown."""
    hours = F.timestamp_diff("SECOND", F.col(at).cast("timestamp_ntz"), as_ts(as_of)) / 3600
    st = F.when(F.col(at).isNull(), "unknown").when(hours <= max_stale_hours, "fresh").otherwise("stale")
    return inventory.select("*", F.round(hours, 2).alias("hours_since_update"), st.alias("status"))


def freshness_counts(status: DataFrame) -> DataFrame:
    n = {s: F.count_if(F.col("status") == s) for s in ("fresh", "stale", "unknown")}
    return status.agg(F.count(F.lit(1)).alias("total_tables"), *[v.alias(k) for k, v in n.items()])


def history(rows: DataFrame, table: str, name: str, at: str, n: int) -> DataFrame:
    """Latest n recorded rows of a table, newest first."""
    return rows.where(F.col(table) == name).orderBy(F.col(at).desc()).limit(n)


def sla_freshness(df: DataFrame, column: str, as_of, max_hours: float) -> DataFrame:
    hours = F.timestamp_diff("SECOND", F.max(F.col(column)).cast("timestamp_ntz"), as_ts(as_of)) / 3600
    return _result(df.agg(F.round(hours, 2).alias("v")), "freshness", max_hours, lambda v: v <= max_hours)


def sla_row_count(df: DataFrame, minimum: int) -> DataFrame:
    return _result(df.agg(F.count(F.lit(1)).cast("double").alias("v")), "row_count", minimum, lambda v: v >= minimum)


def _result(one: DataFrame, metric: str, threshold: float, test) -> DataFrame:
    return one.select(F.lit(metric).alias("metric"), F.col("v").alias("current_value"), F.lit(float(threshold)).alias("threshold"),
                      test(F.col("v")).alias("passed"))


def null_percentages(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL share in percent per column."""
    cols = list(columns)
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    one = df.agg(*[F.round((F.count(F.lit(1)) - F.count(F.col(f"`{c}`"))) / n * 100, 2).alias(f"p{i}") for i, c in enumerate(cols)])
    return unpivot_stats(one, {c: {"null_pct": f"p{i}"} for i, c in enumerate(cols)})


def sla_completeness(df: DataFrame, columns: Sequence[str], max_null_pct: float) -> DataFrame:
    """Mean NULL share over the columns against the limit, with the highest one."""
    p = null_percentages(df, columns).agg(F.round(F.avg("null_pct"), 2).alias("v"), F.max("null_pct").alias("max_null_pct"))
    return p.select(F.lit("completeness").alias("metric"), F.col("v").alias("current_value"), F.lit(float(max_null_pct)).alias("threshold"),
                    (F.col("v") <= max_null_pct).alias("passed"), "max_null_pct")


def sla_accuracy(details: DataFrame, min_match_rate: float) -> DataFrame:
    """Match rate of the latest reconciliation of every table against the minimum.

    details: (table_name, executed_at, source_count, matched_rows)."""
    last = latest_rows(details, ["table_name"], "executed_at", ties=False)
    rate = F.round(F.col("matched_rows") / F.greatest("source_count", F.lit(1)) * 100, 2)
    return last.select("table_name", rate.alias("match_rate"), (rate >= min_match_rate).alias("passed"))


def sla_schema_stability(history_rows: DataFrame, operations: Sequence[str], last_n: int = 10) -> DataFrame:
    """Schema-changing operations among the last entries of every table: none may occur.

    history: (table_name, version, operation)."""
    from tallyframe.common import top_rows

    recent = top_rows(history_rows, ["table_name"], [F.desc("version")], last_n)
    n = F.count_if(F.col("operation").isin(list(operations)))
    return recent.groupBy("table_name").agg(n.alias("schema_changes"), (n == 0).alias("passed"))


def sla_status(checks: DataFrame, rules: DataFrame) -> DataFrame:
    """Latest check of every rule with the rule itself."""
    return rules.join(latest_rows(checks, ["rule_id"], "checked_at"), "rule_id", "left")


def sla_trend(checks: DataFrame, at: str, since: str) -> DataFrame:
    """Share of passed checks per day since a time."""
    g = checks.where(F.col(at) >= since).groupBy(F.to_date(at).cast("string").alias("check_date")).agg(
        F.count(F.lit(1)).alias("total_checks"), F.count_if("passed").alias("passed_checks"))
    return g.withColumn("compliance_pct", F.round(F.col("passed_checks") / F.col("total_checks") * 100, 1))
