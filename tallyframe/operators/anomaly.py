"""Metric baselines and anomalies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.common import spread_join, top_rows

WARNING, CRITICAL, MIN_POINTS, BASELINE = 2.0, 3.0, 3, 30


def trailing_baseline(metrics: DataFrame, keys: Sequence[str], at: str, value: str, n: int = BASELINE) -> DataFrame:
    """Mean and population stddev of the n measurements before each one."""
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(-n, -1)
    return metrics.select("*", F.avg(value).over(w).alias("baseline_mean"), F.stddev_pop(value).over(w).alias("baseline_stddev"),
                          F.count(value).over(w).alias("n_points"))


def severity(z: Column, warning: float = WARNING, critical: float = CRITICAL) -> Column:
    return F.when(z > critical, "critical").when(z > warning, "warning").otherwise("normal")


def score_metrics(metrics: DataFrame, keys: Sequence[str], at: str, value: str, n: int = BASELINE,
                  warning: float = WARNING, critical: float = CRITICAL) -> DataFrame:
    """z-score of every measurement against its trailing baseline; fewer than three points or no
    spread give 0."""
    b = trailing_baseline(metrics, keys, at, value, n)
    enough = F.col("n_points") >= MIN_POINTS
    v = F.col(value)
    mean = F.when(enough, F.col("baseline_mean")).otherwise(v)
    sd = F.when(enough, F.col("baseline_stddev")).otherwise(F.lit(0.0))
    # A spread that is only rounding noise of equal values counts as none.
    z = F.when(F.col("baseline_stddev") > F.abs(F.col("baseline_mean")) * 1e-12, F.abs(v - F.col("baseline_mean")) / F.col("baseline_stddev")).otherwise(0.0)
    out = b.withColumns({"baseline_mean": mean, "baseline_stddev": sd})
    return out.withColumn("z_score", z).withColumn("is_anomaly", F.col("z_score") > warning).withColumn(
        "severity", severity(F.col("z_score"), warning, critical))


def baseline_bands(metrics: DataFrame, keys: Sequence[str], value: str, warning: float = WARNING, critical: float = CRITICAL) -> DataFrame:
    """Mean, population stddev and the warning and critical bands around the mean, per key."""
    g = metrics.groupBy(*keys).agg(F.count(value).alias("n_points"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("stddev"))
    m, s = F.col("mean"), F.col("stddev")
    return g.select("*", (m - warning * s).alias("lower_warning"), (m + warning * s).alias("upper_warning"),
                    (m - critical * s).alias("lower_critical"), (m + critical * s).alias("upper_critical"))


def recompute_baselines(metrics: DataFrame, keys: Sequence[str], at: str, value: str, n: int = BASELINE, min_points: int = 2) -> DataFrame:
    """Fresh baselines from the newest n measurements of every key with enough points."""
    last = top_rows(metrics, keys, [F.col(at).desc()], n)
    g = last.groupBy(*keys).agg(F.count(value).alias("n_points"), F.avg(value).alias("new_mean"), F.stddev_pop(value).alias("new_stddev"))
    return g.where(F.col("n_points") >= min_points)


def list_anomalies(scored: DataFrame, at: str, severities: Sequence[str] = ("critical", "warning")) -> DataFrame:
    """Anomalies by severity, newest first."""
    rank = F.when(F.col("severity") == "critical", 0).otherwise(1)
    return scored.where(F.col("severity").isin(list(severities))).orderBy(rank, F.col(at).desc())


def collect_metrics(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """row_count, null_rate and distinct_rows of a table as metric rows; the null rate is the mean over all columns."""
    from tallyframe.common import union_all
    from tallyframe.operators.relational import distinct_rows, mean_null_rate

    cols = list(columns)
    base = df.agg(F.count(F.lit(1)).cast("double").alias("row_count"), mean_null_rate(df, cols).alias("null_rate"))
    dist = distinct_rows(df.select(*columns), columns).select(F.col("distinct_rows").cast("double").alias("value"))
    return union_all([
        base.select(F.explode(F.create_map(F.lit("row_count"), "row_count", F.lit("null_rate"), "null_rate")).alias("metric_name", "value")),
        dist.select(F.lit("distinct_count").alias("metric_name"), "value"),
    ]).select(F.lit(table).alias("table_fqn"), "metric_name", "value")


def period_outliers(totals: DataFrame, value: str, warning: float = WARNING) -> DataFrame:
    """Period totals whose distance from the mean exceeds the threshold (sample stddev)."""
    s = totals.agg(F.avg(value).alias("m"), F.stddev(value).alias("s"))
    out = totals.select("*", s.select("m").scalar().alias("mean_value"), s.select("s").scalar().alias("std_value"))
    z = F.when(F.col("std_value") > 0, F.abs(F.col(value) - F.col("mean_value")) / F.col("std_value")).otherwise(0.0)
    return out.withColumn("z_score", z).where(F.col("z_score") > warning).withColumn("severity", severity(F.col("z_score"), warning))


def row_outliers(df: DataFrame, value: str, k: float) -> DataFrame:
    """Rows whose value lies more than k sample stddevs above the mean."""
    s = df.agg(F.avg(value).alias("m"), F.stddev(value).alias("s"))
    z = (F.col(value) - s.select("m").scalar()) / s.select("s").scalar()
    return df.withColumn("z_score", z).where(F.col("z_score") > k).withColumn("severity", severity(F.col("z_score"), k))


def failure_listing(ops: DataFrame, state: str, message: str, at: str, bad: Sequence[str], worst: Sequence[str]) -> DataFrame:
    """Operations in a bad state with a message, graded by state, newest first."""
    return (ops.where(F.col(state).isin(list(bad)) & F.col(message).isNotNull() & (F.col(message) != ""))
            .withColumn("severity", F.when(F.col(state).isin(list(worst)), "critical").otherwise("warning"))
            .orderBy(F.col(at).desc()))


def volume_overview(current: DataFrame, history: DataFrame) -> DataFrame:
    """Current rows per table against the last recorded ones.

    current: (table_fqn, current_rows); history: (table_fqn, measured_at, value)."""
    prev = top_rows(history, ["table_fqn"], [F.desc("measured_at")]).select("table_fqn", F.col("value").cast("long").alias("previous_rows"))
    pct = F.when(F.col("previous_rows") > 0, F.round((F.col("current_rows") - F.col("previous_rows")) / F.col("previous_rows") * 100, 2))
    return current.join(prev, "table_fqn", "left").withColumn("change_pct", pct)


def volume_trend(history: DataFrame) -> DataFrame:
    """Tables and total rows per day from recorded row counts."""
    return history.groupBy(F.col("measured_at").alias("day")).agg(
        F.count_distinct("table_fqn").alias("n_tables"), F.sum("value").alias("total_rows"))


def with_baseline(metrics: DataFrame, baselines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach recomputed baselines to the measurements they belong to."""
    return spread_join(metrics, baselines, keys, "left")
