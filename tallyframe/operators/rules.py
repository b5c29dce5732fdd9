"""Quality rules: a set of rules over one table is evaluated in a single aggregate."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.common import as_ts, hours_between, union_all
from tallyframe.operators.relational import duplicate_groups, not_in_failures, orphans

ROW_RULES = ("not_null", "range", "regex")


@dataclass(frozen=True)
class Rule:
    rule_id: str
    rule_type: str
    column: str = ""
    params: Mapping = field(default_factory=dict)
    threshold: float = 0.0
    severity: str = "warning"
    name: str = ""


def row_failure(rule: Rule) -> Column:
    """Whether a row breaks a row rule; NULL values pass all but not_null."""
    c, p = F.col(f"`{rule.column}`"), rule.params
    if rule.rule_type == "not_null":
        return c.isNull()
    if rule.rule_type == "regex":
        return ~c.rlike(p.get("pattern", ".*"))
    if rule.rule_type == "range":
        lo, hi = p.get("min"), p.get("max")
        bad = F.lit(False)
        if lo is not None:
            bad = bad | (c < lo)
        if hi is not None:
            bad = bad | (c > hi)
        return bad
    raise ValueError(f"not a row rule: {rule.rule_type}")


def _outcome(df: DataFrame, rules: Sequence[Rule], table: str) -> DataFrame:
    """Add the rule's own columns, the failure rate and the verdict to (rule_id, total, failures)."""
    meta = F.create_map(*[x for r in rules for x in (
        F.lit(r.rule_id), F.struct(F.lit(r.name or r.rule_id).alias("rule_name"), F.lit(r.column).alias("column_name"),
                                   F.lit(r.rule_type).alias("rule_type"), F.lit(r.severity).alias("severity"),
                                   F.lit(float(r.threshold)).alias("threshold")))])
    rate = F.col("failures") / F.greatest(F.col("total"), F.lit(1))
    return (
        df.withColumn("m", F.element_at(meta, F.col("rule_id")))
        .select("rule_id", "m.rule_name", F.lit(table).alias("table_fqn"), "m.column_name", "m.rule_type", "m.severity",
                F.col("total").cast("long").alias("total_rows"), F.col("failures").cast("long").alias("failed_rows"),
                F.round(rate, 6).alias("failure_rate"), "m.threshold", (rate <= F.col("m.threshold")).alias("passed")))


def within(value: Column, low, high=None) -> Column:
    """low <= value <= high; without a high there is no upper bound."""
    return (value >= low) & (value <= high) if high is not None else value >= low


def _one(df: DataFrame, rule: Rule) -> DataFrame:
    return df.select(F.lit(rule.rule_id).alias("rule_id"), F.col("total").cast("long").alias("total"), F.col("failures").cast("long").alias("failures"))


def _count_rule(failures: Column, fixed_total: int | None = None) -> tuple[Column, Column]:
    return (F.lit(fixed_total).cast("long") if fixed_total is not None else F.count(F.lit(1))), failures.cast("long")


def run_rules(df: DataFrame, rules: Sequence[Rule], table: str = "", parents: Mapping[str, DataFrame] | None = None,
              as_of=None) -> DataFrame:
    """Results of a rule set. Row, freshness and row-count rules share one scan; uniqueness,
    referential and custom rules add one plan each."""
    fused: list[tuple[Rule, Column, Column]] = []
    parts = []
    for r in rules:
        if r.rule_type in ROW_RULES:
            fused.append((r, *_count_rule(F.count_if(row_failure(r)))))
        elif r.rule_type == "row_count":
            fused.append((r, *_count_rule(F.when(within(F.count(F.lit(1)), r.params.get("min", 0), r.params.get("max")), 0).otherwise(1))))
        elif r.rule_type == "freshness":
            age = hours_between(F.max(F.col(r.column)), as_ts(as_of))
            fused.append((r, *_count_rule(F.when(age > r.params.get("max_hours", 24), 1).otherwise(0), 1)))
        elif r.rule_type == "unique":
            g = df.groupBy(F.col(f"`{r.column}`").alias("k")).agg(F.count(F.lit(1)).alias("n"))
            parts.append(_one(g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
                                    (F.coalesce(F.sum("n"), F.lit(0)) - F.count("k")).alias("failures")), r))
        elif r.rule_type == "referential":
            parent = (parents or {})[r.params["parent"]]
            parts.append(_one(not_in_failures(df, r.column, parent, r.params.get("parent_column", r.column),
                                              null_safe=r.params.get("null_safe", False)), r))
        elif r.rule_type == "custom_sql":
            parts.append(_one(custom_total_check(df.sparkSession, r.params["sql"], t=df, **(parents or {})), r))
        else:
            raise ValueError(f"unknown rule type {r.rule_type!r}")
    if fused:
        row = df.agg(*[c.alias(f"{k}{i}") for i, (_, tot, bad) in enumerate(fused) for k, c in (("t", tot), ("f", bad))])
        parts.insert(0, row.select(F.explode(F.array(*[
            F.struct(F.lit(r.rule_id).alias("rule_id"), F.col(f"t{i}").alias("total"), F.col(f"f{i}").alias("failures"))
            for i, (r, _, _) in enumerate(fused)])).alias("x")).select("x.*"))
    return _outcome(union_all(parts), rules, table)


def duplicate_group_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Uniqueness as the number of repeated values and of the rows they have in excess."""
    return duplicate_groups(df, columns).agg(F.count(F.lit(1)).alias("duplicate_groups"),
                                             F.coalesce(F.sum("extra_rows"), F.lit(0)).alias("extra_rows"))


def orphan_violations(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Referential check counting distinct orphan values and the rows that hold them."""
    return orphans(child, fk, parent.where(F.col(pk).isNotNull()), pk).agg(
        F.count(F.lit(1)).alias("orphan_values"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("orphan_rows"))


def custom_total_check(spark: SparkSession, sql: str, **frames: DataFrame) -> DataFrame:
    """SQL that returns the columns total and failures; frames are named as {name} in the text."""
    return spark.sql(sql, **frames).select("total", "failures")


def custom_row_check(spark: SparkSession, sql: str, **frames: DataFrame) -> DataFrame:
    """SQL of which every returned row is a violation."""
    n = spark.sql(sql, **frames).agg(F.count(F.lit(1)).alias("violations"))
    return n.withColumn("passed", F.col("violations") == 0)


def run_table_hooks(tables: Mapping[str, tuple[DataFrame, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """User functions DataFrame -> one row (valid, message), run per table."""
    return union_all([hook(df).select(F.lit(n).alias("table_name"), "valid", "message") for n, (df, hook) in tables.items()])


def daily_history(results: DataFrame, at: str = "executed_at") -> DataFrame:
    """Passed and failed runs per day and rule."""
    return results.groupBy(F.to_date(at).cast("string").alias("day"), "rule_id").agg(
        F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"),
        F.round(F.avg("failure_rate"), 6).alias("avg_failure_rate"))
