"""Sets of checks over a table: error and warning lists per row, splits, summaries, dataset checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.common import exact_percentiles, spread_join, union_all
from tallyframe.functions.checks import ROW_CHECKS

MARKING = ("is_unique", "foreign_key", "has_no_outliers")
AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
AGGREGATE_TESTS = {
    "is_aggr_not_greater_than": lambda v, lim: v > lim,
    "is_aggr_not_less_than": lambda v, lim: v < lim,
    "is_aggr_equal": lambda v, lim: v != lim,
    "is_aggr_not_equal": lambda v, lim: v == lim,
}


@dataclass(frozen=True)
class Check:
    name: str
    function: str
    arguments: Mapping = field(default_factory=dict)
    criticality: str = "error"
    filter: str | None = None


# ---- dataset checks that mark rows ----

def mark_unique(df: DataFrame, columns: Sequence[str], flag: str) -> DataFrame:
    """Flag rows whose values occur more than once; rows with a NULL part never count."""
    n = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(*columns, F.lit(True).alias("__dup"))
    return spread_join(df, n, columns, "left").withColumn(flag, F.col("__dup").isNotNull()).drop("__dup")


def mark_foreign_key(df: DataFrame, column: str, ref: DataFrame, ref_column: str, flag: str) -> DataFrame:
    """Flag rows whose value has no match in the reference; NULL passes."""
    parents = ref.select(F.col(ref_column).alias(column)).distinct().withColumn("__hit", F.lit(True))
    j = spread_join(df, parents, [column], "left")
    return j.withColumn(flag, F.col(column).isNotNull() & F.col("__hit").isNull()).drop("__hit")


def mark_outliers(df: DataFrame, column: str, flag: str, threshold: float = 3.0) -> DataFrame:
    """Flag values further from the median than threshold times the median absolute deviation."""
    v = F.col(column)
    med = exact_percentiles(df, column, [0.5]).first()  # one number, as is the deviation
    mad = exact_percentiles(df.select(F.abs(v - med["value"]).alias("dev")), "dev", [0.5]).first() if med else None
    if mad is None:
        return df.withColumn(flag, F.lit(False))
    return df.withColumn(flag, F.coalesce(F.abs(v - med["value"]) > mad["value"] * threshold, F.lit(False)))


# ---- dataset checks with a result of their own ----

def aggregate_check(df: DataFrame, test: str, limit, aggr_type: str = "count", column: str | None = None,
                    group_by: Sequence[str] = ()) -> DataFrame:
    """Aggregate per group (or in all) with whether it breaks the limit."""
    v = AGGREGATES[aggr_type](F.col(column) if column else F.lit(1))
    g = df.groupBy(*group_by).agg(v.alias("value")) if group_by else df.agg(v.alias("value"))
    return g.withColumn("failed", AGGREGATE_TESTS[test](F.col("value"), F.lit(limit)))


def window_counts(df: DataFrame, column: str, window_minutes: int, min_count: int) -> DataFrame:
    """Rows per time window between the first and the last one, empty windows included, with
    whether a window has too few."""
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")

    slot = F.floor(F.timestamp_diff("MINUTE", epoch, F.date_trunc("minute", F.col(column)).cast("timestamp_ntz")) / window_minutes)
    n = df.where(F.col(column).isNotNull()).groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n_rows"))
    spine = n.agg(F.min("slot").alias("a"), F.max("slot").alias("b")).select(F.explode(F.sequence("a", "b")).alias("slot"))
    start = F.timestamp_add("MINUTE", (F.col("slot") * window_minutes).cast("int"), epoch)
    return (spine.join(n, "slot", "left").select(start.alias("window_start"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
            .withColumn("failed", F.col("n_rows") < min_count))


def schema_problems(df: DataFrame, expected: T.StructType, strict: bool = False) -> DataFrame:
    """Columns that are missing, of another type or, in strict mode, unexpected."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    want = {f.name: f.dataType.simpleString() for f in expected.fields}
    rows = [(n, "missing", w, None) for n, w in want.items() if n not in have]
    rows += [(n, "type", w, have[n]) for n, w in want.items() if n in have and have[n] != w]
    if strict:
        rows += [(n, "unexpected", None, h) for n, h in have.items() if n not in want]
    return df.sparkSession.createDataFrame(rows, "column_name string, problem string, expected string, found string")


def query_condition(df: DataFrame, sql: str, condition: str) -> DataFrame:
    """Failing rows of an SQL text over {df} that returns a boolean condition column."""
    return df.sparkSession.sql(sql, df=df).where(F.col(condition))


# ---- the check set ----

def _failure(check: Check) -> Column:
    f = F.col(f"__flag_{check.name}") if check.function in MARKING else ROW_CHECKS[check.function](**check.arguments)
    return F.expr(check.filter) & f if check.filter else f


def apply_checks(df: DataFrame, checks: Sequence[Check], refs: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Add ``_errors`` and ``_warnings``: the names of the checks a row fails, by criticality.

    All row checks are columns of one projection; checks that need other rows add a flag by a join.
    """
    for ch in checks:
        if ch.function not in ROW_CHECKS and ch.function not in MARKING:
            raise ValueError(f"unknown row check {ch.function!r}")
    out = df
    for ch in checks:
        a, flag = ch.arguments, f"__flag_{ch.name}"
        if ch.function == "is_unique":
            out = mark_unique(out, a["columns"], flag)
        elif ch.function == "foreign_key":
            out = mark_foreign_key(out, a["column"], (refs or {})[a["ref"]], a["ref_column"], flag)
        elif ch.function == "has_no_outliers":
            out = mark_outliers(out, a["column"], flag, a.get("threshold", 3.0))

    def failed(level):
        named = [F.when(_failure(c), F.lit(c.name)) for c in checks if (c.criticality == "error") == (level == "error")]
        arr = F.array(*named) if named else F.array().cast("array<string>")
        return F.filter(arr, lambda x: x.isNotNull())

    return out.select(*[F.col(f"`{c}`") for c in df.columns], failed("error").alias("_errors"), failed("warn").alias("_warnings"))


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows (without errors; warnings may remain) and invalid rows."""
    ok = F.size("_errors") == 0
    return checked.where(ok).drop("_errors", "_warnings"), checked.where(~ok)


def summary(checked: DataFrame, table: str, n_checks: int) -> DataFrame:
    """Rows by outcome and pass rate of one run."""
    err, warn = F.size("_errors") > 0, F.size("_warnings") > 0
    s = checked.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(~err).alias("valid_rows"),
                    F.count_if(err).alias("invalid_rows"), F.count_if(err).alias("error_rows"), F.count_if(warn).alias("warning_rows"))
    rate = F.round(F.col("valid_rows") / F.greatest("total_rows", F.lit(1)) * 100, 2)
    return s.select(F.lit(table).alias("table_fqn"), "*", rate.alias("pass_rate"), F.lit(n_checks).alias("checks_applied"))


def failure_counts(checked: DataFrame) -> DataFrame:
    """Failed rows per check."""
    return (checked.select(F.explode(F.concat("_errors", "_warnings")).alias("check_name"))
            .groupBy("check_name").agg(F.count(F.lit(1)).alias("failed_rows")))


def run_tables(tables: Mapping[str, tuple[DataFrame, Sequence[Check]]], refs: Mapping[str, DataFrame] | None = None,
               pass_at: float = 95.0) -> DataFrame:
    """One summary per table; a table passes from the given pass rate on."""
    parts = [summary(apply_checks(df, checks, refs), name, len(checks)) for name, (df, checks) in tables.items()]
    return union_all(parts).withColumn("passed", F.col("pass_rate") >= pass_at)


def flag_counts(df: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    """Failed rows of many conditions in one scan."""
    row = df.agg(F.count(F.lit(1)).alias("t"), *[F.count_if(c).alias(f"f{i}") for i, c in enumerate(flags.values())])
    items = [F.struct(F.lit(n).alias("check_name"), F.col(f"f{i}").alias("failed_rows"), F.col("t").alias("total_rows"))
             for i, n in enumerate(flags)]
    return row.select(F.explode(F.array(*items)).alias("x")).select("x.*")


def dashboard(runs: DataFrame) -> DataFrame:
    """Latest run per table, worst first, with the pass rate over all latest runs."""
    from tallyframe.operators.relational import latest_rows

    last = latest_rows(runs, ["table_fqn"], "executed_at")
    total = last.agg(F.round(F.sum("valid_rows") / F.greatest(F.sum("total_rows"), F.lit(1)) * 100, 2).alias("r")).scalar()
    rate = F.round(F.col("valid_rows") / F.greatest("total_rows", F.lit(1)) * 100, 2)
    return last.withColumns({"pass_rate": rate, "overall_pass_rate": total}).orderBy("pass_rate")


# ---- checks as data ----

def checks_from_yaml(text: str) -> list[Check]:
    """Checks from a YAML list of {name, criticality, filter, check: {function, arguments}}."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML checks needs PyYAML") from e
    out = []
    for i, item in enumerate(yaml.safe_load(text) or []):
        body = item["check"]
        out.append(Check(item.get("name") or f"{body['function']}_{i}", body["function"], body.get("arguments") or {},
                         item.get("criticality", "error"), item.get("filter")))
    return out


def checks_to_yaml(checks: Sequence[Check]) -> str:
    import yaml

    return yaml.safe_dump([
        {"name": c.name, "criticality": c.criticality, **({"filter": c.filter} if c.filter else {}),
         "check": {"function": c.function, "arguments": dict(c.arguments)}} for c in checks], sort_keys=False)


def checks_to_rows(spark, checks: Sequence[Check], table: str) -> DataFrame:
    import json

    rows = [(c.name, table, c.criticality, c.function, json.dumps(dict(c.arguments), sort_keys=True), c.filter, True) for c in checks]
    return spark.createDataFrame(rows, "name string, table_fqn string, criticality string, check_function string, "
                                       "arguments string, filter_expr string, enabled boolean")


def suite(outcomes: Sequence[DataFrame]) -> DataFrame:
    """Overall status of a mixed suite from frames of (check_type, check_id, passed); a NULL
    outcome is skipped."""
    u = union_all(list(outcomes))
    st = F.when(F.col("passed").isNull(), "skip").when(F.col("passed"), "pass").otherwise("fail")
    u = u.select("check_type", "check_id", st.alias("status"))
    n = {s: F.count_if(F.col("status") == s) for s in ("pass", "fail", "skip")}
    overall = u.agg(F.when(n["fail"] == 0, "pass").otherwise("fail").alias("o")).scalar()
    return u.withColumn("overall_status", overall)
