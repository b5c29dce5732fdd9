"""Data contracts: schema, quality and service-level validation; contracts from tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.common import as_ts, hours_between, is_numeric, is_temporal, is_text, union_all
from tallyframe.operators.checkset import Check
from tallyframe.operators.rules import within
from tallyframe.operators.schema import COMPATIBLE

# ---- Fixed values: comparison operators, tried in this order ----
COMPARISONS = ("mustBe", "mustNotBe", "mustBeGreaterThan", "mustBeGreaterOrEqualTo", "mustBeLessThan", "mustBeLessOrEqualTo",
               "mustBeBetween", "mustNotBeBetween")


def compare(rule: Mapping, value: Column) -> Column:
    """Whether a value meets the first comparison given by a rule; a rule without any is met."""
    given = next((c for c in COMPARISONS if rule.get(c) is not None), None)
    if given is None:
        return F.lit(True)
    x = rule[given]
    return {
        "mustBe": lambda: value == x, "mustNotBe": lambda: value != x, "mustBeGreaterThan": lambda: value > x,
        "mustBeGreaterOrEqualTo": lambda: value >= x, "mustBeLessThan": lambda: value < x, "mustBeLessOrEqualTo": lambda: value <= x,
        "mustBeBetween": lambda: value.between(x[0], x[1]), "mustNotBeBetween": lambda: ~value.between(x[0], x[1]),
    }[given]()


def _base(t: str) -> str:
    return t.lower().split("(")[0].strip()


def validate_schema(df: DataFrame, properties: Sequence[Mapping]) -> DataFrame:
    """Violations of declared columns: missing, wrong type, NULLs in required ones, repeats in
    unique ones. Properties: name, type, required, unique. One scan counts all NULLs; each unique
    column adds one aggregate."""
    have = {f.name.lower(): f for f in df.schema.fields}
    declared = [(p, have.get(p["name"].lower())) for p in properties]
    fixed = []
    for p, f in declared:
        want = p.get("type")
        if f is None:
            fixed.append((p["name"], "missing_column"))
        elif want:
            d, a = _base(want), _base(f.dataType.simpleString().replace("timestamp_ntz", "timestamp"))
            if d != a and a not in COMPATIBLE.get(d, ()):
                fixed.append((p["name"], "type_mismatch"))
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"`{f.name}`").isNull()).alias(f"null_{f.name}") for p, f in declared if f is not None and p.get("required")])
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("violation"), F.lit(None).cast("long").alias("n_rows")) for c, k in fixed]
    rows += [F.struct(F.lit(f.name).alias("column_name"), F.lit("required_violation").alias("violation"), F.col(f"null_{f.name}").alias("n_rows"))
             for p, f in declared if f is not None and p.get("required")]
    parts = []
    if rows:
        parts.append(one.select(F.explode(F.array(*rows)).alias("r")).select("r.*"))
    for p, f in declared:
        if f is not None and p.get("unique"):
            g = df.groupBy(F.col(f"`{f.name}`").alias("k")).agg(F.count(F.lit(1)).alias("n"))
            parts.append(g.agg((F.sum("n") - F.count("k")).alias("n_rows")).select(
                F.lit(f.name).alias("column_name"), F.lit("uniqueness_violation").alias("violation"), "n_rows"))
    return union_all(parts).where("n_rows IS NULL OR n_rows > 0")


def validate_quality(df: DataFrame, rules: Sequence[Mapping]) -> DataFrame:
    """Value and verdict of quality rules: nullValues and duplicateValues (none allowed), rowCount
    and SQL texts over {object} and {property} with a comparison. Rules of type text are skipped."""
    parts = []
    for i, r in enumerate(rules):
        kind, col = r.get("type", "library"), r.get("column")
        if kind == "text":
            continue
        if kind == "sql":
            sql = r["query"].replace("{property}", col or "")
            one = df.sparkSession.sql(sql, object=df).toDF("value").select(F.col("value").cast("double").alias("value"))
            ok = compare(r, F.col("value"))
        elif r["metric"] == "nullValues":
            one, ok = df.agg(F.count_if(F.col(f"`{col}`").isNull()).cast("double").alias("value")), F.col("value") == 0
        elif r["metric"] == "duplicateValues":
            g = df.groupBy(F.col(f"`{col}`").alias("k")).agg(F.count(F.lit(1)).alias("n"))
            one, ok = g.agg((F.sum("n") - F.count("k")).cast("double").alias("value")), F.col("value") == 0
        elif r["metric"] == "rowCount":
            # the bounds of all given comparisons are inclusive here, unlike in compare()
            lo = r.get("mustBeGreaterThan", r.get("mustBeGreaterOrEqualTo", 0))
            hi = r.get("mustBeLessThan", r.get("mustBeLessOrEqualTo"))
            lo, hi = r.get("mustBeBetween", (lo, hi))
            one, ok = df.agg(F.count(F.lit(1)).cast("double").alias("value")), within(F.col("value"), lo, hi)
        else:
            continue
        parts.append(one.select(F.lit(r.get("name", f"rule_{i}")).alias("rule"), "value", ok.alias("passed")))
    return union_all(parts)


def sla_hours(value: float, unit: str) -> float:
    return float(value) if unit.lower() in ("h", "hour", "hours") else float(value) * 24


def validate_sla(df: DataFrame, at: str, properties: Sequence[Mapping], as_of) -> DataFrame:
    """Age of the data in hours against latency or frequency limits; availability needs a row."""
    age = df.agg(hours_between(F.max(F.col(at)), as_ts(as_of)).alias("age"), F.count(F.lit(1)).alias("n"))
    rows = []
    for p in properties:
        if p["property"] in ("latency", "frequency", "ly", "fy"):
            limit = sla_hours(p["value"], p.get("unit", "d"))
            rows.append(F.struct(F.lit(p["property"]).alias("property"), F.col("age").cast("double").alias("value"), F.lit(limit).alias("threshold"), (F.col("age") <= limit).alias("passed")))
        elif p["property"] in ("availability", "av"):
            rows.append(F.struct(F.lit(p["property"]).alias("property"), F.col("n").cast("double").alias("value"), F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("passed")))
    return age.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def checks_from_contract(rules: Sequence[Mapping]) -> list[Check]:
    """Row checks for contract rules (nullValues, missingValues, duplicateValues, invalidValues, sql)."""
    out = []
    for i, r in enumerate(rules):
        level = "error" if r.get("severity") in ("critical", "error") else "warn"
        col, args = r.get("column"), r.get("arguments") or {}
        metric = r.get("metric")
        if r.get("type") == "sql":
            out.append(Check(r.get("name", f"sql_{i}"), "sql_expression", {"expression": r["query"]}, level))
        elif metric == "nullValues":
            out.append(Check(r.get("name", f"null_{i}"), "is_not_null", {"column": col}, level))
        elif metric == "missingValues":
            out.append(Check(r.get("name", f"missing_{i}"), "is_not_null_and_not_empty", {"column": col}, level))
        elif metric == "duplicateValues":
            out.append(Check(r.get("name", f"dup_{i}"), "is_unique", {"columns": [col]}, level))
        elif metric == "invalidValues" and "validValues" in args:
            out.append(Check(r.get("name", f"valid_{i}"), "is_in_list", {"column": col, "allowed": args["validValues"]}, level))
        elif metric == "invalidValues" and "pattern" in args:
            out.append(Check(r.get("name", f"pattern_{i}"), "regex_match", {"column": col, "pattern": args["pattern"]}, level))
    return out


def logical_type(dt) -> str:
    if is_numeric(dt):
        return "integer" if dt.simpleString() in ("int", "bigint", "smallint", "tinyint") else "number"
    if is_text(dt):
        return "string"
    if is_temporal(dt):
        return "date"
    return {"boolean": "boolean", "array": "array"}.get(dt.typeName(), "object")


def generate_contract(df: DataFrame) -> DataFrame:
    """Declared properties that hold for a table: types, required (no NULL) and unique columns."""
    from tallyframe.operators.profile import profile

    p = profile(df)
    types = F.create_map(*[x for f in df.schema.fields for x in (F.lit(f.name), F.struct(
        F.lit(logical_type(f.dataType)).alias("logical_type"), F.lit(f.dataType.simpleString()).alias("physical_type")))])
    return p.withColumn("t", F.element_at(types, F.col("column_name"))).select(
        "column_name", "t.logical_type", "t.physical_type", (F.col("null_count") == 0).alias("required"),
        ((F.col("distinct_count") == F.col("total_rows")) & (F.col("total_rows") > 0)).alias("is_unique"))


def update_frequency(history: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Update frequency per table from its last gaps: 1 h below 2 h, hours below 48 h, else days."""
    from tallyframe.operators.relational import mean_recent_gap

    g = F.col("mean_gap_hours")
    out = mean_recent_gap(history, keys, at)
    return out.withColumns({"value": F.when(g < 2, 1).when(g < 48, F.bround(g)).otherwise(F.bround(g / 24)).cast("int"),
                            "unit": F.when(g < 48, "h").otherwise("d")})


def simple_check(df: DataFrame, expected: Sequence[str], at: str, max_hours: float, min_rows: int, as_of) -> DataFrame:
    """Expected columns, freshness and minimum rows in one row of verdicts."""
    missing = [c for c in expected if c not in df.columns]
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), hours_between(F.max(F.col(at)), as_ts(as_of)).alias("age_hours"))
    fresh, enough = F.col("age_hours") <= max_hours, F.col("n_rows") >= min_rows
    return one.select("n_rows", "age_hours", F.lit(",".join(missing)).alias("missing_columns"), fresh.alias("fresh"), enough.alias("enough_rows"),
                      (F.lit(not missing) & fresh & enough).alias("passed"))
