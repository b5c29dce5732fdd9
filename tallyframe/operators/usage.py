"""Access patterns, column usage and governance scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.common import union_all
from tallyframe.functions import pii as P
from tallyframe.operators.relational import occurrences, search_text


def access_patterns(log: DataFrame, table: str, at: str, user: str) -> DataFrame:
    """Queries, first and last access and distinct users per table."""
    return log.groupBy(F.col(table).alias("table_name")).agg(
        F.count(F.lit(1)).alias("query_count"), F.min(at).alias("first_accessed"), F.max(at).alias("last_accessed"),
        F.count_distinct(user).alias("distinct_users"))


def tables_in_queries(log: DataFrame, text: str, catalog: str) -> DataFrame:
    """One row per table of the catalog named in a statement."""
    names = F.regexp_extract_all(F.col(text), F.lit(rf"(?i)`?{catalog}`?\.(`?\w+`?\.`?\w+)`?"), 1)
    return log.withColumn("table_name", F.explode(names)).withColumn(
        "table_name", F.concat(F.lit(f"{catalog}."), F.replace("table_name", F.lit("`"), F.lit(""))))


def usage_classes(access: DataFrame) -> DataFrame:
    n = F.col("query_count")
    return access.withColumn("usage", F.when(n >= 100, "frequent").when(n >= 10, "occasional").otherwise("rare"))


def unused(tables: DataFrame, access: DataFrame) -> DataFrame:
    return tables.join(access.select("table_name").distinct(), "table_name", "left_anti")


def statement_parts(text: Column) -> Column:
    """The SELECT statements inside a text, each without what stands in brackets: what stands in brackets
    becomes a part of its own, from the inside out, and parts are cut at set operations. Names of
    common table expressions are no tables of a catalog, so their columns count for the tables inside."""
    inner = r"\(([^()]*)\)"
    opened = F.length(F.regexp_replace(text, r"[^(]", ""))
    start = F.struct(text.alias("rest"), F.array().cast("array<string>").alias("parts"))
    step = lambda acc, _: F.when(acc["rest"].rlike(inner), F.struct(
        F.regexp_replace(acc["rest"], inner, "[]").alias("rest"), F.concat(acc["parts"], F.regexp_extract_all(acc["rest"], F.lit(inner), F.lit(1))).alias("parts"))).otherwise(acc)
    whole = F.aggregate(F.sequence(F.lit(0), opened), start, step, lambda acc: F.concat(acc["parts"], F.array(acc["rest"])))
    cut = F.flatten(F.transform(whole, lambda p: F.split(p, r"(?i)\b(?:UNION|EXCEPT|INTERSECT)\b(?:\s+(?:ALL|DISTINCT)\b)?")))
    return F.filter(cut, lambda p: p.rlike(r"(?is)\bSELECT\s.*\sFROM\b"))


def column_usage(log: DataFrame, text: str, user: str, catalog: str) -> DataFrame:
    """Uses per table, selected column and user, read from the SELECT lists of all parts of statements
    (``statement_parts``). Calls count by their alias; the columns of a part go to every table of
    the catalog in it."""
    log = log.withColumn(text, F.explode(statement_parts(F.col(text))))
    t = tables_in_queries(log, text, catalog)
    clause = F.trim(F.regexp_extract(F.col(text), r"(?is)SELECT\s+(?:DISTINCT\s+)?(.*?)\s+FROM", 1))
    part = F.trim(F.col("part"))
    plain = F.regexp_extract(F.regexp_replace(part, r"(?i)\s+AS\s+.*$", ""), r"^(?:\w+\.)?(\w+|\*)", 1)
    call = F.regexp_extract(part, r"(?i)AS\s+`?(\w+)`?", 1)
    name = F.lower(F.when(part.contains("[]"), call).otherwise(plain))
    one = t.withColumn("clause", clause).where("clause <> ''").withColumn("part", F.explode(F.split("clause", ",")))
    return one.withColumn("column_name", name).where("column_name <> ''").groupBy("table_name", "column_name", F.col(user).alias("user_name")).agg(
        F.count(F.lit(1)).alias("usage_count"))


def column_usage_totals(per_user: DataFrame) -> DataFrame:
    return per_user.groupBy("table_name", "column_name").agg(F.sum("usage_count").alias("usage_count"), F.count(F.lit(1)).alias("user_count"))


def column_usage_users(per_user: DataFrame) -> DataFrame:
    """Uses and distinct columns (of a table) per user."""
    return per_user.groupBy("user_name").agg(F.sum("usage_count").alias("usage_count"), F.count(F.lit(1)).alias("column_count"))


def column_name_frequency(inventory: DataFrame) -> DataFrame:
    """Columns with the number of columns of the same name."""
    return occurrences(inventory, "column_name")


# ---- governance --------------------------------------------------------------------------------

# ---- Fixed values: parts of owner names ----
SERVICE_HINTS = ("@serviceprincipal", "spn-", "sp-", "application/")
GROUP_HINTS = ("-group", "-team", "-admins", "-owners", "-readers", "-writers", "-contributors", "group:", "team:")


def owner_type(owner: Column) -> Column:
    """service_principal, group, user or missing."""
    o = F.lower(F.trim(owner))

    def has(hints: Sequence[str]) -> Column:
        c = F.lit(False)
        for h in hints:
            c = c | o.contains(h)
        return c

    return (F.when(owner.isNull() | (owner == "") | (owner == "(none)"), "missing").when(has(SERVICE_HINTS), "service_principal")
            .when(has(GROUP_HINTS), "group").when(o.contains("@"), "user").otherwise("group"))


def ownership_score(objects: DataFrame, owner: str) -> DataFrame:
    k = owner_type(F.col(owner))
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    miss, user = F.count_if(k == "missing"), F.count_if(k == "user")
    score = F.greatest(F.lit(0), F.floor(100 - miss / n * 100 - user / n * 25)).cast("long")
    return objects.agg(F.count(F.lit(1)).alias("total"), miss.alias("missing"), user.alias("user_owned"), score.alias("score"))


def section_status(score: Column) -> Column:
    return F.when(score >= 80, "COMPLIANT").when(score >= 50, "WARNING").otherwise("NON_COMPLIANT")


def overall_status(sections: DataFrame) -> DataFrame:
    """Whole-number mean of the section scores with a status."""
    s = sections.agg(F.coalesce(F.floor(F.sum("score") / F.count("score")), F.lit(0)).cast("long").alias("score"), F.count("score").alias("n"))
    return s.select("score", F.when(F.col("n") == 0, "WARNING").otherwise(section_status(F.col("score"))).alias("status"))


def tag_coverage(tables: DataFrame, tags: DataFrame, on: Sequence[str]) -> DataFrame:
    """Tagged and untagged tables, coverage in whole percent."""
    t = tags.select(*on).distinct().withColumn("hit", F.lit(1))
    j = tables.select(*on).join(t, list(on), "left")
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    return j.agg(F.count(F.lit(1)).alias("total_tables"), F.count("hit").alias("tagged"), F.floor(F.count("hit") / n * 100).cast("long").alias("coverage_pct"))


def pii_audit(findings: DataFrame, masked: DataFrame) -> DataFrame:
    """Scores of a personal-data audit: findings, masking coverage, unmasked high-risk columns.

    findings: (column_name, pii_type); masked: (column_name)."""
    j = findings.join(masked.select("column_name").distinct().withColumn("m", F.lit(1)), "column_name", "left")
    n, open_, high = F.count(F.lit(1)), F.count_if(F.col("m").isNull()), F.col("pii_type").isin(list(P.HIGH_RISK))
    hr_open = F.count_if(high & F.col("m").isNull())
    return j.agg(
        n.alias("pii_columns"), open_.alias("unmasked"), hr_open.alias("high_risk_unmasked"), F.greatest(F.lit(0), 100 - n * 5).cast("long").alias("detection_score"),
        F.when(n == 0, 100).otherwise(F.greatest(F.lit(0), 100 - F.floor(open_ / F.greatest(n, F.lit(1)) * 100))).cast("long").alias("masking_score"),
        F.when(hr_open > 0, 0).otherwise(100).cast("long").alias("high_risk_score"))


def search_metadata(sources: Mapping[str, tuple[DataFrame, str, Sequence[str]]], text: str) -> DataFrame:
    """Hits of a text over several metadata frames, each given with its name column and the
    columns to search."""
    return union_all([search_text(df, cols, text).select(F.lit(kind).alias("kind"), F.col(name).cast("string").alias("name")) for kind, (df, name, cols) in sources.items()])


def grant_audit(grants: DataFrame, privilege: str) -> DataFrame:
    broad = F.count_if(F.upper(privilege).contains("ALL"))
    return grants.agg(F.count(F.lit(1)).alias("grants"), broad.alias("broad_grants"), F.greatest(F.lit(0), 100 - broad * 20).cast("long").alias("score"))


def size_policies(sizes: DataFrame, max_table_gb: float | None = None, max_total_gb: float | None = None, max_tables: int | None = None,
                  blocked: str | None = None) -> DataFrame:
    """Violations of size and naming policies (sizes: table_name, size_gb)."""
    parts = []
    if max_table_gb is not None:
        parts.append(sizes.where(F.col("size_gb") > max_table_gb).select(F.lit("max_table_size_gb").alias("policy"), F.col("table_name").alias("subject")))
    if max_total_gb is not None:
        parts.append(sizes.agg(F.sum("size_gb").alias("s")).where(F.col("s") > max_total_gb).select(F.lit("max_total_size_gb").alias("policy"), F.lit("all").alias("subject")))
    if max_tables is not None:
        parts.append(sizes.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_tables).select(F.lit("max_tables").alias("policy"), F.lit("all").alias("subject")))
    if blocked is not None:
        parts.append(sizes.where(F.col("table_name").rlike(blocked)).select(F.lit("blocked_tables_regex").alias("policy"), F.col("table_name").alias("subject")))
    return union_all(parts)
