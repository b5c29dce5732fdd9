"""Detection of personal data in column names, column values, tags and free text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.common import is_text, union_all
from tallyframe.functions import pii as P
from tallyframe.functions.pii import DEFAULT, PiiConfig

WHERE = ("table_schema", "table_name", "column_name")


def _finding(df: DataFrame, method: str, score, config: PiiConfig) -> DataFrame:
    return df.select(*WHERE, "pii_type", F.lit(method).alias("detection_method"), score.alias("confidence_score"),
                     P.suggested_mask(F.col("pii_type"), config).alias("suggested_masking"))


def detect_by_name(inventory: DataFrame, config: PiiConfig = DEFAULT) -> DataFrame:
    """Findings from column names (inventory: table_schema, table_name, column_name)."""
    hit = inventory.withColumn("pii_type", P.type_of_name(F.col("column_name"), config)).where("pii_type IS NOT NULL")
    return _finding(hit, "column_name", F.lit(P.NAME_SCORE), config)


def value_match_rates(df: DataFrame, columns: Sequence[str] | None = None, config: PiiConfig = DEFAULT) -> DataFrame:
    """Share of non-null values that have the form of each type, for all text columns in one scan."""
    cols = [f.name for f in df.schema.fields if is_text(f.dataType) and (columns is None or f.name in columns)]
    types = list(config.values())
    values = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("v")) for c in cols])).alias("x")).select("x.*")
    counts = values.groupBy("column_name").agg(
        F.count("v").alias("n_values"), *[F.count_if(P.value_matches(F.col("v"), t, config)).alias(f"m{j}") for j, t in enumerate(types)])
    per_type = F.array(*[F.struct(F.lit(t).alias("pii_type"), F.col(f"m{j}").alias("n_matches")) for j, t in enumerate(types)])
    out = counts.select("column_name", "n_values", F.explode(per_type).alias("r")).select("column_name", "r.pii_type", "n_values", "r.n_matches")
    return out.withColumn("match_rate", F.col("n_matches") / F.greatest("n_values", F.lit(1)))


def detect_by_value(df: DataFrame, schema: str, table: str, columns: Sequence[str] | None = None,
                    config: PiiConfig = DEFAULT, sample_fraction: float | None = None, seed: int = 42) -> DataFrame:
    """Findings from column values: types whose share of values exceeds the limit. Reads the whole
    table unless a sample is asked for."""
    src = df.sample(fraction=sample_fraction, seed=seed) if sample_fraction else df
    hit = value_match_rates(src, columns, config).where(F.col("match_rate") > config.min_match_rate)
    score = F.lit(None).cast("double")
    for t in config.values():
        score = F.when(F.col("pii_type") == t, P.value_score(F.col("match_rate"), t)).otherwise(score)
    hit = hit.withColumns({"table_schema": F.lit(schema), "table_name": F.lit(table), "score": score})
    return _finding(hit, "data_sampling", F.col("score"), config)


def detect_by_tag(tags: DataFrame, config: PiiConfig = DEFAULT) -> DataFrame:
    """Findings from column tags (plus tag_name, tag_value): the value names the type, or a
    general tag name gives the general type."""
    name, value = F.lower("tag_name"), F.lower(F.trim("tag_value"))
    general = F.when(name.isin("pii", "sensitive"), "PII_GENERIC")
    hit = (tags.where(name.isin(list(P.TAG_NAMES))).withColumn("pii_type", F.coalesce(P.lookup(P.TAG_TYPES, value), general))
           .where("pii_type IS NOT NULL"))
    return _finding(hit, "uc_tag", F.lit(P.TAG_SCORE), config)


def best_findings(*parts: DataFrame) -> DataFrame:
    """All findings with one row per column and type, that of the highest score."""
    u = union_all(list(parts))
    order = F.struct("confidence_score", F.when(F.col("detection_method") == "column_name", 2)
                     .when(F.col("detection_method") == "uc_tag", 1).otherwise(0).alias("rank"))
    return u.groupBy(*WHERE, "pii_type").agg(
        F.max_by(F.struct("detection_method", "confidence_score", "suggested_masking"), order).alias("b")).select(
        *WHERE, "pii_type", "b.*")


def correlate(findings: DataFrame) -> DataFrame:
    """Raise the score of types that occur together in one table and flag them."""
    types = findings.groupBy("table_schema", "table_name").agg(F.collect_set("pii_type").alias("types"))
    j = findings.join(types, ["table_schema", "table_name"])
    score, flags = F.col("confidence_score"), []
    for flag, need, boost in P.CORRELATIONS:
        hit = (F.size(F.array_except(F.array(*[F.lit(x) for x in need]), "types")) == 0) & F.col("pii_type").isin(list(need))
        score = F.when(hit, F.least(score + boost, F.lit(1.0))).otherwise(score)
        flags.append(F.when(hit, F.lit(flag)))
    out = j.withColumns({"confidence_score": F.round(score, 4), "correlation_flags": F.concat_ws(",", *flags)}).drop("types")
    return out.withColumn("confidence", P.confidence_label(F.col("confidence_score")))


def risk(findings: DataFrame) -> DataFrame:
    """Number of findings and risk level of all findings."""
    n, high = F.count(F.lit(1)), F.count_if(F.col("pii_type").isin(list(P.HIGH_RISK)))
    level = F.when((high > 0) | (n >= 10), "HIGH").when(n >= 3, "MEDIUM").when(n > 0, "LOW").otherwise("NONE")
    return findings.agg(n.alias("n_findings"), high.alias("n_high_risk"), level.alias("risk_level"))


def text_span_counts(df: DataFrame, key: Sequence[str], text: str, types: Sequence[str] | None = None) -> DataFrame:
    """Spans of each type inside a free-text column, for the rows that have any."""
    names = list(types or P.TEXT_PATTERNS)
    items = [F.struct(F.lit(n).alias("pii_type"), P.text_spans(F.col(text), n).cast("long").alias("n_spans")) for n in names]
    return df.select(*key, F.explode(F.array(*items)).alias("x")).select(*key, "x.*").where("n_spans > 0")


def scan_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Findings that are new, removed, or whose type or confidence changed between two scans."""
    from tallyframe.operators.relational import key_set_changes

    return key_set_changes(before, after, list(WHERE), ["pii_type", "confidence"])


def masks_from_findings(findings: DataFrame) -> list[dict]:
    """Mask rules for the columns found: highest score first, then high-risk types. There are as
    many rows as columns, so the result is small."""
    w = Window.partitionBy("column_name").orderBy(F.desc("confidence_score"), F.col("pii_type").isin(list(P.HIGH_RISK)).desc(), "pii_type")
    best = findings.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("column_name", "suggested_masking")
    return [{"column": r["column_name"], "strategy": r["suggested_masking"]} for r in best.collect()]
