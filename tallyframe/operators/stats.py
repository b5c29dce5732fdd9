"""Statistical comparison of the columns of two tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.common import exact_percentiles, top_rows, unpivot_stats
from tallyframe.operators.profile import value_counts

PROBS = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def numeric_stats(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """min, max, mean, sample stddev, null rate and percentiles, one row per column."""
    aggs, specs = [], {}
    for c in columns:
        v = F.col(f"`{c}`")
        d = v.cast("double")
        items = {"min_value": F.min(d), "max_value": F.max(d), "mean": F.avg(d), "stddev": F.stddev(d),
                 "null_rate": F.round(1 - F.count(v) / F.greatest(F.count(F.lit(1)), F.lit(1)), 4)}
        if not exact:
            for i, p in enumerate(PROBS):
                items[p] = F.element_at(F.percentile_approx(d, list(PROBS.values()), 10000), i + 1)
        aggs += [e.alias(f"{c}.{k}") for k, e in items.items()]
        specs[c] = {k: f"{c}.{k}" for k in items}
    base = unpivot_stats(df.agg(*aggs), specs)
    if not exact:
        return base
    longs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    pct = exact_percentiles(longs, "v", list(PROBS.values()), ["column_name"])
    wide = pct.groupBy("column_name").agg(*[
        F.max(F.when(F.abs(F.col("prob") - p) < 1e-9, F.col("value"))).alias(n) for n, p in PROBS.items()])
    return base.join(wide, "column_name", "left")


def compare_numeric(src: DataFrame, dst: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    a, b = numeric_stats(src, columns, exact), numeric_stats(dst, columns, exact)
    names = [c for c in a.columns if c != "column_name"]
    x = a.select("column_name", *[F.col(c).alias(f"source_{c}") for c in names])
    y = b.select("column_name", *[F.col(c).alias(f"dest_{c}") for c in names])
    deltas = [F.round(F.col(f"source_{c}") - F.col(f"dest_{c}"), 6).alias(f"delta_{c}")
              for c in ("min_value", "max_value", "mean", "stddev", "p50")]
    return x.join(y, "column_name").select("*", *deltas)


def top_values(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """Most frequent non-null values; equal counts are ordered by value."""
    return (df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value"))
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(n))


def compare_categorical(src: DataFrame, dst: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cardinality, null rate and five most frequent values (as text) per side, with deltas.

    The values of all columns are counted in one scan and one shuffle per side; an empty side has a cardinality
    and null rate of 0 and no values."""
    names = src.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")

    def side(df, tag):
        counts = value_counts(df, columns)
        s = counts.groupBy("column_name").agg(F.count("value").alias("cardinality"), F.sum("freq").alias("rows"),
                                              F.sum(F.when(F.col("value").isNull(), F.col("freq"))).alias("nulls"))
        best = top_rows(counts.where("value IS NOT NULL"), ["column_name"], [F.desc("freq"), F.col("value")], 5).groupBy("column_name").agg(
            F.array_sort(F.collect_list(F.struct((-F.col("freq")).alias("k"), "value", "freq"))).alias("t"))
        text = F.concat_ws(",", F.transform("t", lambda x: F.concat_ws("=", x["value"], x["freq"].cast("string"))))
        return names.join(s, "column_name", "left").join(best, "column_name", "left").select(
            "column_name", F.coalesce("cardinality", F.lit(0)).alias(f"{tag}_cardinality"),
            F.round(F.coalesce("nulls", F.lit(0)) / F.greatest("rows", F.lit(1)), 4).alias(f"{tag}_null_rate"), text.alias(f"{tag}_top_5"))

    j = side(src, "source").join(side(dst, "dest"), "column_name")
    return j.select("*", (F.col("source_cardinality") - F.col("dest_cardinality")).alias("delta_cardinality"),
                    F.round(F.col("source_null_rate") - F.col("dest_null_rate"), 4).alias("delta_null_rate"))
