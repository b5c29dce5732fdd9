"""Order-free table checksums and multi-table validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.common import union_all


def _row_text(columns: Sequence[Column]) -> Column:
    parts: list[Column] = []
    for i, c in enumerate(columns):
        if i:
            parts.append(F.lit("|"))
        parts.append(F.coalesce(c.cast("string"), F.lit("NULL")))
    return F.concat(*parts)


def md5_sum(columns: Sequence[Column]) -> Column:
    """md5 of the sum of the leading 32 hash bits of every row."""
    word = F.conv(F.substring(F.md5(_row_text(columns)), 1, 8), 16, 10).cast("decimal(20,0)")
    return F.md5(F.sum(word).cast("decimal(38,0)").cast("string"))


def md5_word(columns: Sequence[Column]) -> Column:
    """The leading 60 bits of a row's md5 as a whole number."""
    return F.conv(F.substring(F.md5(_row_text(columns)), 1, 15), 16, 10).cast("long")


def xor_checksum(columns: Sequence[Column], row_hash: Column | None = None) -> list[Column]:
    """XOR of row hashes, xxhash64 of the row as text unless ``row_hash`` is given. Copies cancel in pairs,
    so the row count and a wide sum go with it."""
    h = F.xxhash64(F.struct(*columns).cast("string")) if row_hash is None else row_hash
    return [F.bit_xor(h).alias("xor_hash"), F.sum(h.cast("decimal(20,0)")).alias("sum_hash"),
            F.count(F.lit(1)).alias("row_count")]


def table_checksum(df: DataFrame, columns: Sequence[Column]) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"), md5_sum(columns).alias("checksum"))


def validate_pairs(pairs: Mapping[str, tuple[DataFrame, DataFrame]],
                   columns: Mapping[str, Sequence[Column]] | None = None) -> DataFrame:
    """Per table pair: both row counts, whether they match and, if columns are given, whether checksums do."""
    parts = []
    for name, (s, d) in pairs.items():
        for side, df in (("s", s), ("d", d)):
            cols = (columns or {}).get(name)
            parts.append(df.agg(F.count(F.lit(1)).alias("n"), (md5_sum(cols) if cols else F.lit(None).cast("string")).alias("ck"))
                         .select(F.lit(name).alias("table_name"), F.lit(side).alias("side"), "n", "ck"))
    both = union_all(parts).groupBy("table_name").agg(
        *[F.max(F.when(F.col("side") == x, F.col(c))).alias(f"{c}_{x}") for x in "sd" for c in ("n", "ck")])
    return both.select("table_name", F.col("n_s").alias("source_count"), F.col("n_d").alias("dest_count"),
                       (F.col("n_s") == F.col("n_d")).alias("match"), (F.col("ck_s") == F.col("ck_d")).alias("checksum_match"))


def evaluate_threshold(validation: DataFrame, threshold_pct: float) -> DataFrame:
    """Share of failed tables in percent and whether it stays within the threshold."""
    bad = F.count_if(~F.col("match"))
    err = F.count_if(F.col("match").isNull())
    pct = F.when(F.count(F.lit(1)) > 0, (bad + err) / F.count(F.lit(1)) * 100).otherwise(0.0)
    return validation.agg(
        F.count(F.lit(1)).alias("total_tables"), (bad + err).alias("mismatched_count"),
        F.round(pct, 2).alias("mismatch_pct"), (pct <= threshold_pct).alias("passed"))


def properties_diff(a: DataFrame, b: DataFrame, skip_prefix: str = "delta.") -> DataFrame:
    """Key/value properties that differ between two tables (columns table_name, key, value)."""
    on = ["table_name", "key"]
    x = a.where(~F.col("key").startswith(skip_prefix)).select(*on, F.col("value").alias("source_value"))
    y = b.where(~F.col("key").startswith(skip_prefix)).select(*on, F.col("value").alias("dest_value"))
    return x.join(y, on, "full_outer").where(~F.col("source_value").eqNullSafe(F.col("dest_value")))
