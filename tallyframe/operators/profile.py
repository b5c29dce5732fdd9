"""Column profiles, value distributions, rule suggestions and catalog statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.common import is_numeric, is_temporal, is_text, top_rows, union_all, unpivot_stats

BASIC = ("total_rows", "null_count", "null_pct", "distinct_count", "distinct_pct", "min_value", "max_value", "avg_value",
         "min_length", "max_length", "avg_length")


def _columns(df: DataFrame, columns: Sequence[str] | None) -> list[T.StructField]:
    plain = lambda f: not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))
    return [f for f in df.schema.fields if (columns is None or f.name in columns) and plain(f)]


def _as_text(f: T.StructField):
    """Values as text in a form that does not depend on the engine's number formatting."""
    c = F.col(f"`{f.name}`")
    if is_temporal(f.dataType):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return c.cast("string")


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows per (column, value) for many columns in one shuffle; NULL is counted as a value."""
    items = [F.struct(F.lit(f.name).alias("column_name"), F.col(f"`{f.name}`").cast("string").alias("value")) for f in _columns(df, columns)]
    return (df.select(F.explode(F.array(*items)).alias("x")).select("x.*")
            .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("freq")))


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Exact number of distinct non-null values of many columns in one shuffle.

    Values keep a fixed width: whole numbers and times as long, other numbers as double, texts
    longer than a digest as their md5."""
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    items = []
    for i, f in enumerate(_columns(df, columns)):
        c, dt = F.col(f"`{f.name}`"), f.dataType
        whole, real, text = F.lit(None).cast("long"), F.lit(None).cast("double"), F.lit(None).cast("string")
        if isinstance(dt, (T.IntegralType, T.BooleanType)):
            whole = c.cast("long")
        elif isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
            whole = F.timestamp_diff("MICROSECOND", epoch, c.cast("timestamp_ntz"))
        elif isinstance(dt, T.FractionalType) and not isinstance(dt, T.DecimalType):
            real = c.cast("double")
        else:
            s = c.cast("string")
            text = F.when(F.octet_length(s) > 32, F.md5(s)).otherwise(s)
        items.append(F.struct(F.lit(i).alias("i"), whole.alias("whole"), real.alias("real"), text.alias("text")))
    names = F.array(*[F.lit(f.name) for f in _columns(df, columns)])
    values = df.select(F.explode(F.array(*items)).alias("x")).select("x.*").distinct()
    n = F.count_if(F.col("whole").isNotNull() | F.col("real").isNotNull() | F.col("text").isNotNull())
    return values.groupBy("i").agg(n.alias("distinct_count")).select(F.get(names, F.col("i")).alias("column_name"), "distinct_count")


def profile(df: DataFrame, columns: Sequence[str] | None = None, distinct: str = "exact") -> DataFrame:
    """One row per column: nulls, distinct values, numeric/date range and mean, text lengths.

    All plain statistics come from one scan. Exact distinct counts come from one shuffle of
    (column, value); ``distinct='approx'`` adds a sketch to the scan instead.
    """
    fields = _columns(df, columns)
    aggs, specs = [F.count(F.lit(1)).alias("n")], {}
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        num, tmp, txt = is_numeric(f.dataType), is_temporal(f.dataType), is_text(f.dataType)
        none_d, none_i = F.lit(None).cast("double"), F.lit(None).cast("int")
        items = {
            "non_null": F.count(c),
            "min_value": F.min(_as_text(f)) if tmp else (F.min(c).cast("double").cast("string") if num else F.lit(None).cast("string")),
            "max_value": F.max(_as_text(f)) if tmp else (F.max(c).cast("double").cast("string") if num else F.lit(None).cast("string")),
            "avg_value": F.avg(c.cast("double")) if num else none_d,
            "min_length": F.min(F.length(c)) if txt else none_i,
            "max_length": F.max(F.length(c)) if txt else none_i,
            "avg_length": F.avg(F.length(c)) if txt else none_d,
        }
        if distinct == "approx":
            items["distinct_count"] = F.approx_count_distinct(c, 0.02)
        aggs += [e.alias(f"{k}{i}") for k, e in items.items()]
        specs[f.name] = {**{k: f"{k}{i}" for k in items}, "total_rows": "n"}
    out = unpivot_stats(df.agg(*aggs), specs)
    if distinct != "approx":
        out = out.join(distinct_counts(df, columns), "column_name", "left").withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0)))
    n = F.greatest(F.col("total_rows"), F.lit(1))
    nulls = F.col("total_rows") - F.col("non_null")
    return out.select(
        "column_name", "total_rows", nulls.alias("null_count"), F.round(nulls / n * 100, 2).alias("null_pct"), "distinct_count",
        F.round(F.col("distinct_count") / n * 100, 2).alias("distinct_pct"), "min_value", "max_value",
        F.round("avg_value", 4).alias("avg_value"), "min_length", "max_length", F.round("avg_length", 4).alias("avg_length"))


def top_values(df: DataFrame, columns: Sequence[str] | None = None, n: int = 10, max_numeric_distinct: int | None = None) -> DataFrame:
    """Most frequent values of text and numeric columns; if ``max_numeric_distinct`` is given, only of
    numeric columns with no more distinct values than that."""
    fields = _columns(df, columns)
    counts = value_counts(df, [f.name for f in fields if is_text(f.dataType) or is_numeric(f.dataType)]).where("value IS NOT NULL")
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    best = top_rows(counts, ["column_name"], [F.desc("freq"), F.col("value")], n)
    if max_numeric_distinct is not None:
        numeric = [f.name for f in fields if is_numeric(f.dataType)]
        few = counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("d")).where(
            ~F.col("column_name").isin(numeric) | (F.col("d") <= max_numeric_distinct)).select("column_name")
        best = best.join(few, "column_name", "left_semi")
    return best.withColumn("pct", F.round(F.col("freq") / total * 100, 2))


def histograms(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 20) -> DataFrame:
    """Equal-width histograms of all numeric columns: one scan for the ranges, one for the counts."""
    names = [f.name for f in _columns(df, columns) if is_numeric(f.dataType)]
    rng = df.agg(*[x for i, c in enumerate(names) for x in (
        F.min(F.col(f"`{c}`").cast("double")).alias(f"lo{i}"), F.max(F.col(f"`{c}`").cast("double")).alias(f"hi{i}"))])
    items = []
    for i, c in enumerate(names):
        v = F.col(f"`{c}`").cast("double")
        lo, hi = rng.select(f"lo{i}").scalar(), rng.select(f"hi{i}").scalar()
        b = F.when(lo < hi, F.width_bucket(v, lo, hi + 0.0001, F.lit(bins)))
        items.append(F.struct(F.lit(c).alias("column_name"), b.alias("bucket"), v.alias("v")))
    return (df.select(F.explode(F.array(*items)).alias("x")).select("x.*").where("v IS NOT NULL AND bucket IS NOT NULL")
            .groupBy("column_name", "bucket").agg(F.count(F.lit(1)).alias("freq"), F.min("v").alias("bucket_min"), F.max("v").alias("bucket_max")))


def deep_profile(df: DataFrame, columns: Sequence[str] | None = None, top_n: int = 10, bins: int = 20,
                 max_numeric_distinct: int | None = None) -> dict[str, DataFrame]:
    """Profile, value distribution and histograms of a table or of any query result."""
    return {"profile": profile(df, columns), "top_values": top_values(df, columns, top_n, max_numeric_distinct), "histograms": histograms(df, columns, bins)}


def profile_tables(tables: Mapping[str, DataFrame], distinct: str = "exact", high_null_pct: float = 50.0) -> DataFrame:
    """Profiles of many tables with a flag for columns that are mostly NULL."""
    out = union_all([profile(df, None, distinct).withColumn("table_name", F.lit(n)) for n, df in tables.items()])
    return out.withColumn("high_null", F.col("null_pct") > high_null_pct)


def suggest_rules(df: DataFrame, columns: Sequence[str] | None = None, sample_fraction: float = 1.0, max_in_count: int = 10,
                  max_null_ratio: float = 0.01, remove_outliers: bool = True, sigmas: float = 3.0, seed: int = 42) -> DataFrame:
    """Rules that fit the data: not-null, in-list, range (without outliers) and uniqueness.

    The whole table is read. With a smaller ``sample_fraction`` a rule may be suggested that rows
    outside the sample break.
    """
    src = df if sample_fraction >= 1 else df.sample(fraction=sample_fraction, seed=seed)
    fields = _columns(src, columns)
    p = profile(src, [f.name for f in fields])
    num = [f.name for f in fields if is_numeric(f.dataType)]
    txt = [f.name for f in fields if is_text(f.dataType)]
    ratio = F.col("null_count") / F.greatest("total_rows", F.lit(1))
    none = F.lit(None).cast("string")
    rules = [p.where(ratio <= max_null_ratio).select("column_name", F.lit("is_not_null").alias("rule"), none.alias("arguments")),
             p.where((F.col("distinct_count") == F.col("total_rows")) & (F.col("total_rows") > 0)).select(
                 "column_name", F.lit("is_unique").alias("rule"), none.alias("arguments"))]
    if txt:
        counts = value_counts(src, txt).where("value IS NOT NULL")
        few = p.where(F.col("distinct_count").between(1, max_in_count)).select("column_name")
        # at most max_in_count values remain per column, so the list is small
        rules.append(counts.join(few, "column_name", "left_semi").groupBy("column_name").agg(
            F.array_join(F.array_sort(F.collect_list("value")), ",").alias("arguments")).select(
            "column_name", F.lit("is_in_list").alias("rule"), "arguments"))
    if num:
        s = src.agg(*[x for i, c in enumerate(num) for x in (
            F.avg(F.col(f"`{c}`").cast("double")).alias(f"m{i}"), F.stddev(F.col(f"`{c}`").cast("double")).alias(f"s{i}"))])
        bounds, specs = [], {}
        for i, c in enumerate(num):
            v = F.col(f"`{c}`").cast("double")
            if remove_outliers:
                m, sd = s.select(f"m{i}").scalar(), s.select(f"s{i}").scalar()
                v = F.when(sd.isNull() | (F.abs(v - m) <= sd * sigmas), v)
            bounds += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
            specs[c] = {"lo": f"lo{i}", "hi": f"hi{i}"}
        rules.append(unpivot_stats(src.agg(*bounds), specs).where("lo IS NOT NULL").select(
            "column_name", F.lit("is_in_range").alias("rule"), F.concat_ws(",", "lo", "hi").alias("arguments")))
    return union_all(rules)


FIXED_WIDTH = {"bigint": 8, "double": 8, "timestamp": 8, "timestamp_ntz": 8, "int": 4, "float": 4, "date": 4, "boolean": 1}


def catalog_stats(tables: Mapping[str, tuple[str, DataFrame]]) -> DataFrame:
    """Rows, columns and uncompressed bytes per table; tables are given with their schema name."""
    parts = []
    for name, (schema, df) in tables.items():
        size = F.lit(0).cast("long")
        for f in df.schema.fields:
            w = FIXED_WIDTH.get(f.dataType.simpleString())
            c = F.col(f"`{f.name}`")
            size = size + (F.lit(w) if w else F.coalesce(F.octet_length(c.cast("string")), F.lit(0)))
        parts.append(df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(size), F.lit(0)).alias("n_bytes")).select(
            F.lit(schema).alias("table_schema"), F.lit(name).alias("table_name"), "n_rows", "n_bytes",
            F.lit(len(df.columns)).alias("n_columns")))
    return union_all(parts)


def schema_rollup(stats: DataFrame) -> DataFrame:
    return stats.groupBy("table_schema").agg(
        F.count(F.lit(1)).alias("n_tables"), F.sum("n_rows").alias("n_rows"), F.sum("n_bytes").alias("n_bytes"),
        F.sum("n_columns").cast("long").alias("n_columns"))


def compare_profiles(a: DataFrame, b: DataFrame, metrics: Sequence[str] = ("null_pct", "distinct_count", "avg_value")) -> DataFrame:
    """Profile metrics of two tables side by side per column."""
    def long(df, tag):
        return df.select("column_name", F.explode(F.create_map(*[x for m in metrics for x in (
            F.lit(m), F.col(m).cast("double"))])).alias("metric", tag))

    j = long(a, "source_value").join(long(b, "dest_value"), ["column_name", "metric"], "full_outer")
    return j.withColumn("difference", F.round(F.col("dest_value") - F.col("source_value"), 4))
