"""Row-level comparison of two tables.

Both sides are tagged, unioned and counted per row digest or per key, so one shuffle with a
map-side combine replaces the joins: a key with very many rows stays a single small counter, and
no pairs of rows are ever formed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.common import is_text, spread_join


@dataclass(frozen=True)
class CompareOptions:
    ignore_nulls: bool = False
    ignore_case: bool = False
    ignore_whitespace: bool = False
    decimal_precision: int = 0


DEFAULT = CompareOptions()
PAIRS = "decimal(38,0)"


def shared_columns(src: DataFrame, dst: DataFrame, include: Sequence[str] | None = None,
                   exclude: Sequence[str] | None = None) -> list[str]:
    """Sorted common columns, narrowed by an allow-list or a deny-list."""
    cols = sorted(set(src.columns) & set(dst.columns))
    if include:
        cols = [c for c in cols if c in set(include)]
    if exclude:
        cols = [c for c in cols if c not in set(exclude)]
    return cols


def comparable(df: DataFrame, name: str, opt: CompareOptions = DEFAULT) -> Column:
    """A column as it takes part in comparison."""
    dt = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(dt, (T.DoubleType, T.FloatType, T.DecimalType)) and opt.decimal_precision > 0:
        c = F.round(c, opt.decimal_precision)
    if is_text(dt):
        if opt.ignore_case:
            c = F.lower(c)
        if opt.ignore_whitespace:
            c = F.trim(c)
    if opt.ignore_nulls:
        c = F.coalesce(c.cast("string"), F.lit(""))
    return c


def digest(parts: Sequence[Column]) -> Column:
    """128-bit digest of a list of values, taken from the typed values without building a text.

    NULLs take part by position, so values cannot slip from one column into the next."""
    null_marks = [p.isNull() for p in parts]
    return F.struct(*[F.xxhash64(F.lit(seed), *parts, *null_marks).alias(f"h{seed}") for seed in (0, 1)])


def row_digest(df: DataFrame, other: DataFrame, cols: Sequence[str], options: CompareOptions) -> Column:
    """Digest of a row as compared with rows of another frame; columns whose types differ between
    the two are compared as text."""
    parts = []
    for c in cols:
        v = comparable(df, c, options)
        same = df.schema[c].dataType == other.schema[c].dataType
        parts.append(v if same and not isinstance(df.schema[c].dataType, T.MapType) else v.cast("string"))
    return digest(parts)


def _tagged(src: DataFrame, dst: DataFrame, build) -> DataFrame:
    """Both sides in one frame: build(side, other side) with a source and a dest counter."""
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    return build(src, dst).select("*", one.alias("__s"), zero.alias("__d")).unionByName(
        build(dst, src).select("*", zero.alias("__s"), one.alias("__d")))


def _rate(matched: Column, total: Column) -> Column:
    return F.round(matched.cast("double") / F.greatest(total, F.lit(1)) * 100, 2)


def reconcile_hash(src: DataFrame, dst: DataFrame, columns: Sequence[str] | None = None,
                   options: CompareOptions = DEFAULT, multiset: bool = False) -> DataFrame:
    """Counts of rows present on one side only, with whole rows as identity.

    By default a row counts as present when the other side has any copy of it; with ``multiset``
    the numbers of copies are compared too.
    """
    cols = list(columns or shared_columns(src, dst))
    rows = _tagged(src, dst, lambda df, other: df.select(row_digest(df, other, cols, options).alias("__h")))
    n = rows.groupBy("__h").agg(F.sum("__s").alias("s"), F.sum("__d").alias("d"))
    s, d = F.col("s"), F.col("d")
    if multiset:
        missing, extra = F.greatest(s - d, F.lit(0)), F.greatest(d - s, F.lit(0))
    else:
        missing, extra = F.when(d == 0, s).otherwise(0), F.when(s == 0, d).otherwise(0)
    tot = n.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(a) for x, a in
                  ((s, "source_count"), (d, "dest_count"), (missing, "missing_in_dest"), (extra, "extra_in_dest"))])
    matched = F.col("source_count") - F.col("missing_in_dest")
    return tot.select("source_count", "dest_count", matched.alias("matched_rows"), "missing_in_dest", "extra_in_dest",
                      _rate(matched, F.col("source_count")).alias("match_rate_pct"))


def rows_only_in(src: DataFrame, dst: DataFrame, columns: Sequence[str] | None = None,
                 options: CompareOptions = DEFAULT) -> DataFrame:
    """Whole rows of the first frame with no equal row in the second."""
    cols = list(columns or shared_columns(src, dst))
    left = src.withColumn("__h", row_digest(src, dst, cols, options))
    right = dst.select(row_digest(dst, src, cols, options).alias("__h")).distinct()
    return spread_join(left, right, ["__h"], "left_anti").select(*src.columns)


def _has_null(keys: Sequence[str]) -> Column:
    c = F.lit(False)
    for k in keys:
        c = c | F.col(k).isNull()
    return c


def key_counts(src: DataFrame, dst: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None,
               options: CompareOptions = DEFAULT, null_safe: bool = False) -> DataFrame:
    """Per key: rows on each side, and how many (source, dest) row pairs agree or differ.

    Pair numbers come from products of counts per value digest, never from formed pairs; they are
    decimals of 38 digits, so that a key with billions of rows on both sides can't overflow them.
    A key with a NULL part matches nothing unless ``null_safe``.
    """
    cols = [c for c in (columns or shared_columns(src, dst)) if c not in keys]
    rows = _tagged(src, dst, lambda df, other: df.select(
        *[comparable(df, k, options).alias(k) for k in keys], row_digest(df, other, cols, options).alias("__h")))
    per_value = rows.groupBy(*keys, "__h").agg(F.sum("__s").alias("s"), F.sum("__d").alias("d"))
    return pair_counts(per_value, keys, null_safe)


def _product(a: str, b: str) -> Column:
    return (F.col(a).cast("decimal(19,0)") * F.col(b).cast("decimal(19,0)")).cast(PAIRS)


def pair_counts(per_value: DataFrame, keys: Sequence[str], null_safe: bool = False) -> DataFrame:
    """``key_counts`` from the rows s and d of each value digest of a key."""
    joins = F.lit(True) if null_safe else ~_has_null(keys)
    none = F.lit(0).cast(PAIRS)
    per_key = per_value.groupBy(*keys).agg(
        F.sum("s").alias("n_source"), F.sum("d").alias("n_dest"), F.sum(F.when(joins, _product("s", "d")).otherwise(none)).alias("__same"))
    pairs = F.when(joins, _product("n_source", "n_dest")).otherwise(none)
    same = F.col("__same").cast(PAIRS)
    return per_key.select(
        *keys, "n_source", "n_dest", same.alias("matched_rows"), (pairs - same).cast(PAIRS).alias("modified_rows"),
        F.when(pairs == 0, F.col("n_source")).otherwise(0).alias("missing_in_dest"),
        F.when(pairs == 0, F.col("n_dest")).otherwise(0).alias("extra_in_dest"))


COUNTS = ("matched_rows", "modified_rows", "missing_in_dest", "extra_in_dest")


def narrow_counts(counts: DataFrame) -> DataFrame:
    """Counts of pairs as whole numbers of 64 bits, for results known to fit them."""
    return counts.withColumns({c: F.col(c).cast("long") for c in COUNTS})


def reconcile_keyed(src: DataFrame, dst: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None,
                    options: CompareOptions = DEFAULT, by: Sequence[str] = (), null_safe: bool = False) -> DataFrame:
    """Row counts per outcome, overall or per ``by`` (which must be among the keys). matched_rows and
    modified_rows count pairs and are decimals: see ``narrow_counts``."""
    n = key_counts(src, dst, keys, columns, options, null_safe)
    aggs = [F.coalesce(F.sum("n_source"), F.lit(0)).alias("source_count"),
            F.coalesce(F.sum("n_dest"), F.lit(0)).alias("dest_count")]
    aggs += [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS]
    out = n.groupBy(*by).agg(*aggs) if by else n.agg(*aggs)
    return out.withColumn("match_rate_pct", _rate(F.col("matched_rows"), F.col("source_count")))


def key_status(src: DataFrame, dst: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None,
               options: CompareOptions = DEFAULT) -> DataFrame:
    """One outcome per key: matched, modified, missing_in_dest, extra_in_dest."""
    n = key_counts(src, dst, keys, columns, options)
    status = (F.when(F.col("modified_rows") > 0, "modified").when(F.col("matched_rows") > 0, "matched")
              .when(F.col("missing_in_dest") > 0, "missing_in_dest").otherwise("extra_in_dest"))
    return n.select(*keys, "n_source", "n_dest", status.alias("status"))


def paired_images(src: DataFrame, dst: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per key: row counts n_source / n_dest and one image of each side (structs s and d)."""
    def build(df, _other):
        return df.select(*keys, F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__img"))

    rows = _tagged(src, dst, build)
    return rows.groupBy(*keys).agg(
        F.sum("__s").alias("n_source"), F.sum("__d").alias("n_dest"),
        F.first(F.when(F.col("__s") == 1, F.col("__img")), ignorenulls=True).alias("s"),
        F.first(F.when(F.col("__d") == 1, F.col("__img")), ignorenulls=True).alias("d"))


def repeated_key_changes(src: DataFrame, dst: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For keys with several rows on a side: the images whose numbers of copies differ, with the action
    that makes dst equal to src (insert or delete_copies) and the number of copies.

    Copies are counted per image on both sides; no pairs are formed. NULL is a key like any other."""
    cols = [c for c in src.columns if c not in keys]
    rows = _tagged(src, dst, lambda df, _other: df.select(F.struct(*[F.col(f"`{k}`") for k in keys]).alias("__key"), F.struct(*[F.col(f"`{c}`") for c in cols]).alias("__img")))
    images = rows.groupBy("__key", "__img").agg(F.sum("__s").alias("s"), F.sum("__d").alias("d"))
    repeated = images.groupBy("__key").agg(F.sum("s").alias("ns"), F.sum("d").alias("nd")).where("ns > 1 OR nd > 1").select("__key")
    changed = spread_join(images.where("s <> d"), repeated, ["__key"], "left_semi")
    more = F.col("s") - F.col("d")
    return changed.select("__key.*", F.when(more > 0, "insert").otherwise("delete_copies").alias("action"), "__img.*", F.abs(more).alias("copies"))


def column_diffs(src: DataFrame, dst: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None,
                 options: CompareOptions = DEFAULT) -> DataFrame:
    """One row per key and differing column, with both values as text.

    Keys that are repeated on a side have no single image; each gives one row with column ``*``
    holding its number of rows on both sides. ``repeated_key_changes`` has their rows.
    """
    cols = [c for c in (columns or shared_columns(src, dst)) if c not in keys]
    keep = lambda df: df.select(*keys, *[comparable(df, c, options).alias(c) for c in cols])
    both = paired_images(keep(src), keep(dst), keys, cols).where("n_source > 0 AND n_dest > 0").where(~_has_null(keys))

    def entry(name, a, b):
        return F.struct(F.lit(name).alias("column_name"), a.cast("string").alias("source_value"),
                        b.cast("string").alias("dest_value"))

    per_col = F.filter(F.array(*[
        F.when(~F.col(f"s.{c}").eqNullSafe(F.col(f"d.{c}")), entry(c, F.col(f"s.{c}"), F.col(f"d.{c}")))
        for c in cols]), lambda x: x.isNotNull())
    repeated = (F.col("n_source") > 1) | (F.col("n_dest") > 1)
    diffs = F.when(repeated, F.array(entry("*", F.col("n_source"), F.col("n_dest")))).otherwise(per_col)
    return both.select(*keys, F.explode(diffs).alias("x")).select(*keys, "x.*")


def column_impact(diffs: DataFrame) -> DataFrame:
    """Modified rows per column."""
    return diffs.groupBy("column_name").agg(F.count(F.lit(1)).alias("modified_rows"))


def rollup(per_table: DataFrame) -> DataFrame:
    """Totals over the per-table results of many reconciliations."""
    s = {c: F.sum(c) for c in ("source_count", "dest_count", *COUNTS)}
    clean = (F.col("missing_in_dest") + F.col("extra_in_dest") + F.col("modified_rows")) == 0
    out = per_table.agg(F.count(F.lit(1)).alias("total_tables"), F.count_if(clean).alias("matched_tables"),
                        *[v.alias(k) for k, v in s.items()])
    return (out.withColumn("mismatched_tables", F.col("total_tables") - F.col("matched_tables"))
            .withColumn("match_rate_pct", _rate(F.col("matched_rows"), F.col("source_count"))))


def reconcile_incremental(src_changes: DataFrame, dst_changes: DataFrame, keys: Sequence[str],
                          columns: Sequence[str]) -> DataFrame:
    """Compare only the last inserted or updated image of every key in two change feeds."""
    from tallyframe.sources.changefeed import last_change_per_key

    def images(ch):
        live = ch.where(F.col("_change_type").isin("insert", "update_postimage"))
        return last_change_per_key(live, keys).select(*keys, *columns)

    return reconcile_keyed(images(src_changes), images(dst_changes), keys, columns)


def detect_key_columns(columns: Sequence[str], table: str, declared: Sequence[str] = ()) -> list[str]:
    """Declared primary key, else up to three columns whose names look like a key."""
    if declared:
        return list(declared)
    names = ("id", f"{table.lower()}_id")
    return [c for c in columns if c.lower() in names or c.lower().endswith(("_key", "_pk"))][:3]


def key_uniqueness(df: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """How far every candidate key column identifies a row."""
    from tallyframe.common import union_all

    return union_all([
        df.groupBy(F.col(c).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        .agg(F.count("k").alias("distinct_values"), F.sum("n").alias("total_rows"), F.max("n").alias("max_rows"))
        .select(F.lit(c).alias("column_name"), "distinct_values", "total_rows", (F.col("max_rows") == 1).alias("is_unique"))
        for c in candidates])


def preview_rows(src: DataFrame, dst: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, n: int = 3) -> DataFrame:
    """The first ``n`` rows of each side by key (a feature, not a limit on other results)."""
    cols = list(columns or shared_columns(src, dst))
    sides = []
    for name, df in (("source", src), ("dest", dst)):
        first = df.orderBy(*keys, *[c for c in cols if c not in keys]).limit(n)
        rank = F.row_number().over(Window.orderBy(*keys, *[c for c in cols if c not in keys]))
        sides.append(first.select(F.lit(name).alias("side"), rank.cast("long").alias("position"), *cols))
    return sides[0].unionByName(sides[1])


def table_preview(src: DataFrame, dst: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Match status, types on both sides and whether it is a key, per column; both row counts."""
    a = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    b = {f.name: f.dataType.simpleString() for f in dst.schema.fields}
    rows = []
    for name in sorted({*a, *b}):
        st = ("match" if a.get(name) == b.get(name) else "type_mismatch") if name in a and name in b else (
            "source_only" if name in a else "dest_only")
        rows.append(F.struct(F.lit(name).alias("column_name"), F.lit(st).alias("status"), F.lit(a.get(name)).cast("string").alias("source_type"),
                             F.lit(b.get(name)).cast("string").alias("dest_type"), F.lit(name in keys).alias("is_key")))
    counts = _tagged(src, dst, lambda df, _other: df.select()).agg(
        F.sum("__s").alias("source_count"), F.sum("__d").alias("dest_count"))
    return counts.select(F.explode(F.array(*rows)).alias("r"), "source_count", "dest_count").select(
        "r.*", "source_count", "dest_count")


def grouped_details(per_table: DataFrame, run_id: str, executed_at: str, schema_col: str, table_col: str) -> DataFrame:
    """Detail rows of a run: counts, delta and match flag per table."""
    clean = (F.col("missing_in_dest") + F.col("extra_in_dest") + F.col("modified_rows")) == 0
    return per_table.select(
        F.lit(run_id).alias("run_id"), F.col(schema_col).alias("schema_name"), F.col(table_col).alias("table_name"),
        "source_count", "dest_count", (F.col("dest_count") - F.col("source_count")).alias("delta_count"),
        (F.col("source_count") == F.col("dest_count")).alias("match"), clean.alias("checksum_match"),
        F.lit("").alias("error"), F.lit(executed_at).alias("executed_at"))


def run_summary(details: DataFrame) -> DataFrame:
    return details.groupBy("run_id", "executed_at").agg(
        F.count(F.lit(1)).alias("total_tables"), F.count_if("match").alias("matched"),
        F.count_if(~F.col("match")).alias("mismatched"), F.count_if(F.col("error") != "").alias("errors"))


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs side by side per table."""
    on = ["schema_name", "table_name"]
    pick = ["source_count", "dest_count", "delta_count", "match"]
    x = a.select(*on, *[F.col(c).alias(f"{c}_a") for c in pick])
    y = b.select(*on, *[F.col(c).alias(f"{c}_b") for c in pick])
    return x.join(y, on, "full_outer").withColumn(
        "change", F.when(F.col("match_a").isNull(), "new").when(F.col("match_b").isNull(), "gone")
        .when(F.col("match_a") == F.col("match_b"), "same").when(F.col("match_b"), "fixed").otherwise("broken"))


OPERATORS = ("<", ">", "<=", ">=", "==")


def evaluate_alerts(results: DataFrame, rules: Sequence[Mapping], pair: str = "pair") -> DataFrame:
    """Alerts fired by rules (rule_id, metric, operator, threshold, severity, optional pair) on run results.

    The metric columns of every result row are compared rule by rule in one pass.
    """
    fired = []
    for r in rules:
        if r["operator"] not in OPERATORS:
            raise ValueError(f"unknown operator {r['operator']!r}")
        v, lim = F.col(r["metric"]).cast("double"), F.lit(float(r["threshold"]))
        hit = {"<": v < lim, ">": v > lim, "<=": v <= lim, ">=": v >= lim, "==": v == lim}[r["operator"]]
        if r.get("pair"):
            hit = hit & (F.col(pair) == r["pair"])
        fired.append(F.when(hit, F.struct(
            F.lit(r["rule_id"]).alias("rule_id"), F.lit(r["metric"]).alias("metric"), v.alias("actual_value"),
            lim.alias("threshold"), F.lit(r.get("severity", "warning")).alias("severity"))))
    return (results.select(F.col(pair).alias("pair"), F.explode(F.filter(F.array(*fired), lambda x: x.isNotNull())).alias("a"))
            .select("pair", "a.*"))
