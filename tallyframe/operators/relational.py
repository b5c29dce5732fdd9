"""Small relational operators used all over the library."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.common import exceeds, planned_small, spread_join, top_rows


# ---- selection ---------------------------------------------------------------------------------

def search_text(df: DataFrame, columns: Sequence[str], text: str) -> DataFrame:
    """Rows where any column contains the text, ignoring case; % and _ have no special meaning."""
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
    return df.where(cond)


def row_filter(df: DataFrame, column: str, allowed: Sequence, is_admin: bool = False) -> DataFrame:
    """Rows a role may see."""
    return df if is_admin else df.where(F.col(column).isin(list(allowed)))


def with_all_tags(objects: DataFrame, tags: DataFrame, on: str, required: Sequence[str]) -> DataFrame:
    """Objects that carry every required tag (tags: on, tag)."""
    have = (tags.where(F.col("tag").isin(list(required))).groupBy(on)
            .agg(F.count_distinct("tag").alias("n")).where(F.col("n") == len(set(required))))
    return objects.join(have.select(on), on, "left_semi")


# ---- joins -------------------------------------------------------------------------------------

def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Distinct child values without a parent, with their rows. The child is counted per value
    first, so the join sees every value once."""
    per_value = child.where(F.col(fk).isNotNull()).groupBy(fk).agg(F.count(F.lit(1)).alias("n_rows"))
    return per_value.join(parent.select(F.col(pk).alias(fk)).distinct(), fk, "left_anti")


def not_in_failures(child: DataFrame, fk: str, parent: DataFrame, pk: str, null_safe: bool = False) -> DataFrame:
    """Rows whose value is NOT IN the parent column. As in SQL, one NULL parent makes the test
    unknown, so nothing fails; ``null_safe`` ignores NULL parents."""
    n = orphans(child, fk, parent.where(F.col(pk).isNotNull()), pk).agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("failures"))
    total = child.agg(F.count(F.lit(1)).alias("n")).scalar()
    if not null_safe:
        null_parents = parent.agg(F.count_if(F.col(pk).isNull()).alias("n")).scalar()
        n = n.withColumn("failures", F.when(null_parents > 0, F.lit(0)).otherwise(F.col("failures")))
    return n.select(total.alias("total"), "failures")


def interval_join(facts: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, start: str, end: str,
                  how: str = "left", bucket_days: int = 30) -> DataFrame:
    """Facts with the interval row of their key that is valid at their time; a NULL end is open.

    Time is cut into buckets and an interval is repeated for each bucket it covers within the span
    of the facts, so a fact only meets the intervals of its own key and bucket. Intervals that the planner
    knows to be small are joined by key alone: Spark broadcasts them and reads the facts once.
    """
    valid = (F.col(start) <= F.col(at)) & (F.col(end).isNull() | (F.col(at) < F.col(end)))
    if planned_small(intervals):
        return spread_join(facts, intervals, keys, how, extra=valid)
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")

    def bucket(c: Column) -> Column:
        return F.floor(F.timestamp_diff("DAY", epoch, c.cast("timestamp_ntz")) / bucket_days)

    span = facts.agg(F.min(bucket(F.col(at))).alias("lo"), F.max(bucket(F.col(at))).alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    covered = intervals.withColumns({"__lo": F.greatest(bucket(F.col(start)), lo),
                                     "__hi": F.least(F.coalesce(bucket(F.col(end)), hi), hi)}).where("__lo <= __hi")
    covered = covered.withColumn("__bucket", F.explode(F.sequence("__lo", "__hi"))).drop("__lo", "__hi")
    placed = facts.withColumn("__bucket", bucket(F.col(at)))
    return spread_join(placed, covered, [*keys, "__bucket"], how, extra=valid, no_broadcast=exceeds(covered)).drop("__bucket")


def latest_rows(df: DataFrame, keys: Sequence[str], at: str, ties: bool = True) -> DataFrame:
    """The newest row of every key; equal times are all kept unless ``ties`` is off."""
    return top_rows(df, keys, [F.col(at).desc()], 1, ties)


def key_set_changes(before: DataFrame, after: DataFrame, on: Sequence[str], compare: Sequence[str]) -> DataFrame:
    """Keys that are new, removed, or changed in one of the compared columns."""
    a = before.select(*on, *[F.col(c).alias(f"{c}_before") for c in compare], F.lit(True).alias("__a"))
    b = after.select(*on, *[F.col(c).alias(f"{c}_after") for c in compare], F.lit(True).alias("__b"))
    differs = F.lit(False)
    for c in compare:
        differs = differs | ~F.col(f"{c}_before").eqNullSafe(F.col(f"{c}_after"))
    j = a.join(b, list(on), "full_outer")
    status = (F.when(F.col("__a").isNull(), "new").when(F.col("__b").isNull(), "removed").when(differs, "changed"))
    return j.withColumn("change", status).where("change IS NOT NULL").drop("__a", "__b")


def presence(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Members of two sets with where they occur: only_source, only_dest or both."""
    one = a.select(*on, F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(*on, F.lit(0).alias("x"), F.lit(1).alias("y")))
    g = one.groupBy(*on).agg(F.max("x").alias("x"), F.max("y").alias("y"))
    return g.select(*on, F.when(F.col("y") == 0, "only_source").when(F.col("x") == 0, "only_dest").otherwise("both").alias("place"))


# ---- aggregates --------------------------------------------------------------------------------

def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width buckets between min and max with rows, min and max per bucket."""
    v = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    s = v.agg(F.min("v").alias("lo"), (F.max("v") + 0.0001).alias("hi"))
    b = F.width_bucket(F.col("v"), s.select("lo").scalar(), s.select("hi").scalar(), F.lit(bins))
    return v.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("freq"), F.min("v").alias("bucket_min"),
                                            F.max("v").alias("bucket_max"))


def top_values(df: DataFrame, column: str, n: int, share_of: str = "non_null") -> DataFrame:
    """The n most frequent values with their share in percent; ties are ordered by value."""
    total = df.agg(F.count(F.col(column) if share_of == "non_null" else F.lit(1)).alias("n")).scalar()
    return (df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value"))
            .agg(F.count(F.lit(1)).alias("freq")).orderBy(F.desc("freq"), "value").limit(n)
            .withColumn("pct", F.round(F.col("freq") / total * 100, 2)))


def duplicate_groups(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Repeated values with their rows and the rows in excess of one."""
    g = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")
    return g.withColumn("extra_rows", F.col("n_rows") - 1)


def mean_null_rate(df: DataFrame, columns: Sequence[str]) -> Column:
    return sum((F.avg(F.col(f"`{c}`").isNull().cast("double")) for c in columns[1:]),
               F.avg(F.col(f"`{columns[0]}`").isNull().cast("double"))) / len(columns)


def distinct_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of distinct rows, rows with any NULL not counted."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(f"`{c}`").isNotNull()
    return df.where(ok).select(*columns).distinct().agg(F.count(F.lit(1)).alias("distinct_rows"))


def breakdown(df: DataFrame, dims: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """One pass over the facts for a total and a breakdown by each single dimension."""
    sets = [[F.col(d)] for d in dims] + [[]]
    g = df.groupingSets(sets, *[F.col(d) for d in dims]).agg(
        *aggs, *[F.grouping(d).alias(f"__g_{d}") for d in dims])
    dim = F.lit("total")
    val = F.lit(None).cast("string")
    for d in dims:
        dim = F.when(F.col(f"__g_{d}") == 0, d).otherwise(dim)
        val = F.when(F.col(f"__g_{d}") == 0, F.col(d).cast("string")).otherwise(val)
    names = [c for c in g.columns if c not in dims and not c.startswith("__g_")]
    return g.select(dim.alias("dimension"), val.alias("member"), *names)


# ---- windows -----------------------------------------------------------------------------------

def previous(df: DataFrame, keys: Sequence[str], order: str, column: str, name: str) -> DataFrame:
    return df.withColumn(name, F.lag(column).over(Window.partitionBy(*keys).orderBy(order)))


def moving_average(df: DataFrame, keys: Sequence[str], order: str, column: str, rows: int, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(rows - 1), 0)
    return df.withColumn(name, F.avg(column).over(w))


def share_of_total(df: DataFrame, group: Sequence[str], within: Sequence[str]) -> DataFrame:
    """Rows per group and their share of the enclosing group."""
    n = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    total = df.groupBy(*within).agg(F.count(F.lit(1)).alias("__total"))
    return spread_join(n, total, within).withColumn("share", F.col("n") / F.col("__total")).drop("__total")


def occurrences(df: DataFrame, name: str) -> DataFrame:
    """Rows of a list of names with the number of times each name occurs."""
    n = df.groupBy(name).agg(F.count(F.lit(1)).alias("n_occurrences"))
    return spread_join(df, n, [name], "inner")


def mean_recent_gap(df: DataFrame, keys: Sequence[str], at: str, n: int = 5) -> DataFrame:
    """Mean of the positive gaps in hours among the last n + 1 times of every key."""
    from tallyframe.common import top_rows as first_rows

    last = first_rows(df.select(*keys, at), keys, [F.col(at).desc()], n + 1)
    w = Window.partitionBy(*keys).orderBy(F.col(at))
    gap = F.timestamp_diff("MICROSECOND", F.lag(at).over(w), F.col(at)) / 3.6e9
    return last.withColumn("gap", gap).where("gap > 0").groupBy(*keys).agg(F.avg("gap").alias("mean_gap_hours"))


# ---- samples -----------------------------------------------------------------------------------

def sample_rows(df: DataFrame, key: Sequence[str], k: int) -> DataFrame:
    """A repeatable sample of k rows: the k smallest key hashes, ties by key."""
    return df.orderBy(F.md5(F.concat_ws("|", *key)), *key).limit(k)


def compare_positions(a: DataFrame, b: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """First k rows of two tables lined up by position; positions whose rows differ are returned."""
    def ranked(df, tag):
        first = df.orderBy(*order).limit(k)
        pos = F.row_number().over(Window.orderBy(*order))  # k rows only: the limit came first
        return first.select(pos.alias("position"), F.struct(*sorted(df.columns)).alias(tag))

    j = ranked(a, "s").join(ranked(b, "d"), "position", "full_outer")
    return j.where(~F.col("s").eqNullSafe(F.col("d")))
