"""Shared building blocks: skew-safe joins, top rows per key, exact percentiles, lineage cuts."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A key is "heavy" when it holds more than a given share of the rows: by default that of half a shuffle
# partition, and never less than 1/MOST_HEAVY. At most so many keys can be heavy, and the frame
# that lists them always fits a broadcast.
MOST_HEAVY = 100_000
SPREAD_FROM = 1_000_000
# Share of the left rows counted to find heavy keys, and the least count that shows one.
SAMPLE, MIN_SEEN = 0.01, 10


_local_scratch: str | None = None


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for cut tables, named by the cluster in spark.checkpoint.dir. A local session
    without the setting gets a temporary folder; a cluster must name one."""
    global _local_scratch
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors can reach")
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="tallyframe-")
    return _local_scratch


def new_scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/tallyframe-{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str = "cut", **options: str) -> DataFrame:
    """Write the frame to the shared folder and read it back, so later plans start from files."""
    path = new_scratch_path(df.sparkSession, label)
    df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def heavy_keys(df: DataFrame, keys: Sequence[str], max_heavy: int | None = None, fraction: float | None = SAMPLE) -> DataFrame:
    """Keys (NULL included) that hold more than 1/max_heavy of the rows of a sample, with their share:
    at most max_heavy rows. A key seen fewer than MIN_SEEN times does not count."""
    max_heavy = max_heavy or min(MOST_HEAVY, max(16, 2 * shuffle_partitions(df.sparkSession)))
    rows = df.select(*keys)
    if fraction:
        rows = rows.sample(fraction=fraction, seed=42)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("n")).scalar()
    return counts.where((F.col("__n") >= MIN_SEEN) & (F.col("__n") * F.lit(max_heavy) > total)).select(
        *keys, (F.col("__n") / total).alias("share"))


def planned_small(df: DataFrame) -> bool:
    """Whether the planner's size of a frame is below the limit up to which Spark broadcasts."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


def spread_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    extra: Column | None = None,
    hot_from: DataFrame | None = None,
    known_rows: int | None = None,
    no_broadcast: bool = False,
    max_heavy: int | None = None,
    salts: int | None = None,
    fraction: float | None = SAMPLE,
) -> DataFrame:
    """Equi-join whose left side may have hot keys.

    A right side that the planner knows to be small is joined as it is: Spark broadcasts it. Else a
    sample of the left keys is counted first, and the heavy keys (at most max_heavy) come to the
    driver. Without any, the join is a plain one. Else left rows of a heavy key are dealt over sub-keys,
    as many as shuffle partitions its share would fill twice (or ``salts``), and the matching right rows
    are repeated once per sub-key; all other keys are joined as usual. Which keys are found only
    decides how the work is spread, never the rows.

    ``how`` is inner, left, left_semi or left_anti; ``extra`` is a further join condition on
    non-key columns. The keys are sampled from ``hot_from`` (the left side by default): name a
    frame that is cheaper to read when the left side is itself the result of joins. When the left
    side is known to have fewer rows than SPREAD_FROM, no sample is taken. ``no_broadcast`` keeps a
    right side out of a broadcast whose rows were multiplied beyond what the planner's size
    estimate shows.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"spread_join does not support {how!r}")
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = F.lit(True) if extra is None else extra
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"__r_{k}"))
    right_keys = [f"__r_{k}" for k in keys]
    source = hot_from if hot_from is not None else left
    small = known_rows is not None and known_rows < SPREAD_FROM
    # With the number of salts given, the caller asks for a spread join.
    small = small or (salts is None and not no_broadcast and planned_small(right))
    found = [] if small else heavy_keys(source, keys, max_heavy, fraction).collect()
    if not found:
        return left.join(renamed.hint("merge") if no_broadcast else renamed, cond, how).drop(*right_keys)

    partitions = shuffle_partitions(left.sparkSession)
    rows = [(*tuple(r)[:-1], salts or max(2, math.ceil(2 * r["share"] * partitions))) for r in found]
    schema = T.StructType([*[T.StructField(f"__h_{k}", source.schema[k].dataType) for k in keys], T.StructField("__hot", T.IntegerType())])
    hot = F.broadcast(left.sparkSession.createDataFrame(rows, schema))

    def flagged(df: DataFrame, prefix: str = "") -> DataFrame:
        same = F.lit(True)
        for k in keys:
            same = same & F.col(f"{prefix}{k}").eqNullSafe(F.col(f"__h_{k}"))
        return df.join(hot, same, "left").drop(*[f"__h_{k}" for k in keys])

    hashable = [F.col(f"`{f.name}`") for f in left.schema.fields if not isinstance(f.dataType, T.MapType)]
    # Equal rows hash alike, so the input partition takes part in the salt.
    row_hash = F.xxhash64(F.spark_partition_id(), *hashable)
    dealt = flagged(left.withColumn("__row_hash", row_hash)).withColumn(
        "__salt", F.coalesce(F.pmod("__row_hash", F.col("__hot").cast("long")).cast("int"), F.lit(0))).drop("__hot", "__row_hash")
    all_salts = F.sequence(F.lit(0), F.col("__hot") - 1)
    repeated = flagged(renamed, "__r_").withColumn(
        "__r_salt", F.explode(F.when(F.col("__hot").isNotNull(), all_salts).otherwise(F.array(F.lit(0))))).drop("__hot")
    if no_broadcast:
        repeated = repeated.hint("merge")
    return dealt.join(repeated, cond & (F.col("__salt") == F.col("__r_salt")), how).drop("__salt", "__r_salt", *right_keys)


#: Rows of a task that sorts or groups by key. Spark merges small shuffle partitions by their compressed bytes, and whole
#: numbers take few, so a task would get many millions of rows, all of them in memory.
ROWS_PER_TASK = 500_000


def dealt_by_key(frames: Sequence[DataFrame], keys: Sequence[str]) -> list[DataFrame]:
    """Frames dealt alike by key, over as many tasks as the rows of the longest ask for: a join by these keys, or their
    distinct rows, move nothing again. Frames of few rows stay as they are."""
    rows = max(f.count() for f in frames)
    if rows < SPREAD_FROM:
        return list(frames)
    n = max(shuffle_partitions(frames[0].sparkSession), math.ceil(rows / ROWS_PER_TASK))
    return [f.repartition(n, *keys) for f in frames]


BROADCAST_ROWS = 200_000


def exceeds(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a frame has more rows than a limit; counts no further than the limit."""
    return df.limit(rows + 1).count() > rows


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, ties: bool = False) -> DataFrame:
    """First n rows per key. Spark limits each map partition per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    pos = (F.rank() if ties else F.row_number()).over(w)
    return df.withColumn("__pos", pos).where(F.col("__pos") <= n).drop("__pos")


BUCKETS, MAX_BUCKETS, ROWS_PER_BUCKET = 256, 8192, 1_000_000


def quantile_buckets(df: DataFrame, measure: DataFrame, value: str, name: str) -> DataFrame:
    """Number the rows of df by ranges of a double column that hold about equally many rows of
    ``measure``. The borders, at most MAX_BUCKETS numbers, come to the driver."""
    from pyspark.ml.feature import Bucketizer

    def borders(n: int):
        probs = [i / n for i in range(1, n)]
        return measure.agg(F.percentile_approx(value, probs, 4 * n).alias("c"), F.count(value).alias("n")).first()

    cuts, rows = borders(BUCKETS)
    if rows > BUCKETS * ROWS_PER_BUCKET:
        cuts, _ = borders(min(MAX_BUCKETS, rows // ROWS_PER_BUCKET))
    inner = sorted({c for c in cuts or [] if c == c and abs(c) != float("inf")})
    splits = [float("-inf"), *(inner or [0.0]), float("inf")]
    return Bucketizer(splits=splits, inputCol=value, outputCol=name, handleInvalid="keep").transform(df)


def exact_percentiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
) -> DataFrame:
    """Exact linear-interpolation percentiles per group, without holding a group in one task.

    Values are counted first (map-side) and the counts written; all else reads these. Distinct values are
    placed in buckets cut at approximate quantiles, so that the running count of a group is taken
    bucket by bucket: one small window over the bucket totals gives each bucket its offset, and one
    window per (group, bucket) ranks the distinct values of the few buckets that hold a wanted rank.
    The number of buckets grows with the distinct values. Values are doubles, as is the result.
    Returns ``by`` + ``prob`` + ``value``.
    """
    by = list(by)
    vals = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"))
    counted = cut_lineage(vals.groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__n")), "counts")
    counted = quantile_buckets(counted, counted, "__v", "__b")
    totals = counted.groupBy(*by, "__b").agg(F.sum("__n").alias("__bn"))
    g = [F.col(c) for c in by] or [F.lit(1)]
    wb = Window.partitionBy(*g).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        totals.withColumn("__off", F.coalesce(F.sum("__bn").over(wb), F.lit(0)))
        .withColumn("__total", F.sum("__bn").over(Window.partitionBy(*g)))
    )
    wanted = offsets.select(
        *by, "__b", "__off", "__bn", "__total",
        F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"),
    )
    pos = F.col("prob") * (F.col("__total") - 1)
    wanted = (
        wanted.withColumn("__lo", F.floor(pos)).withColumn("__hi", F.ceil(pos)).withColumn("__frac", pos - F.floor(pos))
        .where((F.col("__hi") >= F.col("__off")) & (F.col("__lo") < F.col("__off") + F.col("__bn")))
    )
    # Only the buckets that hold a wanted rank are ranked value by value.
    cond = F.col("w.__b") == F.col("c.__b")
    for c in by:
        cond = cond & F.col(f"w.{c}").eqNullSafe(F.col(f"c.{c}"))
    hits = counted.alias("c").join(wanted.alias("w"), cond, "inner").select(
        *[F.col(f"c.{c}").alias(c) for c in by], F.col("c.__b").alias("__b"), "__v", "__n", "__off", "prob", "__lo",
        "__hi", "__frac")
    wv = Window.partitionBy(*by, "prob", "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = hits.withColumn("__end", F.col("__off") + F.sum("__n").over(wv)).withColumn(
        "__start", F.col("__end") - F.col("__n"))

    def covers(rank: str) -> Column:
        return (F.col("__start") <= F.col(rank)) & (F.col(rank) < F.col("__end"))

    return (
        ranked.groupBy(*by, "prob", "__frac")
        .agg(F.max(F.when(covers("__lo"), F.col("__v"))).alias("__a"),
             F.max(F.when(covers("__hi"), F.col("__v"))).alias("__z"))
        .select(*by, "prob", (F.col("__a") + (F.col("__z") - F.col("__a")) * F.col("__frac")).alias("value"))
    )


def exact_sum(col: Column | str, scale: int = 4) -> Column:
    """Order-independent sum of a money-like double (summed as decimal, returned as double)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.sum(c.cast(T.DecimalType(28, scale))).cast("double")


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def is_temporal(dt: T.DataType) -> bool:
    return isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_text(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.VarcharType, T.CharType))


def as_ts(value) -> Column:
    """A point in time given as text becomes a time-zone-free timestamp literal."""
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp_ntz")


def hours_between(earlier: Column, later: Column) -> Column:
    """Whole hours from earlier to later, cut toward zero."""
    return F.timestamp_diff("HOUR", earlier.cast("timestamp_ntz"), later.cast("timestamp_ntz"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def unpivot_stats(one_row: DataFrame, specs: dict[str, dict[str, str]], id_name: str = "column_name") -> DataFrame:
    """Turn a one-row aggregate into one row per entry of specs ({entry: {out_name: agg_column}})."""
    rows = [
        F.struct(F.lit(name).alias(id_name), *[F.col(f"`{src}`").alias(out) for out, src in cols.items()])
        for name, cols in specs.items()
    ]
    return one_row.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
