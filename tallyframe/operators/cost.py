"""Billing, cost attribution, utilisation and operation statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.common import exact_percentiles, exact_sum, spread_join, union_all
from tallyframe.operators.relational import breakdown, interval_join, latest_rows

# ---- Fixed values: prices and rates of the estimates ----
STORAGE_PRICE_PER_GB, SERVERLESS_PRICE, CLASSIC_PRICE = 0.023, 0.70, 0.22
GB_PER_UNIT, GB_PER_MINUTE = 10, 50


def priced_usage(usage: DataFrame, prices: DataFrame, dims: Sequence[str], sku: str, at: str, quantity: str) -> DataFrame:
    """Quantity and cost per price-relevant day and dimensions. Usage is summed per day first, so
    the price join sees one row per group, not one per usage record."""
    keys = list(dict.fromkeys([sku, *dims]))
    daily = usage.groupBy(F.date_trunc("day", F.col(at)).cast("timestamp_ntz").alias("usage_day"), *keys).agg(
        exact_sum(quantity).alias("quantity"), F.count(F.lit(1)).alias("n_records"))
    j = interval_join(daily, prices, [sku], "usage_day", "price_start", "price_end")
    return j.select("usage_day", *keys, "quantity", "n_records", (F.col("quantity") * F.coalesce("price", F.lit(0.0))).alias("cost"))


def cost_breakdown(costs: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Total and breakdown by each dimension and by day, in one pass."""
    df = costs.withColumn("day", F.date_format("usage_day", "yyyy-MM-dd"))
    return breakdown(df, ["day", *dims], [exact_sum("quantity").alias("quantity"), exact_sum("cost").alias("cost")])


def hourly_cost(usage: DataFrame, prices: DataFrame, sku: str, at: str, quantity: str, resource: str) -> DataFrame:
    u = usage.groupBy(F.date_trunc("hour", F.col(at)).cast("timestamp_ntz").alias("hour"), resource, sku).agg(exact_sum(quantity).alias("q"))
    u = u.withColumn("usage_day", F.date_trunc("day", "hour").cast("timestamp_ntz"))
    j = interval_join(u, prices, [sku], "usage_day", "price_start", "price_end")
    return j.groupBy("hour", resource).agg(exact_sum(F.col("q") * F.coalesce("price", F.lit(0.0))).alias("hour_cost"), exact_sum("q").alias("hour_quantity"))


def shared(amount: str, part: str, whole: str) -> Column:
    """amount * part / whole, rounded half away from zero to four places: in whole ten-thousandths and with one
    division, so that no rounding of doubles decides the last place."""
    units = f"cast(cast({amount} AS decimal(24,4)) * 10000 AS decimal(24,0))"
    rounded = f"(2BD * abs({units}) * cast({part} AS decimal(10,0)) + cast({whole} AS decimal(18,0))) div (2BD * cast({whole} AS decimal(18,0)))"
    return F.expr(f"cast(sign({amount}) AS long) * ({rounded}) / 10000D")


def query_cost(queries: DataFrame, hourly: DataFrame, resource: str, at: str, duration_ms: Column) -> DataFrame:
    """Cost of the hour shared among its queries by effective duration (1 ms to 1 h)."""
    q = queries.withColumns({"hour": F.date_trunc("hour", F.col(at)).cast("timestamp_ntz"),
                             "effective_ms": F.greatest(F.least(F.coalesce(duration_ms, F.lit(1)), F.lit(3_600_000)), F.lit(1))})
    total = q.groupBy("hour", resource).agg(F.sum("effective_ms").alias("total_ms"))
    rates = total.join(hourly, ["hour", resource], "left").select(
        "hour", resource, "total_ms", F.coalesce("hour_cost", F.lit(0.0)).alias("hour_cost"), F.coalesce("hour_quantity", F.lit(0.0)).alias("hour_quantity"))
    return spread_join(q, rates, ["hour", resource]).select(
        *queries.columns, shared("hour_cost", "effective_ms", "total_ms").alias("estimated_cost"), shared("hour_quantity", "effective_ms", "total_ms").alias("estimated_quantity"))


def idle_cost(hourly: DataFrame, queries: DataFrame, resource: str, at: str) -> DataFrame:
    """Cost of hours with and without queries."""
    active = queries.select(F.date_trunc("hour", F.col(at)).cast("timestamp_ntz").alias("hour"), resource).distinct().withColumn("active", F.lit(1))
    j = hourly.join(active, ["hour", resource], "left")
    on = F.col("active").isNotNull()
    return j.agg(exact_sum("hour_cost").alias("total_cost"), exact_sum(F.when(on, F.col("hour_cost")).otherwise(0.0)).alias("active_cost"),
                 exact_sum(F.when(~on, F.col("hour_cost")).otherwise(0.0)).alias("idle_cost"), F.count(F.lit(1)).alias("total_hours"),
                 F.count("active").alias("active_hours"), F.count_if(~on).alias("idle_hours"))


def job_cost(usage: DataFrame, prices: DataFrame, job: Sequence[str], name: str, sku: str, at: str, quantity: str, top: int | None = None) -> DataFrame:
    """Cost per job, of the ``top`` costliest if given: days active, quantity, cost, first and last day, first known name; costliest first."""
    day = F.date_trunc("day", F.col(at)).cast("timestamp_ntz")
    named_at = F.when(F.col(name).isNotNull(), F.col(at))
    daily = usage.groupBy(day.alias("usage_day"), *job, sku).agg(exact_sum(quantity).alias("q"), F.min_by(name, named_at).alias("name"), F.min(named_at).alias("named_at"))
    j = interval_join(daily, prices, [sku], "usage_day", "price_start", "price_end")
    out = j.groupBy(*job).agg(
        F.min_by("name", "named_at").alias("job_name"), F.count_distinct("usage_day").alias("active_days"), exact_sum("q").alias("quantity"),
        exact_sum(F.col("q") * F.coalesce("price", F.lit(0.0))).alias("cost"), F.min("usage_day").alias("first_run"), F.max("usage_day").alias("last_run"))
    ordered = out.orderBy(F.desc("cost"), *job)
    return ordered if top is None else ordered.limit(top)


def query_performance(queries: DataFrame, by: Sequence[str], duration: str, bytes_read: str, failed: Column) -> DataFrame:
    """Queries, mean and 95th percentile duration, bytes and failure rate per group."""
    g = queries.groupBy(*by) if by else queries.groupBy()
    base = g.agg(F.count(F.lit(1)).alias("query_count"), F.round(F.avg(duration)).alias("avg_duration_ms"), F.sum(bytes_read).cast("long").alias("total_read_bytes"),
                 F.round(F.count_if(failed) / F.count(F.lit(1)) * 100, 2).alias("failure_pct"))
    p = exact_percentiles(queries, duration, [0.95], by).select(*by, F.round("value").alias("p95_duration_ms"))
    if by:
        return base.join(p, list(by), "left")
    return base.withColumn("p95_duration_ms", p.select("p95_duration_ms").scalar())


def slowest(queries: DataFrame, duration: str, key: str, n: int = 50) -> DataFrame:
    return queries.orderBy(F.desc(duration), key).limit(n)


def node_utilisation(samples: DataFrame, cluster: str, at: str, cpu: Column, mem: Column) -> DataFrame:
    return samples.groupBy(cluster, F.to_date(at).cast("string").alias("day")).agg(
        F.round(F.avg(cpu), 1).alias("avg_cpu_pct"), F.round(F.avg(mem), 1).alias("avg_mem_pct"), F.round(F.max(cpu), 1).alias("max_cpu_pct"),
        F.round(F.max(mem), 1).alias("max_mem_pct"), F.count(F.lit(1)).alias("sample_count"))


def latest_configuration(versions: DataFrame, key: str, at: str, auto_stop: str) -> DataFrame:
    """Newest configuration per resource with a warning for missing or long auto-stop."""
    m = F.col(auto_stop)
    return latest_rows(versions, [key], at).withColumn("warning", F.when(m == 0, "auto-stop disabled").when(m > 120, "auto-stop is long"))


def storage_by_schema(stats: DataFrame) -> DataFrame:
    return stats.groupBy("table_schema").agg(F.count(F.lit(1)).alias("n_tables"), F.sum("n_bytes").alias("n_bytes")).withColumn(
        "size_gb", F.round(F.col("n_bytes") / 1024 ** 3, 6))


def largest_tables(stats: DataFrame, n: int = 20) -> DataFrame:
    return stats.orderBy(F.desc("n_bytes"), "table_schema", "table_name").limit(n)


def copy_cost(stats: DataFrame, deep: bool = True, price: float = SERVERLESS_PRICE) -> DataFrame:
    """Monthly storage and one-time compute cost of copying, with an estimate of the minutes."""
    g = stats.agg(F.count(F.lit(1)).alias("n_tables"), (F.sum("n_bytes") / 1024 ** 3).alias("gb"))
    gb, n = F.col("gb"), F.col("n_tables")
    units = F.greatest(F.lit(1.0), gb / GB_PER_UNIT) * 2 if deep else F.greatest(F.lit(0.5), n * 0.01)
    minutes = F.greatest(F.lit(1.0), gb / GB_PER_MINUTE) if deep else F.greatest(F.lit(0.5), n * 0.05)
    storage = gb * STORAGE_PRICE_PER_GB if deep else F.lit(0.0)
    return g.select("n_tables", F.round(gb, 2).alias("size_gb"), F.round(storage, 2).alias("storage_cost"), F.round(units, 1).alias("units"),
                    F.round(units * price, 2).alias("compute_cost"), F.round(minutes, 1).alias("minutes"))


def operation_metrics(tables: DataFrame, ok: Column, seconds: str, rows: str, total_seconds: Column) -> DataFrame:
    """Success, throughput per minute and mean duration of a many-table operation."""
    n = F.count(F.lit(1))
    good = F.count_if(ok)
    return tables.agg(n.alias("total_tables"), good.alias("successful"), (n - good).alias("failed"), F.round((n - good) / n * 100, 2).alias("failure_rate"),
                      F.round(n / (F.greatest(total_seconds, F.lit(0.001)) / 60), 2).alias("tables_per_min"), F.round(exact_sum(seconds) / n, 2).alias("avg_seconds"),
                      F.sum(rows).alias("total_rows"))


def activity(ops: DataFrame, dims: Sequence[str], at: str, ok: Column, failed: Column) -> DataFrame:
    """Operations by each dimension, by day and by hour, and in all, in one pass."""
    df = ops.withColumns({"day": F.date_format(at, "yyyy-MM-dd"), "hour": F.hour(at).cast("string")})
    return breakdown(df, [*dims, "day", "hour"], [F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("succeeded"), F.count_if(failed).alias("failed")])


def daily_activity(ops: DataFrame, at: str, as_of: str, days: int = 7) -> DataFrame:
    """Operations per day of the last days, days without any included."""
    end = F.lit(as_of).cast("date")
    n = ops.groupBy(F.to_date(at).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    # the spine has one row per day asked for
    spine = ops.agg(F.count(F.lit(1)).alias("c")).select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day"))
    return spine.join(n, "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


def week_over_week(ops: DataFrame, at: str, as_of: str) -> DataFrame:
    """Operations of this week (from Monday) and the week before, and the change in percent."""
    monday = F.date_trunc("week", F.lit(as_of).cast("timestamp_ntz")).cast("timestamp_ntz")
    before = F.timestamp_add("DAY", F.lit(-7), monday)
    t = F.col(at)
    g = ops.agg(F.count_if(t >= monday).alias("this_week"), F.count_if((t >= before) & (t < monday)).alias("last_week"))
    a, b = F.col("this_week"), F.col("last_week")
    return g.withColumn("change_pct", F.when(b > 0, F.round((a - b) / F.greatest(b, F.lit(1)) * 100, 1)).when(a > 0, 100.0).otherwise(0.0))


def compare_operations(ops: DataFrame, key: str, first, second, fields: Sequence[str]) -> DataFrame:
    """Fields that differ between two operations."""
    def long(value, name):
        items = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields]
        return ops.where(F.col(key) == value).select(F.explode(F.array(*items)).alias("r")).select("r.*")

    return long(first, "old_value").join(long(second, "new_value"), "field", "full_outer").where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def rightsizing(daily: DataFrame, cluster: str, max_cpu: float = 15.0, max_mem: float = 25.0) -> DataFrame:
    """Clusters whose mean daily CPU and memory stay below the limits."""
    g = daily.groupBy(cluster).agg(F.round(F.avg("avg_cpu_pct"), 4).alias("cpu"), F.round(F.avg("avg_mem_pct"), 4).alias("mem"))
    return g.where((F.col("cpu") < max_cpu) & (F.col("mem") < max_mem)).withColumn("severity", F.lit("warning"))


def event_timeline(events: DataFrame, kind: str, kinds: Sequence[str], at: str, n: int, key: str) -> DataFrame:
    return events.where(F.col(kind).isin(list(kinds))).orderBy(F.desc(at), key).limit(n)


def recommendations(*parts: DataFrame) -> DataFrame:
    return union_all(list(parts))


def top_members(ops: DataFrame, column: str, n: int = 5) -> DataFrame:
    g = ops.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("member")).agg(F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.desc("n"), "member").limit(n)


