"""Streaming jobs run over the given tables until all data that is there is processed."""

from pyspark.sql import functions as F

from tallyframe.common import exact_sum
from tallyframe.operators.checkset import Check
from tallyframe.plans.fixtures import orders_changes, with_ctes
from tallyframe.plans.registry import query
from tallyframe.streaming import alerts, apply, checks, windows
from tallyframe.streaming.clock import advance, start_clock
from tallyframe.streaming.common import file_stream, scratch


def table_stream(t, name):
    """A table may be one file or a folder of files; a stream takes a single file only as a pattern."""
    return file_stream(t.spark, f"{t.base.rstrip('/')}/{name}.parque[t]", getattr(t, name).schema)


def utc(df, column):
    """Stream windows need a timestamp; the zone-free times of the tables are read as UTC, so that
    day windows do not depend on the zone of the session."""
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return df.withColumn(column, F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, column)))


def zone_free(column):
    """The UTC reading of a timestamp (whole seconds)."""
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.unix_seconds(F.col(column)))


def to_the_end(t, label, job):
    """Run a job over all rows that are there, then once more with a mark behind the last of them, which
    closes the windows still open."""
    p = scratch(t.spark, label)
    clock = start_clock(t.spark, f"{p}/clock")
    job(p, clock)
    advance(t.spark, clock, utc(t.events.agg(F.max("ts").alias("ts")), "ts").select(F.timestamp_add("DAY", F.lit(30), "ts")).first()[0])
    job(p, clock)
    return p


EVENT_CHECKS = [Check("value_range", "is_in_range", {"column": "value", "min_limit": 1, "max_limit": 150}),
                Check("json", "has_json_keys", {"column": "props", "keys": ["k"]}), Check("no_errors", "is_not_in_list", {"column": "event_type", "not_allowed": ["error"]}, "warn")]


@query("ss01_stream_checks", "SELECT event_id, value BETWEEN 1 AND 150 AS valid, CASE WHEN value BETWEEN 1 AND 150 THEN '' ELSE 'value_range' END AS errors FROM events")
def _(t):
    p = scratch(t.spark, "ss01")
    checks.check_stream(table_stream(t, "events"), EVENT_CHECKS, f"{p}/out", f"{p}/ck")
    good, bad = checks.outputs(t.spark, f"{p}/out")
    return good.select("event_id", F.lit(True).alias("valid"), F.lit("").alias("errors")).unionByName(
        bad.select("event_id", F.lit(False).alias("valid"), F.array_join("_errors", ",").alias("errors")))


@query("ss02_min_per_window", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS window_start, count(*) AS n_rows, count(*) < 10 AS failed FROM events GROUP BY 1")
def _(t):
    p = to_the_end(t, "ss02", lambda p, c: windows.count_windows(utc(table_stream(t, "events"), "ts"), "ts", "1 hour", "2 hours", f"{p}/out", f"{p}/ck", clock=c))
    w = windows.too_few(windows.closed_windows(t.spark, f"{p}/out"), 10)
    return w.withColumn("window_start", F.date_format(zone_free("window_start"), "yyyy-MM-dd HH:mm"))


@query("ss03_stream_apply", with_ctes("orders_applied") + "SELECT * FROM orders_applied")
def _(t):
    p = scratch(t.spark, "ss03")
    feed = orders_changes(t)
    feed.repartition("_commit_version").write.parquet(f"{p}/feed")
    apply.collect_changes(file_stream(t.spark, f"{p}/feed", feed.schema, files_per_batch=1), ["o_orderkey"], f"{p}/log", f"{p}/ck")
    return apply.current_state(t.spark, t.orders, f"{p}/log", ["o_orderkey"])


@query("ss04_stream_alerts", with_ctes("daily_wide") + """, m AS (SELECT table_fqn, measured_at, 'row_count' AS metric_name, row_count AS value FROM daily_wide UNION ALL SELECT table_fqn, measured_at, 'value_sum', value_sum FROM daily_wide),
s AS (SELECT *, avg(value) OVER w AS a, stddev_pop(value) OVER w AS d, count(*) OVER w AS n FROM m WINDOW w AS (PARTITION BY table_fqn, metric_name ORDER BY measured_at ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
SELECT table_fqn, measured_at, metric_name, value, round(abs(value - a) / d, 6) AS z_score, CASE WHEN abs(value - a) / d > 3 THEN 'critical' ELSE 'warning' END AS severity FROM s WHERE n >= 3 AND d > 0 AND abs(value - a) / d > 2""")
def _(t):
    ev = utc(table_stream(t, "events").withColumnRenamed("event_type", "table_fqn"), "ts")
    metrics = [F.count(F.lit(1)).alias("row_count"), exact_sum("value").alias("value_sum")]
    p = to_the_end(t, "ss04", lambda p, c: alerts.collect_metrics(ev, ["table_fqn"], "ts", "1 day", "2 days", metrics, f"{p}/out", f"{p}/ck", clock=c))
    a = alerts.current_alerts(t.spark, f"{p}/out")
    return a.select("table_fqn", F.date_format(zone_free("measured_at"), "yyyy-MM-dd").alias("measured_at"), "metric_name", "value", F.round("z_score", 6).alias("z_score"), "severity")


@query("ss05_late_arrivals", "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M') AS window_start, count(*) AS n_rows, count(*) FILTER (WHERE event_id % 50 > 30) AS late_rows FROM events GROUP BY 1")
def _(t):
    ev = utc(table_stream(t, "events"), "ts").withColumn("arrived_at", F.timestamp_add("MINUTE", (F.col("event_id") % 50).cast("int"), "ts"))
    p = to_the_end(t, "ss05", lambda p, c: windows.late_arrivals(ev, "ts", "arrived_at", "6 hours", "1 day", 30, f"{p}/out", f"{p}/ck", clock=c))
    return windows.closed_windows(t.spark, f"{p}/out").withColumn("window_start", F.date_format(zone_free("window_start"), "yyyy-MM-dd HH:mm"))
