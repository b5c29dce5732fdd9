"""Streams in several batches give what the batch twin gives, also when a batch is run again."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyframe.operators.anomaly import score_metrics
from tallyframe.operators.changes import apply_changes
from tallyframe.plans.fixtures import orders_changes
from tallyframe.streaming import alerts, apply, windows
from tallyframe.streaming.clock import advance, closed, start_clock
from tallyframe.streaming.common import file_stream, run_available, scratch


def test_apply_in_batches_and_replay(spark, tables):
    p = scratch(spark, "t-apply")
    feed = orders_changes(tables)
    feed.repartition(5).write.parquet(f"{p}/feed")
    stream = lambda: file_stream(spark, f"{p}/feed", feed.schema, files_per_batch=1)
    q = apply.collect_changes(stream(), ["o_orderkey"], f"{p}/log", f"{p}/ck")
    assert len([x for x in q.recentProgress if x["numInputRows"]]) > 1
    want = sorted(map(tuple, apply_changes(tables.orders, feed, ["o_orderkey"]).collect()))
    assert sorted(map(tuple, apply.current_state(spark, tables.orders, f"{p}/log", ["o_orderkey"]).collect())) == want
    apply.collect_changes(stream(), ["o_orderkey"], f"{p}/log", f"{p}/ck-again")
    assert sorted(map(tuple, apply.current_state(spark, tables.orders, f"{p}/log", ["o_orderkey"]).collect())) == want
    assert apply.high_water_mark(spark, f"{p}/log").first().version == 4
    assert sorted(map(tuple, apply.compact(spark, tables.orders, f"{p}/log", ["o_orderkey"], f"{p}/base").collect())) == want


def _event_files(tables, p, n=4):
    """Events as n files, in order of time; a stream reads the oldest file first."""
    ev = tables.events.withColumn("ts", F.col("ts").cast("timestamp"))
    piece = F.ntile(n).over(Window.orderBy("ts"))
    for i in range(1, n + 1):
        ev.withColumn("piece", piece).where(F.col("piece") == i).drop("piece").coalesce(1).write.mode("append").parquet(f"{p}/events")
    return ev


def _six_hours(ev):
    return {(x.w, x.n) for x in ev.groupBy(F.window("ts", "6 hours").start.alias("w")).agg(F.count(F.lit(1)).alias("n")).collect()}


def test_window_counts_over_batches(spark, tables):
    """Each window is written once, when it closes; a mark closes those that are open at the end."""
    p = scratch(spark, "t-win")
    ev, c = _event_files(tables, p), start_clock(spark, f"{p}/clock")
    job = lambda: windows.count_windows(file_stream(spark, f"{p}/events", ev.schema, 1), "ts", "6 hours", "1 day", f"{p}/out", f"{p}/ck", clock=c)
    q = job()
    got = [(x.window_start, x.n_rows) for x in windows.closed_windows(spark, f"{p}/out").collect()]
    want = _six_hours(ev)
    assert len(got) == len(set(got)) < len(want) and set(got) < want and windows.dropped_rows(q) == 0
    advance(spark, c, "2100-01-01")
    job()
    got = [(x.window_start, x.n_rows) for x in windows.closed_windows(spark, f"{p}/out").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_windows_of_rows_without_keys(spark, tables):
    """Groups of NULL keys are rows like others, and aren't taken for marks."""
    p = scratch(spark, "t-null")
    ev = tables.events.select(F.col("ts").cast("timestamp").alias("ts"), F.lit(None).cast("string").alias("k")).limit(50)
    ev.write.parquet(f"{p}/events")
    c = start_clock(spark, f"{p}/clock")
    advance(spark, c, "2100-01-01")
    rows = closed(file_stream(spark, f"{p}/events", ev.schema), "ts", "400 days", "1 day", ["k"], [F.count(F.lit(1)).alias("n")], c)
    run_available(rows, lambda df, i: df.write.mode("overwrite").parquet(f"{p}/out/batch={i}"), f"{p}/ck")
    assert sum(x.n for x in spark.read.parquet(f"{p}/out").where("k IS NULL").collect()) == 50


def _daily(ev):
    return ev.groupBy(F.window("ts", "1 day").start.alias("measured_at"), "event_type").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.max(F.when(F.col("event_id") % 5 == 0, F.col("value"))).alias("top")).select(
        "measured_at", "event_type", F.inline(F.expr("array(struct('n' AS metric_name, n AS value), struct('top' AS metric_name, top AS value))")))


def test_alerts_over_batches(spark, tables):
    """Many batches, a baseline of few points: all scores equal those of the batch twin. A batch reads its own
    rows, and neither the state of a key nor what a batch reads grows."""
    p = scratch(spark, "t-alert")
    ev, c = _event_files(tables, p, 12), start_clock(spark, f"{p}/clock")
    aggs = [F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("event_id") % 5 == 0, F.col("value"))).alias("top")]

    def job():
        return alerts.collect_metrics(file_stream(spark, f"{p}/events", ev.schema, 1), ["event_type"], "ts", "1 day", "1 hour", aggs, f"{p}/out", f"{p}/ck", clock=c, baseline=6)

    q = job()
    read = [x["numInputRows"] for x in q.recentProgress]
    assert sum(read) == ev.count() + 1 and len([n for n in read if n]) >= 12 and max(read) < 2 * ev.count() / 12
    keys = ev.select("event_type").distinct().count() * len(aggs)
    assert max(s["numRowsTotal"] for x in q.recentProgress for s in x["stateOperators"] if "transformWithState" in s["operatorName"]) == keys
    advance(spark, c, "2100-01-01")
    job()
    got = alerts.scored_metrics(spark, f"{p}/out")
    want = score_metrics(_daily(ev), ["event_type", "metric_name"], "measured_at", "value", n=6)
    names = ["event_type", "metric_name", "measured_at", "value", "baseline_mean", "baseline_stddev", "n_points", "z_score", "is_anomaly", "severity"]
    key = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(names).fillna(-1, ["value", "z_score"]).collect())
    assert key(got) == key(want)
    assert alerts.current_alerts(spark, f"{p}/out").count() == want.where("is_anomaly").count() > 0
    assert spark.conf.get(alerts.STORE[0]) != alerts.STORE[1]  # the session keeps its own store
