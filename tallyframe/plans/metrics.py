"""Metric histories, anomalies, freshness, service levels and health over events and orders."""

from pyspark.sql import functions as F

from tallyframe.common import exact_sum
from tallyframe.operators import anomaly as an
from tallyframe.operators import freshness as fr
from tallyframe.operators import health as hs
from tallyframe.plans.fixtures import check_runs, daily_metrics, with_ctes
from tallyframe.plans.registry import query

M = with_ctes("daily_metrics")
KEYS = ["table_fqn", "metric_name"]
SCORED = """scored AS (SELECT table_fqn, metric_name, measured_at, value, n_points,
 CASE WHEN n_points >= 3 THEN m ELSE value END AS baseline_mean, CASE WHEN n_points >= 3 THEN s ELSE 0 END AS baseline_stddev,
 CASE WHEN n_points >= 3 AND s > 0 THEN abs(value - m) / s ELSE 0 END AS z
 FROM (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s, count(*) OVER w AS n_points FROM daily_metrics
   WINDOW w AS (PARTITION BY table_fqn, metric_name ORDER BY measured_at ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)))
"""
SEV = "CASE WHEN z > 3 THEN 'critical' WHEN z > 2 THEN 'warning' ELSE 'normal' END"


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def scored(t):
    return an.score_metrics(daily_metrics(t), KEYS, "measured_at", "value")


@query("an01_metric_z_scores", M + ", " + SCORED + f"""
SELECT table_fqn, metric_name, measured_at, value, n_points, round(baseline_mean, 6) AS baseline_mean, round(baseline_stddev, 6) AS baseline_stddev,
 round(z, 6) AS z_score, z > 2 AS is_anomaly, {SEV} AS severity FROM scored""")
def _(t):
    return r6(scored(t), "baseline_mean", "baseline_stddev", "z_score")


@query("an02_baseline_bands", M + """
SELECT table_fqn, metric_name, n AS n_points, round(m, 6) AS mean, round(s, 6) AS stddev, round(m - 2 * s, 6) AS lower_warning, round(m + 2 * s, 6) AS upper_warning,
 round(m - 3 * s, 6) AS lower_critical, round(m + 3 * s, 6) AS upper_critical
FROM (SELECT table_fqn, metric_name, count(*) AS n, avg(value) AS m, stddev_pop(value) AS s FROM daily_metrics GROUP BY 1, 2)""")
def _(t):
    return r6(an.baseline_bands(daily_metrics(t), KEYS, "value"), "mean", "stddev", "lower_warning", "upper_warning", "lower_critical", "upper_critical")


@query("an03_recompute_baselines", M + """
SELECT table_fqn, metric_name, count(*) AS n_points, round(avg(value), 6) AS new_mean, round(stddev_pop(value), 6) AS new_stddev
FROM (SELECT *, row_number() OVER (PARTITION BY table_fqn, metric_name ORDER BY measured_at DESC) AS rn FROM daily_metrics) WHERE rn <= 14 GROUP BY 1, 2 HAVING count(*) >= 2""")
def _(t):
    return r6(an.recompute_baselines(daily_metrics(t), KEYS, "measured_at", "value", 14), "new_mean", "new_stddev")


@query("an04_list_anomalies", M + ", " + SCORED + f"SELECT table_fqn, metric_name, measured_at, round(z, 6) AS z_score, {SEV} AS severity FROM scored WHERE z > 2")
def _(t):
    out = an.list_anomalies(scored(t), "measured_at")
    return r6(out, "z_score").select("table_fqn", "metric_name", "measured_at", "z_score", "severity")


@query("an05_collect_metrics", """
WITH d AS (SELECT user_id, event_type, CASE WHEN value > 20 THEN value END AS value FROM events)
SELECT 'events' AS table_fqn, 'row_count' AS metric_name, count(*)::DOUBLE AS value FROM d
UNION ALL SELECT 'events', 'null_rate', round((avg((user_id IS NULL)::INT) + avg((event_type IS NULL)::INT) + avg((value IS NULL)::INT)) / 3, 6) FROM d
UNION ALL SELECT 'events', 'distinct_count', (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type, value FROM d WHERE value IS NOT NULL))::DOUBLE""")
def _(t):
    d = t.events.select("user_id", "event_type", F.when(F.col("value") > 20, F.col("value")).alias("value"))
    return r6(an.collect_metrics(d, "events", d.columns), "value")


DAILY = """WITH daily AS (SELECT {day} AS d, {total} AS total FROM {src} GROUP BY 1), st AS (SELECT avg(total) AS m, stddev_samp(total) AS s FROM daily)
SELECT d, total, round(m, 4) AS mean_value, round(s, 4) AS std_value, round(abs(total - m) / s, 6) AS z_score, CASE WHEN abs(total - m) / s > 3 THEN 'critical' ELSE 'warning' END AS severity
FROM daily, st WHERE s > 0 AND abs(total - m) / s > {k}"""


def _rounded(out):
    return out.withColumns({"mean_value": F.round("mean_value", 4), "std_value": F.round("std_value", 4), "z_score": F.round("z_score", 6)})


@query("an06_daily_totals", DAILY.format(day="strftime(ts, '%Y-%m-%d')", total="CAST(sum(CAST(value AS DECIMAL(28,4))) AS DOUBLE)", src="events", k=1))
def _(t):
    daily = t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("d")).agg(exact_sum("value").alias("total"))
    return _rounded(an.period_outliers(daily, "total", 1.0))


@query("an07_row_outliers", """
SELECT event_id, round((value - m) / s, 6) AS z_score, CASE WHEN (value - m) / s > 3 THEN 'critical' WHEN (value - m) / s > 2.5 THEN 'warning' ELSE 'normal' END AS severity
FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) WHERE (value - m) / s > 2.5""")
def _(t):
    return r6(an.row_outliers(t.events, "value", 2.5), "z_score").select("event_id", "z_score", "severity")


@query("an08_daily_size", DAILY.format(day="strftime(l_shipdate, '%Y-%m')", total="CAST(sum(CAST(l_quantity AS DECIMAL(28,4))) AS DOUBLE)", src="lineitem", k=2))
def _(t):
    monthly = t.lineitem.groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("d")).agg(exact_sum("l_quantity").alias("total"))
    return _rounded(an.period_outliers(monthly, "total"))


@query("an09_failure_listing", """
SELECT event_id, CASE WHEN event_type = 'error' THEN 'critical' ELSE 'warning' END AS severity FROM events
WHERE event_type IN ('error', 'signup') AND CASE WHEN value > 20 THEN props ELSE '' END <> ''""")
def _(t):
    ops = t.events.withColumn("message", F.when(F.col("value") > 20, F.col("props")).otherwise(""))
    return an.failure_listing(ops, "event_type", "message", "ts", ["error", "signup"], ["error"]).select("event_id", "severity")


@query("an10_volume_overview", M + """, cur AS (SELECT event_type AS table_fqn, count(*) AS current_rows FROM events GROUP BY 1),
prev AS (SELECT table_fqn, arg_max(value, measured_at)::BIGINT AS previous_rows FROM daily_metrics WHERE metric_name = 'row_count' GROUP BY 1)
SELECT table_fqn, current_rows, previous_rows, round((current_rows - previous_rows) * 100.0 / previous_rows, 2) AS change_pct FROM cur LEFT JOIN prev USING (table_fqn)""")
def _(t):
    cur = t.events.groupBy(F.col("event_type").alias("table_fqn")).agg(F.count(F.lit(1)).alias("current_rows"))
    return an.volume_overview(cur, daily_metrics(t).where("metric_name = 'row_count'"))


@query("an11_volume_trend", M + "SELECT measured_at AS day, count(DISTINCT table_fqn) AS n_tables, sum(value) AS total_rows FROM daily_metrics WHERE metric_name = 'row_count' GROUP BY 1")
def _(t):
    return an.volume_trend(daily_metrics(t).where("metric_name = 'row_count'"))


# ---- freshness and service levels --------------------------------------------------------------

INV = "(SELECT user_id, CASE WHEN user_id % 20 = 0 THEN NULL ELSE max(ts) END AS last_change FROM events GROUP BY 1)"
FRESH = f"""SELECT user_id, round(date_diff('second', date_trunc('second', last_change), TIMESTAMP '2024-01-31') / 3600, 2) AS hours_since_update,
 CASE WHEN last_change IS NULL THEN 'unknown' WHEN date_diff('second', date_trunc('second', last_change), TIMESTAMP '2024-01-31') / 3600 <= 30 THEN 'fresh' ELSE 'stale' END AS status FROM {INV}"""


def _freshness(t):
    inv = t.events.groupBy("user_id").agg(F.max("ts").alias("m")).select(
        "user_id", F.when(F.col("user_id") % 20 != 0, F.date_trunc("second", F.col("m")).cast("timestamp_ntz")).alias("last_change"))
    return fr.freshness(inv, "last_change", "2024-01-31", 30)


@query("fr01_freshness", FRESH)
def _(t):
    return _freshness(t).drop("last_change")


@query("fr01_freshness_counts", f"""SELECT count(*) AS total_tables, count(*) FILTER (WHERE status = 'fresh') AS fresh, count(*) FILTER (WHERE status = 'stale') AS stale,
 count(*) FILTER (WHERE status = 'unknown') AS unknown FROM ({FRESH})""")
def _(t):
    return fr.freshness_counts(_freshness(t))


@query("fr02_freshness_history", with_ctes("check_runs") + "SELECT executed_at, total_rows FROM check_runs WHERE table_fqn = 'click' ORDER BY executed_at DESC LIMIT 20")
def _(t):
    return fr.history(check_runs(t), "table_fqn", "click", "executed_at", 20).select("executed_at", "total_rows")


@query("sl01_freshness_and_rows", """
SELECT 'freshness' AS metric, round(date_diff('second', max(o_orderdate), TIMESTAMP '2002-01-01') / 3600, 2) AS current_value, 24.0::DOUBLE AS threshold,
 date_diff('second', max(o_orderdate), TIMESTAMP '2002-01-01') / 3600 <= 24 AS passed FROM orders
UNION ALL SELECT 'row_count', count(*)::DOUBLE, 1000.0, count(*) >= 1000 FROM orders""")
def _(t):
    return fr.sla_freshness(t.orders, "o_orderdate", "2002-01-01", 24).unionByName(fr.sla_row_count(t.orders, 1000))


HOLES = "(SELECT o_orderkey, CASE WHEN o_orderkey % 8 <> 0 THEN o_custkey END AS o_custkey, CASE WHEN o_totalprice < 450000 THEN o_totalprice END AS o_totalprice FROM orders)"
PCT = " UNION ALL ".join(f"SELECT '{c}' AS column_name, round((count(*) - count({c})) * 100.0 / count(*), 2) AS null_pct FROM {HOLES}" for c in ("o_orderkey", "o_custkey", "o_totalprice"))


def _holes(t):
    return t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 8 != 0, F.col("o_custkey")).alias("o_custkey"),
                           F.when(F.col("o_totalprice") < 450000, F.col("o_totalprice")).alias("o_totalprice"))


@query("sl02_completeness", f"SELECT 'completeness' AS metric, round(avg(null_pct), 2) AS current_value, 5.0::DOUBLE AS threshold, round(avg(null_pct), 2) <= 5 AS passed, max(null_pct) AS max_null_pct FROM ({PCT})")
def _(t):
    d = _holes(t)
    return fr.sla_completeness(d, d.columns, 5.0)


@query("sl02_null_percentages", PCT)
def _(t):
    d = _holes(t)
    return fr.null_percentages(d, d.columns)


@query("sl03_accuracy", """
WITH d AS (SELECT o_orderpriority AS table_name, strftime(o_orderdate, '%Y-%m') AS executed_at, count(*) AS source_count, count(*) FILTER (WHERE o_orderkey % 97 <> 0) AS matched_rows FROM orders GROUP BY 1, 2)
SELECT table_name, round(matched_rows * 100.0 / source_count, 2) AS match_rate, round(matched_rows * 100.0 / source_count, 2) >= 99 AS passed
FROM d WHERE executed_at = (SELECT max(executed_at) FROM d e WHERE e.table_name = d.table_name)""")
def _(t):
    d = t.orders.groupBy(F.col("o_orderpriority").alias("table_name"), F.date_format("o_orderdate", "yyyy-MM").alias("executed_at")).agg(
        F.count(F.lit(1)).alias("source_count"), F.count_if(F.col("o_orderkey") % 97 != 0).alias("matched_rows"))
    return fr.sla_accuracy(d, 99.0)


@query("sl04_schema_stability", """
SELECT 'user_' || user_id AS table_name, count(*) FILTER (WHERE event_type = 'signup') AS schema_changes, count(*) FILTER (WHERE event_type = 'signup') = 0 AS passed
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 10 GROUP BY 1""")
def _(t):
    h = t.events.select(F.concat(F.lit("user_"), "user_id").alias("table_name"), F.col("event_id").alias("version"), F.col("event_type").alias("operation"))
    return fr.sla_schema_stability(h, ["signup"], 10)


CHECKS = """checks AS (SELECT table_fqn AS rule_id, executed_at AS checked_at, valid_rows / total_rows >= 0.95 AS passed FROM check_runs)"""


def _checks(t):
    return check_runs(t).select(F.col("table_fqn").alias("rule_id"), F.col("executed_at").alias("checked_at"), (F.col("valid_rows") / F.col("total_rows") >= 0.95).alias("passed"))


@query("sl05_sla_status", with_ctes("check_runs") + f""", {CHECKS}, rules AS (SELECT DISTINCT event_type AS rule_id, 'rows_' || event_type AS rule_name FROM events)
SELECT rule_id, rule_name, checked_at, passed FROM rules LEFT JOIN (SELECT * FROM checks c WHERE checked_at = (SELECT max(checked_at) FROM checks d WHERE d.rule_id = c.rule_id)) USING (rule_id)""")
def _(t):
    rules = t.events.select(F.col("event_type").alias("rule_id"), F.concat(F.lit("rows_"), "event_type").alias("rule_name")).distinct()
    return fr.sla_status(_checks(t), rules)


@query("sl06_sla_trend", with_ctes("check_runs") + f""", {CHECKS}
SELECT checked_at AS check_date, count(*) AS total_checks, count(*) FILTER (WHERE passed) AS passed_checks, round(count(*) FILTER (WHERE passed) * 100.0 / count(*), 1) AS compliance_pct
FROM checks WHERE checked_at >= '2024-01-05' GROUP BY 1""")
def _(t):
    return fr.sla_trend(_checks(t), "checked_at", "2024-01-05")


# ---- health ------------------------------------------------------------------------------------


@query("hs01_composite_health", M + ", " + SCORED + f""", d AS (
SELECT t.table_fqn, CASE WHEN t.table_fqn <> 'view' THEN round(f.fresh * 100.0 / f.n, 1) END AS freshness,
 greatest(0, 100 - least(100, a.c * 10 + a.w * 3))::DOUBLE AS anomaly, r.rate AS reconciliation
FROM (SELECT DISTINCT table_fqn FROM daily_metrics) t
JOIN (SELECT event_type AS table_fqn, count(*) AS n, count(*) FILTER (WHERE value < 100) AS fresh FROM events GROUP BY 1) f USING (table_fqn)
JOIN (SELECT table_fqn, count(*) FILTER (WHERE z > 3) AS c, count(*) FILTER (WHERE z > 2 AND z <= 3) AS w FROM scored GROUP BY 1) a USING (table_fqn)
JOIN (SELECT event_type AS table_fqn, round(count(*) FILTER (WHERE event_id % 9 <> 0) * 100.0 / count(*), 1) AS rate FROM events GROUP BY 1) r USING (table_fqn)),
e AS (SELECT *, (coalesce(freshness * 0.4, 0) + anomaly * 0.3 + reconciliation * 0.3) / (CASE WHEN freshness IS NULL THEN 0.6 ELSE 1.0 END) AS c FROM d)
SELECT table_fqn, freshness, anomaly, reconciliation, round(c, 1) AS composite_score, CASE WHEN c >= 90 THEN 'healthy' WHEN c >= 70 THEN 'warning' ELSE 'critical' END AS status FROM e""")
def _(t):
    e = t.events.groupBy(F.col("event_type").alias("table_fqn")).agg(
        F.round(F.count_if(F.col("value") < 100) / F.count(F.lit(1)) * 100, 1).alias("fr"), F.round(F.count_if(F.col("event_id") % 9 != 0) / F.count(F.lit(1)) * 100, 1).alias("reconciliation"))
    a = scored(t).groupBy("table_fqn").agg(hs.anomaly_score(F.count_if(F.col("severity") == "critical"), F.count_if(F.col("severity") == "warning")).alias("anomaly"))
    d = e.join(a, "table_fqn").select("table_fqn", F.when(F.col("table_fqn") != "view", F.col("fr")).alias("freshness"), "anomaly", "reconciliation")
    return hs.composite_health(d)


CATS = """cats AS (SELECT 'freshness' AS category, ts AS seen_at, value < 100 AS passed FROM events WHERE event_type = 'view'
UNION ALL SELECT 'sla', ts, value < 120 FROM events WHERE event_type = 'click' UNION ALL SELECT 'dq', ts, value > 1 FROM events WHERE event_type = 'purchase'
UNION ALL SELECT 'anomaly', ts, value < 200 FROM events WHERE event_type = 'error')"""
RATES = "rates AS (SELECT category, count(*) AS total, count(*) FILTER (WHERE passed) AS passed, round(count(*) FILTER (WHERE passed) * 100.0 / count(*), 1) AS rate FROM cats WHERE seen_at >= TIMESTAMP '2024-01-10' GROUP BY 1)"


def _cats(t):
    v = F.col("value")
    rule = {"view": ("freshness", v < 100), "click": ("sla", v < 120), "purchase": ("dq", v > 1), "error": ("anomaly", v < 200)}
    cat, ok = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for k, (c, p) in rule.items():
        cat = F.when(F.col("event_type") == k, c).otherwise(cat)
        ok = F.when(F.col("event_type") == k, p).otherwise(ok)
    return t.events.select(cat.alias("category"), F.col("ts").alias("seen_at"), ok.alias("passed")).where("category IS NOT NULL")


@query("hs02_observability_score", f"""WITH {CATS}, {RATES} SELECT CAST(round(0.25 * max(rate) FILTER (WHERE category = 'freshness') + 0.15 * 100
 + 0.2 * max(rate) FILTER (WHERE category = 'anomaly') + 0.25 * max(rate) FILTER (WHERE category = 'sla') + 0.15 * max(rate) FILTER (WHERE category = 'dq')) AS BIGINT) AS score FROM rates""")
def _(t):
    return hs.observability_score(hs.category_rates(_cats(t), "seen_at", "2024-01-10"))


@query("hs03_category_rates", f"WITH {CATS}, {RATES} SELECT * FROM rates")
def _(t):
    return hs.category_rates(_cats(t), "seen_at", "2024-01-10")


@query("hs04_issue_feed", M + ", " + SCORED + f""", u AS (SELECT 'anomaly' AS source, {SEV} AS severity, measured_at AS seen_at, table_fqn || ':' || metric_name AS title FROM scored WHERE z > 2
UNION ALL SELECT 'orders', CASE WHEN o_totalprice > 495000 THEN 'critical' ELSE 'info' END, strftime(o_orderdate, '%Y-%m-%d'), 'order ' || o_orderkey FROM orders
UNION ALL SELECT 'events', CASE WHEN event_type = 'error' AND value > 250 THEN 'warning' ELSE 'info' END, strftime(ts, '%Y-%m-%d'), 'event ' || event_id FROM events)
SELECT * FROM u ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, seen_at DESC, source, title LIMIT 100""")
def _(t):
    return hs.issue_feed({
        "anomaly": an.list_anomalies(scored(t), "measured_at").select("severity", F.col("measured_at").alias("seen_at"), F.concat_ws(":", "table_fqn", "metric_name").alias("title")),
        "orders": t.orders.select(F.when(F.col("o_totalprice") > 495000, "critical").otherwise("info").alias("severity"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("seen_at"), F.concat(F.lit("order "), "o_orderkey").alias("title")),
        "events": t.events.select(F.when((F.col("event_type") == "error") & (F.col("value") > 250), "warning").otherwise("info").alias("severity"), F.date_format("ts", "yyyy-MM-dd").alias("seen_at"), F.concat(F.lit("event "), "event_id").alias("title")),
    }, 100)


@query("hs05_daily_trend", f"""WITH {CATS} SELECT category, strftime(seen_at, '%Y-%m-%d') AS day, count(*) AS total, count(*) FILTER (WHERE passed) AS passed,
 round(avg(passed::INT) * 100, 1) AS pass_rate FROM cats GROUP BY 1, 2""")
def _(t):
    return hs.daily_trend(_cats(t), "seen_at")


@query("hs06_catalog_health", """
WITH g AS (SELECT 'user_' || user_id AS catalog, count(*) AS total, count(*) FILTER (WHERE event_type NOT IN ('error', 'signup')) AS succeeded,
 count(*) FILTER (WHERE event_type = 'error') AS failed, CAST(count(*) FILTER (WHERE value > 150) AS BIGINT) AS tables_failed, max(ts) FILTER (WHERE value > 1) AS last_operation FROM events GROUP BY 1)
SELECT catalog, total, succeeded, failed, tables_failed, last_operation, greatest(0, least(100, 100 - CASE WHEN failed / total > 0.5 THEN 30 WHEN failed / total > 0.2 THEN 20 WHEN failed > 0 THEN 10 ELSE 0 END
 - CASE WHEN tables_failed > 5 THEN 15 WHEN tables_failed > 0 THEN 5 ELSE 0 END - CASE WHEN last_operation IS NULL THEN 10 ELSE 0 END)) AS score FROM g""")
def _(t):
    ops = t.events.select(F.concat(F.lit("user_"), "user_id").alias("catalog"), "event_type", "value", F.when(F.col("value") > 1, F.col("ts")).alias("at"))
    k = F.col("event_type")
    return hs.catalog_health(ops, "catalog", k == "error", ~k.isin("error", "signup"), (F.col("value") > 150).cast("int"), "at")
