"""Contracts, access patterns, cost and governance over the given tables."""

from pyspark.sql import functions as F

from tallyframe.operators import checkset as cs
from tallyframe.operators import contracts as dc
from tallyframe.operators import cost as fo
from tallyframe.operators import usage as us
from tallyframe.plans.fixtures import column_inventory, prices, query_log, with_ctes
from tallyframe.plans.registry import query

# ---- contracts ---------------------------------------------------------------------------------

HOLES = "(SELECT p_partkey, p_name, p_brand, CASE WHEN p_size > 45 THEN NULL ELSE p_size END AS p_size, p_retailprice FROM part)"


def _part(t):
    return t.part.select("p_partkey", "p_name", "p_brand", F.when(F.col("p_size") <= 45, F.col("p_size")).alias("p_size"), "p_retailprice")


@query("dc01_contract_schema", f"""
SELECT 'p_origin' AS column_name, 'missing_column' AS violation, NULL::BIGINT AS n_rows UNION ALL SELECT 'p_retailprice', 'type_mismatch', NULL
UNION ALL SELECT 'p_size', 'required_violation', count(*) FILTER (WHERE p_size IS NULL) FROM {HOLES} UNION ALL SELECT 'p_name', 'uniqueness_violation', count(*) - count(DISTINCT p_name) FROM {HOLES}""")
def _(t):
    return dc.validate_schema(_part(t), [
        {"name": "p_partkey", "type": "long", "required": True, "unique": True}, {"name": "p_name", "type": "varchar(20)", "unique": True},
        {"name": "p_size", "type": "int", "required": True}, {"name": "p_retailprice", "type": "string"}, {"name": "p_origin", "type": "string"}])


@query("dc02_contract_quality", f"""
SELECT 'nulls' AS rule, count(*) FILTER (WHERE p_size IS NULL)::DOUBLE AS value, count(*) FILTER (WHERE p_size IS NULL) = 0 AS passed FROM {HOLES}
UNION ALL SELECT 'dups', (count(*) - count(DISTINCT p_partkey))::DOUBLE, count(*) = count(DISTINCT p_partkey) FROM part
UNION ALL SELECT 'rows', count(*)::DOUBLE, count(*) BETWEEN 100 AND 1500 FROM part UNION ALL SELECT 'top', max(p_size)::DOUBLE, max(p_size) BETWEEN 40 AND 45 FROM {HOLES}""")
def _(t):
    return dc.validate_quality(_part(t), [
        {"name": "nulls", "metric": "nullValues", "column": "p_size"}, {"name": "dups", "metric": "duplicateValues", "column": "p_partkey"},
        {"name": "rows", "metric": "rowCount", "mustBeBetween": [100, 1500]}, {"type": "text", "name": "note"},
        {"name": "top", "type": "sql", "column": "p_size", "query": "SELECT max({property}) FROM {object}", "mustBeBetween": [40, 45]}])


OPS = (("mustBe", 7), ("mustNotBe", 7), ("mustBeGreaterThan", 30), ("mustBeGreaterOrEqualTo", 30), ("mustBeLessThan", 10), ("mustBeLessOrEqualTo", 10), ("mustBeBetween", (10, 20)), ("mustNotBeBetween", (10, 20)))
OPS_SQL = dict(zip([o for o, _ in OPS], ("= 7", "<> 7", "> 30", ">= 30", "< 10", "<= 10", "BETWEEN 10 AND 20", "NOT BETWEEN 10 AND 20"), strict=True))


@query("dc03_comparisons", " UNION ALL ".join(f"SELECT '{o}' AS operator, count(*) FILTER (WHERE l_quantity {s}) AS n FROM lineitem" for o, s in OPS_SQL.items()))
def _(t):
    one = t.lineitem.agg(*[F.count_if(dc.compare({o: v}, F.col("l_quantity"))).alias(o) for o, v in OPS])
    return one.select(F.explode(F.array(*[F.struct(F.lit(o).alias("operator"), F.col(o).alias("n")) for o, _ in OPS])).alias("r")).select("r.*")


@query("dc04_contract_sla", """
SELECT 'latency' AS property, date_diff('hour', max(ts), TIMESTAMP '2024-02-01')::DOUBLE AS value, 48.0::DOUBLE AS threshold, date_diff('hour', max(ts), TIMESTAMP '2024-02-01') <= 48 AS passed FROM (SELECT date_trunc('hour', ts + INTERVAL 1 HOUR) AS ts FROM events)
UNION ALL SELECT 'frequency', date_diff('hour', max(ts), TIMESTAMP '2024-02-01')::DOUBLE, 6.0, date_diff('hour', max(ts), TIMESTAMP '2024-02-01') <= 6 FROM (SELECT date_trunc('hour', ts + INTERVAL 1 HOUR) AS ts FROM events)
UNION ALL SELECT 'availability', count(*)::DOUBLE, NULL, true FROM events""")
def _(t):
    ev = t.events.withColumn("ts", F.date_trunc("hour", F.timestamp_add("HOUR", F.lit(1), "ts")))
    return dc.validate_sla(ev, "ts", [{"property": "latency", "value": 2, "unit": "d"}, {"property": "frequency", "value": 6, "unit": "h"}, {"property": "availability"}], "2024-02-01")


@query("dc05_contract_checks", f"""
SELECT 'null' AS check_name, count(*) AS failed_rows FROM {HOLES} WHERE p_size IS NULL UNION ALL SELECT 'brand', count(*) FROM part WHERE NOT regexp_matches(p_brand, '^Brand#[0-9]$')
UNION ALL SELECT 'names', count(*) FROM part WHERE p_name IN (SELECT p_name FROM part GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'price', count(*) FROM part WHERE NOT p_retailprice < 1000 HAVING count(*) > 0""")
def _(t):
    checks = dc.checks_from_contract([
        {"name": "null", "metric": "nullValues", "column": "p_size", "severity": "error"}, {"name": "names", "metric": "duplicateValues", "column": "p_name"},
        {"name": "brand", "metric": "invalidValues", "column": "p_brand", "arguments": {"pattern": "^Brand#[0-9]$"}}, {"name": "price", "type": "sql", "query": "p_retailprice < 1000", "severity": "critical"}])
    return cs.failure_counts(cs.apply_checks(_part(t), checks))


@query("dc06_generate_contract", "SELECT c AS column_name, lt AS logical_type, pt AS physical_type, nn = n AS required, d = n AS is_unique FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS c, '{lt}' AS lt, '{pt}' AS pt, count({c}) AS nn, count(DISTINCT {c}) AS d, count(*) AS n FROM {HOLES}" for c, lt, pt in (
        ("p_partkey", "integer", "bigint"), ("p_name", "string", "string"), ("p_brand", "string", "string"), ("p_size", "integer", "int"), ("p_retailprice", "number", "double"))) + ")")
def _(t):
    return dc.generate_contract(_part(t))


@query("dc06_update_frequency", """
WITH r AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events), g AS (SELECT user_id, date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts), ts) / 3.6e9 AS gap FROM r WHERE rn <= 6),
m AS (SELECT user_id, avg(gap) AS g FROM g WHERE gap > 0 GROUP BY 1) SELECT user_id, round(g, 6) AS mean_gap_hours, (CASE WHEN g < 2 THEN 1 WHEN g < 48 THEN round_even(g, 0) ELSE round_even(g / 24, 0) END)::INT AS value, CASE WHEN g < 48 THEN 'h' ELSE 'd' END AS unit FROM m""")
def _(t):
    return dc.update_frequency(t.events, ["user_id"], "ts").withColumn("mean_gap_hours", F.round("mean_gap_hours", 6))


@query("dc07_simple_contract", "SELECT count(*) AS n_rows, date_diff('hour', max(o_orderdate), TIMESTAMP '2002-01-01') AS age_hours, 'o_channel' AS missing_columns, date_diff('hour', max(o_orderdate), TIMESTAMP '2002-01-01') <= 24 AS fresh, count(*) >= 100 AS enough_rows, false AS passed FROM orders")
def _(t):
    return dc.simple_check(t.orders, ["o_orderkey", "o_channel"], "o_orderdate", 24, 100, "2002-01-01")


# ---- access ------------------------------------------------------------------------------------

L = with_ctes("query_log")


@query("us01_access_patterns", "SELECT event_type AS table_name, count(*) AS query_count, min(ts) AS first_accessed, max(ts) AS last_accessed, count(DISTINCT user_id) AS distinct_users FROM events GROUP BY 1")
def _(t):
    return us.access_patterns(t.events, "event_type", "ts", "user_id")


PARSED = "(SELECT *, 'main.sales.' || regexp_extract(statement_text, 'FROM main.sales.([a-z]+)', 1) AS table_name FROM query_log)"


@query("us02_tables_in_queries", L + f"SELECT table_name, count(*) AS query_count, min(start_time) AS first_accessed, max(start_time) AS last_accessed, count(DISTINCT user_name) AS distinct_users FROM {PARSED} GROUP BY 1")
def _(t):
    return us.access_patterns(us.tables_in_queries(query_log(t), "statement_text", "main"), "table_name", "start_time", "user_name")


@query("us03_usage_classes", "SELECT 'c' || o_custkey AS table_name, count(*) AS query_count, CASE WHEN count(*) >= 100 THEN 'frequent' WHEN count(*) >= 10 THEN 'occasional' ELSE 'rare' END AS usage FROM orders GROUP BY 1")
def _(t):
    a = t.orders.groupBy(F.concat(F.lit("c"), "o_custkey").alias("table_name")).agg(F.count(F.lit(1)).alias("query_count"))
    return us.usage_classes(a)


@query("us03_unused_tables", "SELECT 'c' || c_custkey AS table_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(t):
    a = t.orders.select(F.concat(F.lit("c"), "o_custkey").alias("table_name"))
    return us.unused(t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("table_name")), a)


@query("us04_column_usage", L + f"""SELECT table_name, column_name, user_name, count(*) AS usage_count FROM (SELECT table_name, user_name, unnest([regexp_extract(statement_text, 'SELECT (k[0-9])', 1), regexp_extract(statement_text, '(total_[a-z]+)', 1)]) AS column_name FROM {PARSED}) GROUP BY 1, 2, 3""")
def _(t):
    return us.column_usage(query_log(t), "statement_text", "user_name", "main")


@query("us04_column_usage_totals", L + f"""SELECT table_name, column_name, count(*) AS usage_count, count(DISTINCT user_name) AS user_count FROM (SELECT table_name, user_name, unnest([regexp_extract(statement_text, 'SELECT (k[0-9])', 1), regexp_extract(statement_text, '(total_[a-z]+)', 1)]) AS column_name FROM {PARSED}) GROUP BY 1, 2""")
def _(t):
    return us.column_usage_totals(us.column_usage(query_log(t), "statement_text", "user_name", "main"))


@query("us04_column_usage_users", L + f"""SELECT user_name, sum(n)::BIGINT AS usage_count, count(*) AS column_count FROM (SELECT table_name, column_name, user_name, count(*) AS n FROM (SELECT table_name, user_name, unnest([regexp_extract(statement_text, 'SELECT (k[0-9])', 1), regexp_extract(statement_text, '(total_[a-z]+)', 1)]) AS column_name FROM {PARSED}) GROUP BY 1, 2, 3) GROUP BY 1""")
def _(t):
    return us.column_usage_users(us.column_usage(query_log(t), "statement_text", "user_name", "main"))


@query("us04_calls_and_subqueries", """
SELECT 'main.sales.' || event_type AS table_name, column_name, 'u' || user_id AS user_name, count(*) AS usage_count
FROM events, (VALUES ('c'), ('d')) x(column_name) GROUP BY 1, 2, 3
UNION ALL SELECT 'main.sales.inner_' || event_type, 'a', 'u' || user_id, count(*) FROM events GROUP BY 1, 3""")
def _(t):
    stmt = F.concat(F.lit("WITH x AS (SELECT a FROM main.sales.inner_"), "event_type", F.lit(") SELECT coalesce(q.a, round(b, 2)) AS c, q.d FROM main.sales."), "event_type",
                    F.lit(" q JOIN x ON x.a IN (1, 2)"))
    log = t.events.select(stmt.alias("s"), F.concat(F.lit("u"), "user_id").alias("user_name"))
    return us.column_usage(log, "s", "user_name", "main")


@query("us05_column_name_frequency", with_ctes("inventory_1") + "SELECT table_name, column_name, count(*) OVER (PARTITION BY column_name) AS n_occurrences FROM inventory_1")
def _(t):
    return us.column_name_frequency(column_inventory(t, 1).select("table_name", "column_name"))


# ---- cost --------------------------------------------------------------------------------------

USAGE = """u AS (SELECT *, 'w' || (user_id % 12) AS warehouse, 'u' || (user_id % 40) AS run_as, date_trunc('day', ts)::TIMESTAMP AS usage_day, date_trunc('hour', ts)::TIMESTAMP AS hour FROM events),
c AS (SELECT u.*, coalesce(p.price, 0) AS price FROM u LEFT JOIN prices p ON u.event_type = p.event_type AND p.price_start <= u.usage_day AND (p.price_end IS NULL OR u.usage_day < p.price_end))"""
P = with_ctes("prices") + ", " + USAGE
COST = "CAST(sum(CAST(value * price AS DECIMAL(28,4))) AS DOUBLE)"
QTY = "CAST(sum(CAST(value AS DECIMAL(28,4))) AS DOUBLE)"


def usage(t):
    return t.events.select("event_id", "ts", "event_type", "value", "user_id", F.concat(F.lit("w"), F.col("user_id") % 12).alias("warehouse"), F.concat(F.lit("u"), F.col("user_id") % 40).alias("run_as"))


@query("fo01_billing", P + f"""
SELECT CASE WHEN GROUPING(day) = 0 THEN 'day' WHEN GROUPING(event_type) = 0 THEN 'event_type' WHEN GROUPING(warehouse) = 0 THEN 'warehouse' WHEN GROUPING(run_as) = 0 THEN 'run_as' ELSE 'total' END AS dimension,
 CASE WHEN GROUPING(day) = 0 THEN day WHEN GROUPING(event_type) = 0 THEN event_type WHEN GROUPING(warehouse) = 0 THEN warehouse WHEN GROUPING(run_as) = 0 THEN run_as END AS member, {QTY} AS quantity, {COST} AS cost
FROM (SELECT *, strftime(usage_day, '%Y-%m-%d') AS day FROM c) GROUP BY GROUPING SETS ((day), (event_type), (warehouse), (run_as), ())""")
def _(t):
    costs = fo.priced_usage(usage(t), prices(t), ["event_type", "warehouse", "run_as"], "event_type", "ts", "value")
    return fo.cost_breakdown(costs, ["event_type", "warehouse", "run_as"])


def _hourly(t):
    return fo.hourly_cost(usage(t), prices(t), "event_type", "ts", "value", "warehouse")


HOURLY = f"h AS (SELECT hour, warehouse, {COST} AS hour_cost, {QTY} AS hour_quantity FROM c GROUP BY 1, 2)"


# In whole ten-thousandths with one division: amounts are never negative here.
SHARE = "(2 * coalesce(round({0} * 10000), 0)::HUGEINT * ms + total::HUGEINT) // (2 * total::HUGEINT) / 10000.0"


@query("fo02_query_cost", P + f""", {HOURLY}, q AS (SELECT event_id, hour, warehouse, greatest(least(CAST(round(value * 100) AS BIGINT), 3600000), 1) AS ms FROM u), tot AS (SELECT hour, warehouse, sum(ms) AS total FROM q GROUP BY 1, 2)
SELECT event_id, {SHARE.format("hour_cost")} AS estimated_cost, {SHARE.format("hour_quantity")} AS estimated_quantity FROM q JOIN tot USING (hour, warehouse) LEFT JOIN h USING (hour, warehouse)""")
def _(t):
    q = usage(t).select("event_id", "ts", "warehouse", F.round(F.col("value") * 100).cast("long").alias("ms"))
    return fo.query_cost(q, _hourly(t), "warehouse", "ts", F.col("ms")).select("event_id", "estimated_cost", "estimated_quantity")


@query("fo03_idle_cost", P + f""", {HOURLY}, act AS (SELECT DISTINCT hour, warehouse, 1 AS a FROM u WHERE event_type = 'view')
SELECT sum(hour_cost::DECIMAL(28,4))::DOUBLE AS total_cost, coalesce(sum(hour_cost::DECIMAL(28,4)) FILTER (WHERE a = 1), 0)::DOUBLE AS active_cost, coalesce(sum(hour_cost::DECIMAL(28,4)) FILTER (WHERE a IS NULL), 0)::DOUBLE AS idle_cost,
 count(*) AS total_hours, count(a) AS active_hours, count(*) - count(a) AS idle_hours FROM h LEFT JOIN act USING (hour, warehouse)""")
def _(t):
    return fo.idle_cost(_hourly(t), usage(t).where("event_type = 'view'"), "warehouse", "ts")


@query("fo04_job_cost", P + f"""
SELECT run_as, warehouse, arg_min(event_type, ts) FILTER (WHERE value > 40) AS job_name, count(DISTINCT usage_day) AS active_days, {QTY} AS quantity, {COST} AS cost, min(usage_day) AS first_run, max(usage_day) AS last_run
FROM c GROUP BY 1, 2 ORDER BY cost DESC, run_as, warehouse LIMIT 200""")
def _(t):
    u = usage(t).withColumn("nm", F.when(F.col("value") > 40, F.col("event_type")))
    return fo.job_cost(u, prices(t), ["run_as", "warehouse"], "nm", "event_type", "ts", "value", top=200)


PERF = """SELECT {by} count(*) AS query_count, round(avg(ms)) AS avg_duration_ms, CAST(sum(event_id) AS BIGINT) AS total_read_bytes, round(count(*) FILTER (WHERE event_type = 'error') * 100.0 / count(*), 2) AS failure_pct,
 round(quantile_cont(ms, 0.95)) AS p95_duration_ms FROM (SELECT *, 'w' || (user_id % 12) AS warehouse, value * 100 AS ms FROM events)"""


def _perf(t):
    return usage(t).withColumn("ms", F.col("value") * 100)


@query("fo05_query_performance", PERF.format(by=""))
def _(t):
    return fo.query_performance(_perf(t), [], "ms", "event_id", F.col("event_type") == "error")


@query("fo05_performance_by_warehouse", PERF.format(by="warehouse,") + " GROUP BY 1")
def _(t):
    return fo.query_performance(_perf(t), ["warehouse"], "ms", "event_id", F.col("event_type") == "error")


@query("fo05_slowest_queries", "SELECT event_id, value * 100 AS ms FROM events ORDER BY value DESC, event_id LIMIT 50")
def _(t):
    return fo.slowest(_perf(t), "ms", "event_id").select("event_id", "ms")


UTIL = "SELECT 'w' || (user_id % 12) AS warehouse, strftime(ts, '%Y-%m-%d') AS day, round(avg(floor(value)), 1) AS avg_cpu_pct, round(avg(floor(value / 3)), 1) AS avg_mem_pct, round(max(floor(value)), 1) AS max_cpu_pct, round(max(floor(value / 3)), 1) AS max_mem_pct, count(*) AS sample_count FROM events GROUP BY 1, 2"


def _util(t):
    return fo.node_utilisation(usage(t), "warehouse", "ts", F.floor("value").cast("double"), F.floor(F.col("value") / 3).cast("double"))


@query("fo06_node_utilisation", UTIL)
def _(t):
    return _util(t)


CONF = """SELECT user_id, event_id, CASE WHEN auto_stop = 0 THEN 'auto-stop disabled' WHEN auto_stop > 120 THEN 'auto-stop is long' END AS warning
FROM (SELECT *, CAST(floor(value) AS BIGINT) AS auto_stop, rank() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rk FROM events) WHERE rk = 1"""


def _conf(t):
    return fo.latest_configuration(t.events.withColumn("auto_stop", F.floor("value")), "user_id", "ts", "auto_stop")


@query("fo07_latest_configuration", CONF)
def _(t):
    return _conf(t).select("user_id", "event_id", "warning")


SIZES = "st AS (SELECT lang AS table_schema, source AS table_name, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes FROM documents GROUP BY 1, 2)"


def _sizes(t):
    return t.documents.groupBy(F.col("lang").alias("table_schema"), F.col("source").alias("table_name")).agg(F.sum(F.octet_length("text")).alias("n_bytes"))


@query("fo08_storage_by_schema", f"WITH {SIZES} SELECT table_schema, count(*) AS n_tables, CAST(sum(n_bytes) AS BIGINT) AS n_bytes, round(sum(n_bytes) / 1073741824, 6) AS size_gb FROM st GROUP BY 1")
def _(t):
    return fo.storage_by_schema(_sizes(t))


@query("fo08_largest_tables", f"WITH {SIZES} SELECT * FROM st ORDER BY n_bytes DESC, table_schema, table_name LIMIT 20")
def _(t):
    return fo.largest_tables(_sizes(t))


@query("fo09_copy_cost", f"""WITH {SIZES}, g AS (SELECT count(*) AS n_tables, sum(n_bytes * 4096.0) / 1073741824 AS gb FROM st)
SELECT n_tables, round(gb, 2) AS size_gb, round(gb * 0.023, 2) AS storage_cost, round(greatest(1, gb / 10) * 2, 1) AS units, round(greatest(1, gb / 10) * 2 * 0.7, 2) AS compute_cost, round(greatest(1, gb / 50), 1) AS minutes FROM g""")
def _(t):
    return fo.copy_cost(_sizes(t).withColumn("n_bytes", F.col("n_bytes") * 4096.0))


@query("fo10_operation_metrics", f"""SELECT count(*) AS total_tables, count(*) FILTER (WHERE event_type <> 'error') AS successful, count(*) FILTER (WHERE event_type = 'error') AS failed, round(count(*) FILTER (WHERE event_type = 'error') * 100.0 / count(*), 2) AS failure_rate,
 round(count(*) / ({QTY} / 60), 2) AS tables_per_min, round({QTY} / count(*), 2) AS avg_seconds, CAST(sum(user_id) AS BIGINT) AS total_rows FROM events""")
def _(t):
    from tallyframe.common import exact_sum

    return fo.operation_metrics(t.events, F.col("event_type") != "error", "value", "user_id", exact_sum("value"))


@query("fo11_activity", """
SELECT CASE WHEN GROUPING(event_type) = 0 THEN 'event_type' WHEN GROUPING(usr) = 0 THEN 'usr' WHEN GROUPING(day) = 0 THEN 'day' WHEN GROUPING(hour) = 0 THEN 'hour' ELSE 'total' END AS dimension,
 CASE WHEN GROUPING(event_type) = 0 THEN event_type WHEN GROUPING(usr) = 0 THEN usr WHEN GROUPING(day) = 0 THEN day WHEN GROUPING(hour) = 0 THEN hour END AS member, count(*) AS n, count(*) FILTER (WHERE value < 100) AS succeeded, count(*) FILTER (WHERE event_type = 'error') AS failed
FROM (SELECT event_type, value, 'u' || (user_id % 40) AS usr, strftime(ts, '%Y-%m-%d') AS day, hour(ts)::VARCHAR AS hour FROM events) GROUP BY GROUPING SETS ((event_type), (usr), (day), (hour), ())""")
def _(t):
    return fo.activity(usage(t).withColumnRenamed("run_as", "usr"), ["event_type", "usr"], "ts", F.col("value") < 100, F.col("event_type") == "error")


@query("fo11_daily_activity", "SELECT strftime(d, '%Y-%m-%d') AS day, count(event_id) AS n FROM (SELECT unnest(generate_series(DATE '2024-01-27', DATE '2024-02-02', INTERVAL 1 DAY))::DATE AS d) LEFT JOIN events ON ts::DATE = d GROUP BY 1")
def _(t):
    return fo.daily_activity(t.events, "ts", "2024-02-02")


@query("fo11_week_over_week", "SELECT a AS this_week, b AS last_week, round((a - b) * 100.0 / b, 1) AS change_pct FROM (SELECT count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-22') AS a, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-22') AS b FROM events)")
def _(t):
    return fo.week_over_week(t.events, "ts", "2024-01-24 10:00:00")


@query("fo11_top_members", "SELECT CAST(user_id AS VARCHAR) AS member, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(t):
    return fo.top_members(t.events, "user_id")


@query("fo12_compare_operations", """
WITH o AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS failed, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1),
a AS (SELECT unnest(['n', 'failed', 'kinds']) AS field, unnest([n, failed, kinds])::VARCHAR AS v FROM o WHERE day = '2024-01-03'), b AS (SELECT unnest(['n', 'failed', 'kinds']) AS field, unnest([n, failed, kinds])::VARCHAR AS v FROM o WHERE day = '2024-01-04')
SELECT field, a.v AS old_value, b.v AS new_value FROM a FULL JOIN b USING (field) WHERE a.v IS DISTINCT FROM b.v""")
def _(t):
    o = t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_distinct("event_type").alias("kinds"))
    return fo.compare_operations(o, "day", "2024-01-03", "2024-01-04", ["n", "failed", "kinds"])


@query("fo13_rightsizing", f"WITH d AS ({UTIL}) SELECT warehouse AS subject, 'warning' AS severity FROM d GROUP BY 1 HAVING round(avg(avg_cpu_pct), 4) < 49 AND round(avg(avg_mem_pct), 4) < 25 UNION ALL SELECT user_id::VARCHAR, 'warning' FROM ({CONF}) WHERE warning = 'auto-stop disabled'")
def _(t):
    small = fo.rightsizing(_util(t), "warehouse", 49.0, 25.0).select(F.col("warehouse").alias("subject"), "severity")
    conf = _conf(t).where("warning = 'auto-stop disabled'").select(F.col("user_id").cast("string").alias("subject"), F.lit("warning").alias("severity"))
    return fo.recommendations(small, conf)


@query("fo14_event_timeline", "SELECT event_id, event_type FROM events WHERE event_type IN ('signup', 'purchase') ORDER BY ts DESC, event_id LIMIT 100")
def _(t):
    return fo.event_timeline(t.events, "event_type", ["signup", "purchase"], "ts", 100, "event_id").select("event_id", "event_type")


# ---- governance --------------------------------------------------------------------------------

OWNER = "CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'SPN-etl-' || c_custkey WHEN 2 THEN 'data-TEAM' WHEN 3 THEN 'ann' || c_custkey || '@x.com' WHEN 4 THEN '(none)' ELSE 'analysts' END"


def _owned(t):
    k = F.col("c_custkey")
    m = k % 6
    owner = F.when(m == 1, F.concat(F.lit("SPN-etl-"), k)).when(m == 2, "data-TEAM").when(m == 3, F.concat(F.lit("ann"), k, F.lit("@x.com"))).when(m == 4, "(none)").when(m == 5, "analysts")
    return t.customer.select("c_custkey", "c_mktsegment", owner.alias("owner"))


@query("gv01_owner_types", "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'missing' WHEN 1 THEN 'service_principal' WHEN 2 THEN 'group' WHEN 3 THEN 'user' WHEN 4 THEN 'missing' ELSE 'group' END AS owner_type FROM customer")
def _(t):
    return _owned(t).select("c_custkey", us.owner_type(F.col("owner")).alias("owner_type"))


@query("gv01_ownership_score", """SELECT count(*) AS total, count(*) FILTER (WHERE c_custkey % 6 IN (0, 4)) AS missing, count(*) FILTER (WHERE c_custkey % 6 = 3) AS user_owned,
 CAST(greatest(0, floor(100 - count(*) FILTER (WHERE c_custkey % 6 IN (0, 4)) / count(*) * 100 - count(*) FILTER (WHERE c_custkey % 6 = 3) / count(*) * 25)) AS BIGINT) AS score FROM customer""")
def _(t):
    return us.ownership_score(_owned(t), "owner")


@query("gv02_tag_coverage", "SELECT count(*) AS total_tables, count(*) FILTER (WHERE u) AS tagged, CAST(floor(count(*) FILTER (WHERE u) * 100.0 / count(*)) AS BIGINT) AS coverage_pct FROM (SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48) AS u FROM part)")
def _(t):
    return us.tag_coverage(t.part, t.lineitem.where("l_quantity > 48").withColumnRenamed("l_partkey", "p_partkey"), ["p_partkey"])


@query("gv03_pii_audit", """WITH f AS (SELECT 'c' || event_id AS column_name, CASE WHEN event_type = 'error' THEN 'SSN' ELSE 'EMAIL' END AS pii_type, event_id % 3 = 0 AS m FROM events)
SELECT count(*) AS pii_columns, count(*) FILTER (WHERE NOT m) AS unmasked, count(*) FILTER (WHERE NOT m AND pii_type = 'SSN') AS high_risk_unmasked, greatest(0, 100 - 5 * count(*)) AS detection_score,
 CAST(greatest(0, 100 - floor(count(*) FILTER (WHERE NOT m) / count(*) * 100)) AS BIGINT) AS masking_score, CASE WHEN count(*) FILTER (WHERE NOT m AND pii_type = 'SSN') > 0 THEN 0 ELSE 100 END AS high_risk_score FROM f""")
def _(t):
    c = F.concat(F.lit("c"), "event_id").alias("column_name")
    f = t.events.select(c, F.when(F.col("event_type") == "error", "SSN").otherwise("EMAIL").alias("pii_type"))
    masked = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("c"), "event_id")).otherwise(F.concat(F.lit("other"), "event_id"))
    return us.pii_audit(f, t.events.select(masked.alias("column_name")))


@query("gv04_overall_status", "SELECT CAST(floor(sum(s) / count(s)) AS BIGINT) AS score, CASE WHEN floor(sum(s) / count(s)) >= 80 THEN 'COMPLIANT' WHEN floor(sum(s) / count(s)) >= 50 THEN 'WARNING' ELSE 'NON_COMPLIANT' END AS status FROM (SELECT CAST(floor(count(*) FILTER (WHERE value < 80) * 100.0 / count(*)) AS BIGINT) AS s FROM events GROUP BY event_type)")
def _(t):
    return us.overall_status(t.events.groupBy("event_type").agg(F.floor(F.count_if(F.col("value") < 80) * 100.0 / F.count(F.lit(1))).alias("score")))


@query("gv05_metadata_search", "SELECT 'part' AS kind, p_partkey::VARCHAR AS name FROM part WHERE contains(lower(p_name), 'gear') OR contains(lower(p_type), 'gear') UNION ALL SELECT 'page', page_id::VARCHAR FROM pages WHERE contains(lower(url), 'gear') OR contains(lower(html), 'gear') UNION ALL SELECT 'document', doc_id::VARCHAR FROM documents WHERE contains(lower(text), 'gear')")
def _(t):
    return us.search_metadata({"part": (t.part, "p_partkey", ["p_name", "p_type"]), "page": (t.pages, "page_id", ["url", "html"]), "document": (t.documents, "doc_id", ["text"])}, "Gear")


@query("gv06_grant_audit", "SELECT count(*) AS grants, count(*) FILTER (WHERE n_nationkey % 9 = 4) AS broad_grants, greatest(0, 100 - 20 * count(*) FILTER (WHERE n_nationkey % 9 = 4)) AS score FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(t):
    g = t.customer.select(F.when(F.col("c_nationkey") % 9 == 4, "all privileges").otherwise("SELECT").alias("privilege"))
    return us.grant_audit(g, "privilege")


@query("gv07_size_policies", f"""WITH {SIZES}, s AS (SELECT table_schema || '.' || table_name AS table_name, n_bytes / 1000000.0 AS size_gb FROM st)
SELECT 'max_table_size_gb' AS policy, table_name AS subject FROM s WHERE size_gb > 0.05 UNION ALL SELECT 'max_total_size_gb', 'all' FROM s HAVING sum(size_gb) > 1 UNION ALL SELECT 'max_tables', 'all' FROM s HAVING count(*) > 10
UNION ALL SELECT 'blocked_tables_regex', table_name FROM s WHERE regexp_matches(table_name, 'src1$')""")
def _(t):
    s = _sizes(t).select(F.concat_ws(".", "table_schema", "table_name").alias("table_name"), (F.col("n_bytes") / 1000000.0).alias("size_gb"))
    return us.size_policies(s, 0.05, 1.0, 10, "src1$")
