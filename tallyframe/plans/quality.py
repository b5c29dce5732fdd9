"""Quality rules and checks over the given tables."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.common import new_scratch_path, spread_join, union_all
from tallyframe.functions import checks as C
from tallyframe.operators import checkset as cs
from tallyframe.operators import rules as ru
from tallyframe.operators.checkset import Check
from tallyframe.operators.rules import Rule
from tallyframe.plans.fixtures import check_runs, daily_metrics, orders_dest, with_ctes
from tallyframe.plans.registry import query

AS_OF = "2002-01-01 00:00:00"


def rule_sql(rule_id, table, kind, column, total, failures, source, severity="warning", threshold=0.0):
    return f"""SELECT '{rule_id}' AS rule_id, '{rule_id}' AS rule_name, '{table}' AS table_fqn, '{column}' AS column_name, '{kind}' AS rule_type,
 '{severity}' AS severity, total AS total_rows, failures AS failed_rows, round(failures / greatest(total, 1), 6) AS failure_rate,
 {threshold}::DOUBLE AS threshold, failures / greatest(total, 1) <= {threshold} AS passed
FROM (SELECT CAST({total} AS BIGINT) AS total, CAST({failures} AS BIGINT) AS failures FROM {source})"""


N = "count(*)"
NULLED = "(SELECT *, CASE WHEN l_quantity > 45 THEN NULL ELSE l_quantity END AS qty FROM lineitem)"


def _nulled(t):
    return t.lineitem.withColumn("qty", F.when(F.col("l_quantity") > 45, None).otherwise(F.col("l_quantity")))


@query("dq01_not_null", rule_sql("nn", "lineitem", "not_null", "qty", N, "count(*) FILTER (WHERE qty IS NULL)", NULLED, threshold=0.2))
def _(t):
    return ru.run_rules(_nulled(t), [Rule("nn", "not_null", "qty", threshold=0.2)], "lineitem")


@query("dq02_unique", rule_sql("u1", "orders", "unique", "o_orderkey", N, "count(*) - count(DISTINCT o_orderkey)", "orders")
       + " UNION ALL " + rule_sql("u2", "orders", "unique", "o_custkey", N, "count(*) - count(DISTINCT o_custkey)", "orders", "error", 0.5))
def _(t):
    return ru.run_rules(t.orders, [Rule("u1", "unique", "o_orderkey"), Rule("u2", "unique", "o_custkey", threshold=0.5, severity="error")], "orders")


@query("dq02_duplicate_groups", """
SELECT count(*) AS duplicate_groups, CAST(sum(n - 1) AS BIGINT) AS extra_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""")
def _(t):
    return ru.duplicate_group_violations(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("dq03_range", rule_sql("r1", "lineitem", "range", "l_discount", N, "count(*) FILTER (WHERE l_discount NOT BETWEEN 0.02 AND 0.08)", "lineitem")
       + " UNION ALL " + rule_sql("r2", "lineitem", "range", "l_tax", N, "count(*) FILTER (WHERE l_tax > 0.06)", "lineitem", "warning", 0.3))
def _(t):
    return ru.run_rules(t.lineitem, [Rule("r1", "range", "l_discount", {"min": 0.02, "max": 0.08}),
                                     Rule("r2", "range", "l_tax", {"max": 0.06}, 0.3)], "lineitem")


@query("dq04_regex", rule_sql("x1", "part", "regex", "p_brand", N, "count(*) FILTER (WHERE NOT regexp_matches(p_brand, '^Brand#[0-9]$'))", "part"))
def _(t):
    return ru.run_rules(t.part, [Rule("x1", "regex", "p_brand", {"pattern": "^Brand#[0-9]$"})], "part")


@query("dq05_freshness", rule_sql("f1", "orders", "freshness", "o_orderdate", "1", f"CASE WHEN date_diff('hour', max(o_orderdate), TIMESTAMP '{AS_OF}') > 24 THEN 1 ELSE 0 END", "orders"))
def _(t):
    return ru.run_rules(t.orders, [Rule("f1", "freshness", "o_orderdate", {"max_hours": 24})], "orders", as_of=AS_OF)


@query("dq06_row_count", rule_sql("c1", "events", "row_count", "", N, "CASE WHEN count(*) NOT BETWEEN 100 AND 5000 THEN 1 ELSE 0 END", "events"))
def _(t):
    return ru.run_rules(t.events, [Rule("c1", "row_count", params={"min": 100, "max": 5000})], "events")


@query("dq07_referential", rule_sql("ref", "lineitem", "referential", "l_partkey", N, "count(*) FILTER (WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 3))", "lineitem", "error", 0.01))
def _(t):
    return ru.run_rules(t.lineitem, [Rule("ref", "referential", "l_partkey", {"parent": "part", "parent_column": "p_partkey"}, 0.01, "error")],
                        "lineitem", {"part": t.part.where("p_size > 3")})


@query("dq07_orphan_values", """
SELECT count(DISTINCT o_custkey) AS orphan_values, count(*) AS orphan_rows FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def _(t):
    return ru.orphan_violations(t.orders, "o_custkey", t.customer.where("c_acctbal > 0"), "c_custkey")


@query("dq08_custom_sql", rule_sql("s1", "orders", "custom_sql", "", N, "count(*) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice > 450000)", "orders", threshold=0.1))
def _(t):
    sql = "SELECT count(*) AS total, count_if(o_orderstatus = 'F' AND o_totalprice > 450000) AS failures FROM {t}"
    return ru.run_rules(t.orders, [Rule("s1", "custom_sql", params={"sql": sql}, threshold=0.1)], "orders")


@query("dq09_rule_set", " UNION ALL ".join([
    rule_sql("a", "orders", "not_null", "o_custkey", N, "count(*) FILTER (WHERE o_custkey IS NULL)", "orders"),
    rule_sql("b", "orders", "range", "o_totalprice", N, "count(*) FILTER (WHERE o_totalprice < 1000 OR o_totalprice > 490000)", "orders", "error"),
    rule_sql("c", "orders", "regex", "o_orderpriority", N, "count(*) FILTER (WHERE NOT regexp_matches(o_orderpriority, '^[1-4]'))", "orders", "warning", 0.25),
    rule_sql("d", "orders", "row_count", "", N, "CASE WHEN count(*) < 10 THEN 1 ELSE 0 END", "orders"),
    rule_sql("e", "orders", "unique", "o_orderkey", N, "count(*) - count(DISTINCT o_orderkey)", "orders"),
    rule_sql("f", "orders", "referential", "o_custkey", N, "count(*) FILTER (WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))", "orders")]))
def _(t):
    rules = [Rule("a", "not_null", "o_custkey"), Rule("b", "range", "o_totalprice", {"min": 1000, "max": 490000}, severity="error"),
             Rule("c", "regex", "o_orderpriority", {"pattern": "^[1-4]"}, 0.25), Rule("d", "row_count", params={"min": 10}),
             Rule("e", "unique", "o_orderkey"), Rule("f", "referential", "o_custkey", {"parent": "customer", "parent_column": "c_custkey"})]
    return ru.run_rules(t.orders, rules, "orders", {"customer": t.customer})


@query("dq10_daily_history", with_ctes("check_runs") + """
SELECT executed_at AS day, table_fqn AS rule_id, count(*) FILTER (WHERE valid_rows / total_rows >= 0.95) AS passed,
 count(*) FILTER (WHERE valid_rows / total_rows < 0.95) AS failed, round(avg(1 - valid_rows / total_rows), 6) AS avg_failure_rate FROM check_runs GROUP BY 1, 2""")
def _(t):
    rate = F.col("valid_rows") / F.col("total_rows")
    return ru.daily_history(check_runs(t).select("executed_at", F.col("table_fqn").alias("rule_id"), (rate >= 0.95).alias("passed"), (1 - rate).alias("failure_rate")))


ORDER_CHECKS = [
    Check("price_range", "is_in_range", {"column": "o_totalprice", "min_limit": 5000, "max_limit": 480000}),
    Check("status_known", "is_in_list", {"column": "o_orderstatus", "allowed": ["O", "F"]}, "warn"),
    Check("urgent_price", "is_not_greater_than", {"column": "o_totalprice", "limit": 400000}, "error", "o_orderpriority = '1-URGENT'"),
    Check("old", "is_older_than_n_days", {"column": "o_orderdate", "days": 300, "as_of": AS_OF}, "warn"),
]
ERR = "(o_totalprice NOT BETWEEN 5000 AND 480000 OR (o_orderpriority = '1-URGENT' AND o_totalprice > 400000))"
WARN = "(o_orderstatus NOT IN ('O', 'F') OR date_diff('day', o_orderdate, TIMESTAMP '2002-01-01') <= 300)"


@query("dq11_split_valid", f"SELECT o_orderkey, NOT {ERR} AS valid FROM orders")
def _(t):
    good, bad = cs.split(cs.apply_checks(t.orders, ORDER_CHECKS))
    return good.select("o_orderkey", F.lit(True).alias("valid")).unionByName(bad.select("o_orderkey", F.lit(False).alias("valid")))


@query("dq11_split_written", f"SELECT count(*) FILTER (WHERE NOT {ERR}) AS valid_rows, count(*) FILTER (WHERE {ERR}) AS quarantined_rows FROM orders")
def _(t):
    good, bad = cs.split(cs.apply_checks(t.orders, ORDER_CHECKS))
    p = new_scratch_path(t.spark, "split")
    good.write.parquet(f"{p}/valid")
    bad.write.parquet(f"{p}/quarantine")
    n = lambda x: t.spark.read.parquet(f"{p}/{x}").agg(F.count(F.lit(1)).alias("n"))
    return n("valid").select(F.col("n").alias("valid_rows"), n("quarantine").scalar().alias("quarantined_rows"))


@query("dq12_criticality", f"""
SELECT 'orders' AS table_fqn, count(*) AS total_rows, count(*) FILTER (WHERE NOT {ERR}) AS valid_rows, count(*) FILTER (WHERE {ERR}) AS invalid_rows,
 count(*) FILTER (WHERE {ERR}) AS error_rows, count(*) FILTER (WHERE {WARN}) AS warning_rows,
 round(count(*) FILTER (WHERE NOT {ERR}) * 100.0 / count(*), 2) AS pass_rate, 4 AS checks_applied FROM orders""")
def _(t):
    return cs.summary(cs.apply_checks(t.orders, ORDER_CHECKS), "orders", len(ORDER_CHECKS))


@query("dq12_failures_per_check", """
SELECT 'price_range' AS check_name, count(*) AS failed_rows FROM orders WHERE o_totalprice NOT BETWEEN 5000 AND 480000 HAVING count(*) > 0
UNION ALL SELECT 'status_known', count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'F') HAVING count(*) > 0
UNION ALL SELECT 'urgent_price', count(*) FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000 HAVING count(*) > 0
UNION ALL SELECT 'old', count(*) FROM orders WHERE date_diff('day', o_orderdate, TIMESTAMP '2002-01-01') <= 300 HAVING count(*) > 0""")
def _(t):
    return cs.failure_counts(cs.apply_checks(t.orders, ORDER_CHECKS))


def _line(name, table, bad, warn, k):
    return f"""SELECT '{name}' AS table_fqn, count(*) AS total_rows, count(*) FILTER (WHERE NOT ({bad})) AS valid_rows, count(*) FILTER (WHERE {bad}) AS invalid_rows,
 count(*) FILTER (WHERE {bad}) AS error_rows, count(*) FILTER (WHERE {warn}) AS warning_rows, round(count(*) FILTER (WHERE NOT ({bad})) * 100.0 / count(*), 2) AS pass_rate,
 {k} AS checks_applied, round(count(*) FILTER (WHERE NOT ({bad})) * 100.0 / count(*), 2) >= 95 AS passed FROM {table}"""


@query("dq13_many_tables", " UNION ALL ".join([
    _line("orders", "orders", ERR, WARN, 4),
    _line("customer", "customer", "c_acctbal < -900 OR c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 4)", "false", 2),
    _line("part", "part", "p_size > 48", "false", 1)]))
def _(t):
    return cs.run_tables({
        "orders": (t.orders, ORDER_CHECKS),
        "customer": (t.customer, [Check("bal", "is_not_less_than", {"column": "c_acctbal", "limit": -900}),
                                  Check("nation", "foreign_key", {"column": "c_nationkey", "ref": "nation", "ref_column": "n_nationkey"})]),
        "part": (t.part, [Check("size", "is_not_greater_than", {"column": "p_size", "limit": 48})]),
    }, {"nation": t.nation.where("n_regionkey < 4")})


@query("dq14_dashboard", with_ctes("check_runs") + """, last AS (SELECT * FROM check_runs c WHERE executed_at = (SELECT max(executed_at) FROM check_runs d WHERE d.table_fqn = c.table_fqn))
SELECT table_fqn, executed_at, run_id, total_rows, valid_rows, round(valid_rows * 100.0 / total_rows, 2) AS pass_rate,
 (SELECT round(sum(valid_rows) * 100.0 / sum(total_rows), 2) FROM last) AS overall_pass_rate FROM last""")
def _(t):
    return cs.dashboard(check_runs(t))


YAML = """
- name: qty
  criticality: error
  check: {function: is_in_range, arguments: {column: l_quantity, min_limit: 2, max_limit: 49}}
- name: flag
  criticality: warn
  filter: l_linestatus = 'O'
  check: {function: is_in_list, arguments: {column: l_returnflag, allowed: [A, N]}}
"""


@query("dq15_checks_as_data", """
SELECT 'qty' AS check_name, count(*) AS failed_rows FROM lineitem WHERE l_quantity NOT BETWEEN 2 AND 49
UNION ALL SELECT 'flag', count(*) FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag NOT IN ('A', 'N')""")
def _(t):
    text = cs.checks_to_yaml(cs.checks_from_yaml(YAML))
    return cs.failure_counts(cs.apply_checks(t.lineitem, cs.checks_from_yaml(text)))


@query("dq16_suite", with_ctes("orders_dest", "daily_metrics") + f""", u AS (
SELECT 'freshness' AS check_type, 'orders' AS check_id, date_diff('hour', max(o_orderdate), TIMESTAMP '{AS_OF}') <= 24 AS passed FROM orders
UNION ALL SELECT 'dq_rule', 'price', count(*) FILTER (WHERE o_totalprice < 0) = 0 FROM orders
UNION ALL SELECT 'dqx_check', 'price_range', count(*) FILTER (WHERE {ERR}) * 100.0 / count(*) <= 5 FROM orders
UNION ALL SELECT 'reconciliation', 'orders', (SELECT count(*) FROM orders) = (SELECT count(*) FROM orders_dest)
UNION ALL SELECT 'anomaly', 'row_count', count(*) = 0 FROM (SELECT value, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s, count(*) OVER w AS n FROM daily_metrics
  WINDOW w AS (PARTITION BY table_fqn, metric_name ORDER BY measured_at ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)) WHERE n >= 3 AND s > 0 AND abs(value - m) / s > 3
UNION ALL SELECT 'unknown', 'none', NULL)
SELECT check_type, check_id, CASE WHEN passed IS NULL THEN 'skip' WHEN passed THEN 'pass' ELSE 'fail' END AS status,
 CASE WHEN (SELECT count(*) FROM u WHERE NOT passed) = 0 THEN 'pass' ELSE 'fail' END AS overall_status FROM u""")
def _(t):
    from tallyframe.operators.anomaly import score_metrics

    def outcome(df, kind, name, passed):
        return df.select(F.lit(kind).alias("check_type"), F.lit(name).alias("check_id"), passed.alias("passed"))

    fresh = ru.run_rules(t.orders, [Rule("f", "freshness", "o_orderdate", {"max_hours": 24}), Rule("p", "range", "o_totalprice", {"min": 0})], as_of=AS_OF)
    checked = cs.summary(cs.apply_checks(t.orders, ORDER_CHECKS), "orders", 4)
    both = t.orders.agg(F.count(F.lit(1)).alias("a"), F.lit(0).alias("z")).withColumn("b", orders_dest(t).agg(F.count(F.lit(1)).alias("b")).scalar())
    crit = score_metrics(daily_metrics(t), ["table_fqn", "metric_name"], "measured_at", "value").where("severity = 'critical'").agg(F.count(F.lit(1)).alias("n"))
    return cs.suite([
        outcome(fresh.where("rule_id = 'f'"), "freshness", "orders", F.col("passed")),
        outcome(fresh.where("rule_id = 'p'"), "dq_rule", "price", F.col("passed")),
        outcome(checked, "dqx_check", "price_range", F.col("pass_rate") >= 95),
        outcome(both, "reconciliation", "orders", F.col("a") == F.col("b")),
        outcome(crit, "anomaly", "row_count", F.col("n") == 0),
        outcome(t.spark.range(1), "unknown", "none", F.lit(None).cast("boolean"))])


@query("dq17_expectation_events", """
SELECT event_id, event_type, user_id FROM events WHERE event_type IN ('error', 'signup') AND user_id % 10 = 3 AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'""")
def _(t):
    from tallyframe.operators.health import event_listing

    return event_listing(t.events, "event_type", ["error", "signup"], "ts", "2024-01-10", "2024-01-20", F.col("user_id") % 10 == 3).select("event_id", "event_type", "user_id")


# ---- the check catalog -------------------------------------------------------------------------


def counts_sql(table, conds, pre=""):
    return pre + " UNION ALL ".join(
        f"SELECT '{n}' AS check_name, count(*) FILTER (WHERE {c}) AS failed_rows, count(*) AS total_rows FROM {table}" for n, c in conds.items())


SPARSE = "(SELECT *, CASE WHEN user_id % 7 = 0 THEN NULL WHEN user_id % 7 = 1 THEN '' ELSE event_type END AS kind FROM events)"


def _sparse(t):
    u = F.col("user_id") % 7
    return t.events.withColumn("kind", F.when(u == 0, None).when(u == 1, "").otherwise(F.col("event_type")))


@query("ck01_null", counts_sql(SPARSE, {"is_not_null": "kind IS NULL", "is_null": "kind IS NOT NULL"}))
def _(t):
    return cs.flag_counts(_sparse(t), {"is_not_null": C.is_not_null("kind"), "is_null": C.is_null("kind")})


@query("ck02_empty", counts_sql(SPARSE, {"is_not_empty": "kind = ''", "is_empty": "kind <> ''"}))
def _(t):
    return cs.flag_counts(_sparse(t), {"is_not_empty": C.is_not_empty("kind"), "is_empty": C.is_empty("kind")})


@query("ck03_null_or_empty", counts_sql(SPARSE, {"is_not_null_and_not_empty": "kind IS NULL OR kind = ''", "is_null_or_empty": "kind <> ''"}))
def _(t):
    return cs.flag_counts(_sparse(t), {"is_not_null_and_not_empty": C.is_not_null_and_not_empty("kind"), "is_null_or_empty": C.is_null_or_empty("kind")})


@query("ck04_empty_array", """
SELECT 'is_not_null_and_not_empty_array' AS check_name, count(*) FILTER (WHERE label IS NULL OR label % 3 = 0 OR label % 3 = 1 AND len(embedding) = 0) AS failed_rows, count(*) AS total_rows FROM embeddings""")
def _(t):
    lab = F.col("label") % 3
    df = t.embeddings.withColumn("a", F.when(lab == 0, F.filter("embedding", lambda x: F.lit(False))).otherwise(F.col("embedding")))
    return cs.flag_counts(df, {"is_not_null_and_not_empty_array": C.is_not_null_and_not_empty_array("a")})


@query("ck05_lists", counts_sql(SPARSE, {"is_in_list": "kind NOT IN ('click', 'view')", "is_not_in_list": "kind IN ('error')", "is_not_null_and_is_in_list": "kind IS NULL OR kind NOT IN ('click', 'view', '')"}))
def _(t):
    return cs.flag_counts(_sparse(t), {"is_in_list": C.is_in_list("kind", ["click", "view"]), "is_not_in_list": C.is_not_in_list("kind", ["error"]),
                                       "is_not_null_and_is_in_list": C.is_not_null_and_is_in_list("kind", ["click", "view", ""])})


@query("ck06_equal", counts_sql("lineitem", {"is_equal_to": "l_returnflag <> 'N'", "is_not_equal_to": "l_quantity = 7"}))
def _(t):
    return cs.flag_counts(t.lineitem, {"is_equal_to": C.is_equal_to("l_returnflag", "N"), "is_not_equal_to": C.is_not_equal_to("l_quantity", 7)})


@query("ck07_range", counts_sql("lineitem", {"is_in_range": "l_quantity NOT BETWEEN 5 AND 40", "is_not_in_range": "l_discount BETWEEN 0.03 AND 0.05"}))
def _(t):
    return cs.flag_counts(t.lineitem, {"is_in_range": C.is_in_range("l_quantity", 5, 40), "is_not_in_range": C.is_not_in_range("l_discount", 0.03, 0.05)})


@query("ck08_limits", counts_sql("lineitem", {"is_not_less_than": "l_extendedprice < 5000", "is_not_greater_than": "l_shipdate > TIMESTAMP '2001-06-01'"}))
def _(t):
    lim = F.lit("2001-06-01").cast("timestamp_ntz")
    return cs.flag_counts(t.lineitem, {"is_not_less_than": C.is_not_less_than("l_extendedprice", 5000), "is_not_greater_than": C.is_not_greater_than("l_shipdate", lim)})


@query("ck09_regex", counts_sql("pages", {"url": "NOT regexp_matches(url, '^https://')", "no_query": "regexp_matches(url, '[?]page=[0-9]+')"}))
def _(t):
    return cs.flag_counts(t.pages, {"url": C.regex_match("url", "^https://"), "no_query": C.regex_match("url", "[?]page=[0-9]+", negate=True)})


DATES = "(SELECT *, (2000 + o_orderkey % 5) || '-' || lpad((o_orderkey % 14)::VARCHAR, 2, '0') || '-' || lpad((o_orderkey % 33)::VARCHAR, 2, '0') AS d FROM orders)"


@query("ck10_valid_dates", counts_sql(DATES, {"is_valid_date": "try_cast(d AS DATE) IS NULL", "is_valid_timestamp": "try_cast(d || ' 10:00:00' AS TIMESTAMP) IS NULL",
                                              "is_valid_date_format": "try_strptime(replace(d, '-', '/'), '%Y/%m/%d') IS NULL"}))
def _(t):
    k = F.col("o_orderkey")
    df = t.orders.withColumn("d", F.concat_ws("-", (2000 + k % 5).cast("string"), F.lpad((k % 14).cast("string"), 2, "0"), F.lpad((k % 33).cast("string"), 2, "0")))
    df = df.withColumn("ts", F.concat("d", F.lit(" 10:00:00"))).withColumn("s", F.replace("d", F.lit("-"), F.lit("/")))
    return cs.flag_counts(df, {"is_valid_date": C.is_valid_date("d"), "is_valid_timestamp": C.is_valid_timestamp("ts"), "is_valid_date_format": C.is_valid_date("s", "yyyy/MM/dd")})


BROKEN = "(SELECT *, CASE WHEN event_id % 9 = 0 THEN substr(props, 1, length(props) - 1) WHEN event_id % 9 = 1 THEN '{\"z\": 1}' ELSE props END AS js FROM events)"


def _broken(t):
    e, p = F.col("event_id") % 9, F.col("props")
    return t.events.withColumn("js", F.when(e == 0, F.left(p, F.length(p) - 1)).when(e == 1, '{"z": 1}').otherwise(p))


@query("ck11_json", counts_sql(BROKEN, {"is_valid_json": "NOT json_valid(js)", "has_json_keys": "CASE WHEN json_valid(js) THEN NOT list_contains(json_keys(js), 'k') ELSE true END"}))
def _(t):
    return cs.flag_counts(_broken(t), {"is_valid_json": C.is_valid_json("js"), "has_json_keys": C.has_json_keys("js", ["k"])})


@query("ck12_json_schema", counts_sql("(SELECT *, CASE WHEN event_id % 9 = 0 THEN '{\"k\": \"x\"}' WHEN event_id % 9 = 1 THEN '{\"k\": ' ELSE props END AS js FROM events)",
                                      {"has_valid_json_schema": "event_id % 9 IN (0, 1)"}))
def _(t):
    e = F.col("event_id") % 9
    df = t.events.withColumn("js", F.when(e == 0, '{"k": "x"}').when(e == 1, '{"k": ').otherwise(F.col("props")))
    return cs.flag_counts(df, {"has_valid_json_schema": C.has_valid_json_schema("js", "k bigint")})


IPS = "(SELECT *, (event_id % 300) || '.' || (user_id % 256) || '.' || (event_id % 11) || '.' || (CASE WHEN event_id % 13 = 0 THEN '07' ELSE (event_id % 256)::VARCHAR END) AS ip FROM events)"
OKIP = "(event_id % 300 < 256 AND event_id % 13 <> 0)"


def _ips(t):
    e, u, s = F.col("event_id"), F.col("user_id"), lambda c: c.cast("string")
    last = F.when(e % 13 == 0, "07").otherwise(s(e % 256))
    return t.events.withColumn("ip", F.concat_ws(".", s(e % 300), s(u % 256), s(e % 11), last)).withColumn(
        "ip6", F.concat(F.lit("2001:db8:"), F.lower(F.hex(u)), F.when(e % 5 == 0, "::").when(e % 5 == 1, ":0:0:0:0:").when(e % 5 == 2, ":::").otherwise("::1:"),
                        F.lower(F.hex(e % 70000))))


@query("ck13_ip_addresses", counts_sql(IPS, {"is_valid_ipv4_address": f"NOT {OKIP}", "is_valid_ipv6_address": "event_id % 5 = 2 OR event_id % 70000 > 65535"}))
def _(t):
    return cs.flag_counts(_ips(t), {"is_valid_ipv4_address": C.is_valid_ipv4_address("ip"), "is_valid_ipv6_address": C.is_valid_ipv6_address("ip6")})


@query("ck14_ipv4_cidr", counts_sql(IPS, {"in_16": f"NOT ({OKIP} AND event_id % 300 = 10 AND user_id % 256 = 4)", "in_5": f"NOT ({OKIP} AND event_id % 300 BETWEEN 8 AND 15)"}))
def _(t):
    return cs.flag_counts(_ips(t), {"in_16": C.is_ipv4_address_in_cidr("ip", "10.4.0.0/16"), "in_5": C.is_ipv4_address_in_cidr("ip", "8.0.0.0/5")})


@query("ck15_ipv6_cidr", counts_sql("events", {"in_42": "event_id % 5 = 2 OR user_id >= 64", "in_128": "NOT (event_id % 5 IN (0, 1) AND event_id = 5 AND user_id = -1)"}))
def _(t):
    return cs.flag_counts(_ips(t), {"in_42": C.is_ipv6_address_in_cidr("ip6", "2001:db8::/42"), "in_128": C.is_ipv6_address_in_cidr("ip6", "2001:db8:ffff::5/128")})


EV = "TIMESTAMP '2024-01-20 00:00:00'"


@query("ck16_future", counts_sql("events", {"is_not_in_future": f"ts > {EV}", "is_not_in_near_future": f"ts > {EV} AND ts < {EV} + INTERVAL 1 DAY"}))
def _(t):
    return cs.flag_counts(t.events, {"is_not_in_future": C.is_not_in_future("ts", "2024-01-20"), "is_not_in_near_future": C.is_not_in_near_future("ts", "2024-01-20", 86400)})


@query("ck17_older_than", counts_sql("(SELECT l_shipdate, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey)", {
    "is_older_than_n_days": "date_diff('day', l_shipdate, TIMESTAMP '2002-01-01') <= 400", "is_older_than_col2_for_n_days": "date_diff('day', o_orderdate, l_shipdate) < 30"}))
def _(t):
    df = spread_join(t.lineitem.select("l_orderkey", "l_shipdate"), t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), ["l_orderkey"])
    return cs.flag_counts(df, {"is_older_than_n_days": C.is_older_than_n_days("l_shipdate", 400, "2002-01-01"),
                               "is_older_than_col2_for_n_days": C.is_older_than_col2_for_n_days("o_orderdate", "l_shipdate", 30)})


@query("ck18_data_fresh", counts_sql("events", {"is_data_fresh": f"ts < {EV} - INTERVAL 90 MINUTE"}))
def _(t):
    return cs.flag_counts(t.events, {"is_data_fresh": C.is_data_fresh("ts", 90, "2024-01-20")})


@query("ck19_no_pii", counts_sql("documents", {
    "email": r"regexp_matches(text, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-]+')",
    "ssn_or_phone": r"regexp_matches(text, '[0-9]{3}-[0-9]{2}-[0-9]{4}') OR regexp_matches(text, '\+?[0-9][0-9 ()-]{6,13}[0-9]')"}))
def _(t):
    return cs.flag_counts(t.documents, {"email": C.does_not_contain_pii("text", ["EMAIL"]), "ssn_or_phone": C.does_not_contain_pii("text", ["SSN", "PHONE"])})


@query("ck20_sql_expression", counts_sql("lineitem", {"discounted": "NOT (l_extendedprice * (1 - l_discount) > 1500)", "negated": "l_tax > l_discount"}))
def _(t):
    return cs.flag_counts(t.lineitem, {"discounted": C.sql_expression("l_extendedprice * (1 - l_discount) > 1500"), "negated": C.sql_expression("l_tax > l_discount", negate=True)})


@query("ck21_is_unique", "SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type, value) > 1 AS failed FROM events")
def _(t):
    return cs.mark_unique(t.events, ["user_id", "event_type", "value"], "failed").select("event_id", "failed")


@query("ck22_foreign_key", "SELECT l_orderkey, l_linenumber, l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey > 4) AS failed FROM lineitem")
def _(t):
    return cs.mark_foreign_key(t.lineitem, "l_suppkey", t.supplier.where("s_nationkey > 4"), "s_suppkey", "failed").select("l_orderkey", "l_linenumber", "failed")


@query("ck23_valid_schema", """
SELECT 'o_custkey' AS column_name, 'type' AS problem, (SELECT count(*) FROM orders) AS n_rows UNION ALL SELECT 'o_channel', 'missing', (SELECT count(*) FROM orders)
UNION ALL SELECT c, 'unexpected', (SELECT count(*) FROM orders) FROM (VALUES ('o_orderdate'), ('o_orderpriority'), ('o_totalprice')) v(c)""")
def _(t):
    want = T.StructType.fromDDL("o_orderkey bigint, o_custkey int, o_orderstatus string, o_channel string")
    return cs.schema_problems(t.orders, want, strict=True).select("column_name", "problem", t.orders.agg(F.count(F.lit(1)).alias("n")).scalar().alias("n_rows"))


@query("ck24_no_outliers", """
SELECT event_id, abs(value - m) > 3 * d AS failed FROM events, (SELECT median(value) AS m FROM events),
 (SELECT median(abs(value - (SELECT median(value) FROM events))) AS d FROM events)""")
def _(t):
    return cs.mark_outliers(t.events, "value", "failed").select("event_id", "failed")


@query("ck25_compare_datasets", with_ctes("orders_dest") + """
SELECT coalesce(s.o_orderkey, d.o_orderkey) AS o_orderkey, CASE WHEN d.o_orderkey IS NULL THEN 'missing_in_dest' WHEN s.o_orderkey IS NULL THEN 'extra_in_dest' ELSE 'modified' END AS status
FROM orders s FULL JOIN orders_dest d ON s.o_orderkey = d.o_orderkey
WHERE s.o_orderstatus IS DISTINCT FROM d.o_orderstatus OR s.o_totalprice IS DISTINCT FROM d.o_totalprice""")
def _(t):
    from tallyframe.operators.reconcile import key_status

    return key_status(t.orders, orders_dest(t), ["o_orderkey"]).where("status <> 'matched'").select("o_orderkey", "status")


@query("ck26_sql_query", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15")
def _(t):
    return cs.query_condition(t.orders, "SELECT o_custkey, count(*) AS n, count(*) > 15 AS bad FROM {df} GROUP BY o_custkey", "bad").drop("bad")


WINDOWS = """
WITH w AS (SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS window_start, count(*) AS n FROM events GROUP BY 1),
s AS (SELECT unnest(generate_series(min(window_start), max(window_start), INTERVAL 10 MINUTE)) AS window_start FROM w)
SELECT strftime(window_start, '%Y-%m-%d %H:%M') AS window_start, coalesce(n, 0) AS n_rows, coalesce(n, 0) < 2 AS failed FROM s LEFT JOIN w USING (window_start)"""


@query("ck27_fresh_per_window", WINDOWS)
def _(t):
    return cs.window_counts(t.events, "ts", 10, 2).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


@query("ck28_aggregates", """
SELECT 'is_aggr_not_greater_than' AS check_name, p_brand AS grp, count(*)::DOUBLE AS value, count(*) > 80 AS failed FROM part GROUP BY 2
UNION ALL SELECT 'is_aggr_not_less_than', p_type, min(p_size)::DOUBLE, min(p_size) < 1 FROM part GROUP BY 2
UNION ALL SELECT 'is_aggr_equal', 'all', max(p_size)::DOUBLE, max(p_size) <> 50 FROM part
UNION ALL SELECT 'is_aggr_not_equal', 'all', sum(p_size)::DOUBLE, sum(p_size) = 1 FROM part""")
def _(t):
    def part(test, limit, kind, column=None, group=None):
        out = cs.aggregate_check(t.part, test, limit, kind, column, [group] if group else [])
        return out.select(F.lit(test).alias("check_name"), (F.col(group) if group else F.lit("all")).alias("grp"), F.col("value").cast("double").alias("value"), "failed")

    return union_all([part("is_aggr_not_greater_than", 80, "count", None, "p_brand"), part("is_aggr_not_less_than", 1, "min", "p_size", "p_type"),
                      part("is_aggr_equal", 50, "max", "p_size"), part("is_aggr_not_equal", 1, "sum", "p_size")])


PLACES = "(SELECT *, (event_id % 200) - 100 AS lat, (user_id * 3 % 400) - 200 AS lon FROM events)"


def _places(t):
    return t.events.withColumn("lat", F.col("event_id") % 200 - 100).withColumn("lon", F.col("user_id") * 3 % 400 - 200)


@query("ck29_lat_lon", counts_sql(PLACES, {"is_latitude": "lat NOT BETWEEN -90 AND 90", "is_longitude": "lon NOT BETWEEN -180 AND 180"}))
def _(t):
    return cs.flag_counts(_places(t), {"is_latitude": C.is_latitude("lat"), "is_longitude": C.is_longitude("lon")})


@query("ck30_null_island", counts_sql("(SELECT (event_id % 3) AS lat, (user_id % 4) AS lon FROM events)", {"is_not_null_island": "lat = 0 AND lon = 0"}))
def _(t):
    df = t.events.select((F.col("event_id") % 3).alias("lat"), (F.col("user_id") % 4).alias("lon"))
    return cs.flag_counts(df, {"is_not_null_island": C.is_not_null_island("lat", "lon")})


@query("ck31_geometry", counts_sql(PLACES, {
    "is_point": "event_id % 6 NOT IN (0, 4)", "is_linestring": "event_id % 6 <> 1", "is_polygon": "event_id % 6 <> 2", "is_geometry": "event_id % 6 IN (3, 5)",
    "is_geography": "event_id % 6 IN (3, 5) OR (event_id % 6 IN (0, 1) AND (abs(lat) > 90 OR abs(lon) > 180))", "is_non_empty_geometry": "event_id % 6 IN (3, 4, 5)"}))
def _(t):
    e, p = F.col("event_id") % 6, F.concat_ws(" ", F.col("lon").cast("string"), F.col("lat").cast("string"))
    wkt = (F.when(e == 0, F.concat(F.lit("POINT ("), p, F.lit(")"))).when(e == 1, F.concat(F.lit("LINESTRING (0 0, "), p, F.lit(")")))
           .when(e == 2, "POLYGON ((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1))").when(e == 3, F.concat(F.lit("POINT "), p)).when(e == 4, "POINT EMPTY").otherwise("LINESTRING 1 2"))
    df = _places(t).withColumn("w", wkt)
    return cs.flag_counts(df, {f.__name__: f("w") for f in (C.is_point, C.is_linestring, C.is_polygon, C.is_geometry, C.is_geography, C.is_non_empty_geometry)})
