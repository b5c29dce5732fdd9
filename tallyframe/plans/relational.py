"""Projections, predicates, joins, aggregates, windows, sorting, set operations, scalar functions."""

from pyspark.sql import functions as F

from tallyframe.common import dealt_by_key, exact_percentiles, exact_sum, spread_join, union_all
from tallyframe.operators import relational as r
from tallyframe.operators.reconcile import rows_only_in, shared_columns
from tallyframe.plans.fixtures import column_inventory, daily_metrics, orders_dest, prices, query_log, with_ctes
from tallyframe.plans.registry import query
from tallyframe.sources.tables import add_ingestion_columns

DEC = "CAST(sum(CAST({} AS DECIMAL(28,4))) AS DOUBLE)"

# ---- projections and predicates ----------------------------------------------------------------


@query("pj01_column_lists", "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders")
def _(t):
    cols = shared_columns(t.orders, orders_dest(t), include=["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"],
                          exclude=["o_totalprice"])
    return t.orders.select(*cols)


@query("pj02_all_except", "SELECT * EXCLUDE (l_tax, l_discount) FROM lineitem")
def _(t):
    return t.lineitem.drop("l_tax", "l_discount")


@query("pj03_replace_column", "SELECT p_partkey, upper(p_name) AS part_name, p_size * 2 AS p_size FROM part")
def _(t):
    return t.part.select("p_partkey", "p_name", "p_size").withColumnRenamed("p_name", "part_name").withColumns(
        {"part_name": F.upper("part_name"), "p_size": F.col("p_size") * 2})


@query("pj04_ingestion_columns", """
SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_ids, CAST(1 AS BIGINT) AS n_files, count(*) AS n_stamped FROM orders""")
def _(t):
    df = add_ingestion_columns(t.orders, F.input_file_name(), F.current_timestamp())
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("_raw_id").alias("n_ids"),
                  F.count_distinct("_source_file").alias("n_files"), F.count("_ingested_at").alias("n_stamped"))


@query("pf01_predicates", """
SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice < 100000) OR (o_orderpriority IN ('1-URGENT', '2-HIGH')
  AND o_totalprice BETWEEN 300000 AND 400000) OR (o_custkey > 1400 AND o_totalprice NOT BETWEEN 50000 AND 450000) OR o_orderdate IS NULL""")
def _(t):
    p = F.col("o_totalprice")
    return t.orders.where(
        ((F.col("o_orderstatus") == "F") & (p < 100000)) | (F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & p.between(300000, 400000))
        | ((F.col("o_custkey") > 1400) & ~p.between(50000, 450000)) | F.col("o_orderdate").isNull()).select("o_orderkey")


@query("pf02_contains_any", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'promo')")
def _(t):
    return r.search_text(t.part, ["p_name", "p_type"], "RING").unionByName(
        r.search_text(t.part, ["p_name", "p_type"], "Promo")).select("p_partkey", "p_name").distinct()


@query("pf03_rlike", "SELECT doc_id FROM documents WHERE regexp_matches(text, '[0-9]{3}-[0-9]{4}')")
def _(t):
    return t.documents.where(F.col("text").rlike("[0-9]{3}-[0-9]{4}")).select("doc_id")


@query("pf04_row_filter", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def _(t):
    return r.row_filter(t.customer, "c_mktsegment", ["BUILDING", "MACHINERY"]).select("c_custkey", "c_mktsegment")


@query("pf05_required_tags", """
SELECT user_id, count(*) AS n FROM events WHERE user_id IN
 (SELECT user_id FROM events WHERE value > 100 AND event_type IN ('click', 'purchase', 'signup') GROUP BY 1 HAVING count(DISTINCT event_type) = 3) GROUP BY 1""")
def _(t):
    tags = t.events.select("user_id", F.when(F.col("value") > 100, F.col("event_type")).otherwise(F.concat(F.lit("low_"), "event_type")).alias("tag"))
    users = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return r.with_all_tags(users, tags, "user_id", ["click", "purchase", "signup"])


# ---- joins -------------------------------------------------------------------------------------


@query("jn01_inner_join", "SELECT s.o_orderkey, s.o_totalprice AS source_price, d.o_totalprice AS dest_price FROM orders s JOIN orders d USING (o_orderkey, o_custkey)")
def _(t):
    s = t.orders.select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("source_price"))
    d = t.orders.select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("dest_price"))
    return spread_join(s, d, ["o_orderkey", "o_custkey"]).select("o_orderkey", "source_price", "dest_price")


@query("jn02_anti_both_ways", with_ctes("orders_dest") + """
SELECT o_orderkey, 'missing' AS side FROM orders ANTI JOIN orders_dest USING (o_orderkey)
UNION ALL SELECT o_orderkey, 'extra' FROM orders_dest ANTI JOIN orders USING (o_orderkey)""")
def _(t):
    a, b = dealt_by_key([t.orders.select("o_orderkey"), orders_dest(t).select("o_orderkey")], ["o_orderkey"])
    return spread_join(a, b.distinct(), ["o_orderkey"], "left_anti", no_broadcast=True).withColumn("side", F.lit("missing")).unionByName(
        spread_join(b, a.distinct(), ["o_orderkey"], "left_anti", no_broadcast=True).withColumn("side", F.lit("extra")))


@query("jn03_anti_on_row_hash", with_ctes("orders_dest") + """
SELECT s.* FROM orders s ANTI JOIN orders_dest d USING (o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority)""")
def _(t):
    return rows_only_in(t.orders, orders_dest(t))


@query("jn04_orphan_values", """
SELECT l_partkey, count(*) AS n_rows FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5) GROUP BY 1""")
def _(t):
    return r.orphans(t.lineitem, "l_partkey", t.part.where("p_size > 5"), "p_partkey")


@query("jn05_left_join", """
SELECT c_custkey, c_name, count(o_orderkey) AS n_orders, count(DISTINCT n_name) AS n_nations FROM customer LEFT JOIN orders ON o_custkey = c_custkey
LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3 GROUP BY 1, 2""")
def _(t):
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    n = t.nation.where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), F.lit(1).cast("long").alias("hit"))
    return t.customer.join(o, "c_custkey", "left").join(n, "c_nationkey", "left").select(
        "c_custkey", "c_name", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.coalesce("hit", F.lit(0)).alias("n_nations"))


@query("jn06_interval_join", with_ctes("prices") + """
SELECT e.event_id, e.event_type, p.price FROM events e LEFT JOIN prices p ON e.event_type = p.event_type
 AND p.price_start <= e.ts AND (p.price_end IS NULL OR e.ts < p.price_end)""")
def _(t):
    return r.interval_join(t.events.select("event_id", "event_type", "ts"), prices(t), ["event_type"], "ts", "price_start",
                           "price_end").select("event_id", "event_type", "price")


@query("jn07_latest_rows", "SELECT user_id, event_id FROM events e WHERE ts = (SELECT max(ts) FROM events f WHERE f.user_id = e.user_id)")
def _(t):
    return r.latest_rows(t.events.select("user_id", "event_id", "ts"), ["user_id"], "ts").select("user_id", "event_id")


@query("jn08_against_statistics", """
SELECT event_id, round((value - m) / s, 6) AS z FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) WHERE (value - m) / s > 2""")
def _(t):
    st = t.events.agg(F.avg("value").alias("m"), F.stddev("value").alias("s"))
    z = (F.col("value") - st.select("m").scalar()) / st.select("s").scalar()
    return t.events.select("event_id", F.round(z, 6).alias("z")).where("z > 2")


@query("jn09_not_in", """
SELECT 'faithful' AS mode, count(*) AS total, CAST(coalesce(sum(CASE WHEN l_suppkey NOT IN (SELECT CASE WHEN s_acctbal > 0 THEN s_suppkey END FROM supplier) THEN 1 ELSE 0 END), 0) AS BIGINT) AS failures FROM lineitem
UNION ALL SELECT 'null_safe', count(*), CAST(sum(CASE WHEN l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) THEN 1 ELSE 0 END) AS BIGINT) FROM lineitem""")
def _(t):
    parent = t.supplier.select(F.when(F.col("s_acctbal") > 0, F.col("s_suppkey")).alias("s_suppkey"))
    return union_all([r.not_in_failures(t.lineitem, "l_suppkey", parent, "s_suppkey", safe).withColumn("mode", F.lit(name))
                      for name, safe in (("faithful", False), ("null_safe", True))]).select("mode", "total", "failures")


@query("jn10_correlated_latest", with_ctes("check_runs") + """
SELECT table_fqn, executed_at, valid_rows FROM check_runs c WHERE executed_at = (SELECT max(executed_at) FROM check_runs d WHERE d.table_fqn = c.table_fqn)""")
def _(t):
    from tallyframe.plans.fixtures import check_runs

    return r.latest_rows(check_runs(t), ["table_fqn"], "executed_at").select("table_fqn", "executed_at", "valid_rows")


@query("jn12_keyed_set_changes", with_ctes("inventory_1", "inventory_2") + """
SELECT table_name, column_name, a.data_type AS data_type_before, b.data_type AS data_type_after,
 CASE WHEN a.table_name IS NULL THEN 'new' WHEN b.table_name IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM inventory_1 a FULL JOIN inventory_2 b USING (table_name, column_name) WHERE a.data_type IS DISTINCT FROM b.data_type""")
def _(t):
    return r.key_set_changes(column_inventory(t, 1), column_inventory(t, 2), ["table_name", "column_name"], ["data_type"])


@query("jn13_membership", """
SELECT p_partkey, 'used' AS status FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)
UNION ALL SELECT p_partkey, 'unused' FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)""")
def _(t):
    used = t.lineitem.where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return r.presence(t.part.select("p_partkey"), used, ["p_partkey"]).select(
        "p_partkey", F.when(F.col("place") == "both", "used").otherwise("unused").alias("status"))


# ---- aggregates --------------------------------------------------------------------------------


@query("ag01_multi_aggregate", """
SELECT count(*) AS n, count(o_orderstatus) AS non_null, count(DISTINCT o_custkey) AS customers, min(o_totalprice) AS lo, max(o_totalprice) AS hi,
 round(CAST(sum(CAST(o_totalprice AS DECIMAL(28,4))) AS DOUBLE) / count(*), 4) AS mean, min(length(o_orderpriority)) AS min_len,
 max(length(o_orderpriority)) AS max_len, round(avg(length(o_orderpriority)), 6) AS avg_len FROM orders""")
def _(t):
    n = F.length("o_orderpriority")
    return t.orders.agg(
        F.count(F.lit(1)).alias("n"), F.count("o_orderstatus").alias("non_null"), F.count_distinct("o_custkey").alias("customers"),
        F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"),
        F.round(exact_sum("o_totalprice") / F.count(F.lit(1)), 4).alias("mean"), F.min(n).alias("min_len"),
        F.max(n).alias("max_len"), F.round(F.avg(n), 6).alias("avg_len"))


@query("ag02_group_aggregate", f"""
SELECT l_returnflag, l_linestatus, count(*) AS n, {DEC.format('l_quantity')} AS qty, {DEC.format('l_extendedprice')} AS price,
 min(l_tax) AS lo_tax, max(l_tax) AS hi_tax, round(avg(l_discount), 6) AS avg_disc FROM lineitem GROUP BY 1, 2""")
def _(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), exact_sum("l_quantity").alias("qty"), exact_sum("l_extendedprice").alias("price"),
        F.min("l_tax").alias("lo_tax"), F.max("l_tax").alias("hi_tax"), F.round(F.avg("l_discount"), 6).alias("avg_disc"))


@query("ag03_count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("ag03_approx_count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, true AS within_bound FROM lineitem GROUP BY 1")
def _(t):
    """The sketch's answer lies within three standard errors of the exact one."""
    g = t.lineitem.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("approx"), F.count_distinct("l_partkey").alias("parts"))
    return g.select("l_returnflag", "parts", (F.abs(F.col("approx") - F.col("parts")) <= 0.06 * F.col("parts")).alias("within_bound"))


@query("ag04_conditional_sum", """
SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, CAST(sum(CASE WHEN o_orderstatus = 'P' THEN CAST(o_totalprice AS DECIMAL(28,4)) ELSE 0 END) AS DOUBLE) AS pending_value
FROM orders GROUP BY 1""")
def _(t):
    return t.orders.groupBy("o_orderpriority").agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("done"),
        exact_sum(F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice")).otherwise(0.0)).alias("pending_value"))


@query("ag05_having", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 40")
def _(t):
    return t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).where("n > 40")


@query("ag06_spread", """
SELECT event_type, round(stddev_samp(value), 6) AS sd, round(avg(value), 6) AS mean, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1""")
def _(t):
    return t.events.groupBy("event_type").agg(F.round(F.stddev("value"), 6).alias("sd"), F.round(F.avg("value"), 6).alias("mean"),
                                              F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("ag07_approx_percentiles", "SELECT event_type, unnest([0.25, 0.5, 0.75, 0.95])::DOUBLE AS prob, count(value) AS n, true AS within_bound FROM events GROUP BY event_type")
def _(t):
    """The rank of each answer lies within 1/accuracy of the wanted one."""
    probs = [0.25, 0.5, 0.75, 0.95]
    p = t.events.groupBy("event_type").agg(F.percentile_approx("value", probs, 10000).alias("p"))
    each = p.select("event_type", F.explode(F.arrays_zip(F.array(*map(F.lit, probs)).alias("prob"), F.col("p").alias("answer"))).alias("x")).select("event_type", "x.*")
    ranks = t.events.where("value IS NOT NULL").join(each, "event_type").groupBy("event_type", "prob").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") < F.col("answer")).alias("below"), F.count_if(F.col("value") <= F.col("answer")).alias("up_to"))
    slack = F.col("n") / 10000 + 1
    return ranks.select("event_type", "prob", "n", ((F.col("below") <= F.col("prob") * F.col("n") + slack) & (F.col("up_to") >= F.col("prob") * F.col("n") - slack)).alias("within_bound"))


@query("ag08_exact_percentile", """
SELECT event_type, 0.5::DOUBLE AS prob, round(quantile_cont(value, 0.5), 6) AS value FROM events GROUP BY 1
UNION ALL SELECT event_type, 0.95::DOUBLE, round(quantile_cont(value, 0.95), 6) FROM events GROUP BY 1""")
def _(t):
    return exact_percentiles(t.events, "value", [0.5, 0.95], ["event_type"]).withColumn("value", F.round("value", 6))


@query("ag09_first_non_null", "SELECT user_id, arg_min(event_type, event_id) FILTER (WHERE value > 50) AS first_kind FROM events GROUP BY 1")
def _(t):
    big = F.when(F.col("value") > 50, F.col("event_id"))
    return t.events.groupBy("user_id").agg(F.min_by("event_type", big).alias("first_kind"))


@query("ag10_row_hash_checksum", """
SELECT o_orderstatus, md5(CAST(sum(CAST(('0x' || substr(md5(concat(o_orderkey, '|', o_custkey)), 1, 8)) AS BIGINT)) AS VARCHAR)) AS checksum FROM orders GROUP BY 1""")
def _(t):
    from tallyframe.operators.checksum import md5_sum

    return t.orders.groupBy("o_orderstatus").agg(md5_sum([F.col("o_orderkey"), F.col("o_custkey")]).alias("checksum"))


@query("ag11_order_free_hash", """
SELECT l_linestatus, bit_xor(h) AS xor_hash, CAST(sum(h) AS VARCHAR) AS sum_hash, count(*) AS row_count
FROM (SELECT l_linestatus, CAST('0x' || substr(md5(concat(l_orderkey, '|', l_linenumber, '|', l_partkey, '|', coalesce(l_returnflag, 'NULL'))), 1, 15) AS BIGINT) AS h FROM lineitem) GROUP BY 1""")
def _(t):
    from tallyframe.operators.checksum import md5_word, xor_checksum

    row = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")]
    g = t.lineitem.groupBy("l_linestatus").agg(*xor_checksum(row, md5_word(row)))
    return g.withColumn("sum_hash", F.col("sum_hash").cast("string"))


@query("ag12_histogram", """
SELECT CAST(least(floor((l_extendedprice - lo) / ((hi + 0.0001 - lo) / 20)) + 1, 21) AS BIGINT) AS bucket, count(*) AS freq, min(l_extendedprice) AS bucket_min, max(l_extendedprice) AS bucket_max
FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) GROUP BY 1""")
def _(t):
    return r.histogram(t.lineitem, "l_extendedprice", 20)


@query("ag13_top_values", """
SELECT CAST(l_suppkey AS VARCHAR) AS value, count(*) AS freq, round(count(*) * 100.0 / (SELECT count(*) FROM lineitem), 2) AS pct
FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(t):
    return r.top_values(t.lineitem, "l_suppkey", 10)


@query("ag14_duplicate_groups", "SELECT user_id, event_type, value, count(*) AS n_rows, count(*) - 1 AS extra_rows FROM events GROUP BY 1, 2, 3 HAVING count(*) > 1")
def _(t):
    return r.duplicate_groups(t.events, ["user_id", "event_type", "value"])


@query("ag15_mean_null_rate", """
SELECT round((avg((c_acctbal IS NULL)::INT) + avg((CASE WHEN c_acctbal >= 0 THEN c_acctbal END IS NULL)::INT) + avg((nullif(c_mktsegment, 'BUILDING') IS NULL)::INT)) / 3, 6) AS null_rate FROM customer""")
def _(t):
    df = t.customer.select("c_acctbal", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("pos"),
                           F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"))
    return df.agg(F.round(r.mean_null_rate(df, df.columns), 6).alias("null_rate"))


@query("ag16_distinct_rows", "SELECT count(*) AS distinct_rows FROM (SELECT DISTINCT user_id, event_type FROM events WHERE event_type <> 'error')")
def _(t):
    df = t.events.select("user_id", F.nullif("event_type", F.lit("error")).alias("event_type"))
    return r.distinct_rows(df, df.columns)


@query("ag17_grouping_sets", f"""
SELECT CASE WHEN GROUPING(event_type) = 0 THEN 'event_type' WHEN GROUPING(day) = 0 THEN 'day' WHEN GROUPING(usr) = 0 THEN 'usr' ELSE 'total' END AS dimension,
 CASE WHEN GROUPING(event_type) = 0 THEN event_type WHEN GROUPING(day) = 0 THEN day WHEN GROUPING(usr) = 0 THEN CAST(usr AS VARCHAR) END AS member, count(*) AS n, {DEC.format('value')} AS total
FROM (SELECT *, strftime(ts, '%Y-%m-%d') AS day, user_id % 10 AS usr FROM events) GROUP BY GROUPING SETS ((event_type), (day), (usr), ())""")
def _(t):
    df = t.events.select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("user_id") % 10).alias("usr"), "value")
    return r.breakdown(df, ["event_type", "day", "usr"], [F.count(F.lit(1)).alias("n"), exact_sum("value").alias("total")])


@query("ag18_date_buckets", """
SELECT strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') AS month, count(*) AS n FROM lineitem GROUP BY 1""")
def _(t):
    return t.lineitem.groupBy(F.date_format(F.date_trunc("month", "l_shipdate"), "yyyy-MM-dd").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("ag19_conditional_distinct", "SELECT event_type, count(DISTINCT CASE WHEN value > 50 THEN user_id END) AS big_users FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(F.count_distinct(F.when(F.col("value") > 50, F.col("user_id"))).alias("big_users"))


# ---- windows -----------------------------------------------------------------------------------


@query("wn01_row_number", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def _(t):
    from tallyframe.common import top_rows

    return top_rows(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"],
                    [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("wn02_lag", with_ctes("daily_metrics") + """
SELECT *, lag(value) OVER (PARTITION BY table_fqn, metric_name ORDER BY measured_at) AS prev FROM daily_metrics""")
def _(t):
    return r.previous(daily_metrics(t), ["table_fqn", "metric_name"], "measured_at", "value", "prev")


@query("wn03_moving_average", with_ctes("daily_metrics") + """
SELECT table_fqn, metric_name, measured_at, round(avg(value) OVER (PARTITION BY table_fqn, metric_name ORDER BY measured_at ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS ma7 FROM daily_metrics""")
def _(t):
    out = r.moving_average(daily_metrics(t), ["table_fqn", "metric_name"], "measured_at", "value", 7, "ma7")
    return out.select("table_fqn", "metric_name", "measured_at", F.round("ma7", 6).alias("ma7"))


@query("wn04_share_of_total", """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 8) AS share FROM lineitem GROUP BY 1, 2""")
def _(t):
    return r.share_of_total(t.lineitem, ["l_returnflag", "l_linestatus"], ["l_returnflag"]).withColumn("share", F.round("share", 8))


@query("wn05_count_over", "SELECT p_partkey, p_name, count(*) OVER (PARTITION BY p_name) AS n_occurrences FROM part")
def _(t):
    return r.occurrences(t.part.select("p_partkey", "p_name"), "p_name")


@query("wn06_trailing_baseline", with_ctes("daily_metrics") + """
SELECT table_fqn, metric_name, measured_at, value, round(avg(value) OVER w, 6) AS baseline_mean, round(stddev_pop(value) OVER w, 6) AS baseline_stddev, count(*) OVER w AS n_points
FROM daily_metrics WINDOW w AS (PARTITION BY table_fqn, metric_name ORDER BY measured_at ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""")
def _(t):
    from tallyframe.operators.anomaly import trailing_baseline

    out = trailing_baseline(daily_metrics(t), ["table_fqn", "metric_name"], "measured_at", "value", 10)
    return out.withColumns({c: F.round(c, 6) for c in ("baseline_mean", "baseline_stddev")})


@query("wn07_recent_gaps", """
WITH r AS (SELECT event_type, user_id % 20 AS u, ts, row_number() OVER (PARTITION BY event_type, user_id % 20 ORDER BY ts DESC) AS rn FROM events),
g AS (SELECT event_type, u, date_diff('microsecond', lag(ts) OVER (PARTITION BY event_type, u ORDER BY ts), ts) / 3.6e9 AS gap FROM r WHERE rn <= 6)
SELECT event_type, u, round(avg(gap), 6) AS mean_gap_hours FROM g WHERE gap > 0 GROUP BY 1, 2""")
def _(t):
    df = t.events.select("event_type", (F.col("user_id") % 20).alias("u"), "ts")
    return r.mean_recent_gap(df, ["event_type", "u"], "ts").withColumn("mean_gap_hours", F.round("mean_gap_hours", 6))


# ---- sort, top-k, samples ----------------------------------------------------------------------


@query("st01_nulls_last", "SELECT p_type, max(nullif(p_size, 50)) AS biggest FROM part GROUP BY 1 ORDER BY 2 DESC NULLS LAST, 1")
def _(t):
    return t.part.groupBy("p_type").agg(F.max(F.nullif("p_size", F.lit(50))).alias("biggest")).orderBy(F.desc_nulls_last("biggest"), "p_type")


@query("st02_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def _(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@query("st03_sample_rows", "SELECT * FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 20")
def _(t):
    return r.sample_rows(t.orders, ["o_orderkey"], 20)


@query("st04_positional_compare", with_ctes("orders_dest") + """,
a AS (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS position FROM orders QUALIFY position <= 200),
b AS (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS position FROM orders_dest QUALIFY position <= 200)
SELECT position, a.o_orderkey AS source_key, b.o_orderkey AS dest_key FROM a FULL JOIN b USING (position)
WHERE (a.o_orderkey, a.o_custkey, a.o_orderstatus, a.o_totalprice, a.o_orderdate) IS DISTINCT FROM (b.o_orderkey, b.o_custkey, b.o_orderstatus, b.o_totalprice, b.o_orderdate)""")
def _(t):
    return r.compare_positions(t.orders, orders_dest(t), ["o_totalprice", "o_orderkey"], 200).select(
        "position", F.col("s.o_orderkey").alias("source_key"), F.col("d.o_orderkey").alias("dest_key"))


# ---- sets --------------------------------------------------------------------------------------


@query("so01_presence", with_ctes("inventory_1", "inventory_2") + """
SELECT table_name, column_name, CASE WHEN b.n_values IS NULL THEN 'only_source' WHEN a.n_values IS NULL THEN 'only_dest' ELSE 'both' END AS place
FROM inventory_1 a FULL JOIN inventory_2 b USING (table_name, column_name)""")
def _(t):
    return r.presence(column_inventory(t, 1), column_inventory(t, 2), ["table_name", "column_name"])


@query("so02_findings_feed", """
SELECT 'order' AS source, CAST(o_orderkey AS VARCHAR) AS id, o_totalprice AS value, NULL AS kind FROM orders
UNION ALL SELECT 'event', CAST(event_id AS VARCHAR), NULL, event_type FROM events""")
def _(t):
    return union_all([
        t.orders.select(F.lit("order").alias("source"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_totalprice").alias("value")),
        t.events.select(F.lit("event").alias("source"), F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("kind"))])


@query("so03_highest_per_key", "SELECT user_id, max(value) AS value, arg_max(event_id, (value, -event_id)) AS event_id FROM events GROUP BY 1")
def _(t):
    best = F.max(F.struct("value", (-F.col("event_id")).alias("neg")))
    return t.events.groupBy("user_id").agg(best.alias("b")).select("user_id", "b.value", (-F.col("b.neg")).alias("event_id"))


@query("so04_snapshot_objects", with_ctes("inventory_1", "inventory_2") + """,
a AS (SELECT DISTINCT table_schema, table_name FROM inventory_1 WHERE data_type = 'DOUBLE'), b AS (SELECT DISTINCT table_schema, table_name FROM inventory_2 WHERE data_type = 'DOUBLE')
SELECT table_schema, table_name, CASE WHEN b.table_name IS NULL THEN 'removed' ELSE 'added' END AS change FROM
(SELECT *, 1 AS x FROM a) a FULL JOIN (SELECT *, 1 AS y FROM b) b USING (table_schema, table_name) WHERE x IS NULL OR y IS NULL""".replace("CASE WHEN b.table_name IS NULL", "CASE WHEN y IS NULL"))
def _(t):
    on = ["table_schema", "table_name"]
    a, b = (column_inventory(t, i).where("data_type = 'DOUBLE'").select(*on) for i in (1, 2))
    return r.presence(a, b, on).where("place <> 'both'").select(*on, F.when(F.col("place") == "only_source", "removed").otherwise("added").alias("change"))


# ---- scalar functions --------------------------------------------------------------------------


@query("sf01_string_functions", """
SELECT c_custkey, concat(left(c_name, 4), '-', right(c_name, 3)) AS a, lpad(CAST(c_nationkey AS VARCHAR), 4, '0') AS b,
 upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS c, replace(c_name, '#', '/') AS d, repeat('*', 3) || substr(c_name, 10, 5) AS e,
 length(trim('  ' || c_mktsegment || ' ')) AS f, split_part(c_name, '#', 2) AS g, concat_ws('|', c_name, c_mktsegment) AS h FROM customer""")
def _(t):
    n, s = F.col("c_name"), F.col("c_mktsegment")
    return t.customer.select(
        "c_custkey", F.concat(F.left(n, F.lit(4)), F.lit("-"), F.right(n, F.lit(3))).alias("a"), F.lpad(F.col("c_nationkey").cast("string"), 4, "0").alias("b"),
        F.initcap(s).alias("c"), F.replace(n, F.lit("#"), F.lit("/")).alias("d"), F.concat(F.repeat(F.lit("*"), 3), F.substring(n, 10, 5)).alias("e"),
        F.length(F.trim(F.concat(F.lit("  "), s, F.lit(" ")))).alias("f"), F.substring_index(n, "#", -1).alias("g"), F.concat_ws("|", n, s).alias("h"))


@query("sf02_date_functions", """
SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS days, strftime(CAST(o_orderdate AS DATE) + 30, '%Y-%m-%d') AS plus30,
 strftime(CAST(o_orderdate AS DATE) + INTERVAL 2 MONTH, '%Y-%m-%d') AS plus2m, strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS q_start,
 quarter(o_orderdate) AS q, year(o_orderdate) AS y, month(o_orderdate) AS m, dayofweek(o_orderdate) + 1 AS dow,
 date_diff('hour', o_orderdate, TIMESTAMP '2002-01-01') AS hours FROM orders""")
def _(t):
    d, as_of = F.col("o_orderdate"), F.lit("2002-01-01").cast("timestamp_ntz")
    iso = "yyyy-MM-dd"
    return t.orders.select(
        "o_orderkey", F.datediff(as_of, d).alias("days"), F.date_format(F.date_add(d, 30), iso).alias("plus30"),
        F.date_format(F.add_months(d, 2), iso).alias("plus2m"), F.date_format(F.date_trunc("quarter", d), iso).alias("q_start"),
        F.quarter(d).alias("q"), F.year(d).alias("y"), F.month(d).alias("m"), F.dayofweek(d).alias("dow"),
        F.timestamp_diff("HOUR", d, as_of).alias("hours"))


@query("sf03_math_functions", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice / 7, 2) AS a, CAST(floor(l_quantity / 3) AS BIGINT) AS b, abs(l_discount - 0.05) AS c, round(power(1 + l_tax, 3), 8) AS d,
 greatest(l_quantity, 10) AS e, least(l_quantity, 10) AS f, round(acos(cos(radians(l_quantity)) * sin(radians(l_quantity))), 8) AS g FROM lineitem""")
def _(t):
    q = F.col("l_quantity")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") / 7, 2).alias("a"), F.floor(q / 3).alias("b"),
        F.abs(F.col("l_discount") - 0.05).alias("c"), F.round(F.pow(1 + F.col("l_tax"), F.lit(3)), 8).alias("d"), F.greatest(q, F.lit(10.0)).alias("e"),
        F.least(q, F.lit(10.0)).alias("f"), F.round(F.acos(F.cos(F.radians(q)) * F.sin(F.radians(q))), 8).alias("g"))


@query("sf04_hash_functions", "SELECT c_custkey, sha256(c_name) AS h256, md5(c_name) AS hmd5, CAST(('0x' || substr(md5(c_name), 1, 8)) AS BIGINT) AS word FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.sha2("c_name", 256).alias("h256"), F.md5("c_name").alias("hmd5"),
                             F.conv(F.substring(F.md5("c_name"), 1, 8), 16, 10).cast("long").alias("word"))


@query("sf05_conditionals", """
SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'debt' WHEN s_acctbal < 5000 THEN 'low' ELSE 'high' END AS band, coalesce(nullif(s_nationkey, 3), -1) AS nation FROM supplier""")
def _(t):
    b = F.col("s_acctbal")
    return t.supplier.select("s_suppkey", F.when(b < 0, "debt").when(b < 5000, "low").otherwise("high").alias("band"),
                             F.coalesce(F.nullif("s_nationkey", F.lit(3)), F.lit(-1)).alias("nation"))


@query("sf06_arrays", "SELECT vec_id, len(embedding) AS n, round(embedding[1]::DOUBLE, 6) AS first_value, i, round(embedding[i]::DOUBLE, 6) AS v FROM embeddings, range(1, 4) r(i)")
def _(t):
    return t.embeddings.select("vec_id", F.size("embedding").alias("n"), F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first_value"),
                               F.explode(F.sequence(F.lit(1), F.lit(3))).alias("i"), "embedding").select(
        "vec_id", "n", "first_value", F.col("i").cast("long").alias("i"), F.round(F.get("embedding", F.col("i") - 1).cast("double"), 6).alias("v"))


@query("sf07_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k_text FROM events")
def _(t):
    return t.events.select("event_id", F.from_json("props", "k long").getField("k").alias("k"), F.get_json_object("props", "$.k").alias("k_text"))


@query("sf08_extract_all", with_ctes("query_log") + """
SELECT ref, count(*) AS n FROM (SELECT unnest(regexp_extract_all(statement_text, '(?:FROM|JOIN) ([a-z_0-9.`]+)', 1)) AS ref FROM query_log) GROUP BY 1""")
def _(t):
    refs = F.regexp_extract_all("statement_text", F.lit("(?:FROM|JOIN) ([a-z_0-9.`]+)"), 1)
    return query_log(t).select(F.explode(refs).alias("ref")).groupBy("ref").agg(F.count(F.lit(1)).alias("n"))


# ---- user-supplied expressions -----------------------------------------------------------------


@query("ud04_custom_total_check", "SELECT count(*) AS total, count(*) FILTER (WHERE l_discount > l_tax) AS failures FROM lineitem")
def _(t):
    from tallyframe.operators.rules import custom_total_check

    return custom_total_check(t.spark, "SELECT count(*) AS total, count_if(l_discount > l_tax) AS failures FROM {t}", t=t.lineitem)


@query("ud05_custom_row_check", "SELECT count(*) AS violations, count(*) = 0 AS passed FROM orders WHERE o_totalprice < 2000")
def _(t):
    from tallyframe.operators.rules import custom_row_check

    return custom_row_check(t.spark, "SELECT * FROM {t} WHERE o_totalprice < 2000", t=t.orders)


@query("ud07_table_hooks", """
SELECT 'orders' AS table_name, count(*) FILTER (WHERE o_totalprice < 0) = 0 AS valid, count(*) || ' rows' AS message FROM orders
UNION ALL SELECT 'supplier', count(*) FILTER (WHERE s_acctbal < 0) = 0, count(*) || ' rows' FROM supplier""")
def _(t):
    from tallyframe.operators.rules import run_table_hooks

    def no_negative(column):
        return lambda df: df.agg((F.count_if(F.col(column) < 0) == 0).alias("valid"),
                                 F.concat(F.count(F.lit(1)).cast("string"), F.lit(" rows")).alias("message"))

    return run_table_hooks({"orders": (t.orders, no_negative("o_totalprice")), "supplier": (t.supplier, no_negative("s_acctbal"))})
