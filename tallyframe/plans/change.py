"""Change data, merges, versions of rows, retention and schema evolution."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.common import new_scratch_path
from tallyframe.operators import changes as ch
from tallyframe.operators import filemerge as fm
from tallyframe.operators import schema as sc
from tallyframe.operators.relational import presence
from tallyframe.plans.fixtures import column_inventory, customer_versions, orders_changes, orders_dest, with_ctes
from tallyframe.plans.registry import query

KEY = ["o_orderkey"]
COLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


@query("cd01_change_summary", with_ctes("orders_changes") + "SELECT _change_type, count(*) AS n_rows, max(_commit_version) AS latest_version FROM orders_changes GROUP BY 1")
def _(t):
    return ch.change_summary(orders_changes(t))


@query("cd02_apply_changes", with_ctes("orders_applied") + "SELECT * FROM orders_applied")
def _(t):
    return ch.apply_changes(t.orders, orders_changes(t), KEY)


@query("cd03_full_replace", f"SELECT {COLS} FROM orders")
def _(t):
    return ch.sync_or_replace(orders_dest(t), t.orders, orders_changes(t), [])


HIST = """hist AS (SELECT 'user_' || user_id AS table_name, event_id AS version, event_type AS operation FROM events),
state AS (SELECT 'user_' || user_id AS table_name, max(event_id) FILTER (WHERE event_id % 3 = 0 AND user_id % 10 <> 0) AS last_version FROM events GROUP BY 1)"""


@query("cd04_tables_to_sync", f"""WITH {HIST} SELECT table_name, count(*) AS n_operations, string_agg(DISTINCT operation, ',' ORDER BY operation) AS operations, max(version) AS current_version,
 CASE WHEN max(last_version) IS NULL THEN 'never_synced' ELSE 'changed' END AS reason FROM hist LEFT JOIN state USING (table_name) WHERE last_version IS NULL OR version > last_version GROUP BY 1""")
def _(t):
    name = F.concat(F.lit("user_"), "user_id")
    h = t.events.select(name.alias("table_name"), F.col("event_id").alias("version"), F.col("event_type").alias("operation"))
    s = t.events.groupBy(name.alias("table_name")).agg(F.max(F.when((F.col("event_id") % 3 == 0) & (F.col("user_id") % 10 != 0), F.col("event_id"))).alias("last_version"))
    return ch.tables_to_sync(h, s)


@query("cd05_upsert", with_ctes("orders_dest") + f"SELECT {COLS} FROM orders UNION ALL SELECT {COLS} FROM orders_dest ANTI JOIN orders USING (o_orderkey)")
def _(t):
    return ch.merge(orders_dest(t), t.orders, KEY)


@query("cd05_upsert_repeated_target", """
SELECT l_orderkey AS k, coalesce(v, l_quantity) AS v FROM lineitem LEFT JOIN (SELECT o_orderkey, o_totalprice AS v FROM orders WHERE o_orderstatus = 'F') ON l_orderkey = o_orderkey
UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def _(t):
    target = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("v"))
    return ch.merge(target, t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v")), ["k"])


@query("cd05_upsert_last_image", """
SELECT user_id AS k, coalesce(v, 0) AS v FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN (SELECT user_id AS u, arg_max(event_id, event_id) AS v FROM events WHERE event_type = 'click' GROUP BY 1) ON u = user_id""")
def _(t):
    target = t.events.select(F.col("user_id").alias("k"), F.lit(0).cast("long").alias("v")).distinct()
    clicks = t.events.where("event_type = 'click'").select(F.col("user_id").alias("k"), F.col("event_id").alias("v"), "event_id")
    return ch.merge(target, clicks, ["k"], order="event_id")


def _listed(t, table, files=16):
    """A table written as files that are ranges of its key, with their list."""
    folder = new_scratch_path(t.spark, "listed")
    table.repartitionByRange(files, *KEY).write.parquet(f"{folder}/table")
    fm.list_table(t.spark, f"{folder}/table", folder)
    return folder


@query("cd02_apply_changes_files", with_ctes("orders_applied") + "SELECT * FROM orders_applied")
def _(t):
    """The feed in two parts, one after the other, each applied to the files that hold its keys."""
    folder, feed, early = _listed(t, t.orders), orders_changes(t), F.col("_commit_version") <= 2
    for version, part in ((1, early), (2, ~early)):
        fm.apply_changes_to_files(t.spark, folder, feed.where(part), KEY, version)
    return fm.read_table(t.spark, folder)


@query("cd05_upsert_files", with_ctes("orders_dest") + f"SELECT {COLS} FROM orders UNION ALL SELECT {COLS} FROM orders_dest ANTI JOIN orders USING (o_orderkey)")
def _(t):
    folder = _listed(t, orders_dest(t))
    fm.merge_to_files(t.spark, folder, t.orders, KEY, 1)
    return fm.read_table(t.spark, folder)


@query("cd05_files_kept", """
SELECT state, o_orderkey, o_totalprice FROM (
 SELECT 'kept' AS state, * FROM orders WHERE o_orderkey % 7 > 0 UNION ALL
 SELECT 'written', * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice) FROM orders WHERE o_orderkey % 7 = 0)""")
def _(t):
    """Files of equal key remainder; the source changes rows of one remainder and repeats all others."""
    folder = new_scratch_path(t.spark, "listed")
    part = F.col("o_orderkey") % 7
    t.orders.withColumn("part", part).repartition(7, "part").write.partitionBy("part").parquet(f"{folder}/parts")
    fm.list_table(t.spark, f"{folder}/parts", folder)
    price = F.when((part == 0) & (F.col("o_orderkey") % 3 == 0), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    files = fm.merge_to_files(t.spark, folder, t.orders.withColumn("o_totalprice", price), KEY, 1)
    rows = fm.read_table(t.spark, folder).select("o_orderkey", "o_totalprice", fm.file_path().alias("path"))
    return rows.join(files, "path").select("state", "o_orderkey", "o_totalprice")


@query("cd06_sync_state", """SELECT count(*) AS total, count(*) FILTER (WHERE s = 'success' AND NOT st) AS synced, count(*) FILTER (WHERE st) AS stale, count(*) FILTER (WHERE s = 'failed') AS failed
FROM (SELECT user_id, CASE WHEN arg_max(event_type, event_id) = 'error' THEN 'failed' ELSE 'success' END AS s, max(ts) < TIMESTAMP '2024-01-29' AS st FROM events GROUP BY 1)""")
def _(t):
    s = t.events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("k"), F.max("ts").alias("m"))
    return ch.sync_state_counts(s.select(F.when(F.col("k") == "error", "failed").otherwise("success").alias("last_status"),
                                         (F.col("m") < F.lit("2024-01-29").cast("timestamp_ntz")).alias("is_stale")))


@query("cd07_scd2_build", with_ctes("dim_scd2") + "SELECT * REPLACE (strftime(valid_to, '%Y-%m-%d') AS valid_to) FROM dim_scd2")
def _(t):
    return ch.scd2(customer_versions(t), ["c_custkey"], "changed_at").withColumn("valid_to", F.date_format("valid_to", "yyyy-MM-dd"))


@query("cd07_scd2_null_keys", """
SELECT k, seen AS valid_from, coalesce(lead(seen) OVER (PARTITION BY k ORDER BY seen), TIMESTAMP '9999-12-31') AS valid_to, lead(seen) OVER (PARTITION BY k ORDER BY seen) IS NULL AS is_current
FROM (SELECT CASE WHEN user_id % 3 > 0 THEN user_id % 50 END AS k, min(ts) AS seen FROM events GROUP BY CASE WHEN user_id % 3 > 0 THEN user_id % 50 END, event_type, CAST(ts AS DATE))""")
def _(t):
    k = F.when(F.col("user_id") % 3 > 0, F.col("user_id") % 50)
    v = t.events.groupBy(k.alias("k"), "event_type", F.to_date("ts").alias("day")).agg(F.min("ts").alias("at")).drop("event_type", "day")
    return ch.scd2(v, ["k"], "at")


@query("cd07_scd2_lookup", with_ctes("dim_scd2") + """
SELECT o_orderkey, c_mktsegment, c_acctbal FROM orders JOIN dim_scd2 ON o_custkey = c_custkey AND valid_from <= o_orderdate AND o_orderdate < valid_to""")
def _(t):
    dim = ch.scd2(customer_versions(t), ["c_custkey"], "changed_at")
    return ch.lookup_as_of(t.orders.withColumnRenamed("o_custkey", "c_custkey"), dim, ["c_custkey"], "o_orderdate").select("o_orderkey", "c_mktsegment", "c_acctbal")


@query("cd07_scd2_current", with_ctes("dim_scd2") + "SELECT c_mktsegment, count(*) AS n FROM dim_scd2 WHERE is_current GROUP BY 1")
def _(t):
    return ch.scd2(customer_versions(t), ["c_custkey"], "changed_at").where("is_current").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("cd08_retention", """
SELECT o_orderkey, strftime(e, '%Y-%m-%d') AS expires_at, e < TIMESTAMP '1999-01-01' AS expired, e >= TIMESTAMP '1999-01-01' AND date_diff('day', TIMESTAMP '1999-01-01', e) <= 3 AS expiring_soon,
 CASE WHEN e < TIMESTAMP '1999-01-01' THEN 'EXPIRED' ELSE date_diff('day', TIMESTAMP '1999-01-01', e) || ' days remaining' END AS status
FROM (SELECT o_orderkey, o_orderdate + to_days([7, 14, 180, 365, NULL][(o_orderkey % 5 + 1)::INT]::INT) AS e FROM orders)""")
def _(t):
    text = F.element_at(F.array(*[F.lit(x) for x in ("7d", "2w", "6M", "1y", "soon")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    out = ch.retention_status(t.orders.select("o_orderkey", "o_orderdate", ch.retention_days_col(text).alias("days")), "o_orderdate", F.col("days"), "1999-01-01")
    return out.select("o_orderkey", F.date_format("expires_at", "yyyy-MM-dd").alias("expires_at"), "expired", "expiring_soon", "status")


I12 = with_ctes("inventory_1", "inventory_2")


@query("cd09_two_way_sync", I12 + """
SELECT table_name, column_name, 'add' AS action FROM inventory_1 ANTI JOIN inventory_2 USING (table_name, column_name)
UNION ALL SELECT table_name, column_name, 'drop' FROM inventory_2 ANTI JOIN inventory_1 USING (table_name, column_name)""")
def _(t):
    return ch.two_way_plan(column_inventory(t, 1), column_inventory(t, 2), ["table_name", "column_name"], drop_extra=True)


# ---- schemas -----------------------------------------------------------------------------------

DIFF = """d AS (SELECT table_name, column_name, a.data_type AS source_type, a.is_nullable AS source_nullable, b.data_type AS dest_type, b.is_nullable AS dest_nullable,
 CASE WHEN a.data_type IS NULL THEN 'added' WHEN b.data_type IS NULL THEN 'removed' WHEN a.data_type <> b.data_type THEN 'type_changed' WHEN a.is_nullable <> b.is_nullable THEN 'nullability_changed' END AS change
 FROM inventory_1 a FULL JOIN inventory_2 b USING (table_name, column_name))"""


def _diff(t):
    return sc.schema_diff(column_inventory(t, 1), column_inventory(t, 2))


@query("sc01_schema_diff", I12 + f", {DIFF} SELECT * FROM d WHERE change IS NOT NULL")
def _(t):
    return _diff(t)


@query("sc02_drift_report", I12 + f""", {DIFF} SELECT table_name, count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'removed') AS removed,
 count(*) FILTER (WHERE change = 'type_changed') AS type_changed, count(*) FILTER (WHERE change = 'nullability_changed') AS nullability_changed, count(*) AS total_changes FROM d WHERE change IS NOT NULL GROUP BY 1""")
def _(t):
    return sc.drift_report(_diff(t))


@query("sc03_compatible_evolution", I12 + f", {DIFF} SELECT table_name, bool_and(change = 'added' AND dest_nullable) AS compatible FROM d WHERE change IS NOT NULL AND column_name NOT LIKE '%\\_3' ESCAPE '\\' GROUP BY 1")
def _(t):
    return sc.compatible_tables(_diff(t).where(~F.col("column_name").endswith("_3")))


@query("sc04_evolve", "SELECT o_orderkey, try_cast(substr(o_orderpriority, 1, 1 + (o_orderkey % 2)::INT) AS INT) AS o_orderpriority, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderdate, NULL::DOUBLE AS discount FROM orders")
def _(t):
    src = t.orders.withColumn("o_orderpriority", F.substring("o_orderpriority", F.lit(1), (F.col("o_orderkey") % 2 + 1).cast("int")))
    want = T.StructType.fromDDL("o_orderkey bigint, o_custkey string, o_orderdate timestamp_ntz, o_orderpriority int, discount double")
    return sc.evolve(src, want, drop_removed=True)


@query("sc05_type_compatibility", """
SELECT a, b, count(*) AS n, CASE WHEN a = b THEN true ELSE (a, b) IN (('INT', 'BIGINT'), ('DOUBLE', 'FLOAT'), ('FLOAT', 'DOUBLE')) END AS compatible FROM
(SELECT CASE WHEN value > 100 THEN 'DOUBLE' WHEN value > 50 THEN 'FLOAT' ELSE 'INT' END AS a, CASE WHEN user_id % 3 = 0 THEN 'FLOAT' WHEN user_id % 3 = 1 THEN 'BIGINT' ELSE 'STRING' END AS b FROM events) GROUP BY 1, 2""")
def _(t):
    v, u = F.col("value"), F.col("user_id") % 3
    g = t.events.select(F.when(v > 100, "DOUBLE").when(v > 50, "FLOAT").otherwise("INT").alias("a"), F.when(u == 0, "FLOAT").when(u == 1, "BIGINT").otherwise("STRING").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("compatible", sc.types_compatible(F.col("a"), F.col("b")))


@query("sc06_snapshot_diff", I12 + """
SELECT table_schema, table_name, CASE WHEN max(y) IS NULL THEN 'only_source' WHEN max(x) IS NULL THEN 'only_dest' ELSE 'both' END AS place FROM
(SELECT table_schema, table_name, 1 AS x, NULL AS y FROM inventory_1 WHERE data_type = 'DOUBLE' UNION ALL SELECT table_schema, table_name, NULL, 1 FROM inventory_2 WHERE data_type = 'INT') GROUP BY 1, 2""")
def _(t):
    return presence(column_inventory(t, 1).where("data_type = 'DOUBLE'"), column_inventory(t, 2).where("data_type = 'INT'"), ["table_schema", "table_name"])


@query("sc07_search", with_ctes("inventory_1") + """
SELECT table_schema, table_name, column_name, CASE WHEN regexp_matches(table_name, '(?i)USER_1.$') THEN 'table' ELSE 'column' END AS matched FROM inventory_1
WHERE regexp_matches(table_name, '(?i)USER_1.$') OR regexp_matches(column_name, '(?i)USER_1.$|^click_[02]')""".replace("'(?i)USER_1.$'", "'(?i)USER_1.$|^click_[02]'"))
def _(t):
    return sc.search(column_inventory(t, 1), "USER_1.$|^click_[02]").select("table_schema", "table_name", "column_name", "matched")


@query("sc08_inventory_views", with_ctes("inventory_1") + """
SELECT table_schema, count(DISTINCT table_name) AS n_tables, count(*) AS n_columns, count(DISTINCT CASE WHEN regexp_matches(column_name, 'sign|phone') THEN column_name END) AS n_pii_like
FROM (SELECT * REPLACE (replace(column_name, 'signup', 'phone') AS column_name) FROM inventory_1) GROUP BY 1""")
def _(t):
    inv = column_inventory(t, 1).withColumn("column_name", F.replace("column_name", F.lit("signup"), F.lit("phone")))
    return sc.schema_summary(inv)
