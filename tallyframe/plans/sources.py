"""Scans, change reads, copies and exports."""

from pyspark.sql import functions as F

from tallyframe.common import new_scratch_path
from tallyframe.plans.fixtures import orders_changes, with_ctes
from tallyframe.plans.registry import query
from tallyframe.sources import changefeed as cf
from tallyframe.sources import export as ex
from tallyframe.sources import tables as src

CH = with_ctes("orders_changes")
DEC = "CAST(sum(CAST({} AS DECIMAL(28,4))) AS DOUBLE)"


@query("io01_table_scan", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("io02_sql_source", "SELECT event_type, count(*) AS n, max(value) AS top_value FROM events WHERE value > 10 GROUP BY event_type")
def _(t):
    return src.sql_source(t.spark, "SELECT event_type, count(*) AS n, max(value) AS top_value FROM {ev} WHERE value > 10 "
                                   "GROUP BY event_type", ev=t.events)


@query("io03_changes_from", CH + "SELECT * FROM orders_changes WHERE _commit_version >= 3")
def _(t):
    return cf.changes_from(orders_changes(t), version=3, timestamp="2024-01-01")


@query("io03_changes_from_time", CH + "SELECT * FROM orders_changes WHERE _commit_timestamp >= TIMESTAMP '2024-01-02'")
def _(t):
    return cf.changes_from(orders_changes(t), timestamp="2024-01-02")


@query("io04_changes_after", CH + "SELECT * FROM orders_changes WHERE _commit_version > 2")
def _(t):
    return cf.changes_after(orders_changes(t), 2)


@query("io05_as_of_version", CH + """, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY _commit_version DESC) AS rn
  FROM orders_changes WHERE _commit_version <= 2 AND _change_type <> 'update_preimage') WHERE rn = 1)
SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM last)
UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM last WHERE _change_type <> 'delete'""")
def _(t):
    return cf.as_of_version(t.orders, orders_changes(t), ["o_orderkey"], 2)


@query("io06_filtered_copy", "SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000")
def _(t):
    path = new_scratch_path(t.spark, "filtered-copy")
    src.filtered_copy(t.orders, "o_orderstatus = 'F' AND o_totalprice > 200000").write.parquet(path)
    return t.spark.read.parquet(path)


@query("io07_schema_only_copy", "SELECT * FROM lineitem WHERE false")
def _(t):
    return src.schema_only_copy(t.lineitem)


@query("io08_table_selection", """
SELECT 'user_' || user_id AS table_name, count(*) AS n_rows FROM events
WHERE regexp_matches('user_' || user_id, '^user_1') AND NOT regexp_matches('user_' || user_id, '(0|5)$') GROUP BY 1""")
def _(t):
    inv = t.events.groupBy(F.concat(F.lit("user_"), "user_id").alias("table_name")).agg(F.count(F.lit(1)).alias("n_rows"))
    return src.select_tables(inv, include="^user_1", exclude="(0|5)$")


@query("io09_append_rows", f"SELECT o_orderstatus, count(*) * 2 AS n, {DEC.format('o_totalprice')} * 2 AS total FROM orders GROUP BY 1")
def _(t):
    path = new_scratch_path(t.spark, "append")
    for _ in range(2):
        src.append_rows(t.orders.select("o_orderstatus", "o_totalprice"), path)
    return t.spark.read.parquet(path).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(28,4)")).cast("double").alias("total"))


@query("io10_subject_export", """
SELECT 'orders' AS _source_table, 'o_custkey' AS _matched_column, o_orderkey AS row_key FROM orders WHERE o_custkey = 77
UNION ALL SELECT 'customer', 'c_custkey', c_custkey FROM customer WHERE c_custkey = 77
UNION ALL SELECT 'events', 'user_id', event_id FROM events WHERE user_id = 77""")
def _(t):
    rows = ex.subject_rows({"orders": t.orders, "customer": t.customer, "events": t.events},
                           {"orders": ["o_custkey"], "customer": ["c_custkey"], "events": ["user_id"]}, 77)
    path = new_scratch_path(t.spark, "export")
    ex.write_export(rows, path, "json")
    back = t.spark.read.schema("_matched_column string, row_json string, _source_table string").json(path)
    key = F.coalesce(*[F.get_json_object("row_json", f"$.{c}") for c in ("o_orderkey", "c_custkey", "event_id")])
    return back.select("_source_table", "_matched_column", key.cast("long").alias("row_key"))


TABLES = ("customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier")


@query("io11_metadata_export", " UNION ALL ".join(
    f"SELECT c.table_name, c.column_name, c.column_index AS ordinal_position, (SELECT count(*) FROM {n}) AS non_null "
    f"FROM duckdb_columns() c WHERE c.table_name = '{n}'" for n in TABLES))
def _(t):
    path = new_scratch_path(t.spark, "metadata")
    inv = ex.column_inventory({n: getattr(t, n) for n in TABLES})
    inv.write.option("header", True).csv(path)
    back = t.spark.read.schema(inv.schema).option("header", True).csv(path)
    return back.select("table_name", "column_name", "ordinal_position", "non_null")


@query("io12_partitioned_write", """
SELECT strftime(o_orderdate, '%Y') AS part_year, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1""")
def _(t):
    path = new_scratch_path(t.spark, "partitioned")
    src.write_partitioned(t.orders.withColumn("part_year", F.date_format("o_orderdate", "yyyy")), path, ["part_year"])
    back = t.spark.read.schema(t.orders.schema.add("part_year", "string")).parquet(path)
    return back.groupBy("part_year").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"))
