"""Frames derived from the given tables, each with the same rule written as SQL.

``CTE[name]`` is the SQL text of a derived table; ``with_ctes("a", "b")`` renders a WITH clause.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.common import exact_sum
from tallyframe.plans.registry import Tables

CTE: dict[str, str] = {}
NEEDS: dict[str, tuple[str, ...]] = {}


def cte(name: str, sql: str, needs: tuple[str, ...] = ()) -> None:
    CTE[name] = sql.strip()
    NEEDS[name] = needs


def with_ctes(*names: str, recursive: bool = False) -> str:
    done: list[str] = []

    def add(n):
        for d in NEEDS[n]:
            add(d)
        if n not in done:
            done.append(n)

    for n in names:
        add(n)
    body = ",\n".join(f"{n} AS ({CTE[n]})" for n in done)
    return f"WITH {'RECURSIVE ' if recursive else ''}{body}\n"


# ---- a changed copy of orders ------------------------------------------------------------------

def orders_dest(t: Tables):
    k = F.col("o_orderkey")
    kept = t.orders.where(k % 97 != 0).select(
        "o_orderkey", "o_custkey",
        F.when(k % 41 == 0, F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(k % 53 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate", "o_orderpriority")
    added = t.orders.where(k % 211 == 0).withColumn("o_orderkey", k + 1_000_000_000)
    return kept.unionByName(added)


cte("orders_dest", """
SELECT o_orderkey, o_custkey,
       CASE WHEN o_orderkey % 41 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderkey % 53 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
       o_orderdate, o_orderpriority
FROM orders WHERE o_orderkey % 97 <> 0
UNION ALL
SELECT o_orderkey + 1000000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM orders WHERE o_orderkey % 211 = 0""")


# ---- a change feed over orders -----------------------------------------------------------------

def orders_changes(t: Tables):
    k, price = F.col("o_orderkey"), F.col("o_totalprice")

    def change(where, kind, version, **repl):
        df = t.orders.where(where)
        for c, v in repl.items():
            df = df.withColumn(c, v)
        return df.select(
            F.lit(kind).alias("_change_type"), F.lit(version).cast("long").alias("_commit_version"),
            F.lit(f"2024-01-0{version} 00:00:00").cast("timestamp_ntz").alias("_commit_timestamp"), *t.orders.columns)

    return (
        change(k % 101 == 0, "insert", 1, o_orderkey=k + 2_000_000_000)
        .unionByName(change(k % 37 == 0, "update_preimage", 2))
        .unionByName(change(k % 37 == 0, "update_postimage", 2, o_totalprice=price * 2))
        .unionByName(change(k % 83 == 0, "delete", 3))
        .unionByName(change(k % 74 == 0, "update_preimage", 4, o_totalprice=price * 2))
        .unionByName(change(k % 74 == 0, "update_postimage", 4, o_totalprice=price * 4))
    )


def _change_sql(where: str, kind: str, version: int, key: str = "o_orderkey", price: str = "o_totalprice") -> str:
    return (f"SELECT '{kind}' AS _change_type, CAST({version} AS BIGINT) AS _commit_version, "
            f"TIMESTAMP '2024-01-0{version} 00:00:00' AS _commit_timestamp, {key} AS o_orderkey, o_custkey, "
            f"o_orderstatus, {price} AS o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE {where}")


cte("orders_changes", "\nUNION ALL\n".join([
    _change_sql("o_orderkey % 101 = 0", "insert", 1, key="o_orderkey + 2000000000"),
    _change_sql("o_orderkey % 37 = 0", "update_preimage", 2),
    _change_sql("o_orderkey % 37 = 0", "update_postimage", 2, price="o_totalprice * 2"),
    _change_sql("o_orderkey % 83 = 0", "delete", 3),
    _change_sql("o_orderkey % 74 = 0", "update_preimage", 4, price="o_totalprice * 2"),
    _change_sql("o_orderkey % 74 = 0", "update_postimage", 4, price="o_totalprice * 4"),
]))
cte("last_change", """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY _commit_version DESC) AS rn
  FROM orders_changes WHERE _change_type <> 'update_preimage') WHERE rn = 1""", ("orders_changes",))
cte("orders_applied", """
SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM last_change)
UNION ALL
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM last_change WHERE _change_type <> 'delete'""", ("last_change",))


# ---- daily metric history, check runs ----------------------------------------------------------

def daily_metrics(t: Tables):
    day = (
        t.events.groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("table_fqn"))
        .agg(F.count(F.lit(1)).cast("double").alias("row_count"), exact_sum("value").alias("value_sum"))
    )
    return day.select(
        "table_fqn", F.date_format("day", "yyyy-MM-dd").alias("measured_at"),
        F.explode(F.create_map(F.lit("row_count"), F.col("row_count"), F.lit("value_sum"), F.col("value_sum")))
        .alias("metric_name", "value"))


cte("daily_wide", """
SELECT event_type AS table_fqn, strftime(ts, '%Y-%m-%d') AS measured_at, CAST(count(*) AS DOUBLE) AS row_count,
       CAST(sum(CAST(value AS DECIMAL(28,4))) AS DOUBLE) AS value_sum
FROM events GROUP BY ALL""")
cte("daily_metrics", """
SELECT table_fqn, measured_at, 'row_count' AS metric_name, row_count AS value FROM daily_wide
UNION ALL SELECT table_fqn, measured_at, 'value_sum', value_sum FROM daily_wide""", ("daily_wide",))


def check_runs(t: Tables):
    """One run per table and day: rows checked, and rows valid (value within the expected range)."""
    return (
        t.events.groupBy(F.col("event_type").alias("table_fqn"), F.date_format("ts", "yyyy-MM-dd").alias("executed_at"))
        .agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(F.col("value") <= 150).alias("valid_rows"))
        .withColumn("run_id", F.concat_ws("@", "table_fqn", "executed_at"))
    )


cte("check_runs", """
SELECT event_type AS table_fqn, strftime(ts, '%Y-%m-%d') AS executed_at, count(*) AS total_rows,
       count(*) FILTER (WHERE value <= 150) AS valid_rows,
       event_type || '@' || strftime(ts, '%Y-%m-%d') AS run_id
FROM events GROUP BY ALL""")


# ---- prices with validity intervals ------------------------------------------------------------

def prices(t: Tables):
    kinds = t.events.select("event_type").distinct()
    base = (F.length("event_type") * F.lit(0.25)).cast("double")
    change = F.lit("2024-01-15").cast("timestamp_ntz")
    first = kinds.select("event_type", F.lit("2023-01-01").cast("timestamp_ntz").alias("price_start"),
                         change.alias("price_end"), base.alias("price"))
    second = kinds.select("event_type", change.alias("price_start"),
                          F.lit(None).cast("timestamp_ntz").alias("price_end"), (base + 0.5).alias("price"))
    return first.unionByName(second)


cte("prices", """
SELECT DISTINCT event_type, TIMESTAMP '2023-01-01' AS price_start, TIMESTAMP '2024-01-15' AS price_end,
       length(event_type) * 0.25::DOUBLE AS price FROM events
UNION ALL
SELECT DISTINCT event_type, TIMESTAMP '2024-01-15', NULL, length(event_type) * 0.25::DOUBLE + 0.5 FROM events""")


# ---- customer versions -------------------------------------------------------------------------

def customer_versions(t: Tables):
    """Change events of customers: a first image for all, a second one for every tenth key."""
    first = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal",
                              F.lit("1995-01-01").cast("timestamp_ntz").alias("changed_at"))
    second = t.customer.where(F.col("c_custkey") % 10 == 0).select(
        "c_custkey", F.lit("MOVED").alias("c_mktsegment"), (F.col("c_acctbal") + 100).alias("c_acctbal"),
        F.lit("1998-01-01").cast("timestamp_ntz").alias("changed_at"))
    return first.unionByName(second)


cte("customer_versions", """
SELECT c_custkey, c_mktsegment, c_acctbal, TIMESTAMP '1995-01-01' AS changed_at FROM customer
UNION ALL SELECT c_custkey, 'MOVED', c_acctbal + 100, TIMESTAMP '1998-01-01' FROM customer WHERE c_custkey % 10 = 0""")
cte("dim_scd2", """
SELECT c_custkey, c_mktsegment, c_acctbal, changed_at AS valid_from,
       coalesce(lead(changed_at) OVER (PARTITION BY c_custkey ORDER BY changed_at), TIMESTAMP '9999-12-31') AS valid_to,
       lead(changed_at) OVER (PARTITION BY c_custkey ORDER BY changed_at) IS NULL AS is_current
FROM customer_versions""", ("customer_versions",))


# ---- column inventories seen in the data at two points in time ---------------------------------

def column_inventory(t: Tables, part: int):
    """Each user is a table and each event kind and hour a column; the type, nullability and size
    of a column follow from the values seen in the first or second half of the month."""
    half = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    rows = t.events.where(half if part == 1 else ~half)
    return (
        rows.groupBy(
            F.concat(F.lit("s"), F.col("user_id") % 7).alias("table_schema"),
            F.concat(F.lit("user_"), F.col("user_id")).alias("table_name"),
            F.concat_ws("_", "event_type", F.hour("ts") % 4).alias("column_name"))
        .agg(F.count(F.lit(1)).alias("n_values"), F.max("value").alias("max_value"), F.min("value").alias("min_value"))
        .select("table_schema", "table_name", "column_name",
                F.when(F.col("max_value") > 100, "DOUBLE").when(F.col("max_value") > 50, "FLOAT").otherwise("INT")
                .alias("data_type"),
                (F.col("min_value") < 5).alias("is_nullable"), "n_values")
    )


for _p, _op in ((1, "<"), (2, ">=")):
    cte(f"inventory_{_p}", f"""
SELECT 's' || (user_id % 7) AS table_schema, 'user_' || user_id AS table_name,
       event_type || '_' || (hour(ts) % 4) AS column_name,
       CASE WHEN max(value) > 100 THEN 'DOUBLE' WHEN max(value) > 50 THEN 'FLOAT' ELSE 'INT' END AS data_type,
       min(value) < 5 AS is_nullable, count(*) AS n_values
FROM events WHERE ts {_op} TIMESTAMP '2024-01-16' GROUP BY 1, 2, 3""")


# ---- a query log -------------------------------------------------------------------------------

def query_log(t: Tables):
    """Each event is one logged statement over tables named after its kind and user."""
    u = F.col("user_id")
    stmt = F.concat(
        F.lit("SELECT k"), u % 5, F.lit(", total_"), F.col("event_type"), F.lit(" FROM main.sales."), F.col("event_type"),
        F.lit(" JOIN `dim`.`users_"), u % 10, F.lit("` ON id = user_id"),
        F.when(F.col("value") > 60, F.lit(" WHERE k0 > 1")).otherwise(F.lit("")))
    return t.events.select("event_id", stmt.alias("statement_text"), F.col("ts").alias("start_time"),
                           F.concat(F.lit("u"), u).alias("user_name"))


cte("query_log", """
SELECT event_id, 'SELECT k' || (user_id % 5) || ', total_' || event_type || ' FROM main.sales.' || event_type
       || ' JOIN `dim`.`users_' || (user_id % 10) || '` ON id = user_id'
       || CASE WHEN value > 60 THEN ' WHERE k0 > 1' ELSE '' END AS statement_text,
       ts AS start_time, 'u' || user_id AS user_name
FROM events""")


# ---- a dependency graph ------------------------------------------------------------------------

def dependency_edges(t: Tables):
    """Customers that order depend on the customers at half and at a third of their key."""
    n = t.orders.select(F.col("o_custkey").alias("k")).where("o_custkey > 0").distinct()
    return n.select(F.explode(F.array(F.floor(F.col("k") / 2), F.floor(F.col("k") / 3))).alias("src"), F.col("k").alias("dst")).distinct()


cte("edges", """
SELECT DISTINCT src, dst FROM (
  SELECT o_custkey // 2 AS src, o_custkey AS dst FROM orders WHERE o_custkey > 0
  UNION ALL SELECT o_custkey // 3, o_custkey FROM orders WHERE o_custkey > 0)""")


# ---- people derived from customers -------------------------------------------------------------

def persons(t: Tables):
    k = F.col("c_custkey")
    text = lambda c: c.cast("string")
    pad = lambda c, n: F.lpad(text(c), n, "0")
    return t.customer.select(
        "c_custkey",
        F.when(k % 10 != 0, F.replace("c_name", F.lit("#"), F.lit(" "))).alias("full_name"),
        F.concat(F.lit("c"), text(k), F.lit("@example"), text(k % 5), F.lit(".com")).alias("email"),
        F.concat(F.lit("+1 555 "), pad(k % 10000, 4)).alias("phone"),
        F.when(k % 4 == 0, F.lit("none")).otherwise(F.concat_ws("-", pad(k % 900, 3), pad(k % 90, 2), pad(k % 9000, 4))).alias("ssn"),
        F.when(k % 3 == 0, "4111 1111 1111 1111").when(k % 3 == 1, "5500-0000-0000-0004")
        .otherwise(F.concat(F.lit("4111 1111 1111 "), pad(k % 10000, 4))).alias("credit_card"),
        F.concat_ws(".", text(k % 300), text(k % 256), text(k % 7), text(k % 99)).alias("ip_addr"),
        F.concat_ws("-", text(1950 + k % 50), pad(1 + k % 12, 2), pad(1 + k % 28, 2)).alias("birth_date"),
        F.when(k % 2 == 0, "DE89370400440532013000").otherwise(F.concat(F.lit("DE89370400440532"), pad(k % 1000000, 6))).alias("iban"),
        F.concat(F.lit("client "), text(k)).alias("remark"),
        "c_acctbal",
    )


cte("persons", """
SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 THEN replace(c_name, '#', ' ') END AS full_name,
 'c' || c_custkey || '@example' || (c_custkey % 5) || '.com' AS email,
 '+1 555 ' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS phone,
 CASE WHEN c_custkey % 4 = 0 THEN 'none' ELSE lpad((c_custkey % 900)::VARCHAR, 3, '0') || '-' || lpad((c_custkey % 90)::VARCHAR, 2, '0')
   || '-' || lpad((c_custkey % 9000)::VARCHAR, 4, '0') END AS ssn,
 CASE c_custkey % 3 WHEN 0 THEN '4111 1111 1111 1111' WHEN 1 THEN '5500-0000-0000-0004'
   ELSE '4111 1111 1111 ' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') END AS credit_card,
 (c_custkey % 300) || '.' || (c_custkey % 256) || '.' || (c_custkey % 7) || '.' || (c_custkey % 99) AS ip_addr,
 (1950 + c_custkey % 50) || '-' || lpad((1 + c_custkey % 12)::VARCHAR, 2, '0') || '-' || lpad((1 + c_custkey % 28)::VARCHAR, 2, '0') AS birth_date,
 CASE WHEN c_custkey % 2 = 0 THEN 'DE89370400440532013000' ELSE 'DE89370400440532' || lpad((c_custkey % 1000000)::VARCHAR, 6, '0') END AS iban,
 'client ' || c_custkey AS remark, c_acctbal
FROM customer""")
