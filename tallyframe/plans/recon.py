"""Comparison of orders with a changed copy."""

from pyspark.sql import functions as F

from tallyframe.common import cut_lineage, union_all
from tallyframe.operators import changes as ch
from tallyframe.operators import checksum as ck
from tallyframe.operators import digesttree as dt
from tallyframe.operators import reconcile as rc
from tallyframe.operators import stats as st
from tallyframe.operators.radix import exact_quantiles
from tallyframe.plans.fixtures import orders_changes, orders_dest, with_ctes
from tallyframe.plans.registry import query

KEY = ["o_orderkey"]
D = with_ctes("orders_dest")
ROW = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


@query("rc01_reconcile_hash", f"""{D}
SELECT (SELECT count(*) FROM orders) AS source_count, (SELECT count(*) FROM orders_dest) AS dest_count,
       (SELECT count(*) FROM orders) - m AS matched_rows, m AS missing_in_dest, e AS extra_in_dest,
       round(((SELECT count(*) FROM orders) - m) * 100.0 / (SELECT count(*) FROM orders), 2) AS match_rate_pct
FROM (SELECT (SELECT count(*) FROM orders s ANTI JOIN orders_dest d USING ({ROW})) AS m,
             (SELECT count(*) FROM orders_dest d ANTI JOIN orders s USING ({ROW})) AS e)""")
def _(t):
    return rc.reconcile_hash(t.orders, orders_dest(t))


@query("rc01_reconcile_multiset", """
WITH a AS (SELECT l_returnflag, l_linestatus, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL),
b AS (SELECT l_returnflag, l_linestatus, l_quantity, count(*) AS n FROM lineitem WHERE l_discount > 0.02 GROUP BY ALL),
j AS (SELECT coalesce(a.n, 0) AS s, coalesce(b.n, 0) AS d FROM a FULL JOIN b USING (l_returnflag, l_linestatus, l_quantity))
SELECT CAST(sum(s) AS BIGINT) AS source_count, CAST(sum(d) AS BIGINT) AS dest_count,
       CAST(sum(s) - sum(greatest(s - d, 0)) AS BIGINT) AS matched_rows,
       CAST(sum(greatest(s - d, 0)) AS BIGINT) AS missing_in_dest, CAST(sum(greatest(d - s, 0)) AS BIGINT) AS extra_in_dest,
       round((sum(s) - sum(greatest(s - d, 0))) * 100.0 / sum(s), 2) AS match_rate_pct FROM j""")
def _(t):
    cols = ["l_returnflag", "l_linestatus", "l_quantity"]
    return rc.reconcile_hash(t.lineitem.select(cols), t.lineitem.where("l_discount > 0.02").select(cols), multiset=True)


SAME = ("s.o_custkey = d.o_custkey AND s.o_orderstatus = d.o_orderstatus AND s.o_totalprice = d.o_totalprice "
        "AND s.o_orderdate = d.o_orderdate AND s.o_orderpriority = d.o_orderpriority")
KEYED = """SELECT {by} count(s.o_orderkey) AS source_count, count(d.o_orderkey) AS dest_count,
       count(*) FILTER (WHERE {same}) AS matched_rows,
       count(*) FILTER (WHERE s.o_orderkey IS NOT NULL AND d.o_orderkey IS NOT NULL AND NOT ({same})) AS modified_rows,
       count(*) FILTER (WHERE d.o_orderkey IS NULL) AS missing_in_dest,
       count(*) FILTER (WHERE s.o_orderkey IS NULL) AS extra_in_dest,
       round(count(*) FILTER (WHERE {same}) * 100.0 / greatest(count(s.o_orderkey), 1), 2) AS match_rate_pct
FROM orders s FULL JOIN {dest} d ON s.o_orderkey = d.o_orderkey"""


@query("rc02_reconcile_keyed", D + KEYED.format(by="", same=SAME, dest="orders_dest"))
def _(t):
    return rc.narrow_counts(rc.reconcile_keyed(t.orders, orders_dest(t), KEY))


@query("rc02_key_status", D + f"""
SELECT coalesce(s.o_orderkey, d.o_orderkey) AS o_orderkey, CAST(s.o_orderkey IS NOT NULL AS BIGINT) AS n_source,
       CAST(d.o_orderkey IS NOT NULL AS BIGINT) AS n_dest,
       CASE WHEN d.o_orderkey IS NULL THEN 'missing_in_dest' WHEN s.o_orderkey IS NULL THEN 'extra_in_dest'
            WHEN {SAME} THEN 'matched' ELSE 'modified' END AS status
FROM orders s FULL JOIN orders_dest d ON s.o_orderkey = d.o_orderkey""")
def _(t):
    return rc.key_status(t.orders, orders_dest(t), KEY)


def _diff_sql(col, s, d):
    return (f"SELECT s.o_orderkey, '{col}' AS column_name, {s} AS source_value, {d} AS dest_value "
            f"FROM orders s JOIN orders_dest d USING (o_orderkey) WHERE s.{col} IS DISTINCT FROM d.{col}")


DIFFS = " UNION ALL ".join([
    _diff_sql("o_orderstatus", "s.o_orderstatus", "d.o_orderstatus"),
    _diff_sql("o_totalprice", "CAST(CAST(s.o_totalprice AS DECIMAL(18,2)) AS VARCHAR)",
              "CAST(CAST(d.o_totalprice AS DECIMAL(18,2)) AS VARCHAR)")])


@query("rc03_column_diffs", D + DIFFS)
def _(t):
    def price_as_decimal(df):
        return df.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))

    return rc.column_diffs(price_as_decimal(t.orders), price_as_decimal(orders_dest(t)), KEY)


@query("rc04_column_impact", D + f"SELECT column_name, count(*) AS modified_rows FROM ({DIFFS}) GROUP BY 1")
def _(t):
    return rc.column_impact(rc.column_diffs(t.orders, orders_dest(t), KEY))


LOOSE = ("s.o_custkey = d.o_custkey AND lower(trim(s.o_orderstatus)) = lower(trim(d.o_orderstatus)) "
         "AND round(s.o_totalprice, 1) = round(d.o_totalprice, 1) AND s.o_orderdate = d.o_orderdate "
         "AND s.o_orderpriority = d.o_orderpriority")


@query("rc05_compare_options", D + KEYED.format(by="", same=LOOSE, dest="orders_dest"))
def _(t):
    opt = rc.CompareOptions(ignore_nulls=True, ignore_case=True, ignore_whitespace=True, decimal_precision=1)
    keyed = lambda df: df.withColumn("o_orderkey", F.col("o_orderkey").cast("string"))
    return rc.narrow_counts(rc.reconcile_keyed(keyed(t.orders), keyed(orders_dest(t)), KEY, options=opt))


PER_PRIORITY = KEYED.format(by="coalesce(s.o_orderpriority, d.o_orderpriority) AS o_orderpriority,", same=SAME,
                            dest="orders_dest") + " GROUP BY 1"


def _per_priority(t, dest=None):
    return rc.narrow_counts(rc.reconcile_keyed(t.orders, dest or orders_dest(t), ["o_orderkey", "o_orderpriority"], by=["o_orderpriority"]))


@query("rc06_match_rate_rollup", D + f"""
SELECT count(*) AS total_tables, count(*) FILTER (WHERE missing_in_dest + extra_in_dest + modified_rows = 0) AS matched_tables,
       count(*) FILTER (WHERE missing_in_dest + extra_in_dest + modified_rows > 0) AS mismatched_tables,
       CAST(sum(source_count) AS BIGINT) AS source_count, CAST(sum(dest_count) AS BIGINT) AS dest_count,
       CAST(sum(matched_rows) AS BIGINT) AS matched_rows, CAST(sum(modified_rows) AS BIGINT) AS modified_rows,
       CAST(sum(missing_in_dest) AS BIGINT) AS missing_in_dest, CAST(sum(extra_in_dest) AS BIGINT) AS extra_in_dest,
       round(sum(matched_rows) * 100.0 / sum(source_count), 2) AS match_rate_pct
FROM ({PER_PRIORITY})""")
def _(t):
    return rc.rollup(_per_priority(t))


INCR = with_ctes("orders_changes") + """, src AS (SELECT * FROM orders_changes WHERE _commit_version >= 2),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY _commit_version DESC) AS rn
      FROM src WHERE _change_type IN ('insert', 'update_postimage')) WHERE rn = 1),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY _commit_version DESC) AS rn
      FROM src WHERE _change_type IN ('insert', 'update_postimage') AND _commit_version <= 2) WHERE rn = 1)
SELECT count(a.o_orderkey) AS source_count, count(b.o_orderkey) AS dest_count,
       count(*) FILTER (WHERE a.o_totalprice = b.o_totalprice AND a.o_orderstatus = b.o_orderstatus) AS matched_rows,
       count(*) FILTER (WHERE a.o_totalprice <> b.o_totalprice OR a.o_orderstatus <> b.o_orderstatus) AS modified_rows,
       count(*) FILTER (WHERE b.o_orderkey IS NULL) AS missing_in_dest,
       count(*) FILTER (WHERE a.o_orderkey IS NULL) AS extra_in_dest,
       round(count(*) FILTER (WHERE a.o_totalprice = b.o_totalprice AND a.o_orderstatus = b.o_orderstatus) * 100.0
             / greatest(count(a.o_orderkey), 1), 2) AS match_rate_pct
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey"""


@query("rc07_reconcile_incremental", INCR)
def _(t):
    from tallyframe.sources.changefeed import changes_from

    feed = changes_from(orders_changes(t), version=2)
    return rc.narrow_counts(rc.reconcile_incremental(feed, feed.where("_commit_version <= 2"), KEY, ["o_totalprice", "o_orderstatus"]))


def _ck_cols():
    return [F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus"),
            F.col("o_totalprice").cast("decimal(18,2)"), F.col("o_orderpriority")]


CK_SQL = """md5(CAST(sum(CAST(('0x' || substr(md5(concat(o_orderkey, '|', o_custkey, '|', coalesce(o_orderstatus, 'NULL'),
  '|', CAST(o_totalprice AS DECIMAL(18,2)), '|', o_orderpriority)), 1, 8)) AS BIGINT)) AS VARCHAR))"""


@query("rc08_count_and_checksum", D + f"""
SELECT 'orders' AS table_name, a.n AS source_count, b.n AS dest_count, a.n = b.n AS match, a.ck = b.ck AS checksum_match
FROM (SELECT count(*) AS n, {CK_SQL} AS ck FROM orders) a, (SELECT count(*) AS n, {CK_SQL} AS ck FROM orders_dest) b""")
def _(t):
    return ck.validate_pairs({"orders": (t.orders, orders_dest(t))}, {"orders": _ck_cols()})


@query("rc09_md5_sum_checksum", f"SELECT count(*) AS row_count, {CK_SQL} AS checksum FROM orders")
def _(t):
    return ck.table_checksum(t.orders, _ck_cols())


TREE_ROW = """CAST('0x' || substr(md5(concat(o_orderkey, '|', o_custkey, '|', coalesce(o_orderstatus, 'NULL'), '|', CAST(o_totalprice AS DECIMAL(18,2)), '|', o_orderpriority)), 1, 15) AS BIGINT)"""
TREE_FIGURES = "count(*) AS n_rows, sum(h) AS sum_hash, bit_xor(h) AS xor_hash"
WIDTH = 64


def _tree_sql(table):
    return " UNION ALL ".join(f"SELECT {i} AS level, o_orderkey // {WIDTH * dt.FANOUT**i} AS node, {TREE_FIGURES} FROM (SELECT o_orderkey, {TREE_ROW} AS h FROM {table}) GROUP BY 2"
                              for i in range(4))


@query("rc09_digest_tree", f"SELECT * REPLACE (CAST(sum_hash AS VARCHAR) AS sum_hash) FROM ({_tree_sql('orders')})")
def _(t):
    return dt.digest_tree(t.orders, "o_orderkey", ck.md5_word(_ck_cols()), WIDTH, 3).withColumn("sum_hash", F.col("sum_hash").cast("string"))


@query("rc11_differing_leaves", D + f""", a AS ({_tree_sql('orders')}), b AS ({_tree_sql('orders_dest')})
SELECT node FROM a FULL JOIN b USING (level, node) WHERE level = 0 AND (a.n_rows, a.sum_hash, a.xor_hash) IS DISTINCT FROM (b.n_rows, b.sum_hash, b.xor_hash)""")
def _(t):
    trees = [cut_lineage(dt.digest_tree(df, "o_orderkey", ck.md5_word(_ck_cols()), WIDTH, 3), "tree") for df in (t.orders, orders_dest(t))]
    return dt.differing_leaves(*trees, 3)


@query("rc11_tree_column_diffs", D + DIFFS)
def _(t):
    sides = [df.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)")) for df in (t.orders, orders_dest(t))]
    hashed = dt.row_hash(t.orders.columns)
    trees = [cut_lineage(dt.digest_tree(df, "o_orderkey", hashed, WIDTH), "tree") for df in sides]
    return dt.tree_column_diffs(*sides, *trees, "o_orderkey", WIDTH)


@query("rc10_xor_checksum")
def _(t):
    return t.orders.agg(*ck.xor_checksum([F.col(c) for c in t.orders.columns]))


@query("rc10_xor_checksum_md5", """
SELECT bit_xor(h) AS xor_hash, CAST(sum(h) AS VARCHAR) AS sum_hash, count(*) AS row_count
FROM (SELECT CAST('0x' || substr(md5(concat(o_orderkey, '|', o_custkey, '|', coalesce(o_orderstatus, 'NULL'))), 1, 15) AS BIGINT) AS h FROM orders)""")
def _(t):
    row = [F.col(c) for c in ("o_orderkey", "o_custkey", "o_orderstatus")]
    return t.orders.agg(*ck.xor_checksum(row, ck.md5_word(row))).withColumn("sum_hash", F.col("sum_hash").cast("string"))


def _pairs(t):
    return {"orders": (t.orders, orders_dest(t)), "lineitem": (t.lineitem, t.lineitem.where("l_quantity > 1")),
            "customer": (t.customer, t.customer), "part": (t.part, t.part)}


PAIRS = """(
SELECT 'orders' AS table_name, (SELECT count(*) FROM orders) AS source_count, (SELECT count(*) FROM orders_dest) AS dest_count
UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem), (SELECT count(*) FROM lineitem WHERE l_quantity > 1)
UNION ALL SELECT 'customer', (SELECT count(*) FROM customer), (SELECT count(*) FROM customer)
UNION ALL SELECT 'part', (SELECT count(*) FROM part), (SELECT count(*) FROM part))"""


@query("rc11_validate_tables", D + f"""
SELECT table_name, source_count, dest_count, source_count = dest_count AS match, CAST(NULL AS BOOLEAN) AS checksum_match FROM {PAIRS}""")
def _(t):
    return ck.validate_pairs(_pairs(t))


@query("rc12_validation_threshold", D + f"""
SELECT count(*) AS total_tables, count(*) FILTER (WHERE source_count <> dest_count) AS mismatched_count,
       round(count(*) FILTER (WHERE source_count <> dest_count) * 100.0 / count(*), 2) AS mismatch_pct,
       count(*) FILTER (WHERE source_count <> dest_count) * 100.0 / count(*) <= 25 AS passed FROM {PAIRS}""")
def _(t):
    return ck.evaluate_threshold(ck.validate_pairs(_pairs(t)), 25.0)


@query("rc13_key_detection", """
SELECT 'order_key' AS column_name, count(DISTINCT l_orderkey) AS distinct_values, count(*) AS total_rows, count(DISTINCT l_orderkey) = count(*) AS is_unique FROM lineitem
UNION ALL SELECT 'part_key', count(DISTINCT l_partkey), count(*), count(DISTINCT l_partkey) = count(*) FROM lineitem
UNION ALL SELECT 'lineitem_id', count(DISTINCT l_orderkey * 10 + l_linenumber), count(*), count(DISTINCT l_orderkey * 10 + l_linenumber) = count(*) FROM lineitem""")
def _(t):
    df = t.lineitem.select(F.col("l_orderkey").alias("order_key"), F.col("l_partkey").alias("part_key"), "l_quantity",
                           (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("lineitem_id"))
    return rc.key_uniqueness(df, rc.detect_key_columns(df.columns, "lineitem"))


@query("rc14_table_preview", D + """
SELECT c.column_name, c.status, (SELECT count(*) FROM orders) AS source_count, (SELECT count(*) FROM orders_dest) AS dest_count
FROM (VALUES ('o_orderkey','match'), ('o_custkey','type_mismatch'), ('o_orderstatus','match'), ('o_totalprice','match'),
      ('o_orderdate','match'), ('o_orderpriority','source_only'), ('loaded_on','dest_only')) c(column_name, status)""")
def _(t):
    d = orders_dest(t).withColumn("o_custkey", F.col("o_custkey").cast("string")).withColumn(
        "loaded_on", F.lit("2024-01-01")).drop("o_orderpriority")
    return rc.table_preview(t.orders, d).select("column_name", "status", "source_count", "dest_count")


@query("rc14_preview_types", """
SELECT * FROM (VALUES ('o_orderkey', 'bigint', 'bigint', true), ('o_custkey', 'bigint', 'string', false), ('o_totalprice', 'double', 'double', false), ('loaded_on', NULL, 'string', false))
c(column_name, source_type, dest_type, is_key)""")
def _(t):
    d = orders_dest(t).select("o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"), "o_totalprice", F.lit("x").alias("loaded_on"))
    return rc.table_preview(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), d, KEY).select("column_name", "source_type", "dest_type", "is_key")


@query("rc14_preview_rows", D + """
SELECT * FROM (SELECT 'source' AS side, row_number() OVER (ORDER BY o_orderkey) AS position, o_orderkey, o_custkey, o_orderstatus FROM orders) WHERE position <= 3
UNION ALL SELECT * FROM (SELECT 'dest', row_number() OVER (ORDER BY o_orderkey) AS position, o_orderkey, o_custkey, o_orderstatus FROM orders_dest) WHERE position <= 3""")
def _(t):
    return rc.preview_rows(t.orders, orders_dest(t), KEY, ["o_orderkey", "o_custkey", "o_orderstatus"])


def _num_side(side, tbl, col):
    return f"""SELECT '{col}' AS column_name, min({col})::DOUBLE AS {side}_min_value, max({col})::DOUBLE AS {side}_max_value,
 avg({col}) AS {side}_mean, stddev_samp({col}) AS {side}_stddev, round(1 - count({col}) / count(*), 4) AS {side}_null_rate,
 quantile_cont({col}, 0.25) AS {side}_p25, quantile_cont({col}, 0.5) AS {side}_p50, quantile_cont({col}, 0.75) AS {side}_p75,
 quantile_cont({col}, 0.95) AS {side}_p95 FROM {tbl}"""


STATS = ["min_value", "max_value", "mean", "stddev", "null_rate", "p25", "p50", "p75", "p95"]


@query("rc15_stats_numeric", D + f"""
SELECT column_name, {', '.join(f'round({s}_{n}, 4) AS {s}_{n}' for s in ('source', 'dest') for n in STATS)},
  {', '.join(f'round(source_{n} - dest_{n}, 4) AS delta_{n}' for n in ('min_value', 'max_value', 'mean', 'stddev', 'p50'))}
FROM ({_num_side('source', 'orders', 'o_totalprice')} UNION ALL {_num_side('source', 'orders', 'o_custkey')}) a
JOIN ({_num_side('dest', 'orders_dest', 'o_totalprice')} UNION ALL {_num_side('dest', 'orders_dest', 'o_custkey')}) b USING (column_name)""")
def _(t):
    out = st.compare_numeric(t.orders, orders_dest(t), ["o_totalprice", "o_custkey"])
    return out.select("column_name", *[F.round(c, 4).alias(c) for c in out.columns if c != "column_name"])


EXACT = {"o_orderkey": "o_orderkey * 1099511627776 + 9007199254740993", "o_totalprice": "CAST(o_totalprice AS DECIMAL(38,10))"}
#: The product as a decimal: keys beyond eight million make it pass a long.
EXACT_SPARK = EXACT | {"o_orderkey": "CAST(o_orderkey AS DECIMAL(20,0)) * 1099511627776 + 9007199254740993"}
RANKS = ("0.25", "0.5", "0.95")


@query("rc15_exact_quantiles", " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, {p}::DOUBLE AS prob, count(*) AS n_values,
 CAST(max(v) FILTER (k = floor({p} * (n - 1))) AS DECIMAL(38,10)) AS low, CAST(max(v) FILTER (k = ceil({p} * (n - 1))) AS DECIMAL(38,10)) AS high
 FROM (SELECT {e} AS v, row_number() OVER (ORDER BY {e}) - 1 AS k, count(*) OVER () AS n FROM orders)"""
    for c, e in EXACT.items() for p in RANKS))
def _(t):
    """Order statistics of whole numbers beyond those that a double tells apart, and of decimals of ten places."""
    return exact_quantiles(t.orders.selectExpr(*[f"{e} AS {c}" for c, e in EXACT_SPARK.items()]), list(EXACT), RANKS).drop("value")


def _cat_side(side, tbl, col):
    return f"""SELECT '{col}' AS column_name, count(DISTINCT {col}) AS {side}_cardinality,
 round(1 - count({col}) / count(*), 4) AS {side}_null_rate,
 (SELECT string_agg(v || '=' || n, ',' ORDER BY n DESC, v) FROM (SELECT {col} AS v, count(*) AS n FROM {tbl} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)) AS {side}_top_5
 FROM {tbl}"""


@query("rc16_stats_categorical", D + f"""
SELECT *, source_cardinality - dest_cardinality AS delta_cardinality, round(source_null_rate - dest_null_rate, 4) AS delta_null_rate
FROM ({_cat_side('source', 'orders', 'o_orderstatus')} UNION ALL {_cat_side('source', 'orders', 'o_orderpriority')}) a
JOIN ({_cat_side('dest', 'orders_dest', 'o_orderstatus')} UNION ALL {_cat_side('dest', 'orders_dest', 'o_orderpriority')}) b USING (column_name)""")
def _(t):
    return st.compare_categorical(t.orders, orders_dest(t), ["o_orderstatus", "o_orderpriority"])


@query("rc17_repair_plan", D + f"""
SELECT o_orderkey, 'insert' AS action, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders s ANTI JOIN orders_dest d USING (o_orderkey)
UNION ALL SELECT o_orderkey, 'delete', NULL, NULL, NULL, NULL, NULL FROM orders_dest d ANTI JOIN orders s USING (o_orderkey)
UNION ALL SELECT s.o_orderkey, 'update', s.o_custkey, s.o_orderstatus, s.o_totalprice, s.o_orderdate, s.o_orderpriority
FROM orders s JOIN orders_dest d ON s.o_orderkey = d.o_orderkey WHERE NOT ({SAME})""")
def _(t):
    return ch.repair_plan(t.orders, orders_dest(t), KEY).drop("copies")


# lineitem by order: most keys are repeated; the destination lost, changed and doubled some lines
LINES = """src AS (SELECT l_orderkey AS k, l_partkey AS p, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
dst AS (SELECT l_orderkey AS k, l_partkey AS p, CAST(l_quantity AS BIGINT) + CASE WHEN l_linenumber = 2 AND l_orderkey % 3 = 0 THEN 1 ELSE 0 END AS q FROM lineitem WHERE l_linenumber <> 3 OR l_orderkey % 2 = 0
 UNION ALL SELECT l_orderkey, l_partkey, CAST(l_quantity AS BIGINT) FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 5 = 0),
img AS (SELECT k, p, q, sum(s) AS s, sum(d) AS d FROM (SELECT *, 1 AS s, 0 AS d FROM src UNION ALL SELECT *, 0, 1 FROM dst) GROUP BY 1, 2, 3),
ks AS (SELECT k, sum(s) AS ns, sum(d) AS nd FROM img GROUP BY 1),
rep AS (SELECT k, CASE WHEN s > d THEN 'insert' ELSE 'delete_copies' END AS action, p, q, CAST(abs(s - d) AS BIGINT) AS copies FROM img JOIN ks USING (k) WHERE s <> d AND (ns > 1 OR nd > 1))"""


def _line_sides(t):
    q = F.col("l_quantity").cast("long")
    src = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p"), q.alias("q"))
    changed = q + F.when((F.col("l_linenumber") == 2) & (F.col("l_orderkey") % 3 == 0), 1).otherwise(0)
    kept = t.lineitem.where("l_linenumber <> 3 OR l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p"), changed.alias("q"))
    twice = t.lineitem.where("l_linenumber = 1 AND l_orderkey % 5 = 0").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p"), q.alias("q"))
    return src, kept.unionByName(twice)


@query("rc03_repeated_keys", f"WITH {LINES} SELECT * FROM rep")
def _(t):
    return rc.repeated_key_changes(*_line_sides(t), ["k"])


@query("rc17_repeated_keys", f"""WITH {LINES} SELECT * FROM rep
UNION ALL SELECT k, 'insert', p, q, 1 FROM img JOIN ks USING (k) WHERE ns = 1 AND nd = 0
UNION ALL SELECT k, 'delete', NULL, NULL, 1 FROM img JOIN ks USING (k) WHERE ns = 0 AND nd = 1
UNION ALL SELECT k, 'update', p, q, 1 FROM img JOIN ks USING (k) WHERE ns = 1 AND nd = 1 AND s = 1 AND d = 0""")
def _(t):
    return ch.repair_plan(*_line_sides(t), ["k"])


@query("rc18_repair_apply", "SELECT * FROM orders")
def _(t):
    return ch.merge(orders_dest(t), t.orders, KEY, delete_missing=True)


def _details(t, run, day, dest=None):
    src = t.orders.withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    dst = (dest or orders_dest(t)).withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    per = rc.narrow_counts(rc.reconcile_keyed(src, dst, ["o_orderkey", "o_orderpriority", "month"], by=["o_orderpriority", "month"]))
    return rc.grouped_details(per, run, day, "o_orderpriority", "month")


def _details_sql(run, day, dest):
    return f"""
SELECT '{run}' AS run_id, schema_name, table_name, source_count, dest_count, dest_count - source_count AS delta_count,
       source_count = dest_count AS match, bad = 0 AS checksum_match, '' AS error, '{day}' AS executed_at
FROM (SELECT coalesce(s.o_orderpriority, d.o_orderpriority) AS schema_name,
             strftime(coalesce(s.o_orderdate, d.o_orderdate), '%Y-%m') AS table_name,
             count(s.o_orderkey) AS source_count, count(d.o_orderkey) AS dest_count,
             count(*) FILTER (WHERE s.o_orderkey IS NULL OR d.o_orderkey IS NULL OR NOT ({SAME})) AS bad
      FROM orders s FULL JOIN {dest} d ON s.o_orderkey = d.o_orderkey GROUP BY 1, 2)"""


@query("rc19_run_details", D + _details_sql("r1", "2024-01-01", "orders_dest"))
def _(t):
    return _details(t, "r1", "2024-01-01")


@query("rc19_run_summary", D + f"""
SELECT run_id, executed_at, count(*) AS total_tables, count(*) FILTER (WHERE match) AS matched,
       count(*) FILTER (WHERE NOT match) AS mismatched, count(*) FILTER (WHERE error <> '') AS errors
FROM ({_details_sql("r1", "2024-01-01", "orders_dest")}) GROUP BY 1, 2""")
def _(t):
    return rc.run_summary(_details(t, "r1", "2024-01-01"))


@query("rc20_compare_runs", D + f""", d2 AS (SELECT * FROM orders_dest WHERE o_orderkey < 1000000000),
a AS ({_details_sql("r1", "2024-01-01", "orders_dest")}), b AS ({_details_sql("r2", "2024-01-02", "d2")})
SELECT schema_name, table_name, a.source_count AS source_count_a, a.dest_count AS dest_count_a, a.delta_count AS delta_count_a,
       a.match AS match_a, b.source_count AS source_count_b, b.dest_count AS dest_count_b, b.delta_count AS delta_count_b, b.match AS match_b,
       CASE WHEN a.match IS NULL THEN 'new' WHEN b.match IS NULL THEN 'gone' WHEN a.match = b.match THEN 'same' WHEN b.match THEN 'fixed' ELSE 'broken' END AS change
FROM a FULL JOIN b USING (schema_name, table_name)""")
def _(t):
    second = orders_dest(t).where("o_orderkey < 1000000000")
    return rc.compare_runs(_details(t, "r1", "2024-01-01"), _details(t, "r2", "2024-01-02", second))


ALERT_RULES = [
    {"rule_id": "low_rate", "metric": "match_rate_pct", "operator": "<", "threshold": 97.0, "severity": "critical"},
    {"rule_id": "missing", "metric": "missing_in_dest", "operator": ">", "threshold": 0},
    {"rule_id": "urgent_only", "metric": "extra_in_dest", "operator": ">=", "threshold": 1, "pair": "1-URGENT"},
]


@query("rc21_alert_rules", D + f", r AS ({PER_PRIORITY})" + """
SELECT o_orderpriority AS pair, 'low_rate' AS rule_id, 'match_rate_pct' AS metric, match_rate_pct::DOUBLE AS actual_value, 97.0::DOUBLE AS threshold, 'critical' AS severity FROM r WHERE match_rate_pct < 97
UNION ALL SELECT o_orderpriority, 'missing', 'missing_in_dest', missing_in_dest, 0, 'warning' FROM r WHERE missing_in_dest > 0
UNION ALL SELECT o_orderpriority, 'urgent_only', 'extra_in_dest', extra_in_dest, 1, 'warning' FROM r WHERE extra_in_dest >= 1 AND o_orderpriority = '1-URGENT'""")
def _(t):
    return rc.evaluate_alerts(_per_priority(t), ALERT_RULES, pair="o_orderpriority")


@query("rc22_row_count_spot_check", D + f"SELECT table_name, source_count, dest_count, dest_count - source_count AS difference FROM {PAIRS} WHERE source_count <> dest_count")
def _(t):
    v = ck.validate_pairs(_pairs(t)).where(~F.col("match"))
    return v.select("table_name", "source_count", "dest_count", (F.col("dest_count") - F.col("source_count")).alias("difference"))


PROPS = """
SELECT {key} AS table_name, 'status_' || o_orderstatus AS key, CAST(sum(CAST(o_totalprice AS DECIMAL(28,4))) AS VARCHAR) AS value FROM {tbl} GROUP BY 1, 2
UNION ALL SELECT {key}, 'delta.rows', CAST(count(*) AS VARCHAR) FROM {tbl} GROUP BY 1, 2"""


@query("rc23_properties_diff", D + f""", a AS ({PROPS.format(key='o_orderpriority', tbl='orders')}), b AS ({PROPS.format(key='o_orderpriority', tbl='orders_dest')})
SELECT table_name, key, a.value AS source_value, b.value AS dest_value FROM (SELECT * FROM a WHERE NOT starts_with(key, 'delta.')) a
FULL JOIN (SELECT * FROM b WHERE NOT starts_with(key, 'delta.')) b USING (table_name, key) WHERE a.value IS DISTINCT FROM b.value""")
def _(t):
    def props(df):
        g = df.groupBy(F.col("o_orderpriority").alias("table_name"), F.concat(F.lit("status_"), "o_orderstatus").alias("key"))
        h = df.groupBy(F.col("o_orderpriority").alias("table_name"))
        return union_all([
            g.agg(F.sum(F.col("o_totalprice").cast("decimal(28,4)")).cast("string").alias("value")),
            h.agg(F.count(F.lit(1)).cast("string").alias("value")).withColumn("key", F.lit("delta.rows"))])

    return ck.properties_diff(props(t.orders), props(orders_dest(t)))
