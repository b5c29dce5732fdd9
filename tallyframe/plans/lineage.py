"""Lineage graphs derived from orders, lineitem and the query log."""

from pyspark.sql import functions as F

from tallyframe.operators import graph as g
from tallyframe.plans.fixtures import dependency_edges, query_log, with_ctes
from tallyframe.plans.registry import query

E = with_ctes("edges")
ER = with_ctes("edges", recursive=True)


@query("lg01_table_references", with_ctes("query_log") + """
SELECT ref, count(*) AS n FROM (SELECT unnest(['main.sales.' || regexp_extract(statement_text, 'FROM main.sales.([a-z]+)', 1), 'hub.main.sales', 'hub.dim.' || regexp_extract(statement_text, '`(users_[0-9]+)`', 1)]) AS ref FROM query_log) GROUP BY 1""")
def _(t):
    return query_log(t).select(F.explode(g.table_references(F.col("statement_text"), "hub")).alias("ref")).groupBy("ref").agg(F.count(F.lit(1)).alias("n"))


@query("lg02_dependency_graph", E + """
SELECT node, CAST(sum(u) AS BIGINT) AS n_dependants, CAST(sum(s) AS BIGINT) AS n_dependencies, CASE WHEN sum(s) = 0 THEN 'root' WHEN sum(u) = 0 THEN 'leaf' ELSE 'inner' END AS role
FROM (SELECT src AS node, 1 AS u, 0 AS s FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY 1""")
def _(t):
    return g.node_roles(dependency_edges(t))


@query("lg02_edges_from_views", with_ctes("query_log") + """
SELECT DISTINCT src, user_name AS dst FROM (SELECT user_name, unnest(['main.sales.' || regexp_extract(statement_text, 'FROM main.sales.([a-z]+)', 1), 'hub.main.sales', 'hub.dim.' || regexp_extract(statement_text, '`(users_[0-9]+)`', 1)]) AS src FROM query_log)""")
def _(t):
    return g.edges_from_definitions(query_log(t), "user_name", "statement_text", "hub")


WALK = """down AS (SELECT src, dst, 1 AS hop FROM edges WHERE src = 7 UNION SELECT e.src, e.dst, d.hop + 1 FROM edges e JOIN down d ON e.src = d.dst WHERE d.hop < 5),
up AS (SELECT src, dst, 1 AS hop FROM edges WHERE dst = 900 UNION SELECT e.src, e.dst, u.hop + 1 FROM edges e JOIN up u ON e.dst = u.src WHERE u.hop < 5)"""


@query("lg03_multi_hop", ER + f", {WALK} SELECT src, dst, min(hop) AS hop, 'downstream' AS direction FROM down GROUP BY 1, 2 UNION ALL SELECT src, dst, min(hop), 'upstream' FROM up GROUP BY 1, 2")
def _(t):
    e = dependency_edges(t)
    node = lambda k: t.orders.where(F.col("o_custkey") == k).select(F.col("o_custkey").alias("node"))
    return g.reachable(e, node(7), 5, "downstream").unionByName(g.reachable(e, node(900), 5, "upstream"))


@query("lg03_lineage_in_period", """
WITH RECURSIVE t AS (SELECT o_custkey // 2 AS src, o_custkey AS dst FROM orders WHERE o_custkey > 0 AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-07-01'), e AS (SELECT DISTINCT src, dst FROM t),
down AS (SELECT src, dst, 1 AS hop FROM e WHERE src = 40 UNION SELECT e.src, e.dst, d.hop + 1 FROM e JOIN down d ON e.src = d.dst WHERE d.hop < 3),
up AS (SELECT src, dst, 1 AS hop FROM e WHERE dst = 40 UNION SELECT e.src, e.dst, u.hop + 1 FROM e JOIN up u ON e.dst = u.src WHERE u.hop < 3)
SELECT src, dst, min(hop) AS hop, 'downstream' AS direction FROM down GROUP BY 1, 2 UNION ALL SELECT src, dst, min(hop), 'upstream' FROM up GROUP BY 1, 2""")
def _(t):
    e = t.orders.where("o_custkey > 0").select(F.floor(F.col("o_custkey") / 2).alias("src"), F.col("o_custkey").alias("dst"), "o_orderdate")
    start = t.customer.where("c_custkey = 40").select(F.col("c_custkey").alias("node"))
    return g.lineage(e, start, 3, "o_orderdate", "1996-01-01", "1998-06-30")


@query("lg04_topological_levels", ER + """, lv AS (SELECT DISTINCT src AS node, 0 AS level FROM edges WHERE src NOT IN (SELECT dst FROM edges)
 UNION SELECT e.dst, l.level + 1 FROM edges e JOIN lv l ON e.src = l.node)
SELECT node, max(level) AS level, false AS on_cycle FROM lv GROUP BY 1""")
def _(t):
    return g.topological_levels(dependency_edges(t))


@query("lg04_cycles", """
WITH RECURSIVE e AS (SELECT DISTINCT s_nationkey // 2 AS src, s_nationkey AS dst FROM supplier WHERE s_nationkey > 0 UNION SELECT 9, 4 FROM supplier),
lv AS (SELECT DISTINCT src AS node, 0 AS level FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT e.dst, l.level + 1 FROM e JOIN lv l ON e.src = l.node WHERE l.level < 40),
bad AS (SELECT DISTINCT node FROM lv WHERE level >= 30), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
after AS (SELECT node FROM bad UNION SELECT e.dst FROM e JOIN after a ON e.src = a.node)
SELECT n.node, CASE WHEN n.node IN (SELECT node FROM after) THEN NULL ELSE max(level) END AS level, n.node IN (SELECT node FROM after) AS on_cycle FROM n LEFT JOIN lv USING (node) GROUP BY n.node""")
def _(t):
    k = F.col("s_nationkey")
    e = t.supplier.where("s_nationkey > 0").select(F.floor(k / 2).cast("int").alias("src"), k.alias("dst")).unionByName(
        t.supplier.select(F.lit(9).alias("src"), F.lit(4).alias("dst")))
    return g.topological_levels(e)


@query("lg05_column_lineage", """
SELECT 'p' || l_partkey % 50 AS source_table, l_returnflag AS source_column, count(*) AS usage_count, count(DISTINCT (l_suppkey, l_linestatus)) AS downstream_count, strftime(max(l_shipdate), '%Y-%m-%d') AS last_used
FROM lineitem GROUP BY 1, 2""")
def _(t):
    rows = t.lineitem.select(F.concat(F.lit("p"), F.col("l_partkey") % 50).alias("source_table"), F.col("l_returnflag").alias("source_column"), F.col("l_suppkey").alias("target_table"),
                             F.col("l_linestatus").alias("target_column"), F.col("l_shipdate").alias("used_at"))
    return g.column_usage(rows).withColumn("last_used", F.date_format("last_used", "yyyy-MM-dd"))


@query("lg06_impact", E + """, k AS (SELECT c_custkey AS node, CASE WHEN c_custkey % 3 = 0 THEN 'view' WHEN c_custkey % 3 = 1 THEN 'job' ELSE 'function' END AS kind FROM customer),
p AS (SELECT src, kind, count(*) AS n FROM edges JOIN k ON dst = node GROUP BY 1, 2), q AS (SELECT src AS node, CAST(sum(n) AS BIGINT) AS n_dependants, string_agg(kind || '=' || n, ',' ORDER BY kind) AS by_kind FROM p GROUP BY 1)
SELECT node, coalesce(n_dependants, 0) AS n_dependants, coalesce(by_kind, '') AS by_kind, CASE WHEN n_dependants IS NULL THEN 'low' WHEN n_dependants <= 3 THEN 'medium' ELSE 'high' END AS risk FROM k LEFT JOIN q USING (node)""")
def _(t):
    m = F.col("c_custkey") % 3
    kinds = t.customer.select(F.col("c_custkey").alias("node"), F.when(m == 0, "view").when(m == 1, "job").otherwise("function").alias("kind"))
    return g.impact(dependency_edges(t), kinds, 3)


@query("lg07_clone_lineage", "SELECT l_orderkey, l_linenumber, 'p' || l_partkey AS source_name, 's' || l_suppkey AS dest_name FROM lineitem WHERE l_partkey = 77 OR l_suppkey = 77")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.concat(F.lit("p"), "l_partkey").alias("source_name"), F.concat(F.lit("s"), "l_suppkey").alias("dest_name"))
    return g.lookup(rows, "p77", "source_name", "dest_name").unionByName(g.lookup(rows, "s77", "source_name", "dest_name").where("source_name <> 'p77'"))


@query("st05_dependency_order", ER + """, lv AS (SELECT DISTINCT src AS node, 0 AS level FROM edges WHERE src NOT IN (SELECT dst FROM edges) UNION SELECT e.dst, l.level + 1 FROM edges e JOIN lv l ON e.src = l.node),
m AS (SELECT node, max(level) AS level FROM lv GROUP BY 1) SELECT e.src, e.dst, a.level < b.level AS in_order FROM edges e JOIN m a ON e.src = a.node JOIN m b ON e.dst = b.node""")
def _(t):
    e = dependency_edges(t)
    lv = g.topological_levels(e).select("node", "level")
    a, b = lv.select(F.col("node").alias("src"), F.col("level").alias("l1")), lv.select(F.col("node").alias("dst"), F.col("level").alias("l2"))
    return e.join(a, "src").join(b, "dst").select("src", "dst", (F.col("l1") < F.col("l2")).alias("in_order"))
