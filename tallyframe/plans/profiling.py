"""Profiles of the given tables."""

from pyspark.sql import functions as F

from tallyframe.operators import profile as pr
from tallyframe.operators import profilestate as ps
from tallyframe.plans.fixtures import orders_dest, with_ctes
from tallyframe.plans.registry import query
from tallyframe.sources.tables import sql_source

NUM = ("l_quantity", "l_extendedprice", "l_discount")
TXT = ("l_returnflag", "l_linestatus")
DAY = ("l_shipdate",)


def profile_sql(table, num=(), txt=(), day=(), where=""):
    parts = []
    for c in (*num, *txt, *day):
        n, x, d = c in num, c in txt, c in day
        lo = f"CAST(min({c})::DOUBLE AS VARCHAR)" if n else (f"strftime(min({c}), '%Y-%m-%d %H:%M:%S')" if d else "NULL::VARCHAR")
        hi = lo.replace("min(", "max(")
        parts.append(f"""SELECT '{c}' AS column_name, count(*) AS total_rows, count(*) - count({c}) AS null_count,
 round((count(*) - count({c})) * 100.0 / count(*), 2) AS null_pct, count(DISTINCT {c}) AS distinct_count,
 round(count(DISTINCT {c}) * 100.0 / count(*), 2) AS distinct_pct, {lo} AS min_value, {hi} AS max_value,
 {f'round(avg({c}), 4)' if n else 'NULL::DOUBLE'} AS avg_value, {f'min(length({c}))' if x else 'NULL::BIGINT'} AS min_length,
 {f'max(length({c}))' if x else 'NULL::BIGINT'} AS max_length, {f'round(avg(length({c})), 4)' if x else 'NULL::DOUBLE'} AS avg_length
 FROM {table} {where}""")
    return " UNION ALL ".join(parts)


@query("pr01_column_profile", profile_sql("lineitem", NUM, TXT, DAY))
def _(t):
    return pr.profile(t.lineitem, [*NUM, *TXT, *DAY])


@query("pr01_column_profile_approx", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count, true AS within_bound FROM lineitem" for c in [*NUM, *TXT, *DAY]))
def _(t):
    """Approximate distinct counts lie within three standard errors (of 5 %) of the exact ones."""
    cols = [*NUM, *TXT, *DAY]
    a = pr.profile(t.lineitem, cols, distinct="approx").select("column_name", "null_count", F.col("distinct_count").alias("approx"))
    e = pr.profile(t.lineitem, cols).select("column_name", "distinct_count")
    return a.join(e, "column_name").select("column_name", "null_count", (F.abs(F.col("approx") - F.col("distinct_count")) <= 0.15 * F.col("distinct_count")).alias("within_bound"))


def _merged_sql():
    """Exact figures of one quarter; the estimates of the merged states must lie within their bounds."""
    parts = []
    for c, num in (("o_custkey", True), ("o_totalprice", True), ("o_orderpriority", False)):
        value = (lambda f: f"CAST({f}({c}) AS DOUBLE)") if num else (lambda f: "NULL::DOUBLE")
        length = (lambda f: "NULL::BIGINT") if num else (lambda f: f"{f}(length({c}))")
        parts.append(f"""SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS null_count, {value('min')} AS min_number,
 {value('max')} AS max_number, {length('min')} AS min_length, {length('max')} AS max_length, true AS distinct_within, {'true' if num else 'NULL::BOOLEAN'} AS median_within
 FROM orders WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1995-04-01'""")
    return " UNION ALL ".join(parts)


@query("pr01_profile_from_states", _merged_sql())
def _(t):
    """Profile of a quarter from the states of its days; distinct values and medians are compared with exact ones."""
    cols = ["o_custkey", "o_totalprice", "o_orderpriority"]
    days = ps.profile_state(t.orders.withColumn("day", F.to_date("o_orderdate")), ["day"], cols)
    span = days.where("day >= DATE '1995-01-01' AND day < DATE '1995-04-01'")
    merged = ps.merge_states(span)
    p = ps.profile_of(merged).join(merged.select("column_name", "min_number", "max_number"), "column_name")
    rows = t.orders.where("o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1995-04-01'")
    exact = pr.distinct_counts(rows, cols)
    medians = p.where("p50 IS NOT NULL").select("column_name", "p50")
    values = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in cols[:2]])).alias("x")).select("x.*")
    # The median's ranks: from those below it to those up to it.
    ranks = values.join(medians, "column_name").groupBy("column_name").agg(
        F.avg((F.col("v") < F.col("p50")).cast("int")).alias("below"), F.avg((F.col("v") <= F.col("p50")).cast("int")).alias("upto"))
    return p.join(exact, "column_name").join(ranks, "column_name", "left").select(
        "column_name", "n_rows", "null_count", "min_number", "max_number", "min_length", "max_length",
        (F.abs(F.col("distinct_estimate") - F.col("distinct_count")) <= F.greatest(F.lit(1.0), ps.DISTINCT_BOUND * F.col("distinct_count"))).alias("distinct_within"),
        ((F.col("below") <= 0.5 + ps.RANK_BOUND) & (F.col("upto") >= 0.5 - ps.RANK_BOUND)).alias("median_within"))


def top_sql(table, cols, n, max_numeric=None):
    out = []
    for c in cols:
        lim = f"WHERE (SELECT count(DISTINCT {c}) FROM {table}) <= {max_numeric}" if max_numeric else ""
        out.append(f"""SELECT * FROM (SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS freq,
 round(count(*) * 100.0 / (SELECT count(*) FROM {table}), 2) AS pct FROM {table} WHERE {c} IS NOT NULL GROUP BY ALL ORDER BY freq DESC, value LIMIT {n}) {lim}""")
    return " UNION ALL ".join(f"({x})" for x in out)


@query("pr02_deep_profile_histograms", " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, CAST(floor(({c} - lo) / ((hi + 0.0001 - lo) / 20)) + 1 AS BIGINT) AS bucket, count(*) AS freq,
 min({c})::DOUBLE AS bucket_min, max({c})::DOUBLE AS bucket_max FROM lineitem, (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM lineitem) GROUP BY ALL"""
    for c in ("l_quantity", "l_extendedprice", "l_discount")))
def _(t):
    return pr.deep_profile(t.lineitem, NUM, bins=20)["histograms"]


@query("pr02_deep_profile_top_values", top_sql("orders", ["o_orderstatus", "o_orderpriority"], 10))
def _(t):
    return pr.deep_profile(t.orders, ["o_orderstatus", "o_orderpriority", "o_totalprice"], max_numeric_distinct=30)["top_values"]


@query("pr03_numeric_top_values", top_sql("part", ["p_size", "p_partkey"], 10, 30) + " UNION ALL " + top_sql("part", ["p_brand"], 10))
def _(t):
    return pr.top_values(t.part, ["p_size", "p_partkey", "p_brand"], 10, 30)


@query("pr03_small_domain_top_values", top_sql("lineitem", ["l_linenumber"], 5, 30) + " UNION ALL " + top_sql("lineitem", ["l_suppkey"], 5, 30))
def _(t):
    return pr.top_values(t.lineitem, ["l_linenumber", "l_suppkey"], 5, 30)


@query("pr04_query_profile", profile_sql("(SELECT user_id, event_type, sum(value)::DECIMAL(18,2)::DOUBLE AS total FROM (SELECT user_id, event_type, value::DECIMAL(28,4) AS value FROM events) GROUP BY 1, 2)",
                                         ["total", "user_id"], ["event_type"]))
def _(t):
    q = sql_source(t.spark, "SELECT user_id, event_type, CAST(CAST(sum(CAST(value AS DECIMAL(28,4))) AS DECIMAL(18,2)) AS DOUBLE) AS total "
                            "FROM {ev} GROUP BY user_id, event_type", ev=t.events)
    return pr.profile(q)


@query("pr05_multi_table_profile", " UNION ALL ".join(
    f"SELECT *, '{n}' AS table_name, null_pct > 50 AS high_null FROM ({profile_sql(f, num, txt)})" for n, f, num, txt in (
        ("customer", "(SELECT c_custkey, CASE WHEN c_acctbal > 8000 THEN c_acctbal END AS rich, c_mktsegment FROM customer)", ["c_custkey", "rich"], ["c_mktsegment"]),
        ("supplier", "supplier", ["s_suppkey", "s_nationkey", "s_acctbal"], ["s_name"]))))
def _(t):
    c = t.customer.select("c_custkey", F.when(F.col("c_acctbal") > 8000, F.col("c_acctbal")).alias("rich"), "c_mktsegment")
    return pr.profile_tables({"customer": c, "supplier": t.supplier})


RANGE = """SELECT '{c}' AS column_name, 'is_in_range' AS rule, CAST(min({c})::DOUBLE AS VARCHAR) || ',' || CAST(max({c})::DOUBLE AS VARCHAR) AS arguments
FROM part, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM part) WHERE abs({c} - m) <= 3 * s"""


@query("pr06_rule_suggestion", """
SELECT c AS column_name, 'is_not_null' AS rule, NULL AS arguments FROM (VALUES ('p_partkey'), ('p_type'), ('p_size')) v(c)
UNION ALL SELECT 'p_partkey', 'is_unique', NULL FROM part HAVING count(DISTINCT p_partkey) = count(*)
UNION ALL SELECT 'p_type', 'is_in_list', string_agg(DISTINCT p_type, ',' ORDER BY p_type) FROM part HAVING count(DISTINCT p_type) <= 10
UNION ALL """ + RANGE.format(c="p_partkey") + " UNION ALL " + RANGE.format(c="p_size"))
def _(t):
    return pr.suggest_rules(t.part, ["p_partkey", "p_type", "p_size"], sample_fraction=1.0)


SIZES = {
    "orders": ("sales", "8 + 8 + strlen(o_orderstatus) + 8 + 8 + strlen(o_orderpriority)", 6),
    "customer": ("sales", "8 + strlen(c_name) + 4 + 8 + strlen(c_mktsegment)", 5),
    "events": ("web", "8 + 8 + 8 + strlen(event_type) + 8 + strlen(props)", 6),
    "documents": ("web", "8 + strlen(text) + strlen(lang) + strlen(source) + 8", 5),
}
STATS_SQL = " UNION ALL ".join(
    f"SELECT '{s}' AS table_schema, '{n}' AS table_name, count(*) AS n_rows, CAST(sum({e}) AS BIGINT) AS n_bytes, {k} AS n_columns FROM {n}"
    for n, (s, e, k) in SIZES.items())


@query("pr07_catalog_stats", STATS_SQL)
def _(t):
    return pr.catalog_stats({n: (s, getattr(t, n)) for n, (s, _, _) in SIZES.items()})


@query("pr07_schema_rollup", f"""SELECT table_schema, count(*) AS n_tables, CAST(sum(n_rows) AS BIGINT) AS n_rows, CAST(sum(n_bytes) AS BIGINT) AS n_bytes,
 CAST(sum(n_columns) AS BIGINT) AS n_columns FROM ({STATS_SQL}) GROUP BY 1""")
def _(t):
    return pr.schema_rollup(pr.catalog_stats({n: (s, getattr(t, n)) for n, (s, _, _) in SIZES.items()}))


def _metrics(tbl, c, num):
    avg = f"round(avg({c}), 4)" if num else "NULL::DOUBLE"
    return f"""SELECT '{c}' AS column_name, unnest(['null_pct', 'distinct_count', 'avg_value']) AS metric,
 unnest([round((count(*) - count({c})) * 100.0 / count(*), 2), count(DISTINCT {c})::DOUBLE, {avg}]) AS v FROM {tbl}"""


COLS = (("o_totalprice", True), ("o_orderstatus", False), ("o_custkey", True))


@query("pr08_compare_profiles", with_ctes("orders_dest") + f""",
a AS ({' UNION ALL '.join(_metrics('orders', c, n) for c, n in COLS)}), b AS ({' UNION ALL '.join(_metrics('orders_dest', c, n) for c, n in COLS)})
SELECT column_name, metric, a.v AS source_value, b.v AS dest_value, round(b.v - a.v, 4) AS difference FROM a FULL JOIN b USING (column_name, metric)""")
def _(t):
    cols = [c for c, _ in COLS]
    return pr.compare_profiles(pr.profile(t.orders, cols), pr.profile(orders_dest(t), cols))
