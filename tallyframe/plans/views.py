"""Synthetic data, layers, view shapes and business functions over the given tables."""

from pyspark.sql import functions as F

from tallyframe.common import exact_sum
from tallyframe.functions import business as B
from tallyframe.functions import validators as V
from tallyframe.operators import datagen as dg
from tallyframe.operators import views as vw
from tallyframe.plans.fixtures import persons, with_ctes
from tallyframe.plans.registry import query

DEC = "CAST(sum(CAST({} AS DECIMAL(28,4))) AS DOUBLE)"


def hup(expr, n):
    """SQL rounding half up on the shortest decimal form of a double, as Spark rounds."""
    return f"CAST(round(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38,16)), {n}) AS DOUBLE)"


def h(name, ident="id"):
    return f"CAST(('0x' || substr(md5('{name}:' || {ident}), 1, 8)) AS BIGINT)"


SPEC = {"status": dg.Choice(["active", "closed", "open"]), "amount": dg.Number(10, 500, 2), "day": dg.Day("2020-01-01", 730), "parent_id": dg.ForeignKey(5000, 0.1)}
GEN = f"""gen AS (SELECT id, ['active', 'closed', 'open'][({h('status')} % 3 + 1)::INT] AS status, round(10 + ({h('amount')} % 49001) / 100, 2) AS amount, strftime(DATE '2020-01-01' + ({h('day')} % 730)::INT, '%Y-%m-%d') AS day,
 {h('parent_id')} % 500 + 1 AS parent_id FROM (SELECT o_orderkey + 1000 AS id FROM orders))"""


def generated(t):
    ids = t.orders.select(F.col("o_orderkey").alias("id"))
    return dg.generate(ids, SPEC, offset=1000)


@query("mg01_generate_table", f"WITH {GEN} SELECT * FROM gen")
def _(t):
    return generated(t).withColumn("day", F.col("day").cast("string"))


@query("mg02_referential_integrity", f"WITH {GEN} SELECT count(*) AS n_rows, count(DISTINCT parent_id) AS parents_used, count(*) FILTER (WHERE parent_id NOT BETWEEN 1 AND 500) AS orphans FROM gen")
def _(t):
    from tallyframe.operators.relational import orphans

    g = generated(t)
    parents = dg.row_ids(t.spark, 5000, 0.1).select(F.col("id").alias("pid"))
    bad = orphans(g, "parent_id", parents, "pid").agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n")).scalar()
    return g.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("parent_id").alias("parents_used")).withColumn("orphans", bad)


ISSUES = f"""iss AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN {h('null', '(l_orderkey * 10 + l_linenumber)')} % 100 <> 0 THEN l_returnflag END AS flag,
 CASE WHEN {h('outlier', '(l_orderkey * 10 + l_linenumber)')} % 1000 = 0 THEN l_quantity * 1000 ELSE l_quantity END AS qty, {h('copy', '(l_orderkey * 10 + l_linenumber)')} AS c FROM lineitem)"""


@query("mg03_inject_issues", f"WITH {ISSUES} SELECT count(*) + 100 AS n_rows, count(DISTINCT id) AS n_ids, count(*) FILTER (WHERE flag IS NULL) + (SELECT count(*) FROM (SELECT flag FROM iss ORDER BY c, id, flag, qty LIMIT 100) WHERE flag IS NULL) AS nulls, "
                             f"count(*) FILTER (WHERE qty >= 1000) + (SELECT count(*) FROM (SELECT qty FROM iss ORDER BY c, id, flag, qty LIMIT 100) WHERE qty >= 1000) AS outliers FROM iss")
def _(t):
    df = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("qty"))
    d = dg.inject_issues(df, "id", "flag", "qty")
    return d.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_ids"), F.count_if(F.col("flag").isNull()).alias("nulls"), F.count_if(F.col("qty") >= 1000).alias("outliers"))


@query("mg04_seasonality", f"""
WITH m AS (SELECT o_orderdate, o_orderkey, month(o_orderdate) AS mo, {h('season', 'o_orderkey')} % 100 AS s, {h('month', 'o_orderkey')} % 6 AS x FROM orders)
SELECT strftime(d, '%Y-%m') AS month, count(*) AS n FROM (SELECT o_orderdate AS d FROM m UNION ALL SELECT CAST(o_orderdate AS DATE) + to_months((10 + x - mo)::INT) FROM m WHERE mo BETWEEN 4 AND 9 AND s < 15) GROUP BY 1""")
def _(t):
    d = dg.add_season(t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("d")), "o_orderkey", "d", 10, 3)
    return d.groupBy(F.date_format("d", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def raw_orders(t):
    """Orders as text, some twice with a later load, some without a key or with a broken price."""
    k = F.col("o_orderkey")
    first = t.orders.select(F.when(k % 50 != 0, k.cast("string")).alias("k"), F.when(k % 17 == 0, "n/a").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("price"), F.lit(1).alias("load"))
    again = t.orders.where(k % 5 == 0).select(k.cast("string").alias("k"), F.lit("1.50").alias("price"), F.lit(2).alias("load"))
    return first.unionByName(again)


@query("mg05_bronze", "SELECT o_orderkey, '2024-01-01 00:00:00' AS loaded, length(md5('x')) AS id_length FROM orders")
def _(t):
    b = dg.bronze(t.orders, F.input_file_name(), "2024-01-01")
    return b.where("_source_file <> ''").select("o_orderkey", F.date_format("_ingested_at", "yyyy-MM-dd HH:mm:ss").alias("loaded"), F.length("_raw_id").cast("long").alias("id_length"))


@query("mg06_silver", """
SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 1.5 WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END AS load FROM orders""")
def _(t):
    b = dg.bronze(raw_orders(t), F.lit("raw"), "2024-01-01")
    return dg.silver(b, "k", "load", {"k": "bigint", "price": "double"})


@query("mg07_gold", f"SELECT n_name, c_mktsegment, count(*) AS customers, {DEC.format('c_acctbal')} AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def _(t):
    return vw.summary(vw.enrich(t.customer, t.nation, "c_nationkey", "n_nationkey"), ["n_name", "c_mktsegment"], [F.count(F.lit(1)).alias("customers"), exact_sum("c_acctbal").alias("balance")])


@query("mg08_cross_domain", """
SELECT c.c_custkey, coalesce(o.n, 0) AS orders, coalesce(e.n, 0) AS events FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) e ON user_id = c_custkey""")
def _(t):
    return vw.counts_per_entity(t.customer.select("c_custkey"), "c_custkey", {"orders": (t.orders, "o_custkey", F.col("o_orderkey")), "events": (t.events, "user_id", F.col("event_id"))})


@query("mg09_version_history", " UNION ALL ".join(f"""SELECT '{kind}' AS _change_type, {v}::BIGINT AS _commit_version, '2024-01-0{v}' AS day, count(*) AS n, CAST(sum(CAST(p_retailprice{inc} AS DECIMAL(28,4))) AS DOUBLE) AS total FROM part WHERE {h(f'v{v}', 'p_partkey')} % 100 < 20"""
                                                  for v in (1, 2, 3) for kind, inc in (("update_preimage", ""), ("update_postimage", " + 1"))))
def _(t):
    ch = dg.version_history(t.part.select("p_partkey", "p_retailprice"), "p_partkey", {"p_retailprice": F.col("p_retailprice") + 1}, 3, 20, "2024-01-01")
    return ch.groupBy("_change_type", "_commit_version", F.date_format("_commit_timestamp", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), exact_sum("p_retailprice").alias("total"))


# ---- view shapes -------------------------------------------------------------------------------


@query("mv01_filter_group", f"SELECT l_returnflag, l_linestatus, count(*) AS n, {DEC.format('l_extendedprice')} AS total FROM lineitem WHERE l_quantity > 30 GROUP BY 1, 2")
def _(t):
    return vw.summary(t.lineitem, ["l_returnflag", "l_linestatus"], [F.count(F.lit(1)).alias("n"), exact_sum("l_extendedprice").alias("total")], F.col("l_quantity") > 30)


@query("mv02_join_group", f"SELECT p_type, s_nationkey, count(*) AS n, {DEC.format('l_quantity')} AS qty FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2")
def _(t):
    f = t.lineitem.select("l_partkey", "l_suppkey", "l_quantity")
    pre = f.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("decimal(28,4)")).alias("q"))
    j = pre.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey").join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    return j.groupBy("p_type", "s_nationkey").agg(F.sum("n").alias("n"), F.sum("q").cast("double").alias("qty"))


@query("mv03_star_counts", """SELECT c_custkey, count(DISTINCT o_orderkey) AS orders, count(DISTINCT o_orderpriority) AS priorities, count(DISTINCT event_type) AS event_types FROM customer
LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN (SELECT DISTINCT user_id, event_type FROM events) ON user_id = c_custkey GROUP BY 1""")
def _(t):
    return vw.counts_per_entity(t.customer.select("c_custkey"), "c_custkey", {
        "orders": (t.orders, "o_custkey", F.col("o_orderkey")), "priorities": (t.orders, "o_custkey", F.col("o_orderpriority")), "event_types": (t.events, "user_id", F.col("event_type"))})


@query("mv04_trend", f"SELECT strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS period, o_orderstatus, count(*) AS n, {DEC.format('o_totalprice')} AS total FROM orders GROUP BY 1, 2")
def _(t):
    return vw.trend(t.orders, "o_orderdate", "quarter", ["o_orderstatus"], [F.count(F.lit(1)).alias("n"), exact_sum("o_totalprice").alias("total")])


@query("mv05_having", f"SELECT o_custkey, count(*) AS n, {DEC.format('o_totalprice')} AS total FROM orders GROUP BY 1 HAVING {DEC.format('o_totalprice')} > 3000000")
def _(t):
    return vw.summary(t.orders, ["o_custkey"], [F.count(F.lit(1)).alias("n"), exact_sum("o_totalprice").alias("total")], having=F.col("total") > 3000000)


@query("mv06_windowed", f"SELECT *, total - lag(total) OVER (PARTITION BY o_orderstatus ORDER BY period) AS change FROM (SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS period, o_orderstatus, count(*)::DOUBLE AS total FROM orders GROUP BY 1, 2)")
def _(t):
    from tallyframe.operators.relational import previous

    tr = vw.trend(t.orders, "o_orderdate", "month", ["o_orderstatus"], [F.count(F.lit(1)).cast("double").alias("total")])
    return previous(tr, ["o_orderstatus"], "period", "total", "p").select("period", "o_orderstatus", "total", (F.col("total") - F.col("p")).alias("change"))


@query("mv07_conditional_rate", "SELECT l_suppkey, round(count(*) FILTER (WHERE l_returnflag = 'R') * 100.0 / count(*), 2) AS return_rate, round(count(*) FILTER (WHERE l_linestatus = 'F') * 100.0 / count(*), 2) AS done_rate FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_suppkey").agg(vw.rate(F.col("l_returnflag") == "R").alias("return_rate"), vw.rate(F.col("l_linestatus") == "F").alias("done_rate"))


@query("mv08_ratio_of_sums", f"SELECT p_brand, round({DEC.format('l_extendedprice * l_discount')} * 100 / greatest({DEC.format('l_extendedprice')}, 1), 2) AS discount_share FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def _(t):
    j = vw.enrich(t.lineitem.select("l_partkey", "l_extendedprice", "l_discount"), t.part.select("p_partkey", "p_brand"), "l_partkey", "p_partkey")
    return j.groupBy("p_brand").agg(vw.ratio_of_sums(F.col("l_extendedprice") * F.col("l_discount"), F.col("l_extendedprice")).alias("discount_share"))


@query("mv09_detail_list", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' AND o_totalprice > 400000 ORDER BY o_totalprice DESC, o_orderkey")
def _(t):
    late = t.orders.where("o_orderstatus = 'P' AND o_totalprice > 400000")
    return vw.enrich(late, t.customer, "o_custkey", "c_custkey").select("o_orderkey", "c_name", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")


# ---- functions ---------------------------------------------------------------------------------

W = with_ctes("persons")


@query("fn01_masks", W + """SELECT c_custkey, '***-**-' || right(ssn, 4) AS ssn, left(email, 2) || '***@' || split_part(email, '@', 2) AS email, '***-***-' || right(phone, 4) AS phone, '****-****-****-' || right(credit_card, 4) AS card,
 '*****' || right(iban, 4) AS imei, '***' || right(remark, 3) AS plate, left(remark, 4) || '*** ' || split_part(remark, ' ', -1) AS address FROM persons""")
def _(t):
    c = F.col
    return persons(t).select("c_custkey", B.mask_tail(c("ssn"), "ssn").alias("ssn"), B.mask_email(c("email")).alias("email"), B.mask_tail(c("phone"), "phone").alias("phone"), B.mask_tail(c("credit_card"), "card").alias("card"),
                             B.mask_tail(c("iban"), "imei").alias("imei"), B.mask_tail(c("remark"), "plate").alias("plate"), B.mask_address(c("remark")).alias("address"))


@query("fn02_anonymous_ids", "SELECT c_custkey, 'PAT-' || substr(sha256(c_custkey::VARCHAR), 1, 12) AS patient, 'CUST-' || substr(sha256(c_name || c_custkey), 1, 10) AS customer, left(c_name, 1) || '.' || left(c_mktsegment, 1) || '.' || substr(sha256(c_name || c_mktsegment), 1, 6) AS name FROM customer")
def _(t):
    c = F.col
    return t.customer.select("c_custkey", B.anonymous_id("patient", c("c_custkey")).alias("patient"), B.anonymous_id("customer", c("c_name"), c("c_custkey")).alias("customer"), B.anonymous_name(c("c_name"), c("c_mktsegment")).alias("name"))


def band_sql(c, name):
    rows, default = (B.AT_LEAST | B.ABOVE | B.BELOW)[name]
    op = ">=" if name in B.AT_LEAST else ">" if name in B.ABOVE else "<"
    return "CASE " + " ".join(f"WHEN {c} {op} {b} THEN '{x}'" for b, x in rows) + f" ELSE '{default}' END"


BANDS = {n: f"(l_extendedprice / {d})" for n, d in (
    ("risk_score", 1000), ("credit_score", 100), ("churn_risk", 100000), ("signal_quality", 20000), ("environmental_rating", 900), ("voltage_level", 200), ("capacity_factor", 1000), ("academic_standing", 25000), ("credit_hours", 700),
    ("donation_tier", 8), ("school_rating", 9000), ("walkability", 1000), ("insurance_fraud", 1000), ("catastrophe", 0.000002), ("sentiment", 20000), ("event_size", 15), ("claim_severity", 6), ("claim_severity_insurance", 0.7),
    ("encounter_duration", 600), ("bmi", 2500), ("spectrum_band", 12), ("market_status", 800))}


@query("fn03_bands", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"{band_sql(e, n)} AS {n}" for n, e in BANDS.items()) + " FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", *[B.band(F.expr(e), n).alias(n) for n, e in BANDS.items()])


KEYS = ["default", "delinquent", "platinum", "gold", "overdue", "critical", "rate_filing", "SAR", "II", "morning", "solar", "Professor", "same_day", "other"]


def label_sql(c, name):
    m, d = B.LABELS[name]
    q = lambda x: f"'{x}'" if isinstance(x, str) else x
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {q(v)}" for k, v in m.items()) + f" ELSE {q(d)} END"


@query("fn04_labels", f"SELECT o_orderkey, {', '.join(f'{label_sql("v", n)} AS {n}' for n in B.LABELS)}, initcap_words AS title FROM (SELECT o_orderkey, {KEYS}[(o_orderkey % 14 + 1)::INT] AS v, CASE o_orderkey % 2 WHEN 0 THEN 'In Transit' ELSE 'Delivered' END AS initcap_words FROM orders)")
def _(t):
    v = F.element_at(F.array(*[F.lit(x) for x in KEYS]), (F.col("o_orderkey") % 14 + 1).cast("int"))
    raw = F.when(F.col("o_orderkey") % 2 == 0, "in_transit").otherwise("delivered")
    return t.orders.select("o_orderkey", *[B.label(v, n).alias(n) for n in B.LABELS], B.title_label(raw).alias("title"))


@query("fn05_formats", """SELECT l_orderkey, l_linenumber, '$' || format('{:,.2f}', l_extendedprice) AS price, lpad((s // 3600)::VARCHAR, 2, '0') || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS clock,
 (s // 60) || 'h ' || (s % 60) || 'm' AS hm, 'TRK-' || lpad(l_orderkey::VARCHAR, 12, '0') AS tracking, repeat('★', (l_linenumber % 6)::BIGINT) || repeat('☆', (5 - l_linenumber % 6)::BIGINT) AS stars,
 CASE WHEN b >= 1048576 THEN round(b / 1048576, 2) || ' MB' WHEN b >= 1024 THEN round(b / 1024, 2) || ' KB' ELSE b || ' B' END AS size FROM (SELECT *, CAST(floor(l_extendedprice) AS BIGINT) AS s, CAST(l_quantity * l_quantity * l_partkey AS BIGINT) AS b FROM lineitem)""")
def _(t):
    s, b = F.col("s"), F.col("b")
    df = t.lineitem.withColumns({"s": F.floor("l_extendedprice"), "b": (F.col("l_quantity") * F.col("l_quantity") * F.col("l_partkey")).cast("long")})
    r = F.col("l_linenumber") % 6
    return df.select("l_orderkey", "l_linenumber", B.money(F.col("l_extendedprice")).alias("price"), B.clock(s).alias("clock"), B.hours_minutes(s).alias("hm"), B.tracking_id(F.col("l_orderkey")).alias("tracking"),
                     B.stars(r).alias("stars"), B.data_size(b).alias("size"))


@query("fn06_ratios", f"""SELECT l_orderkey, l_linenumber, {hup('l_quantity * 100 / greatest(l_linenumber, 1)', 2)} AS pct, {hup('l_extendedprice / greatest(l_quantity, 1)', 4)} AS unit_price,
 {hup('l_quantity * 1000 / greatest(l_discount, 1)', 4)} AS per_unit FROM lineitem""")
def _(t):
    c = F.col
    return t.lineitem.select("l_orderkey", "l_linenumber", B.safe_ratio(c("l_quantity"), c("l_linenumber")).alias("pct"), B.safe_ratio(c("l_extendedprice"), c("l_quantity"), 1, 4).alias("unit_price"),
                             B.safe_ratio(c("l_quantity"), c("l_discount"), 1000, 4, floor=1.0).alias("per_unit"))


@query("fn07_finance", f"""SELECT l_orderkey, l_linenumber, {hup('power(1 + (l_tax + 0.01) / 12, 12) - 1', 4)} AS apr,
 {hup('l_extendedprice * ((l_tax + 0.01) / 12) / (1 - power(1 + (l_tax + 0.01) / 12, -(l_quantity * 12)))', 2)} AS payment,
 {hup('l_extendedprice * power(1 + l_tax, l_linenumber)', 2)} AS grown, {hup('l_extendedprice * power(1 + -l_discount, l_linenumber)', 2)} AS decayed FROM lineitem""")
def _(t):
    c, r = F.col, F.col("l_tax") + 0.01
    return t.lineitem.select("l_orderkey", "l_linenumber", B.effective_rate(r, F.lit(12)).alias("apr"), B.annuity(c("l_extendedprice"), r, c("l_quantity") * 12).alias("payment"),
                             B.growth(c("l_extendedprice"), c("l_tax"), c("l_linenumber")).alias("grown"), B.growth(c("l_extendedprice"), -c("l_discount"), c("l_linenumber")).alias("decayed"))


@query("fn08_great_circle", """SELECT event_id, round(6371 * acos(greatest(-1.0, least(1.0, cos(radians(a)) * cos(radians(b)) * cos(radians(d) - radians(c)) + sin(radians(a)) * sin(radians(b))))), 2) AS km
FROM (SELECT event_id, user_id % 90 AS a, user_id % 180 AS c, event_id % 80 AS b, event_id % 170 AS d FROM events)""")
def _(t):
    e, u = F.col("event_id"), F.col("user_id")
    return t.events.select("event_id", B.great_circle_km(u % 90, u % 180, e % 80, e % 170).alias("km"))


@query("fn09_dates", """SELECT o_orderkey, floor(date_diff('day', o_orderdate, TIMESTAMP '2010-06-15') / 365.25)::BIGINT AS age, date_diff('day', o_orderdate, TIMESTAMP '2010-06-15') AS days, 'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) AS quarter,
 CASE WHEN date_diff('day', TIMESTAMP '1998-01-01', o_orderdate) < 0 THEN 'Expired' WHEN date_diff('day', TIMESTAMP '1998-01-01', o_orderdate) < 90 THEN 'Expiring Soon' ELSE 'Valid' END AS expiry,
 hour(o_orderdate + to_hours((o_orderkey % 24)::INT)) BETWEEN 9 AND 17 AND isodow(o_orderdate) <= 5 AS office,
 CASE WHEN o_orderkey % 9 = 0 THEN 'Open' WHEN o_orderkey % 12 <= CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 5 ELSE 7 END THEN 'Met' ELSE 'Breached' END AS sla,
 CASE WHEN o_orderkey % 40 > 30 THEN 'Overdue - Critical' WHEN o_orderkey % 40 > 20 THEN 'Overdue' WHEN o_orderkey % 40 > 18 THEN 'Due Soon' ELSE 'OK' END AS urgency FROM orders""")
def _(t):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    pr = B.map_label(F.col("o_orderpriority"), {"1-URGENT": "critical", "2-HIGH": "high", "3-MEDIUM": "medium"}, "low")
    done = F.when(k % 9 != 0, F.timestamp_add("DAY", (k % 12).cast("int"), d))
    return t.orders.select("o_orderkey", B.age_years(d, "2010-06-15").alias("age"), B.days_since(d, "2010-06-15").alias("days"), B.quarter_label(d).alias("quarter"), B.expiry_status(d, "1998-01-01").alias("expiry"),
                           B.in_business_hours(F.timestamp_add("HOUR", (k % 24).cast("int"), d)).alias("office"), B.ticket_sla(d, done, pr).alias("sla"), B.maintenance_urgency(k % 40, F.lit(20)).alias("urgency"))


@query("fn10_validators", """SELECT c_custkey, regexp_matches(n, '^[0-9]{10}$') AS npi, regexp_matches(s, '^[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?$') AS swift
FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '12' ELSE '1' END || lpad(c_custkey::VARCHAR, 9, '0') AS n, upper(left(c_mktsegment, (6 + c_custkey % 2)::INT)) || lpad((c_custkey % 100)::VARCHAR, 2, '0') || CASE WHEN c_custkey % 4 = 0 THEN 'XXX' ELSE '' END AS s FROM customer)""")
def _(t):
    k = F.col("c_custkey")
    n = F.concat(F.when(k % 3 == 0, "12").otherwise("1"), F.lpad(k.cast("string"), 9, "0"))
    s = F.concat(F.upper(F.left("c_mktsegment", (6 + k % 2).cast("int"))), F.lpad((k % 100).cast("string"), 2, "0"), F.when(k % 4 == 0, "XXX").otherwise(""))
    return t.customer.select("c_custkey", V.npi(n).alias("npi"), V.swift(s).alias("swift"))


@query("fn11_measures", f"""SELECT l_orderkey, l_linenumber, {hup('least(l_quantity - 0.5::DOUBLE, 50.5::DOUBLE - l_quantity) / ((50.5::DOUBLE - 0.5::DOUBLE) / 6)', 3)} AS cpk,
 {hup('l_quantity * 90 * 95 / 10000', 2)} AS oee, {hup('l_quantity * 20 * l_linenumber / 5000', 2)} AS dim_weight FROM lineitem""")
def _(t):
    q = F.col("l_quantity")
    return t.lineitem.select("l_orderkey", "l_linenumber", B.cpk(q, F.lit(0.5), F.lit(50.5)).alias("cpk"), B.oee(q, F.lit(90), F.lit(95)).alias("oee"), B.dimensional_weight(q, F.lit(20), F.col("l_linenumber")).alias("dim_weight"))


@query("ud01_scalar_functions", "SELECT s_suppkey, '$' || format('{:,.2f}', s_acctbal) AS balance, CASE WHEN s_acctbal / 100 >= 80 THEN 'Critical' WHEN s_acctbal / 100 >= 60 THEN 'High' WHEN s_acctbal / 100 >= 40 THEN 'Medium' WHEN s_acctbal / 100 >= 20 THEN 'Low' ELSE 'Minimal' END AS risk FROM supplier")
def _(t):
    return t.supplier.select("s_suppkey", B.money(F.col("s_acctbal")).alias("balance"), B.band(F.col("s_acctbal") / 100, "risk_score").alias("risk"))
