"""Record matching and golden records over customers, suppliers and parts."""

from pyspark.sql import functions as F

from tallyframe.common import union_all
from tallyframe.functions import matching as M
from tallyframe.operators import master as mm
from tallyframe.operators import matching as mt
from tallyframe.operators.matching import MatchRule
from tallyframe.plans.registry import query

# ---- field similarity --------------------------------------------------------------------------


@query("md01_exact_match", "SELECT c_custkey, lower(trim(' ' || c_mktsegment)) = lower(trim(CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) ELSE 'building ' END)) AS same FROM customer")
def _(t):
    b = F.when(F.col("c_custkey") % 3 == 0, F.lower("c_mktsegment")).otherwise("building ")
    return t.customer.select("c_custkey", (M.exact(F.concat(F.lit(" "), "c_mktsegment"), b) == 1.0).alias("same"))


def jw_sql(a, b):
    p = f"CASE WHEN left({a}, 4) = left({b}, 4) AND length({a}) >= 4 AND length({b}) >= 4 THEN 4 WHEN left({a}, 3) = left({b}, 3) AND length({a}) >= 3 AND length({b}) >= 3 THEN 3 " \
        f"WHEN left({a}, 2) = left({b}, 2) THEN 2 WHEN left({a}, 1) = left({b}, 1) THEN 1 ELSE 0 END"
    return f"(jaro_similarity({a}, {b}) + ({p}) * 0.1 * (1 - jaro_similarity({a}, {b})))"


# No SQL: DuckDB halves an odd number of moved characters downwards. Tests compare with brute force.
@query("md02_jaro_winkler")
def _(t):
    p = t.part.select(F.col("p_partkey"), F.lower("p_name").alias("a"), F.concat_ws(" ", F.lower("p_type"), F.reverse(F.lower("p_name"))).alias("b"))
    c = t.customer.select((F.col("c_custkey") + 1_000_000_000).alias("p_partkey"), F.lower("c_name").alias("a"), F.concat(F.lit("custom "), F.right("c_name", F.lit(6))).alias("b"))
    return p.unionByName(c).select("p_partkey", F.round(M.jaro_winkler(F.col("a"), F.col("b")), 6).alias("score"))


LEV = "CASE WHEN {a} = {b} THEN 1.0 WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0 ELSE 1 - levenshtein({a}, {b}) / greatest(length({a}), length({b})) END"


@query("md03_levenshtein_ratio", f"SELECT p_partkey, round({LEV.format(a='a', b='b')}, 8) AS score FROM (SELECT p_partkey, p_name AS a, CASE WHEN p_size = 1 THEN '' ELSE replace(p_name, 'e', '') || lower(left(p_type, p_size % 4)) END AS b FROM part)")
def _(t):
    b = F.when(F.col("p_size") == 1, "").otherwise(F.concat(F.replace("p_name", F.lit("e"), F.lit("")), F.lower(F.left("p_type", F.col("p_size") % 4))))
    return t.part.select("p_partkey", F.round(M.levenshtein_ratio(F.col("p_name"), b), 8).alias("score"))


CODED = "regexp_replace(upper(s), '[^BFPVCGJKQSXZDTLMNR]', '', 'g')"
CODED = f"translate({CODED}, 'BFPVCGJKQSXZDTLMNR', '111122222222334556')"
for _d in "123456":
    CODED = f"regexp_replace({CODED}, '{_d}+', '{_d}', 'g')"


@query("md04_soundex", f"""SELECT s, rpad(left(upper(s), 1) || left(CASE WHEN regexp_matches(upper(s), '^[BFPVCGJKQSXZDTLMNR]') THEN substr(r, 2) ELSE r END, 3), 4, '0') AS code, n
FROM (SELECT *, {CODED} AS r FROM (SELECT s, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{{2,}}')) AS s FROM documents) GROUP BY 1))""")
def _(t):
    words = t.documents.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{2,}"), 0)).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    return words.select("s", M.soundex(F.col("s")).alias("code"), "n")


NORM = "regexp_replace(lower(s), '^\\s+|\\s+$', '', 'g')"
for _s in M.SUFFIXES:
    NORM = f"regexp_replace({NORM}, '\\s*{_s}$', '')"
COMPANY = "CASE s_suppkey % 7 WHEN 0 THEN s_name || ' Inc' WHEN 1 THEN s_name || '  LTD ' WHEN 2 THEN s_name || ' Co Ltd' WHEN 3 THEN s_name || ' ltd co' WHEN 4 THEN s_name || ' corporation' WHEN 5 THEN ' ' || s_name || ' GmbH inc' ELSE s_name END"


def company(c, k):
    forms = [F.concat(c, F.lit(" Inc")), F.concat(c, F.lit("  LTD ")), F.concat(c, F.lit(" Co Ltd")), F.concat(c, F.lit(" ltd co")),
             F.concat(c, F.lit(" corporation")), F.concat(F.lit(" "), c, F.lit(" GmbH inc")), c]
    return F.get(F.array(*forms), (k % 7).cast("int"))


@query("md05_normalized", f"SELECT s_suppkey, {NORM} AS name FROM (SELECT s_suppkey, {COMPANY} AS s FROM supplier)")
def _(t):
    return t.supplier.select("s_suppkey", M.normalize(company(F.col("s_name"), F.col("s_suppkey"))).alias("name"))


@query("md06_numeric", "SELECT c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g') = lpad(CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE c_custkey + 1 END::VARCHAR, 9, '0') AS same FROM customer")
def _(t):
    k = F.col("c_custkey")
    other = F.concat(F.lit("no. "), F.lpad(F.when(k % 2 == 0, k).otherwise(k + 1).cast("string"), 9, "0"))
    return t.customer.select("c_custkey", (M.similarity("numeric", F.col("c_name"), other) == 1.0).alias("same"))


# ---- scores, links, clusters -------------------------------------------------------------------

PAIR_RULES = [MatchRule("name", "name", "fuzzy_jaro_winkler", 2.0, 0.8), MatchRule("segment", "segment", "exact", 1.0, 1.0), MatchRule("balance", "balance", "numeric", 0.5)]


@query("md07_pair_score", f"""
WITH r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 <> 0 THEN c_name END AS name, c_mktsegment AS segment, CAST(floor(c_acctbal / 3000) AS BIGINT)::VARCHAR AS balance FROM customer),
p AS (SELECT a.id AS a, b.id AS b, {jw_sql('lower(a.name)', 'lower(b.name)')} AS s1, (a.segment = b.segment)::INT::DOUBLE AS s2,
 (regexp_replace(a.balance, '[^0-9]', '', 'g') = regexp_replace(b.balance, '[^0-9]', '', 'g'))::INT::DOUBLE AS s3, a.name IS NOT NULL AND b.name IS NOT NULL AS n FROM r a JOIN r b ON b.id = a.id + 1),
q AS (SELECT *, coalesce(n AND s1 >= 0.8, false) AS c1, s2 >= 1 AS c2 FROM p)
SELECT a, b, round((CASE WHEN c1 THEN s1 * 2 ELSE 0 END + CASE WHEN c2 THEN s2 ELSE 0 END + s3 * 0.5) / (CASE WHEN c1 THEN 2 ELSE 0 END + CASE WHEN c2 THEN 1 ELSE 0 END + 0.5) * 100, 4) AS score,
 concat_ws(', ', CASE WHEN c1 THEN 'name(' || round(s1 * 100)::INT || '%)' END, CASE WHEN c2 THEN 'segment(100%)' END, CASE WHEN s3 > 0 THEN 'balance(100%)' END) AS matched_rules FROM q""")
def _(t):
    r = t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 10 != 0, F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("segment"),
                          F.floor(F.col("c_acctbal") / 3000).cast("string").alias("balance"))
    a = r.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), *[F.col(c).alias(f"a_{c}") for c in ("name", "segment", "balance")])
    b = r.select(F.col("id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in ("name", "segment", "balance")])
    return mt.score_pairs(a.join(b, "b"), PAIR_RULES).select("a", "b", F.round("score", 4).alias("score"), "matched_rules")


DUP_RULES = [MatchRule("name", "name", "fuzzy_levenshtein", 2.0, 0.94), MatchRule("phone", "phone", "exact", 1.0, 1.0)]


def dup_records(t):
    return t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.concat(F.lit("P"), F.col("c_custkey") % 400).alias("phone"))


LINKS = """r AS (SELECT c_custkey AS id, lower(c_name) AS name, 'P' || (c_custkey % 400) AS phone FROM customer),
links AS (SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.id < b.id AND length(a.name) = length(b.name) WHERE levenshtein(a.name, b.name) <= 1
 UNION SELECT m, id FROM (SELECT id, min(id) OVER (PARTITION BY phone) AS m FROM r) WHERE id <> m),
s AS (SELECT links.a, links.b, 1 - levenshtein(x.name, y.name) / greatest(length(x.name), length(y.name)) AS s1, x.phone = y.phone AS c2 FROM links JOIN r x ON x.id = a JOIN r y ON y.id = b),
scored AS (SELECT a, b, s1, c2, (CASE WHEN s1 >= 0.94 THEN s1 * 2 ELSE 0 END + c2::INT) / (CASE WHEN s1 >= 0.94 THEN 2 ELSE 0 END + c2::INT) * 100 AS score FROM s)"""


@query("md08_duplicate_links", f"""WITH {LINKS}
SELECT a, b, round(score, 4) AS score, concat_ws(', ', CASE WHEN s1 >= 0.94 THEN 'name(' || round(s1 * 100)::INT || '%)' END, CASE WHEN c2 THEN 'phone(100%)' END) AS matched_rules,
 CASE WHEN score >= 95 THEN 'auto_merged' ELSE 'pending' END AS status, CASE WHEN score < 95 THEN CASE WHEN score >= 90 THEN 'high' ELSE 'medium' END END AS priority FROM scored WHERE score >= 80""")
def _(t):
    return mt.detect_duplicates(dup_records(t), "id", DUP_RULES).withColumn("score", F.round("score", 4))


@query("md08_similar_names", "SELECT DISTINCT least(a.p, b.p) AS v, greatest(a.p, b.p) AS w FROM (SELECT DISTINCT s_name AS p FROM supplier) a JOIN (SELECT DISTINCT s_name AS p FROM supplier) b ON a.p < b.p WHERE 1 - levenshtein(a.p, b.p) / greatest(length(a.p), length(b.p)) >= 0.88")
def _(t):
    return mt.similar_values(t.supplier, "s_name", 0.88).select("v", "w")


# Without SQL: DuckDB rounds half transpositions down. A test compares with all pairs.
@query("md08_jaro_winkler_names")
def _(t):
    return mt.jaro_winkler_pairs(t.part.select(F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("x")), "x", 0.9).withColumn("ratio", F.round("ratio", 6))


TWO_DISTANCES = [MatchRule("name", "name", "fuzzy_levenshtein"), MatchRule("kind", "kind", "fuzzy_levenshtein"), MatchRule("size", "size", "exact", 0.5, 1.0)]


@query("md08_two_distances", """
WITH RECURSIVE g AS (SELECT p_name AS name, p_type AS kind, p_size % 3 AS size, min(p_partkey) AS id, count(*) AS n FROM part GROUP BY ALL),
s AS (SELECT a.id AS a, b.id AS b, 1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)) AS s1,
 1 - levenshtein(lower(a.kind), lower(b.kind)) / greatest(length(a.kind), length(b.kind)) AS s2, (a.size = b.size)::INT * 0.5 AS s3 FROM g a JOIN g b ON a.id <> b.id),
links AS (SELECT a, b FROM s WHERE (s1 + s2 + s3) / (2 + s3) * 100 >= 80),
reach AS (SELECT id AS x, id AS y FROM g UNION SELECT r.x, l.b FROM reach r JOIN links l ON l.a = r.y), c AS (SELECT x, min(y) AS component FROM reach GROUP BY x)
SELECT p_partkey AS node, component FROM part JOIN g ON name = p_name AND kind = p_type AND size = p_size % 3 JOIN c ON c.x = g.id
WHERE g.n > 1 OR g.id IN (SELECT a FROM links)""")
def _(t):
    goods = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), (F.col("p_size") % 3).cast("string").alias("size"))
    return mt.connected_components(mt.detect_duplicates(goods, "id", TWO_DISTANCES), "a", "b")


# every tenth number is left out, which ends a chain of links
LINKED = "SELECT DISTINCT o_custkey + o_custkey // 10 AS k FROM orders"


@query("jn11_blocked_self_join", f"""WITH {LINKS} SELECT a, b FROM links""")
def _(t):
    return mt.candidate_links(dup_records(t), "id", DUP_RULES)


@query("md09_clusters", f"""WITH l AS ({LINKED}), g AS (SELECT k, k - row_number() OVER (ORDER BY k) AS grp FROM l),
i AS (SELECT min(k) AS lo, max(k) + 1 AS hi FROM g GROUP BY grp) SELECT unnest(range(lo, hi + 1)) AS node, lo AS component FROM i""")
def _(t):
    ks = t.orders.select((F.col("o_custkey") + F.floor(F.col("o_custkey") / 10)).alias("a")).distinct()
    return mt.connected_components(ks.withColumn("b", F.col("a") + 1), "a", "b")


@query("md09_merged_duplicates", f"WITH {LINKS}, r2 AS (SELECT id, min(id) OVER (PARTITION BY phone) AS m, count(*) OVER (PARTITION BY phone) AS n FROM r) SELECT id AS node, m AS component FROM r2 WHERE n > 1")
def _(t):
    links = mt.detect_duplicates(dup_records(t), "id", DUP_RULES).where("status = 'auto_merged' AND matched_rules LIKE '%phone%'")
    return mt.connected_components(links, "a", "b")


# ---- golden records ----------------------------------------------------------------------------


def sources(t):
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    c = F.col("c_custkey")
    crm = t.customer.select("c_custkey", F.col("c_name").alias("name"), F.when(c % 4 != 0, F.col("c_mktsegment")).alias("segment"), F.lit("x").alias("note"))
    erp = t.customer.where(c % 3 != 0).select("c_custkey", F.upper("c_name").alias("name"), F.concat(F.lit("SEG "), "c_mktsegment").alias("segment"), F.lit("longer note").alias("note"))
    web = t.customer.where(c % 5 != 0).select("c_custkey", F.concat("c_name", F.lit(" W")).alias("name"), F.lit("").alias("segment"), F.lit("").alias("note"))
    return union_all([mm.ingest(crm, "c_custkey", "crm", 0.7, at("2024-01-01")), mm.ingest(erp, "c_custkey", "erp", 0.9, at("2023-06-01")),
                      mm.ingest(web, "c_custkey", "web", 0.4, at("2024-05-01"))])


SRC = """src AS (SELECT 'crm' AS sys, c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS segment, 'x' AS note, 0.7 AS trust, 2 AS ord FROM customer
UNION ALL SELECT 'erp', c_custkey, upper(c_name), 'SEG ' || c_mktsegment, 'longer note', 0.9, 1 FROM customer WHERE c_custkey % 3 <> 0
UNION ALL SELECT 'web', c_custkey, c_name || ' W', '', '', 0.4, 3 FROM customer WHERE c_custkey % 5 <> 0)"""


@query("md10_survivorship", f"""WITH {SRC}, f AS (SELECT *, 1 + (name <> '')::INT + (coalesce(segment, '') <> '')::INT + (note <> '')::INT AS filled FROM src)
SELECT k::VARCHAR AS source_key, 'c_custkey' AS attribute, k::VARCHAR AS value FROM f GROUP BY k
UNION ALL SELECT k::VARCHAR, 'name', first(name ORDER BY ord DESC) FROM f GROUP BY k
UNION ALL SELECT k::VARCHAR, 'segment', first(segment ORDER BY filled DESC, sys) FROM f WHERE segment IS NOT NULL GROUP BY k
UNION ALL SELECT k::VARCHAR, 'note', first(note ORDER BY length(note) DESC, sys) FROM f GROUP BY k""")
def _(t):
    return mm.survive(sources(t), "source_key", {"name": "most_recent", "segment": "most_complete", "note": "longest"})


@query("md10_golden_records", f"""WITH {SRC} SELECT k::VARCHAR AS source_key, first(name ORDER BY trust DESC) AS name, first(note ORDER BY trust DESC) AS note FROM src GROUP BY k""")
def _(t):
    g = mm.golden_records(mm.survive(sources(t), "source_key", {}), "source_key")
    return g.select("source_key", F.col("attributes")["name"].alias("name"), F.col("attributes")["note"].alias("note"))


@query("md11_pair_merge", f"""WITH {SRC} SELECT w.k::VARCHAR AS source_key, w.name, coalesce(nullif(w.segment, ''), e.segment) AS segment, coalesce(nullif(w.note, ''), e.note) AS note
FROM src w JOIN src e ON w.k = e.k WHERE w.sys = 'web' AND e.sys = 'erp'""")
def _(t):
    s = sources(t)
    w = s.where("source_system = 'web'").select("source_key", F.col("attributes").alias("a"))
    e = s.where("source_system = 'erp'").select("source_key", F.col("attributes").alias("b"))
    m = w.join(e, "source_key").select("source_key", mm.merge_pair(F.col("a"), F.col("b")).alias("m"))
    return m.select("source_key", *[F.col("m")[c].alias(c) for c in ("name", "segment", "note")])


@query("md12_source_ingest", f"WITH {SRC} SELECT sys || ':' || k AS source_record_id, 3 + (segment IS NOT NULL)::INT AS n_attributes, trust::DOUBLE AS trust_score, segment FROM src")
def _(t):
    return sources(t).select("source_record_id", F.size("attributes").alias("n_attributes"), "trust_score", F.col("attributes")["segment"].alias("segment"))


@query("md13_split", f"""WITH {SRC}, g AS (SELECT k, count(*) AS n FROM src GROUP BY k) SELECT sys || ':' || k AS source_record_id, CASE WHEN k % 11 <> 0 THEN 'e' || k END AS entity_id,
 (SELECT count(*) FROM g WHERE k % 11 <> 0) AS n_golden FROM src""")
def _(t):
    links = sources(t).select("source_record_id", F.concat(F.lit("e"), "source_key").alias("entity_id"), "source_key")
    golden = links.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    split = links.where(F.col("source_key").cast("long") % 11 == 0).select("entity_id")
    freed, rest = mm.split_entities(links.select("source_record_id", "entity_id"), golden, split)
    return freed.withColumn("n_golden", rest.agg(F.count(F.lit(1)).alias("n")).scalar())


def tree(t):
    s = lambda p, c: F.concat(F.lit(p), F.col(c))
    return union_all([t.region.select(s("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent")),
                      t.nation.select(s("n", "n_nationkey").alias("node"), s("r", "n_regionkey").alias("parent")),
                      t.customer.select(s("c", "c_custkey").alias("node"), s("n", "c_nationkey").alias("parent"))])


TREE = """tree AS (SELECT 'r' || r_regionkey AS node, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"""
PATHS = """paths AS (SELECT node, parent, 0 AS level, node AS path FROM {tree} WHERE parent IS NULL UNION ALL SELECT t.node, t.parent, p.level + 1, p.path || '/' || t.node FROM {tree} t JOIN paths p ON t.parent = p.node)"""


@query("md14_hierarchy_paths", f"WITH RECURSIVE {TREE}, {PATHS.format(tree='tree')} SELECT * FROM paths")
def _(t):
    return mm.hierarchy_paths(tree(t)).where("level IS NOT NULL").drop("on_cycle")


@query("md14_move_subtree", f"WITH RECURSIVE {TREE}, moved AS (SELECT node, CASE WHEN node = 'n3' THEN 'n7' ELSE parent END AS parent FROM tree), {PATHS.format(tree='moved')} "
                            "SELECT split_part(path, '/', 1) AS root, count(*) AS node_count, max(level) AS max_depth FROM paths GROUP BY 1")
def _(t):
    p = mm.hierarchy_paths(mm.move_node(tree(t), "n3", "n7"))
    return mm.hierarchy_summary(p.withColumn("root", F.substring_index("path", "/", 1)), ["root"])


@query("md15_stewardship", """SELECT count(*) AS total, count(*) FILTER (WHERE status = 'open') AS open, count(*) FILTER (WHERE status = 'open' AND priority = 'high') AS high_priority, count(*) FILTER (WHERE status <> 'open') AS resolved
FROM (SELECT CASE WHEN value > 40 THEN 'open' ELSE 'resolved' END AS status, CASE WHEN event_type = 'error' THEN 'high' ELSE 'medium' END AS priority FROM events)""")
def _(t):
    return mm.stewardship_stats(t.events.select(F.when(F.col("value") > 40, "open").otherwise("resolved").alias("status"), F.when(F.col("event_type") == "error", "high").otherwise("medium").alias("priority")))


@query("md15_entities", "SELECT c_mktsegment AS entity_type, CASE WHEN c_acctbal < 0 THEN 'inactive' ELSE 'active' END AS status, count(*) AS n, round(avg(c_nationkey / 25), 6) AS avg_confidence FROM customer GROUP BY 1, 2")
def _(t):
    return mm.entity_stats(t.customer.select(F.col("c_mktsegment").alias("entity_type"), F.when(F.col("c_acctbal") < 0, "inactive").otherwise("active").alias("status"), (F.col("c_nationkey") / 25).alias("confidence_score")))


MIXED_RULES = [MatchRule("segment", "segment", "exact", 3.0), MatchRule("nation", "nation", "exact", 1.0), MatchRule("balance", "balance", "exact", 1.0)]


# equality is all or nothing here, so records are grouped by their values before all pairs are compared
@query("md08_mixed_rules", """WITH RECURSIVE r AS (SELECT CASE WHEN c_custkey % 7 > 0 THEN c_mktsegment || c_custkey // 50 END AS segment, CASE WHEN c_custkey % 5 > 0 THEN 'n' || c_nationkey END AS nation, CAST(CAST(floor(c_acctbal / 1000) AS BIGINT) AS VARCHAR) AS balance, min(c_custkey) AS id FROM customer GROUP BY 1, 2, 3),
s AS (SELECT a.id AS x, b.id AS y, 3 * coalesce(a.segment = b.segment, false)::INT + coalesce(a.nation = b.nation, false)::INT + coalesce(a.balance = b.balance, false)::INT AS won,
 3 * (a.segment IS NOT NULL AND b.segment IS NOT NULL)::INT + (a.nation IS NOT NULL AND b.nation IS NOT NULL)::INT + (a.balance IS NOT NULL AND b.balance IS NOT NULL)::INT AS weight FROM r a JOIN r b ON a.id <> b.id),
e AS (SELECT x, y FROM s WHERE weight > 0 AND won * 100.0 / weight >= 80), c AS (SELECT id AS x, id AS y FROM r UNION SELECT c.x, e.y FROM c JOIN e ON e.x = c.y)
SELECT x AS node, min(y) AS component FROM c GROUP BY 1 HAVING count(*) > 1""")
def _(t):
    text = F.floor(F.col("c_acctbal") / 1000).cast("long").cast("string")
    r = t.customer.select(F.when(F.col("c_custkey") % 7 > 0, F.concat("c_mktsegment", F.floor(F.col("c_custkey") / 50))).alias("segment"),
                          F.when(F.col("c_custkey") % 5 > 0, F.concat(F.lit("n"), "c_nationkey")).alias("nation"), text.alias("balance"), "c_custkey")
    distinct = r.groupBy("segment", "nation", "balance").agg(F.min("c_custkey").alias("id"))
    return mt.connected_components(mt.detect_duplicates(distinct, "id", MIXED_RULES), "a", "b")
