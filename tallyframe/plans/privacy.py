"""Personal data: detection, masks and subject requests over customers, documents and conversations."""

from pyspark.sql import functions as F

from tallyframe.common import union_all
from tallyframe.functions import masks as M
from tallyframe.functions import pii as P
from tallyframe.functions import validators as V
from tallyframe.operators import pii as op
from tallyframe.operators import subject as su
from tallyframe.operators.changes import merge
from tallyframe.plans.fixtures import persons, with_ctes
from tallyframe.plans.registry import query
from tallyframe.sources.export import subject_rows

W = with_ctes("persons")

# column names built from the data: one per segment and nation, some of which look personal
STEMS = ("order_id", "home_phone", "company", "e_mail", "fax", "birthday", "note", "iban_code", "city_code", "user_token")
COLUMN_NAME = "(CASE c_custkey % 10 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(STEMS)) + " END || '_' || c_custkey)"


def inventory(t):
    stem = F.element_at(F.array(*[F.lit(s) for s in STEMS]), (F.col("c_custkey") % 10 + 1).cast("int"))
    return t.customer.select(F.lower("c_mktsegment").alias("table_schema"), F.concat(F.lit("t"), "c_nationkey").alias("table_name"),
                             F.concat_ws("_", stem, F.col("c_custkey")).alias("column_name"), "c_acctbal")


INV = f"inv AS (SELECT lower(c_mktsegment) AS table_schema, 't' || c_nationkey AS table_name, {COLUMN_NAME} AS column_name, c_acctbal FROM customer)"


def name_case(patterns, col="column_name", words=False):
    def pat(p):
        body = p[4:]
        return f"(^|[^a-z]){body}($|[^a-z])" if words else body

    return "CASE " + " ".join(f"WHEN regexp_matches({col}, '(?i){pat(p)}') THEN '{n}'" for n, p in patterns.items()) + " END"


def mask_case(col="pii_type"):
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.SUGGESTED_MASK.items()) + " ELSE 'redact' END"


BY_NAME = f"""by_name AS (SELECT table_schema, table_name, column_name, pii_type, 'column_name' AS detection_method, 0.85::DOUBLE AS confidence_score, {mask_case()} AS suggested_masking
FROM (SELECT *, {name_case(P.NAME_PATTERNS)} AS pii_type FROM inv) WHERE pii_type IS NOT NULL)"""


@query("pi01_column_names", f"WITH {INV}, {BY_NAME} SELECT * FROM by_name")
def _(t):
    return op.detect_by_name(inventory(t))


@query("pi01_column_names_whole_words", f"""WITH {INV} SELECT table_name, column_name, {name_case(P.NAME_PATTERNS, words=True)} AS pii_type FROM inv
WHERE {name_case(P.NAME_PATTERNS, words=True)} IS NOT NULL""")
def _(t):
    return op.detect_by_name(inventory(t), P.PiiConfig(whole_words=True)).select("table_name", "column_name", "pii_type")


def luhn_sql(c):
    d = f"replace(replace({c}, ' ', ''), '-', '')"
    digit = "TRY_CAST(r[i] AS INT)"
    return (f"(regexp_full_match({d}, '[0-9]{{13,19}}') AND list_sum([CASE WHEN i % 2 = 1 THEN {digit} ELSE CASE WHEN {digit} * 2 > 9 THEN {digit} * 2 - 9 ELSE {digit} * 2 END END "
            f"FOR i IN range(1, length({d}) + 1)]) % 10 = 0)").replace("r[i]", f"substr({d}, length({d}) + 1 - i, 1)")


def iban_sql(c):
    s = f"upper(replace({c}, ' ', ''))"
    turned = f"(substr({s}, 5) || substr({s}, 1, 4))"
    num = f"list_transform(string_split({turned}, ''), lambda ch: CASE WHEN ascii(ch) >= 65 THEN ascii(ch) - 55 ELSE ascii(ch) - 48 END)"
    return (f"(regexp_full_match({s}, '[A-Z]{{2}}[0-9]{{2}}[0-9A-Z]{{11,30}}') AND "
            f"list_reduce(list_prepend(0::BIGINT, {num}), lambda a, b: CASE WHEN b > 9 THEN (a * 100 + b) % 97 ELSE (a * 10 + b) % 97 END) = 1)")


def ipv4_sql(c):
    o = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return rf"regexp_full_match(trim({c}), '{o}\.{o}\.{o}\.{o}')"


VALID = {"CREDIT_CARD": luhn_sql, "IBAN": iban_sql, "IP_ADDRESS": ipv4_sql}
PERSON_COLS = ("full_name", "email", "phone", "ssn", "credit_card", "ip_addr", "birth_date", "iban", "remark")


def value_match(c, ty):
    hit = f"regexp_matches({c}, '{P.VALUE_PATTERNS[ty]}')"
    return f"{hit} AND {VALID[ty](c)}" if ty in VALID else hit


RATES = "rates AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{ty}' AS pii_type, count({c}) AS n_values, count(*) FILTER (WHERE {value_match(c, ty)}) AS n_matches FROM persons"
    for c in PERSON_COLS for ty in P.VALUE_PATTERNS) + ")"
SCORE = "round(CASE WHEN pii_type IN ('CREDIT_CARD', 'IBAN', 'IP_ADDRESS') THEN least(match_rate + 0.15, 1.0) ELSE match_rate END, 2)"
BY_VALUE = f"""by_value AS (SELECT 'crm' AS table_schema, 'persons' AS table_name, column_name, pii_type, 'data_sampling' AS detection_method, {SCORE} AS confidence_score, {mask_case()} AS suggested_masking
FROM (SELECT *, n_matches / n_values AS match_rate FROM rates) WHERE match_rate > 0.3)"""


@query("pi02_value_match_rates", W + f", {RATES} SELECT column_name, pii_type, n_values, n_matches, round(n_matches / n_values, 6) AS match_rate FROM rates")
def _(t):
    return op.value_match_rates(persons(t), PERSON_COLS).withColumn("match_rate", F.round("match_rate", 6))


@query("pi02_column_values", W + f", {RATES}, {BY_VALUE} SELECT * FROM by_value")
def _(t):
    return op.detect_by_value(persons(t), "crm", "persons", PERSON_COLS)


@query("pi03_luhn", W + f"SELECT c_custkey, {luhn_sql('credit_card')} AS valid FROM persons")
def _(t):
    return persons(t).select("c_custkey", V.luhn(F.col("credit_card")).alias("valid"))


@query("pi04_iban", W + f"SELECT c_custkey, {iban_sql('iban')} AS valid FROM persons")
def _(t):
    return persons(t).select("c_custkey", V.iban(F.col("iban")).alias("valid"))


@query("pi05_ip_octets", W + f"SELECT c_custkey, {ipv4_sql('ip_addr')} AS valid FROM persons")
def _(t):
    return persons(t).select("c_custkey", V.ipv4(F.col("ip_addr")).alias("valid"))


def tags(t):
    k = F.col("c_custkey")
    return inventory(t).withColumn("k", F.regexp_extract("column_name", "([0-9]+)$", 1).cast("long")).select(
        *op.WHERE, F.when(F.col("k") % 3 == 0, "PII").when(F.col("k") % 3 == 1, "classification").otherwise("owner").alias("tag_name"),
        F.when(F.col("k") % 4 == 0, " Email ").when(F.col("k") % 4 == 1, "ssn").when(F.col("k") % 4 == 2, "confidential").otherwise("yes").alias("tag_value"))


TAGS = f"""tags AS (SELECT table_schema, table_name, column_name, CASE k % 3 WHEN 0 THEN 'PII' WHEN 1 THEN 'classification' ELSE 'owner' END AS tag_name,
 CASE k % 4 WHEN 0 THEN ' Email ' WHEN 1 THEN 'ssn' WHEN 2 THEN 'confidential' ELSE 'yes' END AS tag_value FROM (SELECT *, CAST(regexp_extract(column_name, '([0-9]+)$', 1) AS BIGINT) AS k FROM inv))"""
BY_TAG = f"""by_tag AS (SELECT table_schema, table_name, column_name, pii_type, 'uc_tag' AS detection_method, 0.95::DOUBLE AS confidence_score, {mask_case()} AS suggested_masking
FROM (SELECT *, CASE lower(trim(tag_value)) WHEN 'email' THEN 'EMAIL' WHEN 'ssn' THEN 'SSN' WHEN 'confidential' THEN 'SENSITIVE' ELSE CASE WHEN lower(tag_name) = 'pii' THEN 'PII_GENERIC' END END AS pii_type
 FROM tags WHERE lower(tag_name) IN ('pii', 'classification')) WHERE pii_type IS NOT NULL)"""


@query("pi06_tags", f"WITH {INV}, {TAGS}, {BY_TAG} SELECT * FROM by_tag")
def _(t):
    return op.detect_by_tag(tags(t))


@query("pi07_confidence_label", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity / 50 >= 0.7 THEN 'high' WHEN l_quantity / 50 >= 0.4 THEN 'medium' ELSE 'low' END AS confidence FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", P.confidence_label(F.col("l_quantity") / 50).alias("confidence"))


def table_findings(t):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("PERSON_NAME", "DATE_OF_BIRTH", "ADDRESS", "FINANCIAL", "CREDENTIAL", "EMAIL", "PHONE")]), (F.col("event_id") % 7 + 1).cast("int"))
    return t.events.select(
        F.lit("web").alias("table_schema"), F.concat(F.lit("t"), "user_id").alias("table_name"), F.concat(F.lit("c"), "event_id").alias("column_name"),
        kind.alias("pii_type"), F.lit("column_name").alias("detection_method"), (F.lit(0.5) + (F.col("event_id") % 5) / 10).alias("confidence_score"), F.lit("hash").alias("suggested_masking"))


FOUND = """f AS (SELECT 'web' AS table_schema, 't' || user_id AS table_name, 'c' || event_id AS column_name,
 ['PERSON_NAME', 'DATE_OF_BIRTH', 'ADDRESS', 'FINANCIAL', 'CREDENTIAL', 'EMAIL', 'PHONE'][(event_id % 7 + 1)::INT] AS pii_type, 'column_name' AS detection_method,
 0.5 + (event_id % 5) / 10 AS s, 'hash' AS suggested_masking FROM events),
ty AS (SELECT table_schema, table_name, list(DISTINCT pii_type) AS types FROM f GROUP BY 1, 2)"""
H = {flag: f"(list_has_all(types, {list(need)}) AND pii_type IN {need})" for flag, need, _ in P.CORRELATIONS}
BOOST = "s"
for _flag, _need, _b in P.CORRELATIONS:
    BOOST = f"CASE WHEN {H[_flag]} THEN least({BOOST} + {_b}, 1.0) ELSE {BOOST} END"
FLAGS = "concat_ws(',', " + ", ".join(f"CASE WHEN {H[x]} THEN '{x}' END" for x in H) + ")"


@query("pi08_correlation", f"""WITH {FOUND} SELECT table_schema, table_name, column_name, pii_type, detection_method, suggested_masking, confidence_score, correlation_flags,
 CASE WHEN confidence_score >= 0.7 THEN 'high' WHEN confidence_score >= 0.4 THEN 'medium' ELSE 'low' END AS confidence
 FROM (SELECT *, round({BOOST}, 4) AS confidence_score, {FLAGS} AS correlation_flags FROM f JOIN ty USING (table_schema, table_name))""")
def _(t):
    return op.correlate(table_findings(t))


ALL = f"WITH {INV}, {BY_NAME}, {TAGS}, {BY_TAG}, "
BEST = "best AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY table_schema, table_name, column_name, pii_type ORDER BY confidence_score DESC) AS rn FROM (SELECT * FROM by_name UNION ALL SELECT * FROM by_tag)) WHERE rn = 1)"


@query("pi09_best_findings", ALL + BEST + " SELECT * FROM best")
def _(t):
    return op.best_findings(op.detect_by_name(inventory(t)), op.detect_by_tag(tags(t)))


HIGH = ", ".join(f"'{x}'" for x in P.HIGH_RISK)


@query("pi09_risk_level", ALL + BEST + f""" SELECT count(*) AS n_findings, count(*) FILTER (WHERE pii_type IN ({HIGH})) AS n_high_risk,
 CASE WHEN count(*) FILTER (WHERE pii_type IN ({HIGH})) > 0 OR count(*) >= 10 THEN 'HIGH' WHEN count(*) >= 3 THEN 'MEDIUM' WHEN count(*) > 0 THEN 'LOW' ELSE 'NONE' END AS risk_level FROM best""")
def _(t):
    return op.risk(op.best_findings(op.detect_by_name(inventory(t)), op.detect_by_tag(tags(t))))


OWN = P.PiiConfig(name_patterns={"LOYALTY": "(?i)(note|order_id)"}, disabled=("CREDIT_CARD", "ADDRESS"), masks={"PHONE": "hash"})
OWN_NAMES = OWN.names()


@query("pi10_own_configuration", f"""WITH {INV} SELECT table_name, column_name, pii_type, CASE pii_type WHEN 'PHONE' THEN 'hash' WHEN 'LOYALTY' THEN 'redact' ELSE {mask_case()} END AS suggested_masking
FROM (SELECT *, {name_case(OWN_NAMES)} AS pii_type FROM inv) WHERE pii_type IS NOT NULL""")
def _(t):
    return op.detect_by_name(inventory(t), OWN).select("table_name", "column_name", "pii_type", "suggested_masking")


def _scan(t, part):
    hour = (F.hour("ts") + F.col("event_id") % 2) % 24 if part else F.hour("ts")
    return t.events.groupBy(F.lit("web").alias("table_schema"), F.concat(F.lit("t"), F.col("user_id")).alias("table_name"), F.concat("event_type", hour.cast("int")).alias("column_name")).agg(
        F.when(F.max("value") > 60, "SSN").otherwise("EMAIL").alias("pii_type"), F.when(F.count(F.lit(1)) > 1, "high").otherwise("low").alias("confidence"))


SCAN = """SELECT 'web' AS table_schema, 't' || user_id AS table_name, event_type || {h} AS column_name, CASE WHEN max(value) > 60 THEN 'SSN' ELSE 'EMAIL' END AS pii_type,
 CASE WHEN count(*) > 1 THEN 'high' ELSE 'low' END AS confidence FROM events GROUP BY 1, 2, 3"""
TWO = f"a AS ({SCAN.format(h='hour(ts)')}), b AS ({SCAN.format(h='(hour(ts) + event_id % 2) % 24')})"


@query("pi11_scan_changes", f"""WITH {TWO} SELECT table_schema, table_name, column_name, a.pii_type AS pii_type_before, a.confidence AS confidence_before, b.pii_type AS pii_type_after, b.confidence AS confidence_after,
 CASE WHEN a.pii_type IS NULL THEN 'new' WHEN b.pii_type IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (table_schema, table_name, column_name)
 WHERE a.pii_type IS DISTINCT FROM b.pii_type OR a.confidence IS DISTINCT FROM b.confidence""")
def _(t):
    return op.scan_changes(_scan(t, 0), _scan(t, 1))


@query("pi12_remediation_upsert", f"""WITH {TWO} SELECT * FROM a ANTI JOIN b USING (table_schema, table_name, column_name) UNION ALL SELECT * FROM b""")
def _(t):
    return merge(_scan(t, 0), _scan(t, 1), list(op.WHERE))


def spans_sql(table, key, ty, extra=None):
    ex = f"regexp_extract_all(text, '{P.TEXT_PATTERNS[ty]}')"
    if extra:
        ex = f"list_filter({ex}, lambda s: {extra('s')})"
    return f"SELECT {key}, '{ty}' AS pii_type, len({ex}) AS n_spans FROM {table} WHERE len({ex}) > 0"


TEXT_TYPES = ("EMAIL", "SSN", "IP_ADDRESS", "PHONE", "MAC_ADDRESS")


@query("pi13_text_spans", " UNION ALL ".join(spans_sql("documents", "doc_id", ty, VALID.get(ty)) for ty in TEXT_TYPES))
def _(t):
    return op.text_span_counts(t.documents, ["doc_id"], "text", TEXT_TYPES)


@query("pi13_conversation_spans", " UNION ALL ".join(spans_sql("conversations", "conv_id, turn", ty, VALID.get(ty)) for ty in TEXT_TYPES))
def _(t):
    return op.text_span_counts(t.conversations, ["conv_id", "turn"], "text", TEXT_TYPES)


# ---- masks -------------------------------------------------------------------------------------

PARTIAL = "(substr({c}, 1, 1) || repeat('*', greatest(length({c}) - 2, 0)) || substr({c}, length({c}), 1))"


@query("mk01_mask_strategies", W + f"""SELECT c_custkey, sha256(ssn) AS hashed, CASE WHEN full_name IS NULL THEN '***REDACTED***' ELSE '***REDACTED***' END AS redacted, 0::DOUBLE AS redacted_number, NULL::VARCHAR AS nulled,
 substr(email, 1, 1) || '***@' || split_part(email, '@', -1) AS mailed, {PARTIAL.format(c='full_name')} AS part, upper(remark) AS expr FROM persons""")
def _(t):
    p = persons(t)
    ty = lambda c: p.schema[c].dataType
    m = lambda c, s: M.mask(F.col(c), s, ty(c))
    return p.select("c_custkey", m("ssn", "hash").alias("hashed"), m("full_name", "redact").alias("redacted"), m("c_acctbal", "redact").alias("redacted_number"),
                    m("phone", "null").alias("nulled"), m("email", "email_mask").alias("mailed"), m("full_name", "partial").alias("part"), m("remark", "upper(remark)").alias("expr"))


@query("mk02_mask_table", W + f"SELECT * REPLACE ('***REDACTED***' AS full_name, substr(email, 1, 1) || '***@' || split_part(email, '@', -1) AS email, sha256(ssn) AS ssn, sha256(credit_card) AS credit_card, {PARTIAL.format(c='phone')} AS phone, 0::DOUBLE AS c_acctbal) FROM persons")
def _(t):
    return M.apply_masks(persons(t), [{"column": "full_name", "strategy": "redact"}, {"match": "^EMAIL$", "strategy": "email_mask"}, {"match": "ssn|card", "strategy": "hash"},
                                      {"column": "phone", "strategy": "partial"}, {"column": "c_acctbal", "strategy": "redact"}])


SUBJECT = "c42@example2.com"
ANON = f"""SELECT c_custkey, CASE WHEN hit THEN '***REDACTED***' ELSE full_name END AS full_name, CASE WHEN hit THEN sha256(email) ELSE email END AS email,
 CASE WHEN hit THEN {PARTIAL.format(c='phone')} ELSE phone END AS phone, CASE WHEN hit THEN sha256(ssn) ELSE ssn END AS ssn, CASE WHEN hit THEN sha256(credit_card) ELSE credit_card END AS credit_card,
 CASE WHEN hit THEN '***REDACTED***' ELSE ip_addr END AS ip_addr, CASE WHEN NOT hit THEN birth_date END AS birth_date, CASE WHEN hit THEN sha256(iban) ELSE iban END AS iban, remark, c_acctbal
 FROM (SELECT *, email = '{SUBJECT}' AS hit FROM persons)"""


@query("mk03_mask_subject_rows", W + ANON)
def _(t):
    strat = {"full_name": "redact", "phone": "partial", "ssn": "hash", "credit_card": "hash", "ip_addr": "redact", "birth_date": "null", "iban": "hash", "email": "hash"}
    return M.mask_rows(persons(t), F.col("email") == SUBJECT, strat)


@query("mk04_suggested_masks", W + f", {RATES}, {BY_VALUE} SELECT pii_type, {mask_case()} AS suggested_masking, count(*) AS n FROM by_value GROUP BY 1, 2")
def _(t):
    f = op.detect_by_value(persons(t), "crm", "persons", PERSON_COLS)
    return f.groupBy("pii_type", P.suggested_mask(F.col("pii_type")).alias("suggested_masking")).agg(F.count(F.lit(1)).alias("n"))


@query("mk05_mask_by_detection", W + f"SELECT * REPLACE (substr(email, 1, 1) || '***@' || split_part(email, '@', -1) AS email, {PARTIAL.format(c='phone')} AS phone, sha256(ssn) AS ssn, sha256(credit_card) AS credit_card, sha256(ip_addr) AS ip_addr, NULL::VARCHAR AS birth_date, sha256(iban) AS iban) FROM persons")
def _(t):
    p = persons(t)
    return M.apply_masks(p, op.masks_from_findings(op.best_findings(op.detect_by_value(p, "crm", "persons", PERSON_COLS))))


@query("ud02_column_masks", "SELECT c_custkey, 'Customer#*****' || right(c_name, 4) AS c_name, round(c_acctbal, -3) AS c_acctbal FROM customer")
def _(t):
    rules = [{"column": "c_name", "strategy": "concat('Customer#*****', right(c_name, 4))"}, {"column": "c_acctbal", "strategy": "round(c_acctbal, -3)"}]
    return M.apply_masks(t.customer, rules).select("c_custkey", "c_name", "c_acctbal")


@query("ud03_row_filters", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def _(t):
    from tallyframe.operators.relational import row_filter

    return row_filter(t.orders, "o_orderpriority", ["1-URGENT", "2-HIGH"]).select("o_orderkey", "o_orderpriority")


@query("ud06_mask_expression", "SELECT s_suppkey, 'S-' || right(s_name, 5) AS s_name FROM supplier")
def _(t):
    return M.apply_masks(t.supplier, [{"column": "s_name", "strategy": "concat('S-', right(s_name, 5))"}]).select("s_suppkey", "s_name")


# ---- subject requests --------------------------------------------------------------------------


def subject_tables(t):
    o = t.orders.select("o_orderkey", F.col("o_custkey").alias("customer_id"))
    e = t.events.select("event_id", F.col("user_id"), F.col("user_id").alias("account_id"))
    return {"persons": persons(t).withColumn("client_id", F.col("c_custkey")), "orders": o, "events": e}


def subject_columns(tables):
    return {n: su.candidate_columns(df.columns, "customer_id") for n, df in tables.items()}


HITS = """hits AS (SELECT 'persons' AS table_name, 'client_id' AS column_name, count(*) AS n_rows FROM customer WHERE c_custkey = 42
UNION ALL SELECT 'orders', 'customer_id', count(*) FROM orders WHERE o_custkey = 42 UNION ALL SELECT 'events', 'user_id', count(*) FROM events WHERE user_id = 42
UNION ALL SELECT 'events', 'account_id', count(*) FROM events WHERE user_id = 42)"""


@query("sr01_candidate_columns", """
SELECT 'persons' AS table_name, 'client_id' AS column_name, (SELECT count(*) FROM customer) AS n_values
UNION ALL SELECT 'orders', 'customer_id', (SELECT count(*) FROM orders) UNION ALL SELECT 'events', 'user_id', (SELECT count(*) FROM events) UNION ALL SELECT 'events', 'account_id', (SELECT count(*) FROM events)""")
def _(t):
    tb = subject_tables(t)
    return union_all([tb[n].agg(F.count(c).alias("n_values")).select(F.lit(n).alias("table_name"), F.lit(c).alias("column_name"), "n_values")
                      for n, cols in subject_columns(tb).items() for c in cols])


@query("sr02_subject_discovery", f"WITH {HITS} SELECT * FROM hits WHERE n_rows > 0")
def _(t):
    tb = subject_tables(t)
    return su.discover(tb, subject_columns(tb), 42)


@query("sr03_erase_rows", "SELECT * FROM orders WHERE o_custkey <> 42")
def _(t):
    return su.erase(t.orders, "o_custkey", 42)


@query("sr04_anonymise", W + ANON.replace("'***REDACTED***' ELSE ip_addr", "sha256(ip_addr) ELSE ip_addr").replace("ssn, CASE WHEN hit THEN sha256(credit_card)", "ssn, CASE WHEN hit THEN sha256(credit_card)"))
def _(t):
    return su.anonymise(persons(t).withColumnRenamed("ip_addr", "ipv4_x"), "email", SUBJECT, None).withColumnRenamed("ipv4_x", "ip_addr")


@query("sr05_pseudonymise", W + f"SELECT c_custkey, CASE WHEN email = '{SUBJECT}' THEN 'PSEUDO_' || substr(sha256('pseudo_' || email || '_s3cret'), 1, 16) ELSE email END AS email FROM persons")
def _(t):
    return su.pseudonymise(persons(t), "email", SUBJECT, "s3cret").select("c_custkey", "email")


@query("sr06_verify_erased", """
WITH left_over AS (SELECT count(*) AS n FROM (SELECT * FROM orders WHERE o_custkey <> 42) WHERE o_custkey = 42 UNION ALL SELECT count(*) FROM (SELECT * FROM customer WHERE c_custkey <> 42) WHERE c_custkey = 42
UNION ALL SELECT count(*) FROM (SELECT * FROM events WHERE user_id <> 42) WHERE user_id = 42)
SELECT CAST(sum(n) AS BIGINT) AS remaining_rows, count(*) FILTER (WHERE n > 0) AS places, sum(n) = 0 AS erased FROM left_over""")
def _(t):
    tb = subject_tables(t)
    cols = subject_columns(tb)
    clean = {}
    for n, df in tb.items():
        for c in cols[n]:
            df = su.erase(df, c, 42)
        clean[n] = df
    return su.verify_erased(clean, cols, 42)


@query("sr07_impact", f"WITH {HITS} SELECT count(DISTINCT table_name) AS n_tables, count(*) AS n_columns, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM hits WHERE n_rows > 0")
def _(t):
    tb = subject_tables(t)
    return su.impact(su.discover(tb, subject_columns(tb), 42))


@query("sr08_subject_export", """
SELECT 'orders' AS _source_table, o_orderkey AS row_key FROM orders WHERE o_custkey = 42 UNION ALL SELECT 'events', event_id FROM events WHERE user_id = 42""")
def _(t):
    rows = subject_rows({"orders": t.orders, "events": t.events}, {"orders": ["o_custkey"], "events": ["user_id"]}, 42)
    key = F.coalesce(F.get_json_object("row_json", "$.o_orderkey"), F.get_json_object("row_json", "$.event_id"))
    return rows.select("_source_table", key.cast("long").alias("row_key"))


def requests(t):
    st = F.element_at(F.array(*[F.lit(x) for x in ("received", "analyzed", "discovering", "executing", "completed", "cancelled", "failed")]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", st.alias("status"), d.alias("created_at"), F.timestamp_add("DAY", F.lit(30), d).alias("deadline"),
                           F.when(F.col("o_orderkey") % 7 == 4, F.timestamp_add("DAY", (F.col("o_custkey") % 40).cast("int"), d)).alias("completed_at"))


REQ = """req AS (SELECT o_orderkey, ['received', 'analyzed', 'discovering', 'executing', 'completed', 'cancelled', 'failed'][(o_orderkey % 7 + 1)::INT] AS status, o_orderdate AS created_at,
 o_orderdate + INTERVAL 30 DAY AS deadline, CASE WHEN o_orderkey % 7 = 4 THEN o_orderdate + to_days((o_custkey % 40)::INT) END AS completed_at FROM orders)"""


@query("sr09_request_dashboard", f"""WITH {REQ} SELECT count(*) AS total_requests, count(*) FILTER (WHERE status IN ('received', 'analyzed')) AS pending,
 count(*) FILTER (WHERE status IN ('discovering', 'executing')) AS in_progress, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'cancelled') AS cancelled,
 count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE deadline < TIMESTAMP '2001-08-01' AND status NOT IN ('completed', 'cancelled')) AS overdue,
 round(avg(date_diff('day', created_at, completed_at)), 4) AS avg_processing_days FROM req""")
def _(t):
    return su.request_dashboard(requests(t), "2001-08-01")


@query("sr10_deadlines", f"""WITH {REQ} SELECT o_orderkey, CASE WHEN deadline < TIMESTAMP '2001-08-01' THEN 'overdue' ELSE 'approaching' END AS urgency FROM req
WHERE status NOT IN ('completed', 'cancelled') AND deadline <= TIMESTAMP '2001-08-06' AND deadline <> TIMESTAMP '2001-08-01'""")
def _(t):
    return su.deadlines(requests(t), "2001-08-01").select("o_orderkey", "urgency")
