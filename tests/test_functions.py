"""Literal cases for validators, masks, checks, periods, schemas and graphs."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions import checks as C
from tallyframe.functions import masks as M
from tallyframe.functions import pii as P
from tallyframe.functions import validators as V
from tallyframe.operators import changes as ch
from tallyframe.operators import contracts as dc
from tallyframe.operators import graph as g
from tallyframe.operators import master as mm
from tallyframe.operators import schema as sc
from tallyframe.operators import subject as su
from tallyframe.operators.checkset import Check, apply_checks, checks_from_yaml, checks_to_yaml, split


def one(spark, values, build, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"s {typ}")
    return [x.r for x in df.select(build(F.col("s")).alias("r")).collect()]


def test_luhn(spark):
    assert one(spark, ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1112", "411111111111", "", "x"], V.luhn) == [True, True, False, False, False, False]


def test_iban(spark):
    assert one(spark, ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013001", "DE", "89DE370400440532013000"], V.iban) == [True, True, False, False, False]


def test_ipv4(spark):
    assert one(spark, ["192.168.1.1", "256.1.1.1", "01.2.3.4", "1.2.3", " 8.8.8.8 ", "a.b.c.d"], V.ipv4) == [True, False, False, False, True, False]


def _is6(s):
    try:
        ipaddress.IPv6Address(s)
        return True
    except ValueError:
        return False


def test_ipv6_against_the_standard_library(spark):
    rnd = random.Random(7)
    vals = ["::", "::1", "1::", "2001:db8::8a2e:370:7334", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", ":::", "1::2::3", "12345::", "g::1", "::ffff:192.0.2.1", "::ffff:192.0.2.256", "1:2:3:4:5:6:1.2.3.4", ""]
    vals += [str(ipaddress.IPv6Address(rnd.getrandbits(128) & rnd.getrandbits(128) & rnd.getrandbits(128))) for _ in range(60)]
    assert [bool(x) for x in one(spark, vals, V.ipv6)] == [_is6(v) for v in vals]
    for cidr in ("2001:db8::/32", "::/0", "2001:db8::8a2e:0:0/100", "::1/128", "8000::/1"):
        net = ipaddress.IPv6Network(cidr, strict=False)
        want = [_is6(v) and ipaddress.IPv6Address(v) in net for v in vals]
        assert [bool(x) for x in one(spark, vals, lambda c, cidr=cidr: V.ipv6_in_cidr(c, cidr))] == want


def test_partial_mask(spark):
    assert one(spark, ["abcd", "ab", "a", None], M.partial) == ["a**d", "ab", "aa", None]


def test_masks_by_type(spark):
    df = spark.createDataFrame([(1, 2.5, "ann@x.org")], "i int, d double, e string")
    row = M.apply_masks(df, [{"column": "i", "strategy": "hash"}, {"column": "d", "strategy": "redact"}, {"match": "^E$", "strategy": "email_mask"}]).first()
    assert tuple(row) == (None, 0.0, "a***@x.org")


def test_subject_masks_see_the_unmasked_row(spark):
    df = spark.createDataFrame([("a@x", "Ann", "1"), ("b@x", "Bob", "2")], "email string, full_name string, phone string")
    got = {tuple(r) for r in su.anonymise(df, "email", "a@x").collect()}
    assert ("b@x", "Bob", "2") in got and len(got) == 2
    hashed = next(r for r in got if r[0] != "b@x")
    assert len(hashed[0]) == 64 and hashed[1] == M.REDACTED and hashed[2] == "11"


def test_value_patterns(spark):
    cases = {"SSN": ("123-45-6789", "123456789"), "EMAIL": ("user@example.com", "user@"), "IP_ADDRESS": ("192.168.1.1", "999.1.1.1"), "CREDIT_CARD": ("4111 1111 1111 1111", "4111 1111 1111 1112"),
             "PHONE": ("+1 (555) 123-456", "12ab"), "DATE_OF_BIRTH": ("1990-01-02", "1990/01/02"), "ZIP_CODE": ("12345-6789", "1234"), "MAC_ADDRESS": ("00:1A:2b:3c:4d:5e", "00:1A"), "NATIONAL_ID_NINO": ("AB123456C", "AB123456E")}
    for t, (good, bad) in cases.items():
        assert one(spark, [good, bad], lambda c, t=t: P.value_matches(c, t)) == [True, False], t


def test_column_names(spark):
    names = ["email_address", "Phone", "company", "order_id", "product_name", "user_ssn", "birth_date", "hotel"]
    assert one(spark, names, P.type_of_name) == ["EMAIL", "PHONE", "CREDIT_CARD", None, None, "SSN", "DATE_OF_BIRTH", "PHONE"]
    strict = P.PiiConfig(whole_words=True)
    assert one(spark, names, lambda c: P.type_of_name(c, strict)) == ["EMAIL", "PHONE", None, None, None, "SSN", "DATE_OF_BIRTH", None]


def test_text_spans(spark):
    text = "call +1 555 010 9999 or mail a@b.org, c@d.net; card 4111 1111 1111 1111, ip 10.0.0.1 and 300.1.1.1"
    assert one(spark, [text], lambda c: P.text_spans(c, "EMAIL")) == [2]
    assert one(spark, [text], lambda c: P.text_spans(c, "CREDIT_CARD")) == [1]
    assert one(spark, [text], lambda c: P.text_spans(c, "IP_ADDRESS")) == [1]
    assert one(spark, ["no digits here", None], lambda c: P.text_spans(c, "PHONE")) == [0, 0]


def test_checks_let_null_pass(spark):
    for f in (lambda c: C.is_in_list(c, ["a"]), lambda c: C.is_in_range(c, "a", "b"), lambda c: C.regex_match(c, "x"), C.is_valid_date, C.is_valid_json, C.is_not_empty, lambda c: C.is_equal_to(c, "a")):
        assert one(spark, [None], f) == [False]
    assert one(spark, [None, "", "x"], C.is_not_null_and_not_empty) == [True, True, False]


def test_json_checks(spark):
    vals = ['{"k": 1, "z": 2}', '{"z": 1}', "{", None]
    assert one(spark, vals, C.is_valid_json) == [False, False, True, False]
    assert one(spark, vals, lambda c: C.has_json_keys(c, ["k"])) == [False, True, True, False]
    assert one(spark, vals, lambda c: C.has_json_keys(c, ["k", "z"], require_all=False)) == [False, False, True, False]
    assert one(spark, ['{"k": 1}', '{"k": "x"}', "nope"], lambda c: C.has_valid_json_schema(c, "k int")) == [False, True, True]


def test_split_by_criticality(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (50, "z")], "n int, s string")
    checks = [Check("small", "is_not_greater_than", {"column": "n", "limit": 10}), Check("known", "is_in_list", {"column": "s", "allowed": ["a"]}, "warn"),
              Check("filtered", "is_not_less_than", {"column": "n", "limit": 100}, "error", "s = 'q'")]
    good, bad = split(apply_checks(df, checks))
    assert {x.n for x in good.collect()} == {1, 2}
    assert [(x.n, x._errors, x._warnings) for x in bad.collect()] == [(50, ["small"], ["known"])]
    assert checks_from_yaml(checks_to_yaml(checks)) == checks


def test_retention():
    assert [ch.retention_days(x) for x in ("7d", "2w", "6m", "1y")] == [7, 14, 180, 365]
    for bad in ("7", "d", "x1d", "", "7h"):
        with pytest.raises(ValueError):
            ch.retention_days(bad)


def test_apply_changes_takes_the_last_image(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    feed = spark.createDataFrame([("update_preimage", 1, 1, "a"), ("update_postimage", 1, 1, "x"), ("update_postimage", 2, 1, "y"), ("delete", 1, 2, "b"), ("insert", 1, 4, "n"), ("delete", 2, 4, "n"), ("delete", 1, 3, "c"), ("insert", 3, 3, "c2")],
                                 "_change_type string, _commit_version long, k int, v string").withColumn("_commit_timestamp", F.lit("2024-01-01").cast("timestamp_ntz"))
    assert {tuple(r) for r in ch.apply_changes(base, feed, ["k"]).collect()} == {(1, "y"), (3, "c2")}


def test_repair_makes_tables_equal(spark, tables):
    from tallyframe.operators.reconcile import reconcile_hash
    from tallyframe.plans.fixtures import orders_dest

    dest = orders_dest(tables)
    frames = ch.repair_frames(tables.orders, dest, ["o_orderkey"])
    fixed = dest.join(frames["delete"].select("o_orderkey"), "o_orderkey", "left_anti").join(frames["update"].select("o_orderkey"), "o_orderkey", "left_anti")
    fixed = fixed.unionByName(frames["update"]).unionByName(frames["insert"])
    row = reconcile_hash(tables.orders, fixed, multiset=True).first()
    assert row.missing_in_dest == row.extra_in_dest == 0 and row.match_rate_pct == 100


def test_digest_keeps_column_borders(spark):
    from tallyframe.operators.reconcile import reconcile_hash

    a = spark.createDataFrame([("a|b", "c"), (None, "-")], "x string, y string")
    b = spark.createDataFrame([("a", "b|c"), ("-", "-")], "x string, y string")
    assert reconcile_hash(a, b).first().missing_in_dest == 2
    c = spark.createDataFrame([(None, "x"), ("x", None)], "x string, y string")
    assert reconcile_hash(c.limit(1), c.offset(1)).first().missing_in_dest == 1


def test_columns_of_different_types_compare_as_text(spark):
    from tallyframe.operators.reconcile import reconcile_hash, reconcile_keyed, rows_only_in

    a = spark.createDataFrame([(1, 5), (2, 6)], "k int, v int")
    b = spark.createDataFrame([(1, "5"), (2, "7")], "k int, v string")
    assert reconcile_hash(a, b).first().missing_in_dest == 1
    assert reconcile_keyed(a, b, ["k"]).first().modified_rows == 1
    assert [x.k for x in rows_only_in(a, b).collect()] == [2]


def test_evolve(spark):
    df = spark.createDataFrame([("1", "x", True)], "a string, b string, c boolean")
    want = T.StructType.fromDDL("a int, b string, d date")
    assert sc.evolve(df, want).columns == ["a", "b", "c", "d"]
    row = sc.evolve(df, want, drop_removed=True).first()
    assert tuple(row) == (1, "x", None)


def test_type_compatibility(spark):
    df = spark.createDataFrame([("varchar(10)", "string"), ("int", "bigint"), ("bigint", "string"), ("decimal(10,2)", "double"), ("weird", "weird"), ("date", "timestamp")], "d string, a string")
    assert [x.r for x in df.select(sc.types_compatible(F.col("d"), F.col("a")).alias("r")).collect()] == [True, True, False, True, True, False]


@pytest.mark.parametrize("edges,levels", [
    ([("a", "b"), ("b", "c")], {"a": 0, "b": 1, "c": 2}),
    ([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], {"a": 0, "b": 1, "c": 1, "d": 2}),
    ([("a", "b"), ("b", "a"), ("x", "a"), ("b", "z")], {"x": 0, "a": None, "b": None, "z": None}),
])
def test_topological_levels(spark, edges, levels):
    got = g.topological_levels(spark.createDataFrame(edges, "src string, dst string"))
    assert {x.node: x.level for x in got.collect()} == levels


def jobs_of(spark, work):
    """Result of some work and the number of Spark jobs that it took."""
    import uuid

    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        return work(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_levels_of_a_long_chain(spark):
    """A job per level would be 20,000 of them."""
    n = 20_000
    edges = spark.range(n).select(((F.col("id") * 7919) % 20_011).alias("src"), (((F.col("id") + 1) * 7919) % 20_011).alias("dst"))
    got, jobs = jobs_of(spark, lambda: g.topological_levels(edges))
    assert got.where((F.col("level") * 7919) % 20_011 == F.col("node")).where("NOT on_cycle").count() == got.count() == n + 1
    assert jobs < 120, jobs


def levels_brute(edges, extra=()):
    nodes, into = {x for e in edges for x in e} | set(extra), {}
    for a, b in set(edges):
        into.setdefault(b, set()).add(a)
    level, ready = {}, True
    while ready:
        ready = {x: max((level[a] + 1 for a in into.get(x, ())), default=0) for x in nodes if x not in level and all(a in level for a in into.get(x, ()))}
        level.update(ready)
    return {x: (level.get(x), x not in level) for x in nodes}


@pytest.mark.parametrize("seed", range(6))
def test_levels_of_random_graphs(spark, seed):
    """Forests with long branches, cross links, layers, cycles with tails, loops, repeated edges, nodes without edges."""
    import random

    r = random.Random(seed)
    edges = [(r.choice([i, r.randrange(i + 1)]), i + 1) for i in range(60)]
    edges += [(a, b) for a, b in ((r.randrange(61), r.randrange(61)) for _ in range(r.choice([0, 5, 60]))) if a < b]
    edges += [(100 + 3 * i + a, 103 + 3 * i + b) for i in range(6) for a in range(3) for b in range(3)]  # no chain to compress
    if seed % 2:
        edges += [(200, 201), (201, 202), (202, 200), (202, 203), (203, 204), (5, 200), (204, 30), (300, 300), (300, 301), (400, 401), (401, 400)]
        edges += [(a, b) for a in (500, 501, 502) for b in (500, 501, 502) if a != b] + [(502, 110)]
    edges += edges[:3]
    frame = spark.createDataFrame(edges, "src long, dst long")
    got = g.topological_levels(frame, spark.createDataFrame([(900,), (3,)], "node long"))
    assert {x.node: (x.level, x.on_cycle) for x in got.collect()} == levels_brute(edges, [900, 3])


def test_levels_of_nothing(spark):
    assert g.topological_levels(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_table_references(spark):
    sql = "SELECT * FROM `c`.`s`.`t` JOIN s2.t2 ON x = y JOIN a.b.c USING (k)"
    assert set(one(spark, [sql], lambda c: g.table_references(c, "main"))[0]) == {"c.s.t", "main.s2.t2", "a.b.c", "main.c.s", "main.a.b"}


def test_reachable_with_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    got = {(x.src, x.dst): x.hop for x in g.reachable(e, start, 5).collect()}
    assert got == {("a", "b"): 1, ("b", "c"): 2, ("c", "a"): 3, ("c", "d"): 3}
    assert g.reachable(e, spark.createDataFrame([("q",)], "node string"), 5).count() == 0


def test_hierarchy_flags_cycles(spark):
    n = spark.createDataFrame([("r", None), ("a", "r"), ("b", "a"), ("x", "y"), ("y", "x"), ("z", "x"), ("o", "gone"), ("p", "o")], "node string, parent string")
    got = {x.node: (x.level, x.path, x.on_cycle) for x in mm.hierarchy_paths(n).collect()}
    assert got == {"r": (0, "r", False), "a": (1, "r/a", False), "b": (2, "r/a/b", False), "x": (None, None, True), "y": (None, None, True), "z": (None, None, True),
                   "o": (None, None, False), "p": (None, None, False)}


def test_deep_hierarchy(spark):
    n = spark.createDataFrame([(i, i - 1 if i else None) for i in range(300)], "node long, parent long")
    assert {x.node: (x.level, x.path) for x in mm.hierarchy_paths(n).collect()} == {i: (i, "/".join(map(str, range(i + 1)))) for i in range(300)}


def test_levels_raise_at_a_given_limit(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)], "src long, dst long")
    with pytest.raises(RuntimeError):
        g.topological_levels(edges, max_levels=5)


def test_no_caps(spark):
    """Wide tables, many rows and many jobs are counted whole."""
    from tallyframe.operators import anomaly as an
    from tallyframe.operators import freshness as fr
    from tallyframe.operators import rules as ru

    names = [f"c{i}" for i in range(60)]
    wide = spark.createDataFrame([tuple(None if i == 59 else i for i in range(60))] * 2, ", ".join(f"{n} int" for n in names))
    row = fr.sla_completeness(wide, names, 1.0).first()
    assert row.max_null_pct == 100 and not row.passed
    got = {r.metric_name: r.value for r in an.collect_metrics(wide, "t", names).collect()}
    assert got["null_rate"] == pytest.approx(1 / 60)
    n = spark.createDataFrame([(5_000_000_000,)], "n long")
    assert n.select(ru.within(F.col("n"), 1)).first()[0] and not n.select(ru.within(F.col("n"), 1, 999)).first()[0]


def test_pair_counts_do_not_overflow(spark):
    from tallyframe.operators import reconcile as rc

    per_value = spark.createDataFrame([(1, "a", 4_000_000_000, 4_000_000_000), (1, "b", 4_000_000_000, 0), (None, "a", 9 * 10**18, 9 * 10**18)], "k int, __h string, s long, d long")
    got = {r.k: (int(r.matched_rows), int(r.modified_rows)) for r in rc.pair_counts(per_value, ["k"]).collect()}
    assert got == {1: (16 * 10**18, 16 * 10**18), None: (0, 0)}


def test_merge_refuses_repeated_keys(spark):
    t, s = spark.createDataFrame([(1, "x"), (None, "n")], "k int, v string"), spark.createDataFrame([(1, "y", 1), (1, "z", 2), (None, "a", 1), (None, "b", 2)], "k int, v string, at int")
    with pytest.raises(Exception, match="repeated"):
        ch.merge(t, s.select("k", "v"), ["k"]).collect()
    assert sorted(map(str, ch.merge(t, s, ["k"], order="at").collect())) == sorted(map(str, spark.createDataFrame([(1, "z"), (None, "n"), (None, "a"), (None, "b")], "k int, v string").collect()))


def test_versions_of_null_keys(spark):
    v = spark.createDataFrame([(None, "a", "2024-01-01"), (None, "b", "2024-02-01"), (1, "c", "2024-01-05")], "k int, v string, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    assert {(r.k, r.v, r.is_current) for r in ch.scd2(v, ["k"], "at").collect()} == {(None, "a", False), (None, "b", True), (1, "c", True)}


def test_repair_of_repeated_keys(spark):
    s, d = spark.createDataFrame([(1, "a"), (1, "b"), (2, "x"), (2, "x"), (3, "m")], "k int, v string"), spark.createDataFrame([(1, "z"), (2, "x"), (3, "n"), (4, "q"), (4, "q")], "k int, v string")
    got = sorted((r.k, r.action, r.v, r.copies) for r in ch.repair_plan(s, d, ["k"]).collect())
    assert got == [(1, "delete_copies", "z", 1), (1, "insert", "a", 1), (1, "insert", "b", 1), (2, "insert", "x", 1), (3, "update", "m", 1), (4, "delete_copies", "q", 2)]


def test_contract_comparison_takes_the_first_operator(spark):
    assert one(spark, [5.0, 6.0], lambda c: dc.compare({"mustBe": 5, "mustBeLessThan": 1}, c), "double") == [True, False]
    assert one(spark, [5.0], lambda c: dc.compare({}, c), "double") == [True]


def test_pseudonym_needs_text(spark):
    with pytest.raises(ValueError):
        su.pseudonymise(spark.createDataFrame([(1,)], "k int"), "k", 1, "s")
