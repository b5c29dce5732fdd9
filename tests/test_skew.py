"""Hot keys: a third of all rows in one key must give the same rows as a plain plan."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyframe import common as C
from tallyframe.operators import changes as ch
from tallyframe.operators import checkset as cs
from tallyframe.operators import reconcile as rc
from tallyframe.operators import relational as r


@pytest.fixture(scope="module")
def hot(spark):
    rnd = random.Random(1)
    rows = [(1 if i % 3 == 0 else (None if i % 17 == 0 else rnd.randrange(2, 400)), i, rnd.randrange(1000) / 4) for i in range(3000)]
    return spark.createDataFrame(rows, "k long, id long, v double").repartition(6)


@pytest.fixture(scope="module")
def dim(spark):
    return spark.createDataFrame([(k, f"n{k}") for k in range(0, 400, 2)] + [(1, "hot"), (None, "null")], "k long, name string")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("max_heavy", [2, 50, 1000])
def test_spread_join_is_a_join(hot, dim, how, max_heavy):
    want = hot.join(dim, "k", how)
    got = C.spread_join(hot, dim, ["k"], how, max_heavy=max_heavy, salts=8, fraction=None).select(*want.columns)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_spread_join_deals_hot_rows(hot, dim):
    assert [x.k for x in C.heavy_keys(hot, ["k"], 10, None).collect()] == [1]
    plan = C.spread_join(hot, dim, ["k"], "inner", max_heavy=10, salts=8, fraction=None)
    assert "__salt" in plan._jdf.queryExecution().toString()
    assert plan.count() == hot.join(dim, "k").count()


def test_spread_join_is_plain_without_hot_keys(hot, dim):
    plan = C.spread_join(hot.where("k > 1"), dim, ["k"], "inner", max_heavy=10, salts=8, fraction=None)
    assert "__salt" not in plan._jdf.queryExecution().toString()


def test_a_sample_shows_the_hot_key(hot):
    many = hot.select("k", F.explode(F.sequence(F.lit(1), F.lit(20)))).select("k")
    assert [x.k for x in C.heavy_keys(many, ["k"], 10).collect()] == [1]


def test_spread_join_repeated_right_and_condition(hot, spark):
    right = spark.createDataFrame([(1, 10.0), (1, 100.0), (5, 50.0)], "k long, lim double")
    want = hot.alias("a").join(right.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("v") < F.col("lim")), "left").select("a.k", "id", "v", "lim")
    got = C.spread_join(hot, right, ["k"], "left", extra=F.col("v") < F.col("lim"), max_heavy=10, salts=4, fraction=None).select("k", "id", "v", "lim")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_scratch_folder(spark):
    base = C.scratch_dir(spark)
    assert base == (spark.conf.get("spark.checkpoint.dir", None) or base) and C.new_scratch_path(spark, "x") != C.new_scratch_path(spark, "x")


def test_heavy_keys_are_bounded(hot):
    assert C.heavy_keys(hot, ["k"], 5, None).count() <= 5


@pytest.mark.parametrize("by", [[], ["k"]])
def test_exact_percentiles(hot, by):
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {tuple(x[c] for c in by) + (round(x.prob, 4),): x.value for x in C.exact_percentiles(hot, "v", probs, by).collect()}
    want = hot.groupBy(*by).agg(F.expr("percentile(v, array(0.0, 0.25, 0.5, 0.9, 1.0))").alias("p"))
    n = 0
    for x in want.collect():
        for p, v in zip(probs, x.p, strict=True):
            assert got[tuple(x[c] for c in by) + (p,)] == pytest.approx(v)
            n += 1
    assert n == len(got)


def test_exact_percentile_of_nothing(hot):
    assert C.exact_percentiles(hot.where("id < 0"), "v", [0.5]).collect() == []


def test_top_rows_limits_before_the_shuffle(hot):
    plan = C.top_rows(hot, ["k"], [F.desc("v"), F.col("id")], 2)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_keyed_reconcile_with_repeated_keys_counts_pairs(spark):
    s = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "x"), (None, "n")], "k int, v string")
    d = spark.createDataFrame([(1, "a"), (1, "c"), (3, "y"), (None, "n")], "k int, v string")
    row = rc.reconcile_keyed(s, d, ["k"]).first()
    j = s.alias("s").join(d.alias("d"), "k")
    assert row.matched_rows == j.where("s.v = d.v").count() == 2
    assert row.modified_rows == j.where("s.v <> d.v").count() == 4
    assert row.missing_in_dest == s.join(d, "k", "left_anti").count() == 2
    assert row.extra_in_dest == d.join(s, "k", "left_anti").count() == 2
    assert rc.reconcile_keyed(s, d, ["k"], null_safe=True).first().matched_rows == 3


def test_column_diffs_report_repeated_keys_once(spark):
    s = spark.createDataFrame([(1, "a"), (1, "b"), (2, "x")], "k int, v string")
    d = spark.createDataFrame([(1, "a"), (2, "y")], "k int, v string")
    got = {tuple(x) for x in rc.column_diffs(s, d, ["k"]).collect()}
    assert got == {(1, "*", "2", "1"), (2, "v", "x", "y")}


def test_scd2_with_a_hot_key(spark):
    rows = [(1 if i % 3 else i, i, f"v{i}") for i in range(900)]
    df = spark.createDataFrame(rows, "k int, day int, v string").withColumn("at", F.timestamp_add("DAY", F.col("day"), F.lit("2000-01-01").cast("timestamp_ntz"))).drop("day")
    got = ch.scd2(df, ["k"], "at")
    assert got.count() == 900
    assert got.where("is_current").count() == got.select("k").distinct().count()
    hot = got.where("k = 1").orderBy("valid_from").collect()
    assert all(a.valid_to == b.valid_from for a, b in zip(hot, hot[1:], strict=False)) and hot[-1].is_current


def test_merge_keeps_repeated_target_rows(spark):
    t = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    s = spark.createDataFrame([(1, "n"), (3, "m")], "k int, v string")
    assert Counter(map(tuple, ch.merge(t, s, ["k"]).collect())) == Counter([(1, "n"), (1, "n"), (2, "c"), (3, "m")])
    assert Counter(map(tuple, ch.merge(t, s, ["k"], delete_missing=True).collect())) == Counter([(1, "n"), (1, "n"), (3, "m")])


def test_interval_join_matches_a_theta_join(spark, hot):
    base = F.lit("2020-01-01").cast("timestamp_ntz")
    facts = hot.select("k", "id", F.timestamp_add("DAY", (F.col("id") % 500).cast("int"), base).alias("at"))
    iv = spark.createDataFrame([(1, 0, 40, 1.0), (1, 40, None, 2.0), (2, 10, 300, 3.0), (4, 700, 800, 9.0)], "k long, a int, b int, p double").select(
        "k", F.timestamp_add("DAY", F.col("a"), base).alias("s"), F.timestamp_add("DAY", F.col("b"), base).alias("e"), "p")
    cond = (F.col("f.k") == F.col("i.k")) & (F.col("s") <= F.col("at")) & (F.col("e").isNull() | (F.col("at") < F.col("e")))
    for how in ("left", "inner"):
        want = facts.alias("f").join(iv.alias("i"), cond, how).select("f.k", "id", "p")
        got = r.interval_join(facts, iv, ["k"], "at", "s", "e", how).select("k", "id", "p")
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_unique_and_foreign_key_flags(hot, dim):
    u = cs.mark_unique(hot, ["k"], "dup")
    n = hot.where("k IS NOT NULL").groupBy("k").count().where("count > 1").agg(F.sum("count")).first()[0]
    assert u.where("dup").count() == n and u.count() == hot.count()
    f = cs.mark_foreign_key(hot, "k", dim, "k", "bad")
    assert f.count() == hot.count()
    assert f.where("bad").count() == hot.where("k IS NOT NULL").join(dim, "k", "left_anti").count()


def test_outliers_by_median_deviation(spark):
    df = spark.createDataFrame([(float(i % 7),) for i in range(200)] + [(500.0,), (-500.0,), (None,)], "v double")
    assert sorted(x.v for x in cs.mark_outliers(df, "v", "bad").where("bad").collect()) == [-500.0, 500.0]
    assert cs.mark_outliers(df.where("v IS NULL"), "v", "bad").where("bad").count() == 0


def test_dealt_by_key_bounds_the_rows_of_a_task(spark, monkeypatch):
    monkeypatch.setattr(C, "SPREAD_FROM", 1000)
    monkeypatch.setattr(C, "ROWS_PER_TASK", 500)
    a, b = spark.range(20_000).toDF("k"), spark.range(100, 9000).toDF("k")
    x, y = C.dealt_by_key([a, b], ["k"])
    joined = C.spread_join(x, y.distinct(), ["k"], "left_anti", no_broadcast=True)
    assert joined.count() == 20_000 - 8900
    per_task = x.groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) == 40 and max(r["count"] for r in per_task) < 700
    assert C.dealt_by_key([spark.range(999), b.limit(5)], ["id"])[0].rdd.getNumPartitions() < 40
