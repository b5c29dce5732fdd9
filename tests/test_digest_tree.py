"""Trees of digests: where they differ, what is read, and how they follow changes."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import digesttree as dt
from tallyframe.operators import reconcile as rc

SCHEMA = "k long, x string, v double"


def hashed():
    return dt.row_hash(["k", "x", "v"])


def rows(df):
    return Counter(map(tuple, df.collect()))


def brute_leaves(a, b, width):
    """Leaves whose rows differ as multisets."""
    sides = [Counter((None if r[0] is None else r[0] // width, tuple(r)) for r in t) for t in (a, b)]
    return {leaf for leaf, _ in (sides[0] - sides[1]) | (sides[1] - sides[0])}


@pytest.mark.parametrize("seed", [1, 2])
def test_leaves_that_differ(spark, seed):
    rnd = random.Random(seed)
    a = [(rnd.choice([None, rnd.randrange(-3000, 3000)]), rnd.choice(["p", None]), rnd.choice([0.5, None])) for _ in range(400)]
    b = [r for r in a if rnd.random() > 0.02] + [(5000 + seed, "new", 1.0), a[0], a[0]]
    trees = [dt.digest_tree(spark.createDataFrame(t, SCHEMA), "k", hashed(), 10, 3) for t in (a, b)]
    assert {r.node for r in dt.differing_leaves(*trees, 3).collect()} == brute_leaves(a, b, 10)
    assert dt.differing_leaves(trees[0], trees[0], 3).count() == 0


def test_every_level_holds_all_rows(spark):
    df = spark.range(-500, 500).select(F.col("id").alias("k"), F.lit("x").alias("x"), F.lit(None).cast("double").alias("v"))
    tree = dt.digest_tree(df, "k", hashed(), 7, 2)
    assert {tuple(r) for r in tree.groupBy("level").agg(F.sum("n_rows"), F.sum("sum_hash")).select("sum(n_rows)").collect()} == {(1000,)}
    assert {r.node for r in tree.where("level = 1").collect()} == {(i // 7) // dt.FANOUT for i in range(-500, 500)}


def test_one_changed_key_reads_one_leaf(spark, tmp_path):
    df = spark.range(100_000).select(F.col("id").alias("k"), F.lit("x").alias("x"), F.lit(1.0).alias("v"))
    for name, t in (("a", df), ("b", df.withColumn("x", F.when(F.col("k") == 4321, "y").otherwise(F.col("x"))))):
        t.repartitionByRange(8, "k").write.parquet(f"{tmp_path}/{name}")
        dt.digest_tree(t, "k", hashed(), 100).write.partitionBy("level").parquet(f"{tmp_path}/{name}-tree")
    a, b, ta, tb = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("a", "b", "a-tree", "b-tree"))
    leaves = dt.differing_leaves(ta, tb)
    assert [r.node for r in leaves.collect()] == [43]
    read = dt.rows_of_leaves(a, "k", 100, leaves)
    assert read.count() == 100
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(k,4300)" in plan and "LessThanOrEqual(k,4399)" in plan
    assert rows(dt.tree_column_diffs(a, b, ta, tb, "k", 100)) == Counter([(4321, "x", "x", "y")])


def test_many_ranges_are_joined(spark, monkeypatch):
    monkeypatch.setattr(dt, "MOST_RANGES", 3)
    a = spark.createDataFrame([(i, "x", 1.0) for i in range(200)] + [(None, "n", 1.0)], SCHEMA)
    b = a.withColumn("v", F.when(F.col("k") % 20 == 0, 2.0).otherwise(F.col("v")))
    trees = [dt.digest_tree(t, "k", hashed(), 5) for t in (a, b)]
    assert rows(dt.tree_column_diffs(a, b, *trees, "k", 5)) == rows(rc.column_diffs(a, b, ["k"]))


def test_neighbours_are_one_range(spark):
    leaves = spark.createDataFrame([(n,) for n in (-2, -1, 0, 1, 5, 6, 4095, 4096, None)], "node long")
    assert rows(dt.key_ranges(leaves)) == Counter([(-2, -1), (0, 1), (5, 6), (4095, 4095), (4096, 4096)])


def test_a_tree_follows_changes(spark):
    old = [(1, "a", 1.0), (2, "b", 1.0), (300, "c", None), (None, "n", 1.0)]
    new = [(1, "a", 1.0), (2, "B", 1.0), (301, "d", 2.0)]
    frame = lambda t: spark.createDataFrame(t, SCHEMA)
    tree = dt.digest_tree(frame(old), "k", hashed(), 10)
    after = dt.updated_tree(tree, frame([r for r in old if r not in new]), frame([r for r in new if r not in old]), "k", hashed(), 10)
    assert rows(after) == rows(dt.digest_tree(frame(new), "k", hashed(), 10))


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(7, "x", 1.0)], SCHEMA)
    trees = [dt.digest_tree(t, "k", hashed(), 10) for t in (none, some)]
    assert dt.differing_leaves(trees[0], trees[0]).count() == 0
    assert [r.node for r in dt.differing_leaves(*trees).collect()] == [0]
    assert dt.tree_column_diffs(none, some, *trees, "k", 10).count() == 0
