"""Merges that rewrite only the files whose rows change, against merges of whole tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import changes as ch
from tallyframe.operators import filemerge as fm


def rows(df):
    return Counter(map(tuple, df.collect()))


@pytest.fixture
def listed(spark, tmp_path):
    def make(df, files):
        df.repartitionByRange(files, "k").write.parquet(f"{tmp_path}/table")
        fm.list_table(spark, f"{tmp_path}/table", str(tmp_path))
        return str(tmp_path)

    return make


def states(spark, folder, version=None):
    return Counter(r.state for r in fm.file_list(spark, folder, version).collect())


def feed(spark, changes):
    return spark.createDataFrame([(kind, v, None, k, x) for kind, v, k, x in changes],
                                 "_change_type string, _commit_version long, _commit_timestamp timestamp_ntz, k long, x string")


def test_changes_in_three_keys_rewrite_three_files(spark, listed):
    table = spark.range(5000).select(F.col("id").alias("k"), F.col("id").cast("string").alias("x"))
    folder = listed(table, 50)
    before = {r.path for r in fm.file_list(spark, folder).collect()}
    changes = feed(spark, [("update_preimage", 1, 10, "10"), ("update_postimage", 1, 10, "a"), ("update_postimage", 2, 10, "b"),
                           ("delete", 1, 2500, None), ("update_postimage", 1, 4999, None), ("insert", 1, 9000, "new")])
    files = fm.apply_changes_to_files(spark, folder, changes, ["k"], 1)
    assert 1 <= files.where("state = 'replaced'").count() <= 3
    assert {r.path for r in files.where("state <> 'written'").collect()} == before
    assert rows(fm.read_table(spark, folder)) == rows(ch.apply_changes(table, changes, ["k"]))
    assert rows(fm.read_table(spark, folder, 0)) == rows(table)


def test_a_version_is_applied_once_and_in_order(spark, listed):
    folder = listed(spark.createDataFrame([(1, "a"), (2, "b")], "k long, x string"), 2)
    changes = feed(spark, [("insert", 1, 3, "c")])
    for _ in range(2):
        fm.apply_changes_to_files(spark, folder, changes, ["k"], 1)
    assert rows(fm.read_table(spark, folder)) == Counter([(1, "a"), (2, "b"), (3, "c")])
    with pytest.raises(ValueError, match="does not follow"):
        fm.apply_changes_to_files(spark, folder, changes, ["k"], 3)


def test_a_run_that_died_before_its_list_is_run_again(spark, listed):
    folder = listed(spark.createDataFrame([(1, "a"), (2, "b")], "k long, x string"), 2)
    spark.createDataFrame([(7, "half")], "k long, x string").write.parquet(f"{folder}/data-1")
    assert rows(fm.read_table(spark, folder)) == Counter([(1, "a"), (2, "b")])
    fm.apply_changes_to_files(spark, folder, feed(spark, [("delete", 1, 1, None)]), ["k"], 1)
    assert rows(fm.read_table(spark, folder)) == Counter([(2, "b")])


def test_all_rows_deleted_and_an_empty_table_filled(spark, listed):
    folder = listed(spark.createDataFrame([(1, "a"), (2, "b")], "k long, x string"), 2)
    fm.apply_changes_to_files(spark, folder, feed(spark, [("delete", 1, 1, None), ("delete", 1, 2, None)]), ["k"], 1)
    assert fm.read_table(spark, folder).count() == 0
    fm.apply_changes_to_files(spark, folder, feed(spark, []), ["k"], 2)
    fm.apply_changes_to_files(spark, folder, feed(spark, [("insert", 3, 5, "e")]), ["k"], 3)
    assert rows(fm.read_table(spark, folder)) == Counter([(5, "e")])


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("delete_missing", [False, True])
def test_merge_equals_the_merge_of_whole_tables(spark, listed, seed, delete_missing):
    rnd = random.Random(seed)
    value = lambda: rnd.choice([None, "p", "q"])
    table = spark.createDataFrame([(rnd.choice([None, *range(60)]), value()) for _ in range(150)], "k long, x string")
    source = spark.createDataFrame([(k, value()) for k in rnd.sample(range(70), 30)] + [(None, "n")], "k long, x string")
    folder = listed(table, 10)
    fm.merge_to_files(spark, folder, source, ["k"], 1, delete_missing)
    assert rows(fm.read_table(spark, folder)) == rows(ch.merge(table, source, ["k"], delete_missing))


def test_merge_keeps_files_whose_rows_the_source_repeats(spark, listed):
    table = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 5).alias("x"))
    folder = listed(table, 20)
    source = table.withColumn("x", F.when(F.col("k") == 500, 99).otherwise(F.col("x")))
    fm.merge_to_files(spark, folder, source, ["k"], 1, delete_missing=True)
    assert states(spark, folder) == Counter(kept=19, replaced=1, written=1)
    assert rows(fm.read_table(spark, folder)) == rows(source)
    assert states(spark, folder, 0) == Counter(kept=20)


def test_a_key_in_kept_and_rewritten_files_is_not_added_again(spark, tmp_path):
    one = spark.createDataFrame([(1, "new"), (2, "b")], "k long, x string").coalesce(1)
    two = spark.createDataFrame([(1, "old"), (3, "c")], "k long, x string").coalesce(1)
    one.write.parquet(f"{tmp_path}/table")
    two.write.mode("append").parquet(f"{tmp_path}/table")
    fm.list_table(spark, f"{tmp_path}/table", str(tmp_path))
    fm.merge_to_files(spark, str(tmp_path), spark.createDataFrame([(1, "new"), (4, "d")], "k long, x string"), ["k"], 1)
    assert states(spark, str(tmp_path)) == Counter(kept=1, replaced=1, written=1)
    assert rows(fm.read_table(spark, str(tmp_path))) == Counter([(1, "new"), (1, "new"), (2, "b"), (3, "c"), (4, "d")])


def test_repeated_source_keys(spark, listed):
    folder = listed(spark.createDataFrame([(1, "a")], "k long, x string"), 1)
    source = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (2, "d", 1)], "k long, x string, at long")
    with pytest.raises(Exception, match="repeated in the source"):
        fm.merge_to_files(spark, folder, source, ["k"], 1)
    fm.merge_to_files(spark, folder, source, ["k"], 1, order="at")
    assert rows(fm.read_table(spark, folder)) == Counter([(1, "c"), (2, "d")])


def test_maps_paths_with_blanks_and_a_hot_key(spark, tmp_path):
    table = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.create_map(F.lit("a"), F.col("id")).alias("m"))
    folder = f"{tmp_path}/with blank"
    table.repartitionByRange(4, "k").write.parquet(f"{folder}/table")
    fm.list_table(spark, f"{folder}/table", folder)
    source = spark.createDataFrame([(7, {"z": 1}), (5000, {"y": 2})], "k long, m map<string,long>")
    fm.merge_to_files(spark, folder, source, ["k"], 1)
    text = lambda df: rows(df.select("k", F.to_json("m")))
    assert text(fm.read_table(spark, folder)) == text(ch.merge(table, source, ["k"]))
