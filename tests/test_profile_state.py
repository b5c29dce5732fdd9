"""States of profiles: merged ones tell what a profile of all rows tells."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import profilestate as ps
from tallyframe.operators import stats as st

SCHEMA = "day int, n long, v double, t string, d timestamp_ntz, xs array<int>"


def table(spark, seed, rows=6000):
    rnd = random.Random(seed)
    data = [(rnd.choice([1, 2, 3, None]), rnd.choice([None, 2**53 + rnd.randrange(3000)]), rnd.choice([None, float("nan"), rnd.gauss(10, 5)]),
             rnd.choice([None, "", "ab" * rnd.randrange(40)]), None, [1]) for _ in range(rows)]
    return data, spark.createDataFrame(data, SCHEMA)


@pytest.mark.parametrize("seed", [3, 4])
def test_merged_states_against_all_rows(spark, seed):
    data, df = table(spark, seed)
    got = {r.column_name: r for r in ps.profile_of(ps.merge_states(ps.profile_state(df, ["day"]))).collect()}
    assert set(got) == {"n", "v", "t", "d"}
    for i, c in enumerate(("n", "v", "t", "d"), 1):
        values = [r[i] for r in data if r[i] is not None]
        assert (got[c].n_rows, got[c].null_count) == (len(data), len(data) - len(values))
        # NaN is one value.
        distinct = len({str(x) for x in values})
        assert abs(got[c].distinct_estimate - distinct) <= max(1, ps.DISTINCT_BOUND * distinct)
    numbers = sorted(r[2] for r in data if r[2] is not None and r[2] == r[2])
    assert got["v"].avg_value == pytest.approx(statistics.mean(numbers), abs=1e-4)
    assert (float(got["v"].min_value), float(got["v"].max_value)) == (numbers[0], numbers[-1])
    for p, value in ((0.25, got["v"].p25), (0.5, got["v"].p50), (0.95, got["v"].p95)):
        rank = sum(x <= value for x in numbers) / len(numbers)
        assert abs(rank - p) <= ps.RANK_BOUND
    texts = [r[3] for r in data if r[3] is not None]
    assert (got["t"].min_length, got["t"].max_length) == (min(map(len, texts)), max(map(len, texts)))
    assert got["d"].min_value is None and got["d"].p50 is None and got["t"].p50 is None


def test_merging_in_steps(spark):
    _, df = table(spark, 5, 2000)
    states = ps.profile_state(df.withColumn("half", F.col("n") % 2), ["day", "half"], ["v", "t"])
    steps = ps.profile_of(ps.merge_states(ps.merge_states(states, ["day"])))
    once = ps.profile_of(ps.merge_states(states))
    exact = ["column_name", "n_rows", "null_count", "min_value", "max_value", "avg_value", "min_length", "max_length", "avg_length"]
    assert sorted(map(str, steps.select(exact).collect())) == sorted(map(str, once.select(exact).collect()))


def test_stored_states_read_no_rows(spark, tmp_path):
    _, df = table(spark, 6, 2000)
    df.write.parquet(f"{tmp_path}/rows")
    ps.profile_state(spark.read.parquet(f"{tmp_path}/rows"), ["day"]).write.partitionBy("day").parquet(f"{tmp_path}/states")
    drift = ps.state_drift(spark.read.parquet(f"{tmp_path}/states"), "day", F.lit(3), F.lit(3), F.lit(1), F.lit(2))
    assert all("/states/day=" in f for f in drift.inputFiles())
    plan = drift._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    rows = {r.column_name: r for r in drift.collect()}
    assert rows["v"].now_n_rows == df.where("day = 3").count() and rows["v"].base_n_rows == df.where("day in (1, 2)").count()


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert ps.profile_state(df, ["day"]).count() == 0
    assert ps.profile_of(ps.merge_states(ps.profile_state(df, ["day"]))).count() == 0


def test_categories_of_both_sides(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2), ("y", 2), (None, 2)], "s string, k long")
    got = {r.column_name: r for r in st.compare_categorical(a, a.where("false"), ["s", "k"]).collect()}
    assert (got["s"].source_cardinality, got["s"].source_null_rate, got["s"].source_top_5) == (2, 0.25, "x=2,y=1")
    assert (got["k"].source_top_5, got["k"].dest_cardinality, got["k"].dest_null_rate, got["k"].dest_top_5) == ("2=3,1=1", 0, 0.0, "")
    assert got["k"].delta_cardinality == 2
