"""Order statistics by digits against sorted lists."""

import random
from decimal import Decimal
from fractions import Fraction

import pytest

from tallyframe.operators.radix import exact_quantiles
from tallyframe.plans import load_all

PROBS = ["0", "0.1", "0.25", "0.5", "0.75", "0.999", "1"]
SCHEMA = "small int, big long, ends long, money decimal(12,2), wide decimal(38,10), same long, none long"


def brute(values, p):
    v = sorted(x for x in values if x is not None)
    at = Fraction(p) * (len(v) - 1)
    low, high = Fraction(v[at.__floor__()]), Fraction(v[at.__ceil__()])
    return tuple(Decimal((x * 10**10).__trunc__()) / 10**10 for x in (low, high, low + (high - low) * (at - at.__floor__())))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_sorted_values(spark, seed):
    rnd = random.Random(seed)
    maybe = lambda x: None if rnd.random() < 0.1 else x
    data = [(maybe(rnd.randrange(-5, 5)), maybe(2**53 + rnd.randrange(1000)), rnd.choice([-2**63, 2**63 - 1, 0, rnd.randrange(-2**62, 2**62)]),
             maybe(Decimal(rnd.randrange(-10**6, 10**6)) / 100), maybe(Decimal(rnd.randrange(10**26)).scaleb(-10)), 7, None) for _ in range(500)]
    df = spark.createDataFrame(data, SCHEMA)
    columns = df.columns
    got = {(r.column_name, r.prob): r for r in exact_quantiles(df, columns, PROBS).collect()}
    assert {c for c, _ in got} == set(columns) - {"none"}
    for i, c in enumerate(columns[:-1]):
        for p in PROBS:
            r = got[c, float(p)]
            assert (r.low, r.high, r.value) == brute([x[i] for x in data], p), (c, p)
            assert r.n_values == sum(x[i] is not None for x in data)


def test_empty_and_refused(spark):
    df = spark.createDataFrame([], "a long, b double")
    assert exact_quantiles(df, ["a"], [0.5]).count() == 0
    with pytest.raises(TypeError):
        exact_quantiles(df, ["b"], [0.5])
    with pytest.raises(ValueError):
        exact_quantiles(df, ["a"], [1.5])


def test_scans_do_not_grow_with_columns(spark):
    group = "radix-scans"
    seen = []
    for columns in (["c0"], [f"c{i}" for i in range(8)]):
        df = spark.range(5000).selectExpr(*[f"id * {2**30} + {i} as c{i}" for i in range(8)])
        spark.sparkContext.setJobGroup(f"{group}-{len(columns)}", "")
        exact_quantiles(df, columns, PROBS)
        seen.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"{group}-{len(columns)}")))
    spark.sparkContext.setJobGroup("rest", "")
    assert seen[0] == seen[1]


def test_query_with_keys_whose_product_passes_a_long(spark, tmp_path):
    keys = [0, 1, 2**23, 2**23 + 5, 2**40]
    spark.createDataFrame([(k, 1.5 * i) for i, k in enumerate(keys)], "o_orderkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    rows = load_all()[0]["rc15_exact_quantiles"](spark, str(tmp_path)).where("column_name = 'o_orderkey'").collect()
    key = [k * 2**40 + 2**53 + 1 for k in keys]
    assert {r.prob: (r.low, r.high, r.n_values) for r in rows} == {0.25: (key[1], key[1], 5), 0.5: (key[2], key[2], 5), 0.95: (key[3], key[4], 5)}
