"""The exchange of four-grams of code points: what it moves, and that answers meet their four-grams."""

import random

import numpy as np
import pyarrow as pa

from tallyframe.llm import alphabet
from tallyframe.llm import exchange as ex
from tallyframe.llm.batches import from_planes, to_planes


def moved(plan) -> int:
    """Rows that the shuffles of an executed plan wrote."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return moved(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return moved(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
    return own + sum(moved(plan.children().apply(i)) for i in range(plan.children().size()))


def test_four_grams_are_moved_coded(spark):
    """A four-gram that a piece asks for is no row of a shuffle, on the way to its value or back."""
    r = random.Random(6)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(400)]
    rows = [(i, " ".join(r.sample(words, 400))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(30, "doc_id")
    pieces = ex.write_pieces(docs)
    asked = ex.total(pieces, lambda table: len(alphabet.Grams(table, "text").known))
    found = alphabet.answers(pieces, "text")[0]
    assert sum(x.n for x in found.collect()) == asked
    assert moved(found._jdf.queryExecution().executedPlan()) < asked


def test_answers_meet_their_four_grams():
    """Several parts and shards, and more code points than 16 bits hold."""
    r, shards = random.Random(7), 3
    texts = ["".join(chr(0x4E00 + r.randrange(100_000)) if r.random() < 0.9 else r.choice("ab é") for _ in range(150_000)) for _ in range(2)] + [None, "", "abc"]
    texts = [t and t.encode("utf-16", "surrogatepass").decode("utf-16", "replace") for t in texts]
    table = pa.table({"text": pa.array(texts)})
    g = alphabet.Grams(table, "text")
    n = len(g.known)
    assert n > alphabet.PART
    p = np.stack([(np.arange(n) + 1) / (n + 1), (n - np.arange(n)) / (n + 1)])
    dealt = {s: [] for s in range(shards)}
    for part, first in enumerate(range(0, n, alphabet.PART)):
        hi, lo = g.hi[first: first + alphabet.PART], g.lo[first: first + alphabet.PART]
        order, ranges = alphabet._dealing(hi, lo, shards)
        for s, a, b in ranges:
            dealt[s].append((s, 5, part, b - a, alphabet._coded(hi[order[a:b]], lo[order[a:b]])))
    found = {}
    for s, rows in dealt.items():
        own = np.random.default_rng(s).permutation(np.flatnonzero(alphabet._shard(g.hi, g.lo, shards) == s))
        values = pa.table({"hi": g.hi[own], "lo": g.lo[own], "p0": p[0][own], "p1": p[1][own]})
        answer = alphabet._answer(shards)(pa.Table.from_batches([ex._batch(rows, alphabet.DEALT_TYPES)]), values)
        found |= {x["shard"]: (x["n"], x["bits"]) for x in answer.to_pylist()}
    got, scored = alphabet.held_out(table, "text", found, shards)
    assert scored.tolist() == [len(t) - 3 if t and len(t) > 3 else 0 for t in texts]
    np.testing.assert_array_equal(got, g.log_perplexity(np.log(p).astype(np.float32)))


def test_shards_agree(spark):
    """Spark and numpy deal a four-gram to the same shard, whatever its code points."""
    from pyspark.sql import functions as F

    top = (1 << 2 * alphabet.POINT) - 1
    pairs = [(0, 0), (top, top), (top, 0), (0, top), *((random.Random(i).randint(0, top), random.Random(-i - 1).randint(0, top)) for i in range(200))]
    rows = spark.createDataFrame(pairs, "hi long, lo long").select("hi", "lo", alphabet._shard(F.col("hi"), F.col("lo"), 37).alias("s")).collect()
    hi, lo = np.array([(x.hi, x.lo) for x in rows]).T
    assert alphabet._shard(hi, lo, 37).tolist() == [x.s for x in rows]
    assert len({x.s for x in rows}) > 30


def test_pieces_go_once_scores_are_written(spark):
    """Texts are kept in one written table, not in the pieces as well."""
    import os

    from tallyframe.common import scratch_dir
    from tallyframe.llm.perplexity import keep_good

    folder, tables = scratch_dir(spark), lambda: {t.name for t in spark.catalog.listTables() if t.name.startswith("tallyframe_pieces")}
    before, known = set(os.listdir(folder)), tables()
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(["stone", "river", "garden", "window", "letter"]) for _ in range(60)), "en") for i in range(40)]
    kept = keep_good(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    made = set(os.listdir(folder)) - before
    assert any("-quality-" in x for x in made) and not any("-pieces-" in x for x in made)
    assert tables() == known
    assert {(x.doc_id, x.text, x.lang) for x in kept.collect()} <= set(rows) and kept.count() > 20


def test_planes_come_back():
    for shape, width, dtype in (((4, 1000), 3, np.uint32), ((2, 7), 4, np.float32), ((2, 0), 4, np.uint32)):
        values = (np.random.default_rng(1).integers(0, 1 << 21, shape)).astype(dtype)
        np.testing.assert_array_equal(from_planes(to_planes(values, width), shape, width, dtype), values)
