"""Hard negatives, phrases and languages against brute force, on rows made to be awkward."""

import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# --- hard negatives ----------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, score string, a int, block string"


def negatives_brute(rows, positives=5, negatives=10):
    good = [(i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, label, *_ in rows
            if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    last = float("inf")
    for at, (i, label, v) in enumerate(good):
        if i is None or i % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), last if j is None else j, j, other) for k, (j, other, w) in enumerate(good) if k != at),
                        key=lambda x: (x[0], x[1]))
        for s, _, p, _ in [x for x in scored if x[3] == label][:positives]:
            fits = [x for x in scored if x[3] != label and 30 * -s <= 100 * -x[0] <= 90 * -s]
            out += [(i, p, r, x[2], -s, -x[0]) for r, x in enumerate(fits[:negatives], 1)]
    return sorted(out, key=str)


def vectors(seed=3, n=700, dims=8):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = r.randrange(6)
        rows.append((i, [x + r.gauss(0, 0.5) for x in centres[c]], c if r.random() < 0.8 else r.randrange(6), "x", 1, "y"))
    same = [0.5] * dims
    rows += [(n + i, same, i % 3, "x", 1, "y") for i in range(300)]  # one vector that a third of the rows hold
    rows += [(100, same, 1, "x", 1, "y"), (200, rows[200][1], rows[200][2], "x", 1, "y"), (200, rows[200][1], rows[200][2], "x", 1, "y")]
    rows += [(5000, None, 1, "x", 1, "y"), (5100, same, None, "x", 1, "y"), (5200, [None] + same[1:], 1, "x", 1, "y"), (5300, [float("nan")] * dims, 1, "x", 1, "y"),
             (5400, [float("inf")] + same[1:], 1, "x", 1, "y"), (None, same, 1, None, None, None), (None, rows[3][1], 2, "x", 1, "y"), (5500, [], 1, "x", 1, "y"),
             (5600, same[:3], 2, "x", 1, "y"), (5700, [0.0] * dims, 3, "x", 1, "y"), (5800, [-x for x in same], 1, "x", 1, "y"), (-100, same, 2, "x", 1, "y")]
    return rows


def mined(spark, rows, **more):
    from tallyframe.llm.negatives import mine_hard_negatives

    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    return sorted([tuple(r) for r in mine_hard_negatives(df, F.col("vec_id") % 100 == 0, **more).collect()], key=str)


def test_negatives(spark, monkeypatch):
    from tallyframe.llm import negatives

    rows = vectors()
    want = negatives_brute(rows)
    assert len(want) > 300
    # Many small blocks and cells, and a first round that is far too short.
    for name, value in (("BLOCK", 40), ("ANCHORS", 3), ("CELL_ROWS", 20), ("FIRST", 2), ("HELD", 2), ("SAMPLE", 100)):
        monkeypatch.setattr(negatives, name, value)
    assert mined(spark, rows) == want


def test_negatives_of_few_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, None, 1, "x", 1, "y")]) == []
    rows = [(100, [1.0], 1, "x", 1, "y"), (1, [1.0], 1, "x", 1, "y"), (2, [0.5], 2, "x", 1, "y"), (3, [0.95], 2, "x", 1, "y"), (200, [-1.0], 9, "x", 1, "y")]
    assert mined(spark, rows) == [(100, 1, 1, 2, 65536, 32768)] == negatives_brute(rows)
    large = [(100, [3e6, 1.0], 1, "x", 1, "y"), (1, [3e6, 1.0], 1, "x", 1, "y"), (2, [1.5e6, -1.0], 2, "x", 1, "y")]
    assert mined(spark, large) == negatives_brute(large) != []
    with pytest.raises(Exception, match="beyond"):
        mined(spark, [(100, [3e30], 1, "x", 1, "y")])


def test_multi_sequence_order():
    """Cells come by falling bound, each once, and the bounds hold for every row."""
    from tallyframe.llm.negatives import Index, fit_codebook

    rng = np.random.default_rng(0)
    rows = np.floor(rng.normal(size=(500, 6)) * 50)
    index = Index(fit_codebook(rows[:, :3], 7), fit_codebook(rows[:, 3:], 5))
    cells, r1, r2 = index.cells(rows)
    keys = np.unique(cells)
    index.fill(keys, np.array([(cells == k).sum() for k in keys]), np.array([r1[cells == k].max() for k in keys]), np.array([r2[cells == k].max() for k in keys]))
    for q in rows[:20]:
        seen = list(index.visit(q))
        bounds = [x[0] for x in seen]
        assert bounds == sorted(bounds, reverse=True) and sorted(x[1] for x in seen) == keys.tolist()
        for bound, cell, high, low in seen:
            scores = rows[cells == cell] @ q
            assert low <= scores.min() and scores.max() <= high and scores.max() <= bound


# --- phrases -----------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, n int, rank string, w1 long, phrase string"


def phrases_brute(rows, least, top=2000):
    total, f = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        total[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(ws)
            for n in (1, 2, 3, 4):
                f.update((lang, tuple(ws[i: i + n])) for i in range(len(ws) - n + 1))
    out = []
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    covered = Counter()
    for (lang, p), a in found.items():
        for n in range(2, len(p)):
            for i in range(len(p) - n + 1):
                covered[lang, p[i: i + n]] = max(covered[lang, p[i: i + n]], a)
    for lang in total:
        kept = []
        for (its, p), a in found.items():
            if its == lang and 100 * covered[lang, p] < 80 * a:
                score, _, left, right = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), a, left, right, score))
        out += [(lang, r, x[2].decode(), *x[3:6], total[lang], x[6]) for r, x in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def texts(seed=5):
    r = random.Random(seed)
    words = ["a", "b", "C", "dé", "日本", "x" * 40, "#", "e"]
    some = lambda n: "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r"]) for _ in range(n))
    rows = [(i, some(r.randint(0, 60)), r.choice(["en", "en", "de", None, "und", ""]), 1, "x", 2, "y") for i in range(60)]
    rows += [(100 + i, "The same long line in many documents.", "en", 1, "x", 2, "y") for i in range(40)]
    rows += [(None, None, "en", 1, "x", 2, "y"), (1, "", None, 1, "x", 2, "y"), (1, " .,; ", "fr", 1, "x", 2, "y"), (7, "a b " * 9000, "long", 1, "x", 2, "y"),
             (8, "a b. " * 300 + "b c " * 300, "long", 1, "x", 2, "y")]
    return rows + rows[:5]


@pytest.mark.parametrize("small", [False, True])
def test_phrases(spark, monkeypatch, small):
    from tallyframe.llm import phrases

    if small:  # many shards, hot words, words without numbers
        for name, value in (("SHARD_SUFFIXES", 600), ("RANKED", 6), ("FILTER_BITS", 1 << 16)):
            monkeypatch.setattr(phrases, name, value)
    rows = texts()
    got = phrases.collocations(spark.createDataFrame(rows, DOCS).repartition(4), least=5)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = phrases_brute(rows, 5)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 80
    assert sorted(tuple(r) for r in phrases.collocations(spark.createDataFrame(rows, DOCS), least=5, top=3).collect()) == phrases_brute(rows, 5, 3)


def test_tokens_of_long_texts(monkeypatch):
    """Texts cut into parts and blocks have the same words, and the same ones follow each other."""
    import pyarrow as pa

    from tallyframe.llm import phrases

    rows = texts()
    args = pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])
    t = phrases.Tokens(*args)
    want = [(w, i + 1 < len(ws)) for _, text, *_ in rows for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))
            for ws in [re.findall(r"[^\x20\x09]+", piece)] for i, w in enumerate(ws)]
    assert list(zip(t.words(np.arange(len(t.hash))).to_pylist(), t.follows.tolist())) == want
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 64)
    parts = phrases.Tokens(*args)
    for name in ("start", "end", "lang", "hash", "follows"):
        assert (getattr(parts, name) == getattr(t, name)).all()


def test_phrases_of_nothing(spark):
    from tallyframe.llm.phrases import collocations

    assert collocations(spark.createDataFrame([], DOCS)).collect() == []
    assert collocations(spark.createDataFrame([(1, None, None, 1, "x", 2, "y")], DOCS)).collect() == []


def test_equal_partitions():
    from tallyframe.llm.phrases import equal_partitions

    rng = np.random.default_rng(1)
    for n, least in ((0, 1), (1, 1), (500, 1), (3000, 7), (3000, 10**6)):
        keys = rng.integers(0, 6, (4, n))
        keys[1:][np.cumsum(keys == 0, axis=0)[:-1] > 0] = 0  # nothing follows the end of a piece
        weight = rng.integers(1, 4, n)
        want = Counter()
        for row, w in zip(keys.T.tolist(), weight.tolist()):
            for d in range(1, 5):
                if row[d - 1]:
                    want[tuple(row[:d])] += w
        got = {}
        for d, lead, counts in equal_partitions(keys, weight, least):
            for p, c in zip(keys[:d, lead].T.tolist(), counts.tolist()):
                assert tuple(p) not in got
                got[tuple(p)] = c
        assert got == {p: c for p, c in want.items() if c >= least}


# --- languages ---------------------------------------------------------------------------------------


def speech(seed=2):
    r = random.Random(seed)
    parts = {"en": "the and ing tion er of to wh", "de": "der die ung sch keit ü ß ich", "el": "και του ης ους την α", "": "zz qq xx"}
    rows = []
    for i in range(400):
        lang = r.choice(list(parts))
        text = " ".join("".join(r.choice(parts[lang].split()) for _ in range(r.randint(1, 3))) for _ in range(r.randint(4, 60)))
        rows.append((i, r.choice([text, text.upper(), text + "\n1234"]), lang, 1, "x", 2, "y"))
    rows += [(1000, None, "en", 1, "x", 2, "y"), (1001, "", "de", 1, "x", 2, "y"), (1002, "12 + 3 = \n—", "de", 1, "x", 2, "y"), (None, "the and ingtion", "el", 1, "x", 2, "y"),
             (1003, "und der die ichkeit", None, 1, "x", 2, "y"), (1004, "the of whing " * 60000, "en", 1, "x", 2, "y"), (1005, "日本語のテキスト" * 40, None, 1, "x", 2, "y")]
    return rows + rows[:3]


def identified(spark, rows):
    from tallyframe.llm.languages import identify_languages

    df = spark.createDataFrame(rows, DOCS.replace("rank", "score")).repartition(3)
    return identify_languages(df, F.crc32(F.col("doc_id").cast("string")) % 3 != 1)


def test_languages(spark):
    rows = speech()
    df = identified(spark, rows)
    assert df.columns == ["doc_id", "lang", "n", "w1", "phrase", "lang_pred", "score", "distance", "rejected"]
    got = df.collect()
    assert len(got) == len(rows)
    held_out = [r for r in got if r.doc_id is not None and r.doc_id < 1000 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held_out) > 80 and sum(r.lang_pred == r.lang for r in held_out) >= 0.98 * len(held_out)
    by = {r.doc_id: r for r in got if r.doc_id is None or r.doc_id >= 1000}
    assert [(by[i].lang_pred, by[i].score, by[i].rejected) for i in (1000, 1001, 1002)] == [("und", 0.0, False)] * 3
    assert by[None].lang_pred == "en" and by[1003].lang_pred == "de" and by[1004].lang_pred == "en" and by[1005].rejected
    assert all(0 <= r.score <= 1 and abs(r.score + r.distance - 1) < 1e-9 for r in got)


def test_languages_learn_from_their_share_alone(spark):
    """Held-out rows teach nothing: their labels and texts may be anything."""
    rows = [r for r in speech() if r[0] is not None]
    changed = [r if zlib.crc32(str(r[0]).encode()) % 3 != 1 else (r[0], r[1], "klingon", *r[3:]) for r in rows]
    order = lambda r: (r.doc_id, r.n)
    one, two = (sorted(identified(spark, x).collect(), key=order) for x in (rows, changed))
    assert [(r.doc_id, r.lang_pred, r.rejected) for r in one] == [(r.doc_id, r.lang_pred, r.rejected) for r in two]
    assert all(abs(x.score - y.score) < 1e-5 for x, y in zip(one, two))  # sums of single-precision numbers


def test_languages_of_nothing(spark):
    assert identified(spark, []).collect() == []
    got = identified(spark, [(i, "text", None, 1, "x", 2, "y") for i in range(3)]).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * 3


def test_grams_of_long_texts(monkeypatch):
    """Steps, and texts handled together, don't change the counts."""
    import pyarrow as pa

    from tallyframe.llm import languages

    texts = pa.array(["Das ist 1 Text, ÄÖ", None, "", "a", "xyz " * 50, "日本語"])
    whole = languages.count_grams(texts)
    assert whole.sum(axis=1).tolist() == [len(re.sub(r"[^a-zA-Z\x80-\xff]", "", (t or "").encode().decode("latin1"))) for t in texts.to_pylist()]
    monkeypatch.setattr(languages, "STEP", 7)
    assert (languages.count_grams(texts) == whole).all()
    assert (np.concatenate([languages.count_grams(texts.slice(i, 1)) for i in range(6)]) == whole).all()
    centres = languages.clusters(np.eye(6, dtype=np.float32)[[0, 0, 1, 2, 2, 5]], 3)
    assert len(centres) == 3 and np.allclose((centres ** 2).sum(axis=1), 1)


def test_scores_are_exact():
    from tallyframe.llm.negatives import scores_of

    a, b = np.array([[2**30, 3], [-(2**30), 1]], np.int64), np.array([[2**30, -7], [5, 2**30]], np.int64)
    want = [[int(sum(Fraction(int(x)) * int(y) for x, y in zip(r, c))) for c in b] for r in a]
    assert scores_of(a.astype(np.int32), b.astype(np.int32)).tolist() == want
