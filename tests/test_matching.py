"""Similarity functions, links and clusters against brute force."""

import itertools
import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyframe.functions import matching as M
from tallyframe.operators import matching as mt
from tallyframe.operators.matching import MatchRule


def jaro_winkler(a, b):
    """Textbook form, written with match tables."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    owner = {}
    for i in range(len(a)):
        for j in range(len(b)):
            if abs(i - j) <= reach and a[i] == b[j] and j not in owner.values():
                owner[i] = j
                break
    m = len(owner)
    if not m:
        return 0.0
    left = [a[i] for i in sorted(owner)]
    right = [b[j] for j in sorted(owner.values())]
    half = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - half) / m) / 3
    p = len(list(itertools.takewhile(lambda xy: xy[0] == xy[1], zip(a[:4], b[:4], strict=False))))
    return jaro + p * 0.1 * (1 - jaro)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def words(n, seed, alphabet="abcd", lo=0, hi=9):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(lo, hi))) for _ in range(n)]


def test_jaro_winkler_and_levenshtein(spark):
    pairs = list(zip(words(600, 1), words(600, 2), strict=True)) + [("martha", "marhta"), ("dixon", "dicksonx"), ("abxyzqq", "abrstuv"), ("kitten", "sitting"), ("", "a"), ("", "")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for x in df.select("a", "b", M.jaro_winkler(F.col("a"), F.col("b")).alias("jw"), M.levenshtein_ratio(F.col("a"), F.col("b")).alias("lr")).collect():
        assert x.jw == pytest.approx(jaro_winkler(x.a, x.b))
        want = 1.0 if x.a == x.b else 0.0 if not x.a or not x.b else 1 - distance(x.a, x.b) / max(len(x.a), len(x.b))
        assert x.lr == pytest.approx(want)


def test_soundex_and_normalize(spark):
    df = spark.createDataFrame([("Tymczak",), ("Robert",), ("Rupert",), ("Ashcraft",), ("a",), ("",)], "s string")
    got = {x.s: x.c for x in df.select("s", M.soundex(F.col("s")).alias("c")).collect()}
    assert got == {"Tymczak": "T520", "Robert": "R163", "Rupert": "R163", "Ashcraft": "A261", "a": "A000", "": ""}
    df = spark.createDataFrame([(" Acme Inc",), ("acme",), ("Acme Corp Ltd",), ("Acme Ltd Corp",), ("Inc",)], "s string")
    got = {x.s: x.c for x in df.select("s", M.normalize(F.col("s")).alias("c")).collect()}
    assert got == {" Acme Inc": "acme", "acme": "acme", "Acme Corp Ltd": "acme", "Acme Ltd Corp": "acme ltd", "Inc": "inc"}


@pytest.mark.parametrize("ratio,longest", [(0.75, 9), (0.8, 11), (0.9, 13)])
def test_similar_values_finds_every_pair(spark, ratio, longest):
    vals = sorted(set(words(250, 3, "ab", 3, longest + 1)) | {"ababababababa"[:longest], "ababababababa"[:longest - 1]})
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    want = {(a, b) for a, b in itertools.combinations(vals, 2) if 1 - distance(a, b) / max(len(a), len(b)) >= ratio}
    assert {(x.v, x.w) for x in mt.similar_values(df, "s", ratio).collect()} == want and want


def test_similar_values_of_numbered_names(spark, monkeypatch):
    """Pairs that differ in one or two places come out of their join once: no rows of equal pairs are put together."""
    joined = []
    real = mt.spread_join

    def spy(*args, **kwargs):
        joined.append(real(*args, **kwargs))
        return joined[-1]

    monkeypatch.setattr(mt, "spread_join", spy)
    vals = [f"Supplier#{i:09d}" for i in range(0, 600)]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    for ratio, most in ((0.88, 2), (0.94, 1)):
        joined.clear()
        want = {(a, b) for a, b in itertools.combinations(vals, 2) if distance(a[-3:], b[-3:]) <= most}
        got = [(x.v, x.w) for x in mt.similar_values(df, "s", ratio).collect()]
        assert set(got) == want and len(got) == len(want)
        assert sum(j.count() for j in joined) <= 1.1 * len(want)


def test_links_between_standing_records_are_found_once(spark, monkeypatch):
    """Records of different names look for their partners one way, so a link comes up once per set of equal rules."""
    made = []
    real = mt.union_all
    monkeypatch.setattr(mt, "union_all", lambda frames: made.append(real(frames)) or made[-1])
    df = spark.createDataFrame([(i, f"Customer#{i:09d}", f"P{i % 37}") for i in range(300)], "id long, name string, phone string")
    rules = [MatchRule("name", "name", "fuzzy_levenshtein", 2.0, 0.94), MatchRule("phone", "phone", "exact", 1.0, 1.0)]
    got = {(x.a, x.b) for x in mt.candidate_links(df, "id", rules).collect()}
    want = {(a, b) for a, b in itertools.combinations(range(300), 2) if distance(f"{a:03d}", f"{b:03d}") <= 1} | {(i % 37, i) for i in range(37, 300)}
    assert got == want and made[-1].count() <= 1.1 * len(want)


def test_similar_values_of_any_length(spark):
    """Values of up to 60 characters, with as many edits as the ratio allows, and a very long one."""
    rnd = random.Random(12)
    vals = {"x" * 400, "Acme Trading", "Acme Tradinq", "y" * 31}
    for n in (6, 11, 12, 16, 24, 31, 60):
        for _ in range(6):
            base = "".join(rnd.choice("abcdefgh") for _ in range(n))
            vals.add(base)
            for _ in range(6):
                w = list(base)
                for _ in range(rnd.randint(1, max(1, n // 4))):
                    at = rnd.randrange(len(w) + 1)
                    kind = rnd.random()
                    if kind < 0.4 and at < len(w):
                        w[at] = rnd.choice("abcdefgh")
                    elif kind < 0.7:
                        w.insert(at, rnd.choice("abcdefgh"))
                    elif at < len(w) and len(w) > 2:
                        del w[at]
                vals.add("".join(w))
    vals = sorted(vals)
    df = spark.createDataFrame([(v,) for v in [*vals, None, ""]], "s string")
    for ratio in (0.7, 0.8, 0.93, 1.0):
        want = {(a, b) for a, b in itertools.combinations(vals, 2) if 1 - distance(a, b) / max(len(a), len(b)) >= ratio}
        assert {(x.v, x.w) for x in mt.similar_values(df, "s", ratio).collect()} == want
    with pytest.raises(ValueError):
        mt.similar_values(df, "s", 0.5)


def components(nodes, edges):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), min_size=1, max_size=60))
def test_connected_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    got = {x.node: x.component for x in mt.connected_components(df, "a", "b").collect()}
    assert got == components({n for e in edges for n in e}, edges)


def test_components_of_star_and_chain(spark):
    edges = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(1000, 1100)]
    got = {x.node: x.component for x in mt.connected_components(spark.createDataFrame(edges, "a long, b long"), "b", "a").collect()}
    assert got == components({n for e in edges for n in e}, edges)


def test_duplicate_links_connect_what_all_pairs_connect(spark):
    """Each rule's threshold is at least the review threshold, so a pair matches when any rule does."""
    rnd = random.Random(5)
    names = words(40, 6, "abc", 4, 8)
    recs = [(i, rnd.choice(names) if i % 3 else "unknown", rnd.choice(["", "p1", "p2", f"q{i}"])) for i in range(120)]
    rules = [MatchRule("name", "name", "fuzzy_levenshtein", 2.0, 0.8), MatchRule("phone", "phone", "exact", 1.0, 1.0)]
    df = spark.createDataFrame(recs, "id long, name string, phone string")
    links = mt.detect_duplicates(df, "id", rules).collect()
    brute = []
    for a, b in itertools.combinations(recs, 2):
        s, w = 0.0, 0.0
        lr = 1 - distance(a[1], b[1]) / max(len(a[1]), len(b[1])) if a[1] != b[1] else 1.0
        if lr >= 0.8:
            s, w = s + 2 * lr, w + 2
        if a[2] and a[2] == b[2]:
            s, w = s + 1, w + 1
        if w and s / w * 100 >= 80:
            brute.append((a[0], b[0], s / w * 100))
    scores = {(a, b): x for a, b, x in brute}
    for x in links:
        key = (min(x.a, x.b), max(x.a, x.b))
        assert x.score == pytest.approx(scores[key])
    ids = [i for i, _, _ in recs]
    assert components(ids, [(x.a, x.b) for x in links]) == components(ids, [(a, b) for a, b, _ in brute])
    assert len(links) < len(brute)


def brute_links(recs, rules, review=80):
    out = []
    for a, b in itertools.combinations(recs, 2):
        won = weight = 0.0
        for i, r in enumerate(rules, 1):
            x, y = a[i], b[i]
            if not x or not y:
                continue
            s = float(x == y) if r.kind == "exact" else 1.0 if x == y else 1 - distance(x, y) / max(len(x), len(y))
            if s >= r.threshold:
                won, weight = won + s * r.weight, weight + r.weight
        if weight and won / weight * 100 >= review:
            out.append((a[0], b[0]))
    return out


@pytest.mark.parametrize("name_threshold", [0.0, 0.8])
def test_links_with_thresholds_of_zero(spark, name_threshold):
    """Pairs that are good as a whole although no pair with the smallest record is."""
    rnd = random.Random(21)
    recs = [(1, "e1", "c1", "p1", "smithers"), (2, "e2", "c2", "p2", "johnsons"), (3, "e1", "c2", "p3", "watson-a"), (4, "e1", "c2", "p4", "williams")]
    names = [w + w[::-1] for w in words(12, 8, "abcdefgh", 5, 6)]
    recs += [(i, rnd.choice(["", "e3", "e4", f"e{i}"]), rnd.choice([None, "c3", "c4"]), rnd.choice(["", "p5", f"p{i}"]), rnd.choice([None, "", *names])) for i in range(10, 110)]
    df = spark.createDataFrame(recs, "id long, email string, city string, phone string, name string")
    exact = [MatchRule("email", "email", "exact", 3.0), MatchRule("city", "city", "exact", 1.0), MatchRule("phone", "phone", "exact", 1.0)]
    ids = [r[0] for r in recs]
    got = mt.detect_duplicates(df, "id", exact).collect()
    brute = brute_links([r[:4] for r in recs], exact)
    assert components(ids, [(x.a, x.b) for x in got]) == components(ids, brute) and (3, 4) in brute
    mixed = [*exact, MatchRule("name", "name", "fuzzy_levenshtein", 2.0, name_threshold)]
    got = {(min(x.a, x.b), max(x.a, x.b)) for x in mt.detect_duplicates(df, "id", mixed).collect()}
    brute = brute_links(recs, mixed)
    assert got <= set(brute)
    if name_threshold:
        assert components(ids, got) == components(ids, brute)


def names(n, seed, long=False):
    """Names as people have them: a few first names and many last ones, with slips."""
    rnd = random.Random(seed)
    first = ["Anna", "Maria", "Johann", "Peter", "Katharina", "Li", "Bo", "Ngozi", "Élodie", "Jan-Willem"]
    parts = ["ber", "ger", "son", "ova", "man", "stein", "ski", "er", "ó", "mc", "li", "hart", "ing", "wood", "x"]
    last = ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4))) for _ in range(n // 6 + 1)]
    out = []
    for _ in range(n):
        x = list(f"{rnd.choice(first)} {rnd.choice(last)}" if rnd.random() < 0.8 else rnd.choice(last))
        for _ in range(rnd.choice([0, 0, 1, 2])):
            x = x or ["a"]
            i = rnd.randrange(len(x))
            what = rnd.randrange(3)
            x[i: i + 1] = {0: [], 1: [rnd.choice("abexyz")], 2: [x[i], rnd.choice("ntr")]}[what]
        out.append("".join(x) or "a")
    return out


@pytest.mark.parametrize("ratio", [0.7, 0.85, 0.92])
def test_jaro_winkler_index_is_complete(spark, ratio):
    """All pairs of 3,000 names, and short random words in which characters repeat."""
    score = M._jaro_winkler_udf().func
    for values in (sorted({x.lower() for x in names({0.7: 400, 0.85: 3000, 0.92: 1000}[ratio], 4)}), sorted(set(words(250, 8, "abc", 1, 8)))):
        got = {(r.v, r.w) for r in mt.jaro_winkler_pairs(spark.createDataFrame([(x,) for x in [*values, values[0], "", None]], "x string"), "x", ratio).collect()}
        a, b = zip(*itertools.combinations(values, 2))
        hit = score(pd.Series(a), pd.Series(b)) >= ratio
        want = {(x, y) for x, y, h in zip(a, b, hit) if h}
        assert got == want and want


def good_pairs(rows, rules, review):
    """Scores by the definition, over all pairs; similarities of distinct values are computed once."""
    from functools import lru_cache

    @lru_cache(None)
    def similar(kind, x, y):
        if kind == "exact":
            return float(x.strip().lower() == y.strip().lower())
        x, y = x.lower(), y.lower()
        return jaro_winkler(x, y) if kind == "fuzzy_jaro_winkler" else 1.0 if x == y else 1 - distance(x, y) / max(len(x), len(y))

    for a, b in itertools.combinations(rows, 2):
        won = weight = 0.0
        for r in rules:
            x, y = a[r.field], b[r.field]
            if x and y:
                s = similar(r.kind, x, y)
                if s >= r.threshold:
                    won, weight = won + s * r.weight, weight + r.weight
        if weight and won / weight * 100 >= review:
            yield a["id"], b["id"]


def components(ids, pairs):
    parent = {i: i for i in ids}

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in pairs:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i in ids}


RULE_SETS = {
    "one": [MatchRule("name", "name", "fuzzy_jaro_winkler", 1.0, 0.92)],
    "two distances": [MatchRule("name", "name", "fuzzy_levenshtein", 2.0), MatchRule("street", "street", "fuzzy_levenshtein", 1.0)],
    "with an equal field": [MatchRule("name", "name", "fuzzy_jaro_winkler", 2.0, 0.85), MatchRule("street", "street", "fuzzy_levenshtein", 1.0, 0.6),
                            MatchRule("town", "town", "exact", 0.5)],
}


@pytest.mark.parametrize("which", RULE_SETS)
def test_links_under_several_distances(spark, which):
    """The links connect what the good pairs among all pairs connect, and all links kept are good."""
    rules, rnd = RULE_SETS[which], random.Random(len(which))
    streets, people = names(30, 5), names(80, 6)
    rows = [{"id": i, "name": rnd.choice([rnd.choice(people), rnd.choice(names(5, i)), None]), "street": rnd.choice([rnd.choice(streets), None]) if i % 5 else "",
             "town": rnd.choice(["a", "b", "B ", None])} for i in range(140)]
    frame = spark.createDataFrame([(x["id"], x["name"], x["street"], x["town"]) for x in rows], "id long, name string, street string, town string")
    review = 85.0
    want = set(good_pairs(rows, rules, review))
    links = {(r.a, r.b) for r in mt.detect_duplicates(frame, "id", rules, review=review).collect()}
    assert links <= want and len(want) > 10
    assert components(range(140), links) == components(range(140), want)


def test_least_similarity():
    one, two = MatchRule("a", "a", "fuzzy_levenshtein", 2.0), MatchRule("b", "b", "fuzzy_levenshtein", 1.0)
    assert mt.least_similarity([one], 0, 80) == pytest.approx(0.8)
    assert mt.least_similarity([one, two], 0, 80) == pytest.approx(0.7)  # b equal: (2 s + 1) / 3 >= 0.8
    assert mt.least_similarity([one, two], 1, 80) == pytest.approx(0.4)  # a equal: (2 + s) / 3 >= 0.8
    assert mt.least_similarity([MatchRule("a", "a", "fuzzy_levenshtein", 2.0, 0.9), two], 0, 80) == 0.9
