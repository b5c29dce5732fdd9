"""Operators on documents against brute force, on rows made to be awkward."""

import hashlib
import random
import re
import zlib
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, n_lines string, n_words int, piece int, kept string"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def corpus():
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, line = prose(60), "The same line in many documents, é!"
    texts = [prose(r.randint(0, 300)) for _ in range(40)]
    texts += [prose(40) + "\n" + line + "\n" + prose(30) for _ in range(20)]
    texts += [prose(25) + " " + passage + "  " + prose(25) for _ in range(20)]
    near = prose(200).split()
    for i in range(25):
        copy = list(near)
        for _ in range(r.randint(0, 6)):
            copy[r.randrange(len(copy))] = "x" + str(i)
        texts.append(" ".join(copy))
    texts += [texts[3]] * 5 + [None, "", " ", "\n\n", "a", "\n" + line.upper() + " \t", "one two", "ONE two", "x" * 49, "x" * 50, "x" * 400, "z" * 60 + "\0" * 60]
    texts += ["ab " * 3000, ("\n".join([line] * 4)), "日本語のテキスト" * 30, "日本語のテキスト" * 30 + "。", passage, passage + "\n" + passage]
    texts.append(" ".join(prose(5) for _ in range(4000)))
    ids = list(range(100, 100 + len(texts)))
    r.shuffle(ids)
    return [(i, t, r.choice(["en", "de", None]), "x", 3, 4, "y") for i, t in zip(ids, texts)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def as_dict(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.fixture
def small_pieces(monkeypatch):
    """Pieces of a few documents, so that small tables have many."""
    from tallyframe.llm import exchange

    real = exchange.write_pieces
    for name in ("lines", "substrings", "suffixes"):
        module = __import__(f"tallyframe.llm.{name}", fromlist=["ex"])
        monkeypatch.setattr(module.ex, "write_pieces", lambda d, text="text", limit=4000: real(d, text, 4000))


def lines_brute(rows):
    key = lambda x: x.strip(BLANK).translate(LOWER)
    holders = {}
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                holders.setdefault(key(x), set()).add(i)
    out = {}
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_lines(docs, empty, small_pieces):
    from tallyframe.llm.lines import dedup_lines, drop_repeated_lines, line_digests

    want = lines_brute(ROWS)
    assert as_dict(line_digests(docs)) == {i: (n, d, sha(t)) for i, (n, d, t) in want.items()}
    full = dedup_lines(docs)
    assert full.columns == ["doc_id", "text", "lang", "n_lines", "n_words", "piece", "kept", "n_dropped"]
    stage = drop_repeated_lines(docs)
    assert stage.columns == docs.columns and {r.doc_id: (r.text, r.n_lines) for r in stage.collect()} == {i: (t, "x") for i, (_, _, t) in want.items()}
    assert line_digests(empty).collect() == []


def test_lines_with_shared_and_missing_ids(spark, small_pieces):
    from tallyframe.llm.lines import line_digests

    rows = [(1, "a repeated line\nb"), (1, "a repeated line"), (2, "A Repeated Line "), (None, "a repeated line"), (None, "only here, twice")] + [(3, "only here, twice")] * 2
    got = sorted(map(str, line_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    kept = [(1, 2, 0, "a repeated line\nb"), (1, 1, 0, "a repeated line"), (2, 1, 1, ""), (None, 1, 1, ""), (None, 1, 1, "")] + [(3, 1, 0, "only here, twice")] * 2
    from pyspark.sql import Row
    assert got == sorted(str(Row(doc_id=a, n_lines=b, n_dropped=c, kept_sha256=sha(d))) for a, b, c, d in kept)


def windows_brute(rows, size=20):
    first = {}
    for i, t, *_ in rows:
        w = words_of(t)
        for s in range(len(w) - size + 1):
            k = tuple(w[s: s + size])
            first[k] = min(first.get(k, (i, s)), (i, s))
    out = {}
    for i, t, *_ in rows:
        w = words_of(t)
        gone = set()
        for s in range(len(w) - size + 1):
            if first[tuple(w[s: s + size])] != (i, s):
                gone.update(range(s, s + size))
        out[i] = (len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def test_word_windows(docs, empty, small_pieces):
    from tallyframe.llm.substrings import remove_repeated_windows, window_digests

    assert as_dict(window_digests(docs)) == windows_brute(ROWS)
    assert remove_repeated_windows(docs).columns == [*docs.columns, "n_removed"]
    assert window_digests(empty).collect() == []


def strings_brute(rows, size=50):
    first = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for s in range(len(b) - size + 1):
            k = b[s: s + size]
            first[k] = min(first.get(k, i), i)
    out = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - size + 1):
            if first[b[s: s + size]] < i:
                gone[s: s + size] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-1][:-1]])).sum()) if len(b) else 0
        out[i] = (len(b), int(gone.sum()), spans, sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out


@pytest.mark.parametrize("hot", [2, 1000])
def test_byte_strings(docs, empty, small_pieces, monkeypatch, hot):
    """A low bound sends common grams by single strings."""
    from tallyframe.llm import suffixes

    monkeypatch.setattr(suffixes, "_seen_twice", partial(suffixes._seen_twice, hot=hot))
    assert as_dict(suffixes.string_digests(docs)) == strings_brute(ROWS)
    assert suffixes.string_digests(empty).collect() == []


def test_anchors_fill_all_shards_alike(spark, monkeypatch):
    """Anchors have the least hashes of their strings; the cells they are laid out in are even."""
    from tallyframe.llm import exchange as ex
    from tallyframe.llm import suffixes

    sent = {}
    monkeypatch.setattr(ex, "write_pieces", lambda docs, text: docs)
    monkeypatch.setattr(ex, "output_schema", lambda *a: None)
    monkeypatch.setattr(ex, "suspects", lambda pieces, layout, items, merge: sent.update(items=items))

    class Docs:
        agg = lambda self, *a: self
        first = lambda self: [1 << 20]

    class Stop(Exception):
        pass

    def stop(*a):
        raise Stop

    monkeypatch.setattr(ex, "with_answers", stop)
    with pytest.raises(Stop):
        suffixes.remove_repeated_strings(Docs())
    r = random.Random(13)
    table = suffixes.pa.table({"text": ["".join(r.choice("abcdefgh ") for _ in range(200_000))]})
    shard = np.bincount((sent["items"](table) >> np.uint64(59)).astype(np.int64), minlength=32)
    assert shard.max() < 2 * shard.mean()


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def test_merge_never_rereads_prefixes():
    from tallyframe.llm.suffixes import merge_runs

    r = random.Random(5)
    for _ in range(200):
        runs = [sorted({bytes(r.choice(b"ab") for _ in range(r.randint(0, 7))) + b"\x01" for _ in range(r.randint(0, 12))}) for _ in range(r.randint(1, 9))]
        out = list(merge_runs(runs, [bytes([0, *(common(a, b) for a, b in zip(x, x[1:]))]) for x in runs]))
        assert [k for _, k, _, _ in out] == sorted(k for x in runs for k in x)
        for (shared, key, _, _), (_, before, _, _) in zip(out[1:], out):
            assert shared == common(key, before)


def near_brute(rows, size, percent):
    sets = {}
    for i, t, *_ in rows:
        w = words_of((t or "").translate(LOWER))
        sets[i] = {tuple(w[s: s + size]) for s in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(docs, empty, size):
    from tallyframe.llm.neardup import keep_one, near_duplicates

    want = near_brute(ROWS, size, 80)
    assert as_dict(near_duplicates(docs, size, 80)) == want
    kept = keep_one(docs, size, 80)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, x in want.items() if x[2])
    assert near_duplicates(empty, size, 80).collect() == []


def test_near_duplicates_with_shared_and_missing_ids(spark):
    from tallyframe.llm.neardup import near_duplicates

    a, b = "one two three four five six seven eight", "red green blue black white grey brown pink"
    rows = [(None, a), (None, a), (None, b), (7, a), (5, b), (5, "x " + b), (5, b), (9, None), (None, "")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()), key=str)
    assert got == sorted([(None, 5, 7, False), (None, 5, 7, False), (None, 5, 5, False), (7, 5, 7, True), (5, 5, 5, True), (5, 6, 5, True), (5, 5, 5, True), (9, 0, 9, True), (None, 0, None, True)], key=str)


def test_signature_estimates(spark):
    """The corrected estimate is right on average, and equal sets have one."""
    from tallyframe.llm import neardup

    r = random.Random(2)
    rows = []
    for i in range(40):
        w = [f"w{r.randrange(10**9)}" for _ in range(300)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:270] + [f"v{r.randrange(10**9)}" for _ in range(30)]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit(0).cast("long")).mapInArrow(lambda it: neardup._sketch(it, 4), neardup.SKETCH)
    one = df.where("doc_id % 2 = 0").select("doc_id", F.col("signature").alias("a"))
    two = df.where("doc_id % 2 = 1").select((F.col("doc_id") - 1).alias("doc_id"), F.col("signature").alias("b"))
    got = [x[0] for x in one.join(two, "doc_id").select(neardup.estimate("a", "b")).collect()]
    true = 267 / (2 * 297 - 267)
    assert abs(sum(got) / len(got) - true) < 0.03
    assert {x[0] for x in one.select(neardup.estimate("a", "a")).collect()} == {1.0}


def quality_brute(text):
    w = words_of(text)
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    seen, places = {}, set()
    for s in range(len(w) - 7):
        seen.setdefault(tuple(w[s: s + 8]), []).append(s)
    for at in seen.values():
        if len(at) > 1:
            places.update(j for s in at for j in range(s, s + 8))
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(places), n < 20 or 100 * len(places) > 30 * n)


def test_quality_rules(docs, empty):
    from tallyframe.llm.perplexity import keep_good, quality

    got = quality(docs).collect()
    for r in got:
        text = next(t for i, t, *_ in ROWS if i == r.doc_id)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == quality_brute(text)
        assert not (r.kept and r.base_failed)
    kept = keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.select("doc_id", "n_words").collect()) == sorted((r.doc_id, 3) for r in got if r.kept)
    assert quality(empty).collect() == [] and keep_good(empty).collect() == []


def kn_brute(texts):
    """Modified Kneser-Ney of order four by dictionaries."""
    from collections import Counter

    from tallyframe.llm.perplexity import SYMBOLS

    sequences = [tuple(SYMBOLS[np.frombuffer((t or "").encode(), np.uint8)].tolist()) for t in texts]
    counts = {4: Counter(s[i: i + 4] for s in sequences for i in range(len(s) - 3))}
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discount = {}
    for k, c in counts.items():
        n = [sum(v == j for v in c.values()) for j in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
        discount[k] = [0] + [min(j, max(0, j - (j + 1) * y * n[j + 1] / n[j])) if n[j] else 0.5 for j in (1, 2, 3)]

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / 32
        follow = {g: v for g, v in counts[k].items() if g[:-1] == gram[:-1]}
        total = sum(follow.values())
        if not total:
            return p(gram[1:])
        off = lambda v: discount[k][min(v, 3)]
        own = counts[k].get(gram, 0)
        return (own - off(own) if own else 0) / total + sum(map(off, follow.values())) / total * p(gram[1:])

    return [np.mean([-np.log(p(s[i: i + 4])) for i in range(len(s) - 3)]) if len(s) > 3 else None for s in sequences]


def test_perplexity(spark):
    from tallyframe.llm.perplexity import quality

    texts = ["the cat sat on the mat", "a cat, a hat; 12 bats!", "Zé $#\nthe end", "the", None, "aaaaaaaaaaaa"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.log_perplexity for r in quality(df, lang=None).collect()}
    for i, want in enumerate(kn_brute(texts)):
        assert (got[i] is None and want is None) or got[i] == pytest.approx(want, rel=1e-5)


def test_bands_reject_noise(spark):
    from tallyframe.llm.perplexity import quality

    r = random.Random(4)
    say = lambda: " ".join(r.choice(["stone", "river", "garden", "window", "letter", "summer"]) + r.choice(["", "s"]) for _ in range(80))
    rows = [(i, say(), "en") for i in range(300)] + [(1000 + i, "".join(r.choice("#1x;Q{z~0@w/7k^") + r.choice(["", " "]) for _ in range(800)), "en") for i in range(3)]
    kept = {x.doc_id for x in quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("kept").collect()}
    assert kept == set(range(300))


def test_bands_reject_swapped_letters(spark):
    """Letters beyond ASCII and case count: a text whose letters are exchanged for others of equal byte length goes."""
    from tallyframe.llm.perplexity import quality

    r = random.Random(5)
    for alphabet in ("абвгдежзийклмнопрстуфхцчшщыьэюя", "的一是不了人我在有他这中大来上国个到说们为子和你地出道也时年"):
        vocabulary = ["".join(r.choice(alphabet) for _ in range(r.randint(2, 7))) for _ in range(60)]
        say = lambda: " ".join(r.choice(vocabulary) for _ in range(120))
        noise = lambda: "".join(x if x == " " else r.choice(alphabet) for x in say())
        rows = [(i, say(), "xx") for i in range(300)] + [(1000 + i, noise(), "xx") for i in range(5)]
        kept = {x.doc_id for x in quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("kept").collect()}
        assert kept == set(range(300))


def points_brute(texts):
    """log_perplexity_points by dictionaries: modified Kneser-Ney of the other half's code points."""
    from collections import Counter

    half = [zlib.crc32((t or "").encode()) & 1 for t in texts]

    def model(h):
        counts = {4: Counter(t[i: i + 4] for t, x in zip(texts, half) if t and x == h for i in range(len(t) - 3))}
        for k in (3, 2, 1):
            counts[k] = Counter(g[1:] for g in counts[k + 1])
        off = {}
        for k, c in counts.items():
            n = [sum(v == j for v in c.values()) for j in range(5)]
            y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
            off[k] = [0] + [min(j, max(0.1, j - (j + 1) * y * n[j + 1] / n[j])) if n[j] else 0.5 for j in (1, 2, 3)]

        def p(gram):
            k = len(gram)
            if k == 0:
                return 2.0 ** -21
            follow = [v for g, v in counts[k].items() if g[:-1] == gram[:-1]]
            own = counts[k].get(gram, 0)
            return (own - off[k][min(own, 3)] + sum(off[k][min(v, 3)] for v in follow) * p(gram[1:])) / sum(follow) if follow else p(gram[1:])

        return p

    models = [model(0), model(1)]
    return [np.mean([-np.log(models[1 - h](t[i: i + 4])) for i in range(len(t) - 3)]) if t and len(t) > 3 else None for t, h in zip(texts, half)]


def test_perplexity_of_code_points(spark):
    from tallyframe.llm.perplexity import quality

    texts = ["the cat sat on the mat", "a cat, a hat; 12 bats!", "Zé $#\nthe end", "the", None, "", "aaaaaaaaaaaa", "日本語のテキスト日本語", "日本語のテキスト", "😀😀😀é😀😀", "The Cat sat", "日本"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.log_perplexity_points for r in quality(df, lang=None).collect()}
    for i, want in enumerate(points_brute(texts)):
        assert (got[i] is None and want is None) or got[i] == pytest.approx(want, rel=1e-5)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def private_brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            v, d = m.group(), re.sub("[^0-9]", "", m.group())
            total = sum((2 * int(c) - 9 * (2 * int(c) > 9)) if k % 2 else int(c) for k, c in enumerate(reversed(d)))
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in v.split(".")) or kind == "card" and 16 <= len(d) <= 19 and total % 10 == 0 \
                    or kind == "phone" and 8 <= len(d) <= 15:
                out.append((kind, m.start(), m.end()))
    return out


def test_private_data(spark, docs, empty):
    from tallyframe.llm.pii import BASE as KINDS
    from tallyframe.llm.pii import private_digests

    r = random.Random(9)
    parts = ["a@b.cc", "x.y+z@mail-1.example.com", "..@a.b", "a@b.c.d-e_f@g.h", "@", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "0001.02.3.255", "4111 1111 1111 1111",
             "4111-1111-1111-1111 5", "4111111111111111", "79927398713", "+1 (017) 555-7713", "+12", "++49 30 1234567)", " ", "é", "日本", "\n", "-", ".", "7", "1 2  3",
             'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "call (017) 555-7713 now"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 14)))) for i in range(1500)] + [(2000, None), (2001, ""), (2002, "1 " * 40000 + "a" * 90000 + "@" + "b." * 40000),
            (2003, "1." * 50000), (2004, "a" * 200000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x for x in private_digests(df).collect()}
    for i, t in rows:
        want = private_brute(t) if i != 2003 else [("ip", 8 * j, 8 * j + 7) for j in range(12500)]
        assert got[i].base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, a, b in want)), (t[:200], want[:5], got[i].spans[:200])
        assert [got[i][f"n_{k}"] for k in KINDS] == [sum(x[0] == k for x in want) for k in KINDS]
        assert got[i].spans.startswith(",".join(f"{k}:{a}:{b}" for k, a, b in want))
    found = {i: got[i].spans for i, t in rows if t and "token" in t}
    assert found and all("secret:" in s for s in found.values())
    assert private_digests(empty).collect() == []


def test_keys_of_any_length(spark):
    """Keys and numbers have no upper length; base64 and web tokens are found as a whole."""
    from tallyframe.llm.pii import private_digests

    r = random.Random(10)
    url, plain = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    of = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    # No run of digits is long enough for a card.
    hexa = lambda n: "".join(of("0123456789abcdef", 9) + "e" for _ in range(n))[:n]
    make = {"secret": lambda: hexa(r.choice([40, 128, 129, 256, 300])), "number": lambda: of("123456789", r.choice([12, 33, 60])),
            "encoded": lambda: r.choice([of(plain, 43) + "=", "A/b1" + of(plain, 82) + "==", "eyJ" + of(url, 33) + "." + of(url, 200) + "." + of(url, 43)])}
    rows, want = [], {}
    for i in range(400):
        kind = r.choice(["secret", "secret", "number", "encoded", "encoded"])
        key = make[kind]()
        rows.append((i, f'please keep the token = "{key}" in mind, and read state-of-the-art/words-joined/by-signs here'))
        want[i] = f"{kind}:25:{25 + len(key)}"
    got = {x.doc_id: x.spans.split(",") for x in private_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # A long number is a key of digits as well.
    assert {i: [s for s in x if s.split(":")[0] in make][-1:] for i, x in got.items()} == {i: [w] for i, w in want.items()}
    assert all(len(x) == 1 or want[i].startswith("number") for i, x in got.items())


def test_benchmark_passages(spark, empty):
    from tallyframe.llm.decontaminate import benchmark_matches, drop_contaminated

    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(r.randint(15, 50)))) for i in range(30)] + [(90, None), (91, ""), (92, "few words"), (93, "the " * 40)]
    rows, want = [], set()
    for d in range(200):
        text = [word() for _ in range(r.randint(0, 300))]
        if d % 4 == 0:
            i, passage = items[d % 30]
            p = passage.split()
            if d % 8 == 0:
                for j in range(6, len(p), 12):
                    p[j] = "changed"
            at = r.randint(0, len(text))
            text[at:at] = [x.upper() if d % 3 == 0 else x for x in p]
            want.add((d, i))
        rows.append((d, " ".join(text), "x"))
    rows += [(500, None, "x"), (501, "", "x"), (502, items[1][1], "x"), (502, items[1][1], "x")]
    want.add((502, 1))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")
    for words in (400_000, 100):
        got = benchmark_matches(docs, bench, block_words=words).collect()
        assert {(x.doc_id, x.item_id) for x in got} == want
        clean = drop_contaminated(docs, bench, block_words=words)
        assert clean.columns == docs.columns and sorted(x.doc_id for x in clean.collect()) == sorted(x[0] for x in rows if x[0] not in {d for d, _ in want})
    assert benchmark_matches(empty, bench).collect() == [] and benchmark_matches(docs, bench.limit(0)).collect() == []


def test_every_changed_word_leaves_a_seed():
    from tallyframe.llm.decontaminate import MASKS

    for length in (14, 15, 20):
        for changed in range(length):
            hit = any(m[changed - s] == "0" if 0 <= changed - s < len(m) else True for m in MASKS for s in range(length - len(m) + 1))
            assert hit


def test_every_passage_leaves_a_seed():
    """The most equal words of any stretch without a hit, by its length and last words, never suffice."""
    from tallyframe.llm.decontaminate import MASKS, MIN_SHARE, MIN_WORDS

    bits = max(map(len, MASKS))
    reads = [int(m, 2) for m in MASKS]
    most = {0: 0}  # last words, equal (1) or changed (0), before the begin none is equal
    for n in range(1, 400):
        after = {}
        for last, equal in most.items():
            for bit in (0, 1):
                now = (last << 1 | bit) & (1 << bits) - 1
                if not any(now & m == m for m in reads):
                    after[now & (1 << bits - 1) - 1] = max(after.get(now & (1 << bits - 1) - 1, 0), equal + bit)
        most = after
        best = max(most.values())
        assert best < MIN_WORDS or best <= MIN_SHARE * n, (n, best)


def test_changed_passages_are_found(spark):
    from tallyframe.llm.decontaminate import benchmark_matches

    item = [f"w{i}" for i in range(24)]
    patterns = [(12, {5}), (12, {8}), (11, {4}), (24, set(range(3, 24, 4)))]
    rows = [(d, " ".join("x" if i in gone else w for i, w in enumerate(item[:n]))) for d, (n, gone) in enumerate(patterns)]
    items = [(n, " ".join(item[:n])) for n in {n for n, _ in patterns}]
    got = benchmark_matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(d, n) for d, (n, _) in enumerate(patterns)} <= {(r.doc_id, r.item_id) for r in got}


def test_all_stretches_of_an_alignment(spark):
    """A better but shorter run hides no stretch, several of one alignment come out, short items count whole."""
    from tallyframe.llm.decontaminate import _stretches, benchmark_matches

    r = random.Random(12)
    for _ in range(300):
        same = np.array([r.random() < r.choice([0.5, 0.75, 0.9]) for _ in range(r.randint(1, 45))])
        sums = np.concatenate([[0], np.cumsum(same)])
        fits = lambda a, b: sums[b] - sums[a] >= 10 and 10 * (sums[b] - sums[a]) > 7 * (b - a)
        got = _stretches(same, 10, 0.7)
        assert all(fits(a, b) for a, b in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:]))
        free = [0, *[x for g in got for x in g], len(same)]
        assert not any(fits(a, b) for lo, hi in zip(free[::2], free[1::2]) for a in range(lo, hi) for b in range(a + 1, hi + 1))
    item = [f"w{i}" for i in range(60)]
    gone = {0: set(range(9, 30)) | {36} | set(range(42, 60)), 1: set(range(15, 40)), 2: {2, 5, 8, 11} | set(range(14, 60))}
    rows = [(d, " ".join("x" if i in out else w for i, w in enumerate(item))) for d, out in gone.items()] + [(3, "so A Short item here"), (4, "a short items")]
    items = [(1, " ".join(item)), (2, "a short item")]
    got = benchmark_matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((x.doc_id, x.item_id, x.n_matched, x.first_word, x.last_word) for x in got) == [
        (0, 1, 11, 30, 41), (1, 1, 15, 0, 14), (1, 1, 20, 40, 59), (2, 1, 10, 0, 13), (3, 2, 3, 1, 3)]


def test_packing(docs, empty):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    from tallyframe.llm.packing import pack_documents

    file = path("byte_bpe_50k.json")
    encoder = Tokenizer.from_file(file)
    for buffer in (1 << 21, 3000):
        rows = pack_documents(docs, file, buffer=buffer).collect()
        pieces, sequences = {}, {}
        for r in rows:
            pieces.setdefault(r.doc_id, []).append(r)
            sequences.setdefault(r.sequence_id, []).append(r)
        assert set(pieces) == {i for i, *_ in ROWS}
        for i, t, *_ in ROWS:
            ids = np.array([*encoder.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
            at = 0
            for r in sorted(pieces[i], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at: at + r.length].tobytes())
                at += r.length
            assert at == len(ids)
        for s in sequences.values():
            at = 0
            for r in sorted(s, key=lambda r: r.offset):
                assert r.offset == at and r.length > 0
                at += r.length
            assert at == s[0].tier <= 2048 and at & (at - 1) == 0
    assert pack_documents(empty, file).collect() == []


def test_tokens_are_those_of_the_file():
    from public_tokenizers import path

    from tallyframe.llm.tokens import tokenizer

    encoder = tokenizer(path("byte_bpe_50k.json"))
    assert encoder.quick is not None
    r = random.Random(8)
    parts = [" ", "\n", "a", "'s", "1", "é", "\t", "!", "  ", "B", "\x0b", "\x85", "\x1c", "\u00a0", "日", "<|endoftext|>", "<|", "\0", "\r\n", "\u3000", "\u180e", "²"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert encoder.encode(text).tolist() == encoder.whole.encode(text, add_special_tokens=False).ids


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, sf_dir), "test")
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before)
        rows = [(i, r.text) for i, r in before.items()]
        if name == "line_dedup":
            assert {i: r.text for i, r in after.items()} == {i: x[2] for i, x in lines_brute(rows).items()}
        if name == "minhash_near_dedup":
            assert set(after) == {i for i, x in near_brute(rows, 5, 80).items() if x[2]}
        if name == "quality_rules":
            assert not any(quality_brute(r.text)[-1] for r in after.values())
        counts.append(len(after))
    packed = corpus_pipeline.packing(spark, docs, sf_dir).collect()
    assert {r.doc_id for r in packed} == set(after) and counts[-1] > 0.5 * counts[0]
