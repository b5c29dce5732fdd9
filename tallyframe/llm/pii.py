"""Personal data in texts: patterns, and a span classifier learnt from labelers that vote."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.common import cut_lineage

# Patterns of the base kinds, written so that the Java engine reads a text once and keeps no stack
# per repetition: runs are possessive, a match starts at the begin of a run or where the last match
# ended (\G), and repeated groups are single characters with a look at what comes next. They match
# what the plain forms match:
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   ip    [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+
#   phone \+[0-9][\x20().0-9-]+[0-9]
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-](?:[A-Za-z0-9.-](?<=[A-Za-z0-9-]|\.(?=[A-Za-z0-9-])))*+",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[0-9 -](?<=[0-9]|[ -](?=[0-9])))+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Candidates for what the method adds: long keys, long numbers, numbers grouped like a telephone's, and
#: keys with signs in them (base64 with its padding, the three parts of a web token). None has an upper length.
EXTRA = {
    "secret": r"(?<![A-Za-z0-9])[A-Za-z0-9_]{20,}+",
    "number": r"(?<![0-9A-Za-z.-])[0-9]{9,}+(?![A-Za-z])",
    "tel": r"(?<![0-9(+-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "encoded": r"(?<![A-Za-z0-9_+/-])(?:eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+|(?=[A-Za-z0-9_]*+[+/=-])[A-Za-z0-9_+/-]{20,}+={0,2})",
}
KINDS = [*BASE, *EXTRA]
#: Gazetteer: words that come before personal data or secrets.
CUES = ("token", "key", "secret", "password", "passwd", "pwd", "auth", "bearer", "api", "tel", "phone", "fax", "mobile", "call", "account",
        "iban", "card", "passport", "ssn", "license", "member", "patient", "customer")
LABELERS = ("form", "gazetteer", "assignment", "prose", "repeated")
MIN_PROBABILITY = 0.5
ROUNDS = 50

_SPAN = "array<struct<kind:int,start:bigint,end:bigint,value:string,before:string,after:string>>"


def _spans(text: Column, kind: str, pattern: str) -> tuple[Column, Column]:
    """Matches of a pattern and the texts between them."""
    must = {"email": "@", "phone": "+", "ip": "."}.get(kind)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return (F.when(F.instr(text, must) > 0, found).otherwise(F.array().cast("array<string>")) if must else found), F.split(text, pattern, -1)


def _placed(number: int, found: str, between: str) -> Column:
    """Matches with their places in code points, from the lengths of matches and gaps."""
    pairs = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), F.col(found).alias("value"), F.slice(between, 2, F.size(found)).alias("next"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPAN).alias("out"))

    def add(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["0"])
        b = a + F.length(x["1"])
        return F.struct(b.alias("at"), F.concat(acc["out"], F.array(F.struct(
            F.lit(number).alias("kind"), a.alias("start"), b.alias("end"), x["1"].alias("value"),
            F.right(x["0"], F.lit(24)).alias("before"), F.substring(x["2"], 1, 8).alias("after")))).alias("out"))

    names = ("0", "1", "2")
    zipped = F.transform(pairs, lambda x: F.struct(x["gap"].alias(names[0]), x["value"].alias(names[1]), x["next"].alias(names[2])))
    return F.when(F.size(found) > 0, F.aggregate(zipped, start, add, lambda acc: acc["out"])).otherwise(F.array().cast(_SPAN))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    doubled = lambda d: F.when(2 * d > 9, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + F.when(
        (n - i) % 2 == 1, doubled(F.substr(digits, i, F.lit(1)).cast("int"))).otherwise(F.substr(digits, i, F.lit(1)).cast("int")))
    return total % 10 == 0


def _byte(part: Column) -> Column:
    """Whether a run of digits is at most 255."""
    digits = F.ltrim(part, F.lit("0"))
    return F.when(F.length(digits) > 3, False).when(F.length(digits) == 0, True).otherwise(digits.cast("int") <= 255)


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), _byte)
    if kind == "card":
        return F.when(n.between(16, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _filtered(kind: str):
    return lambda span: _valid(kind, span["value"])


def find_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without its text, with ``base`` and ``candidates``: spans by kind, then start."""
    keep = [c for c in docs.columns if c != text]
    frame = docs.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    patterns = BASE | EXTRA
    frame = frame.select(*[F.col(f"`{c}`") for c in keep], "__t", *[_spans(F.col("__t"), k, p)[0].alias(f"__m_{k}") for k, p in patterns.items()])
    frame = frame.select(*[F.col(f"`{c}`") for c in keep], *[f"__m_{k}" for k in patterns], *[
        F.when(F.size(f"__m_{k}") > 0, _spans(F.col("__t"), k, p)[1]).alias(f"__g_{k}") for k, p in patterns.items()])
    placed = {k: _placed(KINDS.index(k), f"__m_{k}", f"__g_{k}") for k in patterns}
    base = F.concat(*[F.filter(placed[k], _filtered(k)) for k in BASE])
    frame = frame.select(*[F.col(f"`{c}`") for c in keep], base.alias("base"), F.concat(*[placed[k] for k in EXTRA]).alias("__extra"))
    free = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return frame.withColumn("candidates", F.filter("__extra", free)).drop("__extra")


def _votes(s: Column, all_spans: Column) -> dict[str, Column]:
    """Vote of every labeler on a span: 1 personal, 0 not, NULL no opinion."""
    value, before, after = s["value"], F.lower(s["before"]), s["after"]
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    letters = F.length(F.regexp_replace(value, "[^A-Za-z]", ""))
    hexa = value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
    mixed = (digits >= 4) & (letters >= 4)
    word = F.regexp_extract(before, r"([a-z]+)[^a-z0-9]*$", 1)
    kind = s["kind"]
    return {
        # the form of the value itself: keys mix letters and digits at a usual length, words have no digits
        "form": F.when(kind == KINDS.index("secret"), F.when(mixed & (hexa & F.length(value).isin(32, 40, 64, 128, 256, 512) | ~hexa & (digits * 8 >= F.length(value))), 1)
                       .when(digits == 0, 0)).when(kind == KINDS.index("number"), F.when(value.rlike("^([0-9])\\1+$"), 0).when(digits.between(9, 19), 1))
        .when(kind == KINDS.index("tel"), F.when(value.rlike(r"\(|-"), 1))
        # base64 changes between cases and digits all the time, paths and joined words don't
        .when(kind == KINDS.index("encoded"), F.when(value.rlike("[a-z][A-Z]") & value.rlike("[0-9][A-Za-z]|[A-Za-z][0-9]"), 1)
              .when((digits == 0) | ~value.rlike("[A-Z]"), 0)),
        "gazetteer": F.when(word.isin(*CUES), 1).when(word != "", 0),
        "assignment": F.when(before.rlike("[=:][ ]*[\"']?$"), 1).when(before.rlike("[a-z] $"), 0),
        "prose": F.when(before.rlike(r"[a-z] $") & after.rlike("^[ .,;]"), 1).when(after.rlike("^[0-9A-Za-z_/]"), 0),
        "repeated": F.when(F.size(F.filter(all_spans, lambda o: o["value"] == value)) > 3, 0),
    }


def _features(s: Column) -> list[Column]:
    """What the final classifier reads besides the votes: kind, length, share of digits."""
    value = s["value"]
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    return [F.least(F.lit(4), F.floor(F.length(value) / 16)).cast("int").alias("size"), F.floor(4 * digits / F.length(value)).cast("int").alias("digits")]


def expectation_maximisation(patterns: list[tuple[int, tuple, int]], rounds: int = ROUNDS) -> dict[tuple, float]:
    """Probability that a span is personal, for each (kind, votes) pattern, from counts alone.

    Two hidden classes; each labeler has its own chance of voting 1 in either class. They are fitted by
    turns with the chances of the patterns. A start in favour of the majority fixes which class is which.
    """
    kinds = sorted({k for k, _, _ in patterns})
    chance = {}
    for kind, votes, _ in patterns:
        cast = [v for v in votes if v is not None]
        chance[kind, votes] = min(0.9, max(0.1, sum(cast) / len(cast))) if cast else 0.3
    for _ in range(rounds):
        prior, right = {}, {}
        for kind in kinds:
            n = sum(c for k, _, c in patterns if k == kind)
            prior[kind] = (sum(c * chance[k, v] for k, v, c in patterns if k == kind) + 1) / (n + 2)
        for j in range(len(LABELERS)):
            for truth in (0, 1):
                seen = said = 0.0
                for k, v, c in patterns:
                    if v[j] is not None:
                        weight = c * (chance[k, v] if truth else 1 - chance[k, v])
                        seen, said = seen + weight, said + weight * v[j]
                right[j, truth] = (said + (2 if truth else 1)) / (seen + 3)
        for kind, votes, _ in patterns:
            odds = math.log(prior[kind] / (1 - prior[kind]))
            for j, v in enumerate(votes):
                if v is not None:
                    p, q = right[j, 1], right[j, 0]
                    odds += math.log(p / q) if v else math.log((1 - p) / (1 - q))
            chance[kind, votes] = 1 / (1 + math.exp(-max(-30, min(30, odds))))
    return chance


def _inputs(row) -> list[float]:
    """Inputs of the classifier for a pattern: kinds, sizes and shares of digits as 0/1, votes as -1/0/1."""
    return [*[float(row["kind"] == KINDS.index(k)) for k in EXTRA], *[float(row["size"] == i) for i in range(5)], *[float(row["digits"] == i) for i in range(5)],
            *[0.0 if row[x] is None else 2.0 * row[x] - 1 for x in LABELERS]]


def _fit(rows: list, chance: dict, rounds: int = 300) -> list[float]:
    """Logistic regression on patterns with their counts, towards the chances; last weight is the constant."""
    data = [(_inputs(r), chance[r["kind"], tuple(r[x] for x in LABELERS)], r["n"]) for r in rows]
    total = sum(n for _, _, n in data) or 1
    weights = [0.0] * ((len(data[0][0]) if data else len(EXTRA) + 10 + len(LABELERS)) + 1)
    for _ in range(rounds):
        slope = [1e-3 * w for w in weights]
        for x, p, n in data:
            z = sum(a * b for a, b in zip(weights, x)) + weights[-1]
            error = (1 / (1 + math.exp(-max(-30, min(30, z)))) - p) * n / total
            for j, v in enumerate(x):
                slope[j] += error * v
            slope[-1] += error
        weights = [w - 1.0 * g for w, g in zip(weights, slope)]
    return weights


def detect_private(docs: DataFrame, text: str = "text") -> DataFrame:
    """Find personal data in every text.

    ``base``: e-mail addresses, IP addresses (parts up to 255), card numbers (16 to 19 digits that pass
    the Luhn check) and telephone numbers (8 to 15 digits) by their patterns, leftmost first, without
    overlaps inside a kind. ``added``: further spans that overlap no base span. Candidates are long keys,
    long numbers, grouped numbers and keys with signs in them, which take the place of keys and numbers
    inside them once they are found personal. Five labelers (form, gazetteer of cue words, assignment, prose
    around, repetition) vote or abstain on each; Spark counts the vote patterns of all candidates,
    expectation-maximisation on these counts estimates how reliable each labeler is and how likely each
    pattern, and a logistic regression on votes, kind, length and digits learns these chances. Its
    weights become one expression; spans of at least ``MIN_PROBABILITY`` are added.

    Both are arrays of (kind: place in KINDS, start, end, value, before, after), places in code points
    with the end exclusive, by kind and start. Returns the columns of docs but ``text``, and base and
    added, which take the place of columns so named. A NULL or empty text has no spans. What comes to the
    driver are counts of patterns, at most 4 * 5 * 5 * 3**5 rows.
    """
    spans = cut_lineage(find_spans(docs, text), "spans")
    of = F.transform("candidates", lambda s: F.struct(
        s.alias("span"), s["kind"].alias("kind"), *_features(s), *[v.cast("int").alias(k) for k, v in _votes(s, F.col("candidates")).items()]))
    names = ["kind", "size", "digits", *LABELERS]
    counted = spans.where(F.size("candidates") > 0).select(F.explode(of).alias("c")).groupBy(*[F.col(f"c.{n}").alias(n) for n in names]).agg(
        F.count(F.lit(1)).alias("n")).collect()
    merged: dict[tuple, int] = {}
    for r in counted:
        key = (r["kind"], tuple(r[x] for x in LABELERS))
        merged[key] = merged.get(key, 0) + r["n"]
    chance = expectation_maximisation([(k, v, n) for (k, v), n in sorted(merged.items(), key=str)])
    weights = _fit(sorted(counted, key=str), chance)

    def score(c: Column) -> Column:
        inputs = [*[(c["kind"] == KINDS.index(k)).cast("double") for k in EXTRA], *[(c["size"] == i).cast("double") for i in range(5)],
                  *[(c["digits"] == i).cast("double") for i in range(5)], *[F.coalesce(2.0 * c[x] - 1, F.lit(0.0)) for x in LABELERS]]
        total = F.lit(weights[-1])
        for w, x in zip(weights, inputs):
            total = total + F.lit(w) * x
        return total

    bound = math.log(MIN_PROBABILITY / (1 - MIN_PROBABILITY))
    chosen = F.transform(F.filter(of, lambda c: score(c) >= bound), lambda c: c["span"])
    whole = KINDS.index("encoded")
    chosen = F.transform(F.array(chosen), lambda every: F.filter(every, lambda s: (s["kind"] == whole) | ~F.exists(
        every, lambda o: (o["kind"] == whole) & (o["start"] < s["end"]) & (s["start"] < o["end"]))))[0]
    return spans.withColumn("added", F.when(F.size("candidates") > 0, chosen).otherwise(F.array().cast(_SPAN))).drop("candidates")


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def private_digests(docs: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return detect_private(docs.select("doc_id", "text")).select(
        "doc_id", *[count(k) for k in BASE], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.concat("base", "added")).alias("spans"))
