"""Field similarity for record matching, as columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- Fixed values: company suffixes, removed in this order ----
SUFFIXES = (" llc", " ltd", " inc", " corp", " corporation", " co", " company", " plc", " gmbh", " ag", " sa", " sas", " bv")

# ---- Fixed values: soundex digits per letter ----
SOUNDEX = {"BFPV": "1", "CGJKQSXZ": "2", "DT": "3", "L": "4", "MN": "5", "R": "6"}


def clean(c: Column) -> Column:
    return F.lower(F.trim(c))


def exact(a: Column, b: Column) -> Column:
    return F.when(clean(a) == clean(b), 1.0).otherwise(0.0)


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 minus the edit distance over the longer length; an empty side scores 0."""
    n = F.greatest(F.length(a), F.length(b))
    either_empty = (F.length(a) == 0) | (F.length(b) == 0)
    return F.when(a == b, 1.0).when(either_empty, 0.0).otherwise(1 - F.levenshtein(a, b) / n)


def soundex(c: Column) -> Column:
    """Phonetic code in which only a coded letter ends a run: vowels, H and W do not."""
    s = F.upper(c)
    letters, digits = "".join(SOUNDEX), "".join(d * len(ls) for ls, d in SOUNDEX.items())
    coded = F.translate(F.regexp_replace(s, f"[^{letters}]", ""), letters, digits)
    runs = F.regexp_replace(coded, r"(.)\1+", "$1")
    # the code of a coded first letter is the letter itself
    tail = F.when(F.left(s, F.lit(1)).rlike(f"[{letters}]"), F.substr(runs, F.lit(2))).otherwise(runs)
    return F.when(s == "", "").otherwise(F.rpad(F.concat(F.left(s, F.lit(1)), F.left(tail, F.lit(3))), 4, "0"))


def normalize(c: Column) -> Column:
    """Lower case without surrounding blanks and without company suffixes."""
    s = F.regexp_replace(F.lower(c), r"^\s+|\s+$", "")
    for suffix in SUFFIXES:
        s = F.regexp_replace(s, rf"\s*{suffix}$", "")
    return F.coalesce(s, F.lit(""))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _jaro_winkler_udf():
    """Arrow UDF; the helpers are nested so that they travel with it to the executors."""

    def jaro(a: str, b: str) -> float:
        """Share of characters found near the same place, less half of those out of order."""
        if a == b:
            return 1.0
        reach = max(max(len(a), len(b)) // 2 - 1, 0)
        open_b, hits = list(b), []
        for i, ch in enumerate(a):
            start = max(0, i - reach)
            window = open_b[start: i + reach + 1]
            if ch in window:
                j = start + window.index(ch)
                open_b[j] = None
                hits.append((j, ch))
        if not hits:
            return 0.0
        m = len(hits)
        moved = sum(x != y for (_, x), (_, y) in zip(hits, sorted(hits, key=lambda h: h[0]), strict=True))
        return (m / len(a) + m / len(b) + (m - moved / 2) / m) / 3

    def score(a, b):
        if a is None or b is None:
            return None
        j, prefix = jaro(a, b), 0
        while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
            prefix += 1
        return j + prefix * 0.1 * (1 - j)

    def batch(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([score(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return F.pandas_udf(batch, T.DoubleType())


def jaro_winkler(a: Column, b: Column) -> Column:
    return _jaro_winkler_udf()(a, b)


def similarity(kind: str, a: Column, b: Column) -> Column:
    """Score 0..1 of two filled values by match type."""
    a, b = a.cast("string"), b.cast("string")
    if kind == "exact":
        return exact(a, b)
    if kind == "fuzzy_jaro_winkler":
        return jaro_winkler(F.lower(a), F.lower(b))
    if kind == "fuzzy_levenshtein":
        return levenshtein_ratio(F.lower(a), F.lower(b))
    if kind == "soundex":
        return F.when(soundex(a) == soundex(b), 1.0).otherwise(0.0)
    if kind == "normalized":
        return levenshtein_ratio(normalize(a), normalize(b))
    if kind == "numeric":
        return F.when(digits(a) == digits(b), 1.0).otherwise(0.0)
    raise ValueError(f"unknown match type {kind!r}")


def equality_key(kind: str, c: Column) -> Column:
    """Values with the same key have full similarity by this match type."""
    c = c.cast("string")
    return {"exact": clean, "fuzzy_jaro_winkler": F.lower, "fuzzy_levenshtein": F.lower, "soundex": soundex,
            "normalized": normalize, "numeric": digits}[kind](c)
