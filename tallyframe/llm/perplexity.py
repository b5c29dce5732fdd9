"""Quality rules: repetition and length of texts, and bands of n-gram perplexity per language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.common import cut_lineage, exceeds, spread_join
from tallyframe.llm import alphabet
from tallyframe.llm import exchange as ex
from tallyframe.llm.batches import _IS_BLANK, U64, Words, blocks, buffer, mix, with_columns
from tallyframe.llm.exchange import DOUBLE, LONG, output_schema
from tallyframe.llm.frames import restore, set_aside

#: Bytes are folded into 32 symbols, so that there are at most 2**20 four-grams whatever the corpus.
BITS, ORDER = 5, 4
#: Letters without case, blanks, digits, line ends, bytes beyond ASCII, sentence marks, all else.
SYMBOLS = np.full(256, 31, np.uint8)
SYMBOLS[65:91] = SYMBOLS[97:123] = np.arange(26)
SYMBOLS[list(b"\t\x0b\x0c\r ")] = 26
SYMBOLS[48:58] = 27
SYMBOLS[10] = 28
SYMBOLS[128:] = 29
SYMBOLS[list(b".,;:!?'\"()-")] = 30

MIN_WORDS, MAX_REPEATED = 20, 30
#: Half the width of a band, in standard deviations of the language (from its median absolute
#: deviation) at the text's length, and the least half width, both of the logarithm of the perplexity.
WIDTH, LEAST_WIDTH = 6.0, 0.08
BIN = 0.01
METRICS = {"n_words": LONG, "word_chars": LONG, "n_symbols": LONG, "n_dup_lines": LONG, "n_repeat_words": LONG}


def _grams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all four-grams inside one text, and where each begins."""
    n = len(buf) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    s = SYMBOLS[buf].astype(np.int32)
    code = s[:n].copy()
    for j in range(1, ORDER):
        code = (code << BITS) | s[j: j + n]
    marks = np.zeros(len(buf) + 1, np.int32)
    long = np.diff(offs) >= ORDER
    np.add.at(marks, offs[:-1][long], 1)
    np.add.at(marks, offs[1:][long] - ORDER + 1, -1)
    at = np.flatnonzero(np.cumsum(marks[:n]))
    return code[at], at


def _count(batches) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << BITS * ORDER, np.int64)
    for batch in batches:
        buf, offs = buffer(batch.column(0))
        for a, b in blocks(offs):
            code, _ = _grams(buf[offs[a]: offs[b]], offs[a: b + 1] - offs[a])
            counts += np.bincount(code, minlength=len(counts))
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], names=["gram", "n"])


class KneserNey:
    """Modified Kneser-Ney model of order four in sorted arrays of hashed n-grams.

    The highest order counts occurrences, lower ones the distinct symbols before an n-gram. Each
    order has three discounts from its counts of counts. ``known`` holds the hashes of the n-grams
    of all orders in rising order and ``value`` what each adds; ``context`` and ``share`` the same
    for what a context leaves to the next lower order.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        size = 1 << BITS
        keys, values, contexts, shares = [], [], [], []
        codes, n = grams.astype(np.int64), counts.astype(np.float64)
        for order in range(ORDER, 0, -1):
            times = [max(int((n == i).sum()), 0) for i in (1, 2, 3, 4)]
            y = times[0] / (times[0] + 2 * times[1]) if times[0] + times[1] else 0.5
            d = [0.0] + [min(i, max(0.0, i - (i + 1) * y * times[i] / times[i - 1])) if times[i - 1] else 0.5 for i in (1, 2, 3)]
            off = np.array(d)[np.minimum(n, 3).astype(int)]
            before, back = np.unique(codes >> BITS, return_inverse=True)
            total = np.bincount(back, n)
            keys.append(self.key(codes, order))
            values.append((n - off) / total[back])
            contexts.append(self.key(before, order))
            shares.append(np.bincount(back, off) / total)
            if order > 1:
                codes, n = np.unique(codes & (1 << BITS * (order - 1)) - 1, return_counts=True)
                n = n.astype(np.float64)
        self.known, self.value = self._sorted(keys, values)
        self.context, self.share = self._sorted(contexts, shares)
        self.floor = 1.0 / size

    @staticmethod
    def key(codes: np.ndarray, order: int) -> np.ndarray:
        return mix(codes.astype(np.uint64) * U64(8) + U64(order))

    @staticmethod
    def _sorted(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        k, v = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(k)
        return k[order], v[order]

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
        if len(keys) == 0:
            return np.full(len(wanted), missing)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], missing)

    def log_probability(self, grams: np.ndarray) -> np.ndarray:
        """Natural logarithm of the last symbol's probability after the ones before it."""
        p = np.full(len(grams), self.floor)
        for order in range(1, ORDER + 1):
            code = grams & (1 << BITS * order) - 1
            p = self._find(self.known, self.value, self.key(code, order), 0.0) + p * self._find(
                self.context, self.share, self.key(code >> BITS, order), 1.0)
        return np.log(p)


def _metrics(table: pa.Table, text: str, model: KneserNey, memo: np.ndarray) -> dict[str, np.ndarray]:
    buf, offs = buffer(table[text])
    n = len(offs) - 1
    words = Words(buf, offs, lower=False)
    per_doc = lambda marks: np.diff(np.concatenate([[0], np.cumsum(marks)])[offs])
    symbol = np.zeros(256, bool)
    symbol[list(b"#*$%&|<>")] = True
    at, h = words.windows(8)
    own = mix(h + words.doc[at].astype(np.uint64) * U64(0xD1342543DE82EF95)) if len(at) else h
    order = np.argsort(own)
    same = own[order][1:] == own[order][:-1]
    again = np.zeros(len(own), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at[again], 1)
    np.add.at(cover, at[again] + 8, -1)
    repeated = np.bincount(words.doc[np.cumsum(cover[:-1]) > 0], minlength=n) if len(words) else np.zeros(n)
    data, dup = buf.tobytes(), np.zeros(n, np.int64)
    for d, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
        if a < b:
            lines = data[a:b].split(b"\n")
            if len(lines) > 1:
                lines = [x for x in lines if x.strip(b" \t\x0b\x0c\r")]
                dup[d] = len(lines) - len(set(lines))
    code, _ = _grams(buf, offs)
    lp = memo[code]
    if len(new := np.unique(code[np.isnan(lp)])):
        memo[new] = model.log_probability(new)
        lp = memo[code]
    scored = np.maximum(np.diff(offs) - ORDER + 1, 0)
    doc = np.repeat(np.arange(n), scored)
    with np.errstate(invalid="ignore", divide="ignore"):
        log_perplexity = np.where(scored > 0, -np.bincount(doc, lp, minlength=n) / scored, np.nan)
    return {"n_words": words.counts(), "word_chars": per_doc(((buf & 0xC0) != 0x80) & ~_IS_BLANK[buf]), "n_symbols": per_doc(symbol[buf]),
            "n_dup_lines": dup, "n_repeat_words": repeated, "log_perplexity": log_perplexity, "__grams": scored}


def fit_model(docs: DataFrame, text: str = "text") -> KneserNey:
    """The model of all texts. Spark counts; what comes to the driver is one row per four-gram."""
    counts = docs.select(F.col(text).alias("text")).mapInArrow(_count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    table = counts.orderBy("gram").toArrow()
    return KneserNey(table["gram"].to_numpy(), table["n"].to_numpy())


def _by_language(rows: DataFrame, languages: DataFrame) -> DataFrame:
    """Join rows with a table of one short row per language; more languages than a broadcast should
    hold are joined with their hot ones spread."""
    if exceeds(languages, 10_000):
        return spread_join(rows, languages, ["band_lang"], "left")
    return rows.join(F.broadcast(languages), "band_lang", "left")


def _medians(values: DataFrame, value: str, name: str) -> DataFrame:
    """(band_lang, name): median of a number per language, in bins of BIN. Only bins are gathered, a few
    thousand per language."""
    bins = values.groupBy("band_lang", F.round(F.col(value) / BIN).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    whole = bins.groupBy("band_lang").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at"))

    def step(acc, b):
        seen = acc["seen"] + b["n"]
        return F.struct(seen.alias("seen"), F.coalesce(acc["at"], F.when(2 * seen >= F.col("total"), b["bin"])).alias("at"))

    return whole.select("band_lang", (F.aggregate("bins", start, step)["at"] * BIN).alias(name))


def language_bands(scored: DataFrame, value: str = "log_perplexity", grams: str = "__grams") -> DataFrame:
    """(band_lang, middle, spread): median of the logarithm of the perplexity, and the standard deviation
    of its distance from there times the root of the text's length, from the median absolute deviation."""
    known = scored.where(F.col(value).isNotNull()).select("band_lang", value, grams)
    middle = cut_lineage(_medians(known, value, "middle"), "bands")
    away = _by_language(known, middle).select("band_lang", (F.abs(F.col(value) - F.col("middle")) * F.sqrt(grams)).alias("away"))
    return cut_lineage(middle.join(_medians(away, "away", "mad"), "band_lang").select("band_lang", "middle", (1.4826 * F.col("mad")).alias("spread")), "bands")


def quality(docs: DataFrame, text: str = "text", lang: str | None = "lang", carry_text: bool = True) -> DataFrame:
    """Score every document by rules and by the perplexity of its text, and decide whether to keep it.

    Words are split at blanks. n_words; word_chars (code points in words); n_symbols (characters of
    ``#*$%&|<>``); n_dup_lines (lines with a word that are equal to an earlier line of the text);
    n_repeat_words (words in windows of eight words found twice or more in the text). base_failed: under
    20 words, or over 30 % of the words repeated. log_perplexity: of a modified Kneser-Ney model of
    four bytes, folded into 32 symbols, counted over all texts. kept: not base_failed, and
    the logarithm of the perplexity within the band of the text's language, both bounds included: its
    median, and WIDTH standard deviations to either side. Short texts vary more, so deviations are
    measured times the root of the text's length, and the band of a text is as wide as its length asks.

    Folding drops case and every letter beyond ASCII, so texts are judged a second time by a model of
    whole code points that grows with the corpus (``alphabet``): log_perplexity_points, of the half of the
    corpus that a text isn't in. It must not lie above its band; below lie near copies, which the first
    band judges.

    A NULL or empty text has no words and fails. Texts under four bytes, or code points, have no
    perplexity. NULL
    languages are a language of their own, as are all texts if ``lang`` is None. Returns the columns
    of docs (without ``text`` unless ``carry_text``), then these, which take the place of columns so
    named. The folded model is bounded by its 2**20 n-grams (16 MB), the bands by the number of languages;
    the other stays in Spark's tables.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(fit_model(docs, text))
    new = {**METRICS, "log_perplexity": DOUBLE, "log_perplexity_points": DOUBLE, "__grams": LONG, "__points": LONG}
    drop = [] if carry_text else [text]
    pieces = ex.write_pieces(docs, text)
    found_points, shards = alphabet.answers(pieces, text)

    def finish(piece, table, answers):
        memo = np.full(1 << BITS * ORDER, np.nan, np.float32)
        points, scored = alphabet.held_out(table, text, answers[0], shards)
        for a, b in blocks(buffer(table[text])[1]):
            part = table.slice(a, b - a)
            found = _metrics(part, text, held.value, memo) | {"log_perplexity_points": points[a:b], "__points": scored[a:b]}
            ordered = {k: pa.array(found[k], pa.float64(), from_pandas=True) if t is DOUBLE else pa.array(found[k].astype(np.int64)) for k, t in new.items()}
            yield from with_columns(part.drop_columns(drop), ordered)

    scored = cut_lineage(ex.with_answers(pieces, [found_points], finish, output_schema(docs.drop(*drop), new)), "quality")
    ex.drop_pieces(pieces)
    keyed = scored.withColumn("band_lang", F.coalesce(F.col(lang), F.lit("")) if lang else F.lit(""))
    judged = _by_language(keyed, language_bands(keyed))
    judged = _by_language(judged, language_bands(keyed, "log_perplexity_points", "__points").withColumnsRenamed(
        {"middle": "__middle", "spread": "__spread"}))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    half = lambda spread, grams: F.greatest(F.lit(LEAST_WIDTH), WIDTH * F.col(spread) / F.sqrt(grams))
    inside = F.abs(F.col("log_perplexity") - F.col("middle")) <= half("spread", "__grams")
    below = F.col("log_perplexity_points") - F.col("__middle") <= half("__spread", "__points")
    return (judged.withColumn("base_failed", failed).withColumn("kept", ~failed & F.coalesce(inside, F.lit(True)) & F.coalesce(below, F.lit(True)))
            .drop("band_lang", "middle", "spread", "__middle", "__spread", "__grams", "__points"))


def keep_good(docs: DataFrame, text: str = "text", lang: str | None = "lang") -> DataFrame:
    """The rows of docs, with their columns, that ``quality`` keeps."""
    lang = lang if lang in docs.columns else None
    judged = quality(set_aside(docs, text, [lang] if lang else []), text, lang)
    return restore(judged.where("kept"), docs.columns, text)
