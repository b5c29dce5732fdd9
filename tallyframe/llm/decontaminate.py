"""Benchmark passages in training documents, found by spaced seeds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.batches import U64, Words, blocks, buffer, mix

#: Which words of a stretch a seed reads (1) and which may differ (0). Every stretch of at least
#: MIN_WORDS equal words and more than MIN_SHARE equal words holds a hit of one of them, wherever the
#: changed words are: a test goes through all patterns.
MASKS = ("110111", "1111001", "1110101", "11001011", "1101000011", "10000101011")
#: Words of the benchmark that one pass over the documents holds.
BLOCK_WORDS = 400_000
MIN_WORDS, MIN_SHARE = 10, 0.7
_FILTER_BITS = 22
#: Pairs of words that are compared at once.
_COMPARED = 1 << 22

MATCHES = "doc_id long, item_id long, n_matched long, first_word long, last_word long, identity double"


def _seeds(word_hash: np.ndarray, first: np.ndarray, mask: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of a mask's stretches that lie in one text, and their hashes."""
    n = len(word_hash) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(doc[:n] == doc[len(mask) - 1:])
    h = np.full(len(at), U64(2 * number + 1))
    for j, read in enumerate(mask):
        if read == "1":
            h = (h + word_hash[at + j]) * U64(0x9E3779B97F4A7C15)
    return at, mix(h)


class Benchmark:
    """Words and seeds of a block of items, with the hashes of the seeds sorted."""

    def __init__(self, ids: list, texts: list, masks: tuple[str, ...]):
        words = Words(*buffer(pa.array(texts, pa.string())), lower=True)
        self.ids, self.first, self.hash, self.masks = ids, words.first, words.hash, masks
        sizes = np.diff(words.first)
        self.whole = {n: words.run_hash(words.first[:-1][sizes == n], n) for n in np.unique(sizes).tolist() if n}
        found = [_seeds(words.hash, words.first, m, i) for i, m in enumerate(masks)]
        at, h = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(h, kind="stable")
        self.seed, self.at = h[order], at[order]
        self.likely = np.zeros(1 << _FILTER_BITS, bool)
        self.likely[(h & U64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True

    def matches(self, texts: pa.Array, least: int, share: float) -> list[tuple[int, int, int, int, int, float]]:
        """(row, item, matched words, first and last word in the text, share of equal words)."""
        out = []
        words = Words(*buffer(texts), lower=True)
        found = []
        for number, mask in enumerate(self.masks):
            at, h = _seeds(words.hash, words.first, mask, number)
            pick = self.likely[(h & U64((1 << _FILTER_BITS) - 1)).astype(np.int64)]
            at, h = at[pick], h[pick]
            low, high = np.searchsorted(self.seed, h, "left"), np.searchsorted(self.seed, h, "right")
            count = high - low
            here = np.repeat(at, count)
            there = self.at[np.repeat(low, count) + np.arange(len(here)) - np.repeat(np.cumsum(count) - count, count)] if len(here) else here
            found.append(np.stack([here - there, np.searchsorted(self.first, there, side="right") - 1, words.doc[here] if len(here) else here], axis=1))
        # All hits on one diagonal of a text and an item are one alignment.
        for shift, item, row in self._equal_enough(words, np.unique(np.concatenate(found), axis=0), least).tolist():
            begin = max(self.first[item] + shift, words.first[row])
            end = min(self.first[item + 1] + shift, words.first[row + 1])
            same = words.hash[begin:end] == self.hash[begin - shift: end - shift]
            for a, b in _stretches(same, least, share):
                n = int(same[a:b].sum())
                out.append((row, item, n, int(begin + a - words.first[row]), int(begin + b - 1 - words.first[row]), n / (b - a)))
        # An item of fewer words than any stretch needs must be there as a whole.
        sizes = np.diff(self.first)
        for size in np.unique(sizes[(sizes > 0) & (sizes < least)]).tolist():
            short = np.flatnonzero(sizes == size)
            h = self.whole[size]
            order = np.argsort(h, kind="stable")
            at, here = words.windows(size)
            low, high = np.searchsorted(h[order], here, "left"), np.searchsorted(h[order], here, "right")
            for i in np.flatnonzero(high > low).tolist():
                row, place = int(words.doc[at[i]]), int(at[i] - words.first[words.doc[at[i]]])
                out += [(row, item, size, place, place + size - 1, 1.0) for item in short[order[low[i]: high[i]]].tolist()]
        return out


    def _equal_enough(self, words: Words, found: np.ndarray, least: int) -> np.ndarray:
        """The alignments (shift, item, row) with at least ``least`` equal words, many compared at once."""
        shift, item, row = found.T
        begin = np.maximum(self.first[item] + shift, words.first[row])
        size = np.minimum(self.first[item + 1] + shift, words.first[row + 1]) - begin
        ends = np.cumsum(size)
        keep = np.zeros(len(found), bool)
        a = 0
        while a < len(found):
            done = ends[a] - size[a]
            b = max(a + 1, int(np.searchsorted(ends, done + _COMPARED, side="right")))
            at = np.arange(ends[b - 1] - done) + np.repeat(begin[a:b] - (ends[a:b] - size[a:b] - done), size[a:b])
            equal = words.hash[at] == self.hash[at - np.repeat(shift[a:b], size[a:b])]
            keep[a:b] = np.bincount(np.repeat(np.arange(b - a), size[a:b]), equal, minlength=b - a) >= least
            a = b
        return found[keep]


def _stretches(same: np.ndarray, least: int, share: float) -> list[tuple[int, int]]:
    """Disjoint stretches with at least ``least`` equal words, of which more than ``share`` are equal:
    the one with the best score, then those before and behind it, until none is left."""
    out, todo = [], [(0, len(same))]
    while todo:
        begin, end = todo.pop()
        best = _best_stretch(same[begin:end], least, share)
        if best is not None:
            a, b = begin + best[0], begin + best[1]
            out.append((a, b))
            todo += [(begin, a), (b, end)]
    return sorted(out)


def _best_stretch(same: np.ndarray, least: int, share: float) -> tuple[int, int] | None:
    """The stretch with the best score of those with ``least`` equal words, where an equal word counts 1
    and another share / (share - 1): its score is above zero only if more than ``share`` of its words are equal."""
    equal = np.concatenate([[0], np.cumsum(same)])
    if equal[-1] < least:
        return None
    score = equal - (np.arange(len(equal)) - equal) * (share / (1 - share))
    # A stretch that ends at b begins at the latest where ``least`` equal words are still to come.
    latest = np.searchsorted(equal, equal - least, side="right") - 1
    lowest = np.minimum.accumulate(score)
    gain = np.where(latest >= 0, score - lowest[latest], -np.inf)
    b = int(np.argmax(gain))
    if gain[b] <= 1e-9:
        return None
    return int(np.flatnonzero(score[: latest[b] + 1] == lowest[latest[b]])[-1]), b


def _blocks_of(items: DataFrame, item_id: str, text: str, words: int) -> Iterator[Benchmark]:
    """The benchmark in blocks of about ``words`` words, so that a pass holds a bounded share of it."""
    sized = items.select(F.col(item_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = sized.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // 5
    number = max(1, -(-total // words))
    for i in range(number):
        part = sized if number == 1 else sized.where(F.pmod(F.xxhash64("id", "text"), F.lit(number)) == i)
        rows = part.orderBy("id", "text").collect()
        yield Benchmark([r[0] for r in rows], [r[1] for r in rows], MASKS)


def benchmark_matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                      item_text: str = "text", least: int = MIN_WORDS, share: float = MIN_SHARE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents that hold a passage of a benchmark item, where single words may be exchanged.

    Words are split at blanks after lower-casing A-Z. A seed is the hash of the words that a fixed
    mask reads; exchanged words that fall on the mask's gaps don't change it. Seeds of documents are
    joined with those of the items by hash. Around each hit the document and the item are laid on
    each other at that shift, over the item's whole length, and compared word by word. Of the stretches
    with at least ``least`` equal words, more than ``share`` of all, the one with the best balance is
    reported, then those of the words before and behind it. An item of fewer than ``least`` words is
    reported where it stands as a whole.

    The benchmark is joined in blocks of about ``block_words`` words, each in one pass over the
    documents that moves no document. Returns a row per document, item and stretch: doc_id,
    item_id, n_matched, first_word and last_word (places in the document, from 0), identity.
    NULL and empty texts match nothing. Rows that repeat are reported each.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for block in _blocks_of(items, item_id, item_text, block_words):
        held = spark.sparkContext.broadcast(block)

        def run(batches, held=held):
            for batch in batches:
                for a, b in blocks(buffer(batch.column(1))[1]):
                    part = batch.slice(a, b - a)
                    found = held.value.matches(part.column(1), least, share)
                    names = part.column(0).to_pylist()
                    ids = held.value.ids
                    data = [[names[m[0]] for m in found], [ids[m[1]] for m in found], *([m[j] for m in found] for j in range(2, 6))]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64() if j == 5 else pa.int64()) for j, x in enumerate(data)],
                                                     names=["doc_id", "item_id", "n_matched", "first_word", "last_word", "identity"])

        found = rows.mapInArrow(run, MATCHES)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                      least: int = MIN_WORDS, share: float = MIN_SHARE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs, with their columns, that hold no passage of a benchmark item."""
    spark = docs.sparkSession
    for block in _blocks_of(items, item_id, item_text, block_words):
        held = spark.sparkContext.broadcast(block)

        def run(batches, held=held):
            for batch in batches:
                column = batch.schema.get_field_index(text)
                for a, b in blocks(buffer(batch.column(column))[1]):
                    part = batch.slice(a, b - a)
                    keep = np.ones(part.num_rows, bool)
                    keep[[m[0] for m in held.value.matches(part.column(column), least, share)]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
