"""Phrase collocations: counts of word runs by a multikey quicksort of suffixes, cut scores, nested phrases.

A *suffix* is a word of a text with up to three that follow it in its piece. Suffixes are routed to shards
by their leading words; a shard sorts its own by a three-way quicksort over words, in which a partition
whose keys are equal down to a depth is one phrase and its size the phrase's count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.common import cut_lineage, spread_join
from tallyframe.llm.batches import U64, blocks, buffer, mix, prefix_hash, slice_hash
from tallyframe.llm.exchange import from_blob, to_blob

DEPTH = 4
#: Bytes of text that a task handles at once, and suffixes that a shard is laid out for.
BATCH_BYTES, BLOCK_BYTES, SHARD_SUFFIXES = 4 << 20, 1 << 19, 1 << 21
#: Most frequent words that have numbers, which all tasks know (16 MB); other words are sent as hashes.
RANKED = 1 << 20
#: Bits of the filter of further frequent words, at most. Beyond it more suffixes than needed are sent;
#: counts stay the same.
FILTER_BITS = 1 << 26
#: Partitions of the exchange of suffixes, at most.
MOST_PARTITIONS = 1 << 15

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: What ends a piece, and what else separates words.
_ENDS = np.zeros(256, bool)
_ENDS[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
_GAP = _ENDS.copy()
_GAP[[0x20, 0x09]] = True
_ROUTE = [U64(0x9E3779B97F4A7C15), U64(0xD1342543DE82EF95), U64(0x2545F4914F6CDD1D), U64(0xBF58476D1CE4E5B9)]


class Tokens:
    """Words of many texts: byte range, text, hash (of language and word) and the piece they stand in."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        raw, offs = buffer(texts)
        names = pc.dictionary_encode(langs.fill_null("und"))
        seeds = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in names.dictionary.to_pylist()], np.uint64)
        self.langs, self.buf = names.dictionary, _LOWER[raw]
        of_text = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        cuts, text = self._parts(offs)
        found = [self._block(cuts[a: b + 1], text[a:b]) for a, b in blocks(cuts, BLOCK_BYTES)]
        none = np.zeros(0, np.int64)
        #: follows: whether the next word stands in the same piece.
        self.start, self.end, self.lang, self.hash, self.follows = [
            np.concatenate([none.astype(kind), *[f[i] for f in found]]) for i, kind in enumerate((np.int64, np.int64, np.int64, np.uint64, bool))]
        self.lang = of_text[self.lang]
        if len(self.hash):
            self.hash = mix(self.hash ^ seeds[self.lang])
            self.hash[self.hash == 0] = 1

    def _parts(self, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets with long texts cut behind ends of pieces, and the text of each part."""
        cuts, text = [], []
        for d, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
            cuts.append(a)
            text.append(d)
            if b - a > BLOCK_BYTES:
                ends = np.flatnonzero(_ENDS[self.buf[a:b]]) + a + 1
                while b - a > BLOCK_BYTES and len(ends):
                    fit = max(0, int(np.searchsorted(ends, a + BLOCK_BYTES, side="right")) - 1)
                    a, ends = int(ends[fit]), ends[fit + 1:]
                    cuts.append(a)
                    text.append(d)
        return np.array([*cuts, offs[-1]], np.int64), np.array(text, np.int64)

    def _block(self, cuts: np.ndarray, text: np.ndarray):
        base = int(cuts[0])
        x, offs = self.buf[base: cuts[-1]], cuts - base
        solid = ~_GAP[x]
        edge = np.zeros(len(x) + 1, bool)
        edge[offs] = True
        before, after = np.zeros(len(x), bool), np.zeros(len(x), bool)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        start = np.flatnonzero(solid & (~before | edge[:-1]))
        end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        ends = np.cumsum(_ENDS[x])
        part = np.searchsorted(offs, start, side="right") - 1
        # Ends and parts only rise, so their sum changes where either does.
        follows = np.append(np.diff(ends[start] + part) == 0, np.zeros(min(len(start), 1), bool))
        return start + base, end + base, text[part], slice_hash(prefix_hash(x), start, end), follows

    def words(self, at: np.ndarray) -> pa.Array:
        return pa.array([self.buf[a:b].tobytes() for a, b in zip(self.start[at].tolist(), self.end[at].tolist())], pa.binary()).cast(pa.string())


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(texts, langs) of about BATCH_BYTES each."""
    for batch in batches:
        offs = buffer(batch.column(0))[1]
        for a, b in blocks(offs, BATCH_BYTES):
            yield batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)


def _count(batches) -> Iterator[pa.RecordBatch]:
    """Counts of words of a task, and of all words per language (hash NULL)."""
    def out(h, n, lang):
        return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(n, pa.int64()), pa.array(lang, pa.string())], names=["h", "n", "lang"])

    held, counts, totals = np.zeros(0, np.uint64), np.zeros(0, np.int64), {}
    for texts, langs in _batches(batches):
        t = Tokens(texts, langs)
        u, n = np.unique(t.hash, return_counts=True)
        for lang, k in zip(t.langs.to_pylist(), np.bincount(t.lang, minlength=len(t.langs)).tolist()):
            totals[lang] = totals.get(lang, 0) + k
        both = np.concatenate([held, u])
        order = np.argsort(both, kind="stable")
        both, n = both[order], np.concatenate([counts, n])[order]
        at = np.flatnonzero(np.diff(both, prepend=both[:1] + U64(1)))
        held, counts = both[at], np.add.reduceat(n, at) if len(at) else n[:0]
        if len(held) > 1 << 20:
            yield out(held.view(np.int64), counts, [None] * len(held))
            held, counts = held[:0], counts[:0]
    yield out(held.view(np.int64), counts, [None] * len(held))
    yield out([None] * len(totals), list(totals.values()), list(totals))


class Known:
    """What all tasks know of the frequent words: the RANKED most frequent ones by number, a filter of the
    rest, and from which count on a word is hot."""

    def __init__(self, words: DataFrame, hot: int):
        spread = words.groupBy(F.floor(4 * F.log2("f")).alias("size")).agg(F.count(F.lit(1)).alias("n"), F.min("f").alias("f")).orderBy(F.desc("size")).collect()
        held, least = 0, 1 << 62
        for row in spread:  # at most 256 rows
            if held + row["n"] > RANKED:
                break
            held, least = held + row["n"], row["f"]
        top = words.where(F.col("f") >= least).toArrow()
        f, h = top["f"].to_numpy(), top["h"].to_numpy().view(np.uint64)
        order = np.lexsort((h, -f))
        #: Hash of each number; 0 is no word.
        self.ranked = np.append(U64(0), h[order])
        self.hot = np.append(False, f[order] > hot)
        rest = words.where(F.col("f") < least)
        self.filter = self._bits(rest, sum(r["n"] for r in spread) - held)
        self.index()

    def index(self) -> None:
        self.by_hash = np.argsort(self.ranked, kind="stable")
        self.sorted = self.ranked[self.by_hash]

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("ranked", "hot", "filter")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.index()

    @staticmethod
    def _bits(words: DataFrame, rows: int) -> np.ndarray:
        if not rows:
            return np.zeros(0, np.uint64)
        bits = 1 << min(FILTER_BITS.bit_length() - 1, max(16, (32 * rows).bit_length()))
        cell = F.expr(f"h & {bits - 1}L")
        table = words.groupBy(F.shiftright(cell, 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 AS int))")).alias("b")).toArrow()
        out = np.zeros(bits // 64, np.uint64)
        out[table["i"].to_numpy()] = table["b"].to_numpy().view(np.uint64)
        return out

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of words (0 for those without one), and which words may be frequent."""
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        number = np.where(self.sorted[at] == hashes, self.by_hash[at], 0)
        known = number > 0
        if len(self.filter):
            cell = hashes & U64(len(self.filter) * 64 - 1)
            known |= (self.filter[cell >> U64(6)] >> (cell & U64(63))) & U64(1) == 1
        return number, known


def _send(batches, known: Known, shards: int) -> Iterator[pa.RecordBatch]:
    """Suffixes of frequent words, equal ones as one with their number, packed per shard; and the words
    themselves (shards from ``shards`` on)."""
    told = np.zeros(0, np.uint64)
    for texts, langs in _batches(batches):
        t = Tokens(texts, langs)
        if not len(t.hash):
            continue
        u, first, code = np.unique(t.hash, return_index=True, return_inverse=True)
        number, frequent = known.numbers(u)
        new = np.flatnonzero(frequent & ~np.isin(u, told, assume_unique=True))
        told = np.union1d(told, u[new])
        deal = (u[new] % U64(shards)).astype(np.int64)
        rows = []
        for s in np.unique(deal).tolist():
            at = first[new[deal == s]]
            rows.append((shards + s, to_blob(pa.table({"h": t.hash[at].view(np.int64), "lang": t.langs.take(pa.array(t.lang[at])), "word": t.words(at)}))))
        rows += _suffixes(t.follows, code.astype(np.int64), frequent, u, number, known.hot, shards)
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.binary())], names=["shard", "blob"])


def _suffixes(follows, code, frequent, u, number, is_hot, shards: int) -> list[tuple[int, bytes]]:
    ok = frequent[code]
    link = follows.copy()
    link[:-1] &= ok[:-1] & ok[1:]
    at = np.flatnonzero(link)
    if not len(at):
        return []
    code = np.append(code + 1, np.zeros(DEPTH, np.int64))  # 0: no word
    link = np.append(link, np.zeros(DEPTH, bool))
    c, on = [code[at]], np.ones(len(at), bool)
    for d in range(1, DEPTH):
        on = on & link[at + d - 1]
        c.append(np.where(on, code[at + d], 0))
    if len(u) < (1 << 21) - 1:
        order = np.lexsort((c[3], c[0] << 42 | c[1] << 21 | c[2]))
    else:
        order = np.lexsort(c[::-1])
    c = [x[order] for x in c]
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in c], axis=0)
    begin = np.flatnonzero(new)
    weight = np.diff(np.append(begin, len(order)))
    c = [x[begin] for x in c]
    hashes, numbers = np.append(U64(0), u), np.append(0, number)
    hot = is_hot[numbers]
    # Two leading words route a suffix; a third and a fourth one where those before are all hot.
    deep = np.full(len(begin), 2, np.uint8)
    warm = hot[c[0]] & hot[c[1]]
    route = hashes[c[0]] * _ROUTE[0] + hashes[c[1]] * _ROUTE[1]
    for d in (2, 3):
        deep[warm] = d + 1
        route = np.where(warm, route + (hashes[c[d]] + U64(1)) * _ROUTE[d], route)
        warm = warm & hot[c[d]]
    shard = (mix(route) % U64(shards)).astype(np.int64)
    order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
    c, weight, deep, shard = [x[order] for x in c], weight[order], deep[order], shard[order]
    begin = np.flatnonzero(np.diff(shard, prepend=-1))
    return [(s, _pack(np.stack([x[a:b] for x in c]), weight[a:b], deep[a:b], hashes, numbers)) for s, a, b in zip(
        shard[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(shard)])]


def _pack(c: np.ndarray, weight: np.ndarray, deep: np.ndarray, hashes: np.ndarray, numbers: np.ndarray) -> bytes:
    """Numbers in planes of bytes, so that they compress; words without a number as RANKED + 1 and on,
    their hashes first."""
    plain = numbers[c]
    odd = (plain == 0) & (c > 0)
    extra = np.zeros(0, np.uint64)
    if odd.any():
        used, place = np.unique(c[odd], return_inverse=True)
        extra = hashes[used]
        plain[odd] = RANKED + 1 + place
    planes = np.stack([(plain >> 8 * i).astype(np.uint8) for i in range(3)])
    raw = b"".join([extra.tobytes(), planes.tobytes(), weight.astype(np.uint32).tobytes(), deep.tobytes()])
    return np.array([len(extra), len(weight), len(raw)], np.int64).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words without a number, numbers (DEPTH x n), weights and key depths."""
    extra, n, size = np.frombuffer(blob, np.int64, 3).tolist()
    raw = pa.decompress(memoryview(blob)[24:], decompressed_size=size, codec="zstd", asbytes=True)
    at = 8 * extra
    planes = np.frombuffer(raw, np.uint8, 3 * DEPTH * n, at).reshape(3, DEPTH, n).astype(np.int32)
    at += 3 * DEPTH * n
    return (np.frombuffer(raw, np.uint64, extra), planes[0] | planes[1] << 8 | planes[2] << 16, np.frombuffer(raw, np.uint32, n, at),
            np.frombuffer(raw, np.uint8, n, at + 4 * n))


def equal_partitions(keys: np.ndarray, weight: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Multikey three-way quicksort of suffix pointers, all partitions side by side.

    ``keys`` is (depth x n), 0 for no word. Each step takes a pivot per partition, the median of three of its
    keys at its depth, and deals the pointers into smaller, equal and larger ones. Equal ones go on one
    word deeper: they share that many words, so their weight is the count of the phrase. Partitions whose
    weight is under ``least`` are abandoned, as none of their phrases can reach it. Yields (depth, a
    pointer of each phrase, counts) for every phrase that reaches it.
    """
    depth_limit, n = keys.shape
    pointer = np.arange(n)
    begin, depth = np.zeros(min(n, 1), np.int64), np.zeros(min(n, 1), np.int64)
    if n and weight.sum() < least:
        return
    while len(pointer):
        size = np.diff(np.append(begin, len(pointer)))
        part = np.repeat(np.arange(len(begin)), size)
        key = keys[depth[part], pointer]
        pivot = np.sort(np.stack([key[begin], key[begin + size // 2], key[begin + size - 1]]), axis=0)[1][part]
        side = (key >= pivot).astype(np.int8) + (key > pivot)
        # A stable deal: each pointer's place among those of its partition on its side.
        counts = np.zeros((len(begin), 3), np.int64)
        place = np.empty(len(pointer), np.int64)
        runs = [np.cumsum(side == s) for s in range(3)]
        last = begin + size - 1
        for s in range(3):
            before = np.where(begin > 0, runs[s][begin - 1], 0)
            counts[:, s] = runs[s][last] - before
            runs[s] -= before[part] + 1
        offset = begin[:, None] + np.cumsum(counts, axis=1) - counts
        for s in range(3):
            here = side == s
            place[here] = offset[part[here], s] + runs[s][here]
        dealt = np.empty_like(pointer)
        dealt[place] = pointer
        begins, sizes = offset.ravel(), counts.ravel()
        depths = (depth[:, None] + np.array([0, 1, 0])).ravel()
        some = np.flatnonzero(sizes)
        begins, sizes, depths, equal = begins[some], sizes[some], depths[some], some % 3 == 1
        total = np.add.reduceat(weight[dealt], begins)
        lead = dealt[begins]
        # The last word of what all pointers of an equal partition share; 0 is the end of a piece.
        ended = equal & (keys[depths - equal, lead] == 0)
        stay = (total >= least) & ~ended
        for d in range(1, depth_limit + 1):
            hit = stay & equal & (depths == d)
            if hit.any():
                yield d, lead[hit], total[hit]
        stay &= depths < depth_limit
        pointer = dealt[np.repeat(stay, sizes)]
        depth, sizes = depths[stay], sizes[stay]
        begin = np.cumsum(sizes) - sizes


def _sums(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A pointer of each distinct row of keys, and its weight."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = (keys[:, order[1:]] != keys[:, order[:-1]]).any(axis=0)
    begin = np.flatnonzero(new)
    return order[begin], np.add.reduceat(weight[order], begin)


FOUND = "w1 long, w2 long, w3 long, w4 long, f long, lang string, word string"


def _words(blobs: list) -> pa.Table:
    """The words of a dictionary shard once each: two of one hash both stay, to be noticed."""
    words = pa.concat_tables([from_blob(b) for b in blobs]).group_by(["h", "lang", "word"]).aggregate([])
    none = pa.nulls(len(words), pa.int64())
    return pa.table([words["h"], none, none, none, none, words["lang"], words["word"]], names=["w1", "w2", "w3", "w4", "f", "lang", "word"])


def _phrases(blobs: list, ranked: np.ndarray, least: int) -> pa.Table:
    parts = [_unpack(b) for b in blobs]
    extra = np.unique(np.concatenate([p[0] for p in parts]))
    for found, numbers, _, _ in parts:
        if len(found):
            odd = numbers > RANKED
            numbers[odd] = (RANKED + 1 + np.searchsorted(extra, found)).astype(np.int32)[numbers[odd] - RANKED - 1]
    keys = np.concatenate([p[1] for p in parts], axis=1)
    weight = np.concatenate([p[2] for p in parts]).astype(np.int64)
    deep = np.concatenate([p[3] for p in parts])
    del parts
    out = [np.zeros((5, 0), np.int64)]

    def emit(d: int, lead: np.ndarray, counts: np.ndarray) -> None:
        row = np.zeros((5, len(lead)), np.int64)
        numbers = keys[:d, lead]
        odd = numbers > RANKED
        row[:d] = ranked.view(np.int64)[np.where(odd, 0, numbers)]
        if odd.any():
            row[:d][odd] = extra.view(np.int64)[numbers[odd] - RANKED - 1]
        row[4] = counts
        out.append(row)

    for d, lead, counts in equal_partitions(keys, weight, least):
        # A phrase shorter than its routing key is spread over shards: see below.
        whole = deep[lead] <= d
        if d > 1:
            emit(d, lead[whole], counts[whole])
    for d in range(2, DEPTH):
        spread = np.flatnonzero((deep > d) & (keys[d - 1] > 0))
        if len(spread):
            lead, counts = _sums(keys[:d, spread], weight[spread])
            emit(d, spread[lead], counts)
    rows = np.concatenate(out, axis=1)
    none = pa.nulls(rows.shape[1], pa.string())
    return pa.table([*[pa.array(r) for r in rows], none, none], names=["w1", "w2", "w3", "w4", "f", "lang", "word"])


def phrase_counts(docs: DataFrame, least: int = 30, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Counts of all words and phrases of up to four words that occur ``least`` times or more per language.

    Returns (totals: lang, n), (words: h, f), (phrases: w1..w4 as hashes, 0 for none, f) and (names:
    h, lang, word). Counts are exact; two words of one hash raise an error.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    counted = cut_lineage(docs.mapInArrow(_count, "h long, n long, lang string").groupBy("h", "lang").agg(F.sum("n").alias("n")).where(
        F.col("h").isNull() | (F.col("n") >= least)), "words")
    totals = counted.where("h IS NULL").select("lang", "n")
    words = counted.where("h IS NOT NULL").select("h", F.col("n").alias("f"))
    tokens = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, -(-tokens // SHARD_SUFFIXES))
    # A pair of words can fill half a shard only if both do.
    known = spark.sparkContext.broadcast(Known(words, tokens // (2 * shards) if shards > 1 else tokens))

    def answer(batches):
        def done(shard: int, blobs: list) -> Iterator[pa.RecordBatch]:
            yield from (_words(blobs) if shard >= shards else _phrases(blobs, known.value.ranked, least)).to_batches()

        shard, blobs = None, []
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if blobs and number != shard:
                    yield from done(shard, blobs)
                    blobs = []
                shard = number
                blobs.append(blob.as_buffer())
        if blobs:
            yield from done(shard, blobs)

    # One partition per shard, so that a task's share stays the same as the corpus grows.
    sent = docs.mapInArrow(lambda it: _send(it, known.value, shards), "shard long, blob binary").repartitionById(
        min(2 * shards, MOST_PARTITIONS), F.expr(f"cast(shard % {MOST_PARTITIONS} AS int)")).sortWithinPartitions("shard")
    found = cut_lineage(sent.mapInArrow(answer, FOUND), "phrases")
    names = found.where("f IS NULL").select(F.col("w1").alias("h"), "lang", "word")
    if not names.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise RuntimeError("two frequent words share a 64-bit hash")
    phrases = found.where("f IS NOT NULL").groupBy("w1", "w2", "w3", "w4").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return totals, words, cut_lineage(phrases, "counts"), names


def _key(words: list[str]) -> list:
    return [F.col(w) for w in words] + [F.lit(0).cast("long")] * (DEPTH - 1 - len(words))


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, cover: int = 80, scale: int = 2_000_000, lang: str = "lang", text: str = "text") -> DataFrame:
    """The best phrases of two to four words of each language.

    Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and at blanks into words; NULL
    texts are empty, a NULL language is ``und``. Phrases stay within a piece and overlaps count. A phrase
    found a >= ``least`` times is scored ``floor(scale * a / (l + r))`` at each cut into a first part found l times and a
    rest found r times; its lowest score counts, at the first such cut. A phrase is dropped if
    a longer phrase that holds it is found in ``cover`` percent of its places or more. Returns each
    language's first ``top`` rows by score, count (both falling) and phrase (bytes, rising): lang, rank, phrase, a, l, r,
    n (words of the language), score. A repeated row counts as often as it stands there; other columns are ignored.
    """
    totals, words, phrases, names = phrase_counts(docs, least, lang, text)
    w = ["w1", "w2", "w3", "w4"]
    size = F.when(F.col("w4") != 0, 4).when(F.col("w3") != 0, 3).otherwise(2)
    phrases = phrases.select(*w, F.col("f").alias("a"), size.alias("size"))
    counts = words.select(F.col("h").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(0).cast("long").alias("k3"), "f").unionByName(
        phrases.where("size < 4").select(F.col("w1").alias("k1"), F.col("w2").alias("k2"), F.col("w3").alias("k3"), F.col("a").alias("f")))

    def part(x: list[str]):
        return F.struct(*[c.alias(f"k{i + 1}") for i, c in enumerate(_key(x))])

    cuts = [F.when(F.col("size") > k, F.struct(F.lit(k).alias("k"), part(w[:k]).alias("first"), F.when(F.col("size") == 2, part(w[k:2])).when(
        F.col("size") == 3, part(w[k:3])).otherwise(part(w[k:4])).alias("rest"))) for k in (1, 2, 3)]
    cut = phrases.select(*w, "a", F.explode(F.filter(F.array(*cuts), lambda x: x.isNotNull())).alias("c"))
    cut = cut.select(*w, "a", "c.k", F.col("c.first.*"), F.col("c.rest").alias("rest"))
    keys = ["k1", "k2", "k3"]
    rest = cut.select("rest.*")
    cut = spread_join(cut, counts.withColumnRenamed("f", "l"), keys).drop(*keys).select(*w, "a", "k", "l", "rest.*")
    cut = spread_join(cut, counts.withColumnRenamed("f", "r"), keys, hot_from=rest).drop(*keys)
    wide = "decimal(20,0)"
    score = F.expr(f"(cast({scale} AS {wide}) * cast(a AS {wide})) div (cast(l AS {wide}) + cast(r AS {wide}))")
    scored = cut.withColumn("score", score).groupBy(*w).agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("best"))

    inner = [F.when((F.col("size") > n) & (F.col("size") >= i + n), F.struct(*[c.alias(f"w{j + 1}") for j, c in enumerate(
        [F.col(x) for x in w[i: i + n]] + [F.lit(0).cast("long")] * (DEPTH - n))])) for n in (2, 3) for i in range(DEPTH - n + 1)]
    held = phrases.where("size > 2").select("a", F.explode(F.filter(F.array(*inner), lambda x: x.isNotNull())).alias("s")).groupBy(
        *[F.col(f"s.{x}").alias(x) for x in w]).agg(F.max("a").alias("longer"))
    kept = cut_lineage(scored.join(held, w, "left").where(F.expr(f"longer IS NULL OR 100BD * longer < {cover}BD * best.a")).select(
        *w, "best.score", "best.a", "best.l", "best.r"), "scored")

    def named(frame: DataFrame, column: str) -> DataFrame:
        found = names.select(F.col("h").alias(column), F.col("word").alias(f"{column}_word"), *([F.col("lang")] if column == "w1" else []))
        return spread_join(frame, found, [column], "inner" if column in ("w1", "w2") else "left", hot_from=kept)

    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    first = named(kept, "w1").withColumn("at", F.rank().over(best)).where(F.col("at") <= top).drop("at")
    for column in w[1:]:
        first = named(first, column)
    full = first.withColumn("phrase", F.concat_ws(" ", *[f"{x}_word" for x in w]))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = full.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
