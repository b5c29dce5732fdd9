"""A model of code points whose four-grams grow with the corpus, learnt on the other half of it.

Texts are dealt into two halves by a hash of their bytes; the model of each half judges the texts of the
other, so that no text is judged by what it taught itself. Four-grams are counted by Spark, hash
partitioned, after each piece has added up its own. Modified Kneser-Ney values of both halves are joins
of the tables of four-, three- and two-grams with their contexts; none is gathered or broadcast by hand.
Each piece gets back two logarithms per distinct four-gram of its own: it sends its four-grams, coded, to
the shards that a hash of the four-gram names, and each shard answers from the values of its own ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.common import cut_lineage
from tallyframe.llm import exchange as ex
from tallyframe.llm.batches import buffer, from_planes, to_planes

ORDER = 4
#: Bits that hold any code point; a half of a four-gram is two of them.
POINT = 21
HALVES = (0, 1)
#: Least discount: something is left for what the other half lacks.
LEAST = 0.1
#: Most four-grams of one row that a piece sends.
PART = 1 << 18
#: A prime and a factor below it: four-grams are dealt over shards by products within 62 bits.
PRIME, FACTOR = (1 << 31) - 1, 1_640_531_527
_SENT = "piece long, part long, n int, points binary, counts binary"
SENT_TYPES = [("piece", pa.int64()), ("part", pa.int64()), ("n", pa.int32()), ("points", pa.binary()), ("counts", pa.binary())]
_DEALT = "shard long, piece long, part long, n int, points binary"
DEALT_TYPES = [("shard", pa.int64()), *SENT_TYPES[:4]]


def code_points_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and where each text begins (one more at the end)."""
    start = (buf & 0xC0) != 0x80
    start[offs[:-1][offs[:-1] < len(buf)]] = True
    at = np.flatnonzero(start)
    width = np.minimum(np.diff(at, append=len(buf)), 4)
    points = buf[at].astype(np.int64)
    for w in (2, 3, 4):
        pick = np.flatnonzero(width == w)
        value = points[pick] & (0x7F >> w)
        for j in range(1, w):
            value = value << 6 | buf[at[pick] + j] & 0x3F
        points[pick] = value
    return points, np.searchsorted(at, offs)


class Grams:
    """The distinct four-grams of a table's texts in rising order, and where they stand."""

    def __init__(self, table: pa.Table, text: str):
        buf, offs = buffer(table[text])
        points, first = code_points_of(buf, offs)
        sizes = np.diff(first)
        data = buf.tobytes()
        self.half = np.array([zlib.crc32(data[a:b]) & 1 for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())], np.int8)
        self.scored = np.maximum(sizes - ORDER + 1, 0)
        self.doc = np.repeat(np.arange(len(sizes)), self.scored)
        at = np.arange(len(self.doc)) + np.repeat(first[:-1] - (np.cumsum(self.scored) - self.scored), self.scored)
        present = np.zeros(1 << POINT, bool)
        present[points] = True
        known = np.flatnonzero(present)
        if len(known) <= 1 << 16:
            local = (np.cumsum(present) - 1)[points].astype(np.uint64)
            self.code = local[at] << np.uint64(48) | local[at + 1] << np.uint64(32) | local[at + 2] << np.uint64(16) | local[at + 3]
        else:
            pairs, back = np.unique(points[:-1] << POINT | points[1:], return_inverse=True)
            back = back.astype(np.uint64)
            self.code = back[at] << np.uint64(32) | back[at + 2]
        self.known, count = np.unique(self.code, return_counts=True)
        left, right = (self.known >> np.uint64(32)).astype(np.int64), (self.known & np.uint64(0xFFFFFFFF)).astype(np.int64)
        if len(known) <= 1 << 16:
            self.hi, self.lo = (known[x >> 16] << POINT | known[x & 0xFFFF] for x in (left, right))
        else:
            self.hi, self.lo = pairs[left], pairs[right]
        mine, times = np.unique(self.code[self.half[self.doc] == 1], return_counts=True)
        ones = np.zeros(len(self.known), np.int64)
        ones[np.searchsorted(self.known, mine)] = times
        self.counts = (count - ones, ones)

    def log_perplexity(self, values: np.ndarray) -> np.ndarray:
        """values: (2, distinct four-grams), the logarithms of both halves' models."""
        where = np.searchsorted(self.known, self.code)
        lp = np.where(self.half[self.doc] == 0, values[1][where], values[0][where])
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(self.scored > 0, -np.bincount(self.doc, lp, minlength=len(self.scored)) / self.scored, np.nan)


def _coded(hi: np.ndarray, lo: np.ndarray) -> bytes:
    mask = (1 << POINT) - 1
    return to_planes(np.stack([hi >> POINT, hi & mask, lo >> POINT, lo & mask]).astype(np.uint32), 3)


def _halves(raw, n: int) -> tuple[np.ndarray, np.ndarray]:
    a, b, c, d = from_planes(raw, (4, n), 3, np.uint32).astype(np.int64)
    return a << POINT | b, c << POINT | d


def _sent(pieces: DataFrame, text: str) -> DataFrame:
    """The distinct four-grams of each piece in rising order, coded, and how often each half has them."""

    def send(piece: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        g = Grams(table, text)
        for part, a in enumerate(range(0, len(g.known), PART)):
            hi, lo, counts = g.hi[a: a + PART], g.lo[a: a + PART], np.stack([n[a: a + PART] for n in g.counts])
            yield ex._batch([(piece, part, len(hi), _coded(hi, lo), to_planes(counts.astype(np.uint32), 4))], SENT_TYPES)

    return ex.each_piece(pieces, send, _SENT)


def _counted(sent: DataFrame) -> DataFrame:
    """(hi, lo, n0, n1): what all pieces sent, added up."""

    def decode(batches):
        for batch in batches:
            for n, points, counts in zip(*(batch.column(i) for i in range(3))):
                columns = [*_halves(points.as_buffer(), n.as_py()), *from_planes(counts.as_buffer(), (2, n.as_py()), 4, np.uint32).astype(np.int64)]
                for a in range(0, n.as_py(), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(x[a: a + (1 << 16)]) for x in columns], names=["hi", "lo", "n0", "n1"])

    rows = sent.select("n", "points", "counts").mapInArrow(decode, "hi long, lo long, n0 long, n1 long")
    return rows.groupBy("hi", "lo").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _shard(hi, lo, shards: int):
    """The shard of four-grams, of arrays and of columns alike."""
    return (hi % PRIME * FACTOR + lo) % PRIME % shards


def _dealing(hi: np.ndarray, lo: np.ndarray, shards: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of four-grams by shard, and the range of each shard in that order."""
    shard = _shard(hi, lo, shards)
    order = np.argsort(shard, kind="stable")
    found, begin = np.unique(shard[order], return_index=True)
    return order, list(zip(found.tolist(), begin.tolist(), [*begin[1:].tolist(), len(order)]))


def _dealt(sent: DataFrame, shards: int) -> DataFrame:
    def deal(batches):
        for batch in batches:
            for piece, part, n, points in zip(*(batch.column(i) for i in range(4))):
                hi, lo = _halves(points.as_buffer(), n.as_py())
                order, ranges = _dealing(hi, lo, shards)
                hi, lo = hi[order], lo[order]
                yield ex._batch([(s, piece.as_py(), part.as_py(), b - a, _coded(hi[a:b], lo[a:b])) for s, a, b in ranges], DEALT_TYPES)

    return sent.select("piece", "part", "n", "points").mapInArrow(deal, _DEALT)


def _off(n: str, discounts: dict) -> Column:
    d1, d2, d3 = (F.lit(x) for x in discounts[n])
    return F.when(F.col(n) == 0, F.lit(0.0)).when(F.col(n) == 1, d1).when(F.col(n) == 2, d2).otherwise(d3)


def _discounts(grams: DataFrame) -> dict[str, list[float]]:
    """The three discounts of an order, for each half, from its counts of counts."""
    row = grams.agg(*[F.count(F.when(F.col(f"n{h}") == i, 1)).alias(f"t{h}_{i}") for h in HALVES for i in (1, 2, 3, 4)]).first()
    out = {}
    for h in HALVES:
        t = [row[f"t{h}_{i}"] for i in (1, 2, 3, 4)]
        y = t[0] / (t[0] + 2 * t[1]) if t[0] + t[1] else 0.5
        out[f"n{h}"] = [min(i, max(LEAST, i - (i + 1) * y * t[i] / t[i - 1])) if t[i - 1] else 0.5 for i in (1, 2, 3)]
    return out


def _values(grams: DataFrame) -> DataFrame:
    """(hi, lo, p0, p1): the probability of the last code point after the three before it, by the model of
    each half, from the counts (hi, lo, n0, n1) of the distinct four-grams of both."""
    mask = (1 << POINT) - 1
    first, last = lambda c: F.shiftright(c, POINT), lambda c: F.col(c).bitwiseAND(mask)
    # A table per order: its context, and the shorter gram that it ends in. Lower orders count the
    # distinct code points before a gram.
    tables = {4: grams.select("hi", "lo", "n0", "n1", F.shiftright("lo", POINT).alias("c1"), last("hi").alias("s1"))}
    distinct = [F.count(F.when(F.col(f"n{h}") > 0, 1)).alias(f"n{h}") for h in HALVES]
    keys = {4: ["hi", "c1"], 3: ["s1", "c1"], 2: ["c1"], 1: []}
    tables[3] = cut_lineage(tables[4].groupBy("s1", "lo", "c1").agg(*distinct), "grams")
    tables[2] = cut_lineage(tables[3].groupBy("lo", "c1").agg(*distinct), "grams")
    tables[1] = cut_lineage(tables[2].groupBy(last("lo").alias("d1")).agg(*distinct), "grams")
    lower = None
    for order in (1, 2, 3, 4):
        table = tables[order]
        discounts = _discounts(table)
        sums = [f(F.col(f"n{h}")).alias(f"{k}{h}") for h in HALVES for k, f in
                (("total", lambda c: F.sum(c)), ("left", lambda c, h=h: F.sum(_off(f"n{h}", discounts))))]
        contexts = table.groupBy(*keys[order]).agg(*sums)
        if order == 1:
            frame = table.crossJoin(F.broadcast(contexts)).withColumns({f"p{h}": F.lit(1.0 / (1 << POINT)) for h in HALVES})
        else:
            short = {2: ["d1"], 3: ["lo"], 4: ["s1", "lo"]}[order]
            frame = (table.withColumn("d1", last("lo")) if order == 2 else table).join(contexts, keys[order]).join(lower, short)
        own = {f"p{h}": F.when(F.coalesce(f"total{h}", F.lit(0)) > 0, (F.col(f"n{h}") - _off(f"n{h}", discounts) + F.col(f"left{h}") * F.col(f"p{h}")) / F.col(f"total{h}"))
               .otherwise(F.col(f"p{h}")) for h in HALVES}
        names = {1: ["d1"], 2: ["lo"], 3: ["s1", "lo"], 4: ["hi", "lo"]}[order]
        lower = frame.select(*names, *[v.alias(k) for k, v in own.items()])
        if order < 4:
            lower = cut_lineage(lower, "grams")
    return lower


def _answer(shards: int):
    def answer(dealt: pa.Table, values: pa.Table) -> pa.Table:
        hi, lo = (values[c].to_numpy() for c in ("hi", "lo"))
        order = np.lexsort((lo, hi))
        hi, lo = hi[order], lo[order]
        logs = np.log(np.stack([values[f"p{h}"].to_numpy()[order] for h in HALVES])).astype(np.float32)
        firsts, lasts = np.unique(hi), np.unique(lo)
        place = lambda hi, lo: np.searchsorted(firsts, hi) * len(lasts) + np.searchsorted(lasts, lo)
        known, out = place(hi, lo), []
        for shard, piece, part, n, points in zip(*(dealt[c] for c in ("shard", "piece", "part", "n", "points"))):
            own = _halves(points.as_buffer(), n.as_py())
            at = np.minimum(np.searchsorted(known, place(*own)), len(known) - 1)
            if len(known) == 0 or (hi[at] != own[0]).any() or (lo[at] != own[1]).any():
                raise RuntimeError("a shard lacks a four-gram that was sent to it")
            out.append((piece.as_py(), part.as_py() * shards + shard.as_py(), n.as_py(), to_planes(logs[:, at], 4)))
        return pa.Table.from_batches([ex._batch(out, ex.BITS_TYPES)])

    return answer


def answers(pieces: DataFrame, text: str) -> tuple[DataFrame, int]:
    """For each piece the logarithms of both models for its distinct four-grams, by part and shard, and
    the number of shards."""
    sent = cut_lineage(_sent(pieces, text), "grams", **ex.BLOBS)
    shards = ex.exact_shards(sent.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], 16)
    grams = cut_lineage(_counted(sent), "grams")
    values = _values(grams).withColumn("shard", _shard(F.col("hi"), F.col("lo"), shards))
    return _dealt(sent, shards).groupBy("shard").cogroup(values.groupBy("shard")).applyInArrow(_answer(shards), ex.BITS_SCHEMA), shards


def held_out(table: pa.Table, text: str, found: dict, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """log_perplexity of a piece's texts, NaN for those under four code points, and their four-grams."""
    grams = Grams(table, text)
    values = np.empty((len(HALVES), len(grams.known)), np.float32)
    for part, first in enumerate(range(0, len(grams.known), PART)):
        order, ranges = _dealing(grams.hi[first: first + PART], grams.lo[first: first + PART], shards)
        for s, a, b in ranges:
            n, raw = found.get(part * shards + s, (0, b""))
            if n != b - a:
                raise RuntimeError("an answer doesn't fit its piece")
            values[:, first + order[a:b]] = from_planes(raw, (len(HALVES), n), 4, np.float32)
    return grams.log_perplexity(values), grams.scored
