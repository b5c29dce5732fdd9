"""Packing of tokenised documents into sequences of several lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.tokens import tokenizer

#: Context lengths, powers of two, longest first.
TIERS = (2048, 1024, 512, 256)
BUFFER_TOKENS = 1 << 21
GROUP_TOKENS = 8 * TIERS[0]

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()), T.StructField("tier", T.IntegerType()), T.StructField("step_group", T.LongType()),
    T.StructField("ids", T.BinaryType())])


class _Tiers:
    """What waits to be packed: per tier, (length, document, start) in order of length."""

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers = tiers
        self.waiting: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}

    def route(self, parts: list[tuple[int, int, int]]) -> None:
        for part in parts:
            self.waiting[min(t for t in self.tiers if t >= part[0])].append(part)
        for t in self.tiers:
            self.waiting[t].sort()

    def _fill(self, gap: int, shorter: tuple[int, ...]) -> list[tuple[int, int, int]]:
        """Parts for a gap: the longest that fit, then the shortest one left cut to what remains."""
        out = []
        while gap:
            for t in shorter:
                parts = self.waiting[t]
                at = bisect_right(parts, (gap, 1 << 62, 0)) - 1
                if at >= 0:
                    out.append(parts.pop(at))
                    gap -= out[-1][0]
                    break
            else:
                for t in reversed(shorter):
                    if self.waiting[t]:
                        length, doc, start = self.waiting[t].pop(0)
                        out.append((gap, doc, start))
                        self.route([(length - gap, doc, start + gap)])
                        gap = 0
                        break
                else:
                    break
        return out

    def pack(self, last: bool) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """Sequences that are full, tier by tier. What can't fill a window of its tier moves to the
        next shorter one, cut where need be; at the end, to shorter and shorter powers of two."""
        for i, tier in enumerate(self.tiers):
            shorter = self.tiers[i + 1:]
            below = sum(p[0] for t in shorter for p in self.waiting[t])
            while self.waiting[tier]:
                here = self.waiting[tier]
                if below + sum(p[0] for p in here[: 2 * tier]) < tier:
                    break
                first = here.pop()
                gap = tier - first[0]
                # A window of the shortest tiers holds several parts of its own tier.
                before = sum(p[0] for t in shorter for p in self.waiting[t]) if below < 4 * tier else None
                filled = self._fill(gap, (tier, *shorter) if not shorter or below < gap else shorter)
                yield tier, [first, *filled]
                below = max(0, below - gap) if before is None else sum(p[0] for t in shorter for p in self.waiting[t])
            rest, self.waiting[tier] = self.waiting[tier], []
            if not shorter:
                if not last:
                    self.waiting[tier] = rest
                    return
                yield from self._tail(rest, tier // 2)
            else:
                self.route([(min(shorter[0], length - at), doc, start + at) for length, doc, start in rest for at in range(0, length, shorter[0])])

    @staticmethod
    def _tail(parts: list[tuple[int, int, int]], tier: int) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        left = sum(p[0] for p in parts)
        while left:
            while tier > left:
                tier //= 2
            taken, need = [], tier
            while need:
                length, doc, start = parts.pop()
                take = min(length, need)
                taken.append((take, doc, start))
                if take < length:
                    parts.append((length - take, doc, start + take))
                need -= take
            left -= tier
            yield tier, taken


def _pack(batches, path: str, end_id: int, tiers: tuple[int, ...], buffer: int):
    task = TaskContext.get().partitionId() << 32
    encoder = tokenizer(path)
    ids: dict[int, np.ndarray] = {}
    names: dict[int, int | None] = {}
    pool, count, held = _Tiers(tiers), 0, 0
    sequence = group = room = 0

    def flush(last: bool):
        nonlocal sequence, group, room
        rows = []
        # Longest first: lengths are powers of two, so groups fill exactly within a flush; the next one's
        # long sequences may close its last group short.
        for tier, parts in pool.pack(last):
            if room + tier > GROUP_TOKENS:
                group, room = group + 1, 0
            room += tier
            at = 0
            for length, doc, start in parts:
                raw = ids[doc][start: start + length].tobytes()
                rows.append((names[doc], start, length, zlib.crc32(raw), len(ids[doc]), task + sequence, at, tier, task + group, raw))
                at += length
            sequence += 1
        waiting = {p[1] for parts in pool.waiting.values() for p in parts}
        for doc in [d for d in ids if d not in waiting]:
            del ids[doc], names[doc]
        for a in range(0, len(rows), 4000):
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[a: a + 4000]], t) for i, t in enumerate(
                [pa.int64()] * 7 + [pa.int32(), pa.int64(), pa.binary()])], names=PIECES.names)

    for batch in batches:
        texts = batch.column(1)
        for row, name in enumerate(batch.column(0).to_pylist()):
            tokens = np.append(encoder.encode(texts[row].as_py() or ""), np.uint32(end_id)).astype("<u4")
            ids[count], names[count] = tokens, name
            whole = len(tokens) // tiers[0] * tiers[0]
            pool.waiting[tiers[0]] += [(tiers[0], count, at) for at in range(0, whole, tiers[0])]
            if whole < len(tokens):
                size = len(tokens) - whole
                pool.waiting[min(t for t in tiers if t >= size)].append((size, count, whole))
            count, held = count + 1, held + len(tokens)
            if held >= buffer:
                pool.route([])
                yield from flush(False)
                held = 0
    pool.route([])
    yield from flush(True)


def pack_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 1,
                   tiers: tuple[int, ...] = TIERS, buffer: int = BUFFER_TOKENS) -> DataFrame:
    """Pack documents into full sequences of the lengths of ``tiers``.

    A document is its ids under the tokenizer file ``path`` and then ``end_id``. Whole windows of
    the longest tier are cut off long documents; what is left, like each short document, goes to the
    shortest tier that holds it. Each tier is packed longest part first, the gap that a part leaves
    in its window is filled by the longest parts of shorter tiers that fit, and the last gap by a
    part cut to size. Every task packs its own documents, ``buffer`` tokens at a time, and moves
    nothing; what doesn't fill the shortest window waits for the next buffer, and at a task's end
    becomes sequences of smaller powers of two, so that no sequence needs padding. Sequences follow
    each other in groups of equal token numbers (step_group); the last group of each buffer and of each
    task may be shorter.

    Returns one row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, tier (length of the sequence), step_group and ids (little-endian, 32 bits).
    A NULL or empty text is the end id alone; a NULL id stays NULL. Rows that share an id are packed
    each on its own. Ids of sequences hold the task's number, so the input should be a table (a
    task that runs again reads the same rows).
    """
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        lambda batches: _pack(batches, path, end_id, tiers, buffer), PIECES)


def packed_digests(docs: DataFrame, path: str) -> DataFrame:
    return pack_documents(docs, path).drop("ids")
