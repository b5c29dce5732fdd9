"""Array code for blocks of texts: words, lines, hashes and bit codes. Everything here works on one
block of UTF-8 bytes that holds many documents, so that no Python runs per word."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash

U64 = np.uint64
#: Separators of words: \x20 and \x09-\x0D.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[list(BLANKS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240501).integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_CHUNK = 1 << 19


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    with np.errstate(over="ignore"):
        up = np.full(n, U64(base), np.uint64)
        up[0] = 1
        down = np.full(n, U64(pow(base, -1, 2**64)), np.uint64)
        down[0] = 1
        return np.cumprod(up), np.cumprod(down)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(10, (n - 1).bit_length())
    up, down = _powers(base, size)
    return up[:n], down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of a 64-bit hash over all others."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def buffer(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and where each begins (one more at the end). NULL is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if isinstance(texts, pa.ChunkedArray):  # no chunk at all
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    texts = texts.fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0]: offs[-1]], offs - offs[0]


def blocks(offs: np.ndarray, limit: int = _CHUNK):
    """Ranges of documents that hold at most ``limit`` bytes together (or one longer document)."""
    n, a = len(offs) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, side="right")) - 1)
        yield a, b
        a = b


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    out = np.zeros(len(buf) + 1, np.uint64)
    if len(buf):
        up, _ = powers(_BASE, len(buf))
        np.cumsum(_BYTE[buf] * up, out=out[1:])
    return out


def slice_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes from start to end, the same wherever they stand."""
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    _, down = powers(_BASE, len(prefix))
    h = (prefix[end] - prefix[start]) * down[start]
    return mix(h + (end - start).astype(np.uint64) * U64(0x2545F4914F6CDD1D))


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of many texts: byte range, document and hash of each."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, lower: bool = False, hashes: bool = True):
        if lower:
            buf = _LOWER[buf]
        self.buf, self.offs = buf, offs
        parts = [self._block(buf[offs[a]: offs[b]], offs[a: b + 1] - offs[a], hashes) for a, b in blocks(offs, _CHUNK)]
        shifts = [offs[a] for a, _ in blocks(offs, _CHUNK)]
        none = np.zeros(0, np.int64)
        self.start = np.concatenate([none, *[p[0] + s for p, s in zip(parts, shifts)]])
        self.end = np.concatenate([none, *[p[1] + s for p, s in zip(parts, shifts)]])
        self.hash = np.concatenate([none.astype(np.uint64), *[p[2] for p in parts]])
        self.doc = np.searchsorted(offs, self.start, side="right") - 1
        #: Index of the first word of each document, and one more at the end.
        self.first = np.searchsorted(self.start, offs, side="left")

    @staticmethod
    def _block(buf: np.ndarray, offs: np.ndarray, hashes: bool):
        solid = ~_IS_BLANK[buf]
        n = len(buf)
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        before = np.zeros(n, bool)
        before[1:] = solid[:-1]
        after = np.zeros(n, bool)
        after[:-1] = solid[1:]
        start = np.flatnonzero(solid & (~before | edge[:-1]))
        end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        return start, end, slice_hash(prefix_hash(buf), start, end) if hashes else np.zeros(0, np.uint64)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def joined(self, keep: np.ndarray | None = None) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Kept words, each followed by one space: the bytes, where each kept word begins (one more
        at the end), and the index of the first kept word of each document (one more at the end)."""
        start, end, doc = self.start, self.end, self.doc
        if keep is not None:
            start, end, doc = start[keep], end[keep], doc[keep]
        at = np.zeros(len(start) + 1, np.int64)
        np.cumsum(end - start + 1, out=at[1:])
        out = np.empty(int(at[-1]), np.uint8)
        padded = np.append(self.buf, np.uint8(32))
        for a in range(0, len(start), 1 << 17):
            b = min(len(start), a + (1 << 17))
            sizes = end[a:b] - start[a:b] + 1
            out[at[a]: at[b]] = padded[np.arange(at[a], at[b]) + np.repeat(start[a:b] - at[a:b], sizes)]
        out[at[1:] - 1] = 32
        return out.tobytes(), at, np.searchsorted(doc, np.arange(len(self.offs)))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word of each window of ``size`` words of one document, and its hash."""
        n = len(self.start) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:n] == self.doc[size - 1: size - 1 + n])
        return at, self.run_hash(at, size)

    def run_hash(self, at: np.ndarray, size) -> np.ndarray:
        up, down = powers(_WORD_BASE, len(self.hash))
        pre = np.zeros(len(self.hash) + 1, np.uint64)
        np.cumsum(self.hash * up, out=pre[1:])
        return mix((pre[at + size] - pre[at]) * down[at] + np.asarray(size).astype(np.uint64))


def digests(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit digests of slices, as two numbers each."""
    view, digest = memoryview(data), xxhash.xxh3_128_digest
    raw = b"".join([digest(view[a:b]) for a, b in zip(start.tolist(), end.tolist())])
    return np.frombuffer(raw, np.uint64).reshape(-1, 2)


def order_ids(column: pa.ChunkedArray) -> np.ndarray:
    """Document ids as numbers that order them; NULL comes last."""
    return pa.compute.fill_null(column.combine_chunks().cast(pa.int64()), 2**63 - 1).to_numpy(zero_copy_only=False).astype(np.int64)


def with_columns(table: pa.Table, new: dict[str, pa.Array]) -> list[pa.RecordBatch]:
    """The table with columns replaced or added, as record batches."""
    for name, values in new.items():
        at = table.schema.get_field_index(name)
        table = table.append_column(name, values) if at < 0 else table.set_column(at, name, values)
    return table.combine_chunks().to_batches()


def code_points(buf: np.ndarray) -> np.ndarray:
    """Code points before each byte (one more at the end)."""
    out = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=out[1:])
    return out


def pack_sorted(values: np.ndarray, base: int, span: int) -> tuple[int, bytes, bytes]:
    """Rice code of strictly rising numbers in [base, base + span): gaps split into low bits, kept
    as they are (eight of them as a byte), and high bits in unary. About 2 bits more than log2 of the
    mean gap per number."""
    n = len(values)
    gaps = np.diff(values.astype(np.int64), prepend=np.int64(base) - 1) - 1
    low = max(0, int(np.log2(max(1.0, 0.69 * span / n))))
    high = gaps >> low
    ends = np.cumsum(high + 1)
    unary = np.zeros(int(ends[-1]), np.uint8)
    unary[ends - 1] = 1
    whole, rest = divmod(low, 8)
    parts = [(gaps >> 8 * j).astype(np.uint8).tobytes() for j in range(whole)]
    bits = np.empty((n, rest), np.uint8)
    for j in range(rest):
        bits[:, j] = (gaps >> 8 * whole + j) & 1
    return low, np.packbits(unary).tobytes(), b"".join([*parts, np.packbits(bits).tobytes()])


def unpack_sorted(n: int, base: int, low: int, unary: bytes, lows: bytes) -> np.ndarray:
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    gaps = (np.diff(ones, prepend=-1) - 1).astype(np.int64) << low
    whole, rest = divmod(low, 8)
    raw = np.frombuffer(lows, np.uint8)
    for j in range(whole):
        gaps |= raw[j * n: (j + 1) * n].astype(np.int64) << 8 * j
    if rest:
        bits = np.unpackbits(raw[whole * n:])[: n * rest].reshape(n, rest)
        for j in range(rest):
            gaps |= bits[:, j].astype(np.int64) << 8 * whole + j
    return np.cumsum(gaps + 1) - 1 + base


def pack_flags(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unpack_flags(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8))[:n].astype(bool)


def to_planes(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of a matrix of numbers, row by row and place by place: bytes of one
    place are much alike, so they take little once Spark compresses them."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(*values.shape, values.itemsize)
    return raw[:, :, :width].transpose(0, 2, 1).tobytes()


def from_planes(raw, shape: tuple[int, int], width: int, dtype) -> np.ndarray:
    out = np.zeros((*shape, np.dtype(dtype).itemsize), np.uint8)
    out[:, :, :width] = np.frombuffer(raw, np.uint8).reshape(shape[0], width, shape[1]).transpose(0, 2, 1)
    return out.view(dtype).reshape(shape)
