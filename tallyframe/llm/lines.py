"""Line deduplication with two Bloom filters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import exchange as ex
from tallyframe.llm.batches import mix, order_ids, with_columns
from tallyframe.llm.frames import restore, set_aside

STRIPPED = b" \t\n\x0b\x0c\r"
BITS_PER_LINE, PROBES = 12, 5


def _key(line: bytes, least: int) -> bytes | None:
    key = line.strip(STRIPPED).lower()  # bytes.lower() changes A-Z alone
    if len(key) < least or len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least:
        return None
    return key


class _Lines:
    """Lines of the texts of one piece, and the digests of their keys."""

    def __init__(self, table: pa.Table, text: str, least: int):
        digest = xxhash.xxh3_128_digest
        self.texts, found, docs, numbers = [], [], [], []
        for row, value in enumerate(table[text].cast(pa.binary()).to_pylist()):
            lines = (value or b"").split(b"\n")
            self.texts.append(lines)
            for number, line in enumerate(lines):
                if (key := _key(line, least)) is not None:
                    found.append(digest(key))
                    docs.append(row)
                    numbers.append(number)
        self.digest = np.frombuffer(b"".join(found), np.uint64).reshape(-1, 2)
        self.row, self.number = np.array(docs, np.int64), np.array(numbers, np.int64)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct digests, and for each line the index of its digest among them."""
        order = np.lexsort((self.digest[:, 1], self.digest[:, 0]))
        d = self.digest[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]).any(axis=1)
        back = np.empty(len(d), np.int64)
        back[order] = np.cumsum(new) - 1
        return d[new], back


def _probes(cells: np.ndarray, size: int) -> np.ndarray:
    h = mix(cells.astype(np.uint64) + np.uint64(0x1234567))
    step = mix(h) | np.uint64(1)
    return ((h[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(size)).astype(np.int64)


def _bloom(cells: list[np.ndarray]) -> list[np.ndarray]:
    """One filter takes every hash; the second takes those that the first has already. Each piece
    sends a hash once, so what is in the second filter was in two pieces (or collides)."""
    size = max(64, BITS_PER_LINE * sum(map(len, cells)))
    once, twice = np.zeros(size, bool), np.zeros(size, bool)
    for c in cells:
        at = _probes(c, size)
        twice[at[once[at].all(axis=1)]] = True
        once[at] = True
    return [twice[_probes(c, size)].all(axis=1) for c in cells]


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 10) -> DataFrame:
    """Keep each repeated line only in the smallest document that holds it.

    A line's key is the line without blanks at its ends, A-Z lower-cased. Keys of at least
    ``least`` code points that two documents hold lose their lines in all documents but the one
    with the smallest id, where every copy stays. Returns the columns of docs with ``text``
    shortened, and n_lines (before) and n_dropped, which take the place of columns so named.

    Every piece of the corpus sends the hashes of its lines to Bloom filters, one for hashes seen
    and one for hashes seen again, spread over shards by hash. Only lines that the second filter
    knows are sent on, by a 128-bit digest with the smallest id of the piece.

    A NULL or empty text is one empty line and comes back as an empty text. Rows that share an id
    are one document. NULL ids count as one document after all others. An empty table gives none.
    """
    schema = ex.output_schema(docs, {text: ex.TEXT, "n_lines": ex.LONG, "n_dropped": ex.LONG})
    pieces = ex.write_pieces(docs, text)
    read = lambda table: _Lines(table, text, least)
    lines = ex.total(pieces, lambda table: pa.compute.sum(pa.compute.count_substring(table[text], "\n")).as_py() or 0) + 1
    layout = ex.Cells(lines, 256)
    seen = ex.suspects(pieces, layout, lambda table: read(table).digest[:, 0], _bloom)
    shards = ex.exact_shards(lines, 16)

    def firsts(table: pa.Table, answers: dict):
        """The piece's distinct digests, which of them to send, and their smallest ids here."""
        found = read(table)
        digest, back = found.distinct()
        ids = order_ids(table[doc_id])[found.row] if len(found.row) else np.zeros(0, np.int64)
        least_id = np.full(len(digest), 2**63 - 1, np.int64)
        np.minimum.at(least_id, back, ids)
        return found, digest, back, ids, least_id, layout.flags(digest[:, 0], answers)[0]

    def send(piece, table, answers):
        _, digest, _, _, least_id, sent = firsts(table, answers[0])
        yield from ex.exact_rows(piece, digest[sent], least_id[sent][:, None], shards)

    later = ex.exact(ex.with_answers(pieces, [seen], send, ex.ITEMS_SCHEMA), 1)

    def finish(piece, table, answers):
        found, digest, back, ids, least_id, sent = firsts(table, answers[0])
        elsewhere = np.zeros(len(digest), bool)
        elsewhere[sent] = ex.comes_later(digest[sent], shards, answers[1])
        drop = elsewhere[back] | (ids != least_id[back])
        n_lines = np.array([len(x) for x in found.texts], np.int64)
        n_dropped = np.bincount(found.row[drop], minlength=len(n_lines)).astype(np.int64)
        gone: dict[int, set[int]] = {}
        for row, number in zip(found.row[drop].tolist(), found.number[drop].tolist()):
            gone.setdefault(row, set()).add(number)
        for row, numbers in gone.items():
            found.texts[row] = [x for i, x in enumerate(found.texts[row]) if i not in numbers]
        kept = pa.array([b"\n".join(x) for x in found.texts], pa.binary()).cast(pa.string())
        yield from with_columns(table, {text: kept, "n_lines": pa.array(n_lines), "n_dropped": pa.array(n_dropped)})

    return ex.with_answers(pieces, [seen, later], finish, schema)


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with its columns and every text without the lines that ``dedup_lines`` drops."""
    return restore(dedup_lines(set_aside(docs, text, [doc_id]), doc_id, text), docs.columns, text)


def line_digests(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
