"""Removal of repeated runs of words behind a count-min sketch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import exchange as ex
from tallyframe.llm.batches import Words, buffer, digests, mix, order_ids, with_columns

#: Count-min sketch of a shard: rows, and cells of a row for each window sent to it.
ROWS, WIDTH = 2, 8
#: Resolution of the hashes that a piece sends: values for each window of the corpus.
VALUES = 64
_NEAR = 20


def _count_min(cells: list[np.ndarray]) -> list[np.ndarray]:
    """Merge what all pieces sent into one count-min sketch: a cell counts the pieces with a window in
    it, up to 255, and the estimate of a window is the least of its cells over the rows."""
    width = 1 << max(10, int(WIDTH * sum(map(len, cells))).bit_length())
    counts = np.zeros((ROWS, width), np.uint8)
    at = [[(mix(c.astype(np.uint64) + np.uint64(r + 1)) & np.uint64(width - 1)).astype(np.int64) for c in cells] for r in range(ROWS)]
    for row, places in zip(counts, at):
        for p in places:
            row[p] = np.minimum(row[p], 254) + 1
    return [np.minimum.reduce([counts[r][at[r][i]] for r in range(ROWS)]) >= 2 for i in range(len(cells))]


def _local(table: pa.Table, doc_id: str, text: str, size: int, layout: ex.Cells, answers: dict):
    """Windows of the piece that repeat or may repeat, in order of their digests: word index, digest,
    begin of each run of equal ones, the least order key of a run, whether a window comes later than
    that in this piece, and whether the sketch suspects a run."""
    words = Words(*buffer(table[text]))
    at, hashes = words.windows(size)
    cells = layout.of(hashes)
    ordered = np.sort(cells)
    new = np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)]
    known = ordered[new]
    elsewhere = layout.answers(known, answers)[0]
    again = np.diff(np.append(np.flatnonzero(new), len(ordered))) > 1
    wanted, sketched = known[elsewhere | again], elsewhere[elsewhere | again]
    # A table of leading bits leaves few windows to look up.
    near = np.zeros(1 << _NEAR, bool)
    near[wanted & (1 << _NEAR) - 1] = True
    chosen = np.flatnonzero(near[cells & (1 << _NEAR) - 1])
    place = np.minimum(np.searchsorted(wanted, cells[chosen]), max(0, len(wanted) - 1))
    hit = wanted[place] == cells[chosen] if len(wanted) else np.zeros(0, bool)
    chosen, place = chosen[hit], place[hit]
    at, suspected = at[chosen], sketched[place]
    data, begin, _ = words.joined()
    digest = digests(data, begin[at], begin[at + size] - 1)
    ids, doc = order_ids(table[doc_id]), words.doc[at]
    named, rank = np.unique(ids, return_inverse=True)
    key = (rank[doc].astype(np.int64) << 40) + (at - words.first[doc])
    order = np.lexsort((digest[:, 1], digest[:, 0]))
    d, key, at = digest[order], key[order], at[order]
    fresh = np.append(True, (d[1:] != d[:-1]).any(axis=1))[: len(d)]
    runs = np.flatnonzero(fresh)
    least = np.minimum.reduceat(key, runs) if len(runs) else key
    run_of = np.cumsum(fresh) - 1
    first_key = np.stack([named[least >> 40], least & (1 << 40) - 1], axis=1) if len(runs) else np.zeros((0, 2), np.int64)
    return words, at, d[runs], run_of, first_key, key != least[run_of], suspected[order][runs]


def remove_repeated_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 20) -> DataFrame:
    """Remove every word that a window of ``size`` words covers whose words also start earlier.

    Earlier means in a document with a smaller id, or in the same one before; windows are those of
    the input, none crosses documents. Returns the columns of docs with ``text`` as the kept words
    joined by one space, and n_words (before) and n_removed, which take the place of such columns.

    Pieces send the sorted hashes of all their windows, each once, and shards of the hash range merge them
    into count-min sketches. Estimates are never too small, so a window with an estimate of one is unique. The second
    pass groups the others by 128-bit digests of their words, each piece sending its first
    occurrence of each.

    NULL texts have no words and come back empty. Rows that share an id compare by position alone,
    so a run at the same place of two such rows stays in both. NULL ids come after all others.
    """
    schema = ex.output_schema(docs, {text: ex.TEXT, "n_words": ex.LONG, "n_removed": ex.LONG})
    pieces = ex.write_pieces(docs, text)
    n_words = ex.total(pieces, lambda table: len(Words(*buffer(table[text]), hashes=False)))
    layout = ex.Cells(n_words, VALUES)
    seen = ex.suspects(pieces, layout, lambda table: Words(*buffer(table[text])).windows(size)[1], _count_min)
    shards = ex.exact_shards(n_words, 16)

    def send(piece, table, answers):
        _, _, digest, _, first_key, _, suspected = _local(table, doc_id, text, size, layout, answers[0])
        yield from ex.exact_rows(piece, digest[suspected], first_key[suspected], shards)

    later = ex.exact(ex.with_answers(pieces, [seen], send, ex.ITEMS_SCHEMA), 2)

    def finish(piece, table, answers):
        words, at, digest, run_of, _, gone, suspected = _local(table, doc_id, text, size, layout, answers[0])
        elsewhere = np.zeros(len(digest), bool)
        elsewhere[suspected] = ex.comes_later(digest[suspected], shards, answers[1])
        gone = gone | elsewhere[run_of]
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, at[gone], 1)
        np.add.at(cover, at[gone] + size, -1)
        keep = np.cumsum(cover[:-1]) == 0
        data, begin, first_kept = words.joined(keep)
        texts = [data[a: max(a, b - 1)] for a, b in zip(begin[first_kept[:-1]].tolist(), begin[first_kept[1:]].tolist())]
        n, kept = words.counts(), np.diff(first_kept)
        yield from with_columns(table, {text: pa.array(texts, pa.binary()).cast(pa.string()), "n_words": pa.array(n, pa.int64()),
                                        "n_removed": pa.array(n - kept, pa.int64())})

    return ex.with_answers(pieces, [seen, later], finish, schema)


def window_digests(docs: DataFrame) -> DataFrame:
    return remove_repeated_windows(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
