"""Pieces of a corpus and the exchanges between them.

A *piece* is a few megabytes of whole documents, kept as one row of a written table that is
bucketed by piece number. Finding what repeats between pieces takes two exchanges:

* ``suspects``: each piece sends the sorted cells of its item hashes, Rice-coded (about 2 bits more
  than the entropy of a gap), to the shard that owns that range of cells. A shard merges what all
  pieces sent into its sketch and answers every piece with a bit (or a few) per cell sent. The sketch is
  thus spread over the shards: a task holds the cells of about ``SHARD_ITEMS`` items, whatever the
  corpus, and nothing is broadcast. A cell sent by only one piece can't hold an item of two pieces, so no
  repeat is lost; cells shared by chance are settled by the exact exchange.
* ``exact``: for suspected items only, each piece sends (128-bit digest, order key) of its own first
  occurrence; the shard answers with one bit per item that says whether it comes first of all.

An item that fills a third of the corpus is sent once per piece that holds it. Answers meet their
pieces in a join that moves only the answers, since the table is bucketed by piece.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.common import new_scratch_path
from tallyframe.llm.batches import pack_flags, pack_sorted, unpack_flags, unpack_sorted

PIECE_BYTES = 4 << 20
#: Items that one shard is laid out for.
SHARD_ITEMS = 1 << 21

LONG, DOUBLE, TEXT, BYTES = T.LongType(), T.DoubleType(), T.StringType(), T.BinaryType()

#: How tables of large binary values are written: compressed harder, in row groups that a reader can hold.
BLOBS = {"compression": "zstd", "parquet.block.size": str(32 << 20), "parquet.page.size.row.check.min": "1"}

PIECE_SCHEMA = "piece long, blob binary, n_bytes long"
CELLS_SCHEMA = "shard long, piece long, n int, low int, unary binary, lows binary"
BITS_SCHEMA = "piece long, shard long, n int, bits binary"


def to_blob(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def from_blob(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all()


def _cut(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

    def piece() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        return pa.RecordBatch.from_arrays(
            [pa.array([(task << 32) + number], pa.int64()), pa.array([to_blob(table)], pa.binary()), pa.array([size], pa.int64())],
            names=["piece", "blob", "n_bytes"])

    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < batch.num_rows:
            ends = size + np.cumsum(lengths[at:] + 64)
            take = min(len(ends), int(np.searchsorted(ends, limit)) + 1)
            held.append(batch.slice(at, take))
            size, at = int(ends[take - 1]), at + take
            if size >= limit:
                yield piece()
                held, size, number = [], 0, number + 1
    if held:
        yield piece()


def write_pieces(docs: DataFrame, text: str = "text", limit: int = PIECE_BYTES) -> DataFrame:
    """Write docs as pieces of about ``limit`` bytes (one longer document is a piece of its own).

    A piece is numbered by the task that wrote it. The numbers are read from the written table ever
    after, so a task that runs twice can't change them. Writing moves nothing between tasks.
    """
    spark = docs.sparkSession
    path = new_scratch_path(spark, "pieces")
    name = "tallyframe_pieces_" + path.rsplit("-", 1)[-1]
    buckets = min(50_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions()))
    rows = docs.mapInArrow(lambda it: _cut(it, text, limit), PIECE_SCHEMA)
    rows.write.format("parquet").options(path=path, **BLOBS).bucketBy(buckets, "piece").saveAsTable(name)
    pieces = spark.table(name)
    pieces._buckets, pieces._name, pieces._path = buckets, name, path
    return pieces


def drop_pieces(pieces: DataFrame) -> None:
    """Delete the table that ``write_pieces`` made, once all that was read from it is written."""
    spark = pieces.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {pieces._name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(pieces._path)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def each_piece(pieces: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``work(piece, table)`` yields record batches for every piece."""

    def run(batches):
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from work(number, from_blob(blob.as_buffer()))

    return pieces.select("piece", "blob").mapInArrow(run, schema)


def with_answers(pieces: DataFrame, answers: list[DataFrame], work: Callable, schema: str) -> DataFrame:
    """``work(piece, table, answers)`` for every piece; answers[i] maps a shard to (n, bits)
    of the i-th exchange. Only the answers are moved."""
    frame = pieces.select("piece", "blob")
    for i, found in enumerate(answers):
        packed = (found.repartition(pieces._buckets, "piece").groupBy("piece")
                  .agg(F.collect_list(F.struct("shard", "n", "bits")).alias(f"a{i}")))
        frame = frame.join(packed.hint("shuffle_hash"), "piece", "left")

    exchanges = len(answers)

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                got = []
                for i in range(exchanges):
                    lists = batch.column(2 + i)
                    got.append({x["shard"]: (x["n"], x["bits"]) for x in lists[r].as_py() or ()})
                yield from work(batch.column(0)[r].as_py(), from_blob(batch.column(1)[r].as_buffer()), got)

    return frame.mapInArrow(run, schema)


# --- suspects -------------------------------------------------------------------------------------


def distinct(values: np.ndarray) -> np.ndarray:
    s = np.sort(values)
    return s[np.append(True, s[1:] != s[:-1])] if len(s) else s


class Cells:
    """How item hashes are laid out in cells and shards for a corpus of about ``items`` items. A hash's
    cell is its leading bits, so sorted hashes have sorted cells."""

    def __init__(self, items: int, cells_per_item: int):
        self.bits = min(60, max(16, math.ceil(math.log2(max(1, items) * cells_per_item))))
        self.shard_bits = self.bits - min(self.bits - 8, max(4, math.ceil(math.log2(max(1, items) / SHARD_ITEMS))))

    def of(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def _shards(self, cells: np.ndarray) -> list[tuple[int, int, int]]:
        shards, begin = np.unique(cells >> self.shard_bits, return_index=True)
        return list(zip(shards.tolist(), begin.tolist(), [*begin[1:].tolist(), len(cells)]))

    def rows(self, piece: int, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        cells = distinct(self.of(hashes))
        out = [(s, piece, b - a, *pack_sorted(cells[a:b], s << self.shard_bits, 1 << self.shard_bits)) for s, a, b in self._shards(cells)]
        if out:
            yield _batch(out, CELLS_TYPES)

    def answers(self, cells: np.ndarray, answers: dict, planes: int = 1) -> np.ndarray:
        """The flags that ``merge`` gave to a piece's distinct cells, in rising order."""
        flags = np.zeros((planes, len(cells)), bool)
        for s, a, b in self._shards(cells):
            n, bits = answers[s]
            if n != b - a:
                raise RuntimeError("an answer doesn't fit its piece")
            flags[:, a:b] = unpack_flags(bits, planes * n).reshape(planes, n)
        return flags

    def flags(self, hashes: np.ndarray, answers: dict, planes: int = 1) -> np.ndarray:
        """The flags of each item's cell."""
        cells = self.of(hashes)
        known = distinct(cells)
        return self.answers(known, answers, planes)[:, np.searchsorted(known, cells)]


CELLS_TYPES = [("shard", pa.int64()), ("piece", pa.int64()), ("n", pa.int32()), ("low", pa.int32()),
               ("unary", pa.binary()), ("lows", pa.binary())]
BITS_TYPES = [("piece", pa.int64()), ("shard", pa.int64()), ("n", pa.int32()), ("bits", pa.binary())]


def _batch(rows: list[tuple], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(types)], names=[n for n, _ in types])


def suspects(pieces: DataFrame, layout: Cells, items: Callable, merge: Callable) -> DataFrame:
    """Answers for ``items(table)``, the item hashes of each piece. ``merge`` gets the distinct cells of
    each piece in a shard and returns the flags of each, one or more planes."""
    sent = each_piece(pieces, lambda piece, table: layout.rows(piece, items(table)), CELLS_SCHEMA)

    def answer(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda x: x["piece"])
        cells = [unpack_sorted(x["n"], 0, x["low"], x["unary"], x["lows"]) for x in rows]
        flags = merge(cells)
        return pa.Table.from_batches([_batch(
            [(x["piece"], x["shard"], x["n"], pack_flags(f)) for x, f in zip(rows, flags)], BITS_TYPES)])

    return sent.groupBy("shard").applyInArrow(answer, BITS_SCHEMA)


# --- exact ----------------------------------------------------------------------------------------

ITEMS_SCHEMA = "shard long, piece long, n int, digests binary, keys binary"
ITEMS_TYPES = [("shard", pa.int64()), ("piece", pa.int64()), ("n", pa.int32()), ("digests", pa.binary()), ("keys", pa.binary())]


def exact_rows(piece: int, digests: np.ndarray, keys: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    """digests: (n, 2) uint64, distinct; keys: (n, k) int64 order keys of their first occurrence in
    the piece. Rows are sent per shard in digest order."""
    order, shard, begin = _deal(digests, shards)
    out = []
    for s, a, b in zip(shard[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(order)]):
        take = order[a:b]
        out.append((s, piece, b - a, digests[take].tobytes(), keys[take].tobytes()))
    if out:
        yield _batch(out, ITEMS_TYPES)


def _deal(digests: np.ndarray, shards: int):
    shard = (digests[:, 0] % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((digests[:, 1], digests[:, 0], shard))
    shard = shard[order]
    return order, shard, np.flatnonzero(np.diff(shard, prepend=-1))


def exact_answer(width: int) -> Callable:
    def answer(table: pa.Table) -> pa.Table:
        n = table["n"].to_pylist()
        digests = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64).reshape(-1, 2) for x in table["digests"]])
        keys = np.concatenate([np.frombuffer(x.as_buffer(), np.int64).reshape(-1, width) for x in table["keys"]])
        order = np.lexsort((*(keys[:, j] for j in range(width - 1, -1, -1)), digests[:, 1], digests[:, 0]))
        d, k = digests[order], keys[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]).any(axis=1)
        least = k[np.flatnonzero(new)][np.cumsum(new) - 1]
        later = np.empty(len(d), bool)
        later[order] = (k != least).any(axis=1)
        ends = np.cumsum(n)
        return pa.Table.from_batches([_batch([(p, s, m, pack_flags(later[e - m: e])) for p, s, m, e in zip(
            table["piece"].to_pylist(), table["shard"].to_pylist(), n, ends.tolist())], BITS_TYPES)])

    return answer


def exact(rows: DataFrame, width: int) -> DataFrame:
    """Answers to ``exact_rows``: whether a smaller key of the same digest exists."""
    return rows.groupBy("shard").applyInArrow(exact_answer(width), BITS_SCHEMA)


def comes_later(digests: np.ndarray, shards: int, answers: dict) -> np.ndarray:
    order, shard, begin = _deal(digests, shards)
    out = np.zeros(len(order), bool)
    for s, a, b in zip(shard[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(order)]):
        n, bits = answers[s]
        out[order[a:b]] = unpack_flags(bits, n)
    return out


def total(pieces: DataFrame, count: Callable) -> int:
    """Sum of ``count(table)`` over all pieces: one number per piece, added up by Spark."""
    rows = each_piece(pieces, lambda piece, table: [pa.RecordBatch.from_arrays([pa.array([count(table)], pa.int64())], names=["n"])], "n long")
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def output_schema(docs: DataFrame, extra: dict[str, T.DataType]) -> T.StructType:
    """Columns of docs, then the extra ones; an extra column takes the place of one of the same name."""
    fields = {f.name: f.dataType for f in docs.schema.fields} | extra
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def exact_shards(items: int, least: int) -> int:
    return max(1, least, math.ceil(items / SHARD_ITEMS))
