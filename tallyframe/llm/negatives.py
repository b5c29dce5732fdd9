"""Hard negatives by an inverted multi-index: exact searches over cells of two half-space codebooks."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.common import cut_lineage, top_rows
from tallyframe.llm.exchange import from_blob, to_blob

#: Rows the codebooks are fitted on, twice as many at most. They only decide how rows are laid out; every row is indexed.
SAMPLE = 8192
#: Rows of a block of the index, anchors of a block of searches, rows that a cell is meant to hold, entries
#: of a codebook at most (so there are at most 65,536 cells).
BLOCK, ANCHORS, CELL_ROWS, MOST_CODES = 4096, 512, 1024, 256
#: Rows a search looks at before it knows a bound, as a number per wanted row.
FIRST = 512
#: Sums of products below this are exact in doubles.
EXACT = float(1 << 53)
NO_ID = (1 << 63) - 1

CODED = "uid long, vec_id long, label long, is_anchor boolean, cell int, r1 double, r2 double, vector binary"
BLOCKS = "block long, n int, width int, uids binary, ids binary, labels binary, vectors binary"


def whole_vectors(column: pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) as doubles, zeros behind shorter vectors, and which rows are whole: not NULL, no
    NULL or non-finite component."""
    lists = column if pa.types.is_large_list(column.type) else column.cast(pa.large_list(column.type.value_type))
    offs = np.frombuffer(lists.buffers()[1], np.int64)[lists.offset: lists.offset + len(lists) + 1] if len(lists) else np.zeros(1, np.int64)
    flat = lists.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # NULL becomes NaN
    sizes = np.diff(offs)
    rows = np.repeat(np.arange(len(lists)), sizes)
    at = np.arange(offs[0], offs[-1]) - np.repeat(offs[:-1], sizes)
    out = np.zeros((len(lists), width))
    with np.errstate(over="ignore", invalid="ignore"):
        out[rows, at] = np.floor(scale * flat[offs[0]: offs[-1]])
    whole = np.isfinite(out).all(axis=1) & np.asarray(lists.is_valid())
    out[~whole] = 0
    return out, whole


def fit_codebook(points: np.ndarray, codes: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's centres of a bounded sample."""
    if not points.size:
        return np.zeros((1, points.shape[1]))
    points = np.unique(points, axis=0)
    if len(points) <= codes:
        return points
    centres = points[np.random.default_rng(5).choice(len(points), codes, replace=False)]
    for _ in range(rounds):
        code, _ = nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, code, points)
        count = np.bincount(code, minlength=codes)[:, None]
        centres = np.where(count > 0, sums / np.maximum(count, 1), centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each point and the distance to it."""
    code = ((centres ** 2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)
    return code, np.sqrt(((points - centres[code]) ** 2).sum(axis=1))


class Index:
    """Codebooks and the directory of cells: what a search knows of the rows it hasn't seen."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.books = first, second
        self.half = first.shape[1]

    def cells(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        (a, r1), (b, r2) = nearest(vectors[:, :self.half], self.books[0]), nearest(vectors[:, self.half:], self.books[1])
        return a * len(self.books[1]) + b, r1, r2

    def fill(self, cells: np.ndarray, n: np.ndarray, r1: np.ndarray, r2: np.ndarray) -> None:
        shape = len(self.books[0]), len(self.books[1])
        self.n, self.r1, self.r2 = (np.zeros(shape[0] * shape[1], t) for t in (np.int64, float, float))
        self.n[cells], self.r1[cells], self.r2[cells] = n, r1, r2
        #: The widest cell of each entry, whose radius bounds all of its row or column.
        self.wide = self.r1.reshape(shape).max(axis=1), self.r2.reshape(shape).max(axis=0)

    def bounds(self, vector: np.ndarray):
        """Half scores of a vector with each entry, their slack, and the norms of its halves."""
        q1, q2 = vector[:self.half], vector[self.half:]
        s1, s2 = self.books[0] @ q1, self.books[1] @ q2
        return s1, s2, math.sqrt(float(q1 @ q1)), math.sqrt(float(q2 @ q2))

    def visit(self, vector: np.ndarray) -> Iterator[tuple[float, int, float, float]]:
        """Cells by falling bound of what their rows can score: the multi-sequence order over the two lists
        of half scores with their radii. Yields (bound, cell, highest, lowest); no cell yet to come has a row
        above ``bound``, and the rows of this cell score from lowest to highest."""
        s1, s2, n1, n2 = self.bounds(vector)
        up1, up2 = s1 + n1 * self.wide[0], s2 + n2 * self.wide[1]
        order1, order2 = np.argsort(-up1, kind="stable").tolist(), np.argsort(-up2, kind="stable").tolist()
        slack = 1 + 1e-9 * (abs(s1).max() + abs(s2).max() + n1 * self.wide[0].max() + n2 * self.wide[1].max())
        columns = len(order2)
        heap = [(-(up1[order1[0]] + up2[order2[0]]), 0, 0)]
        while heap:
            top, i, j = heapq.heappop(heap)
            a, b = order1[i], order2[j]
            # Each pair is reached once: along the first list only at the head of the second.
            if j + 1 < columns:
                heapq.heappush(heap, (-(up1[a] + up2[order2[j + 1]]), i, j + 1))
            if j == 0 and i + 1 < len(order1):
                heapq.heappush(heap, (-(up1[order1[i + 1]] + up2[b]), i + 1, 0))
            cell = a * columns + b
            if self.n[cell]:
                middle, reach = float(s1[a] + s2[b]), n1 * self.r1[cell] + n2 * self.r2[cell] + slack
                yield slack - top, cell, middle + reach, middle - reach


def wanted_cells(index: Index, vector: np.ndarray, windows: list[tuple[float, float, float | None]], first: int | None) -> list[int]:
    """Cells that the searches of one anchor ask for. A window is (lowest, highest, bound): rows from
    lowest to highest are wanted, the best first; ``bound`` is the score of the last wanted row among
    those found in the first round, None if there were too few. The first round visits cells up
    to ``first`` rows; the second one (None) goes on until no cell to come can hold a better row for
    any window, which certifies them."""
    seen, out = 0, []
    need = [(low if bound is None else max(low, bound), high) for low, high, bound in windows]
    stop = min(low for low, _ in need)
    for bound, cell, most, least in index.visit(vector):
        if bound < stop or (first is not None and seen >= first):
            break
        if any(most >= low and least <= high for low, high in need):
            seen += int(index.n[cell])
            out.append(cell)
    return out


def _codes(batches, index: Index, width: int, scale: int) -> Iterator[pa.RecordBatch]:
    task, at = TaskContext.get().partitionId() << 33, 0
    for batch in batches:
        vectors, whole = whole_vectors(batch.column(1), width, scale)
        labels = batch.column(2)
        keep = np.flatnonzero(whole & np.asarray(labels.is_valid()))
        vectors = vectors[keep]
        if len(keep) and np.abs(vectors).max(initial=0) >= 2.0 ** 31:
            raise ValueError("a component is beyond 2**31 after scaling")
        cell, r1, r2 = index.cells(vectors)
        rows = vectors.astype(np.int16 if np.abs(vectors).max(initial=0) < 1 << 15 else np.int32)
        take = pa.array(keep)
        yield pa.RecordBatch.from_arrays(
            [pa.array(task + at + keep, pa.int64()), batch.column(0).take(take), labels.take(take), batch.column(3).take(take), pa.array(cell, pa.int32()), pa.array(r1), pa.array(r2),
             pa.array([r.tobytes() for r in rows], pa.binary())], names=["uid", "vec_id", "label", "is_anchor", "cell", "r1", "r2", "vector"])
        at += batch.num_rows


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Vectors of two or four bytes a component; a vector's length tells which."""
    raw = [x.as_py() for x in column]
    out = np.zeros((len(raw), width), np.int32)
    for size, kind in ((2, np.int16), (4, np.int32)):
        here = [i for i, x in enumerate(raw) if len(x) == size * width]
        if here and width:
            out[here] = np.frombuffer(b"".join([raw[i] for i in here]), kind).reshape(-1, width)
    return out if len(out) and np.abs(out).max(initial=0) >= 1 << 15 else out.astype(np.int16)


def _pack(table: pa.Table, width: int, number: int) -> pa.Table:
    table = table.sort_by("uid")
    m = _matrix(table["vector"], width)
    ids = table["vec_id"].fill_null(NO_ID).to_numpy()
    return pa.table([pa.array([number], pa.int64()), pa.array([len(table)], pa.int32()), pa.array([m.dtype.itemsize], pa.int32()), *[
        pa.array([x.tobytes()], pa.binary()) for x in (table["uid"].to_numpy(), ids, table["label"].to_numpy(), m)]], names=BLOCK_NAMES)


BLOCK_NAMES = ["block", "n", "width", "uids", "ids", "labels", "vectors"]


def _unpack(row: dict, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    long = [np.frombuffer(row[k], np.int64) for k in ("uids", "ids", "labels")]
    return *long, np.frombuffer(row["vectors"], np.int16 if row["width"] == 2 else np.int32).reshape(row["n"], width)


def scores_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers."""
    most = float(np.abs(a.astype(np.int64)).max(initial=0)) * float(np.abs(b.astype(np.int64)).max(initial=0)) * a.shape[1]
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2.0 ** 63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = a.astype(object) @ b.astype(object).T
    return exact.astype(np.int64)  # raises where a score doesn't fit


class _Best:
    """The best rows of each search of a block of anchors, as far as one task has seen them."""

    def __init__(self, anchors: dict, windows: dict[int, list], wanted: int, same_label: bool, width: int):
        self.uids, self.ids, self.labels, self.vectors = _unpack(anchors, width)
        self.windows, self.wanted, self.same = windows, wanted, same_label
        self.found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def add(self, asked: np.ndarray, uids, ids, labels, vectors) -> None:
        scores = scores_of(self.vectors[asked], vectors)
        for row, a in zip(scores, asked.tolist()):
            windows = self.windows[a]
            fits = (labels == self.labels[a]) & (uids != self.uids[a]) if self.same else labels != self.labels[a]
            low, high = min(x[1] for x in windows), max(x[2] for x in windows)
            at = np.flatnonzero(fits & (row >= low) & (row <= high))
            if not len(at):
                continue
            at = at[np.lexsort((ids[at], -row[at]))]
            falling = -row[at]
            for w, least, most in windows:
                a0, a1 = np.searchsorted(falling, -most), np.searchsorted(falling, -least, side="right")
                take = at[a0: min(a1, a0 + self.wanted)]
                if not len(take):
                    continue
                new = row[take], ids[take], uids[take]
                old = self.found.get((a, w))
                if old is not None:
                    new = tuple(np.concatenate(x) for x in zip(old, new))
                    order = np.lexsort((new[2], new[1], -new[0]))[:self.wanted]
                    new = tuple(x[order] for x in new)
                self.found[a, w] = new

    def rows(self, block: int) -> pa.RecordBatch:
        sizes = [len(x[0]) for x in self.found.values()]
        parts = [np.concatenate([x[i] for x in self.found.values()]) if sizes else np.zeros(0, np.int64) for i in range(3)]
        keys = np.repeat(np.array(list(self.found), np.int64).reshape(-1, 2), sizes, axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), block), pa.int64()), pa.array(keys[:, 0], pa.int64()), pa.array(keys[:, 1], pa.int64()), *[
            pa.array(p, pa.int64()) for p in parts]], names=["anchors", "a", "w", "score", "id", "uid"])


FOUND = "anchors long, a long, w long, score long, id long, uid long"
#: Blocks of anchors whose best rows a task holds at once.
HELD = 32


def _search(batches, wanted: int, same_label: bool, width: int) -> Iterator[pa.RecordBatch]:
    held: dict[int, _Best] = {}
    for batch in batches:
        at = batch.schema.get_field_index
        for i in range(batch.num_rows):
            def cell(name: str):
                return batch.column(at(name))[i].as_py()

            number = cell("anchors")
            if number not in held:
                if len(held) == HELD:
                    old = next(iter(held))
                    yield held.pop(old).rows(old)
                windows: dict[int, list] = {}
                table = from_blob(cell("windows"))
                for a, w, low, high in zip(*[table[c].to_pylist() for c in ("a", "w", "low", "high")]):
                    windows.setdefault(a, []).append((w, low, high))
                held[number] = _Best({k: cell(f"q_{k}") for k in BLOCK_NAMES[1:]}, windows, wanted, same_label, width)
            held[number].add(np.frombuffer(cell("asked"), np.int32), *_unpack({k: cell(k) for k in BLOCK_NAMES[1:]}, width))
    for number, best in held.items():
        yield best.rows(number)


def _pack_windows(table: pa.Table) -> pa.Table:
    # Rows under the bound don't matter any more, those that equal it do: ids decide between them.
    bound = table["bound"].fill_null(-NO_ID)
    kept = table.select(["a", "w", "high", "bound"]).append_column("low", pc.if_else(pc.greater(bound, table["low"]), bound, table["low"]))
    return pa.table({"anchors": table["anchors"].slice(0, 1), "windows": pa.array([to_blob(kept)], pa.binary())})


def _ask(batches, index, width: int, first: int | None) -> Iterator[pa.RecordBatch]:
    """The cells that each block of anchors asks for, and the anchors that ask."""
    for batch in batches:
        for row in batch.to_pylist():
            vectors = _unpack({k: row[f"q_{k}"] for k in BLOCK_NAMES[1:]}, width)[3].astype(np.float64)
            table = from_blob(row["windows"])
            searches: dict[int, list] = {}
            for a, low, high, bound in zip(*[table[c].to_pylist() for c in ("a", "low", "high", "bound")]):
                searches.setdefault(a, []).append((low, high, bound))
            cells: dict[int, list[int]] = {}
            for a, its in searches.items():
                for cell in wanted_cells(index.value, vectors[a], its, first):
                    cells.setdefault(cell, []).append(a)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["anchors"]] * len(cells), pa.int64()), pa.array(list(cells), pa.int32()),
                 pa.array([np.array(x, np.int32).tobytes() for x in cells.values()], pa.binary())], names=["anchors", "cell", "asked"])


def _best_first() -> list[Column]:
    return [F.desc("score"), F.asc("id"), F.asc("uid")]


def _round(anchors: DataFrame, blocks: DataFrame, windows: DataFrame, found: DataFrame | None, index, parts: DataFrame, wanted: int, same_label: bool,
           width: int) -> DataFrame:
    """One round of all searches. ``windows`` is (anchors, a, w, low, high); ``found`` holds the best rows of the
    first round, whose last wanted scores bound the second one."""
    if found is None:
        state = windows.withColumn("bound", F.lit(None).cast("long"))
    else:
        last = found.groupBy("anchors", "a", "w").agg(F.count(F.lit(1)).alias("got"), F.min("score").alias("least"))
        state = windows.join(last, ["anchors", "a", "w"], "left").withColumn("bound", F.when(F.col("got") >= wanted, F.col("least"))).drop("got", "least")
    packed = state.groupBy("anchors").applyInArrow(_pack_windows, "anchors long, windows binary")
    asking = cut_lineage(anchors.withColumnsRenamed({k: f"q_{k}" for k in BLOCK_NAMES[1:]}).withColumnRenamed("block", "anchors").join(packed, "anchors"), "asking")
    first = FIRST * wanted if found is None else None
    asked = asking.mapInArrow(lambda it: _ask(it, index, width, first), "anchors long, cell int, asked binary").join(F.broadcast(parts), "cell").select(
        "anchors", "asked", "cell", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part")).select(
        "anchors", "asked", F.expr("shiftleft(cast(cell AS long), 32) + part").alias("block"))
    new = asked.join(asking, "anchors").join(blocks, "block").mapInArrow(lambda it: _search(it, wanted, same_label, width), FOUND)
    return cut_lineage(top_rows(new, ["anchors", "a", "w"], _best_first(), wanted), "best")


def mine_hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
                        vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Negatives that score from ``low`` to ``high`` percent of a positive's score, the best first, per
    anchor and positive.

    Components become floor(scale * x); a score is the inner product of whole numbers; ties go to the smaller
    id. An anchor's positives are its best other rows of the same label. Rows with a NULL label, a NULL vector or a
    component that is NULL or not finite take no part. Vectors shorter than the longest count as
    zeros there; an empty vector scores 0. Every row counts as a row of its own, also if ids or whole rows
    repeat; NULL ids come last. Components beyond 2**31 after scaling, and scores beyond a long, raise an error.

    Both halves of the vectors have a codebook, fitted on at most SAMPLE rows; a pair of entries is a cell.
    A search visits cells by the sum of two half-score bounds, each the entry's score plus the radius of
    its rows, in multi-sequence order. Its first round covers a number of rows, the second goes on until
    the bound falls below the last wanted row of every window: results are exact, whatever the
    codebooks. Anchors go through the index in blocks, cells in blocks of BLOCK rows, so a vector
    that a third of the rows hold only makes more blocks.
    """
    spark = vectors.sparkSession
    flat = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("embedding"), F.col(label).cast("long").alias("label"),
                          F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    usable = flat.where("label IS NOT NULL AND embedding IS NOT NULL")
    rows, width = usable.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    codes = min(MOST_CODES, max(2, math.ceil(math.sqrt(rows / CELL_ROWS))))
    every = max(1, rows // SAMPLE)
    some = usable.where(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(every)) == 0).select("embedding").limit(2 * SAMPLE).toArrow()["embedding"]
    fit = np.concatenate([np.zeros((0, width)), *[v[w] for v, w in (whole_vectors(c, width, scale) for c in some.chunks if len(c))]])
    half = width // 2
    index = Index(fit_codebook(fit[:, :half], codes), fit_codebook(fit[:, half:], codes))

    sent = spark.sparkContext.broadcast(index)
    coded = cut_lineage(usable.select("vec_id", "embedding", "label", "is_anchor").mapInArrow(
        lambda it: _codes(it, sent.value, width, scale), CODED), "coded")
    cells = coded.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2")).toArrow()
    index.fill(*[cells[c].to_numpy() for c in ("cell", "n", "r1", "r2")])
    filled = spark.sparkContext.broadcast(index)
    parts = spark.createDataFrame([(int(c), -(-int(n) // BLOCK)) for c, n in zip(cells["cell"].to_pylist(), cells["n"].to_pylist())], "cell int, parts long")

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        return _pack(table, width, (key[0].as_py() << 32) + key[1].as_py())

    blocks = cut_lineage(coded.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts"))).groupBy("cell", "part").applyInArrow(
        pack, BLOCKS), "cells")

    # Anchors of near cells search together, so that their blocks ask for the same cells.
    def pack_anchors(batches):
        held, at = [], TaskContext.get().partitionId() << 32
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            while len(table) >= ANCHORS:
                yield from _pack(table.slice(0, ANCHORS), width, at).to_batches()
                table, at = table.slice(ANCHORS), at + 1
            held = table.to_batches()
        if held:
            yield from _pack(pa.Table.from_batches(held), width, at).to_batches()

    dealt = coded.where("is_anchor").repartitionByRange("cell", "uid").sortWithinPartitions("cell", "uid")
    anchors = cut_lineage(dealt.select("uid", "vec_id", "label", "vector").mapInArrow(pack_anchors, BLOCKS), "anchors")

    def members(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                uids, ids, _, _ = _unpack({name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}, width)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(uids), pa.int64()), pa.array(np.arange(len(uids))), pa.array(ids)],
                                                 names=["anchors", "a", "anchor_id"])

    each = cut_lineage(anchors.mapInArrow(members, "anchors long, a long, anchor_id long"), "each")
    all_scores = each.select("anchors", "a", F.lit(0).cast("long").alias("w"), F.lit(-NO_ID).alias("low"), F.lit(NO_ID).alias("high"))

    def search(windows: DataFrame, wanted: int, same_label: bool) -> DataFrame:
        found = _round(anchors, blocks, windows, None, filled, parts, wanted, same_label, width)
        return _round(anchors, blocks, windows, found, filled, parts, wanted, same_label, width)

    def place() -> Column:
        return F.row_number().over(Window.partitionBy("anchors", "a", "w").orderBy(*_best_first()))

    chosen = cut_lineage(search(all_scores, positives, True).select("anchors", "a", (place() - 1).cast("long").alias("w"), F.col("id").alias("positive_id"), F.col(
        "score").alias("positive_score")), "positives")
    # ceil(low * score / 100) and floor(high * score / 100), in decimals.
    wide = F.col("positive_score").cast("decimal(20,0)")
    windows = chosen.select("anchors", "a", "w", F.ceil(wide * low / 100).cast("long").alias("low"), F.floor(wide * high / 100).cast("long").alias("high")).where("low <= high")
    mined = search(cut_lineage(windows, "windows"), negatives, False).withColumn("rank", place())

    def shown(c: str, name: str) -> Column:
        return F.when(F.col(c) != NO_ID, F.col(c)).alias(name)

    return mined.join(chosen, ["anchors", "a", "w"]).join(each, ["anchors", "a"]).select(
        shown("anchor_id", "anchor_id"), shown("positive_id", "positive_id"), "rank", shown("id", "negative_id"), "positive_score", F.col("score").alias("negative_score"))
