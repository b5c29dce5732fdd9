"""Language identification: nearest centroid over TF-IDF vectors of byte three-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.common import cut_lineage, top_rows
from tallyframe.llm.batches import U64, buffer

#: Features that three-grams are hashed to, clusters per language, and the labelled texts of each language
#: that the clusters start from, at most. Document frequencies, centroids and radii are taken over all texts.
FEATURES, CLUSTERS, SAMPLE = 8192, 4, 500
#: Texts vectorised at once, and bytes of one step through long texts.
ROWS, STEP = 64, 1 << 20
#: A text is rejected if it lies further from its centroid than the mean distance of the n learning texts of
#: its language and length, and so many standard deviations, each wider by DOUBT / sqrt(n).
REJECT, DOUBT = 4.0, 0.25
#: Languages a model may hold (128 KB each), so that it can be broadcast.
MOST_LANGUAGES = 256

# ASCII that isn't a letter is a blank.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = [b if chr(b).isalpha() else 32 for b in range(128)]
_SHIFT = U64(64 - (FEATURES.bit_length() - 1))


def has_letter(texts: pa.Array) -> np.ndarray:
    found = pc.match_substring_regex(texts.cast(pa.large_string()), r"\p{L}")
    return found.fill_null(False).to_numpy(zero_copy_only=False).astype(bool)


def count_grams(texts: pa.Array) -> np.ndarray:
    """Counts of hashed three-grams, a row per text: every byte that isn't a blank with its two neighbours,
    lower-cased; blanks stand before and behind a text."""
    buf, offs = buffer(pc.utf8_lower(texts.cast(pa.large_string())))
    docs = len(offs) - 1
    x = np.full(len(buf) + docs + 1, 32, np.uint8)
    for d, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
        x[a + d + 1: b + d + 1] = _FOLD[buf[a:b]]
    starts = offs + np.arange(docs + 1)
    out = np.zeros(docs * FEATURES, np.int64)
    for a in range(1, len(x) - 1, STEP):
        at = np.flatnonzero(x[a: min(a + STEP, len(x) - 1)] != 32) + a
        gram = (x[at - 1].astype(np.uint64) << U64(16) | x[at].astype(np.uint64) << U64(8) | x[at + 1].astype(np.uint64)) * U64(0x9E3779B97F4A7C15) >> _SHIFT
        first = int(np.searchsorted(starts, a, side="right")) - 1
        last = int(np.searchsorted(starts, min(a + STEP, len(x) - 1), side="right"))
        doc = np.searchsorted(starts[first: last], at, side="right") - 1
        part = np.bincount(doc * FEATURES + gram.astype(np.int64))
        out[first * FEATURES: first * FEATURES + len(part)] += part
    return out.reshape(docs, FEATURES)


def vectors(texts: pa.Array, idf: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, vectors, number of grams) of up to ROWS texts at a time: sqrt(count) * idf, of length
    one; zero for a text without grams."""
    for a in range(0, len(texts), ROWS):
        counts = count_grams(texts.slice(a, ROWS))
        v = np.sqrt(counts, dtype=np.float32) * idf
        norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
        yield a, v / np.where(norm > 0, norm, 1), counts.sum(axis=1)


def unit(v: np.ndarray) -> np.ndarray:
    norm = np.sqrt((v * v).sum(axis=-1, keepdims=True))
    return v / np.where(norm > 0, norm, 1)


def clusters(points: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means; each centre starts at the point that is least like those before."""
    centres = unit(points.mean(axis=0, keepdims=True))
    first = int((points @ centres[0]).argmax())
    centres = points[[first]]
    while len(centres) < min(k, len(points)):
        like = (points @ centres.T).max(axis=1)
        if like.min() > 1 - 1e-6:
            break
        centres = np.concatenate([centres, points[[int(like.argmin())]]])
    for _ in range(rounds):
        own = (points @ centres.T).argmax(axis=1)
        sums = np.stack([points[own == c].sum(axis=0) for c in range(len(centres))])
        centres = np.where(np.abs(sums).sum(axis=1, keepdims=True) > 0, unit(sums), centres)
    return centres


class Model:
    """Centroids of all languages as one matrix, with the language of each."""

    def __init__(self, idf: np.ndarray, centroids: pa.Table):
        self.idf = idf.astype(np.float32)
        rows = sorted(zip(centroids["lang"].to_pylist(), centroids["cluster"].to_pylist(), centroids["vector"].to_pylist()))
        self.langs = sorted({r[0] for r in rows})
        self.keys = [(r[0], r[1]) for r in rows]
        self.of = np.array([self.langs.index(r[0]) for r in rows], np.int64)
        self.matrix = np.stack([np.frombuffer(r[2], np.float32) for r in rows]) if rows else np.zeros((0, FEATURES), np.float32)


def _frequencies(batches) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            counts = count_grams(batch.column(0).slice(a, ROWS))
            df += (counts > 0).sum(axis=0)
            n += len(counts)
    # Feature -1 carries the number of texts.
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, FEATURES), pa.int32()), pa.array(np.append(n, df))], names=["feature", "n"])


def _start(batches, idf: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, v, _ in vectors(batch.column(0), idf):
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, len(v)), batch.column(2).slice(a, len(v)), pa.array([r.tobytes() for r in v], pa.binary())],
                                             names=["lang", "order", "vector"])


CENTROIDS = "lang string, cluster int, vector binary"


def _cluster(table: pa.Table) -> pa.Table:
    table = table.sort_by([("order", "ascending")])
    found = clusters(np.stack([np.frombuffer(x, np.float32) for x in table["vector"].to_pylist()]), CLUSTERS)
    return pa.table({"lang": pa.array([table["lang"][0].as_py()] * len(found), pa.string()), "cluster": pa.array(range(len(found)), pa.int32()),
                     "vector": pa.array([v.astype(np.float32).tobytes() for v in found], pa.binary())})


def _sums(batches, model: Model) -> Iterator[pa.RecordBatch]:
    """Sums of a task's vectors per cluster, each text in the nearest cluster of its own language."""
    sums, place = np.zeros(model.matrix.shape), {lang: i for i, lang in enumerate(model.langs)}
    for batch in batches:
        own = np.array([place.get(x, -1) for x in batch.column(1).to_pylist()], np.int64)
        for a, v, _ in vectors(batch.column(0), model.idf):
            like = np.where(model.of == own[a: a + len(v), None], v @ model.matrix.T, -1)
            nearest = like.argmax(axis=1)
            for c in np.unique(nearest[own[a: a + len(v)] >= 0]).tolist():
                sums[c] += v[(nearest == c) & (own[a: a + len(v)] >= 0)].sum(axis=0)
    rows = np.flatnonzero(np.abs(sums).sum(axis=1) > 0).tolist()
    yield pa.RecordBatch.from_arrays(
        [pa.array([model.keys[c][0] for c in rows], pa.string()), pa.array([model.keys[c][1] for c in rows], pa.int32()),
         pa.array([TaskContext.get().partitionId() % 64] * len(rows), pa.int32()), pa.array([sums[c].tobytes() for c in rows], pa.binary())],
        names=["lang", "cluster", "part", "vector"])


def _add(final: bool):
    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(FEATURES)
        for x in sorted(table["vector"].to_pylist()):
            total += np.frombuffer(x, np.float64)
        value = unit(total).astype(np.float32) if final else total
        return table.slice(0, 1).drop_columns(["vector"]).append_column("vector", pa.array([value.tobytes()], pa.binary()))

    return add


def fit(train: DataFrame) -> Model:
    """Model of (text, lang, key) rows with languages: inverse document frequencies over all texts, clusters
    started from the SAMPLE texts of each language with the least hash, centroids over all texts."""
    counts = train.select("text").mapInArrow(_frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(FEATURES + 1)
    df[counts["feature"].to_numpy() + 1] = counts["n"].to_numpy()
    idf = (np.log((1 + df[0]) / (1 + df[1:])) + 1).astype(np.float32)
    order = F.xxhash64("key", "text")
    least = top_rows(train.select("lang", order.alias("order")), ["lang"], [F.asc("order")], SAMPLE).groupBy("lang").agg(F.max("order").alias("last"))
    least = cut_lineage(least, "language-sample")
    if least.count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    some = train.select("text", "lang", order.alias("order")).join(F.broadcast(least), "lang").where("order <= last").select("text", "lang", "order")
    # Repeated rows share a hash; a group still holds SAMPLE rows.
    start = top_rows(some.mapInArrow(lambda it: _start(it, idf), "lang string, order long, vector binary"), ["lang"], [F.asc("order")], SAMPLE)
    first = Model(idf, start.groupBy("lang").applyInArrow(_cluster, CENTROIDS).toArrow())
    model = train.sparkSession.sparkContext.broadcast(first)
    sums = train.select("text", "lang").mapInArrow(lambda it: _sums(it, model.value), "lang string, cluster int, part int, vector binary")
    sums = sums.groupBy("lang", "cluster", "part").applyInArrow(_add(False), "lang string, cluster int, part int, vector binary")
    return Model(idf, sums.drop("part").groupBy("lang", "cluster").applyInArrow(_add(True), CENTROIDS).toArrow())


def identify_languages(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """The most likely language of every text, learnt from the rows where ``learn`` holds and ``lang`` isn't NULL.

    A text's vector holds square roots of counts of lower-cased byte three-grams times inverse document
    frequency, of length one. Each language has up to CLUSTERS centroids; the language of the nearest one by
    cosine is predicted (on equal ones the first by name). Returns the columns of docs but the text, then lang_pred,
    score (that cosine, 0 to 1), distance (1 - score) and rejected: the distance is over that of learning texts
    of like length, by REJECT standard deviations, or there was nothing to compare. New columns
    take the place of docs' columns of the same name. A NULL text, one without a letter, and every text
    if nothing was learnt is ``und`` with score 0 and not rejected. Every row counts by itself, also if ids repeat; more than
    MOST_LANGUAGES languages raise an error.
    """
    spark = docs.sparkSession
    new = ["lang_pred", "score", "distance", "rejected"]
    others = [c for c in docs.columns if c != text and c not in new]
    body = F.col(f"`{text}`").cast("string")
    teaches = F.coalesce(learn, F.lit(False)) & F.col(f"`{lang}`").isNotNull() & body.isNotNull()
    train = docs.where(teaches).select(body.alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{key}`").alias("key"))
    model = spark.sparkContext.broadcast(fit(train))

    def predict(batches):
        for batch in batches:
            letters = has_letter(batch.column(0))
            pred, score, size = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int32)
            if len(model.value.matrix):
                at = np.flatnonzero(letters)
                for a, v, grams in vectors(batch.column(0).take(pa.array(at)), model.value.idf):
                    like = v @ model.value.matrix.T
                    best = like.argmax(axis=1)
                    here = at[a: a + len(v)]
                    pred[here] = np.array(model.value.langs, object)[model.value.of[best]]
                    score[here] = np.clip(like[np.arange(len(v)), best], 0, 1)
                    size[here] = np.log2(1 + grams)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(pred.tolist(), pa.string()), pa.array(score), pa.array(size)],
                                             names=["__row", "__teaches", "lang_pred", "score", "__size"])

    aside = docs.select(body.alias("text"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("__row"), teaches.alias("__teaches"))
    schema = T.StructType([*aside.drop("text").schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("__size", T.IntegerType())])
    judged = cut_lineage(aside.mapInArrow(predict, schema), "languages")
    radius = judged.where("__teaches AND lang_pred <> 'und'").groupBy("lang_pred", "__size").agg(
        (F.avg(1 - F.col("score")) + REJECT * (F.stddev_pop(1 - F.col("score")) + DOUBT / F.sqrt(F.count(F.lit(1))))).alias("__radius"))
    # At most 32 length classes per language.
    far = F.coalesce((F.col("lang_pred") != "und") & ((1 - F.col("score")) > F.coalesce("__radius", F.lit(0.0)) + 1e-9), F.lit(False))
    return judged.join(F.broadcast(radius), ["lang_pred", "__size"], "left").select(
        *[F.col(f"__row.`{c}`").alias(c) for c in others], "lang_pred", "score", (1 - F.col("score")).alias("distance"), far.alias("rejected"))
