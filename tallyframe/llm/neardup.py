"""Near-duplicate documents by b-bit MinHash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.common import cut_lineage, spread_join, union_all
from tallyframe.llm.batches import U64, Words, blocks, buffer, mix
from tallyframe.operators.matching import connected_components

#: Minima kept per document: BANDS groups of ROWS for candidates, and the low BITS of each for
#: estimates. At a similarity of 0.8 a pair shares no band with a chance of 0.5904**24, 3 in a million.
BANDS, ROWS, BITS = 24, 4, 4
#: An estimate may be this much too low before a pair is left out: four and a half standard deviations,
#: a chance of 3 in a million at a similarity of 0.8.
SLACK = 0.19
ROUNDS = 2
#: Rare shingles that two near classes must share.
RARE = 8

_FACTORS = np.random.default_rng(7).integers(0, 2**62, BANDS * ROWS, dtype=np.uint64) * U64(2) + U64(1)
SKETCH = "doc_id long, text_hash long, n_shingles long, node binary, bands array<long>, signature array<long>"


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, rising, and where each text's begin (one more at the
    end). A text of fewer words is one shingle; one without words has none."""
    buf, offs = buffer(texts)
    w = Words(buf, offs, lower=True)
    at, h = w.windows(words)
    n = w.counts()
    short = np.flatnonzero((n > 0) & (n < words))
    doc = np.concatenate([w.doc[at], short])
    h = np.concatenate([h, w.run_hash(w.first[:-1][short], n[short])])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    doc, h = doc[new], h[new]
    return h, np.searchsorted(doc, np.arange(len(offs)))


def node_of(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _sketch(batches, words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offs = buffer(batch.column(1))[1]
        for a, b in blocks(offs):
            h, at = shingles(batch.column(1).slice(a, b - a), words)
            size = np.diff(at)
            some = np.flatnonzero(size)
            minima = np.empty((len(some), BANDS * ROWS), np.uint64)
            for i, factor in enumerate(_FACTORS):
                if len(some):
                    minima[:, i] = np.minimum.reduceat(h * factor, at[some])
            mixed = mix(minima)
            bands = mixed.reshape(len(some), BANDS, ROWS)
            key = np.zeros((len(some), BANDS), np.uint64)
            for r in range(ROWS):
                key = key * U64(0x9E3779B97F4A7C15) + bands[:, :, r]
            key = mix(key + np.arange(BANDS, dtype=np.uint64) * U64(0xD1342543DE82EF95)).astype(np.int64)
            low = (mixed & U64((1 << BITS) - 1)).reshape(len(some), -1, 64 // BITS)
            packed = (low << (np.arange(64 // BITS, dtype=np.uint64) * U64(BITS))).sum(axis=2, dtype=np.uint64).astype(np.int64)
            nodes: list = [None] * (b - a)
            all_bands: list = [None] * (b - a)
            all_low: list = [None] * (b - a)
            for j, d in enumerate(some.tolist()):
                nodes[d] = node_of(h[at[d]: at[d + 1]])
                all_bands[d], all_low[d] = key[j], packed[j]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(size, pa.int64()), pa.array(nodes, pa.binary()),
                 pa.array(all_bands, pa.list_(pa.int64())), pa.array(all_low, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n_shingles", "node", "bands", "signature"])


def estimate(a: str, b: str) -> Column:
    """Similarity from two packed signatures: equal fields are counted by bits and corrected for the
    share 2**-BITS of unequal minima whose low bits agree."""
    fields = BANDS * ROWS
    ones = F.lit(int("0x" + "1" * 16, 16))  # lowest bit of every field of four bits
    differ = F.lit(0)
    for i in range(fields * BITS // 64):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        differ = differ + F.bit_count(x.bitwiseAND(ones))
    chance = 2.0 ** -BITS
    return (1 - differ / fields - chance) / (1 - chance)


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, hashes) of the wanted nodes, from the text of one row of each (its id and the hash of its
    text, as ids may be NULL or repeated)."""

    def run(batches):
        for batch in batches:
            offs = buffer(batch.column(1))[1]
            for a, b in blocks(offs):
                h, at = shingles(batch.column(1).slice(a, b - a), words)
                names = batch.column(0).slice(a, b - a).to_pylist()
                found = [(x, h[at[d]: at[d + 1]].tobytes()) for d, x in enumerate(names) if node_of(h[at[d]: at[d + 1]]) == x]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([x for _, x in found], pa.binary())],
                                                 names=["node", "hashes"])

    same = (F.col("text_hash") == F.col("row.text_hash")) & F.col("doc_id").eqNullSafe(F.col("row.doc_id"))
    joined = docs.join(wanted, same).select("node", "text")
    # Equal rows bring the same set.
    return cut_lineage(joined.mapInArrow(run, "node binary, hashes binary").dropDuplicates(["node"]), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets have ``100 * intersection >= percent * union``."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("node").alias("a"), F.col("hashes").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("hashes").alias("sb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def _pairs_apart(apart: DataFrame, signature: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of one bucket that are in different groups, one of them not in its leading group,
    as far as they can reach the similarity at all.

    The shingles of a class are put in order of how many of these classes have them. Two classes of n and m
    shingles that are near share at least o = percent * (n + m) / (100 + percent) of them, so the n - o + k
    rarest of the one and the m - o + k rarest of the other have k in common, for every k up to o; RARE is the
    k tested. Shingles that a class has alone come first and are in no intersection, so they are only
    counted. Both bounds are exact; they and the estimate are part of the join, so that pairs that fail are
    never rows. A pair comes up in the first band it shares alone."""

    def shingle_rows(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                owned = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(1)]
                sizes = [len(x) for x in owned]
                halves = np.frombuffer(b"".join(part.column(0).to_pylist()), np.int64).reshape(-1, 2)
                # With the smallest partner, of percent * n shingles, so many of the rarest count.
                most = [n - -(-percent * n // 100) + RARE for n in sizes]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(owned)), *[pa.array(np.repeat(halves[:, j], sizes)) for j in (0, 1)],
                                                  pa.array(np.repeat(most, sizes), pa.int32())], names=["h", "k1", "k2", "most_rare"])

    def named(batches):
        for batch in batches:
            halves = np.stack([batch.column(j).to_numpy() for j in (0, 1)], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in halves], pa.binary()), *batch.columns[2:]], names=["node", "common", "rare"])

    nodes = apart.select("node").distinct()
    rows = cut_lineage(sets.join(nodes, "node", "left_semi").select("node", "hashes").mapInArrow(shingle_rows, "h long, k1 long, k2 long, most_rare int"), "shingles")
    # A node's two halves are long numbers here, which Spark aggregates without sorting.
    owners = rows.groupBy("h").agg(F.count(F.lit(1)).alias("owners")).where("owners > 1")
    ranked = spread_join(rows, owners, ["h"], no_broadcast=True).groupBy("k1", "k2").agg(
        F.count(F.lit(1)).alias("common"), F.slice(F.sort_array(F.collect_list(F.struct("owners", "h"))), 1, F.max("most_rare")).alias("rare"))
    common = ranked.select("k1", "k2", "common", F.transform("rare", lambda x: x["h"]).alias("rare")).mapInArrow(named, "node binary, common long, rare array<long>")
    alive = signature.select("node", "n", "signature", "bands").join(nodes, "node", "left_semi").join(common, "node").select(
        "node", "n", "signature", "bands", F.col("common").alias("most"), "rare").where(100 * F.col("most") >= percent * F.col("n"))
    left = cut_lineage(apart.join(alive, "node"), "alive")
    other = left.select("band", F.col("node").alias("other"), F.col("label").alias("other_label"), F.col("n").alias("other_n"), F.col("most").alias("other_most"),
                        F.col("signature").alias("other_signature"), F.col("bands").alias("other_bands"),
                        F.col("rare").alias("other_rare"))
    first = F.coalesce(*[F.when(F.col("bands")[i] == F.col("other_bands")[i], F.col("bands")[i]) for i in range(BANDS)])
    shared = F.least("most", "other_most")
    needed = F.ceil(percent * (F.col("n") + F.col("other_n")) / (100 + percent) - 1e-9)

    k = F.least(needed, F.lit(RARE))

    def rarest(rare: str, most: str) -> Column:
        return F.slice(rare, F.lit(1), F.greatest(F.col(most) - needed + k, F.lit(0)).cast("int"))

    return left.where("label <> lead.label").join(other, "band").where(
        (F.col("label") != F.col("other_label")) & (100 * shared >= percent * (F.col("n") + F.col("other_n") - shared))
        & (first == F.col("band")) & (estimate("signature", "other_signature") >= percent / 100 - SLACK)
        & (F.size(F.array_intersect(rarest("rare", "most"), rarest("other_rare", "other_most"))) >= k))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Group documents whose sets of word shingles have a similarity of ``percent`` or more.

    Words are split at blanks after lower-casing A-Z. Documents with the same set form a class, which
    all later work counts once. Each class has minima of its shingles under 96 hash functions. Four
    minima make a band; classes that share one of 24 bands are candidates. The low four bits of each
    minimum, packed in six longs, estimate the similarity of candidates by counting equal fields;
    pairs whose estimate is far too low are left out, all others are confirmed on the full sets.

    Links inside a bucket are found without forming all its pairs: every member is compared with the
    member that shares most buckets with others; then, in buckets that don't belong together yet, with
    one that shares most among the rest; at last members that are still apart are compared with the
    members of other groups, unless a bound from the shingles they have alone tells that they can't be
    near. So a bucket costs a few pairs per member, and no near pair of two groups is left untested.

    Returns one row per row of docs: doc_id, n_shingles, component_id (smallest id reachable over
    links) and kept (whether it is the document's own). A text without words is linked with nothing.
    NULL ids never give a component its name, unless it has no other; rows that share an id are one
    document with several sets.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_hash"))
    sketch = cut_lineage(docs.mapInArrow(lambda it: _sketch(it, words), SKETCH), "minhash")
    classes = cut_lineage(sketch.where("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.first(F.struct("doc_id", "text_hash")).alias("row"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"),
        F.first("signature").alias("signature")), "classes")

    band = classes.select("node", F.explode("bands").alias("band"))
    shared = band.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    member = cut_lineage(band.join(shared, "band"), "members")
    popular = member.groupBy("node").agg(F.sum("size").alias("pop"))
    member = cut_lineage(member.select("band", "node").join(popular, "node"), "members")
    signature = classes.join(popular, "node", "left_semi").select("node", "row", "n", "signature", "bands")
    sets = _sets(docs, signature.select("row", "node"), words)

    def link(pairs: DataFrame) -> DataFrame:
        one = signature.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("signature").alias("ga"))
        two = signature.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("signature").alias("gb"))
        likely = pairs.join(one, "a").join(two, "b").where(
            (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (estimate("ga", "gb") >= percent / 100 - SLACK))
        return cut_lineage(_confirmed(likely.select("a", "b"), sets, percent), "links")

    def pair(x: str, y: str) -> list[Column]:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    tested: list[DataFrame] = []
    group = None
    labelled = member.withColumn("label", F.col("node"))
    for number in range(ROUNDS + 1):
        lead = labelled.groupBy("band").agg(F.max(F.struct("pop", "node", "label")).alias("lead"), F.min("label").alias("low"),
                                            F.max("label").alias("high")).where("low <> high").select("band", "lead")
        apart = cut_lineage(labelled.join(lead, "band"), "apart")
        if apart.isEmpty():
            break
        rest = apart.where("label <> lead.label") if number else apart
        if number < ROUNDS:
            centre = rest.groupBy("band").agg(F.max(F.struct("pop", "node", "label")).alias("c"))
            new = apart.join(centre, "band").where("label <> c.label").select(*pair("node", "c.node"))
        else:
            new = _pairs_apart(apart, signature, sets, percent).select(*pair("node", "other"))
        new = new.distinct()
        if tested:
            new = new.join(union_all(tested), ["a", "b"], "left_anti")
        tested.append(cut_lineage(new, "pairs"))
        found = link(tested[-1])
        if found.isEmpty():
            continue
        # A group is a star around its component, which says all that its links do.
        stars = [] if group is None else [group.select(F.col("node").alias("a"), F.col("component").alias("b"))]
        group = cut_lineage(connected_components(union_all([*stars, found]), "a", "b"), "groups")
        labelled = cut_lineage(member.join(group, "node", "left").select("band", "node", "pop", F.coalesce("component", "node").alias("label")), "labels")

    if group is None:
        group = classes.where(F.lit(False)).select("node", F.col("node").alias("component"))
    least = group.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    of_node = group.join(least, "component").select("node", "component_id")
    named = classes.select("node", "rep").join(of_node, "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id"))
    rows = sketch.select("doc_id", "n_shingles", "node")
    # Copies by the thousand share a node; texts without words have none.
    found = spread_join(rows.where("node IS NOT NULL"), named, ["node"], "left").unionByName(rows.where("node IS NULL"), allowMissingColumns=True)
    return found.select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near duplicates of smaller id: docs with its columns. Rows without an id stay."""
    gone = near_duplicates(docs, words, percent, doc_id, text).where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(doc_id)).distinct()
    return docs.join(gone, doc_id, "left_anti")
