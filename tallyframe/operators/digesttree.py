"""Trees of digests over key ranges: a stored tree tells where two tables differ without reading their rows.

A leaf holds the rows of ``width`` successive values of a whole-number key: their number, the sum and the
XOR of their hashes. A node of a higher level holds ``FANOUT`` nodes of the one below. All three figures
add up, so a tree is built in one aggregate of the rows, and higher levels from the leaves alone. Rows with
a NULL key are in a leaf of their own, NULL on every level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.common import cut_lineage, union_all
from tallyframe.operators.reconcile import column_diffs, digest

FANOUT = 256
# With so many levels above the leaves, the top has one node per 256^3 leaves.
LEVELS = 3
# Up to so many ranges are conditions of the scan, which skips files by them; more are joined.
MOST_RANGES = 200


def row_hash(columns: Sequence[str]) -> Column:
    """64 bits of a row's typed values, NULLs by position."""
    return digest([F.col(f"`{c}`") for c in columns])["h0"]


def digest_tree(df: DataFrame, key: str, hashed: Column, width: int, levels: int = LEVELS) -> DataFrame:
    """level (0: leaves), node, n_rows, sum_hash decimal(38,0), xor_hash. Store it next to the table, partitioned by level.

    Sum and XOR of one hash are two tests, so copies that cancel in the XOR still show in the sum."""
    figures = [F.sum("n_rows").alias("n_rows"), F.sum("sum_hash").cast("decimal(38,0)").alias("sum_hash"), F.bit_xor("xor_hash").alias("xor_hash")]
    rows = df.select(leaf_of(key, width).alias("node"), hashed.alias("h"))
    leaves = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("h").cast("decimal(20,0)")).cast("decimal(38,0)").alias("sum_hash"),
                                      F.bit_xor("h").alias("xor_hash"))
    # Every leaf goes into each level once, and is combined with its neighbours before the shuffle.
    steps = F.sequence(F.lit(0), F.lit(levels))
    up = leaves.select(F.explode(steps).alias("level"), "*")
    return up.groupBy("level", _parent("node", F.element_at(F.array(*[F.lit(FANOUT**i).cast("long") for i in range(levels + 1)]), F.col("level") + 1)).alias("node")).agg(*figures)


def leaf_of(key: str, width: int) -> Column:
    """The number of a key's leaf."""
    return _parent(key, F.lit(width).cast("long"))


def _parent(node: str, of: Column) -> Column:
    """The whole quotient, rounded down for negative numbers too, without doubles."""
    n = F.col(f"`{node}`").cast("long")
    return F.call_function("div", n, of) - F.when(F.pmod(n, of) != F.call_function("mod", n, of), 1).otherwise(0)


def differing_leaves(a: DataFrame, b: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Numbers of the leaves (NULL: that of rows without key) that two trees of one width differ in.

    From the top down, only the children of differing nodes are compared."""
    figures = F.struct("n_rows", "sum_hash", "xor_hash").alias("d")
    nodes = union_all([t.select("level", "node", figures) for t in (a, b)])
    found = None
    for i in range(levels, -1, -1):
        here = nodes.where(F.col("level") == i).drop("level")
        if found is not None:
            up, over = _parent("node", F.lit(FANOUT).cast("long")), found.withColumnRenamed("node", "over")
            here = here.withColumn("up", up).join(over, F.col("up").eqNullSafe(F.col("over")), "left_semi").drop("up")
        same = (F.count(F.lit(1)) == 2) & (F.min("d") == F.max("d"))
        found = here.groupBy("node").agg(same.alias("same")).where("NOT same").select("node")
    return found


def key_ranges(leaves: DataFrame) -> DataFrame:
    """Successive leaves as ranges: first and last leaf. Leaves are looked at in blocks of 4,096, so two ranges may touch."""
    block = Window.partitionBy(F.shiftright("node", 12)).orderBy("node")
    runs = leaves.where("node IS NOT NULL").withColumn("run", F.col("node") - F.row_number().over(block))
    return runs.groupBy(F.shiftright("node", 12).alias("block"), "run").agg(F.min("node").alias("first"), F.max("node").alias("last")).drop("block", "run")


def rows_of_leaves(df: DataFrame, key: str, width: int, leaves: DataFrame) -> DataFrame:
    """The rows of some leaves. Few ranges become conditions on the key, by which Parquet skips files and row
    groups; beyond MOST_RANGES the leaves are joined. ``leaves`` should be a written table: it is read twice."""
    ranges = key_ranges(leaves).limit(MOST_RANGES + 1).collect()
    if len(ranges) > MOST_RANGES:
        # NULL-safe, so that rows without key meet their leaf.
        return df.withColumn("__leaf", leaf_of(key, width)).join(leaves.withColumnRenamed("node", "__node"), F.col("__leaf").eqNullSafe(F.col("__node")), "left_semi").drop("__leaf")
    wanted = F.lit(False)
    for r in ranges:
        wanted = wanted | F.col(key).between(F.lit(r["first"] * width), F.lit(r["last"] * width + width - 1))
    if leaves.where("node IS NULL").limit(1).count():
        wanted = wanted | F.col(key).isNull()
    return df.where(wanted)


def tree_column_diffs(src: DataFrame, dst: DataFrame, src_tree: DataFrame, dst_tree: DataFrame, key: str, width: int,
                      columns: Sequence[str] | None = None, levels: int = LEVELS) -> DataFrame:
    """``column_diffs`` of two tables with stored trees: only rows of leaves that differ are read."""
    leaves = cut_lineage(differing_leaves(src_tree, dst_tree, levels), "leaves")
    return column_diffs(*[rows_of_leaves(df, key, width, leaves) for df in (src, dst)], [key], columns)


def updated_tree(tree: DataFrame, removed: DataFrame, added: DataFrame, key: str, hashed: Column, width: int, levels: int = LEVELS) -> DataFrame:
    """The tree after a change, from the images that went and those that came; the table is not read."""
    gone = digest_tree(removed, key, hashed, width, levels).withColumns(
        {"n_rows": -F.col("n_rows"), "sum_hash": (-F.col("sum_hash")).cast("decimal(38,0)")})
    both = union_all([tree, gone, digest_tree(added, key, hashed, width, levels)])
    return both.groupBy("level", "node").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("sum_hash").cast("decimal(38,0)").alias("sum_hash"), F.bit_xor("xor_hash").alias("xor_hash")).where("n_rows <> 0")
