"""Dependency and lineage graphs given as edges (src, dst): dst depends on src."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tallyframe.common import cut_lineage, spread_join, union_all

PART = r"(?:`[^`]+`|\w+)"


def table_references(sql_text: Column, default_catalog: str) -> Column:
    """Distinct tables named in an SQL text: three-part names anywhere, and two-part names after
    FROM, JOIN or TABLE with the default catalog in front. A name of three parts also counts with
    its first two parts when it follows such a word."""
    three = F.transform(F.regexp_extract_all(sql_text, F.lit(rf"({PART}\.{PART}\.{PART})"), 1), lambda x: F.replace(x, F.lit("`"), F.lit("")))
    two = F.transform(F.regexp_extract_all(sql_text, F.lit(rf"(?i)(?:FROM|JOIN|TABLE)\s+({PART}\.{PART})"), 1),
                      lambda x: F.concat(F.lit(f"{default_catalog}."), F.replace(x, F.lit("`"), F.lit(""))))
    return F.array_distinct(F.concat(three, two))


def edges_from_definitions(views: DataFrame, name: str, definition: str, default_catalog: str) -> DataFrame:
    refs = views.select(F.col(name).alias("dst"), F.explode(table_references(F.col(definition), default_catalog)).alias("src"))
    return refs.where("src <> dst").select("src", "dst").distinct()


def node_roles(edges: DataFrame) -> DataFrame:
    """Per node: whether it is a root (depends on nothing), a leaf (nothing depends on it) or neither."""
    n = union_all([edges.select(F.col("src").alias("node"), F.lit(1).alias("used"), F.lit(0).alias("uses")),
                   edges.select(F.col("dst").alias("node"), F.lit(0).alias("used"), F.lit(1).alias("uses"))])
    g = n.groupBy("node").agg(F.sum("used").alias("n_dependants"), F.sum("uses").alias("n_dependencies"))
    return g.withColumn("role", F.when(F.col("n_dependencies") == 0, "root").when(F.col("n_dependants") == 0, "leaf").otherwise("inner"))


def reachable(edges: DataFrame, start: DataFrame, depth: int = 5, direction: str = "downstream") -> DataFrame:
    """Edges met when walking from the start nodes, with the hop at which each is first met.

    A hop joins the frontier, the nodes first met at the hop before, to the edges that leave it.
    The edges met are written once per hop; the next frontier is read from those files."""
    near, far = ("src", "dst") if direction == "downstream" else ("dst", "src")
    e = cut_lineage(edges.select("src", "dst").distinct(), "hop")
    n = e.count()
    frontier = start.select(F.col("node").alias(near)).distinct()
    seen, parts = [frontier], []
    for hop in range(1, depth + 1):
        met = cut_lineage(spread_join(e, frontier, [near], "left_semi", known_rows=n).select("src", "dst", F.lit(hop).alias("hop")), "hop")
        if met.isEmpty():
            break
        parts.append(met)
        ends = met.select(F.col(far).alias(near)).distinct()
        frontier = ends.join(union_all(seen), near, "left_anti")
        seen.append(ends)
    if not parts:
        return e.where(F.lit(False)).select("src", "dst", F.lit(0).alias("hop"), F.lit(direction).alias("direction"))
    return union_all(parts).withColumn("direction", F.lit(direction))


def lineage(edges: DataFrame, start: DataFrame, depth: int = 5, at: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Upstream and downstream edges of the start nodes, optionally of a time range (inclusive days)."""
    e = edges
    if since:
        e = e.where(F.col(at) >= F.lit(since).cast("timestamp_ntz"))
    if until:
        e = e.where(F.col(at) < F.timestamp_add("DAY", F.lit(1), F.lit(until).cast("timestamp_ntz")))
    return reachable(e, start, depth, "upstream").unionByName(reachable(e, start, depth, "downstream"))


#: Stands for the level of nodes on or behind a cycle; more than any path is long.
ENDLESS = 1 << 40


def _shortcuts(chain: DataFrame, n: int) -> DataFrame:
    """Nodes with a single dependency, each tied to the nearest node before it that isn't one of them.

    chain: (node, parent, w, base), which says level(node) = max(base, level(parent) + w). Pointer doubling: a
    step replaces a parent by the parent's parent and composes what both say, so paths halve and
    a chain of n nodes takes log2(n) steps. What is still tied to a node of the chain afterwards runs in
    a circle: ``open`` is true for it."""
    for _ in range(n.bit_length() + 1):
        nearer = chain.select(F.col("node").alias("parent"), F.col("parent").alias("up"), F.col("w").alias("w2"), F.col("base").alias("base2"), F.lit(True).alias("open"))
        step = spread_join(chain.drop("open"), nearer, ["parent"], "left", known_rows=n).select(
            "node", F.coalesce("up", "parent").alias("parent"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w"),
            F.greatest("base", F.coalesce(F.col("base2") + F.col("w"), F.col("base"))).alias("base"), F.coalesce("open", F.lit(False)).alias("open"))
        left = Observation()
        chain = cut_lineage(step.observe(left, F.count_if("open").alias("n")), "chain")
        if left.get["n"] == 0:
            break
    return chain


def topological_levels(edges: DataFrame, nodes: DataFrame | None = None, max_levels: int | None = None) -> DataFrame:
    """Level of every node (dependencies come first, level 0 depends on nothing); nodes on or
    behind a cycle have no level and are flagged.

    The graph is contracted. Each round gives nodes without open dependencies their level and passes it on
    (rake); nodes with a single dependency are tied to the next node before them that has none or several,
    by pointer doubling, and leave the graph (compress). So a chain or a tree of any depth takes a few
    rounds of logarithmically many steps; in other graphs a round takes at least one level off. The tied
    nodes get their levels when the ones they are tied to have theirs. Edges carry the length of the path
    they stand for. If ``max_levels`` is given and more are needed, an error is raised."""
    known = union_all([edges.select(F.col("src").alias("node")), edges.select(F.col("dst").alias("node"))]
                      + ([nodes.select("node")] if nodes is not None else [])).distinct()
    zero = F.lit(0).cast("long")
    rest = cut_lineage(known.select("node", zero.alias("base")), "topo")
    left = cut_lineage(edges.select("src", "dst").distinct().withColumn("w", F.lit(1).cast("long")), "topo")
    solved, tied = [], []
    while True:
        into = left.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.first("src").alias("parent"), F.first("w").alias("w"))
        total = Observation()
        state = cut_lineage(rest.join(into, "node", "left").observe(total, F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("n").isNull()).alias("roots"), F.count_if(F.col("n") == 1).alias("single"),
                                                                     F.coalesce(F.sum("n"), F.lit(0)).alias("edges")), "topo")
        roots, single = total.get["roots"], total.get["single"]
        if not roots and not single:
            # Every node left has dependencies among those left: all are on or behind a cycle.
            solved.append(state.select("node", F.lit(ENDLESS).alias("level")))
            break
        level = state.where("n IS NULL").select("node", F.col("base").alias("level"))
        solved.append(level)
        if total.get["edges"] == 0:
            break
        ends = [level.select(F.col("node").alias("src"), F.lit(None).cast(state.schema["node"].dataType).alias("parent"), zero.alias("plus"), F.col("level").alias("fixed"))]
        # Chains are worth their steps when they are a good part of what is left.
        compress = single and (not roots or 4 * single >= total.get["nodes"] - roots)
        if compress:
            chain = _shortcuts(state.where("n = 1").select("node", "parent", "w", "base"), single)
            circle = chain.where("open").select("node", F.lit(ENDLESS).alias("level"))
            solved.append(circle)
            tied.append(chain.where("NOT open").select("node", "parent", "w", "base"))
            ends.append(circle.select(F.col("node").alias("src"), F.lit(None).cast(state.schema["node"].dataType).alias("parent"), zero.alias("plus"), F.col("level").alias("fixed")))
            ends.append(tied[-1].select(F.col("node").alias("src"), "parent", F.col("w").alias("plus"), F.col("base").alias("fixed")))
        # What is left are nodes with several dependencies (or, without tying, with any). An edge from a node that leaves becomes a bound
        # and, if that node is tied, an edge from the one it is tied to; that one may be a root as well.
        several = state.where("n > 1" if compress else "n > 0").select("node", "base")
        inner = left.join(several.select(F.col("node").alias("dst")), "dst", "left_semi")
        one = spread_join(inner, union_all(ends), ["src"], "left", known_rows=total.get["edges"]).select(
            "dst", F.when(F.col("fixed").isNull(), F.col("src")).otherwise(F.col("parent")).alias("src"), (F.col("w") + F.coalesce("plus", F.lit(0))).alias("w"),
            (F.col("fixed") + F.col("w")).alias("bound"))
        two = cut_lineage(spread_join(one, level.select(F.col("node").alias("src"), "level"), ["src"], "left", known_rows=total.get["edges"]).select(
            "dst", F.when(F.col("level").isNull(), F.col("src")).alias("src"), "w",
            F.when(F.col("src") == F.col("dst"), F.lit(ENDLESS)).otherwise(F.greatest("bound", F.col("level") + F.col("w"))).alias("bound")), "topo")
        bounds = two.groupBy(F.col("dst").alias("node")).agg(F.max("bound").alias("bound"))
        rest = several.join(bounds, "node", "left").select("node", F.greatest("base", F.coalesce("bound", "base")).alias("base"))
        # Nothing can be added to an endless level.
        done = bounds.where(F.col("bound") >= ENDLESS).select(F.col("node").alias("dst"))
        left = two.where("src IS NOT NULL").join(done, "dst", "left_anti").groupBy("src", "dst").agg(F.max("w").alias("w"))
    levels = cut_lineage(union_all(solved), "levels")
    for chain in reversed(tied):
        found = spread_join(chain, levels.withColumnRenamed("node", "parent"), ["parent"]).select("node", F.greatest("base", F.col("level") + F.col("w")).alias("level"))
        levels = cut_lineage(levels.unionByName(found), "levels")
    if max_levels is not None and levels.where((F.col("level") < ENDLESS) & (F.col("level") >= max_levels)).head(1):
        raise RuntimeError(f"nodes are left after {max_levels} levels")
    return levels.select("node", F.when(F.col("level") < ENDLESS, F.col("level")).cast("int").alias("level"), (F.col("level") >= ENDLESS).alias("on_cycle"))


def column_usage(lineage_rows: DataFrame) -> DataFrame:
    """Uses, distinct downstream columns and last use per source column."""
    return lineage_rows.groupBy("source_table", "source_column").agg(
        F.count(F.lit(1)).alias("usage_count"), F.count_distinct(F.struct("target_table", "target_column")).alias("downstream_count"),
        F.max("used_at").alias("last_used"))


def impact(edges: DataFrame, kinds: DataFrame, threshold: int = 10) -> DataFrame:
    """Dependants by kind and risk per node: low without any, medium up to the threshold, else high.

    edges: (src, dst); kinds: (node, kind)."""
    j = spread_join(edges.select("src", F.col("dst").alias("node")).distinct(), kinds, ["node"])
    per_kind = j.groupBy("src", "kind").agg(F.count(F.lit(1)).alias("n"))
    per_node = per_kind.groupBy(F.col("src").alias("node")).agg(
        F.sum("n").alias("n_dependants"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "kind", "n"))), ",").alias("by_kind"))
    out = kinds.select("node").join(per_node, "node", "left").select("node", F.coalesce("n_dependants", F.lit(0)).alias("n_dependants"), F.coalesce("by_kind", F.lit("")).alias("by_kind"))
    n = F.col("n_dependants")
    return out.withColumn("risk", F.when(n == 0, "low").when(n <= threshold, "medium").otherwise("high"))


def lookup(rows: DataFrame, table: str, source: str, dest: str) -> DataFrame:
    """Lineage rows in which a table is source or destination."""
    return rows.where((F.col(source) == table) | (F.col(dest) == table))
