"""Golden records: ingest, survivorship, merge, split, hierarchies, dashboards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.common import cut_lineage, spread_join


def ingest(df: DataFrame, key: str, source: str, trust: float, at: Column) -> DataFrame:
    """Source records: key, attributes as a text map without NULLs, trust score and ingest time."""
    attrs = F.create_map(*[x for c in df.columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))])
    return df.where(F.col(key).isNotNull()).select(
        F.concat_ws(":", F.lit(source), F.col(key).cast("string")).alias("source_record_id"), F.lit(source).alias("source_system"),
        F.col(key).cast("string").alias("source_key"), F.map_filter(attrs, lambda k, v: v.isNotNull()).alias("attributes"),
        F.lit(float(trust)).alias("trust_score"), at.alias("ingested_at"))


STRATEGIES = ("most_trusted", "most_recent", "most_complete", "longest")


def survive(records: DataFrame, entity: str, strategies: Mapping[str, str], default: str = "most_trusted") -> DataFrame:
    """One value per entity and attribute by strategy; ties go to the smallest record id.

    records: entity column, source_record_id, attributes map, trust_score, ingested_at. Each value
    is chosen by an aggregate, so a large entity is reduced before the shuffle."""
    filled = F.size(F.map_filter("attributes", lambda k, v: v != ""))
    long = records.select(entity, "source_record_id", "trust_score", "ingested_at", filled.alias("filled"), F.explode("attributes").alias("attribute", "value"))
    strat = F.lit(default)
    for a, s in strategies.items():
        if s not in STRATEGIES:
            raise ValueError(f"unknown strategy {s!r}")
        strat = F.when(F.col("attribute") == a, s).otherwise(strat)
    # a smaller record id must win, and order keys are maximised: pick the least of negated measures
    recent = -F.unix_micros(F.col("ingested_at").cast("timestamp")).cast("double")
    rank = (F.when(F.col("strategy") == "most_trusted", -F.col("trust_score")).when(F.col("strategy") == "most_recent", recent)
            .when(F.col("strategy") == "most_complete", -F.col("filled").cast("double")).otherwise(-F.length("value").cast("double")))
    best = F.min_by("value", F.struct(F.col("rank"), F.col("source_record_id")))
    return (long.withColumn("strategy", strat).withColumn("rank", rank).groupBy(entity, "attribute").agg(best.alias("value")))


def golden_records(values: DataFrame, entity: str) -> DataFrame:
    """Attribute values of an entity as one map (as many entries as attributes)."""
    return values.groupBy(entity).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("attribute", "value")))).alias("attributes"))


def merge_pair(a: Column, b: Column) -> Column:
    """Union of two attribute maps; the first filled value of a, then b, wins."""
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(F.nullif(x, F.lit("")), y, x))


def split_entities(links: DataFrame, golden: DataFrame, split: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Undo merges: the split entities vanish and their source records are unlinked.

    links: (source_record_id, entity_id); split: (entity_id)."""
    s = split.select("entity_id").distinct()
    hit = spread_join(links, s.withColumn("__split", F.lit(True)), ["entity_id"], "left")
    freed = hit.select("source_record_id", F.when(F.col("__split").isNull(), F.col("entity_id")).alias("entity_id"))
    return freed, golden.join(s, "entity_id", "left_anti")


def _climb(state: DataFrame, rows: int, more: dict) -> DataFrame:
    """Replace every pointer ``up`` by that node's own until none is left, or all that are left run in
    circles. ``more`` says how columns follow; ``lost`` marks nodes that hang on no listed root."""
    reach = 1
    while reach <= rows and not state.where("up IS NOT NULL AND NOT lost").isEmpty():
        above = state.withColumnsRenamed({c: f"__{c}" for c in state.columns})
        j = spread_join(state.withColumn("__node", F.col("up")), above, ["__node"], "left", known_rows=rows)
        found = F.col("__lost").isNotNull()
        state = cut_lineage(j.select(
            "node", "parent", F.when(found, F.col("__up")).otherwise(F.col("up")).alias("up"),
            (F.col("lost") | (F.col("up").isNotNull() & ~found) | F.coalesce("__lost", F.lit(False))).alias("lost"),
            *[F.when(found, how).otherwise(F.col(c)).alias(c) for c, how in more.items()]), "tree")
        reach *= 2
    return state


def hierarchy_paths(nodes: DataFrame, sep: str = "/") -> DataFrame:
    """Level and path of every node of a forest given by parent pointers (node, parent), of any depth.

    Every node knows some ancestor and the way from there; a round puts that ancestor's way in front
    of it, so a tree of n levels takes log2(n) rounds: first without paths, to know the nodes that hang
    on a root, then with paths for these. Nodes on a cycle and below one have on_cycle and neither level
    nor path; nodes below a parent that isn't listed have none either."""
    start = cut_lineage(nodes.select("node", "parent", F.col("parent").alias("up"), F.lit(False).alias("lost")), "tree")
    rows = start.count()
    ends = _climb(start, rows, {})
    rooted = ends.where("up IS NULL AND NOT lost").select("node", "parent", F.col("parent").alias("up"), "lost", F.lit(0).cast("long").alias("level"),
                                                         F.col("node").cast("string").alias("path"))
    paths = _climb(cut_lineage(rooted, "tree"), rows, {"level": F.col("level") + F.col("__level") + 1, "path": F.concat_ws(sep, "__path", "path")})
    none = F.lit(None)
    rest = ends.where("up IS NOT NULL OR lost").select("node", "parent", none.cast("int").alias("level"), none.cast("string").alias("path"), (~F.col("lost")).alias("on_cycle"))
    return paths.select("node", "parent", F.col("level").cast("int").alias("level"), "path", F.lit(False).alias("on_cycle")).unionByName(rest)


def move_node(nodes: DataFrame, node, new_parent) -> DataFrame:
    """Hang a node, and with it its subtree, under another parent."""
    return nodes.withColumn("parent", F.when(F.col("node") == node, F.lit(new_parent)).otherwise(F.col("parent")))


def hierarchy_summary(paths: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return paths.groupBy(*by).agg(F.count(F.lit(1)).alias("node_count"), F.max("level").alias("max_depth"))


def stewardship_stats(tasks: DataFrame) -> DataFrame:
    """Tasks in all, open, open with high priority, resolved."""
    is_open = F.col("status") == "open"
    return tasks.agg(F.count(F.lit(1)).alias("total"), F.count_if(is_open).alias("open"),
                     F.count_if(is_open & (F.col("priority") == "high")).alias("high_priority"), F.count_if(~is_open).alias("resolved"))


def entity_stats(entities: DataFrame) -> DataFrame:
    return entities.groupBy("entity_type", "status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence_score"), 6).alias("avg_confidence"))
