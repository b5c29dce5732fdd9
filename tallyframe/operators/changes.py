"""Change application, merge, repair plans, sync planning and history tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.common import spread_join
from tallyframe.sources.changefeed import META, last_change_per_key


def apply_changes(target: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The target after a change feed: only the last image of a key counts, deletes remove it."""
    last = last_change_per_key(changes, keys)
    kept = spread_join(target, last.select(*keys), keys, "left_anti").select(*target.columns)
    live = last.where(F.col("_change_type") != "delete").drop(*META)
    return kept.unionByName(live.select(*target.columns))


def any_null(keys: Sequence[str]):
    """Whether a key has a NULL part."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(f"`{k}`").isNull()
    return null


def one_image(source: DataFrame, keys: Sequence[str], columns: Sequence[str], order: str | None = None) -> DataFrame:
    """A row per key without NULL parts: its image as struct ``__src`` of the columns and ``__hit``, true.

    With ``order`` the last image by it; else a repeated key raises an error."""
    image = F.struct(*columns, F.lit(True).alias("__hit"))
    found = source.where(~any_null(keys)).groupBy(*keys)
    if order:
        return found.agg(F.max_by(image, F.col(order)).alias("__src"))
    return found.agg(F.first(image).alias("__src"), F.count(F.lit(1)).alias("__n")).select(
        *keys, F.when(F.col("__n") > 1, F.raise_error("a key is repeated in the source of a merge")).otherwise(F.col("__src")).alias("__src"))


def merge(target: DataFrame, source: DataFrame, keys: Sequence[str], delete_missing: bool = False, order: str | None = None) -> DataFrame:
    """Upsert: matched target rows take the source values, unmatched source rows are added, and
    unmatched target rows stay unless ``delete_missing``.

    A key repeated in the source is an error when the merge runs, unless ``order`` names a column of
    the source: then the last image by it counts. Keys with a NULL part match nothing."""
    cols = target.columns
    rest = [c for c in cols if c not in keys]
    src = one_image(source, keys, rest, order)
    source = src.select(*keys, "__src.*").drop("__hit").unionByName(source.where(any_null(keys)).select(*keys, *rest))
    how = "inner" if delete_missing else "left"
    hit = F.col("__src.__hit")
    updated = spread_join(target, src, keys, how).select(
        *[F.col(c) if c in keys else F.when(hit, F.col(f"__src.`{c}`")).otherwise(F.col(c)).alias(c) for c in cols])
    added = source.join(target.select(*keys).distinct(), list(keys), "left_anti").select(*cols)
    return updated.unionByName(added)


def repair_plan(source: DataFrame, dest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What has to happen to dest so that it equals source.

    Keys with at most one row on each side give one row with an action (insert, update, delete) and
    the new image. Keys repeated on a side give a row per image whose numbers of copies differ: insert,
    or delete_copies with the image to remove, and how many ``copies``."""
    from tallyframe.operators.reconcile import paired_images, repeated_key_changes

    cols = [c for c in source.columns if c not in keys]
    p = paired_images(source, dest, keys, cols).where("n_source <= 1 AND n_dest <= 1")
    action = (F.when(F.col("n_dest") == 0, "insert").when(F.col("n_source") == 0, "delete")
              .when(~F.col("s").eqNullSafe(F.col("d")), "update"))
    single = p.withColumn("action", action).where("action IS NOT NULL").select(*keys, "action", "s.*", F.lit(1).cast("long").alias("copies"))
    return single.unionByName(repeated_key_changes(source, dest, keys))


def repair_frames(source: DataFrame, dest: DataFrame, keys: Sequence[str] | None) -> dict[str, DataFrame]:
    """Repair as frames: insert (each copy a row), delete, update, delete_copies; without keys the whole source replaces dest."""
    if not keys:
        return {"full_replace": source}
    plan = repair_plan(source, dest, keys)
    frames = {a: plan.where(F.col("action") == a).drop("action") for a in ("insert", "delete", "update", "delete_copies")}
    frames["insert"] = frames["insert"].withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return {a: f if a == "delete_copies" else f.drop("copies") for a, f in frames.items()}


def sync_or_replace(target: DataFrame, source: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Apply changes when a key is known, else take the source as it is."""
    return apply_changes(target, changes, keys) if keys else source.select(*target.columns)


def change_summary(changes: DataFrame) -> DataFrame:
    """Rows per change type and the latest version of each."""
    return changes.groupBy("_change_type").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("_commit_version").alias("latest_version"))


def tables_to_sync(history: DataFrame, state: DataFrame, writes_only: Sequence[str] = ()) -> DataFrame:
    """Tables with operations newer than their synced version.

    history: (table_name, version, operation); state: (table_name, last_version).
    """
    h = history.where(F.col("operation").isin(*writes_only)) if writes_only else history
    per_op = h.groupBy("table_name", "version", "operation").agg(F.count(F.lit(1)).alias("n"))
    j = per_op.join(state, "table_name", "left")
    new = j.where(F.col("last_version").isNull() | (F.col("version") > F.col("last_version")))
    return new.groupBy("table_name").agg(
        F.sum("n").alias("n_operations"), F.array_join(F.array_sort(F.collect_set("operation")), ",").alias("operations"),
        F.max("version").alias("current_version"),
        F.when(F.max("last_version").isNull(), "never_synced").otherwise("changed").alias("reason"))


def sync_state_counts(state: DataFrame) -> DataFrame:
    """Tables by state (columns last_status, is_stale): a failed table may be stale as well."""
    ok, stale = F.col("last_status") == "success", F.col("is_stale")
    return state.agg(F.count(F.lit(1)).alias("total"), F.count_if(ok & ~stale).alias("synced"), F.count_if(stale).alias("stale"),
                     F.count_if(F.col("last_status") == "failed").alias("failed"))


def scd2(versions: DataFrame, keys: Sequence[str], changed_at: str, end: str = "9999-12-31") -> DataFrame:
    """Validity intervals from dated images: valid_to is the start of the next version of the key.

    The next start is looked up within ranges of time that hold about equally many rows, so a key
    with very many versions is sorted in pieces; the last version of a piece takes the first start
    of the key's next piece. NULL is a key like any other."""
    from pyspark.sql import Window

    from tallyframe.common import quantile_buckets

    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    timed = versions.withColumn("__t", F.timestamp_diff("SECOND", epoch, F.col(changed_at).cast("timestamp_ntz")).cast("double"))
    # As fields of a struct, NULL keys are equal.
    cut = quantile_buckets(timed, timed, "__t", "__piece").drop("__t").withColumn("__key", F.struct(*keys))
    firsts = cut.groupBy("__key", "__piece").agg(F.min(changed_at).alias("__first"))
    after = firsts.select("__key", "__piece", F.lead("__first").over(Window.partitionBy("__key").orderBy("__piece")).alias("__after"))
    inside = cut.withColumn("__next", F.lead(changed_at).over(Window.partitionBy("__key", "__piece").orderBy(changed_at)))
    j = spread_join(inside, after, ["__key", "__piece"], "left", hot_from=cut)
    nxt = F.coalesce("__next", "__after")
    return j.select(
        *[c for c in versions.columns if c != changed_at], F.col(changed_at).alias("valid_from"),
        F.coalesce(nxt, F.lit(end).cast("timestamp_ntz")).alias("valid_to"), nxt.isNull().alias("is_current"))


def lookup_as_of(facts: DataFrame, dim: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """The dimension version valid at the time of every fact (keys + interval)."""
    from tallyframe.operators.relational import interval_join

    return interval_join(facts, dim, keys, at, "valid_from", "valid_to", "inner", bucket_days=365)


RETENTION_UNIT_DAYS = {"d": 1, "w": 7, "m": 30, "y": 365}


def retention_days(text: str) -> int:
    """Days named by 7d / 2w / 6m / 1y."""
    t = text.strip().lower()
    if len(t) < 2 or t[-1] not in RETENTION_UNIT_DAYS or not t[:-1].isdigit():
        raise ValueError(f"not a retention period: {text!r}")
    return int(t[:-1]) * RETENTION_UNIT_DAYS[t[-1]]


def retention_days_col(col):
    """The same for a column of texts; NULL when a text is no retention period."""
    t = F.lower(F.trim(col))
    unit = F.right(t, F.lit(1))
    n = F.when(t.rlike("^[0-9]+[dwmy]$"), F.regexp_extract(t, "^([0-9]+)", 1).cast("int"))
    factor = F.element_at(F.create_map(*[F.lit(x) for kv in RETENTION_UNIT_DAYS.items() for x in kv]), unit)
    return n * factor


def retention_status(df: DataFrame, created: str, days, as_of, warn_days: int = 3) -> DataFrame:
    """Expiry time, whether expired or expiring soon, and a status text."""
    from tallyframe.common import as_ts

    now = as_ts(as_of)
    expires = F.timestamp_add("DAY", days, F.col(created).cast("timestamp_ntz"))
    left = F.datediff("expires_at", now)
    gone = F.col("expires_at") < now
    return df.withColumn("expires_at", expires).select(
        "*", gone.alias("expired"), (~gone & (left <= warn_days)).alias("expiring_soon"),
        F.when(gone, "EXPIRED").otherwise(F.concat(left.cast("string"), F.lit(" days remaining"))).alias("status"))


def two_way_plan(source: DataFrame, dest: DataFrame, on: Sequence[str], drop_extra: bool = False) -> DataFrame:
    """Objects to add to the destination and, only if asked, objects to drop from it."""
    add = source.join(dest, list(on), "left_anti").select(*on, F.lit("add").alias("action"))
    if not drop_extra:
        return add
    return add.unionByName(dest.join(source, list(on), "left_anti").select(*on, F.lit("drop").alias("action")))
