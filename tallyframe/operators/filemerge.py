"""Change application and merges for tables of Parquet files that rewrite only the files whose rows change.

A table is a folder of lists: each version lists the files that make it up (state ``kept`` or ``written``)
and those it no longer has (``replaced``). The list is written last, so a run that dies leaves the
version before it in place and is simply run again; a version that is already listed is not applied twice.
Replaced files stay for readers of older versions, until their owner removes them. One writer at a time.

The number of files grows with the table, and their names pass the driver, as they do in any file scan;
rows never do.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.common import cut_lineage, spread_join
from tallyframe.operators.changes import apply_changes, merge, one_image
from tallyframe.sources.changefeed import last_change_per_key

FILE = "__file"
LIST = "path string, state string"
# A rewritten set of files gets as many files as it had, and one more for so many new rows.
ROWS_PER_FILE = 1_000_000


def list_table(spark: SparkSession, path: str, folder: str) -> None:
    """Version 0 in ``folder``: the files of the Parquet table at ``path``, which stay where they are.

    Columns that only folder names hold are not part of it."""
    table = spark.read.option("recursiveFileLookup", True).parquet(path)
    spark.createDataFrame([], table.schema).write.parquet(f"{folder}/schema")
    _write_list(files_of(table, "kept"), folder, 0)


def files_of(table: DataFrame, state: str) -> DataFrame:
    """The files of a scan, all in one state."""
    return table.sparkSession.createDataFrame([(p, state) for p in table.inputFiles()], LIST).withColumn("path", _one_form("path"))


def latest_version(spark: SparkSession, folder: str) -> int:
    return spark.read.parquet(f"{folder}/lists").agg(F.max("version")).first()[0]


def file_list(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """Files of a version (the latest by default): path and state."""
    version = latest_version(spark, folder) if version is None else version
    return spark.read.schema(f"{LIST}, version long").parquet(f"{folder}/lists").where(F.col("version") == version).drop("version")


def read_table(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the latest by default."""
    return _read(spark, folder, file_list(spark, folder, version).where("state <> 'replaced'"))


def apply_changes_to_files(spark: SparkSession, folder: str, changes: DataFrame, keys: Sequence[str], version: int) -> DataFrame:
    """``apply_changes`` as the next version of a listed table; returns the list of that version.

    Files without a changed key are kept. The first read takes the key columns alone, the second
    the files that hold a changed key."""
    if _done(spark, folder, version):
        return file_list(spark, folder, version)
    last = cut_lineage(last_change_per_key(changes, keys), "changes")
    holders = spread_join(_with_file(read_table(spark, folder), keys), last.select(*keys), keys, "left_semi")
    return _rewrite(spark, folder, version, holders, last, keys, lambda rows: apply_changes(rows, last, keys))


def merge_to_files(spark: SparkSession, folder: str, source: DataFrame, keys: Sequence[str], version: int,
                   delete_missing: bool = False, order: str | None = None) -> DataFrame:
    """``merge`` as the next version of a listed table; returns the list of that version.

    A file is kept when the source would change none of its rows, so also when it holds the very
    images that the source brings. With ``delete_missing`` a file with an unmatched row is rewritten.
    Images with map columns can't be compared and count as changed."""
    if _done(spark, folder, version):
        return file_list(spark, folder, version)
    target = read_table(spark, folder)
    rest = [c for c in target.columns if c not in keys]
    source = cut_lineage(source, "source")
    src = one_image(source, keys, rest, order)
    comparable = not any(_has_map(target.schema[c].dataType) for c in rest)
    same = F.col("__src").eqNullSafe(F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(True).alias("__hit"))) if comparable else F.lit(False)
    found = spread_join(_with_file(target, target.columns), src, keys, "left" if delete_missing else "inner")
    # One row per key and file; its image is looked at here and left behind.
    hits = cut_lineage(found.groupBy(*keys, FILE).agg(F.bool_or(F.col("__src").isNotNull()).alias("matched"),
                                                      F.bool_and(F.col("__src").isNotNull() & same).alias("same")), "hits")
    changed = hits.where("NOT same").select(FILE)
    # Keys that are met in kept files alone need nothing; every other image is written or added.
    met = spread_join(hits.where("matched"), changed.distinct().withColumn("rewritten", F.lit(True)), [FILE], "left")
    settled = met.groupBy(*keys).agg(F.max(F.coalesce("rewritten", F.lit(False))).alias("rewritten")).where("NOT rewritten").select(*keys)
    open_images = spread_join(source, settled, keys, "left_anti").select(*source.columns)
    return _rewrite(spark, folder, version, changed, source, keys, lambda rows: merge(rows, open_images, keys, delete_missing, order))


def file_path() -> Column:
    """The file of a scanned row, as lists name it."""
    return _one_form("_metadata.file_path")


def _one_form(path: str) -> Column:
    """Local files are named with one slash or three, by listings and by scans."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def _with_file(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    return table.select(*[F.col(f"`{c}`") for c in columns], file_path().alias(FILE))


def _has_map(t: T.DataType) -> bool:
    if isinstance(t, T.StructType):
        return any(_has_map(f.dataType) for f in t.fields)
    return _has_map(t.elementType) if isinstance(t, T.ArrayType) else isinstance(t, T.MapType)


def _done(spark: SparkSession, folder: str, version: int) -> bool:
    latest = latest_version(spark, folder)
    if version > latest + 1:
        raise ValueError(f"version {version} does not follow {latest}")
    return version <= latest


def _read(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/schema").schema
    paths = [unquote(r.path) for r in files.select("path").collect()]
    # Without files, the empty table that holds the schema: its plan has the columns of a scan too.
    return spark.read.schema(schema).parquet(*(paths or [f"{folder}/schema"]))


def _rewrite(spark: SparkSession, folder: str, version: int, holders: DataFrame, images: DataFrame, keys: Sequence[str],
             change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Write the changed rows of the files named by ``holders``, then the list of the version."""
    before = file_list(spark, folder).where("state <> 'replaced'").select("path")
    touched = cut_lineage(holders.select(F.col(FILE).alias("path")).distinct(), "touched")
    rows = change(_read(spark, folder, touched))
    n = max(1, touched.count(), math.ceil(images.count() / ROWS_PER_FILE))
    hashable = [F.col(f"`{f.name}`") for f in rows.schema.fields if not _has_map(f.dataType)]
    # Files stay ranges of keys, so that a later change meets few; the hash splits a key of very many rows.
    dealt = rows.withColumn("__hash", F.xxhash64(*hashable)).repartitionByRange(n, *keys, "__hash").drop("__hash")
    dealt.write.mode("overwrite").parquet(f"{folder}/data-{version}")
    written = files_of(spark.read.schema(rows.schema).parquet(f"{folder}/data-{version}"), "written")
    gone = touched.withColumn("gone", F.lit(True))
    kept = before.join(gone, "path", "left").select("path", F.when(F.col("gone"), "replaced").otherwise("kept").alias("state"))
    _write_list(kept.unionByName(written), folder, version)
    return file_list(spark, folder, version)


def _write_list(files: DataFrame, folder: str, version: int) -> None:
    files.coalesce(1).write.parquet(f"{folder}/lists/version={version}")
