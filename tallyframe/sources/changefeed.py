"""Reads of a change feed (rows with _change_type, _commit_version, _commit_timestamp)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

META = ("_change_type", "_commit_version", "_commit_timestamp")


def changes_from(changes: DataFrame, version: int | None = None, timestamp: str | None = None) -> DataFrame:
    """Changes from a version on or, when no version is given, from a time on (both inclusive)."""
    if version is not None:
        return changes.where(F.col("_commit_version") >= version)
    if timestamp is not None:
        return changes.where(F.col("_commit_timestamp") >= F.lit(timestamp).cast("timestamp_ntz"))
    raise ValueError("a start version or a start timestamp is needed")


def changes_after(changes: DataFrame, synced_version: int) -> DataFrame:
    """Changes that come after the last version already applied."""
    return changes.where(F.col("_commit_version") > synced_version)


def last_change_per_key(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The final image of every changed key. Pre-images never count."""
    w = Window.partitionBy(*keys).orderBy(F.col("_commit_version").desc(), F.col("_commit_timestamp").desc())
    return (
        changes.where(F.col("_change_type") != "update_preimage")
        .withColumn("__pos", F.row_number().over(w))
        .where(F.col("__pos") == 1)
        .drop("__pos")
    )


def as_of_version(base: DataFrame, changes: DataFrame, keys: Sequence[str], version: int) -> DataFrame:
    """The table as it stood at a version, rebuilt from its first state and the change log."""
    from tallyframe.operators.changes import apply_changes

    return apply_changes(base, changes.where(F.col("_commit_version") <= version), keys)
