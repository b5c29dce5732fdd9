"""Requests of data subjects: find, erase, pseudonymise, verify, report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.common import as_ts, is_text, union_all, unpivot_stats
from tallyframe.functions import masks as M
from tallyframe.functions import pii as P


def candidate_columns(columns: Sequence[str], subject_type: str | None = None, column: str | None = None) -> list[str]:
    """Columns that may identify a subject: one named column, or all that fit the subject type
    (any personal type when it is not given)."""
    if column:
        return [c for c in columns if c.lower() == column.lower()]
    patterns = [P.SUBJECT_PATTERNS[subject_type]] if subject_type else list(P.NAME_PATTERNS.values())
    return [c for c in columns if any(re.search(p, c) for p in patterns)]


def discover(tables: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]], value) -> DataFrame:
    """Rows per table and column that hold the value; one scan per table, hits only."""
    parts = []
    for name, df in tables.items():
        cols = list(columns.get(name, ()))
        if not cols:
            continue
        one = df.agg(*[F.count_if(F.col(f"`{c}`").cast("string") == F.lit(str(value))).alias(f"n{i}") for i, c in enumerate(cols)])
        parts.append(unpivot_stats(one, {c: {"n_rows": f"n{i}"} for i, c in enumerate(cols)}).withColumn("table_name", F.lit(name)))
    return union_all(parts).where("n_rows > 0").select("table_name", "column_name", "n_rows")


def erase(df: DataFrame, column: str, value) -> DataFrame:
    """Rows of everyone else (NULL identifiers stay)."""
    return df.where(~F.col(column).cast("string").eqNullSafe(F.lit(str(value))))


def anonymise(df: DataFrame, column: str, value, strategies: Mapping[str, str] | None = None) -> DataFrame:
    """Mask the personal columns of the subject's rows and hash the identifier."""
    if strategies is None:
        strategies = {}
        for c in df.columns:
            for t, p in P.NAME_PATTERNS.items():
                if c != column and re.search(p, c):
                    strategies[c] = P.SUGGESTED_MASK.get(t, "redact")
                    break
    return M.mask_rows(df, F.col(column).cast("string") == F.lit(str(value)), {**strategies, column: "hash"})


def pseudonymise(df: DataFrame, column: str, value, seed: str) -> DataFrame:
    """Replace the identifier by a pseudonym that depends on the value and a secret seed."""
    if not is_text(df.schema[column].dataType):
        raise ValueError(f"{column} is no text column")
    token = F.concat(F.lit("PSEUDO_"), F.substring(F.sha2(F.concat_ws("_", F.lit("pseudo"), F.col(column), F.lit(seed)), 256), 1, 16))
    return df.withColumn(column, F.when(F.col(column) == F.lit(str(value)), token).otherwise(F.col(column)))


def verify_erased(tables: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]], value) -> DataFrame:
    """Remaining rows of the subject and whether none is left."""
    left = discover(tables, columns, value).agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("remaining_rows"), F.count(F.lit(1)).alias("places"))
    return left.withColumn("erased", F.col("remaining_rows") == 0)


def impact(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count_distinct("table_name").alias("n_tables"), F.count(F.lit(1)).alias("n_columns"), F.sum("n_rows").alias("n_rows"))


# ---- Fixed values: request states ----
PENDING = ("received", "analyzed")
IN_PROGRESS = ("discovering", "approved", "executing", "deleted_pending_vacuum", "vacuuming", "verifying")
CLOSED = ("completed", "cancelled")


def request_dashboard(requests: DataFrame, as_of) -> DataFrame:
    """Requests by state, overdue ones and mean processing days (columns status, deadline, created_at, completed_at)."""
    s, now = F.col("status"), as_ts(as_of)
    return requests.agg(
        F.count(F.lit(1)).alias("total_requests"), F.count_if(s.isin(list(PENDING))).alias("pending"),
        F.count_if(s.isin(list(IN_PROGRESS))).alias("in_progress"), F.count_if(s == "completed").alias("completed"),
        F.count_if(s == "cancelled").alias("cancelled"), F.count_if(s == "failed").alias("failed"),
        F.count_if((F.col("deadline") < now) & ~s.isin(list(CLOSED))).alias("overdue"),
        F.round(F.avg(F.datediff("completed_at", "created_at")), 4).alias("avg_processing_days"))


def deadlines(requests: DataFrame, as_of, warn_days: int = 5) -> DataFrame:
    """Open requests that are overdue or due within the warning period, earliest deadline first."""
    now = as_ts(as_of)
    soon = F.timestamp_add("DAY", F.lit(warn_days), now)
    st = F.when(F.col("deadline") < now, "overdue").when((F.col("deadline") > now) & (F.col("deadline") <= soon), "approaching")
    return (requests.where(~F.col("status").isin(list(CLOSED))).withColumn("urgency", st).where("urgency IS NOT NULL").orderBy("deadline"))
