"""Masking strategies as columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.common import is_numeric, is_text

REDACTED = "***REDACTED***"
STRATEGIES = ("hash", "redact", "null", "email_mask", "partial")


def hash_value(c: Column, dt: T.DataType) -> Column:
    """SHA-256 text; a column of another type cannot hold it and becomes NULL."""
    h = F.sha2(c.cast("string"), 256)
    return h if is_text(dt) else h.try_cast(dt)


def redact(c: Column, dt: T.DataType) -> Column:
    if is_text(dt):
        return F.lit(REDACTED)
    return F.lit(0).cast(dt) if is_numeric(dt) else F.lit(None).cast(dt)


def email_mask(c: Column) -> Column:
    return F.concat(F.substring(c, 1, 1), F.lit("***@"), F.substring_index(c, "@", -1))


def partial(c: Column) -> Column:
    """First and last character with stars between; one character gives itself twice."""
    n = F.length(c)
    return F.concat(F.substring(c, 1, 1), F.repeat(F.lit("*"), n - 2), F.substr(c, n, F.lit(1)))


def mask(c: Column, strategy: str, dt: T.DataType) -> Column:
    """Masked value by strategy name; any other text is taken as an SQL expression."""
    if strategy == "hash":
        return hash_value(c, dt)
    if strategy == "redact":
        return redact(c, dt)
    if strategy == "null":
        return F.lit(None).cast(dt)
    if strategy == "email_mask":
        return email_mask(c)
    if strategy == "partial":
        return partial(c)
    return F.expr(strategy)


def apply_masks(df: DataFrame, rules: Sequence[Mapping]) -> DataFrame:
    """Mask columns. A rule names a column, or a pattern over column names, and a strategy; the
    first rule that fits a column counts. All masks see the unmasked row."""
    out = {}
    for f in df.schema.fields:
        for r in rules:
            named = r.get("column") == f.name
            fits = "match" in r and re.search(r["match"], f.name, re.IGNORECASE)
            if named or fits:
                out[f.name] = mask(F.col(f"`{f.name}`"), r["strategy"], f.dataType)
                break
    return df.select(*[out.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns])


def mask_rows(df: DataFrame, where: Column, strategies: Mapping[str, str]) -> DataFrame:
    """Mask the given columns only in rows that fulfil a condition on the unmasked row."""
    def one(f):
        c = F.col(f"`{f.name}`")
        if f.name not in strategies:
            return c
        return F.when(where, mask(c, strategies[f.name], f.dataType)).otherwise(c).alias(f.name)

    return df.select(*[one(f) for f in df.schema.fields])
