"""Columns that an operator doesn't need, kept aside so that none clashes with those it adds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_aside(docs: DataFrame, text: str, needed: Sequence[str]) -> DataFrame:
    """text, the needed columns that exist, and a struct of all columns but text."""
    others = [c for c in docs.columns if c != text]
    return docs.select(F.col(text), *[F.col(c) for c in needed if c in others], F.struct(*[F.col(f"`{c}`") for c in others]).alias("__row"))


def restore(frame: DataFrame, columns: Sequence[str], text: str) -> DataFrame:
    """The columns that were set aside, in their order, and text as it is now."""
    return frame.select(*[F.col(text) if c == text else F.col(f"__row.`{c}`").alias(c) for c in columns])
