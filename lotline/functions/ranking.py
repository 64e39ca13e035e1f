"""Ordering with explicit NULL places, and top-k with a unique tie-breaker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def down(column) -> Column:
    """Descending with NULL as the largest value, so NULLs come first."""
    return F.desc_nulls_first(column)


def up(column) -> Column:
    """Ascending with NULL as the largest value, so NULLs come last."""
    return F.asc_nulls_last(column)


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """First ``k`` rows; ``order`` should end in a unique key."""
    return df.orderBy(*order).limit(k)
