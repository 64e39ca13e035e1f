"""Joining rows with an aggregate over a key that may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def join_totals(rows: DataFrame, totals: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Joins ``rows`` with ``totals``, one row per combination of ``keys`` (never NULL there).

    An aggregate is already partitioned by its key, so a plain join would read it in
    place and AQE, which splits a skewed partition only where both sides come straight
    from a shuffle, could not split a hot key. Computing the key of the small side anew,
    to the same value, makes it be shuffled once more and leaves the large side splittable.
    """
    again = totals.select(*[F.greatest(k, k).alias(f"_{k}") for k in keys],
                          *[c for c in totals.columns if c not in keys])
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    return rows.join(again, same, how).drop(*[f"_{k}" for k in keys])
