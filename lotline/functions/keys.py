"""Keys made from the data itself, so that a retried task makes the same ones."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def derived_key(kind: str, *columns) -> Column:
    """128-bit key in UUID notation from a kind and the natural key columns."""
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    digest = F.md5(F.concat_ws("|", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit(""))
                                                   for p in parts]))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digest, start, size) for start, size in cuts])


def order_text(column, width: int = 20) -> Column:
    """Fixed-width text of a whole number that sorts like the number."""
    column = F.col(column) if isinstance(column, str) else column
    return F.lpad(column.cast("string"), width, "0")
