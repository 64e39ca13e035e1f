"""What the operators share: words, row packing, shared folders, joins with small tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lotline.session import cut_lineage, new_folder, shared_folder, written  # noqa: F401  (re-exported)

WHITE = r"[\x20\x09-\x0D]+"
WHITE_CHARS = " \t\n\x0b\x0c\r"
SMALL_BYTES = 1 << 28
"""A table is broadcast only once it is written and has been measured to take at most this."""


def text_of(column: Column | str) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def white_words(text: Column) -> Column:
    """Maximal runs of characters other than the ASCII white space, in order."""
    return F.array_remove(F.split(text, WHITE, -1), "")


def tidy(step):
    """``step`` for mapInArrow; at a task's end its worker, which stays for later tasks, gives free memory back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
            pool.release_unused()

    return run


def packed(df: DataFrame) -> Column:
    """The whole row as one struct, so that no column of the input can clash with ours."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def _fixed(kind: T.DataType) -> int:
    """Bytes of an array's element of a kind that has always as many, else 0."""
    if isinstance(kind, T.StructType):
        widths = [_fixed(f.dataType) for f in kind]
        return sum(widths) + 16 if all(widths) else 0
    return 0 if isinstance(kind, (T.StringType, T.BinaryType, T.ArrayType, T.MapType)) else 8


def _bytes(value: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes in memory."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.StructType):
        return sum((_bytes(value[f.name], f.dataType) for f in kind), F.lit(16))
    if isinstance(kind, T.ArrayType) and (width := _fixed(kind.elementType)):
        return F.coalesce(F.size(value), F.lit(0)) * width + 32
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.coalesce(F.octet_length(F.to_json(value)), F.lit(0)) + 32
    return F.lit(8)


def join_small(rows: DataFrame, small: DataFrame, on: Column | list[str], how: str = "left",
               limit: int = SMALL_BYTES) -> DataFrame:
    """Joins ``rows`` with a table that is written already and usually small.

    ``small`` is measured: up to ``limit`` bytes it is broadcast, beyond that it is
    shuffled. Both sides then come straight from a shuffle, so AQE can split a hot key.
    """
    size = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in small.schema), F.lit(32))
    if (small.agg(F.sum(size.cast("bigint"))).first()[0] or 0) <= limit:
        small = F.broadcast(small)
    return rows.join(small, on, how)
