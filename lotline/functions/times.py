"""Time arithmetic on timestamps without zone."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from lotline.schemas import DATE_OF

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def elapsed_micros(start, end) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def as_day(as_of) -> Column:
    """A day literal from a date, a datetime or an ISO string."""
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, dt.datetime):
        as_of = as_of.date()
    elif isinstance(as_of, str):
        as_of = dt.date.fromisoformat(as_of[:10])
    return F.lit(as_of)


def midnight_before(as_of, days: int) -> Column:
    """Start of the day ``days`` before ``as_of``, as a zone-less timestamp."""
    return F.date_sub(as_day(as_of), days).cast("timestamp_ntz")


def recent(df: DataFrame, column: str, as_of, days: int) -> DataFrame:
    """Rows of the ``days`` before the start of day ``as_of``, open to the future.

    Where the table is stored by date, the partitions before are not even listed.
    """
    rows = df.where(F.col(column) >= midnight_before(as_of, days))
    date = DATE_OF.get(column)
    return rows.where(F.col(date) >= F.date_sub(as_day(as_of), days)) if date in df.columns else rows


def on_days(df: DataFrame, column: str, first=None, last=None) -> DataFrame:
    """Rows of the days ``first`` to ``last``, both included; either bound may be left open.

    A half-open range on the time itself, which scans can use, and on the partition
    date where there is one.
    """
    date = DATE_OF.get(column)
    date = date if date in df.columns else None
    if first is not None:
        df = df.where(F.col(column) >= as_day(first).cast("timestamp_ntz"))
        df = df.where(F.col(date) >= as_day(first)) if date else df
    if last is not None:
        df = df.where(F.col(column) < midnight_before(last, -1))
        df = df.where(F.col(date) <= as_day(last)) if date else df
    return df


def utc_instant(column) -> Column:
    """Zone-less wall time read as UTC, whatever the session zone."""
    return F.timestamp_micros(elapsed_micros(F.expr(EPOCH), column))


def utc_wall_time(column) -> Column:
    """Inverse of :func:`utc_instant`."""
    column = F.col(column) if isinstance(column, str) else column
    return F.timestamp_add("MICROSECOND", F.unix_micros(column), F.expr(EPOCH))
