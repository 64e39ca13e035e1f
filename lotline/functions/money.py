"""Tariff cost and exact averages, in built-in expressions only."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

from lotline.functions.times import elapsed_micros

MICROS_PER_MINUTE = 60_000_000


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _whole(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("bigint"))


def billable_minutes(entry, exit, free_minutes) -> Column:
    """Minutes parked, rounded half up, less the free ones, never below zero."""
    minutes = _whole(elapsed_micros(entry, exit) + F.lit(MICROS_PER_MINUTE // 2), MICROS_PER_MINUTE)
    return F.greatest(F.lit(0).cast("bigint"), minutes - _col(free_minutes))


def cost_of_minutes(minutes, price_per_hour) -> Column:
    """``ROUND(minutes / 60.0 * price, 2)``, in whole cents.

    Sixtieths repeat, so the quotient the rule rounds first ends above the true
    value when ``minutes % 3 = 1`` and below it when ``minutes % 3 = 2``. A half
    cent therefore rounds up except in the second case.
    """
    minutes = _col(minutes).cast("bigint")
    sixtieths = minutes * (_col(price_per_hour) * 100).cast("bigint")
    cents = _whole(sixtieths + 30, 60)
    low_tie = ((sixtieths % 60) == 30) & ((minutes % 3) == 2)
    cents = cents - F.when(low_tie, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    return (cents.cast("decimal(14,0)") * F.lit(Decimal("0.01"))).cast("decimal(12,2)")


def parking_cost(entry, exit, price_per_hour, free_minutes) -> Column:
    """Cost of a stay; NULL while it is open or its tariff is unknown."""
    known = _col(exit).isNotNull() & _col(price_per_hour).isNotNull()
    return F.when(known, cost_of_minutes(billable_minutes(entry, exit, free_minutes),
                                         price_per_hour))


def ratio(total, count) -> Column:
    """Average from an exact total, so no summation order can change it."""
    return F.try_divide(_col(total).cast("double"), _col(count).cast("double"))


def exact_avg(column) -> Column:
    """``AVG`` over decimals or whole numbers as a reproducible double."""
    return ratio(F.sum(column), F.count(column))


def money_text(column) -> Column:
    """Two-decimal text of an amount."""
    return _col(column).cast("decimal(12,2)").cast("string")
