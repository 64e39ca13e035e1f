"""Small literal tables for the rule tests."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from lotline.schemas import TABLES, struct_of
from lotline.sources.tables import Tables

START = dt.datetime(2024, 1, 1)


def at(hours: float = 0, minutes: float = 0, seconds: float = 0) -> dt.datetime:
    return START + dt.timedelta(hours=hours, minutes=minutes, seconds=seconds)


def money(value) -> Decimal:
    return Decimal(str(value)).quantize(Decimal("0.01"))


def frame(spark, table, rows, **defaults):
    """Rows given as dicts; missing columns come from ``defaults`` or are NULL."""
    struct = struct_of(table)
    full = [tuple({**defaults, **row}.get(name) for name in struct.fieldNames()) for row in rows]
    return spark.createDataFrame(full, struct)


DEFAULTS = {
    "users": {"password_hash": "h", "created_at": START, "is_blocked": False},
    "wallets": {"currency": "RUB", "updated_at": START},
    "cars": {"is_active": True, "created_at": START},
    "user_access_levels": {"granted_at": START},
    "parking_spots": {"is_reserved": False, "is_active": True},
    "tariffs": {"free_minutes": 0},
    "parking_sessions": {"status": "active", "entry_time": START},
    "wallet_transactions": {"created_at": START},
    "audit_logs": {"created_at": START},
}


def tables(spark, **rows) -> Tables:
    return Tables(**{name: frame(spark, name, rows.get(name, []), **DEFAULTS.get(name, {}))
                     for name in TABLES})


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def by_id(df, *columns):
    return {r["id"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]]
            for r in df.select("id", *columns).collect()}


def col(name):
    return F.col(name)
