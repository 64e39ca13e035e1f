"""Inline constant relations: the reference rows a new installation starts with."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lotline.functions.keys import derived_key
from lotline.schemas import struct_of
from lotline.sources.tables import Tables

# The seed rows.
LEVEL_ROWS = [
    ("RESIDENT", "Resident with permanent access"),
    ("EMPLOYEE", "Employee with discounted rates"),
    ("GUEST", "Guest with standard rates"),
    ("VIP", "VIP with premium access"),
]
GATE_ROWS = [
    ("Gate IN 1", "entry"), ("Gate IN 2", "entry"),
    ("Gate OUT 1", "exit"), ("Gate OUT 2", "exit"),
]
ZONE_ROWS = [
    ("Underground -1", "Underground parking level -1"),
    ("Underground -2", "Underground parking level -2"),
    ("Street Level", "Street level parking"),
    ("VIP Zone", "Premium parking zone"),
]
TARIFF_ROWS = [  # name, price, free minutes, zone name, level code
    ("Standard", Decimal("100.00"), 15, None, None),
    ("Resident", Decimal("50.00"), 30, None, "RESIDENT"),
    ("Employee", Decimal("30.00"), 60, None, "EMPLOYEE"),
    ("VIP", Decimal("200.00"), 60, "VIP Zone", "VIP"),
]


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


def inline_relation(spark: SparkSession, struct: T.StructType, rows: list[tuple]) -> DataFrame:
    """A ``VALUES`` relation: its exact size is known to the optimizer."""
    lines = ", ".join("(" + ", ".join(map(_literal, row)) + ")" for row in rows)
    names = ", ".join(f"`{f.name}`" for f in struct)
    values = spark.sql(f"SELECT * FROM VALUES {lines} AS v({names})")
    return values.select(*[F.col(f.name).cast(f.dataType) for f in struct])


def _named(spark: SparkSession, rows: list[tuple], ddl: str, kind: str) -> DataFrame:
    frame = inline_relation(spark, T.StructType.fromDDL(ddl), rows)
    return frame.select(derived_key(kind, frame.columns[0]).alias("id"), *frame.columns)


def seed_tables(spark: SparkSession) -> Tables:
    """Levels, gates, zones and tariffs; tariffs find their zone and level by name."""
    levels = _named(spark, LEVEL_ROWS, "code string, description string", "access_levels")
    zones = _named(spark, ZONE_ROWS, "name string, description string", "parking_zones")
    gates = _named(spark, GATE_ROWS, "name string, type string", "gates")
    raw = _named(spark, TARIFF_ROWS,
                 "name string, price_per_hour decimal(10,2), free_minutes int, zone string, "
                 "level string", "tariffs")
    tariffs = (raw
               .join(zones.select(F.col("id").alias("zone_id"), F.col("name").alias("zone")),
                     "zone", "left")
               .join(levels.select(F.col("id").alias("access_level_id"),
                                   F.col("code").alias("level")), "level", "left")
               .select(*struct_of("tariffs").fieldNames()))
    return Tables(access_levels=levels, parking_zones=zones, gates=gates, tariffs=tariffs)
