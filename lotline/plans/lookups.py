"""Joins several reports share, and the size check before a broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lotline.sources.tables import Tables

def fits_broadcast(*frames: DataFrame) -> bool:
    """Whether the optimizer's size of every frame is within the session's broadcast threshold."""
    conf = frames[0].sparkSession._jsparkSession.sessionState().conf()
    return all(_estimate(f) <= conf.autoBroadcastJoinThreshold() for f in frames)


def _estimate(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def zone_of_spot(tables: Tables) -> DataFrame:
    """One row per spot with its zone's key and name."""
    spots = tables.parking_spots.select(F.col("id").alias("spot_id"),
                                        F.col("zone_id").alias("_zone"))
    zones = tables.parking_zones.select(F.col("id").alias("zone_id"),
                                        F.col("name").alias("zone_name"))
    return spots.join(zones, F.col("_zone") == F.col("zone_id"), "left").drop("_zone")


def with_zone(tables: Tables, sessions: DataFrame) -> DataFrame:
    """Sessions with the zone of their spot, NULL where they have no spot.

    When the spots are too many to broadcast, sessions without a spot go around
    the join: sharing one NULL key, they would all meet in one task.
    """
    lookup = zone_of_spot(tables)
    if fits_broadcast(tables.parking_spots, tables.parking_zones):
        return sessions.join(F.broadcast(lookup), "spot_id", "left")
    placed = F.col("spot_id").isNotNull()
    outside = sessions.where(~placed)
    for f in lookup.schema.fields:
        if f.name != "spot_id":
            outside = outside.withColumn(f.name, F.lit(None).cast(f.dataType))
    return sessions.where(placed).join(lookup, "spot_id", "left").unionByName(outside)


def owners(tables: Tables, *user_columns: str) -> DataFrame:
    """One row per car with its owner: the two small sides meet before the sessions do."""
    cars = tables.cars.select(F.col("id").alias("car_id"), "plate_number", "user_id")
    users = tables.users.select(F.col("id").alias("user_id"), *user_columns)
    return cars.join(users, "user_id")


def completed(tables: Tables) -> DataFrame:
    return tables.parking_sessions.where(F.col("status") == "completed")


def active(tables: Tables) -> DataFrame:
    return tables.parking_sessions.where(F.col("status") == "active")


def spend_per_car(sessions: DataFrame) -> DataFrame:
    """Session totals per car. Hot cars shrink to one row per task before the shuffle."""
    return sessions.groupBy("car_id").agg(
        F.count("id").alias("sessions"),
        F.sum("total_cost").alias("spent"),
        F.count("total_cost").alias("paid"),
        F.min("entry_time").alias("first_entry"),
        F.max("entry_time").alias("last_entry"),
    )
