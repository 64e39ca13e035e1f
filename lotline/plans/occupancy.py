"""Occupancy, zone use and load over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lotline.functions.money import ratio
from lotline.functions.ranking import down, top, up
from lotline.functions.times import elapsed_micros, recent
from lotline.plans.lookups import active, completed
from lotline.sources.tables import Tables


def parking_occupancy(tables: Tables) -> DataFrame:
    """Spots, occupied and free, per zone.

    A spot counts once per active session on it, and once when it has none.
    Sessions are counted per spot before they meet the spots.
    """
    busy = (active(tables).where(F.col("spot_id").isNotNull())
            .groupBy("spot_id").agg(F.count(F.lit(1)).alias("busy")))
    spots = (tables.parking_spots.where("is_active")
             .select(F.col("id").alias("spot_id"), "zone_id")
             .join(busy, "spot_id", "left")
             .groupBy("zone_id")
             .agg(F.sum(F.greatest(F.lit(1).cast("bigint"), F.coalesce("busy", F.lit(0))))
                  .alias("total"),
                  F.sum(F.coalesce("busy", F.lit(0))).alias("occupied")))
    zones = tables.parking_zones.select(F.col("id").alias("zone_id"),
                                        F.col("name").alias("zone_name"))
    counted = zones.join(spots, "zone_id", "left").select(
        "zone_id", "zone_name",
        F.coalesce("total", F.lit(0)).alias("total_spots"),
        F.coalesce("occupied", F.lit(0)).alias("occupied_spots"))
    share = (F.col("occupied_spots").cast("decimal(18,0)") * 100
             / F.nullif(F.col("total_spots"), F.lit(0)).cast("decimal(18,0)"))
    return counted.select(
        "*", (F.col("total_spots") - F.col("occupied_spots")).alias("free_spots"),
        F.round(share, 2).cast("decimal(5,2)").alias("occupancy_percent"))


def hourly_load(tables: Tables, as_of, days: int = 30) -> DataFrame:
    return (recent(tables.parking_sessions, "entry_time", as_of, days)
            .groupBy(F.hour("entry_time").alias("hour"))
            .agg(F.count(F.lit(1)).alias("entries_count"),
                 F.count_distinct("car_id").alias("unique_cars"))
            .orderBy(down("entries_count"), up("hour")))


def peak_hours(tables: Tables, as_of, days: int = 30) -> DataFrame:
    return (recent(tables.parking_sessions, "entry_time", as_of, days)
            .groupBy(F.hour("entry_time").alias("hour"))
            .agg(F.count(F.lit(1)).alias("entries_count"))
            .orderBy(down("entries_count"), up("hour")))


def busiest_days(tables: Tables, as_of, days: int = 30, limit: int = 10) -> DataFrame:
    daily = (recent(completed(tables), "entry_time", as_of, days)
             .groupBy(F.to_date("entry_time").alias("date"))
             .agg(F.count(F.lit(1)).alias("entries_count"),
                  F.count_distinct("car_id").alias("unique_cars"),
                  F.sum("total_cost").alias("daily_revenue")))
    return top(daily, limit, down("entries_count"), up("date"))


def zone_usage(tables: Tables, as_of, days: int = 30) -> DataFrame:
    """Sessions per zone with any in the period; idle zones are left out.

    Session keys are unique, so counting per spot first and adding up per zone
    replaces the distinct counts.
    """
    per_spot = (recent(tables.parking_sessions, "entry_time", as_of, days)
                .where(F.col("spot_id").isNotNull())
                .groupBy("spot_id")
                .agg(F.count(F.lit(1)).alias("sessions"),
                     F.count_if(F.col("status") == "active").alias("active"),
                     F.sum(elapsed_micros("entry_time", "exit_time")).alias("micros"),
                     F.count("exit_time").alias("closed")))
    spots = tables.parking_spots.select(F.col("id").alias("spot_id"), "zone_id")
    per_zone = (spots.join(per_spot, "spot_id").groupBy("zone_id")
                .agg(F.sum("sessions").alias("total_sessions"),
                     F.sum("active").alias("active_sessions"),
                     F.count(F.lit(1)).alias("used_spots"),
                     F.sum("micros").alias("micros"), F.sum("closed").alias("closed")))
    zones = tables.parking_zones.select(F.col("id").alias("zone_id"),
                                        F.col("name").alias("zone_name"))
    return (zones.join(per_zone, "zone_id")
            .orderBy(down("total_sessions"), up("zone_id"))
            .select("zone_name", "total_sessions", "active_sessions", "used_spots",
                    (ratio("micros", "closed") / 60_000_000).alias("avg_duration_minutes")))


def ranked_peaks(tables: Tables, as_of, days: int = 30, limit: int = 20) -> DataFrame:
    """Busiest (day, hour) pairs, ranked within the day and overall.

    Both windows see one row per hour of the period, never the sessions.
    """
    hourly = (recent(tables.parking_sessions, "entry_time", as_of, days)
              .groupBy(F.to_date("entry_time").alias("date"), F.hour("entry_time").alias("hour"))
              .agg(F.count(F.lit(1)).alias("entries_count")))
    busiest = F.desc("entries_count")
    ranked = hourly.select(
        "*",
        F.rank().over(Window.partitionBy("date").orderBy(busiest)).alias("rank_in_day"),
        F.rank().over(Window.orderBy(busiest)).alias("rank_overall"))
    return top(ranked, limit, down("entries_count"), up("date"), up("hour"))
