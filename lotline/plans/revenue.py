"""Revenue by day, tariff and zone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lotline.functions.money import exact_avg, ratio
from lotline.functions.ranking import down, up
from lotline.functions.times import elapsed_micros, on_days, recent
from lotline.plans.lookups import completed, fits_broadcast, zone_of_spot
from lotline.sources.tables import Tables

ZONE = ("zone_id", "zone_name")


def _tariff_names(tables: Tables) -> DataFrame:
    return tables.tariffs.select(F.col("id").alias("tariff_id"), F.col("name").alias("tariff_name"))


def _measures() -> list:
    return [F.count("id").alias("sessions"), F.sum("total_cost").alias("revenue"),
            F.count("total_cost").alias("paid"), F.min("total_cost").alias("low"),
            F.max("total_cost").alias("high"), F.sum("micros").alias("micros"),
            F.count("micros").alias("closed")]


def _merged() -> list:
    merge = {"low": F.min, "high": F.max}
    return [merge.get(name, F.sum)(name).alias(name)
            for name in ("sessions", "revenue", "paid", "low", "high", "micros", "closed")]


def _by_zone(tables: Tables, sessions: DataFrame, keys: tuple) -> DataFrame:
    """Session measures per ``keys`` and zone of the spot.

    Where the spot table is small enough to broadcast, sessions meet it in place.
    Otherwise they are first added up per spot: the many sessions without a spot
    share one NULL key and would all land in one task of a shuffled join.
    """
    facts = sessions.select("id", "total_cost", "spot_id", *keys,
                            elapsed_micros("entry_time", "exit_time").alias("micros"))
    lookup = zone_of_spot(tables)
    if fits_broadcast(tables.parking_spots, tables.parking_zones):
        return (facts.join(F.broadcast(lookup), "spot_id", "left")
                .groupBy(*keys, *ZONE).agg(*_measures()))
    return (facts.groupBy(*keys, "spot_id").agg(*_measures())
            .join(lookup, "spot_id", "left").groupBy(*keys, *ZONE).agg(*_merged()))


def revenue_analytics(tables: Tables, first_day=None, last_day=None) -> DataFrame:
    """Completed sessions per day, tariff and zone, from ``first_day`` and up to ``last_day`` if given.

    The bounds filter the sessions themselves, so they prune the scan.
    """
    sessions = completed(tables).where(F.col("total_cost").isNotNull())
    sessions = on_days(sessions, "entry_time", first_day, last_day)
    sessions = sessions.withColumn("date", F.to_date("entry_time"))
    totals = _by_zone(tables, sessions, ("date", "tariff_id"))
    return totals.join(_tariff_names(tables), "tariff_id").select(
        "date", "tariff_id", "tariff_name", *ZONE,
        F.col("sessions").alias("sessions_count"), F.col("revenue").alias("total_revenue"),
        ratio("revenue", "paid").alias("avg_session_cost"),
        (ratio("micros", "closed") / 60_000_000).alias("avg_duration_minutes"))


def revenue_report(tables: Tables, first_day=None, last_day=None) -> DataFrame:
    return (revenue_analytics(tables, first_day, last_day)
            .orderBy(down("date"), down("total_revenue"), up("tariff_id"), up("zone_id")))


def revenue_by_tariff_and_zone(tables: Tables, as_of, days: int = 30) -> DataFrame:
    sessions = recent(completed(tables), "entry_time", as_of, days)
    totals = _by_zone(tables, sessions, ("tariff_id",))
    return (totals.join(_tariff_names(tables), "tariff_id")
            .orderBy(down("revenue"), up("tariff_id"), up("zone_id"))
            .select("tariff_name", "zone_name", F.col("sessions").alias("sessions_count"),
                    F.col("revenue").alias("total_revenue"),
                    ratio("revenue", "paid").alias("avg_session_cost"),
                    F.col("low").alias("min_cost"), F.col("high").alias("max_cost")))


def revenue_by_day_and_tariff(tables: Tables, as_of, days: int = 7) -> DataFrame:
    totals = (recent(completed(tables), "entry_time", as_of, days)
              .groupBy(F.to_date("entry_time").alias("date"), "tariff_id")
              .agg(F.count("id").alias("sessions_count"), F.sum("total_cost").alias("revenue")))
    return (totals.join(_tariff_names(tables), "tariff_id")
            .orderBy(down("date"), down("revenue"), up("tariff_id"))
            .select("date", "tariff_name", "sessions_count", "revenue"))


def tariff_averages(tables: Tables) -> DataFrame:
    """Mean stay and cost per tariff; sessions are added up before the tariff join."""
    totals = (completed(tables).where(F.col("exit_time").isNotNull())
              .withColumn("micros", elapsed_micros("entry_time", "exit_time"))
              .groupBy("tariff_id").agg(*_measures()))
    return (totals.join(_tariff_names(tables), "tariff_id")
            .select("tariff_id", "tariff_name", F.col("sessions").alias("sessions_count"),
                    (ratio("micros", "closed") / 60_000_000).alias("avg_duration_minutes"),
                    (ratio("micros", "closed") / 3_600_000_000).alias("avg_duration_hours"),
                    ratio("revenue", "paid").alias("avg_cost"))
            .orderBy(down("avg_duration_minutes"), up("tariff_id")).drop("tariff_id"))


def daily_revenue(tables: Tables, as_of, days: int = 30) -> DataFrame:
    return (recent(completed(tables), "entry_time", as_of, days)
            .groupBy(F.to_date("entry_time").alias("date"))
            .agg(F.count(F.lit(1)).alias("cnt"), F.sum("total_cost").alias("rev"))
            .orderBy(down("date")))


def revenue_change(tables: Tables, as_of, days: int = 30) -> DataFrame:
    """Daily revenue beside that of the previous day that has any.

    The unpartitioned window runs over one row per day of the period.
    """
    daily = (recent(completed(tables), "entry_time", as_of, days)
             .groupBy(F.to_date("entry_time").alias("date"))
             .agg(F.count(F.lit(1)).alias("sessions_count"),
                  F.sum("total_cost").alias("daily_revenue"),
                  exact_avg("total_cost").alias("avg_session_cost")))
    previous = F.lag("daily_revenue").over(Window.orderBy("date"))
    return (daily.withColumn("prev_day_revenue", previous)
            .withColumn("revenue_change", F.col("daily_revenue") - F.col("prev_day_revenue"))
            .orderBy(down("date")))
