"""Users, cars and wallets: spending, debts and histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lotline.functions.money import ratio
from lotline.functions.ranking import down, top, up
from lotline.functions.times import elapsed_micros, recent
from lotline.plans.lookups import active, completed, owners, spend_per_car, with_zone
from lotline.schemas import TABLES
from lotline.sources.tables import Tables


def _user_columns(tables: Tables, *columns: str) -> DataFrame:
    return tables.users.select(F.col("id").alias("user_id"), *columns)


def _car_owner(tables: Tables) -> DataFrame:
    return tables.cars.select(F.col("id").alias("car_id"), "user_id")


def _spend_per_user(tables: Tables, sessions: DataFrame, how: str) -> DataFrame:
    """Totals per user, from totals per car, so sessions are shuffled once."""
    return (_car_owner(tables).join(spend_per_car(sessions), "car_id", how)
            .groupBy("user_id")
            .agg(F.count(F.lit(1)).alias("cars"),
                 F.coalesce(F.sum("sessions"), F.lit(0)).alias("sessions"),
                 F.sum("spent").alias("spent"), F.sum("paid").alias("paid"),
                 F.min("first_entry").alias("first_entry"),
                 F.max("last_entry").alias("last_entry")))


def user_parking_history(tables: Tables, newest_first: bool = False) -> DataFrame:
    """Every session with its owner, car, tariff and zone.

    Sorting the whole history is a full shuffle and only matters for display,
    so it is asked for, not the default.
    """
    tariffs = tables.tariffs.select(F.col("id").alias("tariff_id"),
                                    F.col("name").alias("tariff_name"))
    sessions = tables.parking_sessions.withColumnRenamed("id", "session_id")
    history = (with_zone(tables, sessions).join(owners(tables, "phone"), "car_id")
               .join(tariffs, "tariff_id")
               .select("user_id", "phone", "plate_number", "session_id", "entry_time",
                       "exit_time", "total_cost", "status", "tariff_name", "zone_name"))
    return history.orderBy(down("entry_time"), up("session_id")) if newest_first else history


def top_users_by_use(tables: Tables, limit: int = 20) -> DataFrame:
    """Users with at least one completed session, most sessions first."""
    spend = _spend_per_user(tables, completed(tables), "left").where("sessions > 0")
    ranked = spend.join(_user_columns(tables, "phone", "email"), "user_id").select(
        "user_id", "phone", "email", F.col("cars").alias("cars_count"),
        F.col("sessions").alias("total_sessions"), F.col("spent").alias("total_spent"),
        ratio("spent", "paid").alias("avg_session_cost"),
        F.col("first_entry").alias("first_session"), F.col("last_entry").alias("last_session"))
    return top(ranked, limit, down("total_sessions"), down("total_spent"), up("user_id"))


def top_users_by_spend(tables: Tables, limit: int = 20) -> DataFrame:
    """Highest spenders that have a wallet, with its current balance."""
    spend = _spend_per_user(tables, completed(tables), "inner")
    wallets = tables.wallets.select("user_id", F.col("balance").alias("current_balance"))
    joined = spend.join(_user_columns(tables, "phone", "email"), "user_id").join(wallets, "user_id")
    return top(joined, limit, down("spent"), up("user_id")).select(
        "phone", "email", F.col("spent").alias("total_spent"),
        F.col("sessions").alias("sessions_count"), "current_balance")


def top_users(tables: Tables, limit: int = 10) -> DataFrame:
    """Most active users, those without any session included with zeros."""
    spend = _spend_per_user(tables, completed(tables), "inner")
    zero = F.lit(0)
    ranked = _user_columns(tables, "phone").join(spend, "user_id", "left").select(
        "user_id", "phone", F.coalesce("sessions", zero).alias("total_sessions"),
        F.coalesce("spent", zero.cast("decimal(12,2)")).alias("total_spent"),
        F.coalesce(ratio("spent", "paid"), zero.cast("double")).alias("avg_session_cost"))
    return top(ranked, limit, down("total_sessions"), down("total_spent"), up("user_id"))


def recent_top_spenders(tables: Tables, as_of, days: int = 30, limit: int = 10) -> DataFrame:
    sessions = recent(completed(tables), "entry_time", as_of, days)
    spend = _spend_per_user(tables, sessions, "inner")
    ranked = spend.join(_user_columns(tables, "phone"), "user_id")
    return top(ranked, limit, down("spent"), up("user_id")).select(
        "phone", F.col("sessions").alias("count"), "spent")


def _with_car_and_owner(tables: Tables, sessions: DataFrame) -> DataFrame:
    return (sessions.withColumnRenamed("id", "session_id")
            .withColumn("micros", elapsed_micros("entry_time", "exit_time"))
            .join(owners(tables, "phone"), "car_id")
            .withColumn("duration_hours", F.col("micros").cast("double") / 3_600_000_000))


def suspicious_sessions(tables: Tables, max_hours: float = 24) -> DataFrame:
    """Completed stays longer than ``max_hours``, longest first."""
    longer = elapsed_micros("entry_time", "exit_time") > F.lit(int(max_hours * 3_600_000_000))
    long_stays = completed(tables).where(F.col("exit_time").isNotNull() & longer)
    return (_with_car_and_owner(tables, long_stays)
            .orderBy(down("duration_hours"), up("session_id"))
            .select("session_id", "plate_number", "phone", "entry_time", "exit_time",
                    "total_cost", "duration_hours"))


def long_sessions(tables: Tables) -> DataFrame:
    """Completed stays of over a day, with their tariff."""
    longer = elapsed_micros("entry_time", "exit_time") > F.lit(24 * 3_600_000_000)
    long_stays = completed(tables).where(F.col("exit_time").isNotNull() & longer)
    tariffs = tables.tariffs.select(F.col("id").alias("tariff_id"),
                                    F.col("name").alias("tariff_name"))
    return (_with_car_and_owner(tables, long_stays).join(tariffs, "tariff_id")
            .orderBy(down("duration_hours"), up("session_id"))
            .select("session_id", "plate_number", "phone", "entry_time", "exit_time",
                    "total_cost", "duration_hours", "tariff_name"))


def expensive_sessions(tables: Tables, times_average: int = 3) -> DataFrame:
    """Completed stays that cost more than ``times_average`` times the mean.

    ``cost * n > times * total`` compares exactly, without dividing.
    """
    done = completed(tables)
    totals = done.agg(F.struct(F.sum("total_cost").alias("total"),
                               F.count("total_cost").alias("n")).alias("t")).scalar()
    dear = (F.col("total_cost") * totals.getField("n").cast("decimal(20,0)")
            > totals.getField("total") * F.lit(times_average).cast("decimal(4,0)"))
    tariffs = tables.tariffs.select(F.col("id").alias("tariff_id"),
                                    F.col("name").alias("tariff_name"), "price_per_hour")
    return (_with_car_and_owner(tables, done.where(dear)).join(tariffs, "tariff_id")
            .orderBy(down("total_cost"), up("session_id"))
            .select("session_id", "plate_number", "phone", "entry_time", "exit_time",
                    "total_cost", "tariff_name", "price_per_hour", "duration_hours"))


def debtors_with_activity(tables: Tables) -> DataFrame:
    """Negative balances, with the number of sessions still open."""
    open_per_car = active(tables).groupBy("car_id").agg(F.count(F.lit(1)).alias("open"))
    open_per_user = (_car_owner(tables).join(open_per_car, "car_id")
                     .groupBy("user_id").agg(F.sum("open").alias("open")))
    return (_debts(tables).join(open_per_user, "user_id", "left")
            .orderBy(up("balance"), up("user_id"))
            .select(F.col("user_id").alias("id"), "phone", "email", "balance",
                    F.coalesce("open", F.lit(0)).alias("active_sessions"), "is_blocked"))


def _debts(tables: Tables) -> DataFrame:
    owing = tables.wallets.where(F.col("balance") < 0).select("user_id", "balance")
    return owing.join(_user_columns(tables, "phone", "email", "is_blocked"), "user_id")


def debtors(tables: Tables) -> DataFrame:
    return _debts(tables).select("user_id", "phone", "email", "balance", "is_blocked")


def top_cars(tables: Tables, limit: int = 30) -> DataFrame:
    """Active cars by completed sessions."""
    per_car = (completed(tables).groupBy("car_id")
               .agg(F.count("id").alias("total_sessions"), F.sum("total_cost").alias("total_spent"),
                    F.sum(elapsed_micros("entry_time", "exit_time")).alias("micros"),
                    F.count("exit_time").alias("closed"),
                    F.min("entry_time").alias("first_use"), F.max("entry_time").alias("last_use")))
    cars = (tables.cars.where("is_active")
            .select(F.col("id").alias("car_id"), "plate_number", "user_id"))
    joined = cars.join(per_car, "car_id").join(_user_columns(tables, "phone"), "user_id")
    return top(joined, limit, down("total_sessions"), up("car_id")).select(
        "plate_number", F.col("phone").alias("owner_phone"), "total_sessions", "total_spent",
        (ratio("micros", "closed") / 60_000_000).alias("avg_duration_minutes"),
        "first_use", "last_use")


def active_sessions(tables: Tables) -> DataFrame:
    return active(tables).select(*TABLES["parking_sessions"].columns)


def car_sessions(tables: Tables, car_id, as_of, days: int = 7) -> DataFrame:
    """One car's recent sessions with plate and phone, newest first."""
    chosen = recent(tables.parking_sessions.where(F.col("car_id") == car_id),
                    "entry_time", as_of, days)
    car = tables.cars.where(F.col("id") == car_id).select(
        F.col("id").alias("car_id"), "plate_number", "user_id")
    return (chosen.join(car, "car_id").join(_user_columns(tables, "phone"), "user_id")
            .select(*TABLES["parking_sessions"].columns, "plate_number", "phone")
            .orderBy(down("entry_time"), up("id")))
