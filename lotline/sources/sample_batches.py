"""Job inputs derived from the general-purpose test tables, whole tables at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _plate(user, number):
    return F.concat(F.lit("P"), (user * 3 + number).cast("string"))


def attempts(events: DataFrame) -> DataFrame:
    """An entry attempt per event, at five gates of which two are for entry."""
    event = F.col("event_id")
    return events.select(event.alias("id"), _plate(F.col("user_id"), event % 3).alias("plate_number"),
                         (event % 5).alias("gate_id"), F.col("ts").alias("attempt_time"))


def exits(events: DataFrame) -> DataFrame:
    """Every event as an exit two days later."""
    event = F.col("event_id")
    return events.select(
        event.alias("id"), (F.col("user_id") * 3 + event % 3).alias("car_id"),
        (F.col("ts") + F.expr("INTERVAL '2' DAY")).alias("exit_time"))


def topups(events: DataFrame) -> DataFrame:
    """Every event as a top-up of its value less twenty, negative ones included."""
    event = F.col("event_id")
    return events.select(
        event.alias("id"), "user_id", (F.col("value").cast("decimal(12,2)") - 20)
        .cast("decimal(12,2)").alias("amount"), F.col("ts").alias("created_at"),
        F.when(event % 2 == 0, F.concat(F.lit("note "), (event % 7).cast("string"))).alias("comment"))


def new_cars(orders: DataFrame) -> DataFrame:
    """A car per order; plates repeat each other and those of stored cars."""
    key = F.col("o_orderkey")
    return orders.select((key + F.lit(1_000_000_000)).alias("id"), F.col("o_custkey").alias("user_id"),
                         F.concat(F.lit("P"), (key * 7 % 50_021).cast("string")).alias("plate_number"),
                         F.when(key % 2 == 0, F.lit("Model X")).alias("model"))


def spot_patches(supplier: DataFrame) -> DataFrame:
    """Renumbers three spots in four, moves one in five and switches every other on or off."""
    key = F.col("s_suppkey")
    return supplier.select(
        key.alias("id"), F.when(key % 5 == 0, (key % 3).cast("bigint")).alias("zone_id"),
        F.when(key % 4 != 0, F.concat(F.lit("SP-"), F.expr("s_suppkey div 2").cast("string")))
        .alias("spot_number"),
        F.lit(None).cast("boolean").alias("is_reserved"),
        F.when(key % 2 == 0, key % 3 == 0).alias("is_active"))


def car_patches(customer: DataFrame) -> DataFrame:
    """New plates and models for everyone's first car; one in five asks for a car of somebody else."""
    key = F.col("c_custkey")
    car = key * 3
    return customer.select(
        car.alias("id"), F.when(key % 5 == 0, key + 1).otherwise(key).alias("by"),
        F.concat(F.when(car % 2 == 0, "Q").otherwise("P"), car.cast("string")).alias("plate_number"),
        F.when(car % 4 != 0, "Model Y").alias("model"))


def bare_wallets(customer: DataFrame) -> DataFrame:
    """Wallets of which many columns are missing or NULL."""
    key = F.col("c_custkey")
    return customer.select(
        key.alias("id"), key.alias("user_id"),
        F.when(key % 3 != 0, F.col("c_acctbal").cast("decimal(12,2)")).alias("balance"),
        F.when(key % 4 == 0, F.lit("EUR")).alias("currency"))


def dirty_users(customer: DataFrame) -> DataFrame:
    """Users with phones, emails and times that break rules in several ways."""
    key = F.col("c_custkey")
    return customer.select(
        key.alias("id"),
        F.when(key % 5 == 0, F.lit("0123")).when(key % 7 == 0, F.lit(None).cast("string"))
        .when(key % 11 == 0, F.concat(F.lit("+7"), F.repeat(F.lit("1"), 20)))
        .otherwise(F.concat(F.lit("+7"), (key + 9_000_000_000).cast("string"))).alias("phone"),
        F.when(key % 3 == 0, F.lit("nobody")).when(key % 4 == 0, F.lit("a@b"))
        .when(key % 4 == 1, F.concat(F.lit("u"), key.cast("string"), F.lit("@example.com")))
        .alias("email"),
        F.when(key % 13 != 0, F.lit("hash")).alias("password_hash"),
        F.lit("2023-12-01 00:00:00").cast("timestamp_ntz").alias("created_at"),
        F.lit(False).alias("is_blocked"))


def import_requests(customer: DataFrame) -> DataFrame:
    """Import entries in ten requests, the last one a dry run.

    Phones, emails and plates repeat each other and those already stored.
    """
    key = F.col("c_custkey")
    size = 10
    cars = F.array_compact(F.array(
        F.when(key % 3 != 0, F.struct(
            F.concat(F.lit("N"), (key * 5 % 1_999).cast("string")).alias("plate_number"),
            F.lit("Model N").alias("model"))),
        F.when(key % 4 == 1, F.struct(
            F.concat(F.lit("P"), (key * 11 % 40_009).cast("string")).alias("plate_number"),
            F.lit(None).cast("string").alias("model")))))
    return customer.select(
        (key % size).alias("request_no"), F.expr(f"c_custkey div {size}").alias("user_no"),
        (key % size == size - 1).alias("dry_run"),
        F.concat(F.lit("+8"), (F.lit(1_000_000) + key * 3 % 1_201).cast("string")).alias("phone"),
        F.when(key % 6 == 0, F.concat(F.lit("user"), (key * 13 % 3_001).cast("string"),
                                      F.lit("@example.com"))).alias("email"),
        F.lit("hash").alias("password_hash"), cars.alias("cars"))


def request_texts(customer: DataFrame) -> DataFrame:
    """Ten customers to a JSON request; every seventh request has no users, every eleventh breaks off."""
    key = F.col("c_custkey")
    user = F.struct(key.alias("k"), F.concat(F.lit("+8"), (key + 1_000_000).cast("string")).alias("phone"),
                    F.when(key % 3 == 0, F.array(F.struct(F.concat(F.lit("N"), key.cast("string"))
                                                          .alias("plate_number")))).alias("cars"))
    grouped = (customer.select(F.expr("c_custkey div 10").alias("request_no"), user.alias("u"))
               .groupBy("request_no").agg(F.array_sort(F.collect_list("u")).alias("users")))
    number = F.col("request_no")
    users = F.when(number % 7 == 0, F.slice("users", 1, 0)).otherwise(F.col("users"))
    text = F.to_json(F.struct("request_no", users.alias("users")))
    cut = F.substring(text, F.lit(1), F.length(text) - 1)
    return grouped.select(F.when(number % 11 == 0, cut).otherwise(text).alias("value"))


def passages(events: DataFrame) -> DataFrame:
    """Sign-ups and errors as entries, purchases as top-ups, all else as exits."""
    event, kind = F.col("event_id"), F.col("event_type")
    label = (F.when(kind.isin("signup", "error"), "entry").when(kind == "purchase", "topup")
             .otherwise("exit"))
    return events.select(
        event.alias("id"), label.alias("kind"),
        F.when(kind != "purchase", _plate(F.col("user_id"), event % 3)).alias("plate_number"),
        F.col("ts").alias("at"), "user_id", F.col("value").cast("decimal(12,2)").alias("amount"))
