"""Parking tables derived from general-purpose test tables.

Users and wallets come from ``customer``, cars from three numbers per customer,
zones from ``region``, spots from ``supplier``, and sessions, entry attempts and
wallet operations from ``events``. Everything is an expression over those tables,
so filters and column pruning still reach their scans.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lotline.functions.money import parking_cost
from lotline.schemas import struct_of
from lotline.sources.seeds import inline_relation
from lotline.sources.tables import Tables

LONG = T.LongType()


STORED = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table by its declared schema, so that no footer is read to plan it."""
    return spark.read.schema(STORED[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _created(day: str = "2023-12-01") -> Column:
    return F.lit(f"{day} 00:00:00").cast("timestamp_ntz")


def read_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """The same table as a stream of its files, be it one file or a folder of parts.

    A replay takes all files in one trigger unless told otherwise. Files are in no order of
    time, so with several triggers the watermark must allow for the whole span of the table.
    The path is written as a pattern of one match, since only patterns may match a file.
    """
    reader = spark.readStream.schema(STORED[name])
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parque[t]")


def users(customer: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    return customer.select(
        key.alias("id"),
        F.concat(F.lit("+7"), (key + F.lit(9_000_000_000)).cast("string")).alias("phone"),
        F.when(key % 10 >= 3, F.concat(F.lit("user"), key.cast("string"),
                                       F.lit("@example.com"))).alias("email"),
        F.lit("not-a-hash").alias("password_hash"),
        _created().alias("created_at"),
        (key % 20 == 0).alias("is_blocked"),
    )


def wallets(customer: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    return customer.where(key % 50 != 7).select(
        key.alias("id"), key.alias("user_id"),
        F.col("c_acctbal").cast("decimal(12,2)").alias("balance"),
        F.lit("RUB").alias("currency"), _created().alias("updated_at"),
    )


def cars(customer: DataFrame) -> DataFrame:
    numbers = F.explode(F.array(*[F.lit(n).cast("bigint") for n in range(3)]))
    car = F.col("user_id") * 3 + F.col("n")
    return (customer.select(F.col("c_custkey").alias("user_id"), numbers.alias("n"))
            .select(car.alias("id"), "user_id",
                    F.concat(F.lit("P"), car.cast("string")).alias("plate_number"),
                    F.concat(F.lit("Model "), (car % 7).cast("string")).alias("model"),
                    (car % 10 != 0).alias("is_active"), _created().alias("created_at")))


def zones(region: DataFrame) -> DataFrame:
    return region.select(F.col("r_regionkey").cast("bigint").alias("id"),
                         F.col("r_name").alias("name"),
                         F.lit(None).cast("string").alias("description"))


def spots(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    key = F.col("s_suppkey")
    return (supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .select(key.alias("id"), F.col("n_regionkey").cast("bigint").alias("zone_id"),
                    F.concat(F.lit("SP-"), key.cast("string")).alias("spot_number"),
                    (key % 10 == 0).alias("is_reserved"), (key % 20 != 0).alias("is_active")))


def access_levels(spark: SparkSession) -> DataFrame:
    rows = [(0, "RESIDENT", None), (1, "EMPLOYEE", None), (2, "GUEST", None), (3, "VIP", None)]
    return inline_relation(spark, struct_of("access_levels", LONG), rows)


def grants(customer: DataFrame) -> DataFrame:
    """Three users in ten hold a level, and one in ten holds two."""
    key = F.col("c_custkey")
    levels = F.when(key % 10 == 0, F.array(key % 4, (key + 1) % 4)).otherwise(F.array(key % 4))
    return (customer.where(key % 10 < 3)
            .select(key.alias("user_id"), F.explode(levels).alias("access_level_id"))
            .select((F.col("user_id") * 4 + F.col("access_level_id")).alias("id"),
                    "user_id", "access_level_id", _created().alias("granted_at")))


def tariffs(spark: SparkSession) -> DataFrame:
    rows = [(0, "Standard", Decimal("100.00"), 15, None, None),
            (1, "Resident", Decimal("50.00"), 30, None, 0),
            (2, "Employee", Decimal("30.00"), 60, None, 1),
            (3, "VIP", Decimal("200.00"), 60, 3, 3)]
    return inline_relation(spark, struct_of("tariffs", LONG), rows)


def gates(spark: SparkSession) -> DataFrame:
    rows = [(0, "Gate IN 1", "entry"), (1, "Gate IN 2", "entry"),
            (2, "Gate OUT 1", "exit"), (3, "Gate OUT 2", "exit")]
    return inline_relation(spark, struct_of("gates", LONG), rows)


def sessions(events: DataFrame, supplier: DataFrame, tariff_rows: DataFrame) -> DataFrame:
    event = F.col("event_id")
    spot_count = supplier.agg(F.count(F.lit(1))).scalar()
    kind = F.col("event_type")
    status = (F.when(kind == "signup", "active").when(kind == "error", "failed")
              .otherwise("completed"))
    stay = F.expr("make_dt_interval(0, 0, 0, cast(round(value * 600) as decimal(18,6)))")
    staged = events.select(
        event.alias("id"),
        (F.col("user_id") * 3 + event % 3).alias("car_id"),
        F.when(event % 10 >= 3, (event * 7) % spot_count).alias("spot_id"),
        (event % 4).alias("tariff_id"),
        F.col("ts").alias("entry_time"),
        F.when(status == "completed", F.col("ts") + stay).alias("exit_time"),
        status.alias("status"),
    )
    priced = tariff_rows.select(F.col("id").alias("tariff_id"), "price_per_hour", "free_minutes")
    return staged.join(priced, "tariff_id").select(
        "id", "car_id", "spot_id", "tariff_id", "entry_time", "exit_time",
        parking_cost("entry_time", "exit_time", "price_per_hour", "free_minutes")
        .alias("total_cost"), "status")


def entry_logs(events: DataFrame) -> DataFrame:
    event = F.col("event_id")
    denied = F.col("event_type") == "error"
    reason = (F.when(event % 3 == 0, "Insufficient balance")
              .when(event % 3 == 1, "User is blocked"))
    return events.select(
        event.alias("id"),
        F.concat(F.lit("P"), (F.col("user_id") * 3 + event % 3).cast("string"))
        .alias("plate_number"),
        (event % 2).alias("gate_id"), F.col("ts").alias("attempt_time"),
        F.when(denied, "denied").otherwise("allowed").alias("result"),
        F.when(denied, reason).alias("reason"))


def transactions(events: DataFrame, session_rows: DataFrame) -> DataFrame:
    """Charges of completed sessions, all top-ups and all adjustments."""
    event = F.col("event_id")
    operation = (F.when(F.col("event_type") == "purchase", "topup")
                 .when((F.col("event_type") == "signup") & (event % 5 == 0), "adjustment"))
    amount = F.col("value").cast("decimal(12,2)")
    others = (events.select(event, "user_id", "ts", amount.alias("amount"),
                            operation.alias("operation_type"))
              .where("operation_type is not null")
              .select((event * 3 + F.when(F.col("operation_type") == "topup", 1).otherwise(2))
                      .alias("id"),
                      F.col("user_id").alias("wallet_id"),
                      F.lit(None).cast("bigint").alias("session_id"),
                      F.when(F.col("operation_type") == "topup", F.col("amount"))
                      .otherwise(-F.col("amount")).cast("decimal(12,2)").alias("amount"),
                      "operation_type", F.col("ts").alias("created_at"),
                      F.lit(None).cast("string").alias("comment")))
    charges = (session_rows.where(F.col("status") == "completed")
               .select((F.col("id") * 3).alias("id"),
                       F.expr("car_id div 3").alias("wallet_id"),
                       F.col("id").alias("session_id"),
                       (-F.col("total_cost")).cast("decimal(12,2)").alias("amount"),
                       F.lit("parking_charge").alias("operation_type"),
                       F.col("exit_time").alias("created_at"),
                       F.concat(F.lit("Parking session "), F.col("id").cast("string"))
                       .alias("comment")))
    return charges.unionByName(others)


def audit_logs(events: DataFrame) -> DataFrame:
    """One audited change per event, with its properties as the details."""
    event = F.col("event_id")
    action = F.element_at(F.array(F.lit("create"), F.lit("update"), F.lit("delete")),
                          (event % 3 + 1).cast("int"))
    kind = F.element_at(F.array(F.lit("cars"), F.lit("tariffs"), F.lit("wallet")),
                        (event % 3 + 1).cast("int"))
    return events.select(event.alias("id"), F.col("user_id"), kind.alias("entity_type"),
                         F.col("user_id").alias("entity_id"), action.alias("action"),
                         F.col("props").alias("details"), F.col("ts").alias("created_at"))


def sample_tables(spark: SparkSession, sf_dir: str) -> Tables:
    def stored(name: str) -> DataFrame:
        return read(spark, sf_dir, name)

    def session_rows() -> DataFrame:
        return sessions(stored("events"), stored("supplier"), tariffs(spark))

    return Tables(
        users=lambda: users(stored("customer")),
        wallets=lambda: wallets(stored("customer")),
        cars=lambda: cars(stored("customer")),
        access_levels=lambda: access_levels(spark),
        user_access_levels=lambda: grants(stored("customer")),
        parking_zones=lambda: zones(stored("region")),
        parking_spots=lambda: spots(stored("supplier"), stored("nation")),
        tariffs=lambda: tariffs(spark),
        gates=lambda: gates(spark),
        parking_sessions=session_rows,
        wallet_transactions=lambda: transactions(stored("events"), session_rows()),
        entry_logs=lambda: entry_logs(stored("events")),
        audit_logs=lambda: audit_logs(stored("events")),
    )
