"""Synthetic parking data of any size.

Every value is a hash of a row number and a salt, so the data is the same on every
run and for every partitioning, and references are computed rather than joined.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal
from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lotline.functions.keys import derived_key
from lotline.schemas import struct_of
from lotline.sources.seeds import GATE_ROWS, LEVEL_ROWS, TARIFF_ROWS, ZONE_ROWS, seed_tables
from lotline.sources.tables import Tables

# Letters of plates, shares of statuses and ranges of amounts.
PLATE_LETTERS = "АВЕКМНОРСТУХ"
REGIONS = 199
COMPLETED_PERCENT, ACTIVE_PERCENT = 80, 15
PHONES = 1_000_000_000
PLATES = len(PLATE_LETTERS) ** 3 * 900 * REGIONS
DAYS = 30


def _pick(n, salt: str, *numbers) -> Column:
    """A number below ``n`` that depends on the row numbers and the salt."""
    numbers = [F.col(c) if isinstance(c, str) else c for c in (numbers or ("n",))]
    return F.pmod(F.xxhash64(F.lit(salt), *numbers), F.lit(n).cast("bigint"))


def _chance(percent: int, salt: str, *numbers) -> Column:
    return _pick(100, salt, *numbers) < percent


def _scattered(number: Column, size: int, step: int) -> Column:
    """A one-to-one scattering of the numbers below ``size``."""
    if gcd(size, step) != 1:
        raise ValueError("step and size share a factor")
    return number * step % size


def _one_of(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]),
                        (index + 1).cast("int"))


def _cars_of(user: Column) -> Column:
    return _pick(3, "cars", user) + 1


def _plate(car: Column) -> Column:
    code = _scattered(car, PLATES, 100_000_007)
    letters = len(PLATE_LETTERS)

    def digit(part: Column, size: int) -> Column:
        return F.pmod(part, F.lit(size))

    def letter(part: Column) -> Column:
        return F.substring(F.lit(PLATE_LETTERS), (digit(part, letters) + 1).cast("int"), F.lit(1))

    def over(size: int) -> Column:
        return F.call_function("div", code, F.lit(size).cast("bigint"))

    number = (digit(over(letters ** 3), 900) + 100).cast("string")
    region = (over(letters ** 3 * 900) + 1).cast("string")
    return F.concat(letter(code), number, letter(over(letters)), letter(over(letters ** 2)), region)


def _car_key(user: Column, number: Column) -> Column:
    return derived_key("car", user * 3 + number)


class Generator:
    def __init__(self, spark: SparkSession, users: int, sessions: int, topups: int,
                 now: dt.datetime, partitions: int | None = None):
        if users > PHONES or users * 3 > PLATES:
            raise ValueError(f"at most {min(PHONES, PLATES // 3)} users have phones and plates")
        self.spark, self.users_n, self.sessions_n, self.topups_n = spark, users, sessions, topups
        self.now, self.partitions = F.lit(now).cast("timestamp_ntz"), partitions
        self.start = F.lit(now - dt.timedelta(days=DAYS)).cast("timestamp_ntz")

    def _rows(self, n: int) -> DataFrame:
        return self.spark.range(0, n, 1, self.partitions).withColumnRenamed("id", "n")

    def _moment(self, salt: str) -> Column:
        seconds = _pick(DAYS * 86_400, salt)
        return self.start + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))

    def users(self) -> DataFrame:
        phone = F.lit(9_000_000_000) + _scattered(F.col("n"), PHONES, 387_420_489)
        return self._rows(self.users_n).select(
            derived_key("user", "n").alias("id"),
            F.concat(F.lit("+7"), phone.cast("string")).alias("phone"),
            F.when(_chance(70, "email"), F.concat(F.lit("user"), F.col("n").cast("string"),
                                                  F.lit("@example.com"))).alias("email"),
            F.lit("$2b$12$dummyhash").alias("password_hash"), self.start.alias("created_at"),
            _chance(5, "blocked").alias("is_blocked"))

    def grants(self) -> DataFrame:
        levels = [derived_key("access_levels", F.lit(code)) for code, _ in LEVEL_ROWS]
        return self._rows(self.users_n).where(_chance(30, "granted")).select(
            derived_key("grant", "n").alias("id"), derived_key("user", "n").alias("user_id"),
            _one_of(levels, _pick(len(levels), "level")).alias("access_level_id"),
            self.start.alias("granted_at"))

    def cars(self) -> DataFrame:
        user = F.col("user")
        return (self._rows(self.users_n)
                .select(F.col("n").alias("user"),
                        F.explode(F.sequence(F.lit(0).cast("bigint"), _cars_of(F.col("n")) - 1))
                        .alias("number"))
                .withColumn("n", user * 3 + F.col("number"))
                .select(_car_key(user, F.col("number")).alias("id"),
                        derived_key("user", user).alias("user_id"), _plate(F.col("n")).alias("plate_number"),
                        F.concat(F.lit("Maker "), (_pick(500, "maker") + 1).cast("string"), F.lit(" "),
                                 (_pick(25, "year") + 2000).cast("string")).alias("model"),
                        _chance(90, "car active").alias("is_active"), self.start.alias("created_at")))

    def _spots_in(self, zone: Column) -> Column:
        return _pick(31, "spots", zone) + 20

    def spots(self) -> DataFrame:
        zones = [derived_key("parking_zones", F.lit(name)) for name, _ in ZONE_ROWS]
        return (self._rows(len(zones))
                .select(F.col("n").alias("zone"), F.explode(F.sequence(
                    F.lit(1).cast("bigint"), self._spots_in(F.col("n")))).alias("number"))
                .withColumn("n", F.col("zone") * 100 + F.col("number"))
                .select(derived_key("spot", "n").alias("id"),
                        _one_of(zones, F.col("zone")).alias("zone_id"),
                        F.concat(F.lit("SP-"), F.lpad(F.col("number").cast("string"), 3, "0"))
                        .alias("spot_number"),
                        _chance(10, "reserved").alias("is_reserved"),
                        _chance(95, "spot active").alias("is_active")))

    def _session_facts(self) -> DataFrame:
        """Sessions with their row number, owner and billing numbers."""
        tariff, user, zone = F.col("tariff"), F.col("user"), F.col("zone")
        names = [derived_key("tariffs", F.lit(r[0])) for r in TARIFF_ROWS]
        share = _pick(100, "status")
        status = (F.when(share < COMPLETED_PERCENT, "completed")
                  .when(share < COMPLETED_PERCENT + ACTIVE_PERCENT, "active").otherwise("failed"))
        seconds = _pick(int(11.5 * 3600) + 1, "stay") + 1800
        drawn = self._rows(self.sessions_n).select(
            "n", _pick(self.users_n, "user").alias("user"), _pick(len(names), "tariff").alias("tariff"),
            _pick(len(ZONE_ROWS), "zone").alias("zone"), status.alias("status"),
            self._moment("entry").alias("entry_time"), seconds.alias("seconds"))
        drawn = drawn.withColumn("car", F.pmod(F.xxhash64(F.lit("car"), "n"), _cars_of(user)))
        spot = zone * 100 + F.pmod(F.xxhash64(F.lit("spot"), "n"), self._spots_in(zone)) + 1
        done = F.col("status") == "completed"
        # Stays are billed here by the second, not in rounded minutes.
        billable = F.greatest(F.lit(0).cast("bigint"), F.col("seconds")
                              - _one_of([r[2] * 60 for r in TARIFF_ROWS], tariff))
        price = _one_of([F.lit(r[1]).cast("decimal(10,2)") for r in TARIFF_ROWS], tariff)
        cost = F.round(billable.cast("decimal(12,0)") * price / F.lit(Decimal(3600)), 2)
        return drawn.select(
            "n", "user", "status", "entry_time", derived_key("session", "n").alias("id"),
            _car_key(user, F.col("car")).alias("car_id"), (user * 3 + F.col("car")).alias("car_no"),
            F.when(_chance(70, "placed"), derived_key("spot", spot)).alias("spot_id"),
            _one_of(names, tariff).alias("tariff_id"),
            F.when(done, F.col("entry_time") + F.make_dt_interval(
                secs=F.col("seconds").cast("decimal(18,6)"))).alias("exit_time"),
            F.when(done, cost).cast("decimal(12,2)").alias("total_cost"))

    def sessions(self) -> DataFrame:
        return self._session_facts().select("id", "car_id", "spot_id", "tariff_id", "entry_time",
                                            "exit_time", "total_cost", "status")

    def entry_logs(self) -> DataFrame:
        gates = [derived_key("gates", F.lit(name)) for name, kind in GATE_ROWS if kind == "entry"]
        failed = F.col("status") == "failed"
        return self._session_facts().select(
            derived_key("entry_log", "n").alias("id"), _plate(F.col("car_no")).alias("plate_number"),
            _one_of(gates, _pick(len(gates), "gate")).alias("gate_id"),
            F.col("entry_time").alias("attempt_time"),
            F.when(failed, "denied").otherwise("allowed").alias("result"),
            F.when(failed, "Insufficient balance").alias("reason"))

    def transactions(self) -> DataFrame:
        charges = self._session_facts().where("status = 'completed'").select(
            derived_key("charge", "n").alias("id"), derived_key("wallet", "user").alias("wallet_id"),
            F.col("id").alias("session_id"), (-F.col("total_cost")).cast("decimal(12,2)").alias("amount"),
            F.lit("parking_charge").alias("operation_type"), self.now.alias("created_at"),
            F.lit("Parking session").alias("comment"))
        cents = _pick(490_001, "amount") + 10_000
        topups = self._rows(self.topups_n).select(
            derived_key("topup", "n").alias("id"),
            derived_key("wallet", _pick(self.users_n, "payer")).alias("wallet_id"),
            F.lit(None).cast("string").alias("session_id"),
            (cents.cast("decimal(12,0)") * F.lit(Decimal("0.01"))).cast("decimal(12,2)").alias("amount"),
            F.lit("topup").alias("operation_type"), self._moment("paid").alias("created_at"),
            F.lit("Top-up").alias("comment"))
        return charges.unionByName(topups)

    def wallets(self) -> DataFrame:
        """Opening amounts between 2,000 and 50,000 plus everything that moved."""
        opening = (_pick(4_800_001, "opening") + 200_000).cast("decimal(12,0)") * F.lit(Decimal("0.01"))
        moved = self.transactions().groupBy(F.col("wallet_id").alias("id")).agg(
            F.sum("amount").alias("_moved"))
        return (self._rows(self.users_n)
                .select(derived_key("wallet", "n").alias("id"), derived_key("user", "n").alias("user_id"),
                        opening.alias("_opening"))
                .join(moved, "id", "left")
                .select("id", "user_id", (F.col("_opening") + F.coalesce("_moved", F.lit(0)))
                        .cast("decimal(12,2)").alias("balance"),
                        F.lit("RUB").alias("currency"), self.now.alias("updated_at")))


def generate(spark: SparkSession, users: int = 75, sessions: int = 4000, topups: int = 350,
             now: dt.datetime = dt.datetime(2024, 2, 1), partitions: int | None = None) -> Tables:
    """A whole set of tables: seed rows, users, cars, spots, sessions and what follows."""
    g, seeds = Generator(spark, users, sessions, topups, now, partitions), seed_tables(spark)
    return Tables(
        users=g.users, wallets=g.wallets, cars=g.cars, access_levels=seeds.access_levels,
        user_access_levels=g.grants, parking_zones=seeds.parking_zones, parking_spots=g.spots,
        tariffs=seeds.tariffs, gates=seeds.gates, parking_sessions=g.sessions,
        wallet_transactions=g.transactions, entry_logs=g.entry_logs,
        audit_logs=lambda: _no_audit(spark))


def _no_audit(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], struct_of("audit_logs"))
