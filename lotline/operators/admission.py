"""Entry decisions, tariff assignment and session opening for whole batches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from lotline.functions.keys import derived_key
from lotline.functions.money import money_text
from lotline.operators.ledger import moved_until
from lotline.operators.spread import join_totals
from lotline.schemas import ENTRY_MINIMUM
from lotline.sources.tables import Tables

# Reason texts.
NO_CAR = "Car not found or inactive"
BLOCKED = "User is blocked"
NO_WALLET = "Wallet not found"
ALLOWED = "Entry allowed"
GATE_UNKNOWN = "Gate not found"
GATE_NOT_ENTRY = "Gate is not an entry gate"
GATE_NOT_EXIT = "Gate is not an exit gate"


def _minimum():
    return F.lit(ENTRY_MINIMUM).cast("decimal(12,2)")


@dataclass
class Admission:
    decisions: DataFrame
    entry_logs: DataFrame
    rejected: DataFrame


def entry_profiles(tables: Tables) -> DataFrame:
    """One row per active car: its plate with everything the decision reads."""
    cars = tables.cars.where("is_active").select(F.col("id").alias("car_id"), "user_id",
                                                 "plate_number")
    users = tables.users.select(F.col("id").alias("user_id"), "is_blocked")
    wallets = tables.wallets.select(F.col("id").alias("wallet_id"), "user_id", "balance")
    return cars.join(users, "user_id", "left").join(wallets, "user_id", "left")


def decide(profiled: DataFrame) -> DataFrame:
    """Applies the rules in order to attempts that carry their profile columns.

    Unknown or inactive car, blocked user, no wallet, balance below the minimum;
    otherwise allowed. A decision shows only what it looked at.
    """
    car, wallet = F.col("car_id").isNotNull(), F.col("wallet_id").isNotNull()
    blocked = F.coalesce("is_blocked", F.lit(False))
    poor = F.concat(F.lit("Insufficient balance: "), money_text("balance"),
                    F.lit(" (minimum: "), F.lit(ENTRY_MINIMUM), F.lit(")"))
    reason = (F.when(~car, NO_CAR).when(blocked, BLOCKED).when(~wallet, NO_WALLET)
              .when(F.col("balance") < _minimum(), poor).otherwise(ALLOWED))
    saw_wallet = car & ~blocked & wallet
    return profiled.select(
        "id", "plate_number", "gate_id", "attempt_time",
        (reason == ALLOWED).alias("allowed"), reason.alias("reason"), "car_id", "user_id",
        F.when(saw_wallet, F.col("wallet_id")).alias("wallet_id"),
        F.when(saw_wallet, F.col("balance")).alias("balance"))


def check_gates(tables: Tables, requests: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Requests at a gate of this kind, and the others with the reason."""
    gates = tables.gates.select(F.col("id").alias("gate_id"), F.col("type").alias("_type"))
    wrong = GATE_NOT_ENTRY if kind == "entry" else GATE_NOT_EXIT
    checked = requests.join(gates, "gate_id", "left").withColumn(
        "error", F.when(F.col("_type").isNull(), GATE_UNKNOWN).when(F.col("_type") != kind, wrong))
    return (checked.where("error is null").select(*requests.columns),
            checked.where("error is not null").select(*requests.columns, "error"))


def admit(tables: Tables, attempts: DataFrame, at_balance_of: DataFrame | None = None) -> Admission:
    """Decides attempts (id, plate_number, gate_id, attempt_time) at entry gates.

    ``at_balance_of`` holds wallet operations: with it the balance is the one at
    the time of the attempt, counted from the wallet's stored balance as opening.
    """
    asked, rejected = check_gates(tables, attempts, "entry")
    profiled = asked.join(entry_profiles(tables), "plate_number", "left")
    if at_balance_of is not None:
        profiled = moved_until(at_balance_of, profiled, "attempt_time")
        profiled = profiled.withColumn("balance", (F.col("balance") + F.col("moved"))
                                       .cast("decimal(22,2)"))
    decisions = decide(profiled)
    return Admission(decisions, entry_log_rows(decisions), rejected)


def entry_log_rows(decisions: DataFrame) -> DataFrame:
    """The log row of every decided attempt."""
    return decisions.select(
        derived_key("entry_log", "id").alias("id"), "plate_number", "gate_id", "attempt_time",
        F.when(F.col("allowed"), "allowed").otherwise("denied").alias("result"), "reason")


def assign_tariffs(tables: Tables, requests: DataFrame) -> DataFrame:
    """Adds ``tariff_id`` and ``matched_by`` to requests with ``user_id`` and ``zone_id``.

    The most specific tariff wins: level and zone, level, zone, then one for all;
    within each the lowest price, then the lowest key. Each class is reduced to one
    row per lookup key first, so no request ever multiplies.
    """
    choice = F.struct("price_per_hour", F.col("id").alias("tariff"))
    tariffs = tables.tariffs.select("*", choice.alias("_choice"))
    levelled = tariffs.where(F.col("access_level_id").isNotNull())
    general = tariffs.where(F.col("access_level_id").isNull())
    held = tables.user_access_levels.select("user_id", "access_level_id")
    granted = held.join(levelled.select("access_level_id", "zone_id", "_choice"),
                        "access_level_id")

    def best(df: DataFrame, name: str, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.min("_choice").alias(name))

    zone = F.col("zone_id")
    by_both = best(granted.where(zone.isNotNull()), "_both", "user_id", "zone_id")
    by_level = best(granted.where(zone.isNull()), "_level", "user_id")
    by_zone = best(general.where(zone.isNotNull()), "_zone", "zone_id")
    for_all = general.where(zone.isNull()).agg(F.min("_choice").alias("_all")).scalar()
    matched = join_totals(requests, by_both, ["user_id", "zone_id"])
    matched = join_totals(matched, by_level, ["user_id"])
    matched = join_totals(matched, by_zone, ["zone_id"]).withColumn("_all", for_all)
    ranked = (("_both", "level and zone"), ("_level", "level"), ("_zone", "zone"), ("_all", "all"))
    chosen = F.coalesce(*[F.col(c) for c, _ in ranked])
    label = F.coalesce(*[F.when(F.col(c).isNotNull(), text) for c, text in ranked])
    return matched.select(*requests.columns, chosen.getField("tariff").alias("tariff_id"),
                          label.alias("matched_by"))


def open_sessions(tables: Tables, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New sessions of allowed attempts, and the attempts for which no tariff exists.

    A session opens without a spot, and a car may have several open ones.
    """
    zone_type = tables.tariffs.schema["zone_id"].dataType
    allowed = decisions.where("allowed").withColumn("zone_id", F.lit(None).cast(zone_type))
    priced = assign_tariffs(tables, allowed)
    opened = priced.where("tariff_id is not null").select(
        derived_key("session", "id").alias("id"), "car_id",
        F.lit(None).cast("string").alias("spot_id"), "tariff_id",
        F.col("attempt_time").alias("entry_time"), F.lit(None).cast("timestamp_ntz").alias("exit_time"),
        F.lit(None).cast("decimal(12,2)").alias("total_cost"), F.lit("active").alias("status"))
    without = priced.where("tariff_id is null").select(
        *decisions.columns, F.lit("No tariffs configured").alias("error"))
    return opened, without


def double_active(sessions: DataFrame) -> DataFrame:
    """Cars with more than one active session: a quality flag, not an error."""
    return (sessions.where(F.col("status") == "active").groupBy("car_id")
            .agg(F.count(F.lit(1)).alias("active_sessions")).where("active_sessions > 1"))
