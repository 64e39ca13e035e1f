"""Wallet ledger: balances, running balances, balances at a moment, top-ups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from lotline.functions.keys import derived_key
from lotline.functions.money import parking_cost
from lotline.operators.running import running_total, running_total_by_rows
from lotline.schemas import TABLES, struct_of
from lotline.sources.tables import Tables

LEDGER = tuple(TABLES["wallet_transactions"].columns)
AMOUNT = "decimal(12,2)"


def user_balance(tables: Tables, users: DataFrame | None = None) -> DataFrame:
    """Balance of each user, 0 without a wallet."""
    users = tables.users.select(F.col("id").alias("user_id")) if users is None else users
    wallets = tables.wallets.select("user_id", "balance")
    return users.join(wallets, "user_id", "left").select(
        "user_id", F.coalesce("balance", F.lit(0).cast(AMOUNT)).alias("balance"))


def charges_of(sessions: DataFrame, cars: DataFrame, wallets: DataFrame) -> DataFrame:
    """Charge rows of completed sessions."""
    payer = (cars.select(F.col("id").alias("car_id"), "user_id")
             .join(wallets.select(F.col("id").alias("wallet_id"), "user_id"), "user_id"))
    return (sessions.where((F.col("status") == "completed") & F.col("total_cost").isNotNull())
            .join(payer, "car_id")
            .select(derived_key("charge", "id").alias("id"), "wallet_id",
                    F.col("id").alias("session_id"),
                    (-F.col("total_cost")).cast(AMOUNT).alias("amount"),
                    F.lit("parking_charge").alias("operation_type"),
                    F.col("exit_time").alias("created_at"),
                    F.concat(F.lit("Parking session "), F.col("id").cast("string"))
                    .alias("comment")))


def build_ledger(*parts: DataFrame) -> DataFrame:
    """Charges, top-ups and adjustments in one table of wallet operations."""
    ledger = parts[0].select(*LEDGER)
    for part in parts[1:]:
        ledger = ledger.unionByName(part.select(*LEDGER))
    return ledger


def current_balances(wallets: DataFrame, transactions: DataFrame) -> DataFrame:
    """Opening balance plus all operations, per wallet."""
    moved = (transactions.groupBy(F.col("wallet_id").alias("id"))
             .agg(F.sum("amount").alias("moved"), F.count(F.lit(1)).alias("operations")))
    zero = F.lit(0)
    return wallets.select("id", F.col("balance").alias("opening")).join(moved, "id", "left").select(
        F.col("id").alias("wallet_id"), "opening",
        F.coalesce("operations", zero).alias("operations"),
        (F.col("opening") + F.coalesce("moved", zero)).cast("decimal(22,2)").alias("balance"))


def running_balances(wallets: DataFrame, transactions: DataFrame, by_rows: bool = False) -> DataFrame:
    """Every operation with the balance of its wallet just after it.

    ``by_rows`` cuts histories by number of rows instead of hours, for wallets with very many operations at a time.
    """
    total = running_total_by_rows if by_rows else running_total
    totals = total(transactions, ["wallet_id"], "created_at", ["id"], "amount", "_moved")
    opening = wallets.select(F.col("id").alias("wallet_id"), F.col("balance").alias("_opening"))
    return totals.join(opening, "wallet_id").select(
        *transactions.columns,
        (F.col("_opening") + F.col("_moved")).cast("decimal(22,2)").alias("balance_after"))


def moved_until(transactions: DataFrame, moments: DataFrame, at: str) -> DataFrame:
    """Adds ``moved`` to rows with a ``wallet_id``: what the wallet's operations sum up to
    by the time in column ``at``, operations of the same instant included.

    Rows without a wallet get NULL. They go around the shuffles, where they would all share one key.

    The rows join the operations as rows that move nothing, so one running total
    answers them all and nothing has to be joined back.
    """
    zero = F.lit(0).cast(AMOUNT)
    moves = transactions.select("wallet_id", F.col("created_at").alias("_at"),
                                F.lit(0).alias("_kind"), F.col("amount").alias("_amount")).where("wallet_id is not null")
    asked = moments.where("wallet_id is not null").select("*", F.col(at).alias("_at"), F.lit(1).alias("_kind"),
                           zero.alias("_amount"))
    line = asked.unionByName(moves, allowMissingColumns=True)
    # Ties of one kind need no further order: the asking rows add nothing, and all
    # operations of the instant come before them.
    line = running_total(line, ["wallet_id"], "_at", ["_kind"], "_amount", "_moved")
    line = line.where(F.col("_kind") == 1).select(*moments.columns, F.col("_moved").alias("moved"))
    others = moments.where("wallet_id is null").withColumn("moved", F.lit(None).cast(line.schema["moved"].dataType))
    return line.unionByName(others)


def balances_at(wallets: DataFrame, transactions: DataFrame, moments: DataFrame,
                at: str = "moment") -> DataFrame:
    """Adds ``balance_then``: the stored balance as opening plus what moved until then."""
    opening = wallets.select(F.col("id").alias("wallet_id"), F.col("balance").alias("_opening"))
    return (moved_until(transactions, moments, at).join(opening, "wallet_id")
            .withColumn("balance_then", (F.col("_opening") + F.col("moved")).cast("decimal(22,2)"))
            .drop("_opening", "moved"))


@dataclass
class TopUps:
    transactions: DataFrame
    balances: DataFrame
    audit: DataFrame
    rejected: DataFrame


def post_topups(tables: Tables, batch: DataFrame) -> TopUps:
    """Posts top-ups (id, user_id, amount, created_at, comment) to the users' wallets."""
    positive = F.coalesce(F.col("amount") > 0, F.lit(False))
    wallets = tables.wallets.select(F.col("id").alias("wallet_id"), "user_id",
                                    F.col("balance").alias("_opening"))
    found = batch.withColumn("amount", F.col("amount").cast(AMOUNT)).join(wallets, "user_id", "left")
    reason = (F.when(~positive, "Amount must be positive")
              .when(F.col("wallet_id").isNull(), "Wallet not found"))
    rejected = found.withColumn("reason", reason).where("reason is not null").select(
        *batch.columns, "reason")
    posted = running_total(found.where(reason.isNull()), ["wallet_id"], "created_at", ["id"],
                           "amount", "_moved")
    posted = posted.withColumn("new_balance", (F.col("_opening") + F.col("_moved")).cast(AMOUNT))
    transactions = posted.select(
        "id", "wallet_id", F.lit(None).cast("string").alias("session_id"), "amount",
        F.lit("topup").alias("operation_type"), "created_at",
        F.when(F.coalesce("comment", F.lit("")) != "", F.col("comment"))
        .otherwise("Wallet top-up").alias("comment"))
    details = F.to_json(F.struct(F.col("amount").cast("double").alias("amount"),
                                 F.lit("topup").alias("operation"),
                                 F.col("new_balance").cast("double").alias("new_balance")))
    audit = posted.select(
        derived_key("topup_audit", "id").alias("id"), "user_id",
        F.lit("wallet").alias("entity_type"), F.col("wallet_id").alias("entity_id"),
        F.lit("update").alias("action"), details.alias("details"), "created_at")
    added = found.where(reason.isNull()).groupBy("wallet_id").agg(
        F.sum("amount").alias("_added"), F.max("created_at").alias("_at"))
    balances = tables.wallets.join(added.withColumnRenamed("wallet_id", "id"), "id", "left").select(
        "id", "user_id",
        (F.col("balance") + F.coalesce("_added", F.lit(0))).cast(AMOUNT).alias("balance"),
        "currency", F.coalesce("_at", "updated_at").alias("updated_at"))
    return TopUps(transactions, balances, audit, rejected)


def reconcile_costs(tables: Tables) -> DataFrame:
    """Completed sessions against the tariff rule and against what was charged.

    Charges are added up per session first; either side may be missing.
    """
    tariffs = tables.tariffs.select(F.col("id").alias("tariff_id"), "price_per_hour",
                                    "free_minutes")
    sessions = (tables.parking_sessions.where(F.col("status") == "completed")
                .join(tariffs, "tariff_id", "left")
                .select(F.col("id").alias("session_id"), F.col("total_cost").alias("stored_cost"),
                        parking_cost("entry_time", "exit_time", "price_per_hour", "free_minutes")
                        .alias("rule_cost")))
    charged = (tables.wallet_transactions
               .where((F.col("operation_type") == "parking_charge")
                      & F.col("session_id").isNotNull())
               .groupBy("session_id").agg((-F.sum("amount")).alias("charged")))
    both = sessions.withColumn("_known", F.lit(True)).join(charged, "session_id", "full")
    verdict = (F.when(F.col("_known").isNull(), "charge without completed session")
               .when(F.col("charged").isNull(), "not charged")
               .when(~F.col("stored_cost").eqNullSafe(F.col("charged")), "charge differs")
               .when(F.col("rule_cost").isNull(), "tariff not found")
               .when(~F.col("stored_cost").eqNullSafe(F.col("rule_cost")), "rule differs")
               .otherwise("equal"))
    return both.select("session_id", "stored_cost", "rule_cost",
                       F.col("charged").cast("decimal(22,2)").alias("charged"),
                       verdict.alias("verdict"))


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], struct_of("wallet_transactions"))
