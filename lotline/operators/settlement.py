"""Exit settlement of whole batches: close sessions, debit wallets, write charges.

Exits are taken in order of time, then key. Each closes the latest session of its
car that is still active, unless that is impossible; then nothing changes and the
session stays. Three facts turn this sequence into set operations:

* The batch only debits, so what a wallet can still pay never grows. A session its
  wallet could not pay at one exit costs no less at a later one, so after the first
  unpaid exit of a car all its later exits fail on the same session.
* Until then, the n-th exit of a car that is not before its latest entry closes the
  car's n-th latest session.
* A wallet that can pay all its exits needs no order at all.

Only wallets that cannot pay everything are played through in order: the exits of one
stream through a task, which holds the cars that are stuck and nothing else, however many
of them fail one after the other. Wallets too long for a task go by :func:`pay_in_phases`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lotline.functions.keys import derived_key
from lotline.functions.money import money_text, parking_cost
from lotline.operators.admission import check_gates
from lotline.operators.running import running_rank, running_total
from lotline.operators.spread import join_totals
from lotline.schemas import FLOOR_BALANCE
from lotline.session import cut_lineage
from lotline.sources.tables import Tables

FOLD_ROWS = 1_000_000
"""Exits of one wallet that a task takes in order; longer wallets are split over tasks, in phases."""

# Message texts.
NO_SESSION = "No active session found"
NO_TARIFF = "Tariff not found"
FAILED = "Error processing exit: "
BELOW_FLOOR = FAILED + 'new row for relation "wallets" violates check constraint "balance_check"'
BEFORE_ENTRY = (FAILED + 'new row for relation "parking_sessions" violates check constraint '
                '"exit_after_entry"')
WITHOUT_WALLET = (FAILED + 'null value in column "wallet_id" of relation "wallet_transactions" '
                  'violates not-null constraint')
CAR_UNKNOWN = "Car not found"


@dataclass
class Settlement:
    results: DataFrame       # one row per exit
    sessions: DataFrame      # the closed sessions, whole rows
    transactions: DataFrame  # one charge per closed session
    wallets: DataFrame       # debited wallets, whole rows


def resolve_exits(tables: Tables, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exit requests (id, plate_number, gate_id, exit_time) as exits of known cars.

    The gate must be an exit gate; the car may be inactive.
    """
    asked, rejected = check_gates(tables, requests, "exit")
    cars = tables.cars.select("plate_number", F.col("id").alias("car_id"))
    found = asked.join(cars, "plate_number", "left")
    unknown = (found.where("car_id is null").select(*requests.columns)
               .withColumn("error", F.lit(CAR_UNKNOWN)))
    return (found.where("car_id is not null").select("id", "car_id", "exit_time"),
            rejected.unionByName(unknown))


def match_exits(tables: Tables, exits: DataFrame) -> DataFrame:
    """Each exit with the session it would close if all earlier ones succeed.

    ``turn`` numbers the exits of a car from its latest entry on, 0 before it.
    """
    active = (tables.parking_sessions.where(F.col("status") == "active")
              .select(F.col("id").alias("session_id"), "car_id", "tariff_id", "entry_time")
              .join(exits.select("car_id"), "car_id", "left_semi"))
    latest = active.groupBy("car_id").agg(F.max("entry_time").alias("_latest"))
    asked = (exits.select(F.col("id").alias("exit_id"), "car_id", "exit_time")
             .transform(lambda rows: join_totals(rows, latest, ["car_id"])))
    timely = F.coalesce(F.col("exit_time") >= F.col("_latest"), F.lit(False))
    in_time = running_rank(asked.where(timely), ["car_id"], "exit_time", ["exit_id"], "turn")
    early = asked.where(~timely).withColumn("turn", F.lit(0).cast("bigint"))
    stack = running_rank(active, ["car_id"], "entry_time", ["session_id"], "turn",
                         descending=True).withColumnRenamed("turn", "_depth")
    cars = tables.cars.select(F.col("id").alias("car_id"), "user_id")
    wallets = tables.wallets.select(F.col("id").alias("wallet_id"), "user_id", "balance")
    tariffs = tables.tariffs.select(F.col("id").alias("tariff_id"), "price_per_hour",
                                    "free_minutes")
    turns = in_time.unionByName(early).withColumn(
        "_depth", F.greatest(F.col("turn"), F.lit(1).cast("bigint")))
    return (turns.join(stack, ["car_id", "_depth"], "left").join(tariffs, "tariff_id", "left")
            .join(cars.join(wallets, "user_id", "left"), "car_id", "left")
            .select("exit_id", "car_id", "wallet_id", "balance", "exit_time", "turn", "session_id",
                    F.col("price_per_hour").isNotNull().alias("_priced"),
                    parking_cost("entry_time", "exit_time", "price_per_hour", "free_minutes")
                    .alias("cost")))


def settle(tables: Tables, exits: DataFrame, fold_rows: int = FOLD_ROWS) -> Settlement:
    """Settles exits (id, car_id, exit_time); the input tables stay as they are."""
    matched = cut_lineage(match_exits(tables, exits))

    # Exits that fail whatever the balance. One on its session blocks the car for good.
    blocked = (F.col("session_id").isNotNull() & (F.col("turn") > 0)
               & (~F.col("_priced") | F.col("wallet_id").isNull()))
    blocks = (matched.where(blocked).groupBy("car_id").agg(F.min("turn").alias("_blocked_from")))
    staged = join_totals(matched, blocks, ["car_id"]).withColumn(
        "_payable", (F.col("turn") > 0) & F.col("session_id").isNotNull()
        & (F.col("_blocked_from").isNull() | (F.col("turn") < F.col("_blocked_from"))))
    due = staged.where("_payable").select(
        "exit_id", "car_id", "wallet_id", "exit_time", "turn",
        (F.col("cost") * 100).cast("bigint").alias("cents"),
        ((F.col("balance") - F.lit(FLOOR_BALANCE).cast("decimal(12,2)")) * 100)
        .cast("bigint").alias("room"))
    paid = cut_lineage(pay(due, fold_rows)).withColumn("_paid", F.lit(True))

    # The first unpaid exit of a car fixes the session and the reason of all later ones.
    outcome = staged.join(paid, "exit_id", "left").withColumn(
        "_paid", F.coalesce("_paid", F.lit(False)))
    stuck = (outcome.where((F.col("turn") > 0) & F.col("session_id").isNotNull() & ~F.col("_paid"))
             .groupBy("car_id")
             .agg(F.min_by(F.struct(F.col("turn"), F.col("session_id"), F.col("_priced"),
                                    F.col("wallet_id").isNotNull().alias("_funded")), "turn")
                  .alias("_stuck")))
    outcome = cut_lineage(join_totals(outcome, stuck, ["car_id"]))
    return _publish(tables, outcome)


def _publish(tables: Tables, outcome: DataFrame) -> Settlement:
    paid = outcome.where("_paid")
    charged = running_total(paid, ["wallet_id"], "exit_time", ["exit_id"], "cost", "_charged")
    charged = charged.select("exit_id", (F.col("balance") - F.col("_charged"))
                             .cast("decimal(12,2)").alias("new_balance"))
    stuck = F.col("_stuck")
    held = stuck.isNotNull() & (F.col("turn") >= stuck.getField("turn"))
    reason = (F.when(F.col("_paid"),
                     F.concat(F.lit("Exit processed. Cost: "), money_text("cost"),
                              F.lit(", New balance: "), money_text("new_balance")))
              .when(held & ~stuck.getField("_priced"), NO_TARIFF)
              .when(held & ~stuck.getField("_funded"), WITHOUT_WALLET)
              .when(held, BELOW_FLOOR)
              .when(F.col("session_id").isNull(), NO_SESSION)
              .when(~F.col("_priced"), NO_TARIFF)
              .otherwise(BEFORE_ENTRY))
    results = outcome.join(charged, "exit_id", "left").select(
        F.col("exit_id").alias("id"), "car_id", F.col("_paid").alias("success"),
        F.when(held, stuck.getField("session_id")).otherwise(F.col("session_id"))
        .alias("session_id"),
        F.when(F.col("_paid"), F.col("cost")).alias("cost"), reason.alias("message"))

    closing = paid.select(F.col("session_id").alias("id"), F.col("exit_time").alias("_exit"),
                          F.col("cost").alias("_cost"))
    sessions = (tables.parking_sessions.where(F.col("status") == "active").join(closing, "id")
                .withColumn("exit_time", F.col("_exit")).withColumn("total_cost", F.col("_cost"))
                .withColumn("status", F.lit("completed"))
                .select(*tables.parking_sessions.columns))
    transactions = paid.select(
        derived_key("charge", "session_id").alias("id"), "wallet_id", "session_id",
        (-F.col("cost")).cast("decimal(12,2)").alias("amount"),
        F.lit("parking_charge").alias("operation_type"), F.col("exit_time").alias("created_at"),
        F.concat(F.lit("Parking session "), F.col("session_id").cast("string")).alias("comment"))
    debits = paid.groupBy(F.col("wallet_id").alias("id")).agg(
        F.sum("cost").alias("_debit"), F.max("exit_time").alias("_at"))
    wallets = (tables.wallets.join(debits, "id")
               .withColumn("balance", (F.col("balance") - F.col("_debit")).cast("decimal(12,2)"))
               .withColumn("updated_at", F.col("_at")).select(*tables.wallets.columns))
    return Settlement(results, sessions, transactions, wallets)


def apply_settlement(tables: Tables, done: Settlement) -> Tables:
    """The tables after the settlement, to be published as a new snapshot."""
    def merged(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.join(new.select("id"), "id", "left_anti").select(*old.columns).unionByName(new)

    charges = done.transactions.withColumn(
        "id", F.col("id").cast(tables.wallet_transactions.schema["id"].dataType))
    return tables.replace(
        parking_sessions=merged(tables.parking_sessions, done.sessions),
        wallets=merged(tables.wallets, done.wallets),
        wallet_transactions=tables.wallet_transactions.unionByName(charges))


def pay(due: DataFrame, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Keys of the exits (exit_id, car_id, wallet_id, exit_time, turn, cents, room) that are paid."""
    per_wallet = due.groupBy("wallet_id").agg(
        F.sum("cents").alias("_all"), F.count(F.lit(1)).alias("_rows"))
    sized = join_totals(due, per_wallet, ["wallet_id"], "inner")
    enough = F.col("_all") <= F.col("room")
    short = sized.where(~enough & (F.col("_rows") <= fold_rows))
    long = sized.where(~enough & (F.col("_rows") > fold_rows)).drop("_all", "_rows")
    return (sized.where(enough).select("exit_id")
            .unionByName(_fold(short)).unionByName(pay_in_phases(long)))


def _play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exits (wallet, room, car, cents, exit) in order, wallet after wallet: those that are paid."""
    wallet, room, stuck = None, 0, set()
    for batch in batches:
        pays = []
        for of, start, car, cents in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if of != wallet:
                wallet, room, stuck = of, start, set()
            paid = cents <= room and car not in stuck
            if paid:
                room -= cents
            else:
                stuck.add(car)
            pays.append(paid)
        yield batch.select([4]).filter(pa.array(pays, pa.bool_()))


def _fold(short: DataFrame) -> DataFrame:
    """Plays wallets through in order, each in one task that streams its exits."""
    rows = short.select("wallet_id", "room", "car_id", "cents", "exit_id", "exit_time").repartition("wallet_id")
    rows = rows.sortWithinPartitions("wallet_id", "exit_time", "exit_id").drop("exit_time")
    return rows.mapInArrow(_play, rows.select("exit_id").schema)


def pay_in_phases(due: DataFrame) -> DataFrame:
    """The same outcome for wallets of any length, without bringing one to a single task.

    Let ``unit`` be the largest power of two within the room of a wallet. Until the
    room falls below it, every charge under ``unit`` is paid, and of the larger ones
    at most one can be. So a running total of the small charges tells the room before
    each large one, and a phase ends at the first row where the room falls below
    ``unit``, a large charge is paid, or one fails that has later exits of its car.
    Each phase settles all rows up to there; a paid large charge or a fallen room at
    least halves ``unit``, so the phases are few.
    """
    order = F.struct("exit_time", "exit_id")
    zero = F.lit(0).cast("bigint")
    open_rows = cut_lineage(due)
    paid = [open_rows.limit(0).select("exit_id")]
    while not open_rows.isEmpty():
        # Charges above the room fail now or later, and take their car's later exits along.
        ahead = open_rows.groupBy("wallet_id", "car_id").agg(
            F.min(F.when(F.col("cents") > F.col("room"), F.col("turn"))).alias("_stuck_from"),
            F.max("turn").alias("_last"))
        alive = (join_totals(open_rows, ahead, ["wallet_id", "car_id"], "inner")
                 .where(F.col("_stuck_from").isNull() | (F.col("turn") < F.col("_stuck_from")))
                 .withColumn("_more", F.col("turn") < F.least(
                     F.col("_last"), F.coalesce(F.col("_stuck_from") - 1, F.col("_last"))))
                 .drop("_stuck_from", "_last"))
        unit = F.when(F.col("room") > 0, F.call_function(
            "shiftleft", F.lit(1).cast("bigint"), F.length(F.bin("room")) - 1)).otherwise(zero)
        sized = alive.withColumn("_unit", unit).withColumn(
            "_small", (F.col("cents") < F.col("_unit")) | (F.col("cents") == 0))
        sized = sized.withColumn("_part", F.when(F.col("_small"), F.col("cents")).otherwise(zero))
        walked = running_total(sized, ["wallet_id"], "exit_time", ["exit_id"], "_part", "_sum")
        left = F.col("room") - F.col("_sum")
        fits = ~F.col("_small") & (F.col("cents") <= left)
        ends = ((F.col("_small") & (left < F.col("_unit"))) | fits
                | (~F.col("_small") & ~fits & F.col("_more")))
        walked = cut_lineage(walked.withColumn("_order", order).withColumn("_ends", ends)
                             .withColumn("_pays", F.col("_small") | fits))
        stops = (walked.where("_ends").groupBy("wallet_id")
                 .agg(F.min_by(F.struct(
                     F.col("_order").alias("at"), F.col("car_id").alias("car"),
                     (~F.col("_pays")).alias("failed"),
                     (F.col("_sum") + F.when(F.col("_pays") & ~F.col("_small"), F.col("cents"))
                      .otherwise(zero)).alias("spent")), "_order").alias("_stop")))
        stopped = join_totals(walked, stops, ["wallet_id"])
        stop = F.col("_stop")
        done = stop.isNull() | (F.col("_order") <= stop.getField("at"))
        paid.append(stopped.where(done & F.col("_pays")).select("exit_id"))
        stuck = stop.getField("failed") & (stop.getField("car") == F.col("car_id"))
        open_rows = cut_lineage(
            stopped.where(~done & ~stuck)
            .withColumn("room", F.col("room") - stop.getField("spent"))
            .select(*due.columns))
    return reduce(DataFrame.unionByName, paid)
