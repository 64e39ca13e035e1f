"""Entries, exits and top-ups of each user as one stateful flow.

Admission at some moment depends on the exits and top-ups before it, and all cars of
a user share one wallet, so the flow is kept per user: the balance, and per car the
stack of open sessions. Each passage yields one outcome.

Users are dealt into buckets, which are the keys of the stateful operator: a call into Python costs milliseconds and an access
to the state nearly half a one, as much for a bucket as for one user.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lotline.functions.times import EPOCH, elapsed_micros
from lotline.operators.admission import (ALLOWED, BLOCKED, NO_CAR, NO_WALLET, assign_tariffs)
from lotline.operators.settlement import BELOW_FLOOR, NO_SESSION, WITHOUT_WALLET
from lotline.schemas import ENTRY_MINIMUM, FLOOR_BALANCE
from lotline.sources.tables import Tables

OUTCOME = ("user_id string, id string, car_id string, kind string, at timestamp_ntz, done boolean, "
           "message string, session_id string, cents bigint, balance_cents bigint")
FLOOR_CENTS = int(float(FLOOR_BALANCE) * 100)
MINIMUM_CENTS = int(float(ENTRY_MINIMUM) * 100)
POOR = "Insufficient balance"
NO_TARIFFS = "No tariffs configured"
LATE = "Arrived late"
POSTED = "Top-up posted"
NOT_POSITIVE = "Amount must be positive"
OUT = [part.split()[0] for part in OUTCOME.split(", ")]
OUT_ROWS = 10_000
BUCKETS = 1024
NEVER = -(1 << 62)


def cost_cents(entry_us: int, exit_us: int, price_cents: int, free: int) -> int:
    """The tariff rule in whole numbers, as in ``lotline.functions.money``."""
    minutes = max(0, (exit_us - entry_us + 30_000_000) // 60_000_000 - free)
    n = minutes * price_cents
    return (n + 30) // 60 - (1 if n % 60 == 30 and minutes % 3 == 2 else 0)


class Passage(NamedTuple):
    """What the flow reads of a passage."""

    user_id: str
    id: str
    car_id: str
    kind: str
    at_us: int
    is_active: bool
    price_cents: int | None
    free_minutes: int | None
    amount_cents: int


def _passages(frames: Iterable[pd.DataFrame]) -> Iterator[Passage]:
    for frame in frames:
        columns = {c: frame[c].tolist() for c in Passage._fields}
        for c in ("price_cents", "free_minutes"):
            columns[c] = [None if pd.isna(value) else int(value) for value in columns[c]]
        yield from map(Passage._make, zip(*columns.values()))


class User:
    """State of one user: wallet, last time seen, open sessions per car."""

    def __init__(self, funded: bool = False, blocked: bool = False, balance: int = 0, seen: int = NEVER, stacks: Iterable = ()):
        self.funded, self.blocked, self.balance, self.seen = funded, blocked, balance, seen
        self.stacks = {car: stack for car, stack in stacks}

    def stored(self) -> tuple:
        return self.funded, self.blocked, self.balance, self.seen, [x for x in self.stacks.items() if x[1]]

    def take(self, p: Passage) -> tuple:
        """Whether the passage is done, the message, the session and the cents."""
        if p.at_us < self.seen:
            return False, LATE, None, None
        self.seen = int(p.at_us)
        if p.kind == "topup":
            return self._top_up(int(p.amount_cents))
        if p.kind == "entry":
            return self._enter(p)
        return self._leave(p)

    def _top_up(self, cents: int):
        if cents <= 0:
            return False, NOT_POSITIVE, None, None
        if not self.funded:
            return False, NO_WALLET, None, None
        self.balance += cents
        return True, POSTED, None, cents

    def _enter(self, p):
        for refused, message in ((not p.is_active, NO_CAR), (self.blocked, BLOCKED),
                                 (not self.funded, NO_WALLET),
                                 (self.balance < MINIMUM_CENTS, POOR),
                                 (p.price_cents is None, NO_TARIFFS)):
            if refused:
                return False, message, None, None
        self.stacks.setdefault(p.car_id, []).append((p.id, int(p.at_us), p.price_cents, p.free_minutes))
        return True, ALLOWED, p.id, None

    def _leave(self, p):
        stack = self.stacks.get(p.car_id)
        if not stack:
            return False, NO_SESSION, None, None
        session, entered, price, free = stack[-1]  # passages come in order, so the latest is last
        cents = cost_cents(entered, int(p.at_us), price, free)
        for refused, message in ((not self.funded, WITHOUT_WALLET),
                                 (self.balance - cents < FLOOR_CENTS, BELOW_FLOOR)):
            if refused:
                return False, message, session, None
        stack.pop()
        self.balance -= cents
        return True, "Exit processed", session, cents


def _frame(out: list) -> pd.DataFrame:
    columns = dict(zip(OUT, zip(*out)))
    columns["at"] = np.array(columns["at"], "datetime64[us]")
    for name in ("cents", "balance_cents"):
        columns[name] = pd.array(columns[name], "Int64")
    return pd.DataFrame(columns)


class GateFlow(StatefulProcessor):
    """State of a bucket: its users, as one text."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.users = handle.getValueState("users", "users string")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        users = self._users()
        for user, blocked, cents in zip(*(initialState[c].tolist() for c in ("user_id", "is_blocked", "balance_cents"))):
            if user not in users:
                funded = not pd.isna(cents)
                users[user] = User(funded, bool(blocked), int(cents) if funded else 0)
        self._store(users)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        yield from self._taken([list(_passages(rows))])

    def _taken(self, slices: Iterable[list[Passage]]) -> Iterator[pd.DataFrame]:
        """Outcomes of slices of passages, which follow each other in time; those of a user are taken in order of time."""
        users, out = self._users(), []
        for passages in slices:
            passages.sort(key=lambda p: (p.user_id, p.at_us, p.id))
            for p in passages:
                if (user := users.get(p.user_id)) is None:
                    user = users[p.user_id] = User()
                done, message, session, cents = user.take(p)
                out.append((p.user_id, p.id, p.car_id, p.kind, p.at_us, done, message, session, cents,
                            user.balance if user.funded else None))
                if len(out) == OUT_ROWS:
                    yield _frame(out)
                    out = []
        self._store(users)
        if out:
            yield _frame(out)

    def _users(self) -> dict[str, User]:
        held = self.users.get()
        return {} if held is None else {user: User(*state) for user, state in json.loads(held[0]).items()}

    def _store(self, users: dict[str, User]) -> None:
        self.users.update((json.dumps({name: user.stored() for name, user in users.items()}),))


class OrderedGateFlow(GateFlow):
    """Holds passages back in slices of event time until the watermark has passed a slice, and then takes it in order.

    A bucket has a timer for its earliest slice. When it goes off, all slices that the watermark has passed are taken one after the
    other, so a call holds one slice of a bucket, not the history of its users.
    """

    def __init__(self, slice_seconds: int):
        self.slice_us = slice_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle
        self.held = handle.getMapState("held", "slice bigint", "passages string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        slices: dict[int, list] = {}
        for p in _passages(rows):
            slices.setdefault(int(p.at_us) // self.slice_us, []).append(p)
        known = {number for number, in self.held.keys()}
        for number, passages in slices.items():
            before = self._held(number) if number in known else []
            self.held.updateValue((number,), (json.dumps(before + passages),))
        self.handle.registerTimer(self._passed_at(min(slices)))
        return iter(())

    def _passed_at(self, number: int) -> int:
        return (number + 1) * self.slice_us // 1000

    def _held(self, number: int) -> list[Passage]:
        return [Passage(*p) for p in json.loads(self.held.getValue((number,))[0])]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        until = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        numbers = sorted(number for number, in self.held.keys())
        due = [number for number in numbers if self._passed_at(number) <= until]
        if not due:
            return
        yield from self._taken(map(self._held, due))
        if len(due) == len(numbers):
            self.held.clear()
            return
        for number in due:
            self.held.removeKey((number,))
        self.handle.registerTimer(self._passed_at(numbers[len(due)]))


def enrich(tables: Tables, passages: DataFrame, kept: tuple = ()) -> DataFrame:
    """Adds owner, car state and tariff terms to passages (id, kind, plate_number, at).

    Top-ups carry ``user_id`` and ``amount`` instead of a plate. Everything joined is
    a stored table with one row per key, so passages never multiply. Passages without a plate
    look one up that nobody has, each its own, so that they don't share a NULL key.
    """
    zone_type = tables.tariffs.schema["zone_id"].dataType
    cars = tables.cars.select(F.col("id").alias("car_id"), F.col("user_id").alias("_owner"),
                              F.col("plate_number").alias("_plate"), "is_active")
    asked = F.coalesce("plate_number", F.concat(F.lit("\0"), F.col("id").cast("string")))
    owned = (passages.join(cars, asked == F.col("_plate"), "left").drop("_plate")
             .withColumn("user_id", F.coalesce("_owner", "user_id")).drop("_owner")
             .withColumn("zone_id", F.lit(None).cast(zone_type)))
    terms = tables.tariffs.select(F.col("id").alias("tariff_id"), "price_per_hour", "free_minutes")
    priced = assign_tariffs(tables, owned).join(terms, "tariff_id", "left")
    return priced.select(
        F.col("user_id").cast("string").alias("user_id"), F.col("id").cast("string").alias("id"),
        F.col("car_id").cast("string").alias("car_id"), "kind", "at",
        elapsed_micros(F.expr(EPOCH), F.col("at")).alias("at_us"),
        F.coalesce("is_active", F.lit(False)).alias("is_active"),
        (F.col("price_per_hour") * 100).cast("bigint").alias("price_cents"),
        F.col("free_minutes").cast("bigint").alias("free_minutes"),
        F.coalesce((F.col("amount") * 100).cast("bigint"), F.lit(0)).alias("amount_cents"), *kept)


def opening_state(tables: Tables) -> DataFrame:
    """Balance and block flag each user starts the stream with."""
    wallets = tables.wallets.select("user_id", (F.col("balance") * 100).cast("bigint")
                                    .alias("balance_cents"))
    users = tables.users.select(F.col("id").alias("user_id"), "is_blocked")
    return users.join(wallets, "user_id", "left").select(
        F.col("user_id").cast("string").alias("user_id"), "is_blocked", "balance_cents")


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.where(F.col("user_id").isNotNull()).withColumn("bucket", F.expr(f"cast(pmod(xxhash64(user_id), {buckets}) as int)"))


def gate_flow(tables: Tables, passages: DataFrame, delay: str | None = None, slice_seconds: int = 3600,
              buckets: int = BUCKETS) -> DataFrame:
    """Outcome of every passage. Needs the RocksDB state store.

    Without ``delay`` a passage is taken in the micro-batch it comes with: a batch holds the passages of one bucket of users in one
    task while it orders them, and a passage older than one already taken for its user is reported as late and changes nothing.

    With ``delay`` (as "10 minutes") passages are held back, per bucket of users and slice of ``slice_seconds``, until the watermark
    has passed the slice, and are taken in order whatever micro-batches they came with. What comes later than the delay is
    dropped by the watermark, which :func:`lotline.streaming.run.run_to_end` reports. ``at`` has to be a timestamp then.

    A checkpoint keeps the number of ``buckets`` it was begun with. More of them make for smaller calls, and for more calls.
    """
    # Workers get the processor itself, so they need not have this package installed.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    if delay:
        passages = passages.withColumn("event_time", F.col("at").cast("timestamp")).withWatermark("event_time", delay)
    full = enrich(tables, passages, ("event_time",) if delay else ())
    known = _bucketed(full, buckets).drop("at")
    nobody = full.where(F.col("user_id").isNull() & F.col("id").isNotNull()).select(
        "user_id", "id", "car_id", "kind", "at", F.lit(False).alias("done"),
        F.lit(NO_CAR).alias("message"), F.lit(None).cast("string").alias("session_id"),
        F.lit(None).cast("bigint").alias("cents"), F.lit(None).cast("bigint").alias("balance_cents"))
    flow = known.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=OrderedGateFlow(slice_seconds) if delay else GateFlow(), outputStructType=OUTCOME, outputMode="append",
        timeMode="EventTime" if delay else "None", initialState=_bucketed(opening_state(tables), buckets).groupBy("bucket"))
    return flow.unionByName(nobody)
