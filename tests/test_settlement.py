import random
from decimal import Decimal

import pytest

from lotline.operators import settlement as S
from tests.frames import at, by_id, money, tables

HOUR = Decimal("100")


def base(spark, **extra):
    rows = dict(
        users=[{"id": "u1", "phone": "+71"}, {"id": "u2", "phone": "+72"}, {"id": "u3", "phone": "+73"}],
        wallets=[{"id": "w1", "user_id": "u1", "balance": money(500)},
                 {"id": "w2", "user_id": "u2", "balance": money(-900)}],
        cars=[{"id": "c1", "user_id": "u1", "plate_number": "A1"},
              {"id": "c2", "user_id": "u2", "plate_number": "A2"},
              {"id": "c3", "user_id": "u3", "plate_number": "A3", "is_active": False}],
        tariffs=[{"id": "t", "name": "T", "price_per_hour": HOUR}],
        gates=[{"id": "gi", "name": "in", "type": "entry"}, {"id": "go", "name": "out", "type": "exit"}],
        parking_sessions=[{"id": "s1", "car_id": "c1", "tariff_id": "t", "entry_time": at(1)},
                          {"id": "s2", "car_id": "c1", "tariff_id": "t", "entry_time": at(2)},
                          {"id": "s3", "car_id": "c2", "tariff_id": "t", "entry_time": at(0)},
                          {"id": "s4", "car_id": "c3", "tariff_id": "t", "entry_time": at(0)},
                          {"id": "s5", "car_id": "c1", "tariff_id": "t", "entry_time": at(3),
                           "exit_time": at(4), "total_cost": money(100), "status": "completed"}])
    rows.update(extra)
    return tables(spark, **rows)


def exits(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, car_id string, exit_time timestamp_ntz")


def test_latest_session_first_then_the_older(spark):
    done = S.settle(base(spark), exits(spark, ("x1", "c1", at(3)), ("x2", "c1", at(4)),
                                       ("x3", "c1", at(5))))
    assert by_id(done.results, "success", "session_id", "cost") == {
        "x1": (True, "s2", money(100)), "x2": (True, "s1", money(300)), "x3": (False, None, None)}
    messages = by_id(done.results, "message")
    assert messages["x1"] == "Exit processed. Cost: 100.00, New balance: 400.00"
    assert messages["x2"] == "Exit processed. Cost: 300.00, New balance: 100.00"
    assert messages["x3"] == S.NO_SESSION
    assert by_id(done.wallets, "balance") == {"w1": money(100)}
    assert by_id(done.sessions, "status", "exit_time") == {
        "s1": ("completed", at(4)), "s2": ("completed", at(3))}
    assert sorted(r["amount"] for r in done.transactions.collect()) == [money(-300), money(-100)]


def test_exit_before_entry_leaves_the_session_on_top(spark):
    done = S.settle(base(spark), exits(spark, ("x1", "c1", at(1.5)), ("x2", "c1", at(3))))
    assert by_id(done.results, "success", "session_id", "message")["x1"] == (
        False, "s2", S.BEFORE_ENTRY)
    assert by_id(done.results, "session_id")["x2"] == "s2"


def test_floor_and_missing_wallet(spark):
    done = S.settle(base(spark), exits(spark, ("x1", "c2", at(2)), ("x2", "c2", at(3)),
                                       ("x3", "c3", at(1)), ("x4", "c3", at(2))))
    assert by_id(done.results, "success", "session_id", "message") == {
        "x1": (False, "s3", S.BELOW_FLOOR), "x2": (False, "s3", S.BELOW_FLOOR),
        "x3": (False, "s4", S.WITHOUT_WALLET), "x4": (False, "s4", S.WITHOUT_WALLET)}
    assert done.wallets.count() == done.sessions.count() == done.transactions.count() == 0


def test_floor_itself_may_be_reached(spark):
    done = S.settle(base(spark), exits(spark, ("x1", "c2", at(1))))
    assert by_id(done.wallets, "balance") == {"w2": money(-1000)}


def test_missing_tariff(spark):
    t = base(spark, parking_sessions=[
        {"id": "s1", "car_id": "c1", "tariff_id": "gone", "entry_time": at(2)},
        {"id": "s0", "car_id": "c1", "tariff_id": "t", "entry_time": at(1)}])
    done = S.settle(t, exits(spark, ("x1", "c1", at(3)), ("x2", "c1", at(4)), ("x3", "c1", at(5))))
    assert set(by_id(done.results, "session_id", "message").values()) == {("s1", S.NO_TARIFF)}


def test_requests_by_gate_and_plate(spark):
    requests = spark.createDataFrame(
        [("r1", "A1", "go", at(3)), ("r2", "A1", "gi", at(3)), ("r3", "A1", "none", at(3)),
         ("r4", "Z9", "go", at(3)), ("r5", "A3", "go", at(3))],
        "id string, plate_number string, gate_id string, exit_time timestamp_ntz")
    known, rejected = S.resolve_exits(base(spark), requests)
    assert by_id(known, "car_id") == {"r1": "c1", "r5": "c3"}
    assert by_id(rejected, "error") == {"r2": "Gate is not an exit gate", "r3": "Gate not found",
                                        "r4": "Car not found"}


def test_applied_tables_balance(spark):
    t = base(spark)
    done = S.settle(t, exits(spark, ("x1", "c1", at(3))))
    after = S.apply_settlement(t, done)
    assert after.parking_sessions.count() == t.parking_sessions.count()
    assert by_id(after.wallets, "balance")["w1"] == money(400)
    assert by_id(after.parking_sessions, "status")["s2"] == "completed"


def brute_force(due):
    """The rule itself: one exit after the other."""
    room, stuck, paid = {}, set(), set()
    for exit_id, car, wallet, when, _, cents, start in sorted(due, key=lambda r: (r[3], r[0])):
        room.setdefault(wallet, start)
        if car not in stuck and cents <= room[wallet]:
            room[wallet] -= cents
            paid.add(exit_id)
        else:
            stuck.add(car)
    return paid


def charges(seed, cars_per_wallet, rows):
    rng, due, turns, last = random.Random(seed), [], {}, {}
    for i in range(rows):
        wallet = "w0" if rng.random() < 0.5 else f"w{rng.randrange(1, 5)}"
        car = f"{wallet}c{rng.randrange(cars_per_wallet)}"
        turns[car] = turns.get(car, 0) + 1
        room = {"w0": 5000, "w1": 0, "w2": 1, "w3": 100000, "w4": 777}[wallet]
        cents = rng.choice([0, 1, 2, 3, rng.randrange(1, 40), rng.randrange(1, 3000)])
        due.append((i, car, wallet, at(minutes=i // 3), turns[car], cents, room))
    return due


@pytest.mark.parametrize("seed,cars,rows", [(1, 3, 120), (2, 1000, 150), (3, 12, 200)])
@pytest.mark.parametrize("fold_rows", [0, 10_000])
def test_pay_equals_brute_force(spark, seed, cars, rows, fold_rows):
    due = charges(seed, cars, rows)
    df = spark.createDataFrame(due, "exit_id long, car_id string, wallet_id string, "
                                    "exit_time timestamp_ntz, turn long, cents long, room long")
    got = {r[0] for r in S.pay(df, fold_rows).collect()}
    assert got == brute_force(due)


def test_falling_charges_need_few_phases(spark, monkeypatch):
    """Small charges between ever smaller ones that just fail: one phase per halving."""
    due, room = [], 1000
    for i in range(100):
        due.append((2 * i, f"a{i}", "w", at(minutes=2 * i), 1, 1, room))
        due.append((2 * i + 1, f"b{i}", "w", at(minutes=2 * i + 1), 1, room - i, room))
    df = spark.createDataFrame(due, "exit_id long, car_id string, wallet_id string, "
                                    "exit_time timestamp_ntz, turn long, cents long, room long")
    calls = []
    monkeypatch.setattr(S, "cut_lineage", lambda d, keep=S.cut_lineage: calls.append(1) or keep(d))
    got = {r[0] for r in S.pay_in_phases(df).collect()}
    assert got == brute_force(due)
    assert len(calls) <= 2 * 10 + 1


@pytest.mark.parametrize("cars", [10, 1000])
def test_cars_that_fail_one_after_the_other(spark, cars):
    """Each fails and has later exits: they stream through one task, without a phase for each."""
    due = []
    for i in range(cars):
        due.append((3 * i, f"c{i}", "w", at(minutes=2 * i), 1, 5000, 900))
        due.append((3 * i + 1, f"c{i}", "w", at(minutes=2 * i + 1), 2, 1, 900))
        due.append((3 * i + 2, f"d{i}", "w", at(minutes=2 * i + 1), 1, 1, 900))
    df = spark.createDataFrame(due, "exit_id long, car_id string, wallet_id string, "
                                    "exit_time timestamp_ntz, turn long, cents long, room long").repartition(3)
    assert {r[0] for r in S.pay(df).collect()} == brute_force(due)
