import datetime as dt
import random
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Window, functions as F

from lotline.functions.money import cost_of_minutes, parking_cost
from lotline.functions.times import utc_instant, utc_wall_time
from lotline.operators import admission, ledger
from lotline.operators.running import running_rank, running_total
from lotline.plans import activity, occupancy, people, revenue
from lotline.plans.lookups import fits_broadcast
from tests.frames import at, by_id, money, rows, tables


def numeric_cost(minutes: int, price: Decimal) -> Decimal:
    """Quotient to 20 digits up to an hour and 16 beyond, then product, then cents."""
    digits = 20 if minutes <= 60 else 16
    hours = (Decimal(minutes) / 60).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)
    return (hours * price).quantize(Decimal("0.01"), ROUND_HALF_UP)


def test_cost_matches_decimal_arithmetic(spark):
    rng = random.Random(7)
    cases = [(m, Decimal(p) / 100) for m in (0, 1, 2, 59, 60, 61) for p in (0, 15, 30, 45, 90, 10000)]
    cases += [(rng.randrange(0, 5000), Decimal(rng.randrange(0, 30000)) / 100) for _ in range(3000)]
    cases += [(rng.randrange(0, 300) * 3 + 2, Decimal(rng.randrange(0, 300) * 30) / 100)
              for _ in range(1000)]
    df = spark.createDataFrame(cases, "m long, p decimal(10,2)")
    got = [r[0] for r in df.select(cost_of_minutes("m", "p")).collect()]
    assert got == [numeric_cost(m, p) for m, p in cases]


def test_minutes_round_half_up_then_lose_the_free_ones(spark):
    cases = [(at(), at(minutes=15), 15, "0.00"), (at(), at(minutes=16, seconds=29.9), 15, "1.00"),
             (at(), at(minutes=16, seconds=30), 15, "2.00"), (at(), None, 0, None),
             (at(1), at(0), 0, "0.00"), (at(), at(2), 60, "60.00")]
    df = spark.createDataFrame([(a, b, f) for a, b, f, _ in cases],
                               "a timestamp_ntz, b timestamp_ntz, f int")
    got = [r[0] for r in df.select(parking_cost("a", "b", F.lit(Decimal("60.00")), "f")).collect()]
    assert got == [None if c is None else Decimal(c) for *_, c in cases]


def test_wall_time_survives_any_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        when = dt.datetime(2024, 3, 9, 12, 34, 56, 789012)
        df = spark.createDataFrame([(when,)], "t timestamp_ntz")
        row = df.select(F.unix_micros(utc_instant("t")), utc_wall_time(utc_instant("t"))).first()
        assert row[0] == int(when.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)
        assert row[1] == when
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def parking(spark):
    return tables(
        spark,
        users=[{"id": f"u{i}", "phone": f"+7{i}", "is_blocked": i == 2} for i in range(1, 6)],
        wallets=[{"id": "w1", "user_id": "u1", "balance": money(50)},
                 {"id": "w2", "user_id": "u2", "balance": money(900)},
                 {"id": "w4", "user_id": "u4", "balance": money("49.99")}],
        cars=[{"id": f"c{i}", "user_id": f"u{i}", "plate_number": f"A{i}", "is_active": i != 5}
              for i in range(1, 6)],
        gates=[{"id": "in", "name": "in", "type": "entry"}, {"id": "out", "name": "out", "type": "exit"}],
        access_levels=[{"id": "L1", "code": "R"}, {"id": "L2", "code": "V"}],
        user_access_levels=[{"id": "g1", "user_id": "u1", "access_level_id": "L1"},
                            {"id": "g2", "user_id": "u1", "access_level_id": "L2"},
                            {"id": "g3", "user_id": "u2", "access_level_id": "L2"}],
        parking_zones=[{"id": "z1", "name": "Z1"}, {"id": "z2", "name": "Z2"}, {"id": "z3", "name": "Z3"}],
        parking_spots=[{"id": "p1", "zone_id": "z1", "spot_number": "1"},
                       {"id": "p2", "zone_id": "z1", "spot_number": "2"},
                       {"id": "p3", "zone_id": "z2", "spot_number": "1", "is_active": False}],
        tariffs=[{"id": "t1", "name": "all", "price_per_hour": money(100)},
                 {"id": "t2", "name": "level", "price_per_hour": money(50), "access_level_id": "L1"},
                 {"id": "t3", "name": "both", "price_per_hour": money(70), "access_level_id": "L2",
                  "zone_id": "z1"},
                 {"id": "t4", "name": "zone", "price_per_hour": money(80), "zone_id": "z2"}],
        parking_sessions=[
            {"id": "s1", "car_id": "c1", "tariff_id": "t1", "spot_id": "p1", "entry_time": at(0)},
            {"id": "s2", "car_id": "c2", "tariff_id": "t1", "spot_id": "p1", "entry_time": at(1)},
            {"id": "s3", "car_id": "c1", "tariff_id": "t1", "spot_id": "p2", "entry_time": at(2),
             "exit_time": at(30), "total_cost": money(2800), "status": "completed"},
            {"id": "s4", "car_id": "c1", "tariff_id": "t1", "entry_time": at(3), "exit_time": at(4),
             "total_cost": money(100), "status": "completed"},
            {"id": "s5", "car_id": "c3", "tariff_id": "t2", "spot_id": "p3", "entry_time": at(5),
             "exit_time": at(6), "status": "completed"}])


def test_admission_precedence(spark):
    attempts = spark.createDataFrame(
        [(f"a{i}", f"A{i}", "in", at(1)) for i in range(1, 6)]
        + [("a6", "none", "in", at(1)), ("a7", "A1", "out", at(1)), ("a8", "A1", "gone", at(1))],
        "id string, plate_number string, gate_id string, attempt_time timestamp_ntz")
    done = admission.admit(parking(spark), attempts)
    assert by_id(done.decisions, "allowed", "reason", "car_id", "user_id", "wallet_id", "balance") == {
        "a1": (True, "Entry allowed", "c1", "u1", "w1", money(50)),
        "a2": (False, "User is blocked", "c2", "u2", None, None),
        "a3": (False, "Wallet not found", "c3", "u3", None, None),
        "a4": (False, "Insufficient balance: 49.99 (minimum: 50.00)", "c4", "u4", "w4", money("49.99")),
        "a5": (False, "Car not found or inactive", None, None, None, None),
        "a6": (False, "Car not found or inactive", None, None, None, None)}
    assert by_id(done.rejected, "error") == {"a7": "Gate is not an entry gate", "a8": "Gate not found"}
    assert done.entry_logs.count() == 6
    opened, without = admission.open_sessions(parking(spark), done.decisions)
    assert rows(opened, "car_id", "tariff_id", "status") == [("c1", "t2", "active")]
    assert without.count() == 0


def test_balance_at_the_time_of_the_attempt(spark):
    t = parking(spark)
    operations = spark.createDataFrame(
        [("x1", "w1", None, money(-1), "adjustment", at(1), None),
         ("x2", "w1", None, money(1), "topup", at(2), None)], t.wallet_transactions.schema)
    attempts = spark.createDataFrame(
        [("a0", "A1", "in", at(0.5)), ("a1", "A1", "in", at(1)), ("a2", "A1", "in", at(2.5))],
        "id string, plate_number string, gate_id string, attempt_time timestamp_ntz")
    done = admission.admit(t, attempts, operations)
    assert by_id(done.decisions, "allowed") == {"a0": True, "a1": False, "a2": True}
    moments = spark.createDataFrame([("m1", "w1", at(1)), ("m2", "w1", at(0)), ("m3", "w2", at(9))],
                                    "id string, wallet_id string, moment timestamp_ntz")
    assert by_id(ledger.balances_at(t.wallets, operations, moments), "balance_then") == {
        "m1": money(49), "m2": money(50), "m3": money(900)}


def test_tariff_specificity(spark):
    wanted = spark.createDataFrame(
        [("r1", "u1", "z1"), ("r2", "u1", "z2"), ("r3", "u2", "z1"), ("r4", "u2", "z2"), ("r5", "u3", None)],
        "id string, user_id string, zone_id string")
    assert by_id(admission.assign_tariffs(parking(spark), wanted), "tariff_id", "matched_by") == {
        "r1": ("t3", "level and zone"), "r2": ("t2", "level"), "r3": ("t3", "level and zone"),
        "r4": ("t4", "zone"), "r5": ("t1", "all")}


def test_occupancy_counts_a_spot_once_per_active_session(spark):
    got = {r["zone_id"]: tuple(r)[2:] for r in occupancy.parking_occupancy(parking(spark)).collect()}
    assert got == {"z1": (3, 2, 1, Decimal("66.67")), "z2": (0, 0, 0, None), "z3": (0, 0, 0, None)}


def test_null_sums_sort_first(spark):
    result = revenue.revenue_by_tariff_and_zone(parking(spark), "2024-01-10")
    assert [r["total_revenue"] for r in result.collect()] == [None, money(2800), money(100)]
    top = people.top_users_by_spend(parking(spark)).collect()
    assert [r["phone"] for r in top] == ["+71"]


def test_both_ways_to_the_zone_agree(spark):
    t = parking(spark)
    assert fits_broadcast(t.parking_zones) is not None
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not fits_broadcast(t.parking_spots, t.parking_zones)
        slow = [rows(revenue.revenue_analytics(t)), rows(people.user_parking_history(t))]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100g")
    try:
        fast = [rows(revenue.revenue_analytics(t)), rows(people.user_parking_history(t))]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    assert slow == fast and len(slow[1]) == 5


def test_users_without_sessions(spark):
    t = parking(spark)
    assert [(r["user_id"], r["total_sessions"]) for r in people.top_users(t, 10).collect()] == [
        ("u1", 2), ("u3", 1), ("u2", 0), ("u4", 0), ("u5", 0)]
    assert [r["user_id"] for r in people.top_users_by_use(t).collect()] == ["u1", "u3"]


def test_long_and_expensive_sessions(spark):
    t = parking(spark)
    assert rows(people.long_sessions(t), "session_id", "duration_hours") == [("s3", 28.0)]
    assert people.suspicious_sessions(t, 28).count() == 0
    assert people.expensive_sessions(t, 1).first()["session_id"] == "s3"
    assert people.expensive_sessions(t, 3).count() == 0


def test_idle_zones_are_left_out(spark):
    used = rows(occupancy.zone_usage(parking(spark), "2024-01-10"))
    assert [(r[0], r[1], r[2], r[3]) for r in used] == [("Z1", 3, 2, 2), ("Z2", 1, 0, 1)]


def test_previous_day_is_the_previous_present_day(spark):
    t = parking(spark)
    sessions = t.parking_sessions.where("status = 'completed'").withColumn(
        "entry_time", F.expr("entry_time + make_dt_interval(case id when 's3' then 0 when 's4' then 3 else 5 end)"))
    got = revenue.revenue_change(t.replace(parking_sessions=sessions), "2024-01-20").collect()
    assert [(str(r["date"]), r["prev_day_revenue"], r["revenue_change"]) for r in got] == [
        ("2024-01-06", money(100), None), ("2024-01-04", money(2800), money(-2700)),
        ("2024-01-01", None, None)]


def test_null_reason_is_its_own_group(spark):
    logs = [{"id": str(i), "plate_number": "A", "gate_id": "g", "attempt_time": at(1),
             "result": "denied", "reason": r} for i, r in enumerate([None, None, "x"])]
    t = tables(spark, entry_logs=logs)
    assert rows(activity.denials_by_reason(t, "2024-01-10")) == [("x", 1), (None, 2)]


def test_running_total_equals_one_window(spark):
    rng = random.Random(3)
    data = [(i, "hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}",
             at(minutes=rng.randrange(0, 600)), Decimal(rng.randrange(-500, 500)) / 100)
            for i in range(600)]
    df = spark.createDataFrame(data, "id long, k string, t timestamp_ntz, v decimal(12,2)")
    plain = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    expected = by_id(df.withColumn("s", F.sum("v").over(plain)), "s")
    assert by_id(running_total(df, ["k"], "t", ["id"], "v", "s"), "s") == expected
    back = Window.partitionBy("k").orderBy(F.desc("t"), F.desc("id"))
    expected = by_id(df.withColumn("r", F.row_number().over(back)), "r")
    assert by_id(running_rank(df, ["k"], "t", ["id"], "r", descending=True), "r") == expected


def test_topups(spark):
    t = parking(spark)
    batch = spark.createDataFrame(
        [("1", "u1", money(10), at(1), None), ("2", "u1", money(5), at(2), "gift"),
         ("3", "u1", money(0), at(3), None), ("4", "u3", money(5), at(3), None)],
        "id string, user_id string, amount decimal(12,2), created_at timestamp_ntz, comment string")
    done = ledger.post_topups(t, batch)
    assert by_id(done.rejected, "reason") == {"3": "Amount must be positive", "4": "Wallet not found"}
    assert by_id(done.balances, "balance")["w1"] == money(65)
    assert by_id(done.transactions, "comment") == {"1": "Wallet top-up", "2": "gift"}
    assert sorted(r["details"] for r in done.audit.collect()) == [
        '{"amount":10.0,"operation":"topup","new_balance":60.0}',
        '{"amount":5.0,"operation":"topup","new_balance":65.0}']


def test_ledger_moves_what_balances_move(spark):
    t = parking(spark)
    moves = spark.createDataFrame(
        [("x1", "w1", None, money(-1), "adjustment", at(1), None),
         ("x2", "w1", None, money(3), "topup", at(2), None)], t.wallet_transactions.schema)
    moves = ledger.build_ledger(moves, ledger.charges_of(t.parking_sessions, t.cars, t.wallets))
    final = {r["wallet_id"]: r["balance"] for r in ledger.current_balances(t.wallets, moves).collect()}
    assert final == {"w1": money(50 - 1 + 3 - 2900), "w2": money(900), "w4": money("49.99")}
    last = [r["balance_after"] for r in ledger.running_balances(t.wallets, moves)
            .orderBy("created_at", "id").collect()][-1]
    assert last == final["w1"]


def test_a_wallet_with_all_rows_at_one_instant_is_split(spark):
    """Running totals by rows: one key and one instant hold most rows, and several tasks share them."""
    from lotline.operators import running
    rows_ = [("w", at(1), i, i % 7 - 3) for i in range(20_000)] + [("v", at(i % 5), i, 1) for i in range(50)] + [("w", at(0), -1, 100)]
    df = spark.createDataFrame(rows_, "wallet_id string, at timestamp_ntz, id long, amount long").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are few
    try:
        got = running.running_total_by_rows(df, ["wallet_id"], "at", ["id"], "amount", "total").collect()
        blocks = (df.repartitionByRange("wallet_id", "at", "id").where("wallet_id = 'w' AND id >= 0")
                  .select(F.spark_partition_id()).distinct().count())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, sums = {}, {}
    for wallet, when, i, amount in sorted(rows_, key=lambda r: (r[0], r[1], r[2])):
        sums[wallet] = want[wallet, i] = sums.get(wallet, 0) + amount
    assert {(r.wallet_id, r.id): r.total for r in got} == want and blocks > 1
