import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from lotline.operators import access, changes, importer, quality
from lotline.operators.audit import audit_rows
from lotline.operators.first_wins import first_wins
from lotline.schemas import TABLES
from tests.frames import START, at, by_id, frame, money, rows, tables

NOW = dt.datetime(2024, 3, 1)


def brute_first_wins(batch):
    held, accepted = set(), set()
    for position, claims in sorted(batch):
        if not held & set(claims):
            accepted.add(position)
            held |= set(claims)
    return accepted


@pytest.mark.parametrize("seed,keys", [(1, 30), (2, 200), (3, 8)])
def test_first_wins_equals_sequential(spark, seed, keys):
    rng = random.Random(seed)
    batch = [(i, [f"k{rng.randrange(keys)}" for _ in range(rng.randrange(0, 4))]
              + (["hot"] if rng.random() < 0.3 else [])) for i in range(150)]
    df = spark.createDataFrame(batch, "pos long, claims array<string>")
    got = [r[0] for r in first_wins(df, "pos", "claims").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_first_wins(batch)


def test_inserts_split_the_batch(spark):
    target = frame(spark, "cars", [{"id": "c1", "user_id": "u", "plate_number": "A"}])
    batch = frame(spark, "cars", [
        {"id": "c2", "user_id": "u", "plate_number": "A"},
        {"id": "c3", "user_id": "u", "plate_number": "B"},
        {"id": "c4", "user_id": "u", "plate_number": "B"}])
    done = changes.apply_inserts(target, batch, TABLES["cars"].unique)
    assert by_id(done.accepted, "plate_number") == {"c3": "B"}
    assert by_id(done.rejected, "error") == {
        "c2": "plate_number already exists", "c4": "repeats an earlier row of the batch"}
    assert rows(done.table, "id") == [("c1",), ("c3",)]


def test_null_unique_keys_do_not_collide(spark):
    target = frame(spark, "users", [{"id": "u1", "phone": "+71"}])
    batch = frame(spark, "users", [{"id": "u2", "phone": "+72"}, {"id": "u3", "phone": "+73"}])
    done = changes.apply_inserts(target, batch, TABLES["users"].unique)
    assert rows(done.accepted, "id") == [("u2",), ("u3",)] and done.rejected.count() == 0


def test_insert_ignore(spark):
    t = frame(spark, "access_levels", [{"id": "1", "code": "A"}])
    b = frame(spark, "access_levels", [{"id": "2", "code": "A"}, {"id": "3", "code": "B"}])
    assert rows(changes.insert_ignore(t, b, ["code"]), "id") == [("3",)]


def test_insert_ignore_keeps_nulls_and_the_first(spark):
    t = frame(spark, "users", [{"id": "1", "email": "a@x.y"}])
    b = frame(spark, "users", [{"id": "2", "email": None}, {"id": "3", "email": None}, {"id": "5", "email": "b@x.y"},
                               {"id": "4", "email": "b@x.y"}, {"id": "6", "email": "a@x.y"}])
    assert rows(changes.insert_ignore(t, b, ["email"]), "id") == [("2",), ("3",), ("4",)]


def test_repeated_ids_stay_apart(spark):
    target = frame(spark, "cars", [{"id": "1", "plate_number": "A"}])
    batch = frame(spark, "cars", [{"id": "1", "plate_number": "B"}, {"id": "9", "plate_number": "C"},
                                  {"id": "9", "plate_number": "D"}, {"id": "9", "plate_number": "C"}])
    done = changes.apply_inserts(target, batch, TABLES["cars"].unique)
    assert rows(done.table, "id") == [("1",), ("9",)] and done.accepted.count() == 1
    assert sorted(r.error for r in done.rejected.collect()) == [
        "id already exists", "repeats an earlier row of the batch", "repeats an earlier row of the batch"]


def test_several_patches_of_a_row(spark):
    target = frame(spark, "cars", [{"id": "1", "plate_number": "A", "model": "M"}, {"id": "2", "plate_number": "B", "model": "N"}])
    patch = spark.createDataFrame([("1", 1, "X", None), ("1", 2, None, "Y"), ("1", 3, "Z", None), ("2", 1, "C", None)],
                                  "id string, n int, plate_number string, model string")
    columns = ["plate_number", "model"]
    folded = changes.apply_updates(target, patch, columns, unique_keys=[("plate_number",)], order="n")
    assert by_id(folded.table, *columns) == {"1": ("Z", "Y"), "2": ("C", "N")}
    last = changes.apply_updates(target, patch, columns, overwrite=True, order="n")
    assert by_id(last.table, *columns) == {"1": ("Z", None), "2": ("C", None)}
    unordered = changes.apply_updates(target, patch, columns)
    assert by_id(unordered.table, *columns) == {"1": ("A", "M"), "2": ("C", "N")}
    assert by_id(unordered.rejected, "error") == {"1": "several patches without an order"}


def test_no_request_is_lost(spark, tmp_path):
    lines = ['{"users": []}', '{"users": [{"phone": "+71", "password_hash": "h"}]}', '{"users": [', '{"request_no": 5}']
    (tmp_path / "in.json").write_text("\n".join(lines))
    done = importer.import_users(tables(spark, users=[], cars=[]), importer.read_payloads(spark, str(tmp_path)), NOW)
    assert sorted((r.created_users, r.failed_users) for r in done.summary.collect()) == [(0, 0), (0, 0), (0, 0), (1, 0)]
    [error] = done.errors.collect()
    assert error.error == "Invalid request" and 5 in {r.request_no for r in done.summary.collect()}


def test_defaults(spark):
    batch = spark.createDataFrame([("w1", "u1", None)], "id string, user_id string, currency string")
    row = changes.with_defaults("wallets", batch, NOW).first()
    assert (row["balance"], row["currency"], row["updated_at"]) == (money(0), "RUB", NOW)


def test_updates_keep_what_is_null(spark):
    target = frame(spark, "parking_spots", [
        {"id": "1", "zone_id": "z", "spot_number": "A", "is_active": True, "is_reserved": False},
        {"id": "2", "zone_id": "z", "spot_number": "B", "is_active": True, "is_reserved": False},
        {"id": "3", "zone_id": "y", "spot_number": "C", "is_active": True, "is_reserved": False}])
    patch = frame(spark, "parking_spots", [
        {"id": "1", "is_active": False}, {"id": "2", "spot_number": "A"},
        {"id": "3", "spot_number": "A"}, {"id": "9", "spot_number": "Q"}])
    done = changes.apply_updates(target, patch, ["zone_id", "spot_number", "is_reserved", "is_active"],
                                 unique_keys=TABLES["parking_spots"].unique)
    assert by_id(done.rejected, "error") == {"2": "zone_id, spot_number already exists",
                                             "9": "not found"}
    assert by_id(done.table, "spot_number", "is_active") == {
        "1": ("A", False), "2": ("B", True), "3": ("A", True)}


def test_car_update_overwrites_and_asks_for_the_owner(spark):
    target = frame(spark, "cars", [{"id": "1", "user_id": "u", "plate_number": "A", "model": "M"},
                                   {"id": "2", "user_id": "v", "plate_number": "B", "model": "N"}])
    patch = spark.createDataFrame([("1", "A", None, "u"), ("2", "C", "X", "u")],
                                  "id string, plate_number string, model string, by string")
    done = changes.apply_updates(target, patch, ["plate_number", "model"], overwrite=True,
                                 unique_keys=[("plate_number",)], owner=("user_id", "by"))
    assert by_id(done.table, "plate_number", "model") == {"1": ("A", None), "2": ("B", "N")}
    assert by_id(done.rejected, "error") == {"2": "not the owner"}


def test_last_values(spark):
    p = spark.createDataFrame([("1", 1, "a", None), ("1", 2, None, "x"), ("1", 3, "b", None)],
                              "id string, n int, c string, d string")
    assert rows(changes.last_values(p, ["c", "d"], "n")) == [("1", "b", "x")]


def test_deletes_follow_references(spark):
    t = tables(spark,
               users=[{"id": "u1", "phone": "+71"}, {"id": "u2", "phone": "+72"}],
               wallets=[{"id": "w1", "user_id": "u1", "balance": money(1)},
                        {"id": "w2", "user_id": "u2", "balance": money(1)}],
               cars=[{"id": "c1", "user_id": "u1", "plate_number": "A"},
                     {"id": "c2", "user_id": "u2", "plate_number": "B"}],
               parking_sessions=[{"id": "s2", "car_id": "c2", "tariff_id": "t"}],
               wallet_transactions=[{"id": "x1", "wallet_id": "w1", "amount": money(1),
                                     "operation_type": "topup"}],
               audit_logs=[{"id": "a1", "user_id": "u1", "entity_type": "car", "action": "create"}])
    gone = changes.apply_deletes(t, "users", spark.createDataFrame([("u1",), ("u2",), ("u9",)], "id string"))
    assert rows(gone.deleted) == [("u1",)]
    assert by_id(gone.rejected, "error") == {"u2": "still referenced by parking_sessions",
                                             "u9": "not found"}
    assert rows(gone.tables.wallets, "id") == [("w2",)]
    assert gone.tables.wallet_transactions.count() == 0
    assert rows(gone.tables.cars, "id") == [("c2",)]
    assert rows(gone.tables.audit_logs, "id", "user_id") == [("a1", None)]
    with pytest.raises(ValueError):
        changes.apply_deletes(t, "audit_logs", gone.deleted)


def test_quality_rules(spark):
    t = tables(spark,
               users=[{"id": "1", "phone": "+79", "email": "a@b.c"}, {"id": "2", "phone": "0123"},
                      {"id": "3", "phone": "+79", "email": "nope"}, {"id": "4"}],
               parking_sessions=[{"id": "s", "car_id": "c", "tariff_id": "t", "entry_time": at(2),
                                  "exit_time": at(1), "status": "odd"}],
               wallets=[{"id": "w", "user_id": "1", "balance": money(-1000.01)}])
    good, bad = quality.split_valid("users", t.users)
    assert rows(good, "id") == [("1",)]
    assert by_id(bad, "violations") == {"2": ["phone format"], "3": ["email format"],
                                        "4": ["phone required"]}
    assert rows(quality.duplicate_keys(t.users, ["phone"])) == [("+79", 2)]
    broken = {(r["table"], r["rule"]): r["rows"]
              for r in quality.quality_report(t).where("rows > 0").collect()}
    assert broken[("wallets", "balance below -1000.00")] == 1
    assert broken[("parking_sessions", "exit_time before entry_time")] == 1
    assert broken[("parking_sessions", "status not in domain")] == 1
    assert broken[("parking_sessions", "car_id -> cars")] == 1
    assert broken[("users", "phone")] == 2
    assert rows(quality.orphans(t, "parking_sessions", "car_id", "cars"), "id") == [("s",)]


def test_visibility(spark):
    t = tables(spark, users=[{"id": "u", "phone": "1"}, {"id": "a", "phone": "000"}],
               cars=[{"id": "c", "user_id": "u", "plate_number": "A"},
                     {"id": "d", "user_id": "a", "plate_number": "B"}],
               entry_logs=[{"id": "1", "plate_number": "A"}, {"id": "2", "plate_number": "B"},
                           {"id": "3", "plate_number": "unknown"}])
    assert rows(access.visible_to(t, "entry_logs", "u"), "id") == [("1",)]
    assert access.visible_to(t, "entry_logs", "a", is_admin=True).count() == 3
    who = access.viewers(t.users)
    assert rows(who) == [("a", True), ("u", False)]
    assert rows(access.seen_by(t, "entry_logs", who), "viewer_id", "id") == [("a", "2"), ("u", "1")]


def test_audit_rows(spark):
    cars = frame(spark, "cars", [{"id": "c", "user_id": "u", "plate_number": "A"}])
    row = audit_rows("cars", "create", cars, ["plate_number", "model"], "user_id", F.lit(START)).first()
    assert (row["user_id"], row["entity_type"], row["entity_id"]) == ("u", "car", "c")
    assert json.loads(row["details"]) == {"plate_number": "A", "model": None}


def payload(*users, dry_run=False):
    return {"users": [dict(phone=p, email=e, password_hash="h",
                           cars=[dict(plate_number=n, model=None) for n in plates])
                      for p, e, plates in users], "dry_run": dry_run}


def imported(spark, tmp_path, *requests):
    t = tables(spark, users=[{"id": "u", "phone": "+70", "email": "old@x.y"}],
               cars=[{"id": "c", "user_id": "u", "plate_number": "OLD"}])
    path = tmp_path / "requests.json"
    path.write_text("\n".join(json.dumps(r) for r in requests))
    return importer.import_users(t, importer.read_payloads(spark, str(path)), NOW, "admin")


def test_import(spark, tmp_path):
    done = imported(spark, tmp_path, payload(
        ("+71", "a@x.y", ["A"]), ("+70", None, []), ("+72", "old@x.y", []), ("+73", None, ["OLD"]),
        ("bad", None, []), ("+74", None, ["Q", "Q"]), ("+75", "a@x.y", ["B"]), ("+76", None, ["B"]),
        ("+77", None, ["B"])))
    assert {r["phone"]: r["details"] for r in done.errors.collect()} == {
        "+70": "phone already exists", "+72": "email already exists",
        "+73": "plate_number already exists", "bad": "phone format",
        "+74": "plate_number repeated", "+75": "repeats an earlier entry",
        "+77": "repeats an earlier entry"}
    assert rows(done.users, "phone") == [("+71",), ("+76",)]
    assert rows(done.cars, "plate_number") == [("A",), ("B",)]
    assert rows(done.summary, "created_users", "created_cars", "failed_users") == [(2, 2, 7)]
    assert done.wallets.count() == 2 and rows(done.wallets, "balance")[0] == (money(0),)
    details = sorted(json.loads(r["details"])["phone"] for r in done.audit.collect())
    assert details == ["+71", "+76"]


def test_dry_run_stores_nothing_and_sees_only_the_tables(spark, tmp_path):
    done = imported(spark, tmp_path, payload(("+71", None, ["A"]), ("+71", None, ["A"]),
                                             ("+70", None, []), dry_run=True))
    assert done.users.count() == done.cars.count() == done.audit.count() == 0
    assert rows(done.summary, "created_users", "created_cars", "failed_users") == [(2, 2, 1)]


def test_requests_of_one_number_and_equal_lines(spark, tmp_path):
    one = payload(("+71", None, ["A"]))
    done = imported(spark, tmp_path, one, one)
    assert rows(done.users, "phone") == [("+71",)] and done.cars.count() == 1
    assert [r.details for r in done.errors.collect()] == ["repeats an earlier entry"]
    assert rows(done.summary, "created_users", "created_cars", "failed_users") == [(0, 0, 1), (1, 1, 0)]
    numbered = [dict(payload(("+72", None, ["B"])), request_no=5), dict(payload(("+72", None, ["C"]), ("+73", None, [])), request_no=5)]
    done = imported(spark, tmp_path, *numbered)
    assert rows(done.users, "phone") == [("+72",), ("+73",)] and rows(done.cars, "plate_number") == [("B",)]
    assert [(r.request_no, r.user_no, r.phone) for r in done.errors.collect()] == [(5, 0, "+72")]
    assert rows(done.summary, "request_no", "created_users", "failed_users") == [(5, 1, 0), (5, 1, 1)]


def test_entries_without_a_place_stay_apart(spark):
    requests = spark.createDataFrame([(1, False, [("+71", None, "h", None)] * 2)] * 2,
                                     "request_no bigint, dry_run boolean, users array<struct<phone:string,email:string,"
                                     "password_hash:string,cars:array<struct<plate_number:string,model:string>>>>")
    done = importer.import_users(tables(spark, users=[], cars=[]), importer.entries(requests), NOW)
    assert rows(done.users, "phone") == [("+71",)] and done.errors.count() == 3
    assert rows(done.summary, "request_no", "created_users", "failed_users") == [(1, 1, 3)]


def test_insert_ignore_with_null_and_equal_positions(spark):
    target = spark.createDataFrame([(1, "K0", "x")], "id int, k string, v string")
    batch = spark.createDataFrame([(None, "K1", "a"), (None, "K2", "b"), (3, "K2", "c"), (2, "K3", "d"), (2, "K3", "e"),
                                   (None, "K0", "f"), (5, None, "g"), (5, None, "g")], "id int, k string, v string")
    got = changes.insert_ignore(target, batch, ["k"]).collect()
    assert sorted((r.id, r.k) for r in got if r.k and r.id) == [(2, "K3"), (3, "K2")]
    assert [(r.id, r.k, r.v) for r in got if r.k == "K1"] == [(None, "K1", "a")]
    assert sum(r.k is None for r in got) == 2 and len(got) == 5


def test_patches_without_a_clear_order(spark):
    target = spark.createDataFrame([(str(i), "old", "old") for i in range(6)], "id string, a string, b string")
    patches = spark.createDataFrame(
        [("0", "x", None, None),                          # alone, needs no order
         ("1", "x", None, 1), ("1", None, "y", 1),        # at once
         ("2", "x", None, None), ("2", None, "y", 2),     # one of them nowhere
         ("3", "x", "x", 1), ("3", "z", None, 2),         # in order
         (None, "x", "x", 1), ("9", "x", "x", 1)],
        "id string, a string, b string, at int")
    done = changes.apply_updates(target, patches, ["a", "b"], order="at")
    after = {r.id: (r.a, r.b) for r in done.table.collect()}
    assert after == {"0": ("x", "old"), "1": ("old", "old"), "2": ("old", "old"), "3": ("z", "x"), "4": ("old", "old"), "5": ("old", "old")}
    assert by_id(done.rejected, "error") == {"1": "several patches without an order", "2": "several patches without an order",
                                             "9": "not found", None: "not found"}


def by_hand(batch):
    taken, accepted = set(), []
    for position, claims in sorted(batch):
        if taken.isdisjoint(claims):
            taken.update(claims)
            accepted.append(position)
    return accepted


@pytest.mark.parametrize("most", [1_000_000, 20])
def test_chains_of_conflicts(spark, most):
    """Long chains, a key that many claim, rows with nothing; also where components are too large for a task."""
    rng = random.Random(4)
    batch = [(k, [f"c{k}", f"c{k + 1}"]) for k in range(60 if most == 20 else 1000)]
    batch += [(2000 + k, ["hot", f"h{k // 2}"]) for k in range(60)] + [(3000 + k, []) for k in range(5)]
    batch += [(4000 + k, [f"r{rng.randrange(40)}" for _ in range(3)]) for k in range(60)]
    frame_ = spark.createDataFrame(batch, "at bigint, claims array<string>").repartition(4)
    got = sorted(r["at"] for r in first_wins(frame_, "at", "claims", most=most).collect())
    assert got == by_hand(batch)


@pytest.mark.parametrize("table", ["entry_logs", "cars", "audit_logs", "gates"])
def test_scopes_answer_what_each_viewer_sees(spark, table):
    t = tables(spark, users=[{"id": "u", "phone": "1"}, {"id": "a", "phone": "000"}, {"id": "b", "phone": "2"}],
               cars=[{"id": "c", "user_id": "u", "plate_number": "A"}, {"id": "d", "user_id": "a", "plate_number": "B"}],
               entry_logs=[{"id": "1", "plate_number": "A"}, {"id": "2", "plate_number": "B"}, {"id": "3", "plate_number": "unknown"}],
               audit_logs=[{"id": "x", "user_id": "u"}], gates=[{"id": "g"}, {"id": "h"}])
    who = access.viewers(t.users)
    seen = access.seen_in_scopes(t, table, who)
    assert seen.where("scope_id is null").count() == getattr(t, table).count()
    for viewer, is_admin in [tuple(r) for r in who.collect()]:
        want = access.visible_to(t, table, viewer, is_admin)
        assert rows(access.in_scope(seen, table, viewer, is_admin), "id") == rows(want, "id")
    without = access.seen_in_scopes(t, table, who.where("not is_admin"))
    assert without.where("scope_id is null").count() == (2 if table == "gates" else 0)


def test_inserts_and_updates_keep_declared_rules(spark):
    t = tables(spark, users=[{"id": "u", "phone": "+71"}], cars=[{"id": "c", "user_id": "u", "plate_number": "A"}])
    batch = frame(spark, "cars", [{"id": "1", "user_id": "u", "plate_number": "B"}, {"id": "2", "user_id": "ghost", "plate_number": "C"},
                                  {"id": "3", "user_id": "u", "plate_number": "P" * 21}, {"id": "4", "user_id": "u"},
                                  {"id": "5", "user_id": "u", "plate_number": "A"}, {"id": "6", "user_id": "u", "plate_number": "C"}])
    batch = batch.withColumn("is_active", F.lit(True)).withColumn("created_at", F.lit(START))
    done = changes.apply_inserts(t.cars, batch, [("plate_number",)], table="cars", parents={"users": t.users})
    assert rows(done.accepted, "id") == [("1",), ("6",)]
    errors = by_id(done.rejected, "error")
    assert errors["2"] == "user_id -> users" and errors["3"] == "plate_number longer than 20" and errors["4"] == "plate_number required"
    assert errors["5"] == "plate_number already exists" and len(errors) == 4
    stored = done.table.withColumn("is_active", F.lit(True)).withColumn("created_at", F.lit(START))
    patch = spark.createDataFrame([("1", "x" * 21, None), ("6", None, "ghost"), ("c", "Z", None)], "id string, plate_number string, user_id string")
    after = changes.apply_updates(stored, patch, ["plate_number", "user_id"], table="cars", parents={"users": t.users})
    assert by_id(after.rejected, "error") == {"1": "plate_number longer than 20", "6": "user_id -> users"}
    assert by_id(after.table, "plate_number") == {"c": "Z", "1": "B", "6": "C"}
