
from __future__ import annotations

import importlib.util
import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from pyspark.sql import functions as F, types as T  # noqa: E402

from lotline.functions.money import billable_minutes, parking_cost  # noqa: E402
from lotline.operators import (access, admission, audit, changes, importer,  # noqa: E402
                               ledger, quality, settlement)
from lotline.plans import activity, occupancy, people, revenue, sql_surface  # noqa: E402
from lotline.plans.lookups import with_zone  # noqa: E402
from lotline.schemas import TABLES  # noqa: E402
from lotline.sources import sample, sample_batches as batches, sinks  # noqa: E402
from lotline.sources.sample import read, read_stream, sample_tables  # noqa: E402
from lotline.sources.tables import Tables, shape_result  # noqa: E402
from lotline.streaming import run, windows  # noqa: E402
from lotline.streaming.admission import admit_stream  # noqa: E402
from lotline.streaming.gate_flow import gate_flow  # noqa: E402
from oracle_jobs import JOBS  # noqa: E402
from oracle_reports import REPORTS  # noqa: E402
from oracle_streams import STREAMS  # noqa: E402

LLM_QUERIES, LLM_SQL = {}, {}
llm = importlib.util.find_spec("lotline.llm")
if llm and llm.origin:  # the subpackage can be left out
    from lotline.llm.queries import ORACLE_SQL as LLM_SQL, QUERIES as LLM_QUERIES  # noqa: E402

SMOKE_DIR = "/root/testdata/sf0.001"
AS_OF_30, AS_OF_7 = "2024-02-10", "2024-01-31"

Query = Callable[[SparkSession, str], DataFrame]


def _report(build: Callable[[Tables], DataFrame], zero: tuple = ()) -> Query:
    """A report over the sample tables in plain result types."""
    return lambda spark, sf_dir: shape_result(build(sample_tables(spark, sf_dir)), zero)


def _job(build: Callable[[Tables, Callable[[str], DataFrame]], DataFrame]) -> Query:
    """A job over the sample tables and a batch derived from a stored table."""
    return lambda spark, sf_dir: shape_result(
        build(sample_tables(spark, sf_dir), lambda name: read(spark, sf_dir, name)))


def _admission(t: Tables, stored) -> admission.Admission:
    return admission.admit(t, batches.attempts(stored("events")))


def _cost(t: Tables) -> DataFrame:
    terms = t.tariffs.select(F.col("id").alias("tariff_id"), "price_per_hour", "free_minutes")
    return people.completed(t).join(terms, "tariff_id").select(
        "id", billable_minutes("entry_time", "exit_time", "free_minutes").alias("billable_minutes"),
        parking_cost("entry_time", "exit_time", "price_per_hour", "free_minutes").alias("cost"))


def _tariff_requests(t: Tables) -> DataFrame:
    cars = t.cars.select(F.col("id").alias("car_id"), "user_id")
    sessions = with_zone(t, t.parking_sessions.select("id", "car_id", "spot_id"))
    requests = sessions.join(cars, "car_id").select("id", "user_id", "zone_id")
    return admission.assign_tariffs(t, requests)


def _new_balances(t: Tables, stored) -> DataFrame:
    posted = ledger.post_topups(t, batches.topups(stored("events"))).audit
    details = F.from_json("details", "amount double, operation string, new_balance double")
    return posted.select("entity_id", "created_at", details.alias("d")).select(
        "entity_id", "created_at", "d.new_balance", "d.amount")


def _ledger(t: Tables) -> DataFrame:
    others = t.wallet_transactions.where("operation_type <> 'parking_charge'")
    return ledger.build_ledger(
        ledger.charges_of(t.parking_sessions, t.cars, t.wallets),
        others.withColumn("id", F.col("id").cast("string")))


def _reconciliation(t: Tables) -> DataFrame:
    """All sessions and charges, of which some are altered or name another session."""
    sessions = t.parking_sessions.withColumn(
        "total_cost", (F.col("total_cost") + F.expr("id % 7 div 6")).cast("decimal(12,2)"))
    charges = t.wallet_transactions.withColumn("session_id", F.when(
        F.col("session_id") % 10 == 5, F.col("session_id") + 1_000_000_000).otherwise(F.col("session_id")))
    return ledger.reconcile_costs(t.replace(parking_sessions=sessions,
                                            wallet_transactions=charges))


def _read_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import requests written as JSON and read back, empty and broken ones among them."""
    folder = run.new_folder(spark, "requests")
    batches.request_texts(read(spark, sf_dir, "customer")).write.text(folder)
    known = importer.read_payloads(spark, folder)
    return shape_result(known.select(
        F.when(~F.col("unreadable"), F.col("request_no")).alias("request_no"), "user_no", "phone",
        F.size("cars").cast("bigint").alias("cars"), "unreadable"))


def _new_plates(stored) -> DataFrame:
    """New cars of which some have no plate."""
    return batches.new_cars(stored("orders")).withColumn(
        "plate_number", F.when(F.col("id") % 9 != 0, F.col("plate_number")))


def _import(t: Tables, stored) -> importer.Import:
    return importer.import_users(t, batches.import_requests(stored("customer")),
                                 "2024-02-10 00:00:00")


def _imported_users(t: Tables, stored) -> DataFrame:
    done = _import(t, stored)
    owned = done.cars.groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return done.users.join(owned, "id", "left").select(
        "phone", "email", F.coalesce("n", F.lit(0)).alias("cars"))


def _insert(t: Tables, stored) -> changes.Change:
    return changes.apply_inserts(t.cars, batches.new_cars(stored("orders")), TABLES["cars"].unique)


def _update(t: Tables, stored) -> changes.Change:
    return changes.apply_updates(
        t.parking_spots, batches.spot_patches(stored("supplier")),
        ["zone_id", "spot_number", "is_reserved", "is_active"],
        unique_keys=TABLES["parking_spots"].unique)


def _car_updates(t: Tables, stored) -> changes.Change:
    return changes.apply_updates(
        t.cars, batches.car_patches(stored("customer")), ["plate_number", "model"], overwrite=True,
        unique_keys=TABLES["cars"].unique, owner=("user_id", "by"))


def _change_audit(action: str, changed: DataFrame) -> DataFrame:
    return audit.audit_rows("cars", action, changed, ["plate_number", "model"], "user_id",
                            F.lit("2024-02-10 00:00:00").cast("timestamp_ntz"))


def _deleted_cars(t: Tables) -> DataFrame:
    gone = changes.apply_deletes(t, "cars", t.cars.where("id % 2 = 0").select("id")).deleted
    return t.cars.join(gone, "id", "left_semi")


def _delete_users(t: Tables) -> changes.Deletion:
    return changes.apply_deletes(t, "users", t.users.where("id % 3 = 0").select("id"))


def _verdicts(gone: changes.Deletion) -> DataFrame:
    return gone.deleted.withColumn("error", F.lit(None).cast("string")).unionByName(gone.rejected)


def _delete_zones(t: Tables) -> DataFrame:
    """Sessions after odd zones are gone: they lose their spot, not their history."""
    zones = t.parking_zones.where("id % 2 = 1").select("id")
    return changes.apply_deletes(t, "parking_zones", zones).tables.parking_sessions


def _insert_audit(t: Tables, stored) -> DataFrame:
    when = F.lit("2024-02-10 00:00:00").cast("timestamp_ntz")
    return audit.audit_rows("cars", "create", _insert(t, stored).accepted,
                            ["plate_number", "model"], "user_id", when)


def _quality(t: Tables) -> DataFrame:
    return quality.quality_report(t)


def _violations(t: Tables, stored) -> DataFrame:
    checked = quality.with_violations("users", batches.dirty_users(stored("customer")))
    return checked.select("id", F.concat_ws("; ", "violations").alias("violations"))


def _stored(spark: SparkSession, sf_dir: str) -> Tables:
    """Sessions and tariffs written in the storage layout and read back."""
    t, folder = sample_tables(spark, sf_dir), run.new_folder(spark, "stored")
    sinks.publish(Tables(parking_sessions=t.parking_sessions, tariffs=t.tariffs), folder, 1)
    return sinks.load_latest(spark, folder, key_type=T.LongType())


def _exit_requests(stored) -> DataFrame:
    """Exits at five gates, of which two are for exit, with some unknown plates."""
    return batches.attempts(stored("events")).select(
        "id", F.when(F.col("id") % 7 != 0, F.col("plate_number")).otherwise("none")
        .alias("plate_number"), "gate_id", F.col("attempt_time").alias("exit_time"))


def _stream(build: Callable[[DataFrame, Tables], DataFrame], conf: dict | None = None) -> Query:
    """A stream over the events, run to the end of its input."""
    return lambda spark, sf_dir: shape_result(run.run_to_files(
        build(read_stream(spark, sf_dir, "events"), sample_tables(spark, sf_dir)), conf))


def _windows(build: Callable[[DataFrame], DataFrame]) -> Query:
    """Windows over the events as a stream, the last ones included."""
    return lambda spark, sf_dir: shape_result(
        run.run_to_end(read_stream(spark, sf_dir, "events"), "ts", build))


def _entries(events: DataFrame) -> DataFrame:
    return events.select(F.col("ts").alias("entry_time"),
                         (F.col("user_id") * 3 + F.col("event_id") % 3).alias("car_id"))


def _repeated_reads(events: DataFrame) -> DataFrame:
    reads = sample.entry_logs(events)
    return windows.without_repeats(reads.unionByName(reads))


def _flow_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = sample_tables(spark, sf_dir)
    return shape_result(run.run_to_end(
        read_stream(spark, sf_dir, "events"), "ts",
        lambda e: gate_flow(t, batches.passages(e), delay="10 minutes", slice_seconds=6 * 3600), run.ROCKSDB))


def _streamed_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = run.new_folder(spark, "admission")
    stream = batches.attempts(read_stream(spark, sf_dir, "events"))
    admit_stream(stream, lambda: sample_tables(spark, sf_dir), f"{folder}/out",
                 f"{folder}/state").awaitTermination()
    return shape_result(spark.read.parquet(f"{folder}/out/decisions").drop("batch"))


def _sql(text: str, **args) -> Query:
    return lambda spark, sf_dir: shape_result(
        sql_surface.run_sql(spark, sample_tables(spark, sf_dir), text, **args))


def entry(spark: SparkSession) -> DataFrame:
    """Revenue by day, tariff and zone."""
    return queries()["V3_revenue_analytics"](spark, SMOKE_DIR)


def queries() -> dict[str, Query]:
    return {
        "V1_parking_occupancy": _report(occupancy.parking_occupancy),
        "V2_user_parking_history": _report(people.user_parking_history),
        "V3_revenue_analytics": _report(revenue.revenue_analytics),
        "V3_revenue_report": _report(
            lambda t: revenue.revenue_report(t, "2024-01-11", "2024-01-25")),
        "V3_revenue_since": _report(lambda t: revenue.revenue_analytics(t, first_day="2024-01-20")),
        "V3_revenue_until": _report(lambda t: revenue.revenue_analytics(t, last_day="2024-01-10")),
        "Q01_hourly_load": _report(lambda t: occupancy.hourly_load(t, AS_OF_30)),
        "Q02_busiest_days": _report(lambda t: occupancy.busiest_days(t, AS_OF_30)),
        "Q03_revenue_by_tariff_and_zone": _report(
            lambda t: revenue.revenue_by_tariff_and_zone(t, AS_OF_30)),
        "Q04_revenue_by_day_and_tariff": _report(
            lambda t: revenue.revenue_by_day_and_tariff(t, AS_OF_7)),
        "Q05_top_users_by_use": _report(people.top_users_by_use),
        "Q06_top_users_by_spend": _report(people.top_users_by_spend),
        "Q07_long_sessions": _report(people.long_sessions),
        "Q08_expensive_sessions": _report(people.expensive_sessions),
        "Q09_tariff_averages": _report(revenue.tariff_averages),
        "Q10_zone_usage": _report(lambda t: occupancy.zone_usage(t, AS_OF_30)),
        "Q11_entry_results": _report(lambda t: activity.entry_results(t, AS_OF_30)),
        "Q12_denials_by_reason": _report(lambda t: activity.denials_by_reason(t, AS_OF_30)),
        "Q13_wallet_operations": _report(lambda t: activity.wallet_operations(t, AS_OF_30)),
        "Q14_wallet_operations_by_day": _report(
            lambda t: activity.wallet_operations_by_day(t, AS_OF_30)),
        "Q15_debtors_with_activity": _report(people.debtors_with_activity),
        "Q16_ranked_peaks": _report(lambda t: occupancy.ranked_peaks(t, AS_OF_30)),
        "Q17_revenue_change": _report(lambda t: revenue.revenue_change(t, AS_OF_30)),
        "Q18_top_cars": _report(people.top_cars),
        "R1_debtors": _report(people.debtors),
        "R2_top_users": _report(lambda t: people.top_users(t, 25)),
        "R3_suspicious_sessions": _report(
            lambda t: people.suspicious_sessions(t, 12), zero=("total_cost",)),
        "R4_peak_hours": _report(lambda t: occupancy.peak_hours(t, AS_OF_30, 14)),
        "R5_active_sessions": _report(people.active_sessions),
        "O1_car_sessions": _report(lambda t: people.car_sessions(t, 30, AS_OF_30, 30)),
        "O2_wallet_history": _report(lambda t: activity.wallet_history(t, 10, AS_OF_30)),
        "O3_car_by_plate": _report(lambda t: activity.car_by_plate(t, "P123")),
        "O4_daily_revenue": _report(lambda t: revenue.daily_revenue(t, AS_OF_30)),
        "O5_recent_top_spenders": _report(lambda t: people.recent_top_spenders(t, AS_OF_30)),
        "U1_parking_cost": _report(_cost),
        "U1_parking_cost_function": _sql(
            "SELECT id, calculate_parking_cost(entry_time, exit_time, tariff_id) AS cost "
            "FROM parking_sessions"),
        "U2_user_balance": _report(ledger.user_balance),
        "U2_user_balance_function": _sql("SELECT id AS user_id, get_user_balance(id) AS balance FROM users"),
        "U3_check_entry_function": _sql(
            "SELECT a.id, e.* FROM (SELECT id, plate_number, id % 5 AS gate_id FROM entry_logs) a, "
            "LATERAL check_entry_allowed(a.plate_number, a.gate_id) e"),
        "E1_entry_decisions": _job(lambda t, s: _admission(t, s).decisions),
        "E1_entry_logs": _job(lambda t, s: _admission(t, s).entry_logs),
        "E1_gate_rejections": _job(lambda t, s: _admission(t, s).rejected),
        "E2_decisions_at_time": _job(lambda t, s: admission.admit(
            t, batches.attempts(s("events")), t.wallet_transactions).decisions),
        "E3_tariff_assignment": _report(_tariff_requests),
        "A2_rows_of_keys": _report(lambda t: t.where_keys(
            "parking_sessions", t.cars.where("not is_active").select("id"), "car_id")),
        "A4_occupancy_view": _sql("SELECT * FROM parking_occupancy"),
        "A4_revenue_view": _sql(
            "SELECT date, sum(total_revenue) AS revenue FROM revenue_analytics "
            "WHERE date BETWEEN :first AND :last GROUP BY date",
            first="2024-01-11", last="2024-01-25"),
        "A8_revenue_of_stored_tables": lambda spark, sf_dir: shape_result(
            revenue.revenue_by_day_and_tariff(_stored(spark, sf_dir), AS_OF_7)),
        "C12_insert_ignore": _job(lambda t, s: changes.insert_ignore(
            t.cars, _new_plates(s), ["plate_number"]).select("id", "plate_number")),
        "A5_requests_from_files": _read_requests,
        "U6_wallets_of_new_users": _report(lambda t: importer.wallets_of_new_users(t.users)),
        "E4_known_exits": _job(lambda t, s: settlement.resolve_exits(t, _exit_requests(s))[0]),
        "E4_refused_exits": _job(lambda t, s: settlement.resolve_exits(t, _exit_requests(s))[1]),
        "E4_exit_results": _job(
            lambda t, s: settlement.settle(t, batches.exits(s("events"))).results),
        "E4_exit_results_in_phases": _job(  # wallets with more than two exits go the way of the longest
            lambda t, s: settlement.settle(t, batches.exits(s("events")), fold_rows=2).results),
        "E4_closed_sessions": _job(
            lambda t, s: settlement.settle(t, batches.exits(s("events"))).sessions),
        "E4_charges": _job(
            lambda t, s: settlement.settle(t, batches.exits(s("events"))).transactions),
        "E4_debited_wallets": _job(
            lambda t, s: settlement.settle(t, batches.exits(s("events"))).wallets),
        "E5_opened_sessions": _job(
            lambda t, s: admission.open_sessions(t, _admission(t, s).decisions)[0]),
        "E5_double_active_cars": _report(lambda t: admission.double_active(t.parking_sessions)),
        "J1_topup_transactions": _job(
            lambda t, s: ledger.post_topups(t, batches.topups(s("events"))).transactions),
        "J1_topup_balances": _job(
            lambda t, s: ledger.post_topups(t, batches.topups(s("events"))).balances),
        "J1_topup_new_balances": _job(_new_balances),
        "J1_topup_rejections": _job(
            lambda t, s: ledger.post_topups(t, batches.topups(s("events"))).rejected),
        "J2_balances": _report(lambda t: ledger.current_balances(t.wallets, t.wallet_transactions)),
        "J3_ledger": _report(_ledger),
        "J3_running_balances": _report(
            lambda t: ledger.running_balances(t.wallets, t.wallet_transactions)),
        "J3_running_balances_by_rows": _report(
            lambda t: ledger.running_balances(t.wallets, t.wallet_transactions, by_rows=True)),
        "J4_cost_reconciliation": _report(_reconciliation),
        "J5_import_errors": _job(lambda t, s: _import(t, s).errors),
        "J5_import_summary": _job(lambda t, s: _import(t, s).summary),
        "J5_imported_users": _job(_imported_users),
        "J6_inserted_cars": _job(lambda t, s: _insert(t, s).accepted),
        "J6_rejected_cars": _job(lambda t, s: _insert(t, s).rejected),
        "J7_updated_spots": _job(lambda t, s: _update(t, s).table),
        "J7_rejected_updates": _job(lambda t, s: _update(t, s).rejected),
        "J8_user_delete_verdicts": _report(lambda t: _verdicts(_delete_users(t))),
        "J8_wallets_after_user_delete": _report(
            lambda t: _delete_users(t).tables.wallets.select("id", "user_id")),
        "J8_sessions_after_zone_delete": _report(
            lambda t: _delete_zones(t).select("id", "spot_id")),
        "J9_audit_of_inserts": _job(_insert_audit),
        "B13_cars_after_updates": _job(lambda t, s: _car_updates(t, s).table.select(
            "id", "user_id", "plate_number", "model")),
        "B13_refused_car_updates": _job(lambda t, s: _car_updates(t, s).rejected),
        "J9_audit_of_updates": _job(lambda t, s: _change_audit("update", _car_updates(t, s).accepted)),
        "J9_audit_of_deletes": _report(lambda t: _change_audit("delete", _deleted_cars(t))),
        "J10_defaults": _job(lambda t, s: changes.with_defaults(
            "wallets", batches.bare_wallets(s("customer")), "2024-02-10 00:00:00")),
        "K1_user_violations": _job(_violations),
        "K2_duplicate_phones": _job(lambda t, s: quality.duplicate_keys(
            batches.dirty_users(s("customer")), ["phone"])),
        "K3_orphan_transactions": _report(lambda t: quality.orphans(
            t, "wallet_transactions", "wallet_id", "wallets").select("id", "wallet_id")),
        "K4_quality_report": _report(_quality),
        "B11_sessions_by_viewer": _report(
            lambda t: access.seen_by(t, "parking_sessions", access.viewers(t.users))),
        "B11_logs_of_one_user": _report(lambda t: access.visible_to(t, "entry_logs", 10)),
        "B11_audit_of_one_user": _report(lambda t: access.visible_to(t, "audit_logs", 10)),
        "B11_audit_of_administrators": _report(
            lambda t: access.visible_to(t, "audit_logs", 10, is_admin=True)),
        "B11_cars_seen_with_administrators": _report(lambda t: access.seen_by(
            t, "cars", access.viewers(t.users, admin_phone="+79000000010"))),
        "B11_cars_in_scopes": _report(lambda t: access.seen_in_scopes(
            t, "cars", access.viewers(t.users, admin_phone="+79000000010"))),
        "B11_operations_of_one_user": _report(
            lambda t: access.visible_to(t, "wallet_transactions", 10)),
        "X1_hourly_load_stream": _windows(lambda e: windows.load(_entries(e))),
        "X1_daily_load_stream": _windows(lambda e: windows.load(_entries(e), "1 day")),
        "X1_hourly_load_in_order": lambda spark, sf_dir: shape_result(run.replay_in_order(
            read(spark, sf_dir, "events"), "ts", lambda e: windows.load(_entries(e)))),
        "X2_denials_stream": _windows(lambda e: windows.denials(sample.entry_logs(e))),
        "X2_denial_share_stream": _windows(lambda e: windows.denial_share(sample.entry_logs(e))),
        "X3_visits_stream": _windows(lambda e: windows.visits(sample.entry_logs(e))),
        "X4_reads_without_repeats": _stream(lambda e, t: _repeated_reads(e)),
        "X5_gate_flow": _stream(lambda e, t: gate_flow(t, batches.passages(e)), run.ROCKSDB),
        "X5_gate_flow_in_order": _flow_in_order,
        "X6_streamed_admission": _streamed_admission,
        **LLM_QUERIES,
    }


def oracle_sql() -> dict[str, str]:
    return {**REPORTS, **JOBS, **STREAMS, "X6_streamed_admission": JOBS["E1_entry_decisions"],
            "X5_gate_flow_in_order": STREAMS["X5_gate_flow"],
            "X1_hourly_load_in_order": STREAMS["X1_hourly_load_stream"],
            **LLM_SQL}
