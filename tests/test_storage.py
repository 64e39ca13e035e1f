import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from lotline.operators import quality
from lotline.plans import occupancy, people
from lotline.schemas import TABLES
from lotline.sources import datagen, sinks
from lotline.sources.seeds import seed_tables
from lotline.sources.tables import Tables, shape_result
from lotline.streaming import run
from tests.frames import at, frame, money, rows, tables


def test_seed_rows_find_each_other(spark):
    seeds = seed_tables(spark)
    named = (seeds.tariffs
             .join(seeds.access_levels.select(F.col("id").alias("access_level_id"), "code"),
                   "access_level_id", "left")
             .join(seeds.parking_zones.select(F.col("id").alias("zone_id"), F.col("name").alias("zone")),
                   "zone_id", "left"))
    assert rows(named, "name", "price_per_hour", "free_minutes", "code", "zone") == [
        ("Employee", money(30), 60, "EMPLOYEE", None), ("Resident", money(50), 30, "RESIDENT", None),
        ("Standard", money(100), 15, None, None), ("VIP", money(200), 60, "VIP", "VIP Zone")]
    assert rows(seeds.gates.groupBy("type").count()) == [("entry", 2), ("exit", 2)]


def test_generated_data_is_sound_and_repeatable(spark):
    made = datagen.generate(spark, 60, 3000, 300)
    again = datagen.generate(spark, 60, 3000, 300, partitions=3)
    assert rows(made.parking_sessions) == rows(again.parking_sessions)
    broken = quality.quality_report(made).where("rows > 0").collect()
    assert {r["rule"] for r in broken} <= {"balance below -1000.00"}
    shares = {r["status"]: r["count"] / 3000 for r in made.parking_sessions.groupBy("status").count().collect()}
    assert abs(shares["completed"] - 0.8) < 0.04 and abs(shares["active"] - 0.15) < 0.03
    assert 60 <= made.cars.count() <= 180 and made.entry_logs.count() == 3000
    cars = made.cars.select("plate_number")
    assert made.entry_logs.join(cars, "plate_number", "left_anti").count() == 0
    assert made.cars.where(~F.col("plate_number").rlike("^[АВЕКМНОРСТУХ][0-9]{3}[АВЕКМНОРСТУХ]{2}[0-9]{1,3}$")).count() == 0
    span = made.parking_sessions.agg(F.min("entry_time"), F.max("entry_time")).first()
    assert dt.datetime(2024, 1, 2) <= span[0] and span[1] < dt.datetime(2024, 2, 1)


def test_stored_tables_prune_by_status_and_day(spark, tmp_path):
    made = datagen.generate(spark, 40, 800, 50)
    sinks.publish(made, str(tmp_path), 1)
    sinks.publish(made.replace(users=made.users.limit(3)), str(tmp_path), 2)
    assert sinks.latest_version(spark, str(tmp_path)) == 2
    stored = sinks.load_latest(spark, str(tmp_path))
    assert stored.users.count() == 3
    assert rows(stored.parking_sessions.select(*TABLES["parking_sessions"].columns)) == rows(
        made.parking_sessions)
    assert rows(occupancy.busiest_days(stored, "2024-02-01")) == rows(
        occupancy.busiest_days(made, "2024-02-01"))
    plan = occupancy.busiest_days(stored, "2024-02-01")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(status" in plan and "entry_date" in plan
    assert people.active_sessions(stored).columns == list(TABLES["parking_sessions"].columns)


def test_appended_rows_arrive_in_a_stream(spark, tmp_path):
    root = str(tmp_path)
    logs = [{"id": str(i), "plate_number": "A", "gate_id": "g", "attempt_time": at(i),
             "result": "allowed"} for i in range(30)]
    sinks.append_events(frame(spark, "entry_logs", logs[:20]), root, "entry_logs")
    sinks.append_events(frame(spark, "entry_logs", logs[20:]), root, "entry_logs")
    arrived = run.run_to_files(run.stream_table(spark, root, "entry_logs").select("id"))
    assert arrived.count() == 30


def test_lookups_by_key(spark):
    t = tables(spark, cars=[{"id": str(i), "user_id": "u", "plate_number": f"P{i}"} for i in range(5)])
    assert rows(t.where_key("cars", "P3", "plate_number"), "id") == [("3",)]
    keys = spark.createDataFrame([("1",), ("4",), ("9",)], "k string")
    assert rows(t.where_keys("cars", keys), "id") == [("1",), ("4",)]


def test_tables_are_built_on_first_use(spark):
    built = []
    t = Tables(users=lambda: built.append(1) or frame(spark, "users", []))
    assert not built
    assert t.users is t.users and built == [1]


def test_result_shapes(spark):
    df = spark.createDataFrame([(Decimal("1.50"), 1, dt.date(2024, 1, 2), None, 7)],
                               "d decimal(12,2), i int, day date, m decimal(12,2), k bigint")
    assert shape_result(df, zero=("m",), text=("k",)).first().asDict() == {
        "d": 1.5, "i": 1, "day": "2024-01-02", "m": 0.0, "k": "7"}


def test_a_change_writes_only_the_partitions_it_touches(spark, tmp_path):
    root = str(tmp_path)
    made = datagen.generate(spark, 30, 400, 40)
    sinks.publish(made, root, 1)
    columns = list(TABLES["parking_sessions"].columns)
    stored = sinks.load_latest(spark, root).parking_sessions.select(*columns)
    one = stored.where("status = 'active'").orderBy("id").limit(1)
    [row] = one.collect()
    closed = one.withColumn("status", F.lit("completed")).withColumn("exit_time", F.col("entry_time")).withColumn(
        "total_cost", F.lit(0).cast("decimal(12,2)"))
    want = rows(stored.where(F.col("id") != row["id"]).unionByName(closed.select(*columns)))
    day = row["entry_time"].date()
    done = sinks.merge(spark, root, 2, {"parking_sessions": closed})
    assert set(done["parking_sessions"]) <= {f"status={s}/entry_date={day}" for s in ("active", "completed")}
    after = sinks.load_latest(spark, root)
    assert rows(after.parking_sessions.select(*columns)) == want
    assert rows(after.cars) == rows(made.cars) and after.wallet_transactions.count() == made.wallet_transactions.count()
    # a patch that stays in its partition writes that one, on top of a merged version; a delete likewise
    patched = after.parking_sessions.where(F.col("id") == row["id"]).withColumn("total_cost", F.lit(5).cast("decimal(12,2)"))
    assert sinks.merge(spark, root, 3, {"parking_sessions": patched})["parking_sessions"] == [f"status=completed/entry_date={day}"]
    gone = spark.createDataFrame([(row["id"],)], "id string")
    sinks.merge(spark, root, 4, {}, {"parking_sessions": gone})
    last = sinks.load_latest(spark, root)
    assert rows(last.parking_sessions.select(*columns)) == rows(stored.where(F.col("id") != row["id"]))
    assert rows(sinks.load_version(spark, root, 2).parking_sessions.select(*columns)) == want
    user = last.users.orderBy("id").limit(1).withColumn("is_blocked", F.lit(True))
    assert sinks.merge(spark, root, 5, {"users": user}) == {"users": [""]}
    assert sinks.load_latest(spark, root).users.where("is_blocked").count() >= 1
    assert sinks.load_latest(spark, root).users.count() == made.users.count()


def test_bucketed_tables_join_without_an_exchange(spark, tmp_path):
    made = datagen.generate(spark, 40, 600, 50)
    stored = sinks.write_bucketed(made, str(tmp_path), f"b{tmp_path.name.replace('-', '_')}_", 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cars = stored.cars.select(F.col("id").alias("car_id"), "user_id")
        joined = stored.parking_sessions.join(cars, "car_id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        totals = stored.parking_sessions.groupBy("car_id").agg(F.sum("total_cost").alias("spent")).join(cars, "car_id")
        assert "Exchange" not in totals._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == made.parking_sessions.count()
        car = made.cars.orderBy("id").first()["id"]
        assert rows(people.car_sessions(stored, car, "2024-02-01", 30)) == rows(people.car_sessions(made, car, "2024-02-01", 30))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
