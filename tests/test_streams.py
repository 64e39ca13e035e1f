import random

import pytest
from pyspark.sql import functions as F

from lotline.operators.admission import admit
from lotline.sources import sample, sample_batches
from lotline.sources.sample import read, read_stream, sample_tables
from lotline.streaming import gate_flow, run, windows
from lotline.streaming.admission import admit_stream
from tests.frames import at, by_id, money, rows, tables


BUILDS = {
    "load": lambda e, d: windows.load(e.select(F.col("ts").alias("entry_time"), F.col("user_id").alias("car_id")), delay=d),
    "denials": lambda e, d: windows.denials(sample.entry_logs(e), delay=d),
    "share": lambda e, d: windows.denial_share(sample.entry_logs(e), delay=d),
    "visits": lambda e, d: windows.visits(sample.entry_logs(e), delay=d)}


@pytest.fixture(scope="module")
def in_parts(spark, sf_dir, tmp_path_factory):
    """The events as a folder of parts in no order of time."""
    folder = tmp_path_factory.mktemp("parts")
    read(spark, sf_dir, "events").repartition(4, "event_id").write.parquet(str(folder / "events.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", BUILDS)
def test_streams_equal_their_batch_forms(spark, sf_dir, in_parts, name):
    batch = rows(BUILDS[name](read(spark, sf_dir, "events"), "10 minutes"))
    for folder in (sf_dir, in_parts):
        got = run.run_to_end(read_stream(spark, folder, "events"), "ts", lambda e: BUILDS[name](e, "10 minutes"))
        assert rows(got) == batch


def test_parts_in_many_triggers(spark, sf_dir, in_parts):
    """With a delay as long as the disorder nothing is lost; with a short one the run fails."""
    batch = rows(BUILDS["load"](read(spark, sf_dir, "events"), "10 minutes"))
    got = run.run_to_end(read_stream(spark, in_parts, "events", 1), "ts", lambda e: BUILDS["load"](e, "60 days"))
    assert rows(got) == batch
    with pytest.raises(run.LateRows):
        run.run_to_end(read_stream(spark, in_parts, "events", 1), "ts", lambda e: BUILDS["load"](e, "10 minutes"))


@pytest.mark.parametrize("name", ["load", "visits"])
def test_replay_in_order_needs_no_long_delay(spark, sf_dir, in_parts, name):
    """Parts in no order of time, a slice per trigger, with the delay that fails for files in their own order."""
    batch = rows(BUILDS[name](read(spark, sf_dir, "events"), "10 minutes"))
    got = run.replay_in_order(read(spark, in_parts, "events"), "ts", lambda e: BUILDS[name](e, "10 minutes"), slices=5)
    assert rows(got) == batch


def test_reads_and_flow_do_not_depend_on_files(spark, sf_dir, in_parts):
    for build in (lambda e: windows.without_repeats(sample.entry_logs(e).unionByName(sample.entry_logs(e))),):
        got = [rows(run.run_to_files(build(read_stream(spark, f, "events")))) for f in (sf_dir, in_parts)]
        assert got[0] == got[1] and len(got[0]) == read(spark, sf_dir, "events").count()


def test_stream_admission_equals_batch(spark, sf_dir, tmp_path):
    t = sample_tables(spark, sf_dir)
    attempts = sample_batches.attempts(read_stream(spark, sf_dir, "events"))
    admit_stream(attempts, lambda: sample_tables(spark, sf_dir), str(tmp_path / "out"),
                 str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "decisions")).drop("batch")
    expected = admit(t, sample_batches.attempts(read(spark, sf_dir, "events"))).decisions
    assert rows(got, *expected.columns) == rows(expected)


def flow_tables(spark):
    return tables(
        spark, users=[{"id": "u1", "phone": "+71"}, {"id": "u2", "phone": "+72"}],
        wallets=[{"id": "w1", "user_id": "u1", "balance": money(100)}],
        cars=[{"id": "c1", "user_id": "u1", "plate_number": "A1"},
              {"id": "c2", "user_id": "u2", "plate_number": "A2"}],
        tariffs=[{"id": "t", "name": "T", "price_per_hour": money(100)}])


PASSAGE = ("id string, kind string, plate_number string, at timestamp_ntz, user_id string, "
           "amount decimal(12,2)")


def test_gate_flow_keeps_state_between_batches(spark, tmp_path):
    batches = [
        [("1", "entry", "A1", at(0), None, None), ("2", "entry", "A2", at(0), None, None),
         ("3", "entry", "??", at(0), None, None)],
        [("4", "exit", "A1", at(12), None, None), ("5", "topup", None, at(6), "u1", money(200)),
         ("6", "exit", "A1", at(13), None, None)],
        [("7", "exit", "A1", at(1), None, None), ("8", "entry", "A1", at(14), None, None)]]
    for i, batch in enumerate(batches):
        (spark.createDataFrame(batch, PASSAGE).coalesce(1).write.mode("append")
         .parquet(str(tmp_path / "in" / f"n={i}")))
    stream = (spark.readStream.schema(PASSAGE).option("maxFilesPerTrigger", 1)
              .parquet(str(tmp_path / "in" / "n=*")))
    got = run.run_to_files(gate_flow.gate_flow(flow_tables(spark), stream), run.ROCKSDB)
    assert by_id(got, "done", "message", "session_id", "cents", "balance_cents") == {
        "1": (True, "Entry allowed", "1", None, 10_000),
        "2": (False, "Wallet not found", None, None, None),
        "3": (False, "Car not found or inactive", None, None, None),
        "5": (True, "Top-up posted", None, 20_000, 30_000),
        "4": (True, "Exit processed", "1", 120_000, -90_000),
        "6": (False, "No active session found", None, None, -90_000),
        "7": (False, "Arrived late", None, None, -90_000),
        "8": (False, "Insufficient balance", None, None, -90_000)}


@pytest.mark.parametrize("files", [1, 3])
def test_gate_flow_takes_passages_in_order_of_time(spark, tmp_path, files):
    """Passages come in any order and in any micro-batches; the outcome is that of their order of time."""
    rng = random.Random(8)
    passages = [("t0", "topup", None, at(0), "u1", money(900))]
    for i in range(40):
        kind = rng.choice(["entry", "exit"])
        passages.append((f"p{i:02}", kind, rng.choice(["A1", "A1", "A2", "??"]), at(minutes=7 * i + 1), None, None))
    shuffled = rng.sample(passages, len(passages))
    for i in range(6):
        spark.createDataFrame(shuffled[i::6], PASSAGE).coalesce(1).write.parquet(str(tmp_path / "in" / f"n={i}"))
    spark.createDataFrame(passages, PASSAGE).coalesce(1).write.parquet(str(tmp_path / "one" / "n=0"))

    def stream(folder, n):
        return (spark.readStream.schema(PASSAGE).option("maxFilesPerTrigger", n).parquet(str(tmp_path / folder / "n=*")))

    t, columns = flow_tables(spark), ("id", "user_id", "car_id", "kind", "done", "message", "session_id", "cents", "balance_cents")
    want = rows(run.run_to_files(gate_flow.gate_flow(t, stream("one", 9)), run.ROCKSDB), *columns)
    got = run.run_to_end(stream("in", files), "at", lambda e: gate_flow.gate_flow(t, e, delay="6 hours"), run.ROCKSDB)
    assert rows(got, *columns) == want and len(want) == len(passages)


def test_cost_in_whole_numbers_agrees_with_the_columns(spark):
    from lotline.functions.money import parking_cost
    rng = random.Random(5)
    cases = [(at(0), at(seconds=rng.randrange(0, 90_000)), rng.randrange(0, 20_000), rng.randrange(0, 90))
             for _ in range(300)]
    df = spark.createDataFrame([(a, b, money(p / 100), f) for a, b, p, f in cases],
                               "a timestamp_ntz, b timestamp_ntz, p decimal(10,2), f int")
    got = [int(r[0] * 100) for r in df.select(parking_cost("a", "b", "p", "f")).collect()]
    us = [gate_flow.cost_cents(0, int((b - a).total_seconds()) * 1_000_000, p, f) for a, b, p, f in cases]
    assert got == us
