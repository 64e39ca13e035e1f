"""What the plans must look like, on stored tables."""

import pytest
from pyspark.sql import functions as F

from lotline.operators.running import running_total
from lotline.operators.spread import join_totals
from lotline.plans import activity, occupancy, people, revenue
from lotline.schemas import TABLES
from lotline.sources import datagen, sinks
from lotline.sources.tables import Tables
from lotline.streaming.run import settings


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("stored"))
    sinks.write_tables(datagen.generate(spark, 30, 500, 50), root)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    yield Tables.load(spark, root)
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def above(text, leaf):
    """Operators above the scan of the first relation with column ``leaf``, nearest first."""
    lines = text.splitlines()
    at = next(i for i, line in enumerate(lines) if "Relation" in line and leaf in line)
    depth, found = len(lines[at]) - len(lines[at].lstrip(" :+-")), []
    for line in reversed(lines[:at]):
        level = len(line) - len(line.lstrip(" :+-"))
        if level < depth:
            depth = level
            found.append(line.lstrip(" :+-").split()[0])
    return found


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_period_and_status_prune_the_scan(stored):
    text = plan(revenue.daily_revenue(stored, "2024-01-20", 7))
    assert "entry_date" in text.split("PartitionFilters:")[1].split("]")[0]
    assert "GreaterThanOrEqual(entry_time" in text
    assert "ReadSchema: struct<entry_time:timestamp_ntz,total_cost:decimal(12,2)>" in text


def test_range_of_days_reaches_the_scan(stored):
    text = plan(revenue.revenue_report(stored, "2024-01-10", "2024-01-12"))
    assert "GreaterThanOrEqual(entry_time,2024-01-10" in text and "LessThan(entry_time,2024-01-13" in text


def test_key_lookups_reach_the_scan(stored):
    assert "EqualTo(plate_number,X)" in plan(activity.car_by_plate(stored, "X"))
    assert "EqualTo(wallet_id,w)" in plan(activity.wallet_history(stored, "w", "2024-02-01"))
    text = plan(people.car_sessions(stored, "c", "2024-02-01"))
    assert "EqualTo(car_id,c)" in text and "entry_date" in text


def test_debtors_filter_reaches_the_scan(stored):
    assert "LessThan(balance,0" in plan(people.debtors(stored))


def test_sessions_are_added_up_before_they_are_joined(stored):
    for df in (people.top_users_by_use(stored), people.top_users_by_spend(stored),
               people.top_users(stored), people.top_cars(stored),
               people.recent_top_spenders(stored, "2024-02-01"),
               people.debtors_with_activity(stored), revenue.tariff_averages(stored),
               occupancy.zone_usage(stored, "2024-02-01"), occupancy.parking_occupancy(stored)):
        path = above(optimized(df), "total_cost")
        assert path.index("Aggregate") < path.index("Join"), path


def test_top_k_never_sorts_everything(stored):
    for df in (people.top_users_by_use(stored), people.top_cars(stored),
               occupancy.busiest_days(stored, "2024-02-01")):
        assert "TakeOrderedAndProject" in plan(df) and "rangepartitioning" not in plan(df)


def test_windows_never_run_over_a_whole_wallet(stored):
    text = optimized(running_total(stored.wallet_transactions, ["wallet_id"], "created_at", ["id"],
                                   "amount", "total"))
    windows = [line for line in text.splitlines() if "Window [" in line]
    rows = [w for w in windows if "amount" in w]
    assert rows and all("_block" in w.split("windowspecdefinition(")[1].split("ASC")[0] for w in rows)


def test_no_python_in_batch_plans(stored):
    for df in (people.user_parking_history(stored), revenue.revenue_analytics(stored),
               occupancy.parking_occupancy(stored)):
        assert "Python" not in plan(df) and "Pandas" not in plan(df)


def test_idle_zone_join_is_inner(stored):
    text = optimized(occupancy.zone_usage(stored, "2024-02-01"))
    assert "LeftOuter" not in text


def test_average_is_a_subquery_not_a_join(stored):
    text = optimized(people.expensive_sessions(stored))
    assert "scalar-subquery" in text and "Cross" not in text


def test_declared_columns_only(stored):
    assert people.active_sessions(stored).columns == list(TABLES["parking_sessions"].columns)
    assert stored.parking_sessions.where(F.col("status") == "active").count() > 0


SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


def test_hot_keys_are_split(spark, tmp_path):
    """One car with a third of all rows: the joins stay splittable at run time."""
    hot = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 5000)
    spark.range(0, 60_000, 1, 16).select("id", hot.alias("k"), F.rand(1).alias("v")).write.parquet(
        str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    totals = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    with settings(spark, SKEW):
        spread = join_totals(rows, totals, ["k"], "inner")
        assert spread.where("n > 10000").count() == rows.where("k = 7").count() > 20_000
        spread.collect()
        assert "skew=true" in plan(spread)
        plain = rows.join(totals, "k")
        plain.collect()
        assert "skew=true" not in plan(plain)
        with_users = rows.join(spark.range(5000).withColumnRenamed("id", "k"), "k", "left")
        with_users.collect()
        assert "skew=true" in plan(with_users)
