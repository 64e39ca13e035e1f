"""Entry attempts and wallet operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lotline.functions.money import exact_avg, ratio
from lotline.functions.ranking import down, up
from lotline.functions.times import recent
from lotline.schemas import TABLES
from lotline.sources.tables import Tables


def entry_results(tables: Tables, as_of, days: int = 30) -> DataFrame:
    """Attempts per result and their share of all; the window sees one row per result."""
    counted = (recent(tables.entry_logs, "attempt_time", as_of, days)
               .groupBy("result").agg(F.count(F.lit(1)).alias("attempts_count")))
    total = F.sum("attempts_count").over(Window.partitionBy())
    return counted.withColumn("percentage", ratio(F.col("attempts_count") * 100, total))


def denials_by_reason(tables: Tables, as_of, days: int = 30) -> DataFrame:
    denied = tables.entry_logs.where(F.col("result") == "denied")
    return (recent(denied, "attempt_time", as_of, days)
            .groupBy("reason").agg(F.count(F.lit(1)).alias("denied_count"))
            .orderBy(down("denied_count"), up("reason")))


def wallet_operations(tables: Tables, as_of, days: int = 30) -> DataFrame:
    return (recent(tables.wallet_transactions, "created_at", as_of, days)
            .groupBy("operation_type")
            .agg(F.count(F.lit(1)).alias("transactions_count"),
                 F.sum("amount").alias("total_amount"), exact_avg("amount").alias("avg_amount"),
                 F.min("amount").alias("min_amount"), F.max("amount").alias("max_amount"))
            .orderBy(down("transactions_count"), up("operation_type")))


def wallet_operations_by_day(tables: Tables, as_of, days: int = 30) -> DataFrame:
    return (recent(tables.wallet_transactions, "created_at", as_of, days)
            .groupBy(F.to_date("created_at").alias("date"), "operation_type")
            .agg(F.count(F.lit(1)).alias("transactions_count"),
                 F.sum("amount").alias("total_amount"))
            .orderBy(down("date"), up("operation_type")))


def wallet_history(tables: Tables, wallet_id, as_of, days: int = 30) -> DataFrame:
    mine = tables.wallet_transactions.where(F.col("wallet_id") == wallet_id)
    return (recent(mine, "created_at", as_of, days)
            .select(*TABLES["wallet_transactions"].columns)
            .orderBy(down("created_at"), up("id")))


def car_by_plate(tables: Tables, plate: str) -> DataFrame:
    return tables.where_key("cars", plate, "plate_number")
