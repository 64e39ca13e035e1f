"""Temp views and SQL functions, for users who write SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lotline.plans.occupancy import parking_occupancy
from lotline.plans.people import user_parking_history
from lotline.plans.revenue import revenue_analytics
from lotline.schemas import ENTRY_MINIMUM
from lotline.sources.tables import Tables

VIEWS = {
    "parking_occupancy": parking_occupancy,
    "user_parking_history": user_parking_history,
    "revenue_analytics": revenue_analytics,
}

TERMS = "STRUCT<price_per_hour: DECIMAL(10,2), free_minutes: INT>"

# Same cent arithmetic as lotline.functions.money; `n` is minutes times price in cents.
COST_FUNCTIONS = (
    """
    CREATE OR REPLACE TEMPORARY FUNCTION cents_of(minutes BIGINT, n BIGINT) RETURNS BIGINT
    RETURN (n + 30) DIV 60 - CASE WHEN n % 60 = 30 AND minutes % 3 = 2 THEN 1 ELSE 0 END
    """,
    f"""
    CREATE OR REPLACE TEMPORARY FUNCTION billable_minutes(
        p_entry_time TIMESTAMP_NTZ, p_exit_time TIMESTAMP_NTZ, free_minutes INT) RETURNS BIGINT
    RETURN greatest(0, (timestampdiff(MICROSECOND, p_entry_time, p_exit_time) + 30000000)
                       DIV 60000000 - free_minutes)
    """,
    f"""
    CREATE OR REPLACE TEMPORARY FUNCTION cost_on_terms(
        p_entry_time TIMESTAMP_NTZ, p_exit_time TIMESTAMP_NTZ, terms {TERMS})
    RETURNS DECIMAL(12,2)
    RETURN CASE
        WHEN terms IS NULL THEN CAST(raise_error('Tariff not found') AS DECIMAL(12,2))
        WHEN p_exit_time IS NULL THEN NULL
        ELSE CAST(CAST(cents_of(
                 billable_minutes(p_entry_time, p_exit_time, terms.free_minutes),
                 billable_minutes(p_entry_time, p_exit_time, terms.free_minutes)
                 * CAST(terms.price_per_hour * 100 AS BIGINT)) AS DECIMAL(14,0)) * 0.01
             AS DECIMAL(12,2)) END
    """,
    """
    CREATE OR REPLACE TEMPORARY FUNCTION calculate_parking_cost(
        p_entry_time TIMESTAMP_NTZ, p_exit_time TIMESTAMP_NTZ, p_tariff_id {key})
    RETURNS DECIMAL(12,2)
    RETURN cost_on_terms(p_entry_time, p_exit_time,
        (SELECT max(named_struct('price_per_hour', price_per_hour, 'free_minutes', free_minutes))
         FROM tariffs WHERE id = p_tariff_id))
    """,
)

BALANCE_FUNCTION = """
    CREATE OR REPLACE TEMPORARY FUNCTION get_user_balance(p_user_id {key}) RETURNS DECIMAL(12,2)
    RETURN coalesce((SELECT max(balance) FROM wallets WHERE user_id = p_user_id), 0)
"""

ENTRY_FUNCTION = f"""
    CREATE OR REPLACE TEMPORARY FUNCTION check_entry_allowed(
        p_plate_number STRING, p_gate_id {{key}})
    RETURNS TABLE (allowed BOOLEAN, reason STRING, car_id {{key}}, user_id {{key}},
                   wallet_id {{key}}, balance DECIMAL(12,2))
    RETURN
      SELECT why = 'Entry allowed', why, car_id, user_id,
             CASE WHEN seen THEN wallet_id END, CASE WHEN seen THEN balance END
      FROM (
        SELECT car_id, user_id, wallet_id, balance,
               car_id IS NOT NULL AND NOT coalesce(is_blocked, false) AND wallet_id IS NOT NULL
                 AS seen,
               CASE WHEN car_id IS NULL THEN 'Car not found or inactive'
                    WHEN is_blocked THEN 'User is blocked'
                    WHEN wallet_id IS NULL THEN 'Wallet not found'
                    WHEN balance < {ENTRY_MINIMUM}
                      THEN concat('Insufficient balance: ', CAST(balance AS STRING),
                                  ' (minimum: {ENTRY_MINIMUM})')
                    ELSE 'Entry allowed' END AS why
        FROM (
          SELECT max(c.id) AS car_id, max(c.user_id) AS user_id,
                 max(u.is_blocked) AS is_blocked, max(w.id) AS wallet_id, max(w.balance) AS balance
          FROM cars c LEFT JOIN users u ON u.id = c.user_id LEFT JOIN wallets w ON w.user_id = c.user_id
          WHERE c.is_active AND c.plate_number = p_plate_number))
"""


def register_views(spark: SparkSession, tables: Tables) -> None:
    """Registers every table and the three analytic views under their usual names."""
    tables.register(spark)
    for name, build in VIEWS.items():
        build(tables).createOrReplaceTempView(name)


def register_functions(spark: SparkSession, tables: Tables) -> None:
    """SQL forms of the cost, balance and entry rules over the registered tables.

    They inline into the calling query as joins; for whole batches the operators
    in ``lotline.operators`` say the same with fewer of them.
    """
    tables.register(spark)
    key = tables.tariffs.schema["id"].dataType.simpleString()
    for text in (*COST_FUNCTIONS[:3], COST_FUNCTIONS[3].format(key=key),
                 BALANCE_FUNCTION.format(key=key), ENTRY_FUNCTION.format(key=key)):
        spark.sql(text)


def run_sql(spark: SparkSession, tables: Tables, text: str, **args) -> DataFrame:
    """A SQL query over the tables, views and functions, with named parameters."""
    register_views(spark, tables)
    register_functions(spark, tables)
    return spark.sql(text, args=args or None)
