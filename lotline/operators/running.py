"""Running totals that split a busy key over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lotline.functions.times import EPOCH, elapsed_micros
from lotline.session import written

HOUR_MICROS = 3_600_000_000


def time_block(column, micros: int = HOUR_MICROS) -> Column:
    """Number of the stretch of time, since the epoch, that a row falls in."""
    return F.floor(elapsed_micros(F.expr(EPOCH), column) / F.lit(micros))


def running_total(df: DataFrame, key: list[str], time: str, tie: list[str], value: str,
                  out: str, descending: bool = False,
                  block_micros: int = HOUR_MICROS) -> DataFrame:
    """Adds ``out``: the sum of ``value`` per key up to and including each row in time order.

    A window over the key alone would bring a key's whole history to one task. Here
    the history is cut into hours: hours are totalled map-side first, one short
    window adds them up, and each row adds the total of the earlier hours to the
    running total within its own. ``tie`` orders rows of one instant. Rows without a
    key pass through; what they get is not defined. Where one key holds more than a
    task should sort per hour, ``block_micros`` cuts finer.
    """
    block = time_block(time, block_micros)
    block = -block if descending else block
    arrow = F.desc if descending else F.asc
    rows = df.withColumn("_block", block)
    hours = rows.groupBy(*key, "_block").agg(F.sum(value).alias("_hour_total"))
    earlier = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select(*key, "_block", F.sum("_hour_total").over(earlier).alias("_before"))
    within = (Window.partitionBy(*key, "_block").orderBy(arrow(time), *[arrow(t) for t in tie])
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (rows.join(hours, [*key, "_block"], "left")
            .withColumn(out, F.coalesce("_before", F.lit(0)) + F.sum(value).over(within))
            .drop("_block", "_before"))


def running_total_by_rows(df: DataFrame, key: list[str], time: str, tie: list[str], value: str, out: str) -> DataFrame:
    """As :func:`running_total`, in blocks of about as many rows instead of hours.

    The rows are dealt by range of key, time and tie, so a key's history is cut wherever a task has enough, also
    within one instant. They are written once, so that a block keeps its rows; blocks are totalled map-side, one short
    window per key adds the blocks up, and each row adds the total of the earlier blocks to the running total in its own.
    """
    dealt = df.repartitionByRange(*key, time, *tie).withColumn("_block", F.spark_partition_id())
    rows = written(dealt, "running-blocks")
    blocks = rows.groupBy(*key, "_block").agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*key, "_block", F.sum("_total").over(earlier).alias("_before"))
    within = Window.partitionBy(*key, "_block").orderBy(time, *tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (rows.join(blocks, [*key, "_block"], "left")
            .withColumn(out, F.coalesce("_before", F.lit(0)) + F.sum(value).over(within))
            .drop("_block", "_before"))


def running_rank(df: DataFrame, key: list[str], time: str, tie: list[str], out: str,
                 descending: bool = False) -> DataFrame:
    """Adds ``out``: 1, 2, ... per key in time order, by the same split."""
    counted = df.withColumn("_one", F.lit(1).cast("bigint"))
    return running_total(counted, key, time, tie, "_one", out, descending).drop("_one")
