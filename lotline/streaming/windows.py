"""Windowed views of the gate flow. Each works on a stream and on a table alike.

Stored timestamps have no zone and watermarks need instants, so times are read as
UTC on the way in and written back without zone on the way out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lotline.functions.money import ratio
from lotline.functions.times import utc_instant, utc_wall_time

DELAY = "10 minutes"


def _timed(df: DataFrame, column: str, delay: str) -> DataFrame:
    return df.withColumn("_at", utc_instant(F.col(column))).withWatermark("_at", delay)


def _bounds(df: DataFrame, *columns) -> DataFrame:
    return df.select(utc_wall_time(F.col("w.start")).alias("window_start"),
                     utc_wall_time(F.col("w.end")).alias("window_end"), *columns)


def load(entries: DataFrame, size: str = "1 hour", delay: str = DELAY) -> DataFrame:
    """Entries and distinct cars per tumbling window; use '1 day' for the daily load.

    Counting per window and car first keeps the distinct count exact on a stream,
    where it is not available directly, and spreads a busy hour over its cars.
    """
    per_car = (_timed(entries, "entry_time", delay)
               .groupBy(F.window("_at", size).alias("w"), "car_id")
               .agg(F.count(F.lit(1)).alias("n")))
    counted = per_car.groupBy("w").agg(F.sum("n").alias("entries_count"),
                                       F.count(F.lit(1)).alias("unique_cars"))
    return _bounds(counted, "entries_count", "unique_cars")


def denials(logs: DataFrame, size: str = "1 hour", slide: str = "10 minutes",
            delay: str = DELAY) -> DataFrame:
    """Attempts per sliding window, result and reason."""
    counted = (_timed(logs, "attempt_time", delay)
               .groupBy(F.window("_at", size, slide).alias("w"), "result", "reason")
               .agg(F.count(F.lit(1)).alias("attempts_count")))
    return _bounds(counted, "result", "reason", "attempts_count")


def denial_share(logs: DataFrame, size: str = "1 hour", slide: str = "10 minutes",
                 delay: str = DELAY) -> DataFrame:
    """Share of denied attempts per sliding window."""
    counted = (_timed(logs, "attempt_time", delay)
               .groupBy(F.window("_at", size, slide).alias("w"))
               .agg(F.count(F.lit(1)).alias("attempts_count"),
                    F.count_if(F.col("result") == "denied").alias("denied_count")))
    return _bounds(counted, "attempts_count", "denied_count",
                   ratio("denied_count", "attempts_count").alias("denied_share"))


def visits(logs: DataFrame, gap: str = "2 hours", delay: str = DELAY) -> DataFrame:
    """Attempts of one plate that follow each other within ``gap``, as one visit."""
    merged = (_timed(logs, "attempt_time", delay)
              .groupBy("plate_number", F.session_window("_at", gap).alias("w"))
              .agg(F.count(F.lit(1)).alias("attempts_count"),
                   F.count_if(F.col("result") == "allowed").alias("allowed_count")))
    return _bounds(merged, "plate_number", "attempts_count", "allowed_count")


def without_repeats(reads: DataFrame, time: str = "attempt_time", keys: tuple = (
        "plate_number", "gate_id", "attempt_time"), delay: str = DELAY) -> DataFrame:
    """Gate reads delivered more than once, reduced to one; a stream forgets after ``delay``."""
    if not reads.isStreaming:
        return reads.dropDuplicates(list(keys))
    return _timed(reads, time, delay).dropDuplicatesWithinWatermark(list(keys)).drop("_at")
