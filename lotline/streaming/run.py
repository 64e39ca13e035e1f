"""Reading tables as streams and running streams to files."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lotline.session import shared_folder
from lotline.schemas import TABLES, struct_of

ROCKSDB = {"spark.sql.streaming.stateStore.providerClass":
           "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class LateRows(RuntimeError):
    """Rows came after the watermark had passed them, so a result would be without them."""


def stream_table(spark: SparkSession, root: str, table: str, key_type: T.DataType | None = None,
                 files_per_trigger: int | None = None) -> DataFrame:
    """A stored table as a stream of its new files.

    ``files_per_trigger`` bounds a micro-batch; it needs files in order of time, or a delay
    as long as their disorder.
    """
    struct = struct_of(table, key_type)
    for extra in TABLES[table].partition_by:
        if extra not in struct.fieldNames():
            struct = struct.add(extra, T.DateType())
    reader = spark.readStream.schema(struct)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{root.rstrip('/')}/{table}")


@contextmanager
def settings(spark: SparkSession, values: dict):
    """Session settings for the length of a block."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}/{uuid.uuid4()}"


def append_stream(stream: DataFrame, path: str, state: str, partition_by: tuple = ()):
    """Starts an append-only stream into parquet that ends when the input is used up."""
    writer = (stream.writeStream.format("parquet").outputMode("append")
              .option("path", path).option("checkpointLocation", state))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.trigger(availableNow=True).start()


def late_rows(query) -> int:
    """How many rows a query that has ended dropped behind its watermark."""
    return sum(operator.numRowsDroppedByWatermark
               for progress in query.recentProgress for operator in progress.stateOperators)


def _finish(query) -> None:
    query.awaitTermination()
    if late := late_rows(query):
        raise LateRows(f"{late} rows came later than the watermark's delay allows")


ALL_PROGRESS = {"spark.sql.streaming.numRecentProgressUpdates": "100000"}
END_OF_TIME = "9000-01-01 00:00:00"


def run_to_files(stream: DataFrame, conf: dict | None = None) -> DataFrame:
    """Runs a stream over all input there is, into files, and returns those as a table.

    Windows that the watermark has not passed stay open; see :func:`run_to_end`.
    Raises :class:`LateRows` rather than leave rows out.
    """
    spark = stream.sparkSession
    folder = new_folder(spark, "streams")
    with settings(spark, {**ALL_PROGRESS, **(conf or {})}):
        _finish(append_stream(stream, f"{folder}/out", f"{folder}/state"))
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def run_to_end(source: DataFrame, time: str, build, conf: dict | None = None) -> DataFrame:
    """As :func:`run_to_files` for ``build(source)``, with the last windows too.

    When the source is used up, one row at the end of time follows it through a second
    file source of the same query. It moves the watermark past all real windows,
    which come out; its own window never closes.
    """
    spark = source.sparkSession
    folder = new_folder(spark, "streams")
    blank = [F.lit(END_OF_TIME if f.name == time else None).cast(f.dataType).alias(f.name) for f in source.schema.fields]
    last = spark.range(1).coalesce(1).select(*blank)
    last.limit(0).write.parquet(f"{folder}/end")
    whole = source.unionByName(spark.readStream.schema(source.schema).parquet(f"{folder}/end"))
    stream = build(whole)
    with settings(spark, {**ALL_PROGRESS, **(conf or {})}):
        _finish(append_stream(stream, f"{folder}/out", f"{folder}/state"))
        last.write.mode("append").parquet(f"{folder}/end")
        _finish(append_stream(stream, f"{folder}/out", f"{folder}/state"))
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def replay_in_order(events: DataFrame, time: str, build, slices: int = 8, conf: dict | None = None) -> DataFrame:
    """As :func:`run_to_end` for the rows of a table in whatever order its files hold them, a slice of time per trigger.

    The rows are first stored by slice, between quantiles of ``time``; rows without a time come first. Then the slices follow one
    another into the source of the stream, which takes up each before the next arrives. So a trigger holds one
    slice of the table, and the watermark's delay need not cover the disorder of the files.
    """
    spark, folder = events.sparkSession, new_folder(events.sparkSession, "replay")
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    cuts = sorted(set(events.select(micros.cast("double").alias("at")).approxQuantile(
        "at", [k / slices for k in range(1, slices)], 0.01))) if slices > 1 else []
    number = sum((F.when(micros.cast("double") >= cut, 1).otherwise(0) for cut in cuts), F.lit(0))
    (events.withColumn("_slice", number).hint("rebalance", "_slice").write.partitionBy("_slice").parquet(f"{folder}/slices"))
    stored = spark.read.schema(T.StructType([*events.schema.fields, T.StructField("_slice", T.IntegerType())])).parquet(f"{folder}/slices")
    blank = [F.lit(END_OF_TIME if f.name == time else None).cast(f.dataType).alias(f.name) for f in events.schema.fields]
    events.limit(0).write.parquet(f"{folder}/in")
    stream = build(spark.readStream.schema(events.schema).parquet(f"{folder}/in"))
    last = spark.range(1).coalesce(1).select(*blank)
    parts = [stored.where(F.col("_slice") == k).drop("_slice") for k in range(len(cuts) + 1)]
    with settings(spark, {**ALL_PROGRESS, **(conf or {})}):
        for part in [*parts, last]:
            part.write.mode("append").parquet(f"{folder}/in")
            _finish(append_stream(stream, f"{folder}/out", f"{folder}/state"))
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
