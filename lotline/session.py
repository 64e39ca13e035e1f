"""Session settings and the two session-level helpers that jobs share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ENGINE_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "lotline", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the engine settings.

    ``master`` and the shuffle width are left to the cluster unless given:
    AQE coalesces whatever initial width ``spark.sql.shuffle.partitions`` sets.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**ENGINE_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, for checkpoints and job outputs.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only a local
    session may fall back to a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not is_local(spark):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    return os.path.join(tempfile.gettempdir(), f"lotline-{spark.sparkContext.applicationId}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably so that loops replan from files, not history."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder every executor can reach."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read again: it survives lost executors.

    Unlike a checkpoint it forgets the plan's size estimate, which every join multiplies, so loops hand on written tables.
    """
    folder = new_folder(df.sparkSession, name)
    df.write.options(**options).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
