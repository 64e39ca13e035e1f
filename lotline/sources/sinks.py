"""Writing tables: layout for pruning, appends, and snapshots that appear as a whole."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lotline.schemas import DATE_OF, TABLES
from lotline.sources.tables import Tables

# Order within files, so that row groups can be skipped by key.
SORT_KEYS = {
    "parking_sessions": ("car_id", "entry_time"),
    "wallet_transactions": ("wallet_id", "created_at"),
    "entry_logs": ("plate_number", "attempt_time"),
    "audit_logs": ("entity_id",),
    "cars": ("plate_number",),
    "wallets": ("user_id",),
}


def laid_out(table: str, df: DataFrame) -> DataFrame:
    """Adds the partition dates, evens out the files and orders them by key.

    The rebalance hint groups rows by partition and splits a partition that is too
    large for one file over several tasks, so a busy day is not written by one.
    """
    spec = TABLES[table]
    for time, date in DATE_OF.items():
        if date in spec.partition_by:
            df = df.withColumn(date, F.to_date(time))
    if spec.partition_by:
        df = df.hint("rebalance", *spec.partition_by)
    keys = [*spec.partition_by, *SORT_KEYS.get(table, ())]
    return df.sortWithinPartitions(*keys) if keys else df


def write_table(df: DataFrame, root: str, table: str, mode: str = "append") -> None:
    """Stores rows under ``root/table`` in the table's layout."""
    writer = laid_out(table, df).write.mode(mode)
    if TABLES[table].partition_by:
        writer = writer.partitionBy(*TABLES[table].partition_by)
    writer.parquet(f"{root.rstrip('/')}/{table}")


# Keys by which tables can be dealt into buckets, so that joins and totals over them need no exchange.
BUCKET_KEYS = {
    "parking_sessions": "car_id",
    "cars": "id",
    "wallets": "user_id",
    "users": "id",
    "wallet_transactions": "wallet_id",
}


def write_bucketed(tables: Tables, root: str, catalog_prefix: str, buckets: int, only: tuple | None = None) -> Tables:
    """Stores tables in buckets of their key under ``root`` and registers them in the catalog; returns them as stored.

    Sessions are bucketed by car and cars by id, both into as many buckets, so a join of the two and totals per car
    read matching buckets side by side, and the larger side isn't shuffled. A bucketed table is found by its name in the catalog.
    """
    out = {}
    for table in only or BUCKET_KEYS:
        name, key = f"{catalog_prefix}{table}", BUCKET_KEYS[table]
        df = getattr(tables, table).repartition(buckets, key)  # a file for each bucket
        (df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
         .option("path", f"{root.rstrip('/')}/{table}").saveAsTable(name))
        out[table] = df.sparkSession.table(name)
    return tables.replace(**out)


def append_events(df: DataFrame, root: str, table: str) -> None:
    """Appends log, transaction, session or audit rows."""
    write_table(df.select(*TABLES[table].columns), root, table, "append")


def write_tables(tables: Tables, root: str, mode: str = "errorifexists") -> None:
    for name in tables.names():
        write_table(getattr(tables, name), root, name, mode)


def publish(tables: Tables, root: str, version: int) -> None:
    """Writes all tables as one version; readers see it once its mark exists.

    The mark is written last, by Spark, so a job that dies half way leaves the
    earlier version in force. A version is never written over: a second try takes
    a new number.
    """
    root = root.rstrip("/")
    write_tables(tables, f"{root}/version={version}")
    spark = getattr(tables, tables.names()[0]).sparkSession
    (spark.range(1).select(F.lit(version).cast("bigint").alias("version"))
     .write.mode("append").parquet(f"{root}/published"))


def latest_version(spark: SparkSession, root: str) -> int | None:
    marks = spark.read.schema("version bigint").parquet(f"{root.rstrip('/')}/published")
    return marks.agg(F.max("version")).first()[0]


def load_latest(spark: SparkSession, root: str, **options) -> Tables:
    return load_version(spark, root, latest_version(spark, root), **options)


def load_version(spark: SparkSession, root: str, version: int, **options) -> Tables:
    """The tables of a version; one that merged a change reads what it left alone where it was stored."""
    parts = _manifest(spark, root, version)
    if parts is None:
        return Tables.load(spark, f"{root.rstrip('/')}/version={version}", **options)
    return Tables(**{table: (lambda table=table: _placed(spark, root, version, table, parts, options).drop("_folder"))
                     for table in sorted({r["table"] for r in parts})})


def _placed(spark: SparkSession, root: str, version: int, table: str, parts: list | None, options: dict) -> DataFrame:
    """Rows of a stored table and the partition folder of each, "" in a table without partitions."""
    root, folder = root.rstrip("/"), F.regexp_extract(F.col("_metadata.file_path"), f"/version=[0-9]+/{table}/(?:(.*)/)?[^/]*$", 1)
    places: dict[int, list] = {}
    for row in parts or ():
        if row["table"] == table:
            places.setdefault(row["stored_in"], []).append(row["folder"])
    held = []
    for at, folders in sorted(places.items()) or [(version, [""])]:
        base = f"{root}/version={at}/{table}"
        schema = getattr(Tables.load(spark, f"{root}/version={at}", **options), table).schema
        reader = spark.read.schema(schema).option("basePath", base)
        held.append(reader.parquet(*[f"{base}/{f}".rstrip("/") for f in folders]).select("*", folder.alias("_folder")))
    return reduce(DataFrame.unionByName, held)


MANIFEST = "table string, folder string, stored_in bigint"


def _manifest(spark: SparkSession, root: str, version: int) -> list | None:
    """Where each partition of a merged version is stored; there are as many rows as partitions."""
    marked = spark.read.schema("version bigint, merged boolean").parquet(f"{root}/published").where(F.col("version") == version)
    if not any(r["merged"] for r in marked.collect()):
        return None
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest/version={version}").collect()


def merge(spark: SparkSession, root: str, version: int, upserts: dict[str, DataFrame],
          deletes: dict[str, DataFrame] | None = None, **options) -> dict[str, list[str]]:
    """Publishes a change of some rows as a new version that writes only the partitions it touches.

    ``upserts`` are whole rows that replace those of their ``id`` or are new; ``deletes`` are ids. A partition is
    touched if a row leaves it or comes to it. All others, and all other tables, are referred to where an
    earlier version has them. Returns the folders written, by table. Folders and values of partitions, which are as few as
    partitions, come to the driver.
    """
    root, deletes = root.rstrip("/"), deletes or {}
    before = latest_version(spark, root)
    listed = _manifest(spark, root, before)
    names = sorted({r["table"] for r in listed}) if listed else load_version(spark, root, before, **options).names()
    now = {table: _placed(spark, root, before, table, listed, options) for table in names}
    entries = {(r["table"], r["folder"]): r["stored_in"] for r in listed or ()}
    if listed is None:
        entries = {(t, f): before for t in names for f in _folders(now[t])}
    done: dict[str, list[str]] = {}
    for table in {**upserts, **deletes}:
        stored, by = now[table], list(TABLES[table].partition_by)
        new = upserts[table].select(*TABLES[table].columns) if table in upserts else None
        ids = [f.select("id") for f in (new, deletes.get(table)) if f is not None]
        ids = reduce(DataFrame.unionByName, ids).distinct()
        touched = stored
        if by:
            leaving = stored.join(ids, "id", "left_semi").select("_folder", *by).distinct().collect()
            values = {tuple(r)[1:] for r in leaving}
            if new is not None:
                values |= {tuple(r) for r in _dated(table, new).select(*by).distinct().collect()}
            touched = stored.where(_is_one_of(by, values))
            for row in leaving:
                entries.pop((table, unquote(row["_folder"])), None)
        kept = touched.join(ids, "id", "left_anti").select(*TABLES[table].columns)
        write_table(kept if new is None else kept.unionByName(new), f"{root}/version={version}", table)
        done[table] = _folders(_placed(spark, root, version, table, None, options))
        entries |= {(table, f): version for f in done[table]}
    rows = [(table, folder, int(at)) for (table, folder), at in sorted(entries.items())]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{root}/manifest/version={version}")
    (spark.range(1).select(F.lit(version).cast("bigint").alias("version"), F.lit(True).alias("merged"))
     .write.mode("append").parquet(f"{root}/published"))
    return done


def _folders(placed: DataFrame) -> list[str]:
    return sorted(unquote(r[0]) for r in placed.select("_folder").distinct().collect())


def _dated(table: str, df: DataFrame) -> DataFrame:
    for time, date in DATE_OF.items():
        if date in TABLES[table].partition_by and date not in df.columns:
            df = df.withColumn(date, F.to_date(time))
    return df


def _is_one_of(columns: list[str], values: set[tuple]) -> Column:
    """Whether partition columns have one of these values; it reaches the scan."""
    found = F.lit(False)
    for row in sorted(values, key=repr):
        found = found | reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) if v is not None else F.col(c).isNull()
                                                    for c, v in zip(columns, row)])
    return found
