"""Bulk import of users with their cars."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lotline.functions.keys import derived_key
from lotline.operators.first_wins import (claim, claimed_columns, claims_of, first_wins,
                                          held_claims)
from lotline.operators.quality import row_rules
from lotline.schemas import DEFAULT_CURRENCY, IMPORT_PAYLOAD, TABLES
from lotline.session import cut_lineage, written
from lotline.sources.tables import Tables

# Fixed value: the error text of every broken constraint.
INTEGRITY_ERROR = "Integrity error (duplicate phone/email/plate)"
UNREADABLE = "Invalid request"


@dataclass
class Import:
    users: DataFrame
    wallets: DataFrame
    cars: DataFrame
    audit: DataFrame
    errors: DataFrame   # request_no, user_no, phone, error, details
    summary: DataFrame  # request_no, created_users, created_cars, failed_users


def read_payloads(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Import requests from JSON, one per line, or one per file with ``multi_line``.

    A request is numbered by its own ``request_no`` or else by a hash of its file and text, and has a
    ``place``, its file, block and line, so that requests of one number stay apart and
    their order doesn't depend on how files are split. One that cannot be read becomes a
    row without users that is marked ``unreadable``.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("line"))  # increases along a block
    raw = spark.read.option("wholetext", multi_line).text(path).select("value", "_metadata", place.alias("place")).where(F.trim("value") != "")
    kind = T.StructType(IMPORT_PAYLOAD.fields + [T.StructField("request_no", T.LongType()),
                                                 T.StructField("_corrupt_record", T.StringType())])
    parsed = raw.select("value", "place", F.from_json("value", kind).alias("r"))
    return entries(parsed.select(
        F.coalesce("r.request_no", F.xxhash64("place.file", "value")).alias("request_no"), "place", "r.dry_run", "r.users",
        (F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()).alias("unreadable")))


def entries(requests: DataFrame) -> DataFrame:
    """One row per user of each request, in order, its cars still nested.

    A request without users keeps one row, without a ``user_no``. Requests may have a ``place`` that
    tells apart those of one number.
    """
    place = [F.col("place")] if "place" in requests.columns else []
    unreadable = F.col("unreadable") if "unreadable" in requests.columns else F.lit(False)
    return requests.select(
        "request_no", *place, F.coalesce("dry_run", F.lit(False)).alias("dry_run"), unreadable.alias("unreadable"),
        F.posexplode_outer("users").alias("user_no", "u")).select(
            "request_no", *place, F.col("user_no").cast("bigint").alias("user_no"), "dry_run", "unreadable",
            "u.phone", "u.email", "u.password_hash",
            F.coalesce("u.cars", F.array().cast("array<struct<plate_number:string,model:string>>"))
            .alias("cars"))


def _text_claim(column: str, value):
    """:func:`claim` of one text column, for a value inside an array too."""
    return F.when(value.isNotNull(), F.concat_ws("|", F.lit(column), F.to_json(
        F.struct(value.alias("v")))))


def _problem():
    """First reason why an entry cannot be stored, before other entries are looked at."""
    user_rules = [F.when(c, n) for n, c in row_rules(TABLES["users"])
                  if n.split()[0] in ("phone", "email", "password_hash")]
    plates = F.transform("cars", lambda c: c["plate_number"])
    long_plate = F.exists("cars", lambda c: F.char_length(c["plate_number"])
                          > TABLES["cars"].lengths["plate_number"])
    long_model = F.exists("cars", lambda c: F.char_length(c["model"])
                          > TABLES["cars"].lengths["model"])
    return F.coalesce(
        *user_rules,
        F.when(F.exists(plates, lambda p: p.isNull()), "plate_number required"),
        F.when(long_plate, "plate_number longer than 20"),
        F.when(long_model, "model longer than 255"),
        F.when(F.size(F.array_distinct(plates)) < F.size(plates), "plate_number repeated"),
        F.when(F.col("_held").isNotNull(),
               F.concat(claimed_columns("_held"), F.lit(" already exists"))))


def import_users(tables: Tables, batch: DataFrame, at, actor=None) -> Import:
    """Imports entries in request and user order; each user comes whole or not at all.

    Requests of one number are taken by their ``place``, if they have one. The entries are numbered
    and kept, so equal ones stay apart: the first is stored, the others are errors.

    Dry-run requests are checked against the stored tables only and store nothing,
    so repetitions among their own entries pass. ``at`` is the time of the import.
    """
    now = F.lit(at).cast("timestamp_ntz")
    if "unreadable" not in batch.columns:
        batch = batch.withColumn("unreadable", F.lit(False))
    if "place" not in batch.columns:
        batch = batch.withColumn("place", F.lit(None).cast("string"))
    batch = written(batch.withColumn("_n", F.monotonically_increasing_id()), "import")
    position = F.struct("request_no", "place", "user_no", "_n")
    without_users = batch.where("user_no is null").select("request_no", "unreadable")
    batch = batch.where("user_no is not null").drop("unreadable")

    plates = F.transform("cars", lambda c: c["plate_number"])
    claims = F.array_compact(F.concat(
        F.array(claim(["phone"]), claim(["email"])),
        F.transform(plates, lambda p: _text_claim("plate_number", p))))
    rows = batch.withColumn("_at", position).withColumn("_claims", claims)
    new_plates = rows.select(F.explode("cars.plate_number").alias("plate_number"))
    stored_claims = claims_of(tables.users, [("phone",), ("email",)], rows).unionByName(
        claims_of(tables.cars, [("plate_number",)], new_plates))
    probed = rows.join(held_claims(rows, "_at", "_claims", stored_claims), "_at", "left")
    probed = probed.withColumn("_problem", _problem())
    real = probed.where(F.col("_problem").isNull() & ~F.col("dry_run"))
    wins = first_wins(real, "_at", "_claims").withColumn("_wins", F.lit(True))
    judged = cut_lineage(probed.join(wins, "_at", "left").withColumn("_problem", F.coalesce(
        "_problem", F.when(~F.col("dry_run") & F.col("_wins").isNull(),
                           "repeats an earlier entry"))))
    stored = judged.where(F.col("_problem").isNull() & ~F.col("dry_run")).withColumn(
        "user_id", derived_key("user", "phone"))

    users = stored.select(F.col("user_id").alias("id"), "phone", "email", "password_hash",
                          now.alias("created_at"), F.lit(False).alias("is_blocked"))
    cars = stored.select("user_id", F.explode("cars").alias("c")).select(
        derived_key("car", "c.plate_number").alias("id"), "user_id", "c.plate_number", "c.model",
        F.lit(True).alias("is_active"), now.alias("created_at"))
    audit = stored.select(
        derived_key("audit", F.lit("batch_import"), "user_id").alias("id"),
        F.lit(actor).cast("string").alias("user_id"), F.lit("batch_import").alias("entity_type"),
        F.col("user_id").alias("entity_id"), F.lit("create").alias("action"),
        F.to_json(F.struct("phone", "email", "cars"), {"ignoreNullFields": "false"})
        .alias("details"), now.alias("created_at"))
    errors = judged.where("_problem is not null").select(
        "request_no", "user_no", "phone", F.lit(INTEGRITY_ERROR).alias("error"),
        F.col("_problem").alias("details"))
    errors = errors.unionByName(without_users.where("unreadable").select(
        "request_no", F.lit(None).cast("bigint").alias("user_no"), F.lit(None).cast("string").alias("phone"),
        F.lit(UNREADABLE).alias("error"), F.lit("not a JSON request").alias("details")))
    good = F.col("_problem").isNull()
    summary = judged.groupBy("request_no", "place").agg(
        F.count_if(good).alias("created_users"),
        F.coalesce(F.sum(F.when(good, F.size("cars"))), F.lit(0)).cast("bigint")
        .alias("created_cars"),
        F.count_if(~good).alias("failed_users")).drop("place")
    none = F.lit(0).cast("bigint")
    summary = summary.unionByName(without_users.select(
        "request_no", none.alias("created_users"), none.alias("created_cars"), none.alias("failed_users")))
    return Import(users, wallets_of_new_users(users), cars, audit, errors, summary)


def wallets_of_new_users(users: DataFrame) -> DataFrame:
    """The empty wallet every new user gets."""
    return users.select(
        derived_key("wallet", "id").alias("id"), F.col("id").alias("user_id"),
        F.lit("0.00").cast("decimal(12,2)").alias("balance"),
        F.lit(DEFAULT_CURRENCY).alias("currency"), F.col("created_at").alias("updated_at"))
