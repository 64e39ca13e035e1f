"""Which rows a viewer may see: their own, or all of them for an administrator."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lotline.schemas import TABLES
from lotline.sources.tables import Tables

ADMIN_PHONE = "000"  # fixed value: the default administrator's phone

OPEN_TABLES = ("access_levels", "parking_zones", "parking_spots", "tariffs", "gates",
               "user_access_levels")
ADMIN_TABLES = ("audit_logs",)


def viewers(users: DataFrame, admin_phone: str = ADMIN_PHONE) -> DataFrame:
    """Viewer rows (viewer_id, is_admin) of users."""
    return users.select(F.col("id").alias("viewer_id"),
                        (F.col("phone") == admin_phone).alias("is_admin"))


def with_owner(tables: Tables, table: str, df: DataFrame | None = None) -> DataFrame:
    """Adds ``owner_id``: directly, through the car, its plate or the wallet."""
    df = getattr(tables, table) if df is None else df
    if table == "users":
        return df.withColumn("owner_id", F.col("id"))
    if table in ("cars", "wallets"):
        return df.withColumn("owner_id", F.col("user_id"))
    if table == "parking_sessions":
        cars = tables.cars.select(F.col("id").alias("car_id"), F.col("user_id").alias("owner_id"))
        return df.join(cars, "car_id")
    if table == "entry_logs":
        cars = tables.cars.select("plate_number", F.col("user_id").alias("owner_id"))
        return df.join(cars, "plate_number")
    if table == "wallet_transactions":
        wallets = tables.wallets.select(F.col("id").alias("wallet_id"),
                                        F.col("user_id").alias("owner_id"))
        return df.join(wallets, "wallet_id")
    raise ValueError(f"rows of {table} have no owner")


def visible_to(tables: Tables, table: str, viewer_id=None, is_admin: bool = False,
               df: DataFrame | None = None) -> DataFrame:
    """Rows of ``table`` one viewer sees."""
    rows = getattr(tables, table) if df is None else df
    if is_admin or table in OPEN_TABLES:
        return rows
    if table in ADMIN_TABLES:
        return rows.where(F.lit(False))
    mine = with_owner(tables, table, rows).where(F.col("owner_id") == viewer_id)
    return mine.select(*rows.columns)


def seen_by(tables: Tables, table: str, who: DataFrame) -> DataFrame:
    """For many viewers at once: ``viewer_id`` with each row they own, administrators included.

    An administrator also sees all other rows; those are the table itself, and are not
    multiplied with the administrators here. A table for administrators only has no owners.
    """
    owned = with_owner(tables, table)
    columns = [c for c in TABLES[table].columns if c in owned.columns]
    return (owned.join(who.select("viewer_id"), F.col("owner_id") == F.col("viewer_id"))
            .select("viewer_id", *columns))


def scopes(who: DataFrame) -> DataFrame:
    """What each viewer may see: (viewer_id, scope_id), with scope_id NULL for all rows.

    An administrator has the scope of everything and anybody else the scope of their own id.
    """
    return who.select("viewer_id", F.when(~F.col("is_admin"), F.col("viewer_id")).alias("scope_id"))


def seen_in_scopes(tables: Tables, table: str, who: DataFrame) -> DataFrame:
    """For many viewers at once: each row of ``table`` with the scopes it is in.

    With scope_id NULL it is there once for all administrators together, if there are any, and with its
    owner's id once more if the owner is a viewer. So a table is never multiplied with its administrators;
    ``in_scope`` answers for one viewer. Tables open to all are only in the scope of everything, and every viewer has it.
    """
    rows = getattr(tables, table)
    found = scopes(who)
    everybody = F.lit(True) if table in OPEN_TABLES else F.col("scope_id").isNull()
    owner = found.where("scope_id is not null")
    nobody = F.lit(None).cast(owner.schema["scope_id"].dataType).alias("scope_id")
    every = rows.where(found.where(everybody).exists()).select(nobody, *rows.columns)
    if table in OPEN_TABLES or table in ADMIN_TABLES:
        return every
    owned = with_owner(tables, table)
    columns = [c for c in rows.columns if c in owned.columns]
    mine = owned.join(owner.select("scope_id").distinct(), F.col("owner_id") == F.col("scope_id"))
    return every.select("scope_id", *columns).unionByName(mine.select("scope_id", *columns))


def in_scope(seen: DataFrame, table: str, viewer_id, is_admin: bool = False) -> DataFrame:
    """The rows of ``seen_in_scopes`` that one viewer sees, as ``visible_to`` gives them."""
    whole = is_admin or table in OPEN_TABLES
    mine = F.col("scope_id").isNull() if whole else F.col("scope_id") == viewer_id
    return seen.where(mine).drop("scope_id")
