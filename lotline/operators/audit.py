"""Audit rows derived from what a change job did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lotline.functions.keys import derived_key
from lotline.schemas import AUDIT_ACTIONS

# Cars are audited under a singular name, everything else under the table's.
ENTITY_TYPES = {"cars": "car"}


def details_json(*columns: str) -> Column:
    """JSON text of columns, NULLs kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def audit_rows(table: str, action: str, changed: DataFrame, details: list[str], actor=None,
               at: str | Column | None = None, key: str = "id") -> DataFrame:
    """One audit row per row of ``changed``.

    ``actor`` is a column name, a column or a value. Ids follow from what was done
    to which row and when, so a repeated job derives the same rows.
    """
    if action not in AUDIT_ACTIONS:
        raise ValueError(f"unknown action {action!r}")
    actor = F.col(actor) if isinstance(actor, str) and actor in changed.columns else (
        actor if isinstance(actor, Column) else F.lit(actor).cast("string"))
    when = F.col(at) if isinstance(at, str) else at
    when = F.localtimestamp() if when is None else when
    entity = ENTITY_TYPES.get(table, table)
    return changed.select(
        derived_key("audit", F.lit(entity), F.lit(action), key, when).alias("id"),
        actor.alias("user_id"), F.lit(entity).alias("entity_type"),
        F.col(key).alias("entity_id"), F.lit(action).alias("action"),
        details_json(*details).alias("details"), when.alias("created_at"))
