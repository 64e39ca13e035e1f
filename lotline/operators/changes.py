"""Inserts, partial updates and deletes of whole batches, with their constraints."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lotline.operators.first_wins import (claim, claimed_columns, claims_of, first_wins,
                                          held_claims)
from lotline.operators.quality import row_rules
from lotline.operators.spread import join_totals
from lotline.schemas import CASCADE, NOW, RESTRICT, SET_NULL, TABLES, children_of
from lotline.session import cut_lineage, written
from lotline.sources.tables import Tables


@dataclass
class Change:
    table: DataFrame     # the table afterwards
    accepted: DataFrame  # batch rows that took effect
    rejected: DataFrame  # the others, with ``error``


def with_defaults(table: str, batch: DataFrame, at=None) -> DataFrame:
    """All columns of the table, NULLs and missing ones filled with the defaults.

    ``at`` is the time that stands for "now".
    """
    now = F.localtimestamp() if at is None else (
        at if isinstance(at, Column) else F.lit(at).cast("timestamp_ntz"))
    spec, out = TABLES[table], []
    for name, kind in spec.columns.items():
        held = F.col(name) if name in batch.columns else F.lit(None)
        if kind != "key":
            held = held.cast(kind)
        if name in spec.defaults:
            value = spec.defaults[name]
            value = now if value is NOW else F.lit(value)
            held = F.coalesce(held, value if kind == "key" else value.cast(kind))
        out.append(held.alias(name))
    return batch.select(*out)


def broken_rules(rows: DataFrame, table: str, key: str, parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """``key`` (unique and never NULL) and the first declared rule, of the row or of a reference, that a row breaks.

    A column that ``rows`` lacks is NULL. ``parents`` are the tables whose ids references must hold; dangling ones are
    found on one row per key.
    """
    spec = TABLES[table]
    whole = rows.withColumns({c: F.lit(None).cast("string" if kind == "key" else kind)
                              for c, kind in spec.columns.items() if c not in rows.columns})
    rules = [F.when(c, F.lit(name)) for name, c in row_rules(spec)]
    found = [whole.select(key, F.coalesce(*rules, F.lit(None).cast("string")).alias("error")).where("error is not null")]
    for ref in spec.references:
        if ref.parent in (parents or {}) and ref.column in rows.columns:
            asked = rows.where(F.col(ref.column).isNotNull()).select(key, ref.column)
            held = parents[ref.parent].select(F.col("id").alias(ref.column))
            dangling = asked.select(ref.column).distinct().join(held, ref.column, "left_anti")
            found.append(join_totals(asked, dangling, [ref.column], "left_semi").select(
                key, F.lit(f"{ref.column} -> {ref.parent}").alias("error")))
    return reduce(DataFrame.unionByName, found).groupBy(key).agg(F.min("error").alias("error"))


def apply_inserts(target: DataFrame, batch: DataFrame, unique_keys, position: str = "id", table: str | None = None,
                  parents: dict[str, DataFrame] | None = None) -> Change:
    """Adds the rows of ``batch`` that repeat no unique key; ``id`` is always one.

    With ``table``, rows that break a declared rule of it are rejected first, and with ``parents`` also those whose
    references name no parent; they take no keys.

    Keys the target holds reject at once; within the batch the first row by
    ``position`` wins and a rejected row frees its other keys. The rows are
    numbered and kept, so rows that are equal in all columns stay apart.
    """
    unique_keys = [("id",), *[tuple(k) for k in unique_keys if tuple(k) != ("id",)]]
    numbered = cut_lineage(batch.withColumn("_n", F.monotonically_increasing_id()))
    broken = numbered.limit(0).select(*batch.columns, F.lit("").alias("error"))
    if table:
        judged = join_totals(numbered, broken_rules(numbered, table, "_n", parents), ["_n"])
        judged = written(judged, "checked")
        broken = judged.where("error is not null").select(*batch.columns, "error")
        numbered = judged.where("error is null").drop("error")
    claiming = numbered.withColumn("_at", F.struct(position, "_n")).withColumn(
        "_claims", F.array_compact(F.array(*[claim(k) for k in unique_keys])))
    held = held_claims(claiming, "_at", "_claims", claims_of(target, unique_keys, numbered))
    probed = cut_lineage(claiming.join(held, "_at", "left"))
    known = probed.where("_held is not null").select(*batch.columns, _exists("_held").alias("error"))
    fresh = probed.where("_held is null").drop("_held")
    winners = first_wins(fresh, "_at", "_claims").withColumn("_wins", F.lit(True))
    judged = fresh.drop("_claims").join(winners, "_at", "left")
    accepted = judged.where("_wins").select(*batch.columns)
    repeated = judged.where("_wins is null").select(
        *batch.columns, F.lit("repeats an earlier row of the batch").alias("error"))
    columns = [c for c in target.columns if c in batch.columns]
    grown = target.unionByName(accepted.select(*columns), allowMissingColumns=True)
    return Change(grown, accepted, known.unionByName(repeated).unionByName(broken))


def _exists(held) -> Column:
    return F.concat(claimed_columns(held), F.lit(" already exists"))


def insert_ignore(target: DataFrame, batch: DataFrame, keys, position: str = "id") -> DataFrame:
    """Rows of ``batch`` to add when repeated keys are silently skipped.

    Of rows with one key the first by ``position`` stays, NULL positions last, and of equal
    positions the row of least hash. NULL is like nothing, so rows with a NULL in the key are all added.
    """
    keys = list(keys)
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    row = F.struct(*batch.columns)
    place = F.struct(F.col(position).isNull().alias("none"), F.col(position).alias("at"),
                     F.xxhash64(*batch.columns).alias("tie"))
    firsts = (batch.where(whole).groupBy(*keys).agg(F.min_by(row, place).alias("_row"))
              .select("_row.*"))
    return (firsts.join(target.select(*keys), keys, "left_anti").select(*batch.columns)
            .unionByName(batch.where(~whole)))


def last_values(patches: DataFrame, columns: list[str], order: str, key: str = "id") -> DataFrame:
    """One patch per key: per column the last value given, NULL where none was."""
    return patches.groupBy(key).agg(*[
        F.max_by(F.when(F.col(c).isNotNull(), F.col(c)),
                 F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def _changed_claims(unique_keys, columns: list[str]) -> Column:
    """Claims of the unique keys whose value a patch changes."""
    claims = []
    for keys in unique_keys:
        changed = F.lit(False)
        for k in keys:
            if k in columns:
                changed = changed | ~F.col(k).eqNullSafe(F.col(f"_old_{k}"))
        claims.append(F.when(changed, claim(keys)))
    return F.array_compact(F.array(*claims))


def _one_per_key(patch: DataFrame, columns: list[str], key: str, overwrite: bool, order: str | None,
                 others: list[str]) -> tuple[DataFrame, DataFrame]:
    """Patches folded to one per key, and keys with several patches that nothing puts in order."""
    if order is None:
        counts = patch.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key)
        return patch.join(counts, key, "left_anti"), counts
    places = patch.groupBy(key, order).agg(F.count(F.lit(1)).alias("_n"))
    unordered = (places.groupBy(key).agg(F.sum("_n").alias("_all"), F.max("_n").alias("_most"),
                                         F.count_if(F.col(order).isNull()).alias("_nowhere"))
                 .where("_all > 1 AND (_most > 1 OR _nowhere > 0)").select(key))
    unordered = unordered.where(F.col(key).isNotNull())
    patch = join_totals(patch, unordered, [key], "left_anti")
    place = F.struct(order)  # never NULL, so a single patch needs no order
    last = [F.max_by(c, place).alias(c) for c in others]
    values = [F.max_by(c, place).alias(c) if overwrite else
              F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in columns]
    return patch.groupBy(key).agg(*values, *last), unordered


def apply_updates(target: DataFrame, patch: DataFrame, columns: list[str], key: str = "id",
                  unique_keys=(), overwrite: bool = False, owner: tuple | None = None,
                  order: str | None = None, table: str | None = None,
                  parents: dict[str, DataFrame] | None = None) -> Change:
    """Applies patches to the rows of their key.

    With ``table``, patches after which a row breaks a declared rule of it fail, and with ``parents`` also those after
    which one of its references names no parent.

    Several patches of one key take effect one after the other by ``order``. Without an order they are all
    rejected, since none of them comes first, and so they are if the order of one is NULL or that of two the same.

    NULL in a patch keeps the old value, so a value cannot be cleared, unless
    ``overwrite`` takes the patch as it is. A patch fails if its key is unknown, if
    ``owner`` = (target column, patch column) differ, or if a changed unique key is
    held by another row of the target or of an earlier patch.
    """
    others = [owner[1]] if owner and owner[1] not in columns else []
    patch, unordered = _one_per_key(patch, columns, key, overwrite, order, others)
    new = patch.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in columns],
                       *([F.col(owner[1]).alias("_by")] if owner else []))
    found = new.join(target.withColumn("_found", F.lit(True)), key, "left")
    for c in columns:
        value = F.col(f"_new_{c}") if overwrite else F.coalesce(f"_new_{c}", c)
        found = found.withColumn(f"_old_{c}", F.col(c)).withColumn(c, value)
    checks = [F.when(F.col("_found").isNull(), "not found")]
    if owner:
        checks.append(F.when(~F.col(owner[0]).eqNullSafe(F.col("_by")), "not the owner"))
    if table:
        after = found.where(F.col("_found").isNotNull()).select(*target.columns)
        broken = broken_rules(after, table, key, parents).withColumnRenamed("error", "_broken")
        found = found.join(broken, key, "left")
        checks.append(F.col("_broken"))
    if unique_keys:
        found = found.withColumn("_claims", _changed_claims(unique_keys, columns))
        held = held_claims(found, key, "_claims", claims_of(target, unique_keys, found))
        found = found.join(held, key, "left")
        checks.append(F.when(F.col("_held").isNotNull(), _exists("_held")))
    found = found.withColumn("error", F.coalesce(*checks))
    failed = found.where("error is not null").select(key, "error").unionByName(
        unordered.select(key, F.lit("several patches without an order").alias("error")))
    good = found.where("error is null")
    if unique_keys:
        winners = first_wins(good, key, "_claims", len(unique_keys) == 1).withColumn("_wins", F.lit(True))
        good = good.join(winners, key, "left")
        failed = failed.unionByName(good.where("_wins is null").select(
            key, F.lit("repeats an earlier row of the batch").alias("error")))
        good = good.where("_wins")
    accepted = good.select(*target.columns)
    untouched = target.join(accepted.select(key), key, "left_anti").select(*target.columns)
    return Change(untouched.unionByName(accepted), accepted, failed)


@dataclass
class Deletion:
    tables: Tables       # all tables afterwards
    deleted: DataFrame   # root keys that were deleted
    rejected: DataFrame  # root keys that were not, with ``error``


def apply_deletes(tables: Tables, table: str, keys: DataFrame) -> Deletion:
    """Deletes rows of one table by ``id`` and follows the references to them.

    Children cascade, lose the reference or forbid the delete, as declared. Every
    key stands for its own delete against the given tables: one that is forbidden
    anywhere below leaves all its rows alone.
    """
    if table == "audit_logs":
        raise ValueError("audit rows may not be deleted")
    asked = keys.select("id").distinct()
    known = asked.join(getattr(tables, table).select("id"), "id", "left_semi")
    unknown = asked.join(known, "id", "left_anti").withColumn("error", F.lit("not found"))
    reached = {table: known.select("id", F.col("id").alias("_root"))}
    blocks, cleared = [], []
    waiting = [table]
    while waiting:
        parent = waiting.pop(0)
        for child, ref in children_of(parent):
            if child not in tables:
                continue
            hit = (getattr(tables, child).where(F.col(ref.column).isNotNull())
                   .join(reached[parent].select(F.col("id").alias(ref.column), "_root"), ref.column)
                   .select("id", "_root"))
            if ref.on_delete == RESTRICT:
                blocks.append(hit.select("_root", F.lit(f"still referenced by {child}").alias("error")))
            elif ref.on_delete == SET_NULL:
                cleared.append((child, ref.column, parent))
            elif ref.on_delete == CASCADE:
                reached[child] = (reached[child].unionByName(hit).distinct()
                                  if child in reached else hit)
                waiting.append(child)
    if blocks:
        blocked = blocks[0]
        for more in blocks[1:]:
            blocked = blocked.unionByName(more)
        blocked = blocked.groupBy(F.col("_root").alias("id")).agg(F.min("error").alias("error"))
    else:
        blocked = known.where(F.lit(False)).withColumn("error", F.lit(None).cast("string"))
    deleted = known.join(blocked, "id", "left_anti")
    gone = {name: rows.join(deleted.withColumnRenamed("id", "_root"), "_root", "left_semi")
            .select("id").distinct() for name, rows in reached.items()}
    after = {name: getattr(tables, name).join(ids, "id", "left_anti")
             .select(*getattr(tables, name).columns) for name, ids in gone.items()}
    for child, column, parent in cleared:
        rows = after.get(child, getattr(tables, child))
        lost = gone[parent].select(F.col("id").alias(column), F.lit(True).alias("_lost"))
        kept = F.when(F.col("_lost").isNull(), F.col(column)).alias(column)
        referring = join_totals(rows.where(F.col(column).isNotNull()), lost, [column]).select(
            *[kept if c == column else F.col(c) for c in rows.columns])
        after[child] = referring.unionByName(rows.where(F.col(column).isNull()))
    return Deletion(tables.replace(**after), deleted, unknown.unionByName(blocked))
