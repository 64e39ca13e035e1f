"""First come, first served over shared keys, for batches taken in order."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lotline.operators.components import components
from lotline.operators.spread import join_totals
from lotline.session import written

FOLD_ROWS = 1_000_000
"""Rows of a component that one task takes in order; larger components are decided in rounds instead."""


def claim(keys) -> Column:
    """Text of a unique key over one or more columns, NULL if any part is."""
    whole = F.lit(True)
    for key in keys:
        whole = whole & F.col(key).isNotNull()
    parts = [F.to_json(F.struct(F.col(k).cast("string").alias("v"))) for k in keys]
    return F.when(whole, F.concat_ws("|", F.lit(", ".join(keys)), *parts))


def claimed_columns(text) -> Column:
    """The column names a claim is about."""
    return F.substring_index(text, "|", 1)


def claims_of(table: DataFrame, unique_keys, batch: DataFrame | None = None) -> DataFrame:
    """All claims (``_key``) the rows of a table hold, or those that ``batch`` could meet.

    With a batch, the table is reduced on the typed key columns to rows that share a key
    with it, before any claim is made or shuffled; a small batch is broadcast for that.
    """
    unique_keys = [list(k) for k in unique_keys]
    if batch is None:
        held = F.explode(F.array_compact(F.array(*[claim(k) for k in unique_keys])))
        return table.select(held.alias("_key"))
    parts = [table.select(*keys).join(batch.select(*keys).dropna().distinct(), keys, "left_semi")
             .select(claim(keys).alias("_key")) for keys in unique_keys]
    return reduce(DataFrame.unionByName, parts)


def held_claims(rows: DataFrame, position: str, claims: str, held: DataFrame) -> DataFrame:
    """Rows of which some claim is among ``held``, with the first such claim as ``_held``.

    Only claims travel, so rows without a value in a key, however many, meet nowhere.
    """
    pairs = rows.select(F.col(position), F.explode(claims).alias("_key"))
    return (pairs.join(held, "_key", "left_semi")
            .groupBy(position).agg(F.min("_key").alias("_held")))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, claims, row) in order, group after group: those accepted."""
    group, taken = None, set()
    for batch in batches:
        wins = []
        for of, claims in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if of != group:
                group, taken = of, set()
            accepted = taken.isdisjoint(claims)
            if accepted:
                taken.update(claims)
            wins.append(accepted)
        yield batch.select([2]).filter(pa.array(wins, pa.bool_()))


def _by_rounds(undecided: DataFrame) -> list[DataFrame]:
    """Accepted rows: each round takes those that come first on all their keys and drops the rows that share a key with them."""
    accepted = []
    while not undecided.isEmpty():
        first = undecided.groupBy("_key").agg(F.min("_row").alias("_first"))
        winners = (join_totals(undecided, first, ["_key"], "inner")
                   .groupBy("_row").agg(F.bool_and(F.col("_row") == F.col("_first")).alias("_wins"))
                   .where("_wins").select("_row"))
        winners = written(winners, "winners")
        taken = undecided.join(winners, "_row", "left_semi").select("_key")
        decided = (join_totals(undecided, taken, ["_key"], "left_semi")
                   .select("_row").distinct())
        accepted.append(winners)
        undecided = written(undecided.join(decided, "_row", "left_anti"), "undecided")
    return accepted


def first_wins(rows: DataFrame, position: str, claims: str, single: bool = False, most: int = FOLD_ROWS) -> DataFrame:
    """Positions of the rows accepted when rows are taken in order of ``position``, which is unique.

    Each row claims the keys in its array ``claims`` and is accepted if no accepted
    row before it claims one of them; a rejected row leaves its keys free. Rows whose
    keys nobody else claims are accepted at once. The rest falls into components of
    rows that share keys, each in touch with the first row of its keys. A component
    streams through one task in order, however long its chains of conflicts are; only
    its taken keys are held. Components of more than ``most`` rows, such as those of
    a key that a large share of all rows claims, are decided together in rounds
    that look at one row per key. With ``single``, no row claims more than one key, and
    the first row of each key is the answer.
    """
    if single:
        key = F.get(claims, 0)
        firsts = (rows.where(F.size(claims) > 0).groupBy(key.alias("_key"))
                  .agg(F.min(position).alias(position)).select(position))
        return rows.where(F.size(claims) == 0).select(position).unionByName(firsts)
    pairs = rows.select(F.col(position).alias("_row"),
                        F.explode(F.array_distinct(claims)).alias("_key"))
    contested = (pairs.groupBy("_key").agg(F.min("_row").alias("_a"), F.max("_row").alias("_b"))
                 .where("_a <> _b").select("_key"))
    undecided = written(
        pairs.join(join_totals(pairs, contested, ["_key"], "left_semi").select("_row").distinct(),
                   "_row", "left_semi"), "undecided")
    at_once = (rows.select(F.col(position).alias("_row"))
               .join(undecided.select("_row"), "_row", "left_anti"))
    if undecided.isEmpty():
        return at_once.withColumnRenamed("_row", position)
    # rows are numbered by hash: two of one number only put their components together
    numbered = undecided.withColumn("_n", F.xxhash64("_row"))
    hubs = numbered.groupBy("_key").agg(F.min_by("_n", "_row").alias("_hub"))
    groups = components(join_totals(numbered, hubs, ["_key"], "inner").select(F.col("_n").alias("a"), F.col("_hub").alias("b")))
    whole = numbered.groupBy("_row", "_n").agg(F.collect_set("_key").alias("_claims"))
    grouped = written(whole.join(groups, F.col("_n") == F.col("n"), "left").select(
        F.coalesce("class", "_n").alias("_group"), "_claims", "_row"), "conflicts")
    large = grouped.groupBy("_group").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > most).select("_group")
    large = written(large, "large-conflicts")
    small = (join_totals(grouped, large, ["_group"], "left_anti").repartition("_group")
             .sortWithinPartitions("_group", "_row"))
    accepted = [at_once, small.mapInArrow(_fold, grouped.select("_row").schema)]
    if not large.isEmpty():
        rest = join_totals(grouped, large, ["_group"], "left_semi").select("_row", F.explode("_claims").alias("_key"))
        accepted += _by_rounds(written(rest, "undecided"))
    return reduce(DataFrame.unionByName, accepted).withColumnRenamed("_row", position)
