"""Classes of alike items that a first step has put into clusters, without writing pairs down.

The items of a cluster meet in one task, each sent once, and a function finds their classes. A cluster of more than ``PART``
words of data is dealt into parts by hash: each part is joined by itself, then one item of each class with those of other
parts, and last of all the pairs of parts that still hold several classes, all of their items. So nothing is left out, and
copies, however many, cost no pairs of parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lotline.llm.common import written
from lotline.operators.components import components
from lotline.operators.spread import join_totals

PART = 1 << 22
"""Words of 64 bits that are joined in one task."""

ClassesOf = Callable[[list[bytes], np.ndarray, np.ndarray | None], np.ndarray]
"""From the data of items, the classes known of them, and maybe their sides (items of one side need not be compared), to
the number of an item of each one's class."""


def _joiner(classes_of: ClassesOf):
    """Arrow batches of (cluster, part, n, class, side, data), sorted by cluster and part, to links (a, b).

    Within a part, an item is linked with one of its class only. ``class`` is what is known of it before, or null.
    """

    def links(held: list) -> pa.RecordBatch:
        rows = list({row[0]: row for row in held}.values())  # an item may have come twice
        n = np.array([r[0] for r in rows], np.int64)
        known = np.array([r[0] if r[1] is None else r[1] for r in rows], np.int64)
        side = None if rows[0][2] is None else np.array([r[2] for r in rows])
        found = classes_of([r[3] for r in rows], known, side)
        apart = np.flatnonzero((found != np.arange(len(n))) & (known != known[found]))
        return pa.RecordBatch.from_arrays([pa.array(n[apart]), pa.array(n[found[apart]])], names=["a", "b"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for cluster, piece, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (cluster, piece) != part:
                    if len(held) > 1:
                        yield links(held)
                    part, held = (cluster, piece), []
                held.append(row)
        if len(held) > 1:
            yield links(held)

    return join


def _joined(placed: DataFrame, data: DataFrame, classes_of: ClassesOf) -> DataFrame:
    """Links (a, b) found among the items of each part. ``placed``: n, cluster, part, class, side."""
    rows = placed.join(data, "n").select("cluster", "part", "n", "class", "side", "data")
    rows = rows.repartition("cluster", "part").sortWithinPartitions("cluster", "part")
    return rows.mapInArrow(_joiner(classes_of), "a bigint, b bigint")


def _parts(nodes: DataFrame, most: int) -> DataFrame:
    """``nodes`` with parts (how many the cluster has) and part, dealt by hash."""
    totals = nodes.groupBy("cluster").agg(F.sum("weight").alias("total"))
    parts = totals.select("cluster", F.ceil(F.col("total") / most).cast("int").alias("parts"))
    dealt = join_totals(nodes, parts, ["cluster"], "inner")
    return dealt.withColumn("part", F.pmod(F.xxhash64("n", F.lit(3)), F.col("parts")).cast("string"))


def joined_classes(nodes: DataFrame, data: DataFrame, most: int, classes_of: ClassesOf) -> DataFrame:
    """n and class of every item that ``classes_of`` puts with another one.

    ``nodes``: n, cluster and weight (words of data); ``data``: n and data.
    """
    nothing = {"class": F.lit(None).cast("bigint"), "side": F.lit(None).cast("int")}
    dealt = written(_parts(nodes, most), "dealt")
    links = written(_joined(dealt.withColumns(nothing), data, classes_of), "links")
    split = dealt.where("parts > 1")
    if split.isEmpty():  # each cluster is a part, and its links are stars
        return links.select(F.col("a").alias("n"), F.col("b").alias("class")).unionByName(
            links.select(F.col("b").alias("n"), F.col("b").alias("class")).distinct())
    leaders = split.join(links.select(F.col("a").alias("n")).distinct(), "n", "left_anti").select("n", "cluster", "weight")
    between = _joined(_parts(leaders, most).withColumns(nothing), data, classes_of)
    links = written(links.unionByName(between), "links")
    classed = split.join(components(links), "n", "left").select(
        "n", "cluster", "part", F.coalesce("class", "n").alias("class"))
    classed = written(classed, "classed")
    held = written(classed.groupBy("cluster", "part").agg(F.min("class").alias("low"), F.max("class").alias("high")), "parts")
    one, other = (held.select("cluster", *[F.col(c).alias(f"{c}_{k}") for c in ("part", "low", "high")]) for k in (0, 1))
    pairs = one.join(other, "cluster").where("part_0 < part_1 AND least(low_0, low_1) <> greatest(high_0, high_1)")
    pairs = pairs.select("cluster", F.concat_ws("+", "part_0", "part_1").alias("pair"),
                         F.explode(F.array(*[F.struct(F.col(f"part_{k}").alias("part"), F.lit(k).alias("side")) for k in (0, 1)])).alias("p"))
    pairs = pairs.select("cluster", "pair", "p.part", "p.side")
    rest = classed.join(pairs, ["cluster", "part"]).select("n", "cluster", F.col("pair").alias("part"), "class", "side")
    return components(links.unionByName(_joined(rest, data, classes_of)))


