"""Connected components of links between numbered nodes.

Rounds hand on written tables: what a checkpoint remembers of its plan has a size estimate that every join squares, and after
some twenty joins the driver is busy with nothing but that number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lotline.session import written


def _shortened(hooks: DataFrame) -> DataFrame:
    """high and low, where each high points to the end of its chain of hooks."""
    while True:
        ahead = hooks.select(F.col("high").alias("low"), F.col("low").alias("lower"))
        hooks = written(hooks.join(ahead, "low", "left").select(
            "high", F.coalesce("lower", "low").alias("low"), F.col("lower").isNotNull().alias("moved")), "hooks")
        if hooks.where("moved").isEmpty():
            return hooks.drop("moved")


def components(links: DataFrame) -> DataFrame:
    """n and class of all nodes of ``links`` (a, b), where the class is a node of the component.

    Each round every class hooks onto the least class it has a link with, chains of hooks are cut short by doubling, and
    links within a class go. Rounds grow with the logarithm of a component's width. A class that very many links
    lead to is reduced map-side.
    """
    links = written(links.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).where("high <> low").distinct(), "links")
    classes = links.select("high").union(links.select("low")).distinct().select(F.col("high").alias("n"), F.col("high").alias("class"))
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("high").alias("low"), F.col("low").alias("high")))
        hooks = _shortened(both.groupBy("high").agg(F.min("low").alias("low")).where("low < high"))
        to = hooks.select(F.col("high").alias("class"), F.col("low").alias("to"))
        classes = written(classes.join(to, "class", "left").select("n", F.coalesce("to", "class").alias("class")), "classes")
        to_a, to_b = (hooks.select(F.col("high").alias(k), F.col("low").alias(f"to_{k}")) for k in ("a", "b"))
        moved = links.select(F.col("high").alias("a"), F.col("low").alias("b")).join(to_a, "a", "left").join(to_b, "b", "left")
        moved = moved.select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b")).where("a <> b")
        links = written(moved.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct(), "links")
    return classes
