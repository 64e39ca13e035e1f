"""Declared constraints as checks over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lotline.operators.spread import join_totals
from lotline.schemas import TABLES, TableSpec
from lotline.sources.tables import Tables


def row_rules(spec: TableSpec) -> list[tuple[str, Column]]:
    """(rule name, condition of a violation) pairs; NULL passes all but ``required``."""
    rules = [(f"{c} required", F.col(c).isNull()) for c in spec.required]
    rules += [(f"{c} longer than {n}", F.char_length(c) > n) for c, n in spec.lengths.items()]
    rules += [(f"{c} format", ~F.col(c).rlike(p)) for c, p in spec.patterns.items()]
    rules += [(f"{c} not in domain", ~F.col(c).isin(*v)) for c, v in spec.domains.items()]
    rules += [(f"{c} below {m}", F.col(c) < F.lit(m).cast("decimal(12,2)"))
              for c, m in spec.minimums.items()]
    rules += [(f"{b} before {a}", F.col(b) < F.col(a)) for a, b in spec.ordered]
    return rules


def with_violations(table: str, df: DataFrame, out: str = "violations") -> DataFrame:
    """Adds the names of the row rules each row breaks, in one pass without a shuffle."""
    rules = [(n, c) for n, c in row_rules(TABLES[table])]
    present = [F.when(c, F.lit(n)) for n, c in rules]
    return df.withColumn(out, F.array_compact(F.array(*present)))


def split_valid(table: str, df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that satisfy all row rules, and the others with what they break."""
    checked = with_violations(table, df)
    clean = F.size("violations") == 0
    return checked.where(clean).drop("violations"), checked.where(~clean)


def duplicate_keys(df: DataFrame, keys: tuple | list) -> DataFrame:
    """Key values held by more than one row; a key with a NULL part equals no other."""
    whole = df
    for key in keys:
        whole = whole.where(F.col(key).isNotNull())
    return whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def orphans(tables: Tables, table: str, column: str, parent: str) -> DataFrame:
    """Rows whose reference names no parent row; NULL references nothing.

    Dangling keys are found on one row per key, so a key shared by many rows
    does not weigh on the join with the parents.
    """
    child = getattr(tables, table).where(F.col(column).isNotNull())
    parents = getattr(tables, parent).select(F.col("id").alias(column))
    dangling = child.select(column).distinct().join(parents, column, "left_anti")
    return join_totals(child, dangling, [column], "left_semi")


def _key(columns) -> Column:
    """Text of key values, NULL if one of them is."""
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    return F.when(whole, F.to_json(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(columns)])))


def _marks(tables: Tables, table: str, constraints: list[tuple[str, str]]) -> DataFrame:
    """target, key and rule of all that one pass over a table has to say about its constraints.

    The target of a key is a unique constraint: the table's own, where ``rule`` is NULL, or that of the parent's
    id, where it is the reference. A row that breaks a row rule has the rule as target and no key.
    """
    spec, marks = TABLES[table], []
    none = F.lit(None).cast("string")

    def mark(holds: Column, target: str, key: Column, rule: Column) -> None:
        marks.append(F.when(holds, F.struct(F.lit(target).alias("target"), key.alias("key"), rule.alias("rule"))))

    rules = dict(row_rules(spec))
    keys = {", ".join(k): k for k in (("id",), *spec.unique)}
    references = {f"{r.column} -> {r.parent}": r for r in spec.references}
    for kind, name in constraints:
        if kind == "row":
            mark(rules[name], f"row|{table}|{name}", none, none)
        elif kind == "unique":
            mark(_key(keys[name]).isNotNull(), f"unique|{table}|{name}", _key(keys[name]), none)
        else:
            key = _key([references[name].column])
            mark(key.isNotNull(), f"unique|{references[name].parent}|id", key, F.lit(f"reference|{table}|{name}"))
    return getattr(tables, table).select(F.explode(F.array_compact(F.array(*marks))).alias("m")).select("m.*")


def constraints_of(tables: Tables, table: str) -> list[tuple[str, str]]:
    """(kind, name) of the declared constraints of a table."""
    spec = TABLES[table]
    return ([("row", name) for name, _ in row_rules(spec)] + [("unique", ", ".join(k)) for k in (("id",), *spec.unique)]
            + [("reference", f"{r.column} -> {r.parent}") for r in spec.references if r.parent in tables])


def quality_report(tables: Tables, only: tuple | None = None) -> DataFrame:
    """Violations of every declared constraint: table, kind, rule and rows concerned.

    Each table is read once, for all its constraints and as parent of others. Keys are counted map-side before they are
    shuffled, so a key that very many rows hold or refer to is one row per task; the ids of parents meet the
    references to them in the same groups, and no table is joined with another.
    """
    names = list(only or tables.names())
    asked = {name: constraints_of(tables, name) for name in names}
    parents = {r.parent for name in names for r in TABLES[name].references if r.parent in tables}
    passes = {**{p: [("unique", "id")] for p in sorted(parents)}, **asked}
    marks = reduce(DataFrame.unionByName, [_marks(tables, name, listed) for name, listed in passes.items()])
    counts = marks.groupBy("target", "key", "rule").agg(F.count(F.lit(1)).alias("n"))
    held = F.max(F.col("rule").isNull()).over(Window.partitionBy("target", "key"))
    broken = counts.withColumn("held", held).select(
        F.coalesce("rule", "target").alias("constraint"),
        F.when(F.col("key").isNull(), F.col("n")).when(F.col("rule").isNull(), F.when(F.col("n") > 1, F.col("n")))
        .otherwise(F.when(~F.col("held"), F.col("n"))).alias("n"))
    broken = broken.where("n is not null").groupBy("constraint").agg(F.sum("n").alias("n"))
    spark = getattr(tables, names[0]).sparkSession
    every = spark.createDataFrame([(name, kind, rule, f"{kind}|{name}|{rule}") for name in names for kind, rule in asked[name]],
                                  "table string, kind string, rule string, constraint string")
    return every.join(broken, "constraint", "left").select("table", "kind", "rule", F.coalesce("n", F.lit(0)).alias("rows"))
