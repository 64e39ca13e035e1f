"""The set of parking tables a report or job reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lotline.schemas import TABLES, struct_of


class Tables:
    """One DataFrame per table, reachable as an attribute.

    A table may be given as a function without arguments; it is called when the
    table is first used, so a report plans only the tables it reads.
    """

    def __init__(self, **frames: DataFrame | Callable[[], DataFrame]):
        unknown = set(frames) - set(TABLES)
        if unknown:
            raise ValueError(f"unknown tables: {sorted(unknown)}")
        self._frames = dict(frames)

    @classmethod
    def load(cls, spark: SparkSession, root: str, key_type: T.DataType | None = None,
             file_format: str = "parquet", only: tuple | None = None) -> "Tables":
        """Tables stored as ``root/<table>`` with the declared schema, nothing inferred."""
        def reader(name: str) -> Callable[[], DataFrame]:
            return lambda: (spark.read.schema(_stored_struct(name, key_type))
                            .format(file_format).load(f"{root.rstrip('/')}/{name}"))

        return cls(**{name: reader(name) for name in (only or TABLES)})

    def __getattr__(self, name: str) -> DataFrame:
        frames = self.__dict__.get("_frames", {})
        if name in frames:
            if not isinstance(frames[name], DataFrame):
                frames[name] = frames[name]()
            return frames[name]
        raise AttributeError(f"no table {name!r} in this set")

    def __contains__(self, name: str) -> bool:
        return name in self._frames

    def names(self) -> list[str]:
        return list(self._frames)

    def replace(self, **frames: DataFrame) -> "Tables":
        return Tables(**{**self._frames, **frames})

    def register(self, spark: SparkSession) -> None:
        """Temp view per table, under the table's own name."""
        for name in self._frames:
            getattr(self, name).createOrReplaceTempView(name)

    def where_key(self, table: str, value, column: str = "id") -> DataFrame:
        """Rows with one key, natural or surrogate; the equality reaches the scan."""
        return getattr(self, table).where(F.col(column) == value)

    def where_keys(self, table: str, keys: DataFrame, column: str = "id") -> DataFrame:
        """Rows whose key is in a one-column table of keys."""
        listed = keys.select(F.col(keys.columns[0]).alias(column))
        return getattr(self, table).join(listed, column, "left_semi")


def _stored_struct(name: str, key_type: T.DataType | None) -> T.StructType:
    """Declared columns plus the date columns the layout is partitioned by."""
    struct = struct_of(name, key_type)
    for extra in TABLES[name].partition_by:
        if extra not in struct.fieldNames():
            struct = struct.add(extra, T.DateType())
    return struct


def shape_result(df: DataFrame, zero: tuple = (), text: tuple = ()) -> DataFrame:
    """Plain result types for export.

    Decimals become doubles, whole numbers bigints and dates ISO text; the
    columns in ``zero`` read 0 where NULL and those in ``text`` become strings.
    """
    shaped: list[Column] = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        if f.name in zero:
            c = F.coalesce(c, F.lit(0).cast("double"))
        if f.name in text:
            c = c.cast("string")
        shaped.append(c.alias(f.name))
    return df.select(*shaped)
