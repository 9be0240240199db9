"""Class dictionaries: fit, encode, decode.

A dictionary is the sorted distinct values of a column (code-point order),
numbered from 0, fitted on all rows.  ``Dictionary`` is a table of any size:
numbered by range partitions plus offsets, encoded and decoded by joins.
``ClassDictionary`` is one small enough to stand in a plan as a literal, for
the classes of a model: encode and decode are JVM expressions without a join.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from babelcask.operators.ranking import numbered
from babelcask.session import cut_lineage, shuffle_partitions

# Most classes that stand in a plan (a literal array); a larger dictionary is a table.
MAX_PLAN_CLASSES = 100_000
# Largest dictionary (rows) that a join hands to every task.
MAX_BROADCAST_ROWS = 1 << 20


def literal_array(values, element: str) -> Column:
    """A constant array in one literal, however long (``array(lit, lit...)`` is a call and a plan node each)."""
    return F.from_json(F.lit(json.dumps(list(values), ensure_ascii=False)), f"array<{element}>")


@dataclass(frozen=True)
class Dictionary:
    """``frame(idx long, value)`` written in the shared folder, and its number of classes."""

    frame: DataFrame
    size: int

    @classmethod
    def fit(cls, df: DataFrame, column: str) -> Dictionary:
        """Distinct non-null values (pre-aggregated map-side) in code-point order, numbered without a global window."""
        values = df.select(F.col(column).alias("value")).where(F.col("value").isNotNull()).distinct()
        frame = cut_lineage(numbered(values, ["value"], "idx").select("idx", "value"), "dictionary")
        return cls(frame, frame.count())

    def encode(self, df: DataFrame, column: str, out: str, broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
        """``df`` with the class id of ``column``; an unseen non-null value is an error, null stays null."""
        found = self._lookup(df, column, "value", "idx", broadcast_rows)
        unseen = F.raise_error(F.concat(F.lit("unseen label: "), F.col(column).cast("string"))).cast("long")
        return found.withColumn(out, F.when(F.col(column).isNotNull() & F.col("_found").isNull(), unseen)
                                .otherwise(F.col("_found"))).drop("_found")

    def decode(self, df: DataFrame, column: str, out: str, broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
        """``df`` with the value of the class id ``column`` (null for null and for no class's id)."""
        return self._lookup(df, column, "idx", "value", broadcast_rows).withColumnRenamed("_found", out)

    def _lookup(self, df: DataFrame, column: str, key: str, value: str, broadcast_rows: int) -> DataFrame:
        """Left join on ``column``.  A dictionary above ``broadcast_rows`` is joined by shuffle, where rows of a
        value that holds more than one in ``shuffle partitions`` of all rows (so at most as many values) and null
        rows do not move: they meet a broadcast of those few entries."""
        entries = self.frame.select(F.col(key).alias("_key"), F.col(value).alias("_found"))
        on = F.col(column) == F.col("_key")
        if self.size <= broadcast_rows:
            return df.join(F.broadcast(entries), on, "left").drop("_key")
        counted = cut_lineage(df.groupBy(F.col(column).alias("_key")).agg(F.count(F.lit(1)).alias("_n")), "hotvalues")
        total = counted.agg(F.sum("_n")).first()[0] or 0
        hot = counted.where((F.col("_n") * shuffle_partitions(df.sparkSession) > total) & F.col("_key").isNotNull()).select("_key")
        few = entries.join(F.broadcast(hot), "_key")
        stay = (df.join(F.broadcast(few.withColumn("_hot", F.lit(True))), on, "left")
                .where(F.col(column).isNull() | F.col("_hot")).drop("_key", "_hot"))
        move = (df.where(F.col(column).isNotNull()).join(F.broadcast(hot), on, "left_anti")
                .join(entries.hint("merge"), on, "left").drop("_key"))
        return stay.unionByName(move)

    def in_plan(self) -> ClassDictionary:
        if self.size > MAX_PLAN_CLASSES:
            raise ValueError(f"{self.size} classes do not fit a plan (at most {MAX_PLAN_CLASSES}); encode with the table")
        return ClassDictionary(tuple(r["value"] for r in self.frame.orderBy("idx").collect()))


@dataclass(frozen=True)
class ClassDictionary:
    classes: tuple[str, ...]

    @classmethod
    def fit(cls, df: DataFrame, column: str) -> ClassDictionary:
        rows = (df.select(column).where(F.col(column).isNotNull()).distinct()
                .limit(MAX_PLAN_CLASSES + 1).collect())
        if len(rows) > MAX_PLAN_CLASSES:
            raise ValueError(f"column {column!r} has more than {MAX_PLAN_CLASSES} distinct values: use Dictionary")
        return cls(tuple(sorted((r[0] for r in rows), key=lambda s: s.encode("utf-8"))))

    @property
    def size(self) -> int:
        return len(self.classes)

    def _array(self) -> Column:
        return literal_array(self.classes, "string")

    def encode(self, c) -> Column:
        """Class id of a value; an unseen non-null value is an error, null stays null."""
        c = F.col(c) if isinstance(c, str) else c
        pos = F.array_position(self._array(), c)
        return (F.when(c.isNull(), F.lit(None).cast("int"))
                 .when(pos == 0, F.raise_error(F.concat(F.lit("unseen label: "), c)).cast("int"))
                 .otherwise((pos - 1).cast("int")))

    def decode(self, idx) -> Column:
        """Value of a class id (null for null)."""
        idx = F.col(idx) if isinstance(idx, str) else idx
        return F.element_at(self._array(), idx.cast("int") + 1)

    def table(self, spark: SparkSession) -> DataFrame:
        """(idx, value): every class, with or without rows."""
        return spark.range(1).select(F.posexplode(self._array()).alias("idx", "value"))
