"""Size checks before anything is copied to every task."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

MAX_ROWS, MAX_BYTES = 200_000, 64 * 1024 * 1024


def rows_within(df: DataFrame, max_rows: int) -> list[Row] | None:
    """All rows of a configuration table, or ``None`` if it has more than ``max_rows``."""
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def fits(df: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> bool:
    """Is the table small enough to copy to every executor?"""
    size = df.limit(max_rows + 1).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0)).alias("b")
    ).first()
    return size["n"] <= max_rows and size["b"] <= max_bytes


def join_small(left: DataFrame, right: DataFrame, on, how: str = "inner", max_rows: int = MAX_ROWS) -> DataFrame:
    """Broadcast ``right`` if its size allows, else a shuffled join (split by AQE when skewed)."""
    return left.join(F.broadcast(right) if fits(right, max_rows) else right, on, how)


def salted_join(left: DataFrame, right: DataFrame, on: list[str], by: str, salts: int = 64, how: str = "inner") -> DataFrame:
    """Equi-join for a hot key on the left: its rows go to ``salts`` tasks, the right side is repeated.

    ``by``: a column of the left side with many values, it decides the task.
    """
    key = "_salt"
    spread = left.withColumn(key, F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    repeated = right.withColumn(key, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(repeated, [*on, key], how).drop(key)


def literal(value, ddl: str) -> Column:
    """Configuration as one constant; the optimizer folds it before execution."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), ddl)


def unpack(df: DataFrame, keep: list[str], array: str | Column) -> DataFrame:
    """One row per struct of an array column; empty arrays give no row.

    The outer form keeps the optimizer from evaluating the array a second time in
    a filter of its own.
    """
    column = F.col(array) if isinstance(array, str) else array
    rows = df.select(*keep, F.explode_outer(column).alias("_row"))
    return rows.filter(F.col("_row").isNotNull()).select(*keep, "_row.*")
