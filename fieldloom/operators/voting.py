"""Votes across rows: most frequent value per group, ties to the first seen.

Counting comes first, with partial sums on (group, value), so a group that holds
a third of all rows is spread over as many tasks as it has values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counted(df: DataFrame, group: list[str], value: str, position: str) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(
        F.count(F.lit(1)).alias("n"), F.min(position).alias("first_seen")
    )


def frequency_vote(df: DataFrame, group: list[str], value: str, position: str) -> DataFrame:
    """Winner per group with its count.  ``position``: numeric order of appearance."""
    best = F.max(F.struct(F.col("n"), (-F.col("first_seen")).alias("p"), F.col(value).alias("v")))
    return counted(df, group, value, position).groupBy(*group).agg(best.alias("_b")).select(
        *group, F.col("_b.v").alias(value), F.col("_b.n").alias("n")
    )


def top_two_vote(df: DataFrame, group: list[str], value: str, position: str) -> DataFrame:
    """First and second of each group, as (first_value, second_value).

    Two aggregations instead of a window: the group is never sorted as a whole.
    """
    votes = counted(df, group, value, position).withColumn(
        "_s", F.struct(F.col("n"), (-F.col("first_seen")).alias("p"), F.col(value).alias("v"))
    )
    first = votes.groupBy(*group).agg(F.max("_s").alias("_1"))
    rest = votes.join(first, group).filter(F.col("_s") != F.col("_1")).groupBy(*group).agg(F.max("_s").alias("_2"))
    return first.join(rest, group, "left").select(
        *group, F.col("_1.v").alias("first_value"), F.col("_2.v").alias("second_value")
    )


def preference_vote(df: DataFrame, group: list[str], value: str, position: str, rank) -> DataFrame:
    """Most frequent value of the lowest rank class; rows without a rank are out."""
    ranked = df.withColumn("_r", rank).filter(F.col("_r").isNotNull())
    n = ranked.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first_seen"), F.min("_r").alias("_r"))
    best = F.max(F.struct((-F.col("_r")).alias("r"), F.col("n"), (-F.col("first_seen")).alias("p"), F.col(value).alias("v")))
    return n.groupBy(*group).agg(best.alias("_b")).select(*group, F.col("_b.v").alias(value), F.col("_b.n").alias("n"))


def top_n_per_group(df: DataFrame, group: list[str], order: list, n: int, columns: list[str]) -> DataFrame:
    """The ``n`` first rows of each group (feature: report of recent items).

    Pre-selects per task before the shuffle: each salt keeps n rows, then the group does.
    ``order``: numeric columns or expressions, larger first.
    """
    key = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *columns)
    salt = F.pmod(F.xxhash64(*columns), F.lit(64))
    best = lambda c: F.slice(F.sort_array(c, asc=False), 1, n)
    partial = df.select(*group, key.alias("_k"), salt.alias("_salt"))
    from pyspark.sql import Window

    w = Window.partitionBy(*group, "_salt").orderBy(F.desc("_k"))
    partial = partial.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    return partial.groupBy(*group).agg(best(F.collect_list("_k")).alias("_t")).select(*group, F.posexplode("_t").alias("_i", "_k")).select(
        *group, (F.col("_i") + 1).alias("rank"), *[F.col(f"_k.{c}").alias(c) for c in columns]
    )
