"""Connected components of a table of links, by alternating large and small stars.

Each round joins every vertex to the smallest vertex it sees, first for its larger
neighbours, then for its smaller ones, until only stars are left.  A vertex with very
many links is a hot key of one side of an equi-join whose other side has one row
for it, which adaptive execution splits; minima are taken before the shuffle.  Each
round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import materialize

MAX_ROUNDS = 60


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """links: a > b."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    others = links.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id that occurs in the links (a, b); component: the smallest id reachable.

    Links of an id with itself, repeated links and links in both directions are
    allowed.  No links give no rows.
    """
    now = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        now = materialize(_small_star(_large_star(now)))
        after = _state(now)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"no end after {MAX_ROUNDS} rounds")
    stars = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct())
