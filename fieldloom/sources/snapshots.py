"""Keyed tables kept as snapshots in hash buckets.

A change rewrites only the buckets that hold changed rows; one numbered version file
names the files of all buckets and makes them current together.  Readers see one
version, a failed change none of its files.  Of two writers that started from the same
version the second gets an error and can repeat its change.  Old files stay, for
readers that began before; ``unused`` lists them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldloom.session import list_names, path_exists, put_text

BUCKETS = 64
BUCKET = "_bucket"


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)).cast("int")


def _version(spark: SparkSession, folder: str) -> tuple[int, dict]:
    names = [n for n in list_names(spark, f"{folder}/versions") if n.endswith(".json")]
    if not names:
        raise ValueError(f"no snapshot in {folder}")
    number = max(int(n.removesuffix(".json")) for n in names)
    text = spark.read.text(f"{folder}/versions/{number:012d}.json", wholetext=True).first()[0]
    return number, json.loads(text)


def _write(rows: DataFrame, folder: str, keys: list[str], buckets: int, tasks: int) -> str:
    """Rows in folders of their buckets; a bucket is written by ``tasks`` tasks, so a large one does not meet in one."""
    name = f"data/{uuid.uuid4().hex}"
    share = F.pmod(F.xxhash64(F.lit(1), *[F.col(k) for k in keys]), F.lit(tasks))
    placed = rows.withColumn(BUCKET, _bucket(keys, buckets)).repartition(BUCKET, share)
    placed.write.partitionBy(BUCKET).parquet(f"{folder}/{name}")
    return name


def _publish(spark: SparkSession, folder: str, number: int, state: dict) -> None:
    put_text(spark, f"{folder}/versions/{number:012d}.json", json.dumps(state), replace=False)


def _held(spark: SparkSession, folder: str, name: str, buckets) -> dict[str, str]:
    """Folder of each bucket that got rows."""
    made = set(list_names(spark, f"{folder}/{name}"))
    return {str(b): f"{name}/{BUCKET}={b}" for b in buckets if f"{BUCKET}={b}" in made}


def create(rows: DataFrame, folder: str, keys: list[str], buckets: int = BUCKETS, tasks: int = 1) -> None:
    """First version of a table with one row per key."""
    spark = rows.sparkSession
    if path_exists(spark, f"{folder}/versions"):
        raise ValueError(f"{folder} holds a snapshot already")
    name = _write(rows, folder, keys, buckets, tasks)
    state = {"keys": keys, "buckets": buckets, "tasks": tasks, "schema": rows.schema.json(), "parts": _held(spark, folder, name, range(buckets))}
    _publish(spark, folder, 0, state)


def _rows(spark: SparkSession, folder: str, state: dict, buckets=None) -> DataFrame:
    schema = StructType.fromJson(json.loads(state["schema"]))
    paths = [f"{folder}/{p}" for b, p in state["parts"].items() if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read(spark: SparkSession, folder: str, near: DataFrame | None = None) -> DataFrame:
    """The current rows; with ``near`` only those of the buckets that its keys lie in."""
    _, state = _version(spark, folder)
    return _rows(spark, folder, state, None if near is None else _touched(near, state))


def _touched(rows: DataFrame, state: dict) -> set[int]:
    numbers = rows.select(_bucket(state["keys"], state["buckets"]).alias("b")).distinct().collect()  # at most the number of buckets
    return {r["b"] for r in numbers}


def merge(spark: SparkSession, folder: str, rows: DataFrame, removed: DataFrame | None = None) -> set[int]:
    """Replace or add rows by key and drop the ``removed`` keys; returns the buckets that were rewritten.

    Rows that the table holds already change nothing, so a change applied twice writes
    once.  ``rows`` has one row per key; keys compare as values, null keys included.
    """
    number, state = _version(spark, folder)
    keys = state["keys"]
    schema = StructType.fromJson(json.loads(state["schema"]))
    given = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    fresh = given.subtract(_rows(spark, folder, state, _touched(given, state)))
    buckets = _touched(fresh, state)
    gone = fresh.select(*keys)
    if removed is not None:
        known = _rows(spark, folder, state, _touched(removed, state)).select(*keys).intersect(removed.select(*keys))
        buckets |= _touched(known, state)
        gone = gone.union(known)
        fresh = _without(fresh, removed.select(*keys), keys)
    if not buckets:
        return set()
    kept = _without(_rows(spark, folder, state, buckets), gone, keys)
    name = _write(kept.unionByName(fresh), folder, keys, state["buckets"], state["tasks"])
    parts = {b: p for b, p in state["parts"].items() if int(b) not in buckets} | _held(spark, folder, name, buckets)
    _publish(spark, folder, number + 1, {**state, "parts": parts})
    return buckets


def _without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    named = gone.distinct().toDF(*[f"_gone_{k}" for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_gone_{k}")) for k in keys]
    return rows.join(named, same, "left_anti")


def unused(spark: SparkSession, folder: str) -> list[str]:
    """Bucket folders that the current version does not name, for a clean-up by the owner."""
    _, state = _version(spark, folder)
    made = [f"data/{n}/{b}" for n in list_names(spark, f"{folder}/data") for b in list_names(spark, f"{folder}/data/{n}") if b.startswith(BUCKET)]
    return sorted(set(made) - set(state["parts"].values()))
