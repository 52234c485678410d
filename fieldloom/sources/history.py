"""History pages that read only the files their rows lie in.

Rows are appended in order of time; a small index holds the oldest and newest time and
the number of rows of each file.  A page starts behind a cursor, the (time, id) of the
last row seen, so no page sorts or counts the ones before it.  Rows whose files are
not in the index yet are not seen.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.session import path_exists


def append_history(rows: DataFrame, folder: str, time: str = "created_at", ident: str = "id", files: int = 8) -> None:
    """Add rows, newest first, in ``files`` files of their own; every row has a time and an id."""
    spark = rows.sparkSession
    target = f"{folder}/rows/{uuid.uuid4().hex}"
    order = [F.desc(time), F.desc(ident)]
    rows.repartitionByRange(files, *order).sortWithinPartitions(*order).write.parquet(target)
    stored = spark.read.schema(rows.schema).parquet(target)
    missing = F.count_if(F.col(time).isNull() | F.col(ident).isNull()).alias("missing")
    entries = stored.groupBy(F.col("_metadata.file_path").alias("path")).agg(
        F.min(time).alias("oldest"), F.max(time).alias("newest"), F.count(F.lit(1)).alias("n"), missing
    )
    refused = F.when(F.col("missing") > 0, F.raise_error(F.lit("a row of the history has no time or no id")).cast("bigint")).otherwise(F.col("n"))
    entries.withColumn("n", refused).drop("missing").coalesce(1).write.mode("append").parquet(f"{folder}/index")


def _index(spark: SparkSession, folder: str) -> DataFrame:
    if not path_exists(spark, f"{folder}/index"):
        raise ValueError(f"no history in {folder}")
    return spark.read.parquet(f"{folder}/index")


def history_total(spark: SparkSession, folder: str) -> int:
    """Number of rows, from the index alone."""
    return _index(spark, folder).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def page_files(spark: SparkSession, folder: str, limit: int, after: tuple | None = None) -> list[str]:
    """Files that can hold rows of the page: those from the cursor down to where enough rows are certain."""
    index = _index(spark, folder)
    if after is not None:
        index = index.filter(F.col("oldest") <= F.lit(after[0]))
    whole = index if after is None else index.filter(F.col("newest") < F.lit(after[0]))
    # one short row a file, so the running sum is over a small table
    summed = whole.withColumn("_sum", F.sum("n").over(Window.orderBy(F.desc("oldest"), "path").rowsBetween(Window.unboundedPreceding, 0)))
    floor = summed.filter(F.col("_sum") >= limit).agg(F.max("oldest")).first()[0]
    if floor is not None:
        index = index.filter(F.col("newest") >= F.lit(floor))
    return [r["path"] for r in index.select("path").orderBy("path").collect()]  # the files of one page


def history_after(spark: SparkSession, folder: str, limit: int, after: tuple | None = None, time: str = "created_at", ident: str = "id") -> DataFrame:
    """The next ``limit`` rows behind the cursor ``after`` (time, id), newest first, ties by id; without one the first page."""
    paths = page_files(spark, folder, limit, after)
    rows = spark.read.parquet(*paths) if paths else spark.read.parquet(f"{folder}/rows/*").limit(0)
    if after is not None:
        rows = rows.filter((F.col(time) < F.lit(after[0])) | ((F.col(time) == F.lit(after[0])) & (F.col(ident) < F.lit(after[1]))))
    return rows.orderBy(F.desc(time), F.desc(ident)).limit(limit)
