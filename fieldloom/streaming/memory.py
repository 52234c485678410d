"""Running a bounded stream to its end and reading the result as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from fieldloom.session import shared_dir


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process all available input, write it to the shared folder, read it back."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/fieldloom/stream-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/log")
        .trigger(availableNow=True).start(f"{base}/rows")
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
