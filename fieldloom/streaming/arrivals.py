"""Arriving documents: source, de-duplication, classification, batch expiry.

Exactly once per path comes from the file source's own log, content
de-duplication from watermarked state plus an anti-join with the stored queue.
A writer should move finished files into the watched folder by rename.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from fieldloom import model as m
from fieldloom.operators.bounds import fits
from fieldloom.operators.detect import detect
from fieldloom.operators.upkeep import duplicates
from fieldloom.session import materialize, path_exists
from fieldloom.sources.ingest import PDF_GLOB, content_hash, describe_files

BINARY_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def watch_files(spark: SparkSession, folder: str, glob: str = PDF_GLOB, per_trigger: int = 1_000) -> DataFrame:
    """New files of a folder (not its sub-folders): path, name, mtime, size, sha256, content."""
    stream = (
        spark.readStream.format("binaryFile").schema(BINARY_SCHEMA)
        .option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger).load(folder)
    )
    return describe_files(stream)


def watch_table(spark: SparkSession, folder: str, schema, per_trigger: int = 1_000) -> DataFrame:
    """New parquet files with document texts."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def drop_repeated(stream: DataFrame, time: str, delay: str | None = "1 hour", text: str = "text") -> DataFrame:
    """First arrival of each content within the delay; state is bounded by the watermark.

    Without a delay the state keeps every hash ever seen (use the RocksDB state
    store): each trigger then costs as much as its own rows, however long the history.
    """
    hashed = stream.withColumn("sha256", content_hash(text))
    if delay is None:
        return hashed.dropDuplicates(["sha256"])
    return hashed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["sha256"])


def classify(stream: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Stateless classification of each arrival."""
    return detect(stream, catalogue)


def fresh_only(batch: DataFrame, stored: DataFrame, key: str = "sha256") -> DataFrame:
    """Rows whose content is not stored yet.

    The few hashes of the batch are sent to the stored table, not the other way
    round, so the history is scanned in one column and never shuffled.
    """
    hashes = batch.select(key).distinct()
    known = stored.select(key).join(F.broadcast(hashes) if fits(hashes) else hashes, key, "left_semi").distinct()
    return batch.join(known, key, "left_anti")


def queue_rows(batch: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Queue rows of a batch; a document without text gets the state of an error.

    Documents the detector is not sure about wait for a model answer.
    """
    found = detect(batch, catalogue)
    sure = (F.col("confidence") == m.HIGH) & F.col("product_id").isNotNull()
    blank = F.coalesce(F.length(F.trim("text")), F.lit(0)) == 0
    return found.select(
        "doc_id", "sha256", "arrived",
        *[F.when(sure, F.col(c)).alias(f"{c}_prop") for c in ("company_id", "line_id", "product_id")],
        "confidence",
        F.when(sure, F.lit("detector")).alias("method"),
        F.when(blank, m.FAILED).when(sure, m.CLASSIFIED).otherwise(m.PENDING).alias("state"),
        F.when(blank, F.lit("no extractable text")).alias("error"),
    )


def failing_rows(rows: DataFrame, probe: Callable[[DataFrame], None], key: str = "doc_id", most: int = 100) -> list[tuple]:
    """(key, first line of the error) of the rows that ``probe`` fails on.

    A failing part is halved by a digest of the key until one key is left, so k failing
    rows of n take about k log n probes, each on its part only.  An error that strikes
    more than ``most`` rows is no fault of theirs and is raised.
    """
    bad: list[tuple] = []
    parts = [(0, 0)]
    while parts:
        depth, rest = parts.pop()
        part = rows.filter(F.pmod(F.xxhash64(key), F.lit(2**depth)) == rest)
        try:
            probe(part)
        except (AnalysisException, ParseException):
            raise  # a wrong plan, not a wrong row
        except Exception as error:
            if depth == 62 or part.select(key).distinct().limit(2).count() <= 1:
                bad += [(r[0], _first_line(error)) for r in part.select(key).distinct().collect()]
                if len(bad) > most:
                    raise
            else:
                parts += [(depth + 1, rest), (depth + 1, rest + 2**depth)]
    return bad


def _first_line(error: Exception) -> str:
    """What the failing row said, without the lines of the engine around it."""
    lines = [x.strip() for x in str(getattr(error, "desc", None) or error).splitlines()]
    return next((x for x in lines if x), type(error).__name__)


def without_failing(rows: DataFrame, classified: Callable[[DataFrame], DataFrame], key: str = "doc_id") -> DataFrame:
    """Queue rows of a batch that could not be classified as a whole; failing rows get the state of an error."""
    held = materialize(rows)
    nothing = lambda part: classified(part).write.format("noop").mode("overwrite").save()
    bad = failing_rows(held, nothing, key)
    errors = held.sparkSession.createDataFrame(bad, StructType([held.schema[key], StructField("error", StringType())]))
    marked = held.join(F.broadcast(errors), held[key].eqNullSafe(errors[key]), "left").drop(errors[key])
    states = marked.filter(F.col("error").isNotNull()).select("doc_id", "sha256", "arrived", F.lit(m.FAILED).alias("state"), "error")
    return classified(marked.filter(F.col("error").isNull()).drop("error")).unionByName(states, allowMissingColumns=True)


def queue_writer(folder: str, catalogue: DataFrame, classified: Callable[[DataFrame, DataFrame], DataFrame] = queue_rows) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: folder de-duplication, history check, classification, write.

    Each batch owns the partition ``batch=<id>``; a repeated batch overwrites it.
    Files that repeat a content are listed under ``to_delete``, never deleted.  A row that
    makes the classification fail is stored with the error, the others of its batch as usual.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch if "sha256" in batch.columns else batch.withColumn("sha256", content_hash("text"))
        # only ids and hashes are compared, the texts stay where they are
        doubles = duplicates(rows.select("doc_id", "sha256", "arrived"), "sha256", "arrived", "doc_id")
        first = rows.join(doubles.select("doc_id"), "doc_id", "left_anti")
        doubles.select("doc_id", "sha256").write.mode("overwrite").parquet(f"{folder}/to_delete/batch={batch_id}")
        if path_exists(spark, f"{folder}/queue"):
            stored = spark.read.parquet(f"{folder}/queue").filter(F.col("batch") != batch_id)
            first = fresh_only(first, stored)
        target = f"{folder}/queue/batch={batch_id}"
        place = lambda part: classified(part, catalogue)
        try:
            place(first).write.mode("overwrite").parquet(target)
        except (AnalysisException, ParseException):
            raise
        except Exception:
            without_failing(first, place).write.mode("overwrite").parquet(target)

    return write


def run_queue(stream: DataFrame, folder: str, catalogue: DataFrame, checkpoint: str, every: str | None = None,
              classified: Callable[[DataFrame, DataFrame], DataFrame] = queue_rows) -> StreamingQuery:
    """Start the queue stream; without ``every`` it handles what is there and stops."""
    writer = stream.writeStream.foreachBatch(queue_writer(folder, catalogue, classified)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


# ---- batches with an expiry ----------------------------------------------------------

def batch_sessions(activity: DataFrame, batch: str = "batch_id", time: str = "ts", ttl_minutes: int = m.BATCH_TTL_MINUTES,
                   delay: str | None = None) -> DataFrame:
    """Life spans of batches: each activity renews, silence beyond the limit ends it.

    Works on a stream (give ``delay`` for the watermark) and on a table.
    """
    source = activity.withWatermark(time, delay) if delay else activity
    window = F.session_window(time, f"{ttl_minutes} minutes")
    return source.groupBy(batch, window).agg(F.count(F.lit(1)).alias("n_activities")).select(
        batch, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("expires"), "n_activities"
    )


def live_batches(activity: DataFrame, now, batch: str = "batch_id", time: str = "ts", ttl_minutes: int = m.BATCH_TTL_MINUTES) -> DataFrame:
    """Batches whose last activity is at most the limit ago."""
    last = activity.groupBy(batch).agg(F.max(time).alias("last_activity"), F.count(F.lit(1)).alias("n_activities"))
    return last.filter(F.col("last_activity") >= now - F.make_interval(mins=F.lit(ttl_minutes)))
