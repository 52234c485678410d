"""The same results from streams over the table files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fieldloom import model as m
from fieldloom.session import is_folder, shared_dir
from fieldloom.sources.ingest import content_hash
from fieldloom.streaming import arrivals
from fieldloom.streaming.expiry import expiries
from fieldloom.streaming.memory import run_to_table
from fieldloom.workloads.classification import DETECT_SQL, DETECTED, catalogue
from fieldloom.workloads.registry import query, table


def _stream(spark, folder, name, per_trigger=None):
    """The files of a table, which is one file of the folder or a folder of its own; all at once unless limited.

    The first of equal contents and the order of times are those of the whole table, however many files it has.
    """
    stream = spark.readStream.schema(table(spark, folder, name).schema)
    if per_trigger:
        stream = stream.option("maxFilesPerTrigger", per_trigger)
    if is_folder(spark, f"{folder}/{name}.parquet"):
        return stream.parquet(f"{folder}/{name}.parquet")
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def stream_trigger(spark, folder):
    """All files of a folder taken one per trigger, then counted."""
    rows = run_to_table(_stream(spark, folder, "events", per_trigger=1).select("event_type", "value"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT sha256(text) AS sha256 FROM documents GROUP BY 1")
def stream_dedup(spark, folder):
    """First arrival of each content."""
    stream = _stream(spark, folder, "documents").select("doc_id", "text", F.lit("2024-01-01").cast("timestamp").alias("arrived"))
    return run_to_table(arrivals.drop_repeated(stream, "arrived").select("sha256"))


@query(f"WITH {DETECT_SQL} SELECT {', '.join(DETECTED)} FROM level")
def stream_classify(spark, folder):
    """Stateless classification of the stream."""
    stream = _stream(spark, folder, "documents").select("doc_id", "text")
    return run_to_table(arrivals.classify(stream, catalogue(spark)).select(*DETECTED))


@query(f"""WITH {DETECT_SQL}, first AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY text)
SELECT doc_id, CASE WHEN confidence = 'alta' THEN product_id END AS product_id_prop, confidence, CASE WHEN confidence = 'alta' THEN 'clasificado' ELSE 'pendiente' END AS state
FROM level JOIN first USING (doc_id)""")
def stream_queue(spark, folder):
    """Arrivals through folder de-duplication, history check and classification into the queue."""
    stream = _stream(spark, folder, "documents").select("doc_id", "text", F.lit("2024-01-01").cast("timestamp").alias("arrived"), content_hash("text").alias("sha256"))
    base = f"{shared_dir(spark)}/fieldloom/queue-{uuid.uuid4().hex}"
    arrivals.run_queue(stream, base, catalogue(spark), f"{base}/log").awaitTermination()
    return spark.read.parquet(f"{base}/queue").select("doc_id", "product_id_prop", "confidence", "state")


# a life span is written when the watermark, ten minutes behind the newest activity, has passed its end
@query(f"""WITH a AS (SELECT user_id AS batch_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
n AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL {m.BATCH_TTL_MINUTES} MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY batch_id ORDER BY ts) AS life FROM a),
s AS (SELECT batch_id, min(ts) AS started, max(ts) + INTERVAL {m.BATCH_TTL_MINUTES} MINUTE AS expires, count(*) AS n_activities FROM n GROUP BY batch_id, life)
SELECT batch_id, started, expires, n_activities FROM s WHERE expires <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_ttl(spark, folder):
    """Expired batches of a stream: closed life spans once the watermark has passed them."""
    activity = _stream(spark, folder, "events").select(F.col("user_id").alias("batch_id"), F.col("ts").cast("timestamp").alias("ts"))
    return run_to_table(arrivals.batch_sessions(activity, delay="10 minutes"))


# every fifth activity arrives eight minutes late, some of them after the next slice of time has begun
@query(f"""WITH a AS (SELECT user_id AS batch_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
n AS (SELECT *, sum(CASE WHEN before IS NULL OR ts > before + INTERVAL {m.BATCH_TTL_MINUTES} MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY batch_id ORDER BY ts) AS life FROM a),
s AS (SELECT batch_id, min(ts) AS started, max(ts) AS last_activity, max(ts) + INTERVAL {m.BATCH_TTL_MINUTES} MINUTE AS expired, count(*) AS n_activities FROM n GROUP BY batch_id, life)
SELECT batch_id, started, last_activity, expired, n_activities FROM s WHERE expired < (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_expiry(spark, folder):
    """An event for each expired batch; activities come in slices of ten days, late renewals among them."""
    events = table(spark, folder, "events").select("event_id", F.col("user_id").alias("batch_id"), F.col("ts").cast("timestamp").alias("ts"))
    arrived = F.unix_timestamp("ts") + F.when(F.col("event_id") % 5 == 0, 8 * 60).otherwise(0)
    day = F.floor((arrived - events.agg(F.unix_timestamp(F.min("ts"))).first()[0]) / 86_400)
    base = f"{shared_dir(spark)}/fieldloom/expiry-{uuid.uuid4().hex}"
    for arrival in (day < 10, (day >= 10) & (day < 20), day >= 20):
        events.filter(arrival).select("batch_id", "ts").write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema("batch_id bigint, ts timestamp").parquet(f"{base}/in")
        written = expiries(stream).writeStream.format("parquet").option("checkpointLocation", f"{base}/log")
        written.trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    return spark.read.parquet(f"{base}/out")


def _states(batch, catalogue):
    """A light classification: by the length of the text."""
    state = F.when(F.length("text") > 500, m.CLASSIFIED).otherwise(m.PENDING)
    return batch.select("doc_id", "sha256", "arrived", state.alias("state"), F.lit(None).cast("string").alias("error"))


def _queue_of(spark, arrivals_in_order, classified):
    """Queue after the given tables have arrived one after the other."""
    base = f"{shared_dir(spark)}/fieldloom/queue-{uuid.uuid4().hex}"
    for rows in arrivals_in_order:
        rows.write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        arrivals.run_queue(stream, base, catalogue(spark), f"{base}/log", classified=classified).awaitTermination()
    return base


def _arrived(spark, folder):
    day = F.lit("2024-01-01").cast("timestamp")
    return table(spark, folder, "documents").select("doc_id", "text", day.alias("arrived"), content_hash("text").alias("sha256"))


@query("""WITH first AS (SELECT coalesce(min(doc_id) FILTER (doc_id % 2 = 0), min(doc_id)) AS doc_id FROM documents GROUP BY text)
SELECT doc_id, CASE WHEN length(text) > 500 THEN 'clasificado' ELSE 'pendiente' END AS state FROM documents JOIN first USING (doc_id)""")
def stream_history(spark, folder):
    """Even documents arrive first, odd ones later, all of them again at last: a known content is not queued twice."""
    docs = _arrived(spark, folder)
    base = _queue_of(spark, [docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 <> 0"), docs], _states)
    return spark.read.parquet(f"{base}/queue").select("doc_id", "state")


@query("""WITH first AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY text), odd AS (SELECT min(doc_id) AS doc_id FROM first)
SELECT doc_id, CASE WHEN doc_id = (SELECT doc_id FROM odd) THEN 'error' WHEN length(text) > 500 THEN 'clasificado' ELSE 'pendiente' END AS state,
  doc_id = (SELECT doc_id FROM odd) AS failed FROM documents JOIN first USING (doc_id)""")
def stream_failing_row(spark, folder):
    """The first document makes the classification fail: it alone is an error row, all others are queued."""
    docs = _arrived(spark, folder)
    first = docs.agg(F.min("doc_id")).first()[0]

    def classified(batch, catalogue):
        refused = F.raise_error(F.lit("cannot be read")).cast("string")
        return _states(batch.withColumn("text", F.when(F.col("doc_id") == first, refused).otherwise(F.col("text"))), catalogue)

    base = _queue_of(spark, [docs], classified)
    queue = spark.read.parquet(f"{base}/queue")
    return queue.select("doc_id", "state", F.coalesce(F.contains("error", F.lit("cannot be read")), F.lit(False)).alias("failed"))
