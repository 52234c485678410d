"""Stored documents, labels, files."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.operators import coverage as cov
from fieldloom.operators import upkeep
from fieldloom.sources import ingest
from fieldloom.workloads.policies import policies
from fieldloom.workloads.registry import documents, query, table

_FILES = "SELECT doc_id, sha256(text) AS sha, n_chars, (doc_id * 7919) % 100003 AS mtime FROM documents"


def _files(spark, folder):
    return documents(spark, folder).select(
        "doc_id", ingest.content_hash("text").alias("sha256"), "n_chars", ((F.col("doc_id") * 7919) % 100003).alias("mtime")
    )


@query(f"""WITH f AS ({_FILES}) SELECT sha AS sha256, arg_min(doc_id, (mtime, doc_id)) AS doc_id, min(mtime) AS mtime, count(*) AS copies FROM f GROUP BY sha""")
def dedup_keep_oldest(spark, folder):
    """The oldest document of each content."""
    return upkeep.keep_oldest(_files(spark, folder), ident="doc_id")


@query(f"""WITH f AS ({_FILES}) SELECT doc_id, sha AS sha256, n_chars FROM f QUALIFY row_number() OVER (PARTITION BY sha ORDER BY mtime, doc_id) > 1""")
def duplicate_files(spark, folder):
    """All documents but the oldest of each content."""
    return upkeep.duplicates(_files(spark, folder), ident="doc_id").select("doc_id", "sha256", "n_chars")


@query("""SELECT user_id, event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events WHERE event_type <> 'error'
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_per_name(spark, folder):
    """Newest event of each user among those that are still there."""
    events = table(spark, folder, "events").withColumn("file_present", F.col("event_type") != "error")
    latest = upkeep.latest_per_name(events, "user_id", "ts", "event_id")
    return latest.select("user_id", "event_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


_NOW = "2024-01-10 00:00:00"


@query(f"""WITH e AS (SELECT event_id, CASE WHEN event_id % 50 = 7 THEN NULL ELSE ts END AS ts FROM events),
r AS (SELECT *, coalesce(ts < TIMESTAMP '{_NOW}' - INTERVAL 7 DAY, false) AS aged FROM e)
SELECT event_id, 'age' AS reason FROM r WHERE aged UNION ALL
SELECT event_id, 'cap' FROM (SELECT * FROM r WHERE NOT aged QUALIFY row_number() OVER (ORDER BY ts DESC NULLS LAST, event_id DESC) > 500)""")
def retention_plan(spark, folder):
    """Too old, then beyond the newest 500; unreadable dates only count for the cap."""
    events = table(spark, folder, "events").select("event_id", F.when(F.col("event_id") % 50 != 7, F.col("ts")).alias("ts"))
    return upkeep.retention_plan(events, F.lit(_NOW).cast("timestamp_ntz"), time="ts", ident="event_id")


@query("""SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) FILTER (text <> '') AS text, count(*) AS pages FROM
  (SELECT conv_id, turn, CASE WHEN turn = 1 THEN '' ELSE text END AS text FROM conversations) GROUP BY conv_id""")
def assemble_text(spark, folder):
    """Turns of a conversation as pages of a text, empty ones dropped."""
    pages = table(spark, folder, "conversations").withColumn("text", F.when(F.col("turn") == 1, "").otherwise(F.col("text")))
    return ingest.assemble_text(pages, "conv_id", "turn")


@query("""SELECT conv_id, trim(string_agg(text, chr(10) ORDER BY turn), ' ' || chr(10)) AS text, count(*) AS pages FROM
  (SELECT conv_id, turn, CASE WHEN turn = 1 THEN '' ELSE text END AS text FROM conversations) GROUP BY conv_id""")
def assemble_text_keep_empty(spark, folder):
    """The same with empty pages kept and the whole text trimmed."""
    pages = table(spark, folder, "conversations").withColumn("text", F.when(F.col("turn") == 1, "").otherwise(F.col("text")))
    return ingest.assemble_text(pages, "conv_id", "turn", keep_empty=True)


@query("""SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, sha256(html) AS sha256, len(regexp_extract_all(html, '<li>')) AS n_items FROM pages""")
def page_blocks(spark, folder):
    """Block between anchors, hash and all matches on web pages."""
    from fieldloom.functions.regex import find_all
    from fieldloom.functions.text import block_between

    html = F.col("html")
    return table(spark, folder, "pages").select(
        "page_id", F.coalesce(block_between(html, "<title>", "</title>"), F.lit("")).alias("title"), ingest.content_hash("html").alias("sha256"),
        F.size(find_all(html, "<li>", flags="")).cast("bigint").alias("n_items"),
    )


@query("""SELECT c_custkey AS doc_id, c_name FROM customer WHERE NOT EXISTS (FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""")
def purge_unused(spark, folder):
    """Customers no finished order refers to."""
    docs = table(spark, folder, "customer").select(F.col("c_custkey").alias("doc_id"), "c_name")
    refs = table(spark, folder, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("doc_id"))
    return upkeep.unused(docs, refs)


@query("""WITH used AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F')
SELECT (SELECT count(*) FROM customer WHERE c_custkey IN (FROM used)) AS documents, (SELECT count(*) FROM orders WHERE o_custkey IN (FROM used)) AS labels""")
def purge_snapshots(spark, folder):
    """Sizes of the snapshots left after the purge."""
    docs = table(spark, folder, "customer").select(F.col("c_custkey").alias("doc_id"))
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderstatus")
    left, labels = upkeep.purge(docs, orders, orders.filter("o_orderstatus = 'F'"))
    sizes = left.select(F.lit(1).alias("d"), F.lit(0).alias("l")).unionByName(labels.select(F.lit(0).alias("d"), F.lit(1).alias("l")))
    return sizes.agg(F.sum("d").alias("documents"), F.sum("l").alias("labels"))


@query("""WITH l AS (SELECT doc_id, 'quality' AS field, CAST(quality AS VARCHAR) AS value FROM labels UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS VARCHAR) FROM labels WHERE toxic = 1)
SELECT d.doc_id, count(l.doc_id) AS n_labels, max(value) FILTER (field = 'quality') AS quality, max(value) FILTER (field = 'toxic') AS toxic
FROM documents d LEFT JOIN l USING (doc_id) GROUP BY d.doc_id""")
def labels_matrix(spark, folder):
    """Labels of each document as a map, and their number, zero included."""
    raw = table(spark, folder, "labels")
    long_labels = raw.select("doc_id", F.lit("quality").alias("field"), F.col("quality").cast("string").alias("value")).unionByName(
        raw.filter("toxic = 1").select("doc_id", F.lit("toxic").alias("field"), F.col("toxic").cast("string").alias("value"))
    )
    docs = table(spark, folder, "documents").select("doc_id")
    counts = upkeep.labels_per_document(docs, long_labels)
    wide = upkeep.label_matrix(long_labels).select("doc_id", F.col("labels")["quality"].alias("quality"), F.col("labels")["toxic"].alias("toxic"))
    return counts.join(wide, "doc_id", "left")


@query("""SELECT source, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY source""")
def labelled_documents(spark, folder):
    """Documents with at least one label (semi join)."""
    docs = table(spark, folder, "documents").select("doc_id", "source")
    return docs.join(table(spark, folder, "labels").select("doc_id"), "doc_id", "left_semi").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH cur AS (SELECT doc_id, 'quality' AS field, CAST(quality AS VARCHAR) AS value, NULL AS context, 0 AS at FROM labels),
new AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'quality' ELSE 'opening' END AS field, substr(text, 3, 12) AS value,
  substr(text, 1, CAST(least(length(text), instr(lower(text), lower(substr(text, 3, 12))) + 11 + 350) AS INT)) AS context, doc_id AS at FROM documents)
SELECT doc_id, field, value, context FROM new UNION ALL SELECT doc_id, field, value, context FROM cur c WHERE NOT EXISTS (FROM new n WHERE n.doc_id = c.doc_id AND n.field = c.field)""")
def label_upsert(spark, folder):
    """New labels replace old ones of the same document and field; context cut from the text."""
    current = table(spark, folder, "labels").select(
        "doc_id", F.lit("quality").alias("field"), F.col("quality").cast("string").alias("value"), F.lit(None).cast("string").alias("context"), F.lit(0).cast("bigint").alias("created_at")
    )
    changes = documents(spark, folder).select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, "quality").otherwise("opening").alias("field"), F.substring("text", 3, 12).alias("value"),
        F.lit(None).cast("string").alias("context"), F.col("doc_id").alias("created_at"), "text",
    )
    return upkeep.upsert_labels(current, changes).select("doc_id", "field", "value", "context")


@query("""SELECT o_orderkey AS doc_id, 'estado' AS field, o_orderstatus AS value, true AS is_auto FROM orders WHERE o_orderstatus <> 'P'""")
def automatic_labels(spark, folder):
    """Label rows from extracted values that are not empty."""
    found = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.lit("estado").alias("field"), F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus")).alias("value"),
        F.lit("regla").alias("method"),
    )
    return upkeep.automatic_labels(found).drop("method")


@query("""SELECT o_orderkey, c_custkey IS NOT NULL AS file_present FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey""")
def file_presence(spark, folder):
    """Which documents still have their file in a fresh listing?"""
    docs = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("path"))
    listing = table(spark, folder, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("path"))
    return ingest.with_file_present(docs, listing).select("o_orderkey", "file_present")


@query()
def scan_files_batch(spark, folder):
    """Binary scan of the table files themselves: name, size, hash."""
    return ingest.scan_folder(spark, folder, "*.parquet").select("name", "size", "sha256")


@query("""SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY o_orderstatus""")
def empty_documents(spark, folder):
    """Documents without text go to the quarantine."""
    docs = policies(spark, folder).withColumn("text", F.when(F.col("status") != "P", F.col("text")).otherwise(F.lit(" \n")))
    return ingest.without_text(docs).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')""")
def orphan_labels(spark, folder):
    """Labels whose document is gone."""
    docs = table(spark, folder, "documents").filter("lang = 'en'")
    return cov.orphans(table(spark, folder, "labels"), docs, "doc_id", "doc_id").select("doc_id")
