"""Classification queue, history pages, batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom import model as m
from fieldloom.operators import coverage as cov
from fieldloom.operators import fields as fl
from fieldloom.operators import upkeep
from fieldloom.plans.recipes import run_extractor
from fieldloom.session import shared_dir
from fieldloom.sources import history, snapshots
from fieldloom.streaming.arrivals import batch_sessions, live_batches
from fieldloom.workloads.catalogues import CATALOGUE, nation_catalogue
from fieldloom.workloads.classification import DETECT_SQL, catalogue, detected
from fieldloom.workloads.policies import WITH_POLICY, policies
from fieldloom.workloads.registry import query, table


def event_queue(spark: SparkSession, folder: str) -> DataFrame:
    """Events as queue rows."""
    e, v = F.col("event_type"), F.col("value")
    state = (
        F.when(e == "view", m.CLASSIFIED).when(e == "click", m.NEEDS_PERSON).when(e == "error", m.FAILED).when(e == "purchase", m.SENT).otherwise(m.CLASSIFIED)
    )
    confidence = F.when(v > 20, m.HIGH).when(v > 5, m.MEDIUM).when(v > 1, m.LOW)
    return table(spark, folder, "events").select(
        F.col("event_id").alias("doc_id"), F.concat(F.lit("f"), "user_id", F.lit(".pdf")).alias("name"), F.sha2(F.col("event_id").cast("string"), 256).alias("sha256"),
        state.alias("state"), confidence.alias("confidence"), (F.col("user_id") % 6).alias("company_id_prop"), (F.col("user_id") % 30).alias("line_id_prop"),
        F.when(F.col("user_id") % 7 != 0, F.col("user_id")).alias("product_id_prop"),
    )


QUEUE = """q AS (SELECT event_id AS doc_id, 'f' || user_id || '.pdf' AS name, sha256(CAST(event_id AS VARCHAR)) AS sha,
  CASE event_type WHEN 'click' THEN 'requiere_manual' WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'enviado' ELSE 'clasificado' END AS state,
  CASE WHEN value > 20 THEN 'alta' WHEN value > 5 THEN 'media' WHEN value > 1 THEN 'baja' END AS confidence, user_id % 6 AS company_id_prop, user_id % 30 AS line_id_prop,
  CASE WHEN user_id % 7 <> 0 THEN user_id END AS product_id_prop FROM events)"""


@query(f"""WITH {QUEUE} SELECT count(*) AS total, count(*) FILTER (state = 'clasificado' AND confidence = 'alta') AS high,
  count(*) FILTER (state IN ('requiere_manual', 'clasificado') AND coalesce(confidence, '') <> 'alta') AS review, count(*) FILTER (state = 'enviado') AS sent,
  count(*) FILTER (state = 'error') AS failed, count(*) FILTER (state = 'clasificado' AND confidence = 'alta') AS batch_ready FROM q""")
def queue_state_counts(spark, folder):
    return cov.queue_counters(event_queue(spark, folder))


@query(f"""WITH {QUEUE}, {CATALOGUE}, f AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN 2 ELSE company_id_prop END AS company_id_final,
  line_id_prop AS line_id_final, CASE WHEN doc_id % 5 = 0 THEN 9 ELSE product_id_prop END AS product_id_final FROM q)
SELECT doc_id, a.name AS company_prop, b.name AS line_prop, c.name AS product_prop, d.name AS company_final, e.name AS product_final,
  CASE WHEN product_id_final IS NULL THEN 'product required' END AS refused
FROM f LEFT JOIN cat a ON a.level = 'company' AND a.id = company_id_prop LEFT JOIN cat b ON b.level = 'line' AND b.id = line_id_prop
LEFT JOIN cat c ON c.level = 'product' AND c.id = product_id_prop LEFT JOIN cat d ON d.level = 'company' AND d.id = company_id_final
LEFT JOIN cat e ON e.level = 'product' AND e.id = product_id_final""")
def queue_enrich(spark, folder):
    """Final ids with overrides, and the names of both sets of ids."""
    queue = event_queue(spark, folder)
    overrides = queue.filter(F.col("doc_id") % 5 == 0).select(
        "doc_id", F.lit(2).cast("bigint").alias("company_id"), F.lit(None).cast("bigint").alias("line_id"), F.lit(9).cast("bigint").alias("product_id")
    )
    named = upkeep.with_level_names(upkeep.final_ids(queue, overrides), nation_catalogue(spark, folder), ["_prop", "_final"])
    return named.select("doc_id", "company_prop", "line_prop", "product_prop", "company_final", "product_final", "refused")


_READY = "state = 'clasificado' AND confidence = 'alta' AND product_id_prop IS NOT NULL"


@query(f"""WITH {QUEUE} SELECT CASE WHEN {_READY} THEN 'enviado' ELSE state END AS state, count(*) AS n, count(*) FILTER ({_READY}) AS with_final FROM q GROUP BY 1""")
def queue_confirm(spark, folder):
    """Queue after confirming all sure rows at once."""
    snapshot, _ = upkeep.confirm_batch(_with_final(event_queue(spark, folder)), _taken(spark, folder))
    return snapshot.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.count("product_id_final").alias("with_final"))


def _with_final(queue: DataFrame) -> DataFrame:
    return queue.withColumns({f"{c}_final": F.lit(None).cast("bigint") for c in ("company_id", "line_id", "product_id")})


def _taken(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select(F.col("s_suppkey").alias("product_id"), F.concat(F.lit("f"), "s_suppkey", F.lit(".pdf")).alias("name"))


@query(f"""WITH {QUEUE} SELECT doc_id, product_id_prop AS product_id, CASE WHEN product_id_prop IN (SELECT s_suppkey FROM supplier)
  THEN replace(name, '.pdf', '_' || left(sha, 6) || '.pdf') ELSE name END AS name FROM q WHERE {_READY}""")
def training_rows(spark, folder):
    """Training rows of the confirmed documents, names made unique."""
    _, training = upkeep.confirm_batch(_with_final(event_queue(spark, folder)), _taken(spark, folder))
    return training.select("doc_id", "product_id", "name")


_ANSWERS = """ans AS (SELECT doc_id, n_chars % 5 AS company_id, n_chars % 7 AS line_id, n_chars % 9 AS product_id, (n_chars % 100) / 100.0 AS conf, n_chars % 11 = 0 AS is_new
  FROM documents WHERE doc_id % 10 <> 3)"""


@query(f"""WITH {DETECT_SQL}, {_ANSWERS}
SELECT l.doc_id, CASE WHEN confidence = 'alta' THEN l.company_id WHEN a.company_id BETWEEN 1 AND 4 THEN a.company_id END AS company_id_prop,
  CASE WHEN confidence = 'alta' THEN l.product_id WHEN a.product_id BETWEEN 1 AND 6 THEN a.product_id END AS product_id_prop,
  CASE WHEN confidence = 'alta' THEN 'alta' WHEN conf >= 0.85 THEN 'alta' WHEN conf >= 0.6 THEN 'media' WHEN conf > 0 THEN 'baja' WHEN conf IS NOT NULL THEN 'sin_datos' END AS confidence,
  CASE WHEN confidence = 'alta' THEN 'detector' WHEN conf IS NOT NULL THEN 'ia' END AS method,
  CASE WHEN confidence = 'alta' THEN 'clasificado' WHEN is_new THEN 'requiere_manual' WHEN conf IS NOT NULL THEN 'clasificado' ELSE 'error' END AS state
FROM level l LEFT JOIN ans a USING (doc_id)""")
def model_fallback(spark, folder):
    """Proposal from the detector when sure, else from a stored model answer with known ids."""
    n = F.col("n_chars")
    answers = table(spark, folder, "documents").filter("doc_id % 10 <> 3").select(
        "doc_id", (n % 5).alias("company_id"), (n % 7).alias("line_id"), (n % 9).alias("product_id"), ((n % 100) / 100).alias("confidence"),
        F.lit("r").alias("reason"), (n % 11 == 0).alias("is_new"),
    )
    active = catalogue(spark).filter("active")
    proposed = upkeep.propose(detected(spark, folder).drop("text"), upkeep.known_ids(answers, active))
    return proposed.select("doc_id", "company_id_prop", "product_id_prop", "confidence", "method", "state")


@query("""WITH r AS (SELECT o_orderkey AS doc_id, 'estado' AS field, CASE WHEN o_orderstatus = 'F' THEN 'F' END AS value, 'regla' AS method, 1 AS k FROM orders
  UNION ALL SELECT o_orderkey, 'estado', 'M' || o_orderstatus, 'ia', 2 FROM orders WHERE o_orderpriority <> '5-LOW' UNION ALL SELECT o_orderkey, 'estado', 'X', 'extractor_dedicado', 0 FROM orders WHERE o_totalprice > 400000)
SELECT doc_id, field, arg_min(value, CASE WHEN value IS NULL THEN 9 ELSE k END) AS value, arg_min(method, CASE WHEN value IS NULL THEN 9 ELSE k END) AS method FROM
  (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN value IS NULL THEN 9 ELSE k END) AS rn FROM r) WHERE rn = 1 GROUP BY ALL""")
def source_overlay(spark, folder):
    """Dedicated, rule and model values of a field: the best source wins."""
    orders = table(spark, folder, "orders")
    none = F.lit(None).cast("bigint")
    row = lambda df, value, method: df.select(F.col("o_orderkey").alias("doc_id"), F.lit("estado").alias("field"), value.alias("value"), F.lit(method).alias("method"), none.alias("rule_id"))
    rules = row(orders, F.when(F.col("o_orderstatus") == "F", "F"), m.METHOD_RULE)
    model = row(orders.filter("o_orderpriority <> '5-LOW'"), F.concat(F.lit("M"), "o_orderstatus"), m.METHOD_MODEL)
    recipe = row(orders.filter("o_totalprice > 400000"), F.lit("X"), m.METHOD_RECIPE)
    return fl.resolve_sources(rules.unionByName(model).unionByName(recipe)).drop("rule_id")


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, c_name, n_name, (SELECT count(*) FROM orders) AS total FROM
  (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 100) JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def history_page(spark, folder):
    """Third page of the history with names and the total number of rows."""
    orders = table(spark, folder, "orders")
    page = upkeep.history_page(orders.select("o_orderkey", "o_orderdate", "o_custkey"), 100, 50, "o_orderdate", "o_orderkey")
    # the page has 50 rows by construction, so it is the side that is copied
    customers = table(spark, folder, "customer").join(F.broadcast(page), F.col("c_custkey") == F.col("o_custkey"))
    named = customers.join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    total = orders.agg(F.count(F.lit(1)).alias("total"))
    return named.join(F.broadcast(total)).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "c_name", "n_name", "total")


@query("""WITH b AS (SELECT strftime(ts, '%Y-%m-%d') AS batch_id, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT batch_id, CAST(sum(n) AS BIGINT) AS results, CAST(sum(n) FILTER (event_type = 'error') AS BIGINT) AS errors FROM b WHERE batch_id NOT IN
  (SELECT strftime(ts, '%Y-%m-%d') FROM events WHERE value > 330) GROUP BY batch_id""")
def batch_totals(spark, folder):
    """Results of each batch, unpacked from its list, batches of another list left out."""
    events = table(spark, folder, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("batch_id"), "event_type", "value")
    # a batch holds one entry per kind of result: pre-aggregated before it becomes a list
    counts = events.groupBy("batch_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    batches = counts.groupBy("batch_id").agg(F.collect_list(F.struct("event_type", "n")).alias("results"))
    kept = batches.join(events.filter("value > 330").select("batch_id").distinct(), "batch_id", "left_anti")
    flat = kept.select("batch_id", F.inline("results"))
    return flat.groupBy("batch_id").agg(F.sum("n").alias("results"), F.sum(F.when(F.col("event_type") == "error", F.col("n"))).alias("errors"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 25 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id AS batch_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts) + INTERVAL 25 MINUTE, '%Y-%m-%d %H:%M:%S') AS expires, count(*) AS n_activities FROM s GROUP BY user_id, k""")
def batch_expiry(spark, folder):
    """Life spans of batches: 25 minutes after the last activity."""
    activity = table(spark, folder, "events").select(F.col("user_id").alias("batch_id"), F.col("ts").cast("timestamp").alias("ts"))
    spans = batch_sessions(activity)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return spans.select("batch_id", stamp("started"), stamp("expires"), "n_activities")


@query("""SELECT user_id AS batch_id, count(*) AS n_activities FROM events GROUP BY user_id HAVING max(ts) >= TIMESTAMP '2024-01-30 20:00:00' - INTERVAL 25 MINUTE""")
def live_batches_now(spark, folder):
    """Batches that are still alive at one moment."""
    activity = table(spark, folder, "events").select(F.col("user_id").alias("batch_id"), "ts")
    return live_batches(activity, F.lit("2024-01-30 20:00:00").cast("timestamp_ntz")).drop("last_activity")


_KEPT = "NOT (o_orderpriority = '5-LOW' AND o_orderstatus = 'F')"


@query(f"""SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'P' THEN 'X' ELSE o_orderstatus END AS status FROM orders WHERE {_KEPT}
UNION ALL SELECT -o_orderkey, NULL, 'N' FROM orders WHERE o_orderstatus = 'P'""")
def snapshot_merge(spark, folder):
    """A keyed table after rows were changed, added and removed, the change applied twice."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"), "o_orderpriority")
    base = f"{shared_dir(spark)}/fieldloom/snapshot-{uuid.uuid4().hex}"
    snapshots.create(orders.drop("o_orderpriority"), base, ["o_orderkey"], buckets=16)
    partial = orders.filter("status = 'P'")
    changed = partial.select("o_orderkey", "o_custkey", F.lit("X").alias("status"))
    added = partial.select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit(None).cast("bigint").alias("o_custkey"), F.lit("N").alias("status"))
    removed = orders.filter("o_orderpriority = '5-LOW' AND status = 'F'")
    for _ in range(2):
        snapshots.merge(spark, base, changed.unionByName(added), removed)
    return snapshots.read(spark, base)


@query(f"""{WITH_POLICY}, e AS (SELECT min(doc_id) AS lo, max(doc_id) AS hi FROM policy)
SELECT doc_id, CASE WHEN doc_id NOT IN (lo, hi) AND doc_id % 50 <> 7 THEN 'documento' END AS field,
  CASE WHEN doc_id NOT IN (lo, hi) AND doc_id % 50 <> 7 THEN CAST(doc_id AS VARCHAR) END AS value,
  CASE WHEN doc_id = lo THEN 'no answer within 3 seconds' WHEN doc_id = hi THEN 'the extractor ended without an answer'
    WHEN doc_id % 50 = 7 THEN 'refused ' || doc_id END AS error FROM policy, e""")
def watched_extractor(spark, folder):
    """A Python extractor that answers, raises, hangs on the first document and crashes on the last."""
    docs = policies(spark, folder)
    first, last = docs.agg(F.min("doc_id"), F.max("doc_id")).first()

    def extractor(body):
        import os
        import time

        number = int(body.split("\n", 1)[0].split()[1])
        if number == first:
            time.sleep(600)
        if number == last:
            os._exit(1)
        if number % 50 == 7:
            raise ValueError(f"refused {number}")
        return {"documento": number, "empty": ""}

    return run_extractor(docs, extractor, seconds=3)


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_custkey, (SELECT count(*) FROM orders) AS total
FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 100)""")
def history_cursor(spark, folder):
    """Third page of the history, each page from the cursor of the one before; the total comes from the index."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    base = f"{shared_dir(spark)}/fieldloom/history-{uuid.uuid4().hex}"
    history.append_history(orders, base, "o_orderdate", "o_orderkey")
    cursor = None
    for _ in range(2):
        last = history.history_after(spark, base, 50, cursor, "o_orderdate", "o_orderkey").tail(1)[0]  # a page has 50 rows
        cursor = last["o_orderdate"], last["o_orderkey"]
    page = history.history_after(spark, base, 50, cursor, "o_orderdate", "o_orderkey")
    total = F.lit(history.history_total(spark, base)).cast("bigint").alias("total")
    return page.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_custkey", total)
