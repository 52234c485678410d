"""Classification of the document texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom import model as m
from fieldloom.operators import coverage as cov
from fieldloom.operators import detect as det
from fieldloom.operators import trainer
from fieldloom.sources import ingest
from fieldloom.workloads.registry import documents, query, table

# (level, id, parent, name, alias, keywords, patterns, active, priority)
ENTRIES = [
    (m.COMPANY, 1, None, "Alfa", "ALFA SA", ["the ", "and "], [r"\sth[a-z]+"], True, 1),
    (m.COMPANY, 2, None, "Beta", None, ["der ", "und"], ["sch[a-z]"], True, 2),
    (m.COMPANY, 3, None, "Gama", "", ["que ", "le "], [], True, None),
    (m.COMPANY, 4, None, "Delta", "DELTA", ["el ", "los "], ["ci[oa]n"], True, 3),
    (m.COMPANY, 5, None, "Off", None, ["e"], ["e"], False, 1),
    (m.LINE, 1, 1, "Autos", None, ["er", "on"], [r"her[a-z]"], True, None),
    (m.LINE, 2, 1, "Vida", None, ["tion", "is "], [], True, None),
    (m.LINE, 3, 2, "Autos", "COCHES", ["ein", "ver"], ["ung"], True, None),
    (m.LINE, 4, 3, "Vida", None, ["eau", "oi"], ["ment"], True, None),
    (m.LINE, 5, 4, "Autos", None, ["de ", "en"], [], True, None),
    (m.PRODUCT, 1, 1, "Particular", None, ["in", "en"], ["re[a-z]er"], True, 2),
    (m.PRODUCT, 2, 1, "Flotilla", None, ["that", "wh"], [], True, 1),
    (m.PRODUCT, 3, 2, "Individual", None, ["ti"], ["tion"], True, None),
    (m.PRODUCT, 4, 3, "Particular", None, ["zu", "mit"], ["keit"], True, 1),
    (m.PRODUCT, 5, 4, "Grupo", None, ["vi", "ai"], ["eaux"], True, 1),
    (m.PRODUCT, 6, 5, "Particular", None, ["la", "con"], ["es[a-z]"], True, 1),
]


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENTRIES, m.CATALOGUE_SCHEMA)


def _sql_text(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


_TERMS = ",\n".join(
    f"('{e[0]}', {e[1]}, {_sql_text(t)}, {points}, {kind})"
    for e in ENTRIES if e[7]
    for terms, points, kind in ((e[5], 1, "false"), (e[6], 3, "true"))
    for t in terms
)
_ENTRIES = ",\n".join(
    f"('{e[0]}', {e[1]}, {e[2] or 'NULL'}, '{e[3]}', {_sql_text(e[4])}, {e[8] or 'NULL'}, {len(e[6])}, {len(e[5])})" for e in ENTRIES if e[7]
)
DETECT_SQL = f"""
term(level, id, term, points, is_pattern) AS (VALUES {_TERMS}),
entry(level, id, parent, name, alias, priority, n_patterns, n_keywords) AS (VALUES {_ENTRIES}),
score AS (
  SELECT doc_id, e.level, e.id, e.parent, e.name, e.priority, e.n_patterns, e.n_keywords, CAST(coalesce(p, 0) AS INT) AS score
  FROM documents CROSS JOIN entry e LEFT JOIN (
    SELECT doc_id, level, id, sum(points) AS p FROM documents JOIN term
    ON CASE WHEN is_pattern THEN regexp_matches(lower(text), term) ELSE contains(lower(text), term) END GROUP BY ALL) h USING (doc_id, level, id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, level, parent ORDER BY score DESC,
           CASE WHEN level = 'line' THEN NULL ELSE priority END ASC NULLS LAST, id) AS rn FROM score),
detected AS (
  SELECT d.doc_id, CAST(c.id AS BIGINT) AS company_id, c.name AS company, CAST(l.id AS BIGINT) AS line_id, l.name AS line,
         CAST(p.id AS BIGINT) AS product_id, p.name AS product,
         coalesce(c.score, 0) AS score_company, coalesce(l.score, 0) AS score_line, coalesce(p.score, 0) AS score_product
  FROM documents d
  LEFT JOIN ranked c ON c.doc_id = d.doc_id AND c.level = 'company' AND c.rn = 1 AND c.score > 0
  LEFT JOIN ranked l ON l.doc_id = d.doc_id AND l.level = 'line' AND l.parent = c.id AND l.rn = 1 AND l.score > 0
  LEFT JOIN ranked p ON p.doc_id = d.doc_id AND p.level = 'product' AND p.parent = l.id AND p.rn = 1 AND p.score > 0),
level AS (
  SELECT *, CASE WHEN product_id IS NOT NULL AND score_company + score_line + score_product >= 9 THEN 'alta'
                 WHEN line_id IS NOT NULL AND score_company + score_line + score_product >= 3 THEN 'media'
                 WHEN company_id IS NOT NULL THEN 'baja' ELSE 'sin_datos' END AS confidence,
         CASE WHEN score_company >= 3 THEN 'patrones' ELSE 'keywords' END AS detection_method FROM detected)"""
DETECTED = ["doc_id", "company_id", "company", "line_id", "line", "product_id", "product", "score_company", "score_line",
            "score_product", "confidence"]


def detected(spark: SparkSession, folder: str) -> DataFrame:
    return det.detect(documents(spark, folder).select("doc_id", "text"), catalogue(spark))


@query(f"WITH {DETECT_SQL} SELECT {', '.join(DETECTED)} FROM level")
def detect_hierarchy(spark, folder):
    """Best company, line and product of each document."""
    return detected(spark, folder).select(*DETECTED)


@query(f"WITH {DETECT_SQL} SELECT {', '.join(DETECTED)} FROM level")
def detect_hierarchy_joined(spark, folder):
    """The same through the joins for large catalogues."""
    docs = documents(spark, folder).select("doc_id", "text")
    return det.detect_by_join(docs, catalogue(spark)).select(*DETECTED)


@query(f"""WITH {DETECT_SQL} SELECT doc_id, CAST(rn AS INT) AS place, CAST(id AS BIGINT) AS id, name, score, n_patterns, n_keywords FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, priority ASC NULLS LAST, id) AS rn FROM score WHERE level = 'company') WHERE rn <= 3""")
def detect_top3_candidates(spark, folder):
    """The three best companies of each document, zero scores kept."""
    found = detected(spark, folder)
    return found.select("doc_id", F.posexplode("candidates").alias("p", "c")).select("doc_id", (F.col("p") + 1).alias("place"), "c.*")


@query(f"""WITH {DETECT_SQL} SELECT detection_method, confidence, count(*) AS n FROM level GROUP BY ALL""")
def detection_method_mix(spark, folder):
    return detected(spark, folder).groupBy("detection_method", "confidence").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {DETECT_SQL}, bare AS (SELECT level, id FROM entry WHERE n_patterns = 0)
SELECT l.doc_id, confidence, left(text, 50000) AS stored_text,
  (l.company_id IN (SELECT id FROM bare WHERE level = 'company')) IS TRUE OR (l.line_id IN (SELECT id FROM bare WHERE level = 'line')) IS TRUE
  OR (l.product_id IN (SELECT id FROM bare WHERE level = 'product')) IS TRUE AS needs_patterns
FROM level l JOIN documents d USING (doc_id) WHERE company LIKE '%lfa%' OR company LIKE 'Gam%'""")
def detection_preview(spark, folder):
    """Detection of some companies with the text as stored; nothing is saved."""
    found = det.needs_patterns(detected(spark, folder), catalogue(spark))
    chosen = found.filter(F.col("company").like("%lfa%") | F.col("company").like("Gam%"))
    return chosen.select("doc_id", "confidence", F.left("text", F.lit(m.HISTORY_CHARS)).alias("stored_text"), "needs_patterns")


@query(f"""WITH {DETECT_SQL}, flags AS (
  SELECT CASE WHEN l.doc_id % 97 = 0 THEN 'broken' END AS error, company, product, confidence FROM level l)
SELECT count(*) FILTER (error IS NULL) AS ok, count(*) FILTER (error IS NOT NULL) AS failed,
  count(*) FILTER (company IS NULL AND error IS NULL) AS unrecognised, count(*) FILTER (company = 'Gama') AS with_new_patterns,
  count(*) FILTER (company IS NOT NULL AND confidence IN ('baja', 'sin_datos')) AS low_confidence,
  count(*) FILTER (company IS NOT NULL AND product IS NULL AND error IS NULL) AS without_product FROM flags""")
def batch_quality_flags(spark, folder):
    """Counts of the quality flags over all documents."""
    results = detected(spark, folder).withColumn("error", F.when(F.col("doc_id") % 97 == 0, "broken"))
    return cov.flag_totals(cov.quality_flags(results.withColumn("new_patterns", F.col("company") == "Gama")))


PATTERNS = [r"\sth[a-z]+", r"eau(x|s)", r"[A-Z][a-z]+\.", "@", r"\d{3}", "(broken"]
_PATTERN_SQL = " UNION ALL ".join(
    f"SELECT {_sql_text(p)} AS pattern, "
    + ("0" if p == "(broken" else f"count(*) FILTER (regexp_matches(text, {_sql_text('(?im)' + p)}))")
    + f" AS matches, count(*) AS total, {'false' if p == '(broken' else 'true'} AS valid FROM documents"
    for p in PATTERNS
)


@query(_PATTERN_SQL)
def pattern_hit_counts(spark, folder):
    """In how many texts does each pattern occur?"""
    return cov.pattern_counts(documents(spark, folder), PATTERNS)


_TESTED = r"the ([a-z]+)\."


@query(f"""WITH t AS (SELECT source, regexp_extract(text, '(?i){_TESTED}', 1) AS v, regexp_matches(text, '(?i){_TESTED}') AS found FROM documents)
SELECT source, count(*) FILTER (found) AS found, count(*) AS total, bool_and(found) AS passes FROM t GROUP BY source""")
def regex_batch_test(spark, folder):
    """One pattern on all documents of each batch (source)."""
    tested = cov.test_pattern(documents(spark, folder).select("doc_id", "source", "text"), _TESTED)
    return cov.batch_summary(tested, ["source"])


@query(f"""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i){_TESTED}') THEN trim(regexp_extract(text, '(?i){_TESTED}', 1)) END AS value,
  regexp_matches(text, '(?i){_TESTED}') AS found FROM documents""")
def regex_document_test(spark, folder):
    """The same pattern, value by document."""
    return cov.test_pattern(documents(spark, folder).select("doc_id", "text"), _TESTED).select("doc_id", "value", "found")


# every passage counts as selected in the document of its own number
_SELECTIONS = "sel AS (SELECT item_id AS selection_id, item_id AS origin, text AS v FROM benchmark UNION ALL SELECT -1, 3, '')"


@query(f"""WITH {_SELECTIONS}
SELECT selection_id, doc_id, substr(text, CAST(p AS INT), length(v)) AS value,
  substr(text, CAST(greatest(1, p - 300) AS INT), CAST(least(length(text), p + length(v) - 1 + 300) - greatest(1, p - 300) + 1 AS INT)) AS context
FROM (SELECT *, CASE WHEN v = '' THEN 1 ELSE instr(lower(text), lower(v)) END AS p FROM documents, sel) WHERE p > 0 AND doc_id <> origin""")
def literal_autodetect(spark, folder):
    """Whole benchmark passages, and an empty selection, found again in the other documents, with context."""
    docs = documents(spark, folder).select("doc_id", "text", F.lit(1).alias("product_id"))
    return trainer.locate_literals(_selections(spark, folder), docs)


def _selections(spark, folder):
    passages = table(spark, folder, "benchmark").select(F.col("item_id").alias("selection_id"), F.lit(1).alias("product_id"), F.col("item_id").alias("doc_id"), F.col("text").alias("value"))
    return passages.unionByName(spark.createDataFrame([(-1, 1, 3, "")], passages.schema))


@query(f"""WITH {_SELECTIONS}
SELECT selection_id, count(*) FILTER (contains(lower(text), lower(v))) AS found, count(*) AS total,
  count(*) FILTER (NOT contains(lower(text), lower(v))) AS not_found FROM documents, sel WHERE length(text) > 0 AND doc_id <> origin GROUP BY selection_id""")
def literal_batch_summary(spark, folder):
    """How many documents hold each selected text, through the join for many selections."""
    docs = documents(spark, folder).select("doc_id", "text", F.lit(1).alias("product_id"))
    chosen = _selections(spark, folder)
    hits = trainer.locate_literals(chosen, docs, max_selections=0)
    return trainer.literal_summary(chosen, docs, hits)


_WORDS = ["the", "und", "que", "los", "der"]


@query("WITH c AS (SELECT doc_id, unnest([" + ", ".join(f"'{w}'" for w in _WORDS) + "]) AS word, unnest(range(5)) AS place, text FROM documents), "
       "n AS (SELECT doc_id, word, place, (length(text) - length(replace(text, word, ''))) // length(word) AS n FROM c) "
       "SELECT doc_id, CASE WHEN max(n) > 0 THEN arg_min(word, -n * 10 + place) END AS word FROM n GROUP BY doc_id")
def catalogue_vote(spark, folder):
    """The fixed word that occurs most often in each text."""
    from fieldloom.functions.votes import word_vote

    return documents(spark, folder).select("doc_id", word_vote(F.col("text"), _WORDS).alias("word"))


@query(f"""WITH {DETECT_SQL}, cat AS (SELECT '[' || string_agg('{{"company_id":' || c.id || ',"company":"' || c.name || '","line_id":' || l.id || ',"line":"' || l.name
  || '","product_id":' || p.id || ',"product":"' || p.name || '"}}', ',' ORDER BY c.id, l.id, p.id) || ']' AS j
  FROM entry c JOIN entry l ON l.parent = c.id AND l.level = 'line' AND c.level = 'company' JOIN entry p ON p.parent = l.id AND p.level = 'product')
SELECT l.doc_id, j AS catalogue, left(text, 2500) AS excerpt FROM level l JOIN documents USING (doc_id), cat WHERE confidence <> 'alta'""")
def model_requests(spark, folder):
    """Requests for the documents the detector is not sure about."""
    unsure = detected(spark, folder).filter(F.col("confidence") != m.HIGH)
    return ingest.model_requests(unsure, ingest.catalogue_json(catalogue(spark)))


@query(f"""WITH {DETECT_SQL} SELECT doc_id, company, line, product, left(text, 3000) AS excerpt FROM level JOIN documents USING (doc_id) WHERE company IS NOT NULL""")
def pattern_requests(spark, folder):
    """Requests for patterns of the levels a document was placed in."""
    return ingest.pattern_requests(detected(spark, folder))


@query("""SELECT lang, count(*) AS n_examples, string_agg('[' || doc_id || '] ' || substr(text, 1, 20) || chr(10) || left(text, 600), chr(10) ORDER BY doc_id) AS examples
FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY lang""")
def example_requests(spark, folder):
    """Labelled examples of each group in one request text."""
    docs = documents(spark, folder).join(table(spark, folder, "labels").filter("toxic = 1"), "doc_id")
    examples = docs.select("doc_id", "lang", F.substring("text", 1, 20).alias("value"), F.col("text").alias("context"))
    out = ingest.example_requests(examples, ["lang"])
    return out.withColumn("n_examples", F.col("n_examples").cast("bigint"))
