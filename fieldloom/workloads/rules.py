"""Rules on the policy texts, field resolution, coverage, exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom import model as m
from fieldloom.operators import coverage as cov
from fieldloom.operators import fields as fl
from fieldloom.operators import upkeep
from fieldloom.operators.bounds import unpack
from fieldloom.plans.recipes import RECIPE_SCHEMA, Family, Recipe, from_table, recipe_fields, to_rows
from fieldloom.session import shared_dir
from fieldloom.sources import export
from fieldloom.workloads.policies import POLICY, WITH_LINES, policies
from fieldloom.workloads.registry import query, table

TAX = r"R\.F\.C\.: ([A-Z]{3,4}-?\d{6}(?:-[A-Z0-9]{3})?)"
# (rule_id, product_id, field, pattern, active, draft)
RULES = [
    *[(p, p, "documento", r"poliza (\d+)", True, False) for p in range(1, 6)],
    *[(10 + p, p, "rfc", TAX, True, None if p == 3 else False) for p in range(1, 6)],
    (21, 1, "prima_neta", r"PRIMA NETA\n(?:.*\n){7}([\d,]+\.\d\d)", True, False),
    (22, 2, "prima_neta", r"^([\d,]+\.\d\d)$", True, False),
    (23, 3, "motor", r"Motor:(\w+)", True, False),
    (24, 4, "modelo", r"Modelo:(\d{4})", True, False),
    (25, 5, "placas", r"Placas:([A-Z]+\d+)$", True, False),
    (26, 5, "emitida", r"EMITIDA \d{2}/\d{2}", True, False),
    (31, 1, "documento", "old", False, False),
    (32, 1, "documento", "draft", True, True),
    (33, 2, "roto", "(broken", True, False),
]
# (field, group, fixed_value), product -> line, (product, field)
GLOBALS = [("documento", None, None), ("rfc", None, None), ("moneda", None, "MXN"), ("recargos", None, None), ("placas", "vehiculos", None),
           ("motor", "vehiculos", None)]
PRODUCT_LINES = [(1, "Autos"), (2, "Vida"), (3, "Transporte"), (4, "Vida"), (5, "Motos")]
SPECIFIC = [(1, "prima_neta"), (2, "prima_neta"), (2, "suma"), (3, "motor"), (4, "modelo"), (5, "moneda")]


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*r, None) for r in RULES], m.RULE_SCHEMA)


def field_table(spark: SparkSession, dedupe: bool = False) -> DataFrame:
    return fl.product_fields(
        spark.createDataFrame(PRODUCT_LINES, "product_id bigint, line string"),
        spark.createDataFrame(GLOBALS, "field string, group string, fixed_value string"),
        spark.createDataFrame(SPECIFIC, "product_id bigint, field string"), dedupe,
    )


def _v(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(_v(x) for x in r) + ")" for r in rows)


_GOOD = [(r[0], r[1], r[2], r[3] if "(" in r[3] else f"({r[3]})") for r in RULES if r[4] and not r[5] and r[3] != "(broken"]
_BAD = " UNION ALL SELECT doc_id, product_id, 'roto', NULL, 33 FROM policy WHERE product_id = 2"
RULED = f"""{POLICY},
rule(rule_id, product_id, field, pattern) AS (VALUES {_values(_GOOD)}),
ruled AS (SELECT doc_id, product_id, field, nullif(trim(regexp_extract(text, '(?im)' || pattern, 1)), '') AS value, CAST(rule_id AS BIGINT) AS rule_id
          FROM policy JOIN rule USING (product_id) {_BAD}),
long_rule AS (SELECT *, CASE WHEN value IS NULL THEN 'no_encontrado' ELSE 'regla' END AS method FROM ruled),
gfield(field, grp, fixed) AS (VALUES {_values(GLOBALS)}),
prod(product_id, line) AS (VALUES {_values(PRODUCT_LINES)}),
spec(product_id, field) AS (VALUES {_values(SPECIFIC)}),
pf AS (SELECT product_id, field, fixed, true AS is_global FROM prod, gfield
       WHERE grp IS NULL OR regexp_matches(lower(line), 'auto|moto|transporte|carga|camion|vehiculo')
       UNION ALL SELECT product_id, field, NULL, false FROM spec),
fixed AS (SELECT doc_id, field, fixed AS value, 'valor_fijo' AS method, NULL AS rule_id FROM policy JOIN pf USING (product_id)
          WHERE is_global AND fixed IS NOT NULL AND NOT EXISTS (FROM ruled r WHERE r.doc_id = policy.doc_id AND r.field = pf.field)),
missing AS (SELECT DISTINCT doc_id, field, NULL AS value, 'no_encontrado' AS method, NULL AS rule_id FROM policy JOIN pf USING (product_id)
          WHERE (NOT is_global OR fixed IS NULL) AND NOT EXISTS
          (FROM long_rule r WHERE r.doc_id = policy.doc_id AND r.field = pf.field AND method = 'regla')),
every AS (SELECT doc_id, field, value, method, rule_id FROM long_rule UNION ALL SELECT * FROM fixed UNION ALL SELECT * FROM missing),
resolved AS (SELECT doc_id, field, value, method, rule_id FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY CASE WHEN value IS NULL THEN 9 WHEN method = 'regla' THEN 1 ELSE 2 END, rule_id DESC NULLS LAST) AS rn
  FROM every) WHERE rn = 1)"""
WITH_RULES = f"WITH {RULED}"


def _ruled(spark, folder):
    docs = policies(spark, folder)
    return docs, fl.apply_rules(docs, rule_table(spark))


def _resolved(spark, folder):
    docs, found = _ruled(spark, folder)
    return fl.complete_sources(docs, field_table(spark), found)


def _arrays(spark, folder):
    """All fields of each policy as one array, without a shuffle after the texts are made."""
    docs = fl.rule_fields(policies(spark, folder), rule_table(spark))
    complete = fl.complete_fields(F.col("rule_fields"), fl.field_lists(field_table(spark)), F.col("product_id"))
    return docs.withColumn("fields", complete).drop("rule_fields")


@query(f"{WITH_RULES} SELECT doc_id, field, value, method, rule_id FROM long_rule")
def apply_rules_long(spark, folder):
    """Every rule of the document's product, unrolled into one projection."""
    return _ruled(spark, folder)[1]


@query(f"{WITH_RULES} SELECT doc_id, field, value, method, rule_id FROM long_rule")
def apply_rules_joined(spark, folder):
    """The same with the rules as arrays of their products, in tables of a few rules each."""
    return fl.apply_rules(policies(spark, folder), rule_table(spark), max_unrolled=0, max_broadcast=4)


@query(f"{WITH_RULES} SELECT doc_id, field, value, method FROM fixed UNION ALL SELECT doc_id, field, value, method FROM missing")
def missing_fields(spark, folder):
    """Fixed values and missing fields of each document."""
    docs, found = _ruled(spark, folder)
    fields = field_table(spark)
    return fl.fixed_values(docs, fields, found).unionByName(fl.missing_fields(docs, fields, found)).drop("rule_id")


@query(f"{WITH_RULES} SELECT * FROM resolved")
def resolve_sources(spark, folder):
    """One row per document and field from all sources."""
    return _resolved(spark, folder)


@query(f"{WITH_RULES} SELECT doc_id, field, value, CASE WHEN value IS NULL THEN 'no_encontrado' ELSE method END AS method FROM resolved")
def resolve_in_arrays(spark, folder):
    """The same resolution on arrays, in one projection."""
    return export.long_rows(_arrays(spark, folder)).drop("rule_id")


@query(f"""{WITH_RULES} SELECT doc_id, count(*) FILTER (method IN ('regla', 'valor_fijo')) AS by_rule, CAST(0 AS BIGINT) AS by_model,
  count(*) FILTER (method = 'no_encontrado') AS not_found FROM resolved GROUP BY doc_id""")
def method_counters(spark, folder):
    return fl.method_counters(_resolved(spark, folder))


@query(f"""{WITH_RULES} SELECT r.doc_id, product_id, list_sort(list(field || '=' || coalesce(value, '-'))) AS pairs,
  list_sort(list(field) FILTER (method = 'regla')) AS covered, count(*) FILTER (method <> 'no_encontrado') AS by_rule,
  count(*) FILTER (method = 'no_encontrado') AS not_found, any_value(left(text, 50000)) AS stored_text
  FROM resolved r JOIN policy USING (doc_id) GROUP BY r.doc_id, product_id""")
def extraction_headers(spark, folder):
    """Header row of each document with its record and counters."""
    none = F.lit(None).cast("string")
    docs = _arrays(spark, folder).withColumns(
        {"company_id": F.lit(1), "line_id": F.lit(1), "company": none, "line": none, "product": none, "score_company": F.lit(3), "confidence": none}
    )
    head = export.header_rows(docs)
    pairs = F.array_sort(F.transform(F.map_entries("record"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("-")))))
    return head.select("doc_id", "covered", "product_id", pairs.alias("pairs"), F.col("by_rule").cast("bigint").alias("by_rule"),
                      F.col("not_found").cast("bigint").alias("not_found"), F.col("text").alias("stored_text"))


@query(f"""{WITH_RULES} SELECT doc_id, list_sort(list(field) FILTER (method = 'regla')) AS covered, count(*) AS n_fields FROM resolved GROUP BY doc_id""")
def field_record_map(spark, folder):
    """Record map and covered set from the long table."""
    long_fields = _resolved(spark, folder)
    size = fl.field_map(long_fields).select("doc_id", F.size("record").cast("bigint").alias("n_fields"))
    return fl.covered_fields(long_fields).join(size, "doc_id")


@query(f"""{WITH_RULES} SELECT doc_id, count(*) AS n_fields, count(value) AS n_values, count(*) FILTER (method <> 'no_encontrado') AS by_rule,
  count(*) FILTER (method = 'no_encontrado') AS not_found, list_sort(list(field) FILTER (method = 'regla')) AS covered FROM resolved GROUP BY doc_id""")
def write_extraction(spark, folder):
    """Headers and long rows read back from a batch that was written twice; an attempt never published is not seen."""
    none = F.lit(None).cast("string")
    docs = _arrays(spark, folder).withColumns(
        {"company_id": F.lit(1), "line_id": F.lit(1), "company": none, "line": none, "product": none, "score_company": F.lit(3), "confidence": none}
    )
    base = f"{shared_dir(spark)}/fieldloom/extraction-{uuid.uuid4().hex}"
    export.write_extraction(docs.withColumn("fields", F.slice("fields", 1, 1)), base, "all")
    export.write_extraction(docs, base, "all")
    export.stage_extraction(docs.withColumn("fields", F.slice("fields", 1, 2)), base, "all")
    long_fields = export.read_extraction(spark, base, "fields")
    sizes = long_fields.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_fields"), F.count("value").alias("n_values"))
    head = export.read_extraction(spark, base, "extractions").select(
        "doc_id", "covered", F.col("by_rule").cast("bigint").alias("by_rule"), F.col("not_found").cast("bigint").alias("not_found")
    )
    return head.join(sizes, "doc_id")


@query(f"""{WITH_RULES} SELECT doc_id, max(value) FILTER (field = 'documento') AS documento, max(value) FILTER (field = 'rfc') AS rfc,
  max(value) FILTER (field = 'moneda') AS moneda, max(value) FILTER (field = 'motor') AS motor FROM resolved GROUP BY doc_id""")
def pivot_export(spark, folder):
    """Wide table from the long one."""
    return export.pivot_fields(_resolved(spark, folder), ["documento", "rfc", "moneda", "motor"])


_WIDE = ", ".join(f"max(value) FILTER (field = '{f}') AS {f}" for f, _ in export.WIDE_COLUMNS)


@query(f"""{WITH_RULES} SELECT 'P' || r.doc_id AS name, segment AS company, CAST(NULL AS VARCHAR) AS line, CAST(NULL AS VARCHAR) AS product, {_WIDE},
  'Regla(' || count(*) FILTER (method <> 'no_encontrado') || ')' AS method, '' AS error, '—' AS confidence
  FROM resolved r JOIN policy USING (doc_id) GROUP BY r.doc_id, segment""")
def wide_export(spark, folder):
    """The exported table: four meta columns, fixed fields, three more."""
    none = F.lit(None).cast("string")
    docs = _arrays(spark, folder).withColumns(
        {"name": F.concat(F.lit("P"), F.col("doc_id")), "company": F.col("segment"), "line": none, "product": none, "confidence": none, "error": none}
    )
    return export.export_wide(docs, headings=False)


@query(f"""{WITH_RULES}, chosen AS (SELECT doc_id, text, 1 AS product_id FROM policy WHERE product_id = 4 AND status = 'F'),
again AS (SELECT doc_id, field, nullif(trim(regexp_extract(text, '(?im)' || pattern, 1)), '') AS value FROM chosen JOIN rule USING (product_id)
  UNION ALL SELECT doc_id, x.field, x.value FROM chosen, (VALUES ('moneda', 'MXN'), ('recargos', NULL), ('placas', NULL), ('motor', NULL)) x(field, value))
SELECT doc_id, field, value FROM resolved WHERE doc_id NOT IN (SELECT doc_id FROM chosen) UNION ALL SELECT * FROM again
UNION ALL SELECT doc_id, 'entidad', CASE WHEN regexp_matches(tax, '^[A-ZÑ&]{{4}}[0-9]{{6}}') THEN '0' ELSE '1' END
  FROM (SELECT doc_id, upper(regexp_replace(value, '[ -]', '', 'g')) AS tax FROM again WHERE field = 'rfc') WHERE regexp_matches(tax, '^[A-ZÑ&]{{3,4}}[0-9]{{6}}')""")
def reapply_product(spark, folder):
    """Documents of one product reworked with another; the other rows stay."""
    docs = policies(spark, folder)
    chosen = docs.filter("product_id = 4 AND status = 'F'").select("doc_id", F.lit(1).cast("bigint").alias("product_id"))
    done = fl.reapply_product(docs, chosen, rule_table(spark), field_table(spark), _resolved(spark, folder))
    return done.select("doc_id", "field", "value")


# ---- rules made from parts, hierarchy made from nations -----------------------------

def part_rules(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("rule_id"), F.regexp_replace("p_brand", "Brand#", "").cast("bigint").alias("product_id"),
        F.col("p_type").alias("field"), F.replace("p_name", F.lit(" "), F.lit(r"\s+")).alias("pattern"), (F.col("p_size") <= 40).alias("active"),
        F.when(F.col("p_size") > 1, F.col("p_size").between(30, 35)).alias("draft"), F.col("p_retailprice").alias("created_at"),
    )


PART_RULES = """prule AS (SELECT p_partkey AS rule_id, CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS product_id, p_type AS field,
  replace(p_name, ' ', '\\s+') AS pattern, p_size <= 40 AS active, CASE WHEN p_size > 1 THEN p_size BETWEEN 30 AND 35 END AS draft,
  p_retailprice AS created_at FROM part)"""
LIVE = "active AND NOT coalesce(draft, false)"


def nation_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    joined = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    line = F.element_at(F.array(*map(F.lit, LINE_NAMES)), F.col("r_regionkey") + 1)
    return joined.select(
        (F.col("n_nationkey") + 1).cast("bigint").alias("product_id"), F.col("n_name").alias("product"), line.alias("line"),
        F.col("r_name").alias("company"), F.when(F.col("r_regionkey") > 0, F.col("r_regionkey")).alias("company_priority"),
        (F.col("n_nationkey") < 20).alias("product_active"),
    )


LINE_NAMES = ["Autos", "Vida", "Transporte", "Fianzas", "Carga"]
HIERARCHY = f"""hier AS (SELECT CAST(n_nationkey + 1 AS BIGINT) AS product_id, n_name AS product,
  {_v(LINE_NAMES[0])} AS x, ([{', '.join(_v(n) for n in LINE_NAMES)}])[r_regionkey + 1] AS line, r_name AS company,
  nullif(r_regionkey, 0) AS company_priority, n_nationkey < 20 AS product_active FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def part_fields(spark: SparkSession, folder: str, dedupe: bool) -> DataFrame:
    part = table(spark, folder, "part")
    globals_ = part.select(F.col("p_type").alias("field")).distinct().select(
        "field", F.when(F.col("field") == "SMALL", m.VEHICLE_GROUP).alias("group"), F.when(F.col("field") == "PROMO", "X").alias("fixed_value")
    )
    brand = F.regexp_replace("p_brand", "Brand#", "").cast("bigint").alias("product_id")
    specific = part.select(brand, F.split("p_name", " ")[1].alias("field")).distinct().unionByName(
        part.filter("p_size >= 48").select(brand, F.col("p_type").alias("field")).distinct()
    )
    return fl.product_fields(nation_hierarchy(spark, folder), globals_, specific, dedupe)


FIELD_LIST = f"""{HIERARCHY},
pglob AS (SELECT DISTINCT p_type AS field, CASE WHEN p_type = 'SMALL' THEN 'vehiculos' END AS grp, CASE WHEN p_type = 'PROMO' THEN 'X' END AS fixed FROM part),
pspec AS (SELECT DISTINCT CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS product_id, split_part(p_name, ' ', 2) AS field FROM part UNION ALL
  SELECT DISTINCT CAST(replace(p_brand, 'Brand#', '') AS BIGINT), p_type FROM part WHERE p_size >= 48),
general AS (SELECT product_id, field, fixed, true AS is_global FROM hier, pglob WHERE grp IS NULL OR line IN ('Autos', 'Transporte', 'Carga')),
own AS (SELECT s.product_id, s.field, NULL AS fixed, false AS is_global FROM pspec s JOIN hier USING (product_id)),
{PART_RULES},
flagged AS (SELECT f.*, fixed IS NOT NULL OR EXISTS (FROM prule r WHERE r.product_id = f.product_id AND r.field = f.field AND {LIVE}) AS covered
  FROM (FROM general UNION ALL FROM own) f)"""
_COVER = """count(*) AS total, count(*) FILTER (covered) AS covered, count(*) - count(*) FILTER (covered) AS missing,
  round(count(*) FILTER (covered) / count(*) * 100, 1) AS percent"""


@query(f"WITH {FIELD_LIST} SELECT product_id, {_COVER} FROM flagged GROUP BY product_id")
def rule_coverage(spark, folder):
    """Coverage of every product."""
    return cov.rule_coverage(part_fields(spark, folder, False), part_rules(spark, folder))


@query(f"""WITH {FIELD_LIST} SELECT company, line, product_id, {_COVER} FROM flagged JOIN hier USING (product_id) GROUP BY ROLLUP (company, line, product_id)""")
def coverage_rollup(spark, folder):
    """Coverage at all levels of the hierarchy."""
    fields = part_fields(spark, folder, False).join(F.broadcast(nation_hierarchy(spark, folder).select("product_id", "company", "line")), "product_id")
    return cov.coverage_rollup(fields, part_rules(spark, folder), ["company", "line", "product_id"])


@query(f"""WITH {FIELD_LIST}, listed AS (FROM general UNION ALL SELECT * FROM own o WHERE NOT EXISTS
  (FROM general g WHERE g.product_id = o.product_id AND g.field = o.field))
SELECT product_id, field, is_global, fixed AS fixed_value, row_number() OVER (PARTITION BY product_id ORDER BY is_global DESC, field) AS place FROM listed""")
def field_list(spark, folder):
    """Field list of each product: global fields first, names once."""
    from pyspark.sql import Window

    # a product has a few dozen fields, the window is over configuration
    place = F.row_number().over(Window.partitionBy("product_id").orderBy(F.desc("is_global"), "field")).cast("bigint")
    return part_fields(spark, folder, True).select("product_id", "field", "is_global", "fixed_value", place.alias("place"))


@query(f"WITH {PART_RULES} SELECT product_id, field, count(*) AS n FROM prule WHERE {LIVE} GROUP BY ALL HAVING count(*) > 1")
def duplicate_active_rules(spark, folder):
    return cov.duplicate_rules(part_rules(spark, folder))


@query(f"""WITH {PART_RULES}, {HIERARCHY} SELECT rule_id, field, pattern, product, line, company, company_priority
FROM prule JOIN hier USING (product_id) WHERE {LIVE}""")
def rules_with_hierarchy(spark, folder):
    """Active rules with their three level names, in hierarchy order."""
    joined = upkeep.rules_with_hierarchy(part_rules(spark, folder), nation_hierarchy(spark, folder))
    return joined.orderBy(*upkeep.hierarchy_order()).select("rule_id", "field", "pattern", "product", "line", "company", "company_priority")


@query(f"""WITH {PART_RULES}, {HIERARCHY} SELECT rule_id, row_number() OVER (ORDER BY company_priority NULLS FIRST, line, product, field, rule_id) AS place
FROM prule JOIN hier USING (product_id) WHERE {LIVE}""")
def rule_places(spark, folder):
    """Place of each active rule in hierarchy order: companies without a priority come first."""
    from pyspark.sql import Window

    joined = upkeep.rules_with_hierarchy(part_rules(spark, folder), nation_hierarchy(spark, folder))
    # the window is over configuration
    place = F.row_number().over(Window.orderBy(*upkeep.hierarchy_order(), "rule_id")).cast("bigint")
    return joined.select("rule_id", place.alias("place"))


@query(f"""WITH {PART_RULES}, marked AS (SELECT * REPLACE (CASE WHEN rule_id % 10 = 3 THEN '(' || pattern ELSE pattern END AS pattern) FROM prule)
SELECT rule_id, product_id, field, pattern, pattern NOT LIKE '(%' AS valid, CASE WHEN pattern LIKE '(%' THEN NULL ELSE 0 END AS groups FROM marked
WHERE {LIVE}""")
def active_rules(spark, folder):
    """Active rules with the result of the pattern check."""
    rules = part_rules(spark, folder).withColumn(
        "pattern", F.when(F.col("rule_id") % 10 == 3, F.concat(F.lit("("), F.col("pattern"))).otherwise(F.col("pattern"))
    )
    screened = fl.screen_rules(fl.usable_rules(rules))
    return screened.select("rule_id", "product_id", "field", "pattern", F.col("java").isNotNull().alias("valid"), "groups")


@query(f"""WITH {PART_RULES}, win AS (SELECT product_id, field, arg_max(rule_id, (created_at, rule_id)) AS rule_id FROM prule WHERE {LIVE} GROUP BY ALL)
SELECT rule_id, product_id, field, CASE WHEN {LIVE} THEN rule_id IN (SELECT rule_id FROM win) ELSE active END AS active FROM prule""")
def rule_activation(spark, folder):
    """Only the newest of the active rules of a field stays active."""
    return upkeep.activate_latest(part_rules(spark, folder)).select("rule_id", "product_id", "field", "active")


@query(f"""WITH {PART_RULES}, up AS (SELECT * REPLACE (CASE WHEN active AND draft THEN false ELSE draft END AS draft,
  CASE WHEN active AND draft THEN 99999 + created_at ELSE created_at END AS created_at) FROM prule),
win AS (SELECT product_id, field, arg_max(rule_id, (created_at, rule_id)) AS rule_id FROM up WHERE {LIVE} GROUP BY ALL)
SELECT rule_id, draft, CASE WHEN {LIVE} THEN rule_id IN (SELECT rule_id FROM win) ELSE active END AS active FROM up""")
def draft_promotion(spark, folder):
    """All active drafts become rules and replace the ones before."""
    rules = part_rules(spark, folder)
    promoted = rules.filter("active AND draft").select("rule_id", (F.lit(99999) + F.col("created_at")).alias("promoted_at"))
    return upkeep.promote_drafts(rules, promoted).select("rule_id", "draft", "active")


@query(f"""WITH {PART_RULES}, {HIERARCHY} SELECT company, line, product, len(list(rule_id)) AS n_rules, list_sort(list(field || ':' || rule_id)) AS rules
FROM prule JOIN hier USING (product_id) WHERE {LIVE} GROUP BY ALL""")
def nested_rules_export(spark, folder):
    """The nested rule export, flattened again to compare."""
    nested = export.nested_rules(upkeep.rules_with_hierarchy(part_rules(spark, folder), nation_hierarchy(spark, folder)))
    flat = nested.select("company", F.inline("lines")).select("company", "line", F.inline("products"))
    names = F.array_sort(F.transform("rules", lambda r: F.concat(r["field"], F.lit(":"), r["rule_id"])))
    return flat.select("company", "line", "product", F.size("rules").cast("bigint").alias("n_rules"), names.alias("rules"))


@query(f"""WITH {PART_RULES}, {HIERARCHY} SELECT rule_id, company, line, product, product_active, field, active, coalesce(draft, false) AS draft
FROM prule JOIN hier USING (product_id)""")
def maintenance_reports(spark, folder):
    """Audit list of all rules with the state of their product."""
    return upkeep.rule_audit(part_rules(spark, folder), nation_hierarchy(spark, folder))


OLD = list(upkeep.PRODUCT_NAMES)
_REMAP = f"""h2 AS (SELECT product_id, company, product_active, CAST(dense_rank() OVER (ORDER BY company) AS BIGINT) AS company_id,
  CASE WHEN product_id <= 13 THEN ([{', '.join(_v(x) for x in upkeep.OLD_LINES)}])[product_id % 4 + 1] ELSE 'Vehículos' END AS line,
  CASE WHEN product_id <= 13 THEN ([{', '.join(_v(x) for x in [*OLD, 'Otro'])}])[product_id % 5 + 1]
       ELSE ([{', '.join(_v(x) for x in upkeep.PRODUCT_NAMES.values())}])[product_id % 4 + 1] END AS product FROM hier)"""


@query(f"""WITH {PART_RULES}, {HIERARCHY}, {_REMAP}, names(old, new) AS (VALUES {_values(upkeep.PRODUCT_NAMES.items())})
SELECT *, CASE WHEN new_product IS NULL THEN 'no mapping' WHEN new_product_id IS NULL THEN 'no new product' END AS skip_reason FROM (
SELECT rule_id, o.product AS old_product, new AS new_product,
  (SELECT min(product_id) FROM h2 n WHERE n.line = 'Vehículos' AND n.company_id = o.company_id AND n.product = new AND n.product_active) AS new_product_id
FROM prule JOIN h2 o USING (product_id) LEFT JOIN names ON old = o.product WHERE o.line <> 'Vehículos') t""")
def rule_remap(spark, folder):
    """Rules of old products moved to the products that replace them."""
    from pyspark.sql import Window

    base = nation_hierarchy(spark, folder)
    ranks = base.select("company").distinct().withColumn("company_id", F.dense_rank().over(Window.orderBy("company")).cast("bigint"))
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("product_id") % n + 1).cast("int"))
    old = F.col("product_id") <= 13
    hierarchy = base.join(ranks, "company").select(
        "product_id", "company_id", "product_active", F.when(old, pick(upkeep.OLD_LINES, 4)).otherwise(upkeep.NEW_LINE).alias("line"),
        F.when(old, pick([*OLD, "Otro"], 5)).otherwise(pick(list(upkeep.PRODUCT_NAMES.values()), 4)).alias("product"),
    )
    return upkeep.remap_rules(part_rules(spark, folder), hierarchy).select("rule_id", "old_product", "new_product", "new_product_id", "skip_reason")


# ---- recipes -------------------------------------------------------------------------

CENTS = r"-?\d{1,3}(?:,\d{3})*\.\d{2}"
FAMILY_ONE = Family("BUILDING", [
    Recipe("prima_neta", "label_offset", {"labels": ["PRIMA NETA"], "offsets": [8, 1], "value": CENTS, "on": "lines"}),
    Recipe("descuento", "label_offset", {"labels": ["TASA FINANCIAMIENTO"], "offsets": [8], "value": CENTS, "on": "lines", "post": ["unsigned"]}),
    Recipe("forma_pago", "label_offset", {"labels": ["FORMA DE PAGO"], "offsets": [8], "accept": ["payment_form"], "first_only": False, "post": ["title"]}),
    Recipe("prima_total", "label_steps", {"labels": ["IMPORTE TOTAL"], "steps": [{"at": 7, "value": r"\d+-\d+"}, {"first": 1, "last": 35, "which": "last", "value": CENTS}]}),
    Recipe("copia", "copy_field", {"other": "prima_neta"}, 1),
], lambda doc: F.contains(doc.upper, F.lit("SUBTOTAL")))
FAMILY_TWO = Family("MACHINERY", [
    Recipe("motor", "regex", {"patterns": [r"Chasis:(\w+)", r"Motor:(\w+)"]}),
    Recipe("agente", "relative_to", {"other": "motor", "offset": 1}, 1),
], lambda doc: F.lit(True))


@query(f"""{WITH_LINES}, pick AS (SELECT p.doc_id, p.segment, l.no, l.line FROM policy p JOIN lines l USING (doc_id)),
one AS (SELECT doc_id, 'prima_neta' AS field, v.line AS value FROM pick a JOIN pick v USING (doc_id) WHERE a.segment = 'BUILDING' AND a.line = 'PRIMA NETA' AND v.no = a.no + 8),
two AS (SELECT doc_id, 'descuento', replace(v.line, '-', '') FROM pick a JOIN pick v USING (doc_id) WHERE a.segment = 'BUILDING' AND a.line = 'TASA FINANCIAMIENTO' AND v.no = a.no + 8),
three AS (SELECT doc_id, 'forma_pago', upper(left(v.line, 1)) || lower(substr(v.line, 2)) FROM pick a JOIN pick v USING (doc_id) WHERE a.segment = 'BUILDING' AND a.line = 'FORMA DE PAGO' AND v.no = a.no + 8 AND v.line <> 'OTRA'),
four AS (SELECT doc_id, 'prima_total', v.line FROM pick a JOIN pick v USING (doc_id) WHERE a.segment = 'BUILDING' AND a.line = 'IMPORTE TOTAL' AND v.no = a.no + 8),
five AS (SELECT doc_id, 'motor', regexp_extract(line, 'Motor:(\\w+)', 1) FROM pick WHERE segment = 'MACHINERY' AND line LIKE 'Motor:%'),
six AS (SELECT doc_id, 'agente', v.line FROM pick a JOIN pick v USING (doc_id) WHERE a.segment = 'MACHINERY' AND a.line LIKE 'Motor:%' AND v.no = a.no + 1)
FROM one UNION ALL FROM two UNION ALL FROM three UNION ALL FROM four UNION ALL SELECT doc_id, 'copia', value FROM one UNION ALL FROM five UNION ALL FROM six""")
def recipe_runner(spark, folder):
    """Recipes read from a table, two companies, one pass."""
    rows = [r for family in (FAMILY_ONE, FAMILY_TWO) for r in to_rows(family)]
    families = from_table(spark.createDataFrame(rows, RECIPE_SCHEMA), {f.company: f.gate for f in (FAMILY_ONE, FAMILY_TWO)})
    docs = policies(spark, folder).withColumn("company", F.col("segment"))
    return unpack(recipe_fields(docs, families), ["doc_id"], "recipe_fields").select("doc_id", "field", "value")


# ---- end to end ------------------------------------------------------------------------

CATALOGUE = [
    (m.COMPANY, 1, None, "Quálitas", None, ["qualitas"], ["poliza"], True, 1),
    (m.COMPANY, 2, None, "Otra", None, ["agente"], [], True, 2),
    (m.LINE, 1, 1, "Vehículos", None, ["motor"], ["placas"], True, None),
    (m.PRODUCT, 1, 1, "Automóviles", None, ["tipo"], ["prima neta"], True, 1),
    (m.PRODUCT, 2, 1, "Camiones", None, ["tractor"], [], True, 2),
]


@query(f"""{WITH_LINES}, f AS (SELECT doc_id, max(line) FILTER (no = 22) AS prima_neta, max(line) FILTER (no = 25) AS iva, max(line) FILTER (no = 26) AS prima_total,
  max(line) FILTER (no = 10) AS vt, max(line) FILTER (no = 13) AS issued FROM lines GROUP BY doc_id)
SELECT doc_id, CASE WHEN priority IN ('1-URGENT', '4-NOT SPECIFIED') THEN 'Camiones' ELSE 'Automóviles' END AS product, 'alta' AS confidence,
  replace(regexp_extract(text, 'R\\.F\\.C\\.: (\\S+)', 1), '-', '') AS rfc, prima_neta, iva, prima_total, 'KA' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS motor,
  CASE WHEN nation_id >= 12 THEN 'Persona Física' ELSE 'Persona Moral' END AS entidad, CASE WHEN nation_id < 20 THEN 'Pesos' ELSE 'Usd' END AS moneda,
  CASE WHEN priority IN ('1-URGENT', '4-NOT SPECIFIED') THEN replace(issued, 'EMITIDA ', '') END AS concepto,
  CASE WHEN priority NOT IN ('1-URGENT', '4-NOT SPECIFIED') THEN 'fijo' END AS canal, 'no_encontrado' AS estado_method
FROM policy JOIN f USING (doc_id)""")
def extract_fields(spark, folder):
    """The whole extraction of the first family: detection, recipes, override, rules, fixed, missing, derived."""
    from fieldloom.plans import family_a
    from fieldloom.plans.extract import extract

    docs = policies(spark, folder).select("doc_id", F.concat("text", F.lit("\nQualitas")).alias("text"))
    rules_ = spark.createDataFrame([(1, 2, "concepto", r"EMITIDA (\S+)", True, False, None), (2, 2, "canal", "absent", True, False, None)], m.RULE_SCHEMA)
    products = spark.createDataFrame([(1, "Vehículos"), (2, "Vehículos")], "product_id bigint, line string")
    globals_ = spark.createDataFrame([("rfc", None, None), ("canal", None, "fijo")], "field string, group string, fixed_value string")
    specific = spark.createDataFrame([(1, "estado"), (2, "estado")], "product_id bigint, field string")
    fields = fl.product_fields(products, globals_, specific, dedupe=False)
    out = extract(docs, spark.createDataFrame(CATALOGUE, m.CATALOGUE_SCHEMA), rules_, fields, families=[family_a.FAMILY])
    names = ["rfc", "prima_neta", "iva", "prima_total", "motor", "entidad", "moneda", "concepto", "canal"]
    state = F.get(F.filter("fields", lambda f: f["field"] == "estado"), F.lit(0))["method"]
    return out.select("doc_id", "product", "confidence", *[fl.value_of(F.col("fields"), n).alias(n) for n in names], state.alias("estado_method"))
