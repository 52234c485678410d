"""Catalogue upkeep, names and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom import model as m
from fieldloom.functions.amounts import person_label
from fieldloom.operators import coverage as cov
from fieldloom.operators import detect as det
from fieldloom.operators import upkeep
from fieldloom.sources import export
from fieldloom.workloads.policies import WITH_POLICY, policies
from fieldloom.workloads.registry import query, table


def nation_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """Regions as companies, nations as lines, suppliers as products."""
    listed = lambda *c: F.array(*c)
    company = table(spark, folder, "region").select(
        F.lit(m.COMPANY).alias("level"), F.col("r_regionkey").cast("bigint").alias("id"), F.lit(None).cast("bigint").alias("parent_id"), F.col("r_name").alias("name"),
        F.when(F.col("r_regionkey") % 2 == 0, F.concat(F.lit("X "), "r_name")).alias("alias"), listed("r_name").alias("keywords"),
        listed(F.lower("r_name")).alias("patterns"), F.lit(True).alias("active"), F.when(F.col("r_regionkey") > 1, F.col("r_regionkey")).alias("priority"),
    )
    line = table(spark, folder, "nation").select(
        F.lit(m.LINE).alias("level"), F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_regionkey").cast("bigint").alias("parent_id"), F.col("n_name").alias("name"),
        F.lit(None).cast("string").alias("alias"), listed().cast("array<string>").alias("keywords"), listed(F.col("n_name"), F.lit("x")).alias("patterns"),
        (F.col("n_nationkey") != 3).alias("active"), F.lit(None).cast("int").alias("priority"),
    )
    product = table(spark, folder, "supplier").select(
        F.lit(m.PRODUCT).alias("level"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("bigint").alias("parent_id"), F.col("s_name").alias("name"),
        F.when(F.col("s_acctbal") > 5000, "RICH").otherwise("").alias("alias"), F.when(F.col("s_acctbal") > 2000, listed("s_name")).alias("keywords"),
        F.when(F.col("s_acctbal") > 8000, listed("s_name")).alias("patterns"), (F.col("s_acctbal") > 0).alias("active"), F.col("s_nationkey").alias("priority"),
    )
    return company.unionByName(line).unionByName(product)


CATALOGUE = """cat AS (
  SELECT 'company' AS level, CAST(r_regionkey AS BIGINT) AS id, NULL AS parent_id, r_name AS name, CASE WHEN r_regionkey % 2 = 0 THEN 'X ' || r_name END AS alias, 1 AS n_pat, 1 AS n_kw, true AS active,
    CASE WHEN r_regionkey > 1 THEN r_regionkey END AS priority FROM region
  UNION ALL SELECT 'line', n_nationkey, n_regionkey, n_name, NULL, 2, 0, n_nationkey <> 3, NULL FROM nation
  UNION ALL SELECT 'product', s_suppkey, s_nationkey, s_name, CASE WHEN s_acctbal > 5000 THEN 'RICH' ELSE '' END, CASE WHEN s_acctbal > 8000 THEN 1 ELSE 0 END,
    CASE WHEN s_acctbal > 2000 THEN 1 ELSE 0 END, s_acctbal > 0, s_nationkey FROM supplier)"""


@query(f"""WITH {CATALOGUE} SELECT c.id, c.name, CAST(sum(x.n_pat) AS BIGINT) AS n_patterns FROM cat c JOIN (
  SELECT id AS cid, n_pat FROM cat WHERE level = 'company' AND active UNION ALL SELECT parent_id, n_pat FROM cat WHERE level = 'line' AND active
  UNION ALL SELECT l.parent_id, p.n_pat FROM cat p JOIN cat l ON l.level = 'line' AND l.active AND p.parent_id = l.id WHERE p.level = 'product' AND p.active) x ON cid = c.id
WHERE c.level = 'company' GROUP BY ALL""")
def patterns_per_company(spark, folder):
    return cov.patterns_per_company(nation_catalogue(spark, folder))


def _flat(nested: DataFrame) -> DataFrame:
    lines = nested.select(F.col("name").alias("company"), F.explode_outer("lines").alias("l"))
    return lines.select("company", F.col("l.name").alias("line"), F.explode_outer("l.products").alias("p")).select("company", "line", F.col("p.name").alias("product"))


@query(f"""WITH {CATALOGUE} SELECT c.name AS company, l.name AS line, p.name AS product FROM cat c LEFT JOIN cat l ON l.level = 'line' AND l.active AND l.parent_id = c.id
LEFT JOIN cat p ON p.level = 'product' AND p.active AND p.parent_id = l.id WHERE c.level = 'company'""")
def nested_catalogue_export(spark, folder):
    """The nested catalogue, flattened again to compare."""
    return _flat(export.nested_catalogue(nation_catalogue(spark, folder)))


@query(f"""WITH {CATALOGUE} SELECT c.name AS company, l.name AS line, p.name AS product FROM cat c LEFT JOIN cat l ON l.level = 'line' AND l.active AND l.parent_id = c.id
LEFT JOIN cat p ON p.level = 'product' AND p.active AND p.parent_id = l.id AND p.n_pat + p.n_kw > 0 WHERE c.level = 'company'""")
def nested_export(spark, folder):
    """The same without products that have nothing to detect."""
    return _flat(export.nested_catalogue(nation_catalogue(spark, folder), drop_empty=True))


@query(f"""WITH {CATALOGUE} SELECT name, priority, row_number() OVER (ORDER BY priority ASC NULLS LAST, name) AS place FROM cat WHERE level = 'company'""")
def catalogue_order(spark, folder):
    """Companies by priority, none last, then name."""
    from pyspark.sql import Window

    # the companies of a catalogue are a few dozen rows
    companies = nation_catalogue(spark, folder).filter(F.col("level") == m.COMPANY)
    return companies.select("name", "priority", F.row_number().over(Window.orderBy(*upkeep.catalogue_order())).cast("bigint").alias("place"))


@query("""SELECT c.n_nationkey AS line_id, coalesce(d.name, c.n_name) AS name, coalesce(d.region, c.n_regionkey) AS parent,
  CASE WHEN d.name IS NULL THEN false ELSE true END AS active,
  CASE WHEN c.n_name IS NULL THEN 'added' WHEN d.name IS NULL THEN CASE WHEN c.act THEN 'retired' ELSE 'kept' END WHEN NOT c.act THEN 'revived'
    WHEN d.region <> c.n_regionkey THEN 'updated' ELSE 'kept' END AS change
FROM (SELECT *, n_nationkey % 4 <> 1 AS act FROM nation) c FULL JOIN
  (SELECT 'NATION_' || (n_nationkey + 5) AS name, CASE WHEN n_nationkey < 10 THEN (n_regionkey + 1) % 5 ELSE (SELECT any_value(x.n_regionkey) FROM nation x WHERE x.n_nationkey = o.n_nationkey + 5) END AS region
   FROM nation o) d ON c.n_name = d.name""")
def catalogue_sync(spark, folder):
    """Current lines against a shifted official list: kept, updated, revived, added, retired."""
    nation = table(spark, folder, "nation")
    current = nation.select(F.col("n_nationkey").alias("line_id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("parent"), (F.col("n_nationkey") % 4 != 1).alias("active"))
    shifted = nation.select((F.col("n_nationkey") + 5).alias("k"), F.when(F.col("n_nationkey") < 10, (F.col("n_regionkey") + 1) % 5).alias("r"))
    known = nation.select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("old"))
    desired = shifted.join(known, "k", "left").select(F.concat(F.lit("NATION_"), "k").alias("name"), F.coalesce("r", "old").alias("parent"))
    return upkeep.sync_level(current, desired, ["name"], ["parent"])


@query("""SELECT n_nationkey, n_name FROM nation WHERE n_name NOT IN (SELECT 'NATION_' || (n_nationkey + 5) FROM nation)""")
def retired_names(spark, folder):
    """Names that left the official list."""
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
    official = nation.select(F.concat(F.lit("NATION_"), F.col("n_nationkey") + 5).alias("n_name"))
    return upkeep.missing_names(nation, official, ["n_name"])


@query("""SELECT s_suppkey AS product_id, f.field FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN
  (SELECT DISTINCT 'L' || (p_size % 5) AS line, p_type AS field FROM part) f ON f.line = 'L' || n_regionkey WHERE s_acctbal > 9000""")
def default_fields(spark, folder):
    """Fields of new products by their line."""
    added = table(spark, folder, "supplier").filter("s_acctbal > 9000").join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("product_id"), F.concat(F.lit("L"), "n_regionkey").alias("line")
    )
    sets = table(spark, folder, "part").select(F.concat(F.lit("L"), F.col("p_size") % 5).alias("line"), F.col("p_type").alias("field")).distinct()
    return upkeep.default_fields(added, sets)


@query(f"""WITH {CATALOGUE}, ok AS (SELECT 'line' AS level, s_nationkey AS id, list_distinct(list(CASE WHEN s_acctbal > 5000 THEN 'rich' ELSE 'poor' END)) AS new FROM supplier GROUP BY s_nationkey)
SELECT level, id, n_pat + len(coalesce(new, [])) AS n FROM cat LEFT JOIN ok USING (level, id)""")
def pattern_approval(spark, folder):
    """Approved patterns appended to the entries they belong to."""
    approved = table(spark, folder, "supplier").select(
        F.lit(m.LINE).alias("level"), F.col("s_nationkey").cast("bigint").alias("id"), F.array(F.when(F.col("s_acctbal") > 5000, "rich").otherwise("poor")).alias("patterns")
    )
    merged = upkeep.add_patterns(nation_catalogue(spark, folder), approved)
    return merged.select("level", "id", F.coalesce(F.size("patterns"), F.lit(0)).cast("bigint").alias("n"))


@query(f"""WITH {CATALOGUE}, o AS (SELECT o_orderkey, o_custkey % 6 AS cid, o_custkey % 30 AS lid, o_orderkey % 110 AS pid FROM orders)
SELECT o_orderkey, coalesce(nullif(c.alias, ''), 'C') AS company, coalesce(nullif(l.alias, ''), 'L') AS line, coalesce(nullif(p.alias, ''), 'P') AS product,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Persona Física' WHEN o_orderkey % 3 = 1 THEN 'Persona Moral' ELSE '2' END AS person
FROM o LEFT JOIN cat c ON c.level = 'company' AND c.id = cid LEFT JOIN cat l ON l.level = 'line' AND l.id = lid LEFT JOIN cat p ON p.level = 'product' AND p.id = pid""")
def export_alias(spark, folder):
    """Detected names replaced by the export alias; person code as text."""
    docs = table(spark, folder, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 6).alias("company_id"), (F.col("o_custkey") % 30).alias("line_id"), (F.col("o_orderkey") % 110).alias("product_id"),
        F.lit("C").alias("company"), F.lit("L").alias("line"), F.lit("P").alias("product"),
    )
    named = upkeep.export_names(docs, nation_catalogue(spark, folder))
    return named.select("o_orderkey", "company", "line", "product", person_label((F.col("o_orderkey") % 3).cast("string")).alias("person"))


@query("""SELECT c_custkey, CAST(r_regionkey AS BIGINT) AS company_id FROM customer LEFT JOIN region ON lower(CASE c_custkey % 3 WHEN 0 THEN 'Africa' WHEN 1 THEN 'aSIA' ELSE 'Nowhere' END) = lower(r_name)""")
def name_prefill(spark, folder):
    """Catalogue id of a typed name, case-blind."""
    typed = F.when(F.col("c_custkey") % 3 == 0, "Africa").when(F.col("c_custkey") % 3 == 1, "aSIA").otherwise("Nowhere")
    items = table(spark, folder, "customer").select("c_custkey", typed.alias("typed"))
    return upkeep.prefill_by_name(items, nation_catalogue(spark, folder), m.COMPANY, "typed").select("c_custkey", "company_id")


@query(f"""{WITH_POLICY}, t AS (SELECT doc_id, product_id, segment, trim(split_part(split_part(text, chr(10), 11), ':', 2)) AS vt FROM policy),
w AS (SELECT *, CASE WHEN segment = 'BUILDING' THEN CASE WHEN vt IN ('Camiones-Panel', 'Tractocamion') THEN 'Camiones' WHEN vt = 'Motocicletas' THEN 'Motocicletas' END END AS want FROM t)
SELECT doc_id, CASE want WHEN 'Camiones' THEN 77 WHEN 'Motocicletas' THEN product_id ELSE product_id END AS product_id, CASE want WHEN 'Camiones' THEN 'Camiones' ELSE 'Automóviles' END AS product FROM w""")
def product_override(spark, folder):
    """Vehicle type replaces the product where such a product is active in the line."""
    from fieldloom.functions.regex import first_match

    rows = [(m.PRODUCT, 77, 2, "Camiones", None, [], [], True, 1), (m.PRODUCT, 78, 2, "Motocicletas", None, [], [], False, 1), (m.PRODUCT, 79, 3, "Camiones", None, [], [], True, 1)]
    catalogue = spark.createDataFrame(rows, m.CATALOGUE_SCHEMA)
    docs = policies(spark, folder).withColumns({"line_id": F.col("product_id"), "product": F.lit("Automóviles"), "kind": first_match(F.col("text"), r"Tipo:\s*(.+)", 1)})
    wanted = det.wanted_product(F.col("segment"), F.col("kind"), F.col("text"), "BUILDING", "MACHINERY")
    return det.override_product(docs, catalogue, wanted).select("doc_id", "product_id", "product")


@query(f"""{WITH_POLICY} SELECT doc_id, CASE WHEN segment = 'MACHINERY' AND status = 'F' THEN 88 ELSE product_id END AS product_id,
  CASE WHEN segment = 'MACHINERY' AND status = 'F' THEN 'Flotilla de Vehiculos' ELSE 'Automóviles' END AS product FROM policy""")
def fleet_override(spark, folder):
    """The fleet heading, as a word of its own, replaces the product in the company that prints it."""
    rows = [(m.PRODUCT, 88, 5, "Flotilla de Vehiculos", None, [], [], True, 1)]
    heading = F.when(F.col("status") == "F", "\nPóliza de Flotillas\n").when(F.col("status") == "O", "\nMINIFLOTILLAS\n").otherwise("")
    docs = policies(spark, folder).withColumns({"line_id": F.col("product_id"), "product": F.lit("Automóviles"), "text": F.concat("text", heading)})
    wanted = det.wanted_product(F.col("segment"), F.lit(None).cast("string"), F.col("text"), "BUILDING", "MACHINERY")
    return det.override_product(docs, spark.createDataFrame(rows, m.CATALOGUE_SCHEMA), wanted).select("doc_id", "product_id", "product")


@query("""SELECT r_name AS name, count(*) AS n FROM (SELECT r_name FROM region UNION ALL SELECT r_name FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey < 3) GROUP BY r_name HAVING count(*) > 1""")
def repeated_names(spark, folder):
    """Company names used more than once."""
    catalogue = nation_catalogue(spark, folder)
    region = table(spark, folder, "region")
    extra = table(spark, folder, "nation").filter("n_nationkey < 3").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.lit(m.COMPANY).alias("level"), F.col("r_name").alias("name"))
    return cov.unique_names(upkeep.evolve(catalogue, extra))
