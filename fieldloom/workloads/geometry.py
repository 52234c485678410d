"""Layout strategies on pages made from orders: one label, values around it."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.operators import layout
from fieldloom.operators.bounds import unpack
from fieldloom.operators.fields import rule_fields
from fieldloom.workloads.registry import query, spread, table

# (ord, text, x0, y0, width): expressions that mean the same in both engines
GRID = [
    (0, "'CONTRATANTE'", "20", "20", 60),
    (1, "'Total'", "100", "100", 30),
    (2, "concat('A', o_custkey)", "130 + o_orderkey % 50", "100 + o_custkey % 9", 20),
    (3, "concat('B', o_orderkey)", "100 + o_custkey % 21", "101 + o_orderkey % 60", 20),
    (4, "'Neta'", "104", "103", 20),
    (5, "concat('C', o_custkey)", "102", "112 + o_orderkey % 13", 20),
    (6, "concat('D', o_orderkey % 7)", "99", "125 + o_orderkey % 25", 20),
    (7, "concat('E', o_custkey % 5)", "101", "150 + o_custkey % 30", 20),
    (8, "'AGENTE'", "20", "300", 40),
    (9, "concat('K', o_custkey)", "22", "310 + o_orderkey % 50", 40),
    (10, "'Total'", "100", "400", 30),
]
HEIGHT = 800
TITLES, VALUES = (0, 1, 4, 8, 10), (2, 3, 5, 6, 7)
SPAN_FIELDS = ["page", "ord", "block", "line", "text", "x0", "y0", "x1", "y1", "page_width", "page_height"]


def _span_sql() -> str:
    parts = [
        f"SELECT o_orderkey AS doc_id, 1 AS page, {o} AS ord, {t} AS text, CAST({x} AS DOUBLE) AS x0, CAST({y} AS DOUBLE) AS y0, "
        f"CAST({x} + {w} AS DOUBLE) AS x1, CAST({y} + 8 AS DOUBLE) AS y1 FROM orders" for o, t, x, y, w in GRID
    ]
    return "span AS (" + " UNION ALL ".join(parts) + ")"


SPANS = _span_sql()
LABEL = "lab AS (SELECT doc_id, page, ord AS lo, x0 AS lx0, y0 AS ly0, x1 AS lx1 FROM span WHERE ord = 1)"
WITH_LABEL = f"WITH {SPANS}, {LABEL}"


def _spans(page=1):
    """The spans of a page as structs; the second page repeats the first a little lower, with marked values."""

    def one(o, text, x, y, width):
        at = lambda e: F.expr(f"cast({e} as double)") + (2.0 if page == 2 else 0.0)
        said = F.expr(text) if page == 1 or o in TITLES else F.concat(F.expr(text), F.lit("p"))
        sides = F.expr(f"cast({x} as double)"), at(y), F.expr(f"cast({x} + {width} as double)"), at(f"{y} + 8")
        values = [F.lit(page), F.lit(o + 20 * (page - 1)), F.lit(0 if o < 8 else 1), F.lit(o // 3), said, *sides, F.lit(600.0), F.lit(float(HEIGHT))]
        return F.struct(*[v.alias(n) for v, n in zip(values, SPAN_FIELDS, strict=True)])

    return [one(*place) for place in GRID]


def span_array(spark, folder):
    """One row per page with its spans as an array."""
    return spread(table(spark, folder, "orders")).select(F.col("o_orderkey").alias("doc_id"), F.array(*_spans()).alias("spans"))


def _of_place(made):
    """One of the columns of the grid, by the place ``_o`` of the row; only that one is worked out."""
    (first, value), *others = made
    chosen = F.when(F.col("_o") == first, value)
    for o, value in others:
        chosen = chosen.when(F.col("_o") == o, value)
    return chosen


def _unnested(spark, folder, pages):
    """The spans of ``pages`` as rows: each order meets the places of the grid, so no array is built to be unpacked."""
    number = lambda e: F.expr(f"cast({e} as double)")
    orders = spread(table(spark, folder, "orders")).select("o_orderkey", "o_custkey", F.explode(F.lit(pages)).alias("page"))
    places = orders.select("*", F.explode(F.lit([o for o, *_ in GRID])).alias("_o"))
    o, second = F.col("_o"), F.col("page") == 2
    text, y0 = _of_place((o, F.expr(t)) for o, t, *_ in GRID), _of_place((o, number(y)) for o, _, _, y, _ in GRID)
    if 2 in pages:
        text = F.concat(text, F.when(second & ~o.isin(*TITLES), "p").otherwise(""))
        y0 = y0 + F.when(second, 2.0).otherwise(0.0)
    placed = places.select(
        F.col("o_orderkey").alias("doc_id"), "_o", "page", (o + 20 * (F.col("page") - 1)).alias("ord"), F.when(o < 8, 0).otherwise(1).alias("block"),
        F.floor(o / 3).cast("int").alias("line"), text.alias("text"), _of_place((o, number(x)) for o, _, x, _, _ in GRID).alias("x0"), y0.alias("y0"),
        _of_place((o, F.lit(w)) for o, *_, w in GRID).alias("_width"),
    )
    return placed.select(
        "doc_id", "_o", "page", "ord", "block", "line", "text", "x0", "y0", (F.col("x0") + F.col("_width")).alias("x1"), (F.col("y0") + 8).alias("y1"),
        F.lit(600.0).alias("page_width"), F.lit(float(HEIGHT)).alias("page_height"),
    )


def span_rows(spark, folder):
    return _unnested(spark, folder, [1]).drop("_o")


_NEAREST = """SELECT doc_id, arg_min(text, (kind, gap, ord)) AS value FROM (
  SELECT doc_id, text, ord, CASE WHEN {row} AND abs(y0 - ly0) <= 3 AND x0 > lx1 - 2 THEN 0 WHEN {col} AND y0 > ly0 AND y0 - ly0 <= 45 AND abs(x0 - lx0) <= 14 THEN 1 END AS kind,
    CASE WHEN kind = 0 THEN x0 - lx1 ELSE y0 - ly0 END AS gap
  FROM span JOIN lab USING (doc_id, page) WHERE ord <> lo AND text <> 'Neta') WHERE kind IS NOT NULL GROUP BY doc_id"""


@query(f"{WITH_LABEL} {_NEAREST.format(row='true', col='true')}")
def nearest_value_same_row(spark, folder):
    """Value right of the label, else below: join on the page, partial aggregation."""
    spans = span_rows(spark, folder)
    found = layout.nearest_values(spans, layout.label_spans(spans, "total"), exclude=["neta"])
    return layout.first_page_value(found)


@query(f"{WITH_LABEL} {_NEAREST.format(row='false', col='true')}")
def column_below(spark, folder):
    """Value below the label only."""
    spans = span_rows(spark, folder)
    return layout.nearest_values(spans, layout.label_spans(spans, "Total", exact=True), exclude=["neta"], same_row=False).drop("page")


@query(f"{WITH_LABEL}, f AS ({_NEAREST.format(row='true', col='true')}) SELECT o_orderkey AS doc_id, value FROM orders LEFT JOIN f ON doc_id = o_orderkey")
def nearest_value_in_arrays(spark, folder):
    """The same inside one row, without a shuffle."""
    pages = span_array(spark, folder)
    value = layout.over_pages(F.col("spans"), "total", None, lambda part, label: layout.nearest_value(part, label, ["neta"]))
    return pages.select("doc_id", value.alias("value"))


_COLUMN = f"""{WITH_LABEL}, u AS (SELECT doc_id, text, y0, row_number() OVER (PARTITION BY doc_id ORDER BY y0, ord) AS rn, lag(y0) OVER (PARTITION BY doc_id ORDER BY y0, ord) AS py
  FROM span JOIN lab USING (doc_id, page) WHERE ord <> lo AND y0 > ly0 AND y0 - ly0 <= 90 AND abs(x0 - lx0) <= 14 AND text <> 'Neta'),
c AS (SELECT *, sum(CASE WHEN y0 - py > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY rn) AS broken FROM u WHERE rn <= 4)
SELECT doc_id, string_agg(text, ' ' ORDER BY rn) AS value FROM c WHERE broken = 0 GROUP BY doc_id"""


@query(_COLUMN)
def column_multiline(spark, folder):
    """Lines below the label up to the first gap, table form."""
    spans = span_rows(spark, folder)
    return layout.column_values(spans, layout.label_spans(spans, "Total"), exclude=["neta"]).drop("page")


@query(_COLUMN)
def column_multiline_in_arrays(spark, folder):
    """The same inside one row."""
    s = F.col("spans")
    return span_array(spark, folder).select("doc_id", layout.column_lines(s, layout.find_label(s, "Total"), ["neta"]).alias("value"))


@query(f"""WITH {SPANS} SELECT doc_id, max(text) FILTER (ord = 2) AS after_label, max(text) FILTER (ord = 5) AS next_row,
  CASE WHEN contains(max(text) FILTER (ord = 2), '1') THEN max(text) FILTER (ord = 2) END AS first_with_one FROM span GROUP BY doc_id""")
def table_row_value(spark, folder):
    """Spans after a label in its text line, and the value of a table row."""
    s = F.col("spans")
    rows = layout.layout_lines(s)
    next_row = layout.table_row(rows, ["total", "contratante"], r"(Zzz\d+)", lambda v: v.isNotNull())
    return span_array(spark, folder).select(
        "doc_id", layout.after_label_in_line(F.filter(s, lambda x: x["ord"] < 8), "total", lambda t: t).alias("after_label"),
        F.split(next_row, " ")[2].alias("next_row"),
        layout.after_label_in_line(F.filter(s, lambda x: x["ord"] < 8), "total", lambda t: F.when(F.contains(t, F.lit("1")), t)).alias("first_with_one"),
    )


@query("""SELECT o_orderkey AS doc_id, CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE 'B' || o_orderkey || ' Neta C' || o_custkey END AS value FROM orders""")
def table_row_inline(spark, folder):
    """Value in the header row itself where it has the shape, else the next row."""
    rows = layout.layout_lines(F.col("spans"))
    value = layout.table_row(rows, ["total", "contratante"], r"total a(\d*[02468])$", lambda v: v.isNotNull())
    return span_array(spark, folder).select("doc_id", value.alias("value"))


def _zone_sql(spans: str, where: str, keys: str = "doc_id") -> str:
    """Texts of a zone: a blank within a line, a line break between lines."""
    return f"""SELECT {keys}, string_agg(gap || text, '' ORDER BY ord) AS t FROM (SELECT {keys}, ord, text,
  CASE WHEN lag(y0) OVER w IS NULL THEN '' WHEN abs(y0 - lag(y0) OVER w) <= 3 THEN ' ' ELSE chr(10) END AS gap
  FROM {spans} WHERE {where} WINDOW w AS (PARTITION BY {keys} ORDER BY ord)) GROUP BY {keys}"""


@query(f"""WITH {SPANS}, zone AS ({_zone_sql('span', f'y0 >= 0.140625 * {HEIGHT} - 5 AND y1 <= 0.171875 * {HEIGHT} + 5')}),
every AS (SELECT doc_id, string_agg(text, ' ' ORDER BY ord) AS t FROM span GROUP BY doc_id),
sec AS (SELECT doc_id, count(*) AS n FROM span WHERE y0 >= 20 AND y0 < 300 GROUP BY doc_id)
SELECT e.doc_id, n AS in_section, coalesce(nullif(regexp_extract(z.t, '(D\\d)', 1), ''), nullif(regexp_extract(e.t, '(D\\d)', 1), '')) AS value, z.t AS zone_text
FROM every e LEFT JOIN zone z USING (doc_id) LEFT JOIN sec USING (doc_id)""")
def zone_then_text(spark, folder):
    """Pattern on a zone of the page, else on the whole text; spans of a section."""
    from fieldloom.functions.regex import apply_pattern
    from fieldloom.functions.text import present

    spans = span_rows(spark, folder)
    zones = spark.createDataFrame([(1, 1, 0.140625, 0.171875)], "rule_id bigint, page int, top double, bottom double")
    zone = layout.zone_texts(spans, zones).select("doc_id", F.col("text").alias("zone_text"))
    whole = span_array(spark, folder).select("doc_id", F.array_join(F.transform("spans", lambda s: s["text"]), " ").alias("text"))
    section = layout.section_spans(spans, layout.label_spans(spans, "contratante"), layout.label_spans(spans, "agente"))
    counts = section.groupBy("doc_id").agg(F.count(F.lit(1)).alias("in_section"))
    value = F.coalesce(present(apply_pattern(F.col("zone_text"), r"(D\d)")), present(apply_pattern(F.col("text"), r"(D\d)")))
    return whole.join(zone, "doc_id", "left").join(counts, "doc_id", "left").select("doc_id", "in_section", value.alias("value"), "zone_text")


# ---- two pages, two products ------------------------------------------------------------

# page 1 lacks the values of every third document; page 2 repeats the page with marked values, and its lower
# title is absent from every fourth
PAGES = f"""{SPANS}, pages AS (SELECT doc_id, doc_id % 2 + 1 AS product_id, page, ord, text, x0, y0, x1, y1 FROM span WHERE NOT (doc_id % 3 = 0 AND ord IN (2, 3, 5, 6, 7))
  UNION ALL SELECT doc_id, doc_id % 2 + 1, 2, ord + 20, CASE WHEN ord IN (0, 1, 4, 8, 10) THEN text ELSE text || 'p' END, x0, y0 + 2, x1, y1 + 2 FROM span
  WHERE NOT (doc_id % 4 = 1 AND ord = 8))"""


def page_array(spark, folder):
    """One row per document with the spans of both its pages."""
    doc = F.col("doc_id")
    made = spread(table(spark, folder, "orders")).select(F.col("o_orderkey").alias("doc_id"), F.array(*_spans(1)).alias("first"), F.array(*_spans(2)).alias("second"))
    # a page that is whole is taken as it is
    first = F.when(doc % 3 != 0, F.col("first")).otherwise(F.filter("first", lambda s: ~((doc % 3 == 0) & s["ord"].isin(*VALUES))))
    second = F.when(doc % 4 != 1, F.col("second")).otherwise(F.filter("second", lambda s: ~((doc % 4 == 1) & (s["ord"] == 28))))
    both = made.select("doc_id", F.concat(first, second).alias("spans"))
    text = F.array_join(F.transform("spans", lambda s: s["text"]), " ")
    return both.select("doc_id", (doc % 2 + 1).alias("product_id"), text.alias("text"), "spans")


def page_rows(spark, folder):
    """The same, one row per span."""
    doc, o, page = F.col("doc_id"), F.col("_o"), F.col("page")
    rows = _unnested(spark, folder, [1, 2]).filter(~((page == 1) & (doc % 3 == 0) & o.isin(*VALUES)) & ~((page == 2) & (doc % 4 == 1) & (o == 8)))
    return rows.drop("_o").select("doc_id", (doc % 2 + 1).alias("product_id"), *SPAN_FIELDS)


@query(f"""WITH {PAGES}, lab AS (SELECT doc_id, page, ord AS lo, x0 AS lx0, y0 AS ly0, x1 AS lx1 FROM pages WHERE ord IN (1, 21)),
placed AS (SELECT doc_id, page, text, ord, CASE WHEN abs(y0 - ly0) <= 3 AND x0 > lx1 - 2 THEN 0 WHEN y0 > ly0 AND y0 - ly0 <= 45 AND abs(x0 - lx0) <= 14 THEN 1 END AS kind,
  CASE WHEN kind = 0 THEN x0 - lx1 ELSE y0 - ly0 END AS gap FROM pages JOIN lab USING (doc_id, page) WHERE ord <> lo AND text <> 'Neta'),
f AS (SELECT doc_id, arg_min(text, (page, kind, gap, ord)) AS value FROM placed WHERE kind IS NOT NULL GROUP BY doc_id)
SELECT o_orderkey AS doc_id, value, value AS value_in_row FROM orders LEFT JOIN f ON doc_id = o_orderkey""")
def first_page_value(spark, folder):
    """Value of the first page whose label has one, in the table form and inside one row."""
    docs, spans = page_array(spark, folder), page_rows(spark, folder)
    found = layout.first_page_value(layout.nearest_values(spans, layout.label_spans(spans, "total"), exclude=["neta"]))
    in_row = layout.over_pages(F.col("spans"), "total", None, lambda part, label: layout.nearest_value(part, label, ["neta"]))
    return docs.select("doc_id", in_row.alias("value_in_row")).join(found, "doc_id", "left")


@query(f"""WITH {PAGES}, title AS (SELECT doc_id, max(page) AS page FROM pages WHERE text = 'AGENTE' GROUP BY doc_id),
low AS (SELECT doc_id, page, y0 AS ty FROM pages JOIN title USING (doc_id, page) WHERE text = 'AGENTE')
SELECT doc_id, page, max(text) AS agent_key, count(*) AS n FROM pages JOIN low USING (doc_id, page) WHERE y0 > ty AND y0 <= ty + 40 GROUP BY ALL""")
def last_page_band(spark, folder):
    """Spans below the title on the last of several pages that has it."""
    band = layout.band_below_title(page_rows(spark, folder), "AGENTE")
    return band.groupBy("doc_id", "page").agg(F.max("text").alias("agent_key"), F.count(F.lit(1)).alias("n"))


# rule, product, field, pattern, page and the two bounds of its zone
ZONE_RULES = [
    (1, 1, "clave", r"(D\d)", 1, 0.140625, 0.171875),
    (2, 1, "cliente", r"C(\d+)", 2, 0.12, 0.16),
    (3, 1, "par", r"C(\d+)p?\nD", 2, 0.13, 0.2),
    (4, 2, "clave", r"(D\dp)", 2, 0.140625, 0.171875),
    (5, 2, "agente", r"K(\d+)", 1, 0.3625, 0.45),
    (6, 2, "total", r"B(\d+)", None, None, None),
]
_BOX = "rule(rule_id, product_id, field, pattern, page, top, bottom) AS (VALUES " + ", ".join(
    f"({r}, {p}, '{f}', '{x}', {pg or 'NULL'}, {t or 'NULL'}, {b or 'NULL'})" for r, p, f, x, pg, t, b in ZONE_RULES) + ")"
_ZONED = f"""WITH {PAGES}, {_BOX}, held AS (SELECT rule_id, doc_id, ord, text, y0 FROM pages JOIN rule USING (product_id, page)
  WHERE y0 >= greatest(0, top * {HEIGHT} - 5) AND y1 <= least({HEIGHT}, bottom * {HEIGHT} + 5)), zone AS ({_zone_sql('held', 'true', 'rule_id, doc_id')})"""


def zone_rules(spark):
    box = F.when(F.col("page").isNotNull(), F.struct("page", F.lit(0.0).alias("x0"), "top", F.lit(1.0).alias("x1"), "bottom"))
    rows = spark.createDataFrame(ZONE_RULES, "rule_id bigint, product_id bigint, field string, pattern string, page int, top double, bottom double")
    return rows.select("*", box.alias("bbox"), F.lit(True).alias("active"), F.lit(False).alias("draft"))


@query(f"{_ZONED} SELECT rule_id, doc_id, t AS text FROM zone")
def zone_texts(spark, folder):
    """Texts of the zones of each product on their pages, table form."""
    zones = zone_rules(spark).filter("page IS NOT NULL").select("rule_id", "product_id", "page", "top", "bottom")
    return layout.zone_texts(page_rows(spark, folder), zones)


@query(f"""{_ZONED}, doc AS (SELECT doc_id, product_id, string_agg(text, ' ' ORDER BY ord) AS t FROM pages GROUP BY ALL),
found AS (SELECT doc_id, rule_id, field, coalesce(nullif(regexp_extract(z.t, pattern, 1), ''), nullif(regexp_extract(d.t, pattern, 1), '')) AS value
  FROM doc d JOIN rule USING (product_id) LEFT JOIN zone z USING (rule_id, doc_id))
SELECT *, CASE WHEN value IS NULL THEN 'no_encontrado' ELSE 'regla' END AS method FROM found""")
def zone_rule_fields(spark, folder):
    """Rules of two products with zones on two pages, each on its zone, else on the whole text."""
    ruled = rule_fields(page_array(spark, folder), zone_rules(spark), spans="spans")
    return unpack(ruled, ["doc_id"], "rule_fields").select("doc_id", "rule_id", "field", "value", "method")


@query(f"""WITH {SPANS} SELECT doc_id, max(text) FILTER (ord = 9 AND y0 <= 340) AS agent_key, count(*) FILTER (ord = 9 AND y0 <= 340) AS n FROM span GROUP BY doc_id
HAVING count(*) FILTER (ord = 9 AND y0 <= 340) > 0""")
def band_below_title(spark, folder):
    """Spans in the band below a title on the last page that has it."""
    band = layout.band_below_title(span_rows(spark, folder), "AGENTE")
    return band.groupBy("doc_id").agg(F.max("text").alias("agent_key"), F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey AS doc_id, s.block, s.line, s.span, s.text, s.x0 FROM orders, (SELECT unnest([
  {'block': 0, 'line': 0, 'span': 0, 'k': 1}, {'block': 0, 'line': 1, 'span': 1, 'k': 2}, {'block': 1, 'line': 0, 'span': 0, 'k': 3}]) AS g) t,
  LATERAL (SELECT g.block, g.line, g.span, CASE g.k WHEN 1 THEN 'N' || o_custkey WHEN 2 THEN o_orderpriority ELSE o_orderstatus END AS text, CAST(o_orderkey % 10 + g.k AS DOUBLE) AS x0) s""")
def flatten_spans(spark, folder):
    """Nested page layout to one row per non-empty span."""
    box = lambda k: F.array(*[(F.col("o_orderkey") % 10 + k).cast("double") for _ in range(4)])
    span = lambda text, k: F.struct(text.alias("text"), box(k).alias("bbox"))
    line = lambda *spans: F.struct(F.array(*spans).alias("spans"))
    block = lambda *lines: F.struct(F.array(*lines).alias("lines"))
    blocks = F.array(
        block(line(span(F.concat(F.lit(" N"), F.col("o_custkey"), F.lit("\t")), 1)), line(span(F.lit("  "), 2), span(F.col("o_orderpriority"), 2))),
        block(line(span(F.col("o_orderstatus"), 3), span(F.lit(""), 4))),
    )
    pages = table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), blocks.alias("blocks"))
    return layout.flatten_spans(pages).select("doc_id", "block", "line", "span", "text", "x0")


