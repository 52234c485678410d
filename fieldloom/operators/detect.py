"""Classification of documents in a three-level catalogue by weighted hits.

A keyword found in the lower-case text gives one point, a pattern three.  The
best company wins, then the best of its lines, then the best of that line's
products.  With a catalogue of ordinary size this is one pass over the documents
without any shuffle; larger catalogues go through ``detect_by_join``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom import model as m
from fieldloom.functions.regex import prepare, prepare_column
from fieldloom.functions.text import fleet_heading, product_of_type
from fieldloom.operators.bounds import join_small, literal, rows_within
from fieldloom.functions.literals import literals_column
from fieldloom.operators.terms import contains_join, pattern_hits
from fieldloom.session import materialize

MAX_ENTRIES = 20_000
ENTRY = "struct<id:bigint,name:string,kw:array<string>,pt:array<string>,nk:int,np:int>"


def catalogue_from_tables(companies: DataFrame, lines: DataFrame, products: DataFrame) -> DataFrame:
    """One catalogue table from the three stored tables (Spanish column names)."""

    def level(df, name, parent, priority):
        return df.select(
            F.lit(name).alias("level"),
            F.col("id").cast("bigint").alias("id"),
            (F.col(parent).cast("bigint") if parent else F.lit(None).cast("bigint")).alias("parent_id"),
            F.col("nombre").alias("name"),
            F.col("nombre_exportacion").alias("alias"),
            "keywords",
            F.col("patrones_deteccion").alias("patterns"),
            F.col("activo").alias("active"),
            (F.col("prioridad").cast("int") if priority else F.lit(None).cast("int")).alias("priority"),
        )

    return (
        level(companies, m.COMPANY, None, True)
        .unionByName(level(lines, m.LINE, "compania_id", False))
        .unionByName(level(products, m.PRODUCT, "ramo_id", True))
    )


def active_only(catalogue: DataFrame) -> DataFrame:
    return catalogue.filter(F.col("active"))


def _entries(rows, level: str) -> list[dict]:
    """Active entries of one level in tie order: priority (none last), then id."""
    chosen = [r for r in rows if r["level"] == level]
    chosen.sort(key=lambda r: (level != m.LINE and r["priority"] is None,
                               (r["priority"] or 0) if level != m.LINE else 0, r["id"]))
    out = []
    for r in chosen:
        keywords, patterns = list(r["keywords"] or []), list(r["patterns"] or [])
        ready = [p.java for p in map(prepare, patterns) if p]
        out.append({"id": r["id"], "parent": r["parent_id"], "name": r["name"], "kw": [k.lower() for k in keywords],
                    "pt": ready, "nk": len(keywords), "np": len(patterns)})
    return out


def _scored(entries: Column, text: Column) -> Column:
    """Entries with their score, best first; equal scores keep the tie order."""
    scored = F.transform(
        entries,
        lambda e, i: F.struct(
            (
                m.KEYWORD_POINTS * F.size(F.filter(e["kw"], lambda k: F.contains(text, k)))
                + m.PATTERN_POINTS * F.size(F.filter(e["pt"], lambda p: F.rlike(text, p)))
            ).alias("score"),
            (-i).alias("tie"),
            e["id"].alias("id"), e["name"].alias("name"), e["np"].alias("n_patterns"), e["nk"].alias("n_keywords"),
        ),
    )
    return F.sort_array(scored, asc=False)


def _winner(scored: Column) -> Column:
    return F.get(F.filter(F.slice(scored, 1, 1), lambda s: s["score"] > 0), F.lit(0))


def confidence_level(company_id: Column, line_id: Column, product_id: Column, total: Column) -> Column:
    """Level from the detected ids and the total of the three scores."""
    return (
        F.when(product_id.isNotNull() & (total >= m.HIGH_TOTAL), m.HIGH)
        .when(line_id.isNotNull() & (total >= m.MEDIUM_TOTAL), m.MEDIUM)
        .when(company_id.isNotNull(), m.LOW)
        .otherwise(m.NO_DATA)
    )


def detection_method(score_company: Column) -> Column:
    return F.when(score_company >= m.PATTERN_POINTS, m.DETECTED_BY_PATTERNS).otherwise(m.DETECTED_BY_KEYWORDS)


def _finish(df: DataFrame) -> DataFrame:
    total = F.col("score_company") + F.col("score_line") + F.col("score_product")
    return df.withColumn(
        "confidence", confidence_level(F.col("company_id"), F.col("line_id"), F.col("product_id"), total)
    ).withColumn("detection_method", detection_method(F.col("score_company")))


def detect(docs: DataFrame, catalogue: DataFrame, text: str = "text", max_entries: int = MAX_ENTRIES) -> DataFrame:
    """Add company, line, product, their scores, confidence and the top-3 companies.

    Beyond ``max_entries`` catalogue rows the join form is used.
    """
    rows = rows_within(active_only(catalogue), max_entries)
    if rows is None:
        return detect_by_join(docs, catalogue, text)

    def children(level):
        by_parent: dict[str, list] = {}
        for e in _entries(rows, level):
            by_parent.setdefault(str(e["parent"]), []).append(e)
        return literal(by_parent, f"map<string,array<{ENTRY}>>")

    def of_parent(level, parent):
        return F.coalesce(F.try_element_at(children(level), F.col(parent)["id"].cast("string")), F.array().cast(f"array<{ENTRY}>"))

    low = F.col("_low")
    companies = literal(_entries(rows, m.COMPANY), f"array<{ENTRY}>")
    staged = (
        docs.withColumn("_low", F.lower(text))
        .withColumn("_companies", _scored(companies, low))
        .withColumn("_company", _winner(F.col("_companies")))
        .withColumn("_line", _winner(_scored(of_parent(m.LINE, "_company"), low)))
        .withColumn("_product", _winner(_scored(of_parent(m.PRODUCT, "_line"), low)))
    )
    out = staged.select(
        *docs.columns,
        *[F.col(f"_{lv}")[src].alias(dst.format(lv)) for lv in (m.COMPANY, m.LINE, m.PRODUCT)
          for src, dst in (("id", "{}_id"), ("name", "{}"))],
        *[F.coalesce(F.col(f"_{lv}")["score"], F.lit(0)).alias(f"score_{lv}") for lv in (m.COMPANY, m.LINE, m.PRODUCT)],
        F.transform(
            F.slice("_companies", 1, 3),
            lambda c: F.struct(*[c[k].alias(k) for k in ("id", "name", "score", "n_patterns", "n_keywords")]),
        ).alias("candidates"),
    )
    return _finish(out)


def detect_by_join(docs: DataFrame, catalogue: DataFrame, text: str = "text") -> DataFrame:
    """Same result for a catalogue of any size.

    Hits are found by seed joins and batched pattern passes, summed per
    (document, entry) and resolved level by level; the text is not shuffled
    together with the hits.
    """
    entries = active_only(catalogue).withColumn(
        "tie", F.when(F.col("level") == m.LINE, F.lit(None)).otherwise(F.col("priority"))
    )
    plain = docs.select("doc_id", F.col(text).alias("text"))
    key = F.struct("level", "id")
    # one term may serve many entries: look for it once
    words = entries.select(key.alias("entry"), F.explode("keywords").alias("term")).filter(F.col("term") != "")
    words = words.withColumn("term_id", F.xxhash64(F.lower("term")))
    regex = entries.select(key.alias("entry"), F.explode("patterns").alias("pattern"))
    regex = regex.withColumn("ready", prepare_column("pattern")).withColumn("literals", literals_column("pattern")).filter("ready.java is not null")
    regex = regex.withColumn("java", F.col("ready.java")).withColumn("term_id", F.xxhash64("java"))
    word_hits = contains_join(plain, words.select("term_id", F.lower("term").alias("term")).distinct()).select("doc_id", "term_id")
    regex_hits = pattern_hits(plain, regex.select("term_id", "java", "literals").distinct())
    points = (
        word_hits.join(words, "term_id").select("doc_id", "entry", F.lit(m.KEYWORD_POINTS).alias("p"))
        .unionByName(regex_hits.join(regex, "term_id").select("doc_id", "entry", F.lit(m.PATTERN_POINTS).alias("p")))
    )
    # an empty keyword is in every text; such entries are few, so their list is written into the plan
    empty = entries.select(F.col("level").alias("level"), F.col("id").alias("id"), F.size(F.filter("keywords", lambda k: k == "")).alias("n")).filter("n > 0")
    always = [r.asDict() for r in empty.toLocalIterator()]
    if always:
        everywhere = literal(always, f"array<{empty.schema.simpleString()}>")
        added = plain.filter(F.col("text").isNotNull()).select("doc_id", F.explode(everywhere).alias("e"))
        fields_ = points.schema["entry"].dataType.fieldNames()
        points = points.unionByName(added.select("doc_id", F.struct(*[F.col(f"e.{f}").alias(f) for f in fields_]).alias("entry"), (F.col("e.n") * m.KEYWORD_POINTS).cast("int").alias("p")))
    scores = points.groupBy("doc_id", "entry").agg(F.sum("p").cast("int").alias("score")).select("doc_id", "entry.level", "entry.id", "score")
    described = join_small(
        scores,
        entries.select("level", "id", "parent_id", "name", "tie",
                       F.coalesce(F.size("patterns"), F.lit(0)).alias("n_patterns"),
                       F.coalesce(F.size("keywords"), F.lit(0)).alias("n_keywords")),
        ["level", "id"],
    )
    # hits are few compared to the texts; written once, read by every level below
    described = materialize(described).withColumn(
        "r", F.struct(F.col("score"), (-F.coalesce(F.col("tie"), F.lit(2**31 - 1))).alias("t"), (-F.col("id")).alias("i"),
                      "id", "name", "n_patterns", "n_keywords")
    )

    def best(level, parent_of):
        d = described.filter(F.col("level") == level)
        if parent_of is not None:
            parent, column = parent_of
            d = d.join(parent.select("doc_id", F.col(column)["id"].alias("parent_id")), ["doc_id", "parent_id"], "left_semi")
        return d.groupBy("doc_id").agg(F.max("r").alias(f"_{level}"))

    company = best(m.COMPANY, None)
    line = best(m.LINE, (company, "_company"))
    product = best(m.PRODUCT, (line, "_line"))
    # candidates: at most three per document, filled up with unhit companies in tie order
    hit_companies = described.filter(F.col("level") == m.COMPANY)
    top = hit_companies.groupBy("doc_id").agg(F.slice(F.sort_array(F.collect_list("r"), asc=False), 1, 3).alias("_top"))
    fill = [
        {"id": r["id"], "name": r["name"], "score": 0, "n_patterns": r["np"], "n_keywords": r["nk"]}
        for r in entries.filter(F.col("level") == m.COMPANY)
        .select("id", "name", "tie", F.coalesce(F.size("patterns"), F.lit(0)).alias("np"), F.coalesce(F.size("keywords"), F.lit(0)).alias("nk"))
        .orderBy(F.asc_nulls_last("tie"), "id").limit(3).collect()
    ]
    candidate = "array<struct<id:bigint,name:string,score:int,n_patterns:int,n_keywords:int>>"
    filler = literal(fill, candidate)
    parts = company.join(line, "doc_id", "left").join(product, "doc_id", "left").join(top, "doc_id", "left")
    out = docs.join(parts, "doc_id", "left")
    named = F.coalesce(
        F.transform("_top", lambda c: F.struct(*[c[k].alias(k) for k in ("id", "name", "score", "n_patterns", "n_keywords")])),
        F.array().cast(candidate),
    )
    unhit = F.filter(filler, lambda c: ~F.exists(named, lambda h: h["id"] == c["id"]))
    out = out.select(
        *docs.columns,
        *[F.col(f"_{lv}")[src].alias(dst.format(lv)) for lv in (m.COMPANY, m.LINE, m.PRODUCT)
          for src, dst in (("id", "{}_id"), ("name", "{}"))],
        *[F.coalesce(F.col(f"_{lv}")["score"], F.lit(0)).alias(f"score_{lv}") for lv in (m.COMPANY, m.LINE, m.PRODUCT)],
        F.slice(F.concat(named, unhit), 1, 3).alias("candidates"),
    )
    return _finish(out)


def needs_patterns(detected: DataFrame, catalogue: DataFrame, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """Flag documents with a detected level that has no pattern yet."""
    bare = active_only(catalogue).filter(F.coalesce(F.size("patterns"), F.lit(0)) <= 0).select("level", "id")
    out = detected
    for level in (m.COMPANY, m.LINE, m.PRODUCT):
        of_level = bare.filter(F.col("level") == level).select(F.col("id").alias(f"{level}_id"), F.lit(True).alias(f"_bare_{level}"))
        out = join_small(out, of_level, f"{level}_id", "left", max_entries)
    flags = [F.coalesce(F.col(f"_bare_{lv}"), F.lit(False)) for lv in (m.COMPANY, m.LINE, m.PRODUCT)]
    return out.select(*detected.columns, (flags[0] | flags[1] | flags[2]).alias("needs_patterns"))


def override_product(detected: DataFrame, catalogue: DataFrame, wanted: Column) -> DataFrame:
    """Replace the product by the active product named ``wanted`` in the same line.

    Scores and confidence stay as detected.
    """
    products = active_only(catalogue).filter(F.col("level") == m.PRODUCT)
    named = products.groupBy(F.col("parent_id").alias("line_id"), F.col("name").alias("_wanted")).agg(F.min("id").alias("_pid"))
    joined = join_small(detected.withColumn("_wanted", wanted), named, ["line_id", "_wanted"], "left")
    swap = F.col("_pid").isNotNull()
    return joined.select(
        *[c for c in detected.columns if c not in ("product_id", "product")],
        F.coalesce(F.col("_pid"), F.col("product_id")).alias("product_id"),
        F.when(swap, F.col("_wanted")).otherwise(F.col("product")).alias("product"),
    )


def wanted_product(company: Column, vehicle_type: Column, text: Column, by_type: str, by_heading: str) -> Column:
    """Product name asked for by the document itself: by vehicle type or fleet heading."""
    return F.when(company == by_type, product_of_type(vehicle_type)).when(company == by_heading, fleet_heading(text))


def model_confidence(value: Column) -> Column:
    """Level of a numeric confidence."""
    return (
        F.when(value >= m.MODEL_HIGH, m.HIGH)
        .when(value >= m.MODEL_MEDIUM, m.MEDIUM)
        .when(value > 0, m.LOW)
        .otherwise(m.NO_DATA)
    )


