"""Lookups by place on the page against brute force."""

import random

from pyspark.sql import functions as F

from fieldloom.operators import fields as fl
from fieldloom.operators import layout
from fieldloom.workloads import geometry

SCHEMA = "doc_id bigint, product_id bigint, page int, ord int, text string, x0 double, y0 double, x1 double, y1 double, page_height double"


def made(seed=3, docs=6, spans=60):
    """Crowded pages: heights below the page's edge, above its top, far beyond it and unknown ones."""
    rng = random.Random(seed)
    rows = []
    for d in range(docs):
        height = rng.choice([60.0, 300.0, 800.0])
        for page in (1, 2):
            for i in range(spans):
                x, y = float(rng.randint(0, 12) * 10), rng.choice([rng.uniform(-10, height + 10), float(rng.randint(0, 20) * 10), 20_000.0 + i, None])
                tall = rng.choice([0.0, 4.0, 8.0, 30.0])
                rows.append((d, d % 2 + 1, page, page * 1000 + i, rng.choice(["Total", "Neta", f"v{i}", f"w{i}"]), x, y, x + 20, None if y is None else y + tall, height))
    return rows


def brute_nearest(rows, max_dy=45, tol_x=14, tol_row=3):
    out = {}
    for d, page in {(r[0], r[2]) for r in rows}:
        mine = sorted((r for r in rows if (r[0], r[2]) == (d, page)), key=lambda r: r[3])
        mark = next((r for r in mine if "total" in r[4].lower()), None)
        if mark is None or mark[6] is None:
            continue
        best = []
        for r in mine:
            if r[3] == mark[3] or r[4].lower() == "neta" or r[6] is None:
                continue
            dy = r[6] - mark[6]
            if abs(dy) <= tol_row and r[5] > mark[7] - 2:
                best.append((0, r[5] - mark[7], r[3], r[4]))
            elif 0 < dy <= max_dy and abs(r[5] - mark[5]) <= tol_x:
                best.append((1, dy, r[3], r[4]))
        if best:
            out[d, page] = min(best)[3]
    return out


def test_grid_finds_what_all_pairs_find(spark):
    for seed in (3, 4):
        rows = made(seed)
        spans = spark.createDataFrame(rows, SCHEMA)
        for max_dy in (45, 400, 30_000):
            got = layout.nearest_values(spans, layout.label_spans(spans, "total"), exclude=["neta"], max_dy=max_dy)
            assert {(r["doc_id"], r["page"]): r["value"] for r in got.collect()} == brute_nearest(rows, max_dy)


def test_sections_take_half_open_bands(spark):
    rows = made(5)
    spans = spark.createDataFrame(rows, SCHEMA)
    bounds = spark.createDataFrame([(d, p, a) for d in range(6) for p, a in ((1, 10.0), (2, 50.0))], "doc_id bigint, page int, l_y0 double")
    ends = spark.createDataFrame([(d, 1, 100.0) for d in range(3)], "doc_id bigint, page int, l_y0 double")
    got = {(r["doc_id"], r["ord"]) for r in layout.section_spans(spans, bounds, ends).collect()}
    start = {1: 10.0, 2: 50.0}
    stop = lambda d, p: 100.0 if d < 3 and p == 1 else start[p] + 200
    assert got == {(r[0], r[3]) for r in rows if r[6] is not None and start[r[2]] <= r[6] < stop(r[0], r[2])}


def zones(spark, n=60):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        a, b = sorted((rng.choice([rng.random(), rng.randint(0, 20) / 20]), rng.choice([rng.random(), rng.randint(0, 20) / 20])))
        rows.append((i, rng.choice([1, 2]), rng.choice([1, 2, 3]), a, b))
    rows += [(900, 1, 1, 0.0, 1.0), (901, 2, 2, -0.2, 1.4), (902, 1, 1, 0.9, 0.1), (903, 1, None, 0.0, 1.0), (904, 1, 1, None, 1.0), (905, 2, 1, 0.3, None), (906, 1, 2, 0.5, 0.46)]
    return rows, spark.createDataFrame(rows, "rule_id bigint, product_id bigint, page int, top double, bottom double")


def test_zones_of_products_in_both_forms(spark):
    """Each zone meets the pages of its product only; table and array form give one text, line breaks included."""
    spans = spark.createDataFrame(made(7), SCHEMA)
    rows, table = zones(spark)
    got = {(r["rule_id"], r["doc_id"]): r["text"] for r in layout.zone_texts(spans, table).collect()}
    docs = spans.groupBy("doc_id", "product_id").agg(F.collect_list(F.struct("page", "ord", "text", "y0", "y1", "page_height")).alias("spans"))
    box = F.struct("page", "top", "bottom")
    pairs = docs.join(table, "product_id").select("rule_id", "doc_id", layout.zone_text(F.col("spans"), box).alias("text"))
    want = {(r["rule_id"], r["doc_id"]): r["text"] for r in pairs.collect() if r["text"]}
    assert got == want and len(want) > 50 and any("\n" in t for t in want.values())


def test_lookups_join_on_cells(spark):
    spans = spark.createDataFrame(made(), SCHEMA)
    _, table = zones(spark)
    for out, keys in ((layout.nearest_values(spans, layout.label_spans(spans, "total")), "_cell"), (layout.zone_texts(spans, table), "_band")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join Inner" in line]
        assert joins and all(keys in line for line in joins)


def test_zone_rules_agree_between_plan_and_table(spark):
    """Rules with zones written into the plan and those met as data give the same rows on two products and pages."""
    spans = spark.createDataFrame(made(11), SCHEMA).filter("y0 IS NOT NULL")
    item = F.struct("page", "ord", "text", "x0", "y0", "x1", "y1", F.lit(600.0).alias("page_width"), "page_height")
    docs = spans.groupBy("doc_id", "product_id").agg(F.array_sort(F.collect_list(item)).alias("spans"))
    docs = docs.withColumn("text", F.array_join(F.transform("spans", lambda s: s["text"]), " "))
    rules = spark.createDataFrame(
        [(i, p, f"f{i}", r"(v\d+)\n" if i % 2 else r"(w\d+)", page, 0.1 * (i % 5), 0.1 * (i % 5) + 0.4) for i, (p, page) in enumerate([(1, 1), (1, 2), (2, 1), (2, 2), (2, None)])],
        "rule_id bigint, product_id bigint, field string, pattern string, page int, top double, bottom double",
    )
    box = F.when(F.col("page").isNotNull(), F.struct("page", F.lit(0.0).alias("x0"), "top", F.lit(1.0).alias("x1"), "bottom"))
    rules = rules.select("rule_id", "product_id", "field", "pattern", F.lit(True).alias("active"), F.lit(False).alias("draft"), box.alias("bbox"))
    forms = [fl.rule_fields(docs, rules, spans="spans", max_unrolled=n) for n in (400, 0)]
    got = [{r["doc_id"]: [tuple(f) for f in r["rule_fields"]] for r in form.collect()} for form in forms]
    assert got[0] == got[1] and any(f[1] for rows in got[0].values() for f in rows)


def test_band_below_title_sends_spans_once(spark):
    """The band is that of brute force; spans are sent by their document, and not again for a grouping of the page."""
    rows = made(13, docs=9)
    spans = spark.createDataFrame(rows, SCHEMA)
    want = set()
    for d in range(9):
        marks = sorted((-r[2], r[3], r[6]) for r in rows if r[0] == d and r[4] == "Total")
        if marks and marks[0][2] is not None:
            want |= {(d, r[3]) for r in rows if (r[0], r[2]) == (d, -marks[0][0]) and r[6] is not None and marks[0][2] < r[6] <= marks[0][2] + 40}
    known = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        band = layout.band_below_title(spans, "Total")
        grouped = band.groupBy("doc_id", "page").agg(F.max("text").alias("t"))
        assert {(r["doc_id"], r["ord"]) for r in band.collect()} == want and want
        plan = grouped._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= 3 and "_cell" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known)


def test_array_form_finds_what_all_pairs_find(spark):
    for seed in (3, 4):
        rows = made(seed)
        spans = spark.createDataFrame(rows, SCHEMA)
        docs = spans.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("page", "ord", "text", "x0", "y0", "x1", "y1"))).alias("s"))
        for reach in ({}, {"max_dy": 400}, {"same_row": False}, {"below": False}, {"max_dx": 30.0}, {"same_row": False, "below": False}):
            value = layout.nearest_value(F.col("s"), layout.find_label(F.col("s"), "total"), ["neta"], **reach)
            got = {(r["doc_id"], r["page"]): r["v"] for r in docs.select("doc_id", "page", value.alias("v")).collect() if r["v"] is not None}
            table = layout.nearest_values(spans, layout.label_spans(spans, "total"), exclude=["neta"], **reach).collect()
            assert got == {(r["doc_id"], r["page"]): r["value"] for r in table}
            if set(reach) <= {"max_dy"}:
                assert got == brute_nearest(rows, **reach)


def test_no_page_is_looked_at_after_a_value(spark):
    spans = "array<struct<page:int, ord:int, text:string>>"
    docs = spark.createDataFrame([(1, [(1, 0, "Total"), (2, 1, "Total")]), (2, None), (3, [])], f"doc_id int, s {spans}")

    def value(part, label):
        return F.when(part[0]["page"] == 1, label["text"]).otherwise(F.raise_error(F.concat(F.lit("page "), part[0]["page"].cast("string"))).cast("string"))

    got = docs.select("doc_id", layout.over_pages(F.col("s"), "total", None, value).alias("v")).collect()
    assert {r["doc_id"]: r["v"] for r in got} == {1: "Total", 2: None, 3: None}


def test_rows_of_pages_are_made_once_each(spark, tmp_path):
    """Rows and arrays hold the same spans; no filter builds a page a second time to see whether it is empty."""
    keys = [(k, None if k == 7 else k * 13) for k in range(1, 41)] + [(None, 3), (5, 65)]
    spark.createDataFrame(keys, "o_orderkey bigint, o_custkey bigint").write.parquet(str(tmp_path / "orders.parquet"))
    for rows, array in ((geometry.span_rows, geometry.span_array), (geometry.page_rows, geometry.page_array)):
        made_rows, arrays = rows(spark, str(tmp_path)), array(spark, str(tmp_path))
        unpacked = arrays.select(*[c for c in arrays.columns if c in ("doc_id", "product_id")], F.inline("spans"))
        assert made_rows.dtypes == unpacked.dtypes
        assert sorted(map(repr, made_rows.collect())) == sorted(map(repr, unpacked.collect())) and unpacked.count() > 300
        plan = made_rows._jdf.queryExecution().optimizedPlan().toString()
        assert "size(" not in plan and "lambdafunction" not in plan
