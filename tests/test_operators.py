"""Operators against brute force on small fixtures."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

import samples
from fieldloom import model as m
from fieldloom.operators import detect as det
from fieldloom.operators import fields as fl
from fieldloom.operators import locate as loc
from fieldloom.operators import upkeep
from fieldloom.operators.bounds import salted_join
from fieldloom.operators.terms import contains_join, pattern_hits
from fieldloom.operators.trainer import locate_literals
from fieldloom.functions.literals import required_literals
from fieldloom.functions.regex import prepare
from fieldloom.operators.coverage import pattern_counts, pattern_counts_from

WORDS = ["auto", "automóvil", "a", "pó", "seguro de", "ab", "moto", "o\n"]


def texts(n=60):
    rng = random.Random(5)
    return [(i, " ".join(rng.choice(["Auto", "MOTO", "automóvil", "seguro", "de", "pó", "x", "o\n"]) for _ in range(rng.randint(0, 8)))) for i in range(n)]


def test_contains_join_finds_every_substring(spark):
    docs = texts()
    terms = list(enumerate(WORDS))
    got = {(r["doc_id"], r["term_id"]) for r in contains_join(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(terms, "term_id bigint, term string")).collect()}
    assert got == {(d, t) for d, body in docs for t, w in terms if w in body.lower()}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_contains_join_leaves_texts_in_place(spark):
    # two texts under one id count together; a repeated term counts twice
    docs = spark.createDataFrame([(1, "auto x"), (1, "AUTO y"), (2, "autor"), (3, "aut"), (4, None), (None, "auto")], "doc_id bigint, text string")
    terms = spark.createDataFrame([(7, "Auto"), (7, "Auto"), (8, "r"), (9, "")], "term_id bigint, term string")
    out = contains_join(docs, terms)
    assert sorted(map(tuple, out.collect())) == [(1, 7, "auto")] * 8 + [(2, 7, "auto")] * 2 + [(2, 8, "r")]
    assert "collect_list" not in plan_of(out) and "SortMergeJoin" not in plan_of(out)


def test_offsets_of_the_line_table(spark):
    texts = [(1, "a\nL\nb\nc"), (1, "a\nL\nb\nc"), (2, "L\nL\n\n"), (3, ""), (4, None), (5, "x\rL\x85y\u2028z\n")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    offsets = {"next": 1, "second": 2, "before": -1}
    joined = loc.table_offsets(loc.line_table(docs), F.col("line") == "L", offsets)
    held = loc.table_offsets(loc.line_table(docs, ahead=[1, 2, -1]), F.col("line") == "L", offsets)
    assert sorted(map(repr, joined.collect())) == sorted(map(repr, held.collect()))
    assert {tuple(r) for r in held.collect()} == {(1, "L", "b", "c", "a"), (2, "L", "L", "", None), (2, "L", "", None, "L"), (5, "L", "y", "z", "x")}
    assert "Join" not in plan_of(held) and "SortMergeJoin" in plan_of(joined)


def test_label_lines_are_trimmed_only_where_the_label_is(spark):
    docs = spark.createDataFrame([(1, ["Moneda:", " moneda\t", "x"]), (2, ["MONEDAS", "\u00a0MONEDA", "y"]), (3, None)], "doc_id int, lines array<string>")
    at = lambda test: loc.first_index(F.col("lines"), test)
    assert [tuple(r) for r in docs.select(at(loc.equals("moneda", F.lower)), at(loc.equals("MONEDA"))).collect()] == [(1, None), (1, 1), (None, None)]
    assert "contains(line, MONEDA)" in str(loc.equals("MONEDA")(F.col("line"))).replace("'", "")


def test_pattern_hits_in_batches(spark):
    docs, patterns = texts(), ["^auto", r"seguro\s+de$", "zzz", "[x"]
    ready = [(i, prepare(p).java) for i, p in enumerate(patterns) if prepare(p)]
    got = {(r["doc_id"], r["term_id"]) for r in pattern_hits(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(ready, "term_id bigint, java string"), batch=1).collect()}
    assert got == {(d, i) for d, b in docs for i, p in enumerate(patterns[:3]) if re.search(p, b.lower(), re.I | re.M)}


PATTERNS = ["^auto", r"seguro\s+de$", "zzz", r"p(?:oliza|rima)\s*n", "(?:casa|vida)", r"\d+", "a|b", "(?:responsab)+il", "x?y?z?"]


def test_required_literals():
    assert required_literals(r"p(?:oliza|rima)\s*nueva") == ["nueva"]
    assert required_literals(r"(?:casa|vida)\d") == ["casa", "vida"]
    assert required_literals("(?:ABCD)+x") == ["abcd"]
    for nothing in (r"\d+", "ab", "(?:casa|x)", "(?:casa)?", "[x", "(?x) c a s a", "(?=casa)b"):
        assert required_literals(nothing) is None, nothing


def test_patterns_by_literals_equal_all_patterns(spark):
    docs = texts() + [(900, None), (901, ""), (902, "CA\u017fA nueva vida"), (903, "responsabresponsabilidad")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    many = PATTERNS + [f"nothing{i}" for i in range(10_000)]
    ready = spark.createDataFrame([(i, prepare(p).java, required_literals(p)) for i, p in enumerate(many)], "term_id bigint, java string, literals array<string>")
    got = sorted(map(tuple, pattern_hits(frame, ready).select("doc_id", "term_id").collect()))
    want = sorted(map(tuple, pattern_hits(frame, ready.drop("literals").filter(f"term_id < {len(PATTERNS)}")).select("doc_id", "term_id").collect()))
    assert got == want and (902, 4) in got
    counts = {r["pattern"]: (r["matches"], r["total"], r["valid"]) for r in pattern_counts_from(frame, spark.createDataFrame([(p,) for p in [*PATTERNS, "[x"]], "p string"), "p", limit=0).collect()}
    assert counts == {r["pattern"]: (r["matches"], r["total"], r["valid"]) for r in pattern_counts(frame, [*PATTERNS, "[x"]).collect()}


def brute_detect(body, entries):
    low = body.lower()

    def score(e):
        return sum(k.lower() in low for k in e[5]) + 3 * sum(bool(re.search(p, low, re.I | re.M)) for p in e[6])

    def best(level, parent):
        own = [e for e in entries if e[0] == level and e[7] and (parent is None or e[2] == parent)]
        own.sort(key=lambda e: (level != m.LINE and e[8] is None, 0 if level == m.LINE else e[8] or 0, e[1]))
        own.sort(key=score, reverse=True)
        return (own[0][1], score(own[0])) if own and score(own[0]) > 0 else (None, 0)

    c, cs = best(m.COMPANY, None)
    line, ls = best(m.LINE, c) if c else (None, 0)
    p, ps = best(m.PRODUCT, line) if line else (None, 0)
    total = cs + ls + ps
    level = "alta" if p and total >= 9 else "media" if line and total >= 3 else "baja" if c else "sin_datos"
    return (c, line, p, cs, ls, ps, level)


def test_detection_by_brute_force(spark):
    entries = [
        (m.COMPANY, 1, None, "A", None, ["Auto", "x"], ["^mo"], True, None), (m.COMPANY, 2, None, "B", None, ["moto", "seguro"], [], True, 2),
        (m.COMPANY, 3, None, "C", None, ["pó"], ["de$"], True, 1), (m.LINE, 1, 1, "a", None, ["o"], [], True, None), (m.LINE, 2, 1, "b", None, ["o"], ["x"], True, None),
        (m.LINE, 3, 2, "c", None, ["seg"], [], True, None), (m.LINE, 4, 3, "d", None, ["de"], ["se+g"], True, None), (m.PRODUCT, 1, 1, "p", None, ["a"], ["auto"], True, 2),
        (m.PRODUCT, 2, 1, "q", None, ["a"], ["auto"], True, 1), (m.PRODUCT, 3, 4, "r", None, ["de", "pó"], ["seguro"], True, None), (m.PRODUCT, 4, 3, "s", None, ["x"], [], False, 1),
    ]
    docs = texts(80)
    catalogue = spark.createDataFrame(entries, m.CATALOGUE_SCHEMA)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    cols = ["company_id", "line_id", "product_id", "score_company", "score_line", "score_product", "confidence"]
    for found in (det.detect(frame, catalogue), det.detect_by_join(frame, catalogue)):
        got = {r["doc_id"]: tuple(r[c] for c in cols) for r in found.collect()}
        assert got == {d: brute_detect(b, entries) for d, b in docs}


def test_rule_paths_agree(spark):
    docs = samples.documents(spark).select("doc_id", "text", (F.col("doc_id") + 1).alias("product_id"))
    rules = samples.rules(spark)
    paths = [fl.apply_rules(docs, rules), fl.apply_rules(docs, rules, max_unrolled=0), fl.apply_rules(docs, rules, max_unrolled=0, max_broadcast=1)]
    results = [sorted(map(tuple, p.select("doc_id", "field", "value", "method", "rule_id").collect()), key=str) for p in paths]
    assert results[0] == results[1] == results[2] and results[0]


def test_rules_of_any_number_stay_beside_the_text(spark):
    """401 and 50,000 rules, zones and known fields included, give what unrolled rules give, without moving texts."""
    docs = samples.documents(spark).withColumn("product_id", F.col("doc_id") + 1)
    few = samples.rules(spark)
    known = F.array(F.lit("documento"))
    spans = "spans" if "spans" in docs.columns else None
    want = [(r["doc_id"], sorted(map(str, r["rule_fields"]))) for r in fl.rule_fields(docs, few, spans=spans, exclude=known).collect()]
    assert any(f for _, f in want)
    for n in (401, 50_000):
        more = spark.range(n).select(
            (F.col("id") + 1000).alias("rule_id"), F.lit(77).cast("bigint").alias("product_id"), F.concat(F.lit("f"), "id").alias("field"),
            F.concat(F.lit(r"never(\d+)x"), "id").alias("pattern"), F.lit(True).alias("active"), F.lit(False).alias("draft"), F.lit(None).cast(few.schema["bbox"].dataType).alias("bbox"),
        )
        out = fl.rule_fields(docs, few.unionByName(more.select(few.columns)), spans=spans, exclude=known)
        assert sorted((r["doc_id"], sorted(map(str, r["rule_fields"]))) for r in out.collect()) == sorted(want)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_two_rules_of_a_field_give_one_value(spark):
    docs = spark.createDataFrame([(1, "alpha 12 beta 34", 5)], "doc_id bigint, text string, product_id bigint")
    rows = [(1, 5, "n", r"alpha (\d+)", True, False, None), (2, 5, "n", r"gamma (\d+)", True, False, None), (3, 5, "m", r"beta (\d+)", True, False, None), (4, 5, "m", r"alpha (\d+)", True, False, None)]
    found = fl.apply_rules(docs, spark.createDataFrame(rows, m.RULE_SCHEMA))
    assert found.count() == 4
    assert fl.field_map(found).first()["record"] == {"n": "12", "m": "12"}
    wide = fl.rule_fields(docs, spark.createDataFrame(rows, m.RULE_SCHEMA))
    assert [(f["field"], f["value"], f["rule_id"]) for f in wide.select(fl.best_per_field(F.col("rule_fields")).alias("b")).first()["b"]] == [("m", "12", 4), ("n", "12", 1)]


def test_array_and_table_resolution_agree(spark):
    docs = samples.documents(spark).select("doc_id", "text", (F.col("doc_id") + 1).alias("product_id"))
    fields = samples.product_fields(spark)
    found = fl.apply_rules(docs, samples.rules(spark))
    one = fl.complete_sources(docs, fields, found)
    two = fl.resolve_sources(found.unionByName(fl.fixed_values(docs, fields, found)).unionByName(fl.missing_fields(docs, fields, found)))
    key = lambda df: sorted(map(str, df.select("doc_id", "field", "value", "method").collect()))
    assert key(one) == key(two)


def test_derived_person_type_in_the_long_table(spark):
    rows = [(1, "rfc", "LOMM8001011A2", "regla", 1), (2, "nombre_cliente", "X S.A. de C.V.", "regla", 2), (3, "rfc", "SLE120202M92", "regla", 1), (3, "entidad", "dada", "regla", 3)]
    out = fl.derive_fields(spark.createDataFrame(rows, "doc_id bigint, field string, value string, method string, rule_id bigint"))
    got = {r["doc_id"]: (r["value"], r["method"]) for r in out.filter("field = 'entidad'").collect()}
    assert got == {1: ("Persona Física", "derivado"), 2: ("Persona Moral", "derivado"), 3: ("dada", "regla")}


def test_salted_join_is_a_join(spark):
    left = spark.createDataFrame([(i, 1 if i % 3 else 2) for i in range(50)], "id bigint, k int")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    assert sorted(map(tuple, salted_join(left, right, ["k"], "id", 4).select("id", "v").collect())) == sorted(map(tuple, left.join(right, "k").select("id", "v").collect()))


def test_literals_with_and_without_anchor_words(spark):
    docs = [(1, "uno dos TRES cuatro", 7), (2, "x uno dos tres", 7), (3, "unos dos tres", 7), (4, "uno dos tres", 8), (5, "99817", 7)]
    chosen = [(1, 7, 1, "uno dos tres"), (2, 7, 9, "981"), (3, 7, 9, "o dos t")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, product_id bigint")
    s = spark.createDataFrame(chosen, "selection_id bigint, product_id bigint, doc_id bigint, value string")
    expected = {(i, doc) for i, p, o, v in chosen for doc, body, q in docs if p == q and doc != o and v.lower() in body.lower()}
    for limit in (100, 0):
        got = {(r["selection_id"], r["doc_id"]) for r in locate_literals(s, d, max_selections=limit).collect()}
        assert got == expected


def test_retention_and_duplicates(spark):
    now = dt.datetime(2024, 1, 31)
    rows = [(i, now - dt.timedelta(days=i)) for i in range(12)] + [(50, None), (51, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, created_at timestamp_ntz")
    plan = upkeep.retention_plan(frame, F.lit("2024-01-31").cast("timestamp_ntz"), days=7, cap=4)
    got = {r["doc_id"]: r["reason"] for r in plan.collect()}
    assert got == {8: "age", 9: "age", 10: "age", 11: "age", 50: "cap", 51: "cap", 7: "cap", 6: "cap", 5: "cap", 4: "cap"}
    files = spark.createDataFrame([("a", "h", 3), ("b", "h", 1), ("c", "h", 2), ("d", "i", 9)], "path string, sha256 string, mtime int")
    assert {r["path"] for r in upkeep.duplicates(files).collect()} == {"a", "c"}


def test_sync_is_idempotent(spark):
    current = spark.createDataFrame([(1, "A", 1, True), (2, "B", 2, False), (3, "C", 3, True)], "id int, name string, priority int, active boolean")
    desired = spark.createDataFrame([("A", 5), ("B", 2), ("D", 9)], "name string, priority int")
    once = upkeep.sync_level(current, desired, ["name"], ["priority"])
    got = {r["name"]: (r["priority"], r["active"], r["change"]) for r in once.collect()}
    assert got == {"A": (5, True, "updated"), "B": (2, True, "revived"), "C": (3, False, "retired"), "D": (9, True, "added")}
    twice = upkeep.sync_level(once.drop("change"), desired, ["name"], ["priority"])
    assert {r["change"] for r in twice.collect()} == {"kept"}


def test_one_active_rule(spark):
    rows = [(1, 1, "f", True, False, 1), (2, 1, "f", True, False, 2), (3, 1, "f", True, True, 3), (4, 2, "f", True, None, 1), (5, 1, "g", False, False, 9)]
    rules = spark.createDataFrame(rows, "rule_id int, product_id int, field string, active boolean, draft boolean, created_at int")
    assert {r["rule_id"]: r["active"] for r in upkeep.activate_latest(rules).collect()} == {1: False, 2: True, 3: True, 4: True, 5: False}
    promoted = upkeep.promote_drafts(rules, spark.createDataFrame([(3, 10)], "rule_id int, promoted_at int"))
    got = {r["rule_id"]: (r["active"], r["draft"]) for r in promoted.collect()}
    assert got[3] == (True, False) and got[2] == (False, False)


def test_rename_prefers_the_current_name(spark):
    df = spark.createDataFrame([({"numero_poliza": "1", "x": "2"},), ({"numero_poliza": "1", "documento": "3"},)], "r map<string,string>")
    got = [r["m"] for r in df.select(upkeep.rename_map_keys(F.col("r")).alias("m")).collect()]
    assert got == [{"documento": "1", "x": "2"}, {"documento": "3"}]


def test_line_strategies_at_the_edges(spark):
    lines = ["A", "LABEL", "x", "1.00", "LABEL", "2.00"]
    df = spark.createDataFrame([(lines,)], "l array<string>")
    col, pick = F.col("l"), loc.found(r"\d\.\d\d")
    out = df.select(
        loc.label_offset(col, loc.has("LABEL"), [9, 2], pick).alias("second_offset"), loc.label_offset(col, loc.has("LABEL"), [1], pick).alias("first_only"),
        loc.label_offset(col, loc.has("LABEL"), [1], pick, first_only=False).alias("later_label"), loc.label_window(col, loc.has("LABEL"), 1, 50, pick, "last").alias("last"),
        loc.label_offset(col, loc.has("NONE"), [1], pick).alias("none"), loc.relative_to(col, F.lit("1.00"), -1).alias("before"),
        loc.from_block_end(col, 2).alias("from_end"), loc.from_block_end(col, 20).alias("too_far"),
    ).first()
    assert tuple(out) == ("1.00", None, "2.00", "2.00", None, "x", "LABEL", None)


def test_empty_keywords_score_in_both_forms(spark):
    docs = spark.createDataFrame([(1, "auto"), (2, "poliza"), (3, "nothing")], "doc_id bigint, text string")
    base = samples.catalogue(spark)
    rows = [r.asDict() for r in base.collect()]
    first = next(r for r in rows if r["level"] == m.COMPANY)
    first["keywords"] = [*first["keywords"], ""]
    catalogue = spark.createDataFrame([tuple(r[c] for c in base.columns) for r in rows], base.schema)
    cols = ["doc_id", "company_id", "line_id", "product_id", "score_company", "confidence"]
    one, two = (sorted(map(str, f(docs, catalogue).select(*cols).collect())) for f in (det.detect, det.detect_by_join))
    assert one == two and any(f"score_company={k}" in x for x in one for k in range(1, 9))
