"""Long field table: rules, fixed values, missing fields, resolution, counters.

The common currency is (doc_id, field, value, method, rule_id).  While all
sources of a document sit in its own row they are kept as one array column and
nothing is shuffled; the table forms are for sources stored apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom import model as m
from fieldloom.functions.amounts import derive_person_type
from fieldloom.functions.binding import keep_if, let, let2, regexp_extract
from fieldloom.functions.checks import is_vehicle_line
from fieldloom.functions.regex import apply_pattern, extract_value, prepare, prepare_column
from fieldloom.functions.text import strip
from fieldloom.operators.bounds import MAX_BYTES, join_small, literal, rows_within, unpack
from fieldloom.operators.layout import zone_text

MAX_UNROLLED_RULES = 400
MAX_BROADCAST_RULES = 100_000
MAX_FIELD_LISTS = 50_000
FIELDS = f"array<{m.FIELD_TYPE}>"


# ---- rules -----------------------------------------------------------------

def usable_rules(rules: DataFrame, product_id: int | None = None, drafts: bool = False, ordered: bool = False) -> DataFrame:
    """Active rules (or active drafts); a missing draft flag counts as false.

    ``ordered`` sorts them by field for a listing.
    """
    draft = F.coalesce(F.col("draft"), F.lit(False))
    kept = rules.filter(F.col("active") & (draft if drafts else ~draft))
    if product_id is not None:
        kept = kept.filter(F.col("product_id") == product_id)
    return kept.orderBy("field", "rule_id") if ordered else kept


def screen_rules(rules: DataFrame) -> DataFrame:
    """Add the rewritten pattern; broken patterns keep a NULL there."""
    ready = rules.withColumn("_ready", prepare_column("pattern"))
    return ready.select(*rules.columns, F.col("_ready.java").alias("java"), F.col("_ready.groups").alias("groups"),
                        F.col("_ready.optional_first").alias("optional_first"))


def _filled(value: Column) -> Column:
    """NULL instead of an empty value; stays inside generated code."""
    return F.nullif(value, F.lit(""))


def _field(name, value: Column, method: Column, rule_id) -> Column:
    return F.struct(
        (name if isinstance(name, Column) else F.lit(name)).alias("field"), value.alias("value"), method.alias("method"),
        (rule_id if isinstance(rule_id, Column) else F.lit(rule_id)).cast("bigint").alias("rule_id"),
    )


def _rule_method(value: Column) -> Column:
    return F.when(value.isNotNull(), m.METHOD_RULE).otherwise(m.METHOD_NONE)


def rule_value(text: Column, pattern: str) -> Column:
    """Value of a rule, NULL when absent or empty; ordinary patterns are searched once."""
    ready = prepare(pattern)
    if ready is not None and (ready.groups == 0 or (ready.groups == 1 and not ready.optional_first)):
        return strip(regexp_extract(text, ready.java, ready.groups))
    return apply_pattern(text, pattern)


def rule_item(field: str, rule_id: int, value: Column) -> Column:
    """Field row of a rule; the value is evaluated once."""
    return let(keep_if(value, lambda v: v != ""), lambda v: _field(field, v, _rule_method(v), rule_id))


def rule_fields(docs: DataFrame, rules: DataFrame, text: str = "text", spans: str | None = None, exclude: Column | None = None,
                as_column: str = "rule_fields", max_unrolled: int = MAX_UNROLLED_RULES, max_broadcast: int = MAX_BROADCAST_RULES) -> DataFrame:
    """Add the results of all rules of the document's product as an array column, one row a rule, by rule id.

    ``exclude``: array of field names already known, their rules are not run.  Few rules are
    written into the plan; any number of them goes through ``rule_sets``.  Either way a
    text stays where it is and is not copied.
    """
    active = usable_rules(rules)
    rows = rows_within(active.orderBy("rule_id"), max_unrolled)
    if rows is None:
        return _fields_by_sets(docs, active, text, spans, exclude, as_column, max_broadcast)
    by_product: dict[int, list] = {}
    for r in rows:
        by_product.setdefault(r["product_id"], []).append(r)
    result = F.array().cast(FIELDS)
    for product_id, group in by_product.items():
        items = []
        for r in group:
            value = rule_value(F.col(text), r["pattern"])
            if spans is not None and r["bbox"] is not None:
                box = literal(r["bbox"].asDict(), "struct<page:int,x0:double,top:double,x1:double,bottom:double>")
                value = F.coalesce(keep_if(rule_value(zone_text(F.col(spans), box), r["pattern"]), lambda v: v != ""), value)
            item = rule_item(r["field"], r["rule_id"], value)
            items.append(item if exclude is None else F.when(~F.array_contains(exclude, r["field"]), item))
        result = F.when(F.col("product_id") == product_id, F.array_compact(F.array(*items)).cast(FIELDS)).otherwise(result)
    return docs.withColumn(as_column, result)


def rule_sets(rules: DataFrame, max_rows: int = MAX_BROADCAST_RULES, max_bytes: int = MAX_BYTES) -> list[DataFrame]:
    """(product_id, rules): one row a product with its rules as an array, in as many tables as it takes for each to be copied to every task.

    Rules are dealt to the tables by a digest of their id, so one product may own most of them.
    """
    box = [F.col("bbox")] if "bbox" in rules.columns else [F.lit(None).cast("struct<page:int,x0:double,top:double,x1:double,bottom:double>").alias("bbox")]
    ready = screen_rules(rules.select("rule_id", "product_id", "field", "pattern", *box))
    held = F.sum(F.coalesce(F.length("java"), F.lit(0)) + F.length("field") + 100)
    size = ready.agg(F.count(F.lit(1)).alias("n"), F.coalesce(held, F.lit(0)).alias("b")).first()
    parts = max(1, -(-size["n"] // max(1, max_rows)), -(-size["b"] // max_bytes))
    packed = F.sort_array(F.collect_list(F.struct("rule_id", "field", "java", "groups", "optional_first", "bbox")))
    return [
        ready.filter(F.pmod(F.xxhash64("rule_id"), F.lit(parts)) == k).groupBy("product_id").agg(packed.alias("_rules"))
        for k in range(parts)
    ]


def _searched(text: Column, rule: Column) -> Column:
    """Value of a rule that is data; NULL for a broken pattern."""
    value = extract_value(text, F.coalesce(rule["java"], F.lit("$^")), F.coalesce(rule["groups"], F.lit(0)), F.coalesce(rule["optional_first"], F.lit(False)))
    return F.when(rule["java"].isNotNull(), _filled(value))


def _fields_by_sets(docs: DataFrame, active: DataFrame, text: str, spans: str | None, exclude: Column | None, as_column: str, max_rows: int) -> DataFrame:
    """The table form: each document meets the arrays of its product's rules and searches them in its row."""
    known = "_known"
    out = docs.withColumn(as_column, F.array().cast(FIELDS)).withColumn(known, F.lit(None).cast("array<string>") if exclude is None else exclude)

    def found(rule: Column) -> Column:
        value = _searched(F.col(text), rule)
        if spans is not None:
            in_zone = F.when(rule["bbox"].isNotNull(), let(zone_text(F.col(spans), rule["bbox"]), lambda t: _searched(t, rule)))
            value = F.coalesce(in_zone, value)
        return let(value, lambda v: _field(rule["field"], v, _rule_method(v), rule["rule_id"]))

    parts = rule_sets(active, max_rows)
    for part in parts:
        part = part.withColumnRenamed("product_id", "_product")
        joined = out.join(F.broadcast(part), F.col("product_id") == F.col("_product"), "left")
        wanted = F.filter(F.coalesce("_rules", F.array()), lambda r: F.col(known).isNull() | ~F.array_contains(known, r["field"]))
        added = F.concat(as_column, F.transform(wanted, found).cast(FIELDS))
        out = joined.withColumn(as_column, added).drop("_product", "_rules")
    if len(parts) > 1:
        out = out.withColumn(as_column, F.array_sort(as_column, lambda a, b: F.when(a["rule_id"] < b["rule_id"], -1).otherwise(1)))
    return out.drop(known)


def best_per_field(fields: Column) -> Column:
    """One row a field, by name: of several rules one with a value, of those the one with the highest id."""
    keyed = F.transform(fields, lambda f: F.struct(f["field"].alias("field"), f["value"].isNull().alias("none"), (-F.coalesce(f["rule_id"], F.lit(0))).alias("late"), f.alias("row")))

    def first(rows: Column) -> Column:
        return F.transform(F.filter(rows, lambda x, i: (i == 0) | (x["field"] != F.get(rows, i - 1)["field"])), lambda x: x["row"])

    return let(F.array_sort(keyed), first)


def apply_rules(docs: DataFrame, rules: DataFrame, text: str = "text", max_unrolled: int = MAX_UNROLLED_RULES,
                max_broadcast: int = MAX_BROADCAST_RULES) -> DataFrame:
    """Long result of all rules on the documents of their product; see ``rule_fields``."""
    wide = rule_fields(docs.select("doc_id", "product_id", text), rules, text, max_unrolled=max_unrolled, max_broadcast=max_broadcast)
    return unpack(wide, ["doc_id"], "rule_fields")


# ---- field lists -------------------------------------------------------------

def product_fields(products: DataFrame, globals_: DataFrame, specific: DataFrame, dedupe: bool = True) -> DataFrame:
    """Fields of every product: applicable global ones, then its own.

    ``products``: product_id, line.  Vehicle fields only for vehicle lines.  With
    ``dedupe`` a specific field named like an applicable global one is left out.
    """
    rows = rows_within(globals_, MAX_FIELD_LISTS)
    if rows is None:
        raise ValueError("the global field list is configuration and must stay small")
    listed = literal([r.asDict() for r in rows], f"array<{globals_.schema.simpleString()}>")
    vehicle = is_vehicle_line(F.col("line"))
    usable = F.filter(listed, lambda f: vehicle | f["group"].isNull() | (f["group"] != m.VEHICLE_GROUP))
    general = products.select("product_id", F.inline(usable)).withColumn("is_global", F.lit(True))
    own = specific.join(products.select("product_id"), "product_id", "left_semi").withColumn("is_global", F.lit(False))
    if dedupe:
        own = own.join(general.select("product_id", "field"), ["product_id", "field"], "left_anti")
    return general.unionByName(own, allowMissingColumns=True)


def fixed_values(doc_products: DataFrame, fields: DataFrame, found: DataFrame) -> DataFrame:
    """Rows for global fields with a fixed value that no rule produced."""
    fixed = fields.filter(F.col("is_global") & F.col("fixed_value").isNotNull()).select("product_id", "field", F.col("fixed_value").alias("value"))
    wanted = join_small(doc_products.select("doc_id", "product_id"), fixed, "product_id")
    fresh = wanted.join(found.select("doc_id", "field"), ["doc_id", "field"], "left_anti")
    return fresh.select("doc_id", "field", "value", F.lit(m.METHOD_FIXED).alias("method"), F.lit(None).cast("bigint").alias("rule_id"))


def missing_fields(doc_products: DataFrame, fields: DataFrame, found: DataFrame) -> DataFrame:
    """Fields of the product without a value: listed with method "not found"."""
    open_fields = fields.filter(~F.col("is_global") | F.col("fixed_value").isNull()).select("product_id", "field").distinct()
    wanted = join_small(doc_products.select("doc_id", "product_id"), open_fields, "product_id")
    covered = found.filter(F.col("method").isin(m.METHOD_RULE, m.METHOD_RECIPE)).select("doc_id", "field")
    return wanted.join(covered, ["doc_id", "field"], "left_anti").select(
        "doc_id", "field", F.lit(None).cast("string").alias("value"), F.lit(m.METHOD_NONE).alias("method"),
        F.lit(None).cast("bigint").alias("rule_id"),
    )


def field_lists(fields: DataFrame) -> Column:
    """product -> its fields with their fixed values, as one constant."""
    chosen = fields.select("product_id", "field", F.when(F.col("is_global"), F.col("fixed_value")).alias("fixed_value"))
    rows = rows_within(chosen, MAX_FIELD_LISTS)
    if rows is None:
        raise ValueError("too many product fields for one projection, use missing_fields and fixed_values")
    lists: dict[str, list] = {}
    for r in rows:
        lists.setdefault(str(r["product_id"]), []).append({"field": r["field"], "fixed_value": r["fixed_value"]})
    return literal(lists, "map<string,array<struct<field:string,fixed_value:string>>>")


# ---- resolution --------------------------------------------------------------

def source_rank(method: Column) -> Column:
    """Dedicated recipe, rule, fixed or derived, model, nothing."""
    return (
        F.when(method == m.METHOD_RECIPE, m.RANK_RECIPE)
        .when(method == m.METHOD_RULE, m.RANK_RULE)
        .when(method.isin(m.METHOD_FIXED, m.METHOD_DERIVED), m.RANK_FIXED)
        .when(method == m.METHOD_MODEL, m.RANK_MODEL)
        .otherwise(m.RANK_MISSING)
    )


def resolve_sources(long_fields: DataFrame) -> DataFrame:
    """One row per (document, field): the best source with a value.

    The rule id of an unmatched rule is kept on the missing row.
    """
    rank = F.when(F.col("value").isNull(), m.RANK_MISSING).otherwise(source_rank(F.col("method")))
    order = F.struct(rank, F.coalesce(-F.col("rule_id"), F.lit(2**62)))
    best = F.min_by(F.struct("value", "method", "rule_id"), order)
    return long_fields.groupBy("doc_id", "field").agg(best.alias("_b")).select("doc_id", "field", "_b.*")


def complete_sources(doc_products: DataFrame, fields: DataFrame, found: DataFrame) -> DataFrame:
    """Resolved rows of all fields: found ones, fixed values, missing ones.

    ``found`` is read once: the expected fields of each document join it in one
    grouping instead of two anti-joins.  A field with a rule never takes the fixed
    value, hit or not.
    """
    listed = fields.groupBy("product_id", "field").agg(F.max(F.when(F.col("is_global"), F.col("fixed_value"))).alias("value"))
    wanted = join_small(doc_products.select("doc_id", "product_id"), listed, "product_id")
    expected = wanted.select(
        "doc_id", "field", "value", F.when(F.col("value").isNotNull(), m.METHOD_FIXED).otherwise(m.METHOD_NONE).alias("method"),
        F.lit(None).cast("bigint").alias("rule_id"),
    )
    rank = F.when(F.col("value").isNull(), m.RANK_MISSING).otherwise(source_rank(F.col("method")))
    order = F.struct(rank, F.coalesce(-F.col("rule_id"), F.lit(2**62)))
    best = found.select(expected.columns).unionByName(expected).groupBy("doc_id", "field").agg(
        F.min_by(F.struct("value", "method", "rule_id"), order).alias("_b"), F.max("rule_id").alias("_rule")
    )
    refused = (F.col("_b.method") == m.METHOD_FIXED) & F.col("_rule").isNotNull()
    return best.select(
        "doc_id", "field", F.when(~refused, F.col("_b.value")).alias("value"),
        F.when(refused, m.METHOD_NONE).otherwise(F.col("_b.method")).alias("method"),
        F.when(refused, F.col("_rule")).otherwise(F.col("_b.rule_id")).alias("rule_id"),
    )


def overlay(first: Column, *others: Column) -> Column:
    """Array form of the resolution: earlier arrays win, field by field."""
    def add(result: Column, other: Column) -> Column:
        known = F.transform(result, lambda f: f["field"])
        return F.concat(result, let(known, lambda names: F.filter(other, lambda f: ~F.array_contains(names, f["field"]))))

    return reduce(add, others, first)


def complete_fields(found: Column, lists: Column, product_id: Column) -> Column:
    """Add fixed values, then the missing fields of the product."""
    expected = F.coalesce(F.try_element_at(lists, product_id.cast("string")), F.array().cast("array<struct<field:string,fixed_value:string>>"))

    def added(names: Column, wanted: Column) -> Column:
        rest = F.filter(wanted, lambda e: ~F.array_contains(names, e["field"]))

        def item(name: Column, candidates: Column) -> Column:
            # a field may be listed twice (global and specific): the fixed value wins
            fixed = F.array_max(F.transform(F.filter(candidates, lambda e: e["field"] == name), lambda e: e["fixed_value"]))
            return let(fixed, lambda v: _field(name, v, F.when(v.isNotNull(), m.METHOD_FIXED).otherwise(m.METHOD_NONE), None))

        return let(rest, lambda r: F.transform(F.array_distinct(F.transform(r, lambda e: e["field"])), lambda n: item(n, r)))

    return F.concat(found, let2(F.transform(found, lambda f: f["field"]), expected, added))


def value_of(fields: Column, name: str) -> Column:
    """Value of one field in the array form."""
    return F.get(F.filter(fields, lambda f: f["field"] == name), F.lit(0))["value"]


def with_person_type(fields: Column, output: str = "label") -> Column:
    """Set the derived person type where the document gives none."""

    def add(kind: Column) -> Column:
        others = F.filter(fields, lambda f: f["field"] != "entidad")
        return F.when(kind.isNotNull(), F.concat(others, F.array(_field("entidad", kind, F.lit(m.METHOD_DERIVED), None)))).otherwise(fields)

    none = F.lit(None).cast("string")
    derive = lambda tax_id, name: derive_person_type(none, tax_id, name, output)
    derived = let2(value_of(fields, "rfc"), value_of(fields, "nombre_cliente"), derive)
    return let(F.when(value_of(fields, "entidad").isNull(), derived), add)


def derive_fields(long_fields: DataFrame, output: str = "label") -> DataFrame:
    """Table form: the person type of each document from its tax id and name."""
    pick = lambda name: F.max(F.when(F.col("field") == name, F.col("value")))
    facts = long_fields.groupBy("doc_id").agg(pick("rfc").alias("_t"), pick("nombre_cliente").alias("_n"), pick("entidad").alias("_e"))
    value = derive_person_type(F.lit(None).cast("string"), F.col("_t"), F.col("_n"), output)
    derived = facts.filter(F.col("_e").isNull()).select("doc_id", F.lit("entidad").alias("field"), value.alias("value"),
                                                       F.lit(m.METHOD_DERIVED).alias("method"), F.lit(None).cast("bigint").alias("rule_id"))
    derived = derived.filter(F.col("value").isNotNull())
    return long_fields.join(derived.select("doc_id", "field"), ["doc_id", "field"], "left_anti").unionByName(derived)


# ---- counters ----------------------------------------------------------------

def method_bucket(method: Column) -> Column:
    """Six methods in three buckets."""
    return (
        F.when(method.isin(m.METHOD_RULE, m.METHOD_RECIPE, m.METHOD_FIXED, m.METHOD_DERIVED), m.METHOD_RULE)
        .when(method == m.METHOD_MODEL, m.METHOD_MODEL)
        .otherwise(m.METHOD_NONE)
    )


COUNTERS = [("by_rule", m.METHOD_RULE), ("by_model", m.METHOD_MODEL), ("not_found", m.METHOD_NONE)]


def method_counters(long_fields: DataFrame, key: str = "doc_id") -> DataFrame:
    bucket = method_bucket(F.col("method"))
    return long_fields.groupBy(key).agg(*[F.count_if(bucket == b).alias(name) for name, b in COUNTERS])


def counters_of(fields: Column) -> list[Column]:
    """Array form of the counters."""

    def size(bucket: str) -> Column:
        return F.size(F.filter(fields, lambda f: method_bucket(f["method"]) == bucket))

    return [size(b).alias(name) for name, b in COUNTERS]


def field_map(long_fields: DataFrame) -> DataFrame:
    """Record of each document as a map; its size is the number of fields.  Of several rules of a field one with a value counts, the latest."""
    order = F.struct(F.col("value").isNull(), -F.coalesce("rule_id", F.lit(0)))
    single = long_fields.groupBy("doc_id", "field").agg(F.min_by("value", order).alias("value"))
    return single.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("record"))


def covered_fields(long_fields: DataFrame) -> DataFrame:
    """Names of the fields found by rule or recipe, per document."""
    hit = F.when(F.col("method").isin(m.METHOD_RULE, m.METHOD_RECIPE), F.col("field"))
    return long_fields.groupBy("doc_id").agg(F.array_sort(F.collect_set(hit)).alias("covered"))


def reapply_product(extractions: DataFrame, chosen: DataFrame, rules: DataFrame, fields: DataFrame, stored: DataFrame) -> DataFrame:
    """Recompute the fields of chosen documents with another product.

    ``chosen``: doc_id, product_id.  Only the rules run, not the recipes; the person type is derived anew.  Returns
    the whole field table with the old rows of these documents replaced.
    """
    docs = extractions.select("doc_id", "text").join(chosen, "doc_id")
    found = apply_rules(docs, rules)
    fresh = derive_fields(complete_sources(docs, fields, found), "code").select(stored.columns)
    return stored.join(chosen.select("doc_id"), "doc_id", "left_anti").unionByName(fresh)


