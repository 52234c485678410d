"""Upkeep of catalogue, rules, labels, queue and stored documents.

Every operator returns a new snapshot or an action list.  Nothing here deletes a
file or updates in place; the caller writes the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.binding import regexp_extract
from fieldloom import model as m
from fieldloom.functions.text import context_window, lookup
from fieldloom.operators.bounds import join_small

# ---- fixed values: old field name -> current field name
FIELD_NAMES = {
    "numero_poliza": "documento",
    "inicio_vigencia": "desde",
    "fin_vigencia": "hasta",
    "descripcion_vehiculo": "descripcion_veh",
    "gastos_expedicion": "derechos",
}

# ---- fixed values: old product name -> current product name, old and new line names
PRODUCT_NAMES = {
    "Particular": "Automóviles",
    "Flotilla": "Flotilla de Vehiculos",
    "Motocicleta": "Motocicletas",
    "Pesado": "Camiones",
}
OLD_LINES, NEW_LINE = ["Autos", "Pesado", "Camiones", "Flotilla"], "Vehículos"
# ---- end of fixed values


# ---- catalogue ----------------------------------------------------------------

def sync_level(current: DataFrame, desired: DataFrame, keys: list[str], updates: list[str], soft_delete: bool = True) -> DataFrame:
    """New snapshot of one level: update by natural key, revive, add, switch off the rest.

    Rows only in ``current`` become inactive (``soft_delete``) or stay as they
    are.  The column ``change`` says what happened: kept, updated, revived, added,
    retired.
    """
    a, b = current.alias("a"), desired.alias("b")
    match = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    on = match[0]
    for c in match[1:]:
        on = on & c
    both = a.withColumn("_a", F.lit(True)).alias("a").join(b.withColumn("_b", F.lit(True)).alias("b"), on, "full_outer")
    in_a, in_b = F.col("a._a").isNotNull(), F.col("b._b").isNotNull()
    changed = F.lit(False)
    for c in updates:
        changed = changed | ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    change = (
        F.when(~in_a, "added")
        .when(~in_b, F.when(F.col("a.active") & F.lit(soft_delete), "retired").otherwise("kept"))
        .when(~F.col("a.active"), "revived")
        .when(changed, "updated")
        .otherwise("kept")
    )
    active = F.when(in_b, F.lit(True)).otherwise(F.col("a.active") & F.lit(not soft_delete))
    columns = []
    for c in current.columns:
        if c == "active":
            columns.append(active.alias("active"))
        elif c in keys:
            columns.append(F.coalesce(f"a.{c}", f"b.{c}").alias(c))
        elif c in updates:
            columns.append(F.when(in_b, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c))
        else:
            columns.append(F.col(f"a.{c}").alias(c))
    return both.select(*columns, change.alias("change"))


def missing_names(current: DataFrame, official: DataFrame, keys: list[str]) -> DataFrame:
    """Current rows whose name left the official list."""
    return current.join(official.select(*keys).distinct(), keys, "left_anti")


def default_fields(added_products: DataFrame, field_sets: DataFrame) -> DataFrame:
    """Field rows for new products, by the name of their line (small table)."""
    return join_small(added_products.select("product_id", "line"), field_sets, "line").drop("line")


def merge_patterns(existing: Column, new: Column) -> Column:
    """Union of two lists without repeats, existing ones first."""
    empty = F.array().cast("array<string>")
    return F.array_union(F.coalesce(existing, empty), F.coalesce(new, empty))


def add_patterns(catalogue: DataFrame, approved: DataFrame) -> DataFrame:
    """Append approved patterns (level, id, patterns) to the catalogue entries."""
    per_entry = approved.select("level", "id", F.explode("patterns").alias("p")).filter(F.col("p").isNotNull())
    grouped = per_entry.groupBy("level", "id").agg(F.array_sort(F.collect_set("p")).alias("_new"))
    joined = join_small(catalogue, grouped, ["level", "id"], "left")
    merged = F.when(F.col("_new").isNull(), F.col("patterns")).otherwise(merge_patterns(F.col("patterns"), F.col("_new")))
    return joined.select(*[merged.alias("patterns") if c == "patterns" else F.col(c) for c in catalogue.columns])


# ---- rules ----------------------------------------------------------------------

def activate_latest(rules: DataFrame, time: str = "created_at") -> DataFrame:
    """Exactly one active non-draft rule per (product, field): the newest of the active ones.

    The winners are joined back by rule id, so a field with very many versions
    does not meet in one task.
    """
    live = rules.filter(F.col("active") & ~F.coalesce(F.col("draft"), F.lit(False)))
    winners = live.groupBy("product_id", "field").agg(F.max_by("rule_id", F.struct(time, "rule_id")).alias("rule_id"))
    marked = rules.join(winners.select("rule_id", F.lit(True).alias("_win")), "rule_id", "left")
    is_live = F.col("active") & ~F.coalesce(F.col("draft"), F.lit(False))
    active = F.when(is_live, F.col("_win").isNotNull()).otherwise(F.col("active"))
    return marked.select(*[active.alias(c) if c == "active" else F.col(c) for c in rules.columns])


def promote_drafts(rules: DataFrame, promoted: DataFrame, time: str = "created_at") -> DataFrame:
    """Turn drafts (rule_id, promoted_at) into the active rules of their field."""
    joined = rules.join(promoted.select("rule_id", "promoted_at"), "rule_id", "left")
    hit = F.col("promoted_at").isNotNull()
    ready = joined.select(
        *[F.when(hit, False).otherwise(F.col(c)).alias(c) if c == "draft" else F.col(c) for c in rules.columns],
        F.coalesce("promoted_at", time).alias("_at"),
    )
    return activate_latest(ready, "_at").drop("_at")


def rename_fields(df: DataFrame, column: str, names: dict[str, str] | None = None) -> DataFrame:
    """Current field names in a column."""
    return df.withColumn(column, F.coalesce(lookup(F.col(column), names or FIELD_NAMES), F.col(column)))


def rename_map_keys(record: Column, names: dict[str, str] | None = None) -> Column:
    """Current field names as keys of a record; if both names occur the current one wins."""
    table = names or FIELD_NAMES
    present_keys = F.map_keys(record)
    safe = F.map_filter(record, lambda k, v: ~F.coalesce(F.array_contains(present_keys, lookup(k, table)), F.lit(False)))
    return F.transform_keys(safe, lambda k, v: F.coalesce(lookup(k, table), k))


def rename_report(tables: dict[str, tuple[DataFrame, str]], names: dict[str, str] | None = None) -> DataFrame:
    """Rows per table and old name that a rename will touch."""
    out = None
    for table, (df, column) in tables.items():
        part = df.filter(F.col(column).isin(*(names or FIELD_NAMES))).groupBy(F.col(column).alias("old_name")).agg(
            F.count(F.lit(1)).alias("n")
        ).select(F.lit(table).alias("table"), "old_name", "n")
        out = part if out is None else out.unionByName(part)
    return out


def remap_rules(rules: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Move rules of old products to the product that replaces them.

    ``hierarchy``: product_id, product, line, company_id, product_active.  Each
    rule of an old line comes back with ``new_product_id`` or ``skip_reason``.
    """
    old = hierarchy.filter(F.col("line").isin(*OLD_LINES)).select(
        "product_id", "company_id", F.col("product").alias("old_product"), lookup(F.col("product"), PRODUCT_NAMES).alias("new_product")
    )
    new = hierarchy.filter((F.col("line") == NEW_LINE) & F.col("product_active")).groupBy(
        "company_id", F.col("product").alias("new_product")
    ).agg(F.min("product_id").alias("new_product_id"))
    moved = join_small(rules, old, "product_id").join(new, ["company_id", "new_product"], "left")
    reason = F.when(F.col("new_product").isNull(), "no mapping").when(F.col("new_product_id").isNull(), "no new product")
    return moved.select(*rules.columns, "company_id", "old_product", "new_product", "new_product_id", reason.alias("skip_reason"))


def rule_audit(rules: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Rules with company, product and state; a missing draft flag counts as false."""
    return join_small(rules, hierarchy, "product_id").select(
        "rule_id", "company", "line", "product", "product_active", "field", "active",
        F.coalesce("draft", F.lit(False)).alias("draft"),
    )


def rules_with_hierarchy(rules: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Active rules with the names of product, line and company; order with ``HIERARCHY_ORDER``."""
    live = rules.filter(F.col("active") & ~F.coalesce(F.col("draft"), F.lit(False)))
    return join_small(live, hierarchy.select("product_id", "product", "line", "company", "company_priority"), "product_id")


def hierarchy_order() -> list[Column]:
    """Company priority (none first), line, product, field."""
    return [F.asc_nulls_first("company_priority"), F.asc("line"), F.asc("product"), F.asc("field")]


def catalogue_order() -> list[Column]:
    """Priority (none last), then name."""
    return [F.asc_nulls_last("priority"), F.asc("name")]


# ---- documents, labels ------------------------------------------------------------

def keep_oldest(files: DataFrame, hash_column: str = "sha256", time: str = "mtime", ident: str = "path") -> DataFrame:
    """The oldest file of each content, with the number of copies."""
    oldest = F.min(F.struct(time, ident)).alias("_o")
    return files.groupBy(hash_column).agg(oldest, F.count(F.lit(1)).alias("copies")).select(
        hash_column, F.col(f"_o.{ident}").alias(ident), F.col(f"_o.{time}").alias(time), "copies"
    )


def duplicates(files: DataFrame, hash_column: str = "sha256", time: str = "mtime", ident: str = "path") -> DataFrame:
    """All files but the oldest of each content.

    Found by an anti-join on the unique file id, so a content with very many
    copies is never brought together.
    """
    return files.join(keep_oldest(files, hash_column, time, ident).select(ident), ident, "left_anti")


def latest_per_name(documents: DataFrame, name: str = "name", time: str = "created_at", ident: str = "doc_id") -> DataFrame:
    """Newest document of each name that still has its file (``file_present``)."""
    live = documents.filter(F.col("file_present")) if "file_present" in documents.columns else documents
    others = [c for c in live.columns if c != name]
    return live.groupBy(name).agg(F.max_by(F.struct(*others), F.struct(time, ident)).alias("_d")).select(name, "_d.*")


def retention_plan(documents: DataFrame, now: Column, days: int = m.RETENTION_DAYS, cap: int = m.RETENTION_CAP,
                   time: str = "created_at", ident: str = "doc_id") -> DataFrame:
    """(ident, reason) of the documents to delete: too old, then beyond the cap.

    A missing date escapes the age rule but counts toward the cap and sorts as the
    oldest.  The ``cap`` newest rows are kept by a top-k, the rest is an anti-join
    with these few rows; the table is never sorted as a whole.
    """
    limit = now - F.make_interval(days=F.lit(days))
    aged = F.coalesce(F.col(time) < limit, F.lit(False))
    old = documents.filter(aged).select(ident, F.lit("age").alias("reason"))
    rest = documents.filter(~aged).select(ident, time)
    kept = rest.orderBy(F.desc_nulls_last(time), F.desc(ident)).limit(cap).select(ident)
    over = rest.join(F.broadcast(kept), ident, "left_anti").select(ident, F.lit("cap").alias("reason"))
    return old.unionByName(over)


def unused(documents: DataFrame, references: DataFrame, ident: str = "doc_id") -> DataFrame:
    """Documents no extraction refers to."""
    used = references.select(F.col(ident)).filter(F.col(ident).isNotNull()).distinct()
    return documents.join(used, ident, "left_anti")


def purge(documents: DataFrame, labels: DataFrame, references: DataFrame, ident: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Snapshots of documents and labels without the unused documents."""
    gone = unused(documents, references, ident).select(ident)
    return documents.join(gone, ident, "left_anti"), labels.join(gone, ident, "left_anti")


def upsert_labels(current: DataFrame, changes: DataFrame) -> DataFrame:
    """One label per (doc_id, field): the newest; context from the text when given.

    ``changes`` may carry ``text``; the label's surroundings are cut from it.
    """
    if "text" in changes.columns:
        around = context_window(F.col("text"), F.col("value"), m.LABEL_CONTEXT)
        context = F.when(F.coalesce(F.length("text"), F.lit(0)) > 0, F.coalesce(around, F.col("value"))).otherwise(F.col("context"))
        changes = changes.withColumn("context", context).drop("text")
    rows = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    others = [c for c in rows.columns if c not in ("doc_id", "field", "_new")]
    newest = F.max_by(F.struct(*others), F.struct("_new", "created_at"))
    return rows.groupBy("doc_id", "field").agg(newest.alias("_l")).select("doc_id", "field", "_l.*")


def automatic_labels(long_fields: DataFrame) -> DataFrame:
    """Label rows from extracted values that are not empty."""
    return long_fields.filter(F.coalesce("value", F.lit("")) != "").select(
        "doc_id", "field", F.left("value", F.lit(m.LABEL_CHARS)).alias("value"), F.lit(True).alias("is_auto"), "method"
    )


def labels_per_document(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Number of labels of each document, zero included."""
    n = labels.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return documents.select("doc_id").join(n, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n_labels"))


def label_matrix(labels: DataFrame) -> DataFrame:
    """Labels of each document as field -> label; as wide as the field list, not as the batch."""
    return labels.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("labels"))


# ---- queue ------------------------------------------------------------------------

def propose(detected: DataFrame, responses: DataFrame) -> DataFrame:
    """Queue proposal: the detector when its confidence is high, else the model.

    ``responses``: doc_id, company_id, line_id, product_id, confidence (number),
    reason, is_new.  No usable response for a document leaves an error state.
    """
    r = responses.select("doc_id", *[F.col(c).alias(f"r_{c}") for c in responses.columns if c != "doc_id"], F.lit(True).alias("_r"))
    both = detected.join(r, "doc_id", "left")
    sure = (F.col("confidence") == m.HIGH) & F.col("product_id").isNotNull()
    answered = F.col("_r").isNotNull()
    from fieldloom.operators.detect import model_confidence

    pick = lambda own, other: F.when(sure, own).when(answered, other)
    return both.select(
        "doc_id",
        *[pick(F.col(c), F.col(f"r_{c}")).alias(f"{c}_prop") for c in ("company_id", "line_id", "product_id")],
        pick(F.lit(m.HIGH), model_confidence(F.col("r_confidence"))).alias("confidence"),
        pick(F.lit("detector"), F.lit(m.METHOD_MODEL)).alias("method"),
        F.when(sure, F.lit(None)).otherwise(F.col("r_reason")).alias("reason"),
        F.when(sure, m.CLASSIFIED)
        .when(answered & F.coalesce(F.col("r_is_new"), F.lit(False)), m.NEEDS_PERSON)
        .when(answered, m.CLASSIFIED)
        .otherwise(m.FAILED).alias("state"),
    )


def known_ids(responses: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Ids of a model answer that are not in the catalogue become NULL."""
    out = responses
    for level in (m.COMPANY, m.LINE, m.PRODUCT):
        ids = catalogue.filter(F.col("level") == level).select(F.col("id").alias(f"{level}_id"), F.lit(True).alias("_ok"))
        joined = join_small(out, ids, f"{level}_id", "left")
        out = joined.select(*[F.when(F.col("_ok"), F.col(c)).alias(c) if c == f"{level}_id" else F.col(c) for c in out.columns])
    return out


def final_ids(queue: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Final ids: override, else proposal; rows without a product are refused."""
    ids = ("company_id", "line_id", "product_id")
    if overrides is None:
        joined = queue.withColumns({f"{c}_over": F.lit(None).cast("bigint") for c in ids})
    else:
        joined = queue.join(overrides.select("doc_id", *[F.col(c).alias(f"{c}_over") for c in ids]), "doc_id", "left")
    final = {f"{c}_final": F.coalesce(f"{c}_over", f"{c}_prop") for c in ids}
    out = joined.withColumns(final).drop(*[f"{c}_over" for c in ids])
    return out.withColumn("refused", F.when(F.col("product_id_final").isNull(), F.lit("product required")))


def confirm_batch(queue: DataFrame, taken_names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Confirm all classified rows of high confidence: new queue snapshot, new training rows.

    A name already taken in the product gets a short suffix made from its content hash.
    """
    ready = (F.col("state") == m.CLASSIFIED) & (F.col("confidence") == m.HIGH) & F.col("product_id_prop").isNotNull()
    moved = queue.filter(ready)
    training = moved.join(
        taken_names.select(F.col("product_id").alias("product_id_prop"), "name", F.lit(True).alias("_taken")).distinct(),
        ["product_id_prop", "name"], "left",
    )
    suffix = F.concat(F.lit("_"), F.left("sha256", F.lit(6)))
    unique = F.when(
        F.col("_taken"), F.concat(F.regexp_replace("name", "(\\.[^.]*)?$", ""), suffix, regexp_extract("name", "(\\.[^.]*)?$", 1))
    ).otherwise(F.col("name"))
    training = training.select(F.col("product_id_prop").alias("product_id"), unique.alias("name"), "doc_id", "sha256")
    snapshot = queue.withColumns(
        {f"{c}_final": F.when(ready, F.col(f"{c}_prop")).otherwise(F.col(f"{c}_final")) for c in ("company_id", "line_id", "product_id")}
    ).withColumn("state", F.when(ready, m.SENT).otherwise(F.col("state")))
    return snapshot, training


def with_level_names(queue: DataFrame, catalogue: DataFrame, suffixes: list[str]) -> DataFrame:
    """Names of company, line and product for each set of ids (``_prop``, ``_final``)."""
    out = queue
    for suffix in suffixes:
        for level in (m.COMPANY, m.LINE, m.PRODUCT):
            names = catalogue.filter(F.col("level") == level).select(F.col("id").alias(f"{level}_id{suffix}"), F.col("name").alias(f"{level}{suffix}"))
            out = join_small(out, names, f"{level}_id{suffix}", "left")
    return out


def export_names(extractions: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Detected names, replaced by the export alias where one is set."""
    out = extractions
    for level in (m.COMPANY, m.LINE, m.PRODUCT):
        alias = catalogue.filter(F.col("level") == level).select(
            F.col("id").alias(f"{level}_id"), F.nullif(F.col("alias"), F.lit("")).alias("_alias")
        )
        joined = join_small(out, alias, f"{level}_id", "left")
        out = joined.select(*[F.coalesce("_alias", c).alias(c) if c == level else F.col(c) for c in out.columns])
    return out


def history_page(extractions: DataFrame, skip: int, limit: int, time: str = "created_at", ident: str = "id") -> DataFrame:
    """One page, newest first, ties by id; look-ups are joined to the page only."""
    return extractions.orderBy(F.desc(time), F.desc(ident)).offset(skip).limit(limit)


def prefill_by_name(items: DataFrame, catalogue: DataFrame, level: str, name: str) -> DataFrame:
    """Catalogue id for a typed name, case-blind."""
    names = catalogue.filter(F.col("level") == level).groupBy(F.lower("name").alias("_low")).agg(F.min("id").alias(f"{level}_id"))
    return join_small(items.withColumn("_low", F.lower(name)), names, "_low", "left").drop("_low")


def evolve(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Append rows that have more (or fewer) columns."""
    return stored.unionByName(new, allowMissingColumns=True)

