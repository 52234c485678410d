"""Getting results out: header and long tables, wide and nested exports."""

from __future__ import annotations

import json
import uuid
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom import model as m
from fieldloom.functions.amounts import person_label
from fieldloom.operators.bounds import unpack
from fieldloom.operators.detect import detection_method
from fieldloom.operators.fields import best_per_field, counters_of, value_of
from fieldloom.session import path_exists, put_text

# ---- fixed values: exported fields and their headings, in order
WIDE_COLUMNS = [
    ("documento", "N° Póliza"),
    ("nombre_cliente", "Cliente"),
    ("rfc", "RFC"),
    ("entidad", "Entidad"),
    ("agente_clave", "Clave Agente"),
    ("forma_pago", "Forma Pago"),
    ("moneda", "Moneda"),
    ("desde", "Inicio Vigencia"),
    ("hasta", "Fin Vigencia"),
    ("placas", "Placas"),
    ("serie", "N° Serie"),
    ("motor", "N° Motor"),
    ("modelo", "Modelo (año)"),
    ("descripcion_veh", "Descripción Vehículo"),
    ("tipo_vehiculo", "Tipo Vehículo"),
    ("suma_asegurada", "Suma Asegurada"),
    ("deducible", "Deducible"),
    ("coaseguro", "Coaseguro %"),
    ("prima_neta", "Prima Neta"),
    ("descuento", "Descuento"),
    ("derechos", "Derechos/Gastos Exp."),
    ("sub_total", "Subtotal"),
    ("iva", "IVA"),
    ("prima_total", "Prima Total"),
    ("colonia", "Colonia"),
    ("municipio", "Municipio"),
    ("cp", "C.P."),
    ("estado", "Estado"),
]
META_HEADINGS = {"name": "Archivo", "company": "Compañía", "line": "Ramo", "product": "Subramo"}
EXTRA_HEADINGS = {"confidence": "Confianza detección", "error": "Error", "method": "Método"}
# ---- end of fixed values


def header_rows(results: DataFrame, fields: str = "fields", text: str = "text") -> DataFrame:
    """One row per extracted document: detection, counters, record, stored text.

    ``results`` carries the fields as an array, so this is a projection.
    """
    hits = F.filter(fields, lambda f: f["method"].isin(m.METHOD_RULE, m.METHOD_RECIPE))
    record = F.map_from_entries(F.transform(best_per_field(F.col(fields)), lambda f: F.struct(f["field"], f["value"])))
    return results.select(
        "doc_id", "company_id", "line_id", "product_id", "company", "line", "product",
        detection_method(F.col("score_company")).alias("detection_method"), "confidence",
        record.alias("record"), F.array_sort(F.array_distinct(F.transform(hits, lambda f: f["field"]))).alias("covered"), F.left(text, F.lit(m.HISTORY_CHARS)).alias("text"), F.lit(True).alias("successful"),
        *counters_of(F.col(fields)),
    )


def long_rows(results: DataFrame, fields: str = "fields") -> DataFrame:
    """One row per document and field."""
    return unpack(results, ["doc_id"], fields)


def stage_extraction(results: DataFrame, folder: str, batch: str, fields: str = "fields", text: str = "text") -> str:
    """Write the three tables of a batch where no reader looks yet; returns the name of the attempt.

    The extraction itself runs a single time however many tables are derived: header and
    long rows come from the written results.
    """
    attempt = uuid.uuid4().hex
    target = lambda name: _attempt_path(folder, name, batch, attempt)
    results.write.parquet(target("results"))
    stored = results.sparkSession.read.schema(results.schema).parquet(target("results"))
    header_rows(stored, fields, text).write.parquet(target("extractions"))
    long_rows(stored, fields).write.parquet(target("fields"))
    return attempt


def publish_extraction(spark: SparkSession, folder: str, batch: str, attempt: str) -> None:
    """Make a staged attempt the current one of its batch: one small file is replaced as a whole."""
    put_text(spark, f"{folder}/commits/{quote(batch, safe='')}.json", json.dumps({"batch": batch, "attempt": attempt}))


def write_extraction(results: DataFrame, folder: str, batch: str, fields: str = "fields", text: str = "text") -> None:
    """Write one batch of results with its header and long rows; readers see all three tables of it or none.

    The files are staged first and published last, so a failure on the way leaves what
    the batch had before; a repeated batch replaces it.  Read with ``read_extraction``.
    """
    publish_extraction(results.sparkSession, folder, batch, stage_extraction(results, folder, batch, fields, text))


def _attempt_path(folder: str, name: str, batch: str, attempt: str) -> str:
    return f"{folder}/{name}/{quote(batch, safe='')}/{attempt}"


def published(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, attempt) of every batch that was written to its end."""
    if not path_exists(spark, f"{folder}/commits"):
        return spark.createDataFrame([], "batch string, attempt string")
    return spark.read.schema("batch string, attempt string").json(f"{folder}/commits")


def read_extraction(spark: SparkSession, folder: str, name: str, batches: list[str] | None = None) -> DataFrame:
    """One of the three tables (``results``, ``extractions``, ``fields``) of all published batches, or of some."""
    rows = published(spark, folder).collect()  # one short row a batch
    paths = [_attempt_path(folder, name, r["batch"], r["attempt"]) for r in rows if batches is None or r["batch"] in batches]
    if not paths:
        raise ValueError(f"no published batch in {folder}")
    return spark.read.parquet(*paths)


def method_text(by_rule: Column, by_model: Column) -> Column:
    return F.when(by_model > 0, F.concat(F.lit("IA("), by_model, F.lit(") + Regla("), by_rule, F.lit(")"))).otherwise(
        F.concat(F.lit("Regla("), by_rule, F.lit(")"))
    )


def _wide(values: dict[str, Column], headings: bool) -> list[Column]:
    return [
        (person_label(values[f]) if f == "entidad" else values[f]).alias(h if headings else f) for f, h in WIDE_COLUMNS
    ]


def export_wide(results: DataFrame, fields: str = "fields", headings: bool = True) -> DataFrame:
    """Wide table from the array form: a projection, no shuffle."""
    by_rule, by_model, _ = counters_of(F.col(fields))
    values = {f: value_of(F.col(fields), f) for f, _ in WIDE_COLUMNS}
    staged = results.withColumns({"_rule": by_rule, "_model": by_model})
    return staged.select(
        *[F.col(c).alias(h if headings else c) for c, h in META_HEADINGS.items()],
        *_wide(values, headings),
        F.coalesce("confidence", F.lit("—")).alias(EXTRA_HEADINGS["confidence"] if headings else "confidence"),
        F.coalesce("error", F.lit("")).alias(EXTRA_HEADINGS["error"] if headings else "error"),
        method_text(F.col("_rule"), F.col("_model")).alias(EXTRA_HEADINGS["method"] if headings else "method"),
    )


def pivot_fields(long_fields: DataFrame, names: list[str], key: str = "doc_id") -> DataFrame:
    """Wide table from the long one: one shuffle with partial aggregation, fixed columns."""
    return long_fields.groupBy(key).agg(*[F.max(F.when(F.col("field") == n, F.col("value"))).alias(n) for n in names])


def nested_rules(rules: DataFrame) -> DataFrame:
    """Company -> line -> product -> rules.  ``rules`` from ``rules_with_hierarchy``; configuration size."""
    item = F.struct("field", "rule_id", "pattern")
    product = rules.groupBy("company", "line", "product").agg(F.array_sort(F.collect_list(item)).alias("rules"))
    line = product.groupBy("company", "line").agg(F.array_sort(F.collect_list(F.struct("product", "rules"))).alias("products"))
    return line.groupBy("company").agg(F.array_sort(F.collect_list(F.struct("line", "products"))).alias("lines"))


def nested_catalogue(catalogue: DataFrame, drop_empty: bool = False) -> DataFrame:
    """Active companies with their lines and products, keywords and patterns.

    ``drop_empty`` leaves out products and lines without anything to detect.
    """
    empty = F.array().cast("array<string>")
    base = catalogue.filter("active").select(
        "level", "id", "parent_id", "name", "priority",
        F.coalesce("keywords", empty).alias("keywords"), F.coalesce("patterns", empty).alias("patterns"),
    )
    filled = F.size("keywords") + F.size("patterns") > 0
    level = lambda lv: base.filter(F.col("level") == lv)
    rank = F.coalesce("priority", F.lit(2**31 - 1)).alias("rank")
    product = level(m.PRODUCT).filter(filled) if drop_empty else level(m.PRODUCT)
    products = product.groupBy(F.col("parent_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct(rank, "name", "id", "keywords", "patterns"))).alias("products")
    )
    line = level(m.LINE).join(products, "id", "left")
    if drop_empty:
        line = line.filter(filled | F.col("products").isNotNull())
    lines = line.groupBy(F.col("parent_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("name", "id", "keywords", "patterns", "products"))).alias("lines")
    )
    company = level(m.COMPANY).join(lines, "id", "left")
    if drop_empty:
        company = company.filter(filled | F.col("lines").isNotNull())
    return company.select("id", "name", "priority", "keywords", "patterns", "lines")
