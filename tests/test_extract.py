import pytest

import samples
from fieldloom.plans.extract import extract


@pytest.fixture(scope="module")
def extracted(spark):
    """Built once: writing some sixty recipes into a plan takes a while."""
    return extract(samples.documents(spark), samples.catalogue(spark), samples.rules(spark), samples.product_fields(spark))


def test_both_families_end_to_end(extracted):
    rows = {r["doc_id"]: r for r in extracted.collect()}
    assert set(rows) == {1, 2, 3}
    a = {f["field"]: f for f in rows[1]["fields"]}
    got = {k: v["value"] for k, v in a.items()}
    expected = {
        "documento": "1234567890", "rfc": "TNO120202M92", "desde": "01/02/2026", "hasta": "01/02/2027",
        "prima_neta": "6,490.48", "descuento": "129.81", "derechos": "870.00", "iva": "1,156.91", "prima_total": "1,156.91",
        "forma_pago": "Contado", "moneda": "Pesos", "motor": "11294130144935", "serie": "3N1AB7AP0GY123456", "modelo": "2000",
        "placas": "NXG-2146", "municipio": "SAN PEDRO", "colonia": "Centro", "tipo_vehiculo": "Camiones Particulares",
        "agente_clave": "57335", "agente_nombre": "JIRO Y ASOCIADOS, AGENTE DE SEGUROS",
        "nombre_cliente": "Transportes Del Norte SA De CV", "sub_total": "7,230.67", "entidad": "Persona Moral",
        "recargos": None, "ramo": "AUTOS", "concepto": "APLICADA", "estado": None,
    }
    assert {k: got.get(k) for k in expected} == expected
    assert rows[1]["product"] == "Camiones" and a["concepto"]["rule_id"] == 1
    b = {f["field"]: f["value"] for f in rows[2]["fields"]}
    expected_b = {
        "documento": "0051234567", "desde": "18/Ago/2026", "hasta": "18/Ago/2027", "prima_neta": "7146.70", "derechos": "590.00",
        "recargos": "0.00", "iva": "1237.87", "prima_total": "8974.57", "sub_total": "7,736.70", "nombre_cliente": "MARIA LOPEZ",
        "rfc": "LOMM8001011A2", "direccion_completa": "CALLE 1, CENTRO, PUEBLA, PUEBLA, C.P. 72000", "colonia": "CENTRO",
        "municipio": "PUEBLA", "cp": "72000", "descripcion_veh": "SEDAN 4 PTAS", "tipo_vehiculo": "VEHÍCULOS RESIDENTES",
        "modelo": "2020", "placas": "ABC-123", "motor": "KA24016688M", "forma_pago": "Anual", "moneda": "Pesos",
        "agente_clave": "0098765", "agente_nombre": "JUAN PEREZ RUIZ", "entidad": "Persona Física",
        "zona": "SEDAN", "concepto": None, "estado": None,
    }
    assert {k: b.get(k) for k in expected_b} == expected_b
    assert rows[3]["fields"] == [] and rows[3]["confidence"] == "sin_datos"


def test_extraction_is_one_pass(extracted):
    plan = extracted._jdf.queryExecution().executedPlan().toString()
    # only the catalogue is aggregated, the documents stay where they are
    assert "hashpartitioning(doc_id" not in plan and "SortMergeJoin" not in plan


def test_field_sets(spark):
    from pyspark.sql import functions as F

    from fieldloom import field_sets
    from fieldloom.operators.coverage import covered_first, flag_covered, global_first
    from fieldloom.operators.fields import product_fields

    products = spark.createDataFrame([(1, "Vehículos"), (2, "Fianzas")], "product_id bigint, line string")
    own = products.join(field_sets.line_fields(spark), "line").drop("line")
    listed = product_fields(products, field_sets.global_fields(spark), own)
    counts = {r["product_id"]: r["n"] for r in listed.groupBy("product_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {1: 20 + 6, 2: 15 + 4}
    first = listed.filter("product_id = 2").orderBy(*global_first()).select(field_sets.field_label(F.col("field")).alias("l")).first()["l"]
    assert first == "RFC"
    rules = spark.createDataFrame([(1, 1, "placas", "x", True, False, None)], "rule_id bigint, product_id bigint, field string, pattern string, active boolean, draft boolean, bbox string")
    assert flag_covered(listed, rules).filter("product_id = 1").orderBy(*covered_first()).first()["field"] == "placas"


def test_needs_change_no_value(spark, monkeypatch):
    from pyspark.sql import functions as F

    from fieldloom.plans import family_a, recipes

    text = samples.POLICY_A
    texts = [
        text, text.lower(), text.replace("\n", "\r\n"), text.replace("\n", " "), text.replace("I", "İ").replace("S", "ſ"),
        text.replace("INFORMACIÓN", "INFORMACION").replace("VEHÍCULO", "VEHICULO"), text.replace("Placas:NXG2146", "Placa - NXG2146"),
        text + "\nINFORMACIÓN DEL ASEGURADO\nC.P.:\n1\n2\n3\n4\n5\n6\n06700\nINFORMACIÓN IMPORTANTE\n" + "x\n" * 12 + "ENDOSO\n" + "y\n" * 9 + "06700",
        text + "\nTNO-120202-M93\nENGLISH\n" + "x\n" * 12 + "123\nSEDAN\nMUNICIPIO: LEON\nPLAN: AMPLIA\nTRIMESTRAL USD EUROS",
        "COBERTURA QUALITAS", "Qualitas placas\nsubtotal\n" + "1\n" * 7 + "12.00", "QUALITAS\nPLACAS:\n" + "1\n" * 6 + "pendiente", "QUALITAS PLACASABC12D", None,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("company", F.lit(family_a.COMPANY))
    found = lambda: sorted(recipes.recipe_fields(docs, [family_a.FAMILY]).select("doc_id", F.to_json("recipe_fields")).collect())
    quick = found()
    plan = recipes.recipe_fields(docs, [family_a.FAMILY])._jdf.queryExecution().analyzed().toString()
    assert "Contains(_upper" in plan and len(recipes.NEEDS) > 10  # whole texts are looked at before their lines
    monkeypatch.setattr(recipes, "NEEDS", {})
    monkeypatch.setattr(recipes.Doc, "printed", lambda doc, *words, on="upper": doc.text.isNotNull())
    monkeypatch.setattr(recipes.Doc, "quick", lambda doc, *words: (doc.upper_lines, lambda line: F.lit(True)))
    assert found() == quick and len({row[1] for row in quick}) > 8
