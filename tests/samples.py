"""Two hand-made policies and the small tables they are processed with."""

from fieldloom import model as m

# first family: label block, then value block (each value eight lines below its label)
POLICY_A = "\n".join(
    [
        "Qualitas Compañía de Seguros",
        "PÓLIZA DE SEGURO DE AUTOMÓVILES",
        "INCISO 1234567890",
        "VIGENCIA 01/02/2026 01/02/2027",
        "DESDE 01/02/2026",
        "INFORMACIÓN DEL ASEGURADO",
        "TRANSPORTES DEL NORTE S.A. DE C.V.",
        "R.F.C.: TNO-120202-M92",
        "Municipio: SAN PEDRO Estado: PUEBLA",
        "COLONIA: CENTRO",
        "DESCRIPCIÓN DEL VEHÍCULO ASEGURADO",
        "Tipo: Camiones Particulares",
        "Modelo:2000 Ocupantes: 05",
        "Serie: 3N1AB7AP0GY123456 Motor:11294130144935 Color: Placas:NXG2146",
        "PRIMA NETA",
        "TASA FINANCIAMIENTO",
        "GASTOS POR EXPEDICIÓN",
        "SUBTOTAL",
        "16%",
        "I.V.A.",
        "IMPORTE TOTAL",
        "TARIFA APLICADA",
        "6,490.48",
        "-129.81",
        "870.00",
        "7,230.67",
        "1,156.91",
        "1,156.91",
        "8,387.58",
        "Agente:",
        "CIUDAD DE MEXICO",
        "JIRO Y ASOCIADOS, AGENTE DE SEGUROS",
        "57335",
        "5-46-14-58",
        "FORMA DE PAGO",
        "CONTADO",
        "MONEDA",
        "PESOS",
    ]
)

POLICY_B = "\n".join(
    [
        "Seguros GNP automóvil",
        "No. Póliza 0051234567",
        "Desde las 12 hrs del 18/Ago/2026 Hasta las 12 hrs del 18/Ago/2027",
        "Prima Neta 7,146.70",
        "Recargo por pago fraccionado 0.00",
        "Derecho de Póliza 590.00",
        "I.V.A. 1,237.87",
        "Importe por pagar 8,974.57",
    ]
)

# (text, x0, y0)
SPANS_B = [
    ("CONTRATANTE", 20, 100),
    ("Nombre", 20, 120), ("R.F.C.", 300, 120),
    ("MARIA LOPEZ", 22, 135), ("LOMM8001011A2", 302, 135),
    ("Dirección", 20, 160),
    ("CALLE 1, CENTRO,", 20, 172), ("PUEBLA, PUEBLA, C.P. 72000", 20, 184), ("pie", 20, 240),
    ("VEHÍCULO ASEGURADO", 20, 300),
    ("Descripción", 20, 310), ("SEDAN 4 PTAS", 20, 322),
    ("Procedencia", 300, 310), ("Residentes", 380, 311), ("Carga propia", 560, 310),
    ("Modelo", 20, 350), ("Placas", 120, 350), ("Motor", 220, 350),
    ("2020", 21, 362), ("ABC123", 121, 362), ("KA24016688M", 221, 362),
    ("Forma de Pago", 20, 420), ("Moneda", 120, 420),
    ("Anual", 20, 432), ("Pesos", 120, 432),
    ("AGENTE", 20, 500),
    ("Clave", 20, 510), ("Agente", 120, 510),
    ("0098765", 20, 522), ("JUAN PEREZ RUIZ", 120, 522),
]


def spans_b():
    return [
        (1, i, i, 0, t, float(x), float(y), float(x) + 6.0 * len(t), y + 8.0, 600.0, 800.0) for i, (t, x, y) in enumerate(SPANS_B)
    ]


def catalogue(spark):
    rows = [
        (m.COMPANY, 1, None, "Quálitas", "QUALITAS", ["qualitas"], ["quálitas|qualitas compañía"], True, 1),
        (m.COMPANY, 2, None, "GNP Seguros", None, ["gnp"], ["seguros gnp"], True, 2),
        (m.LINE, 1, 1, "Vehículos", None, ["placas", "automóvil", "vehículo"], [], True, None),
        (m.LINE, 2, 2, "Vehículos", None, ["automóvil"], [], True, None),
        (m.PRODUCT, 1, 1, "Automóviles", None, ["automóvil"], [r"autom[oó]viles"], True, 1),
        (m.PRODUCT, 2, 1, "Camiones", None, ["tractor"], [], True, 3),
        (m.PRODUCT, 3, 2, "Automóviles", None, ["automóvil"], [], True, 1),
    ]
    return spark.createDataFrame(rows, m.CATALOGUE_SCHEMA)


def documents(spark):
    schema = f"doc_id bigint, text string, spans array<{m.SPAN_TYPE}>"
    return spark.createDataFrame([(1, POLICY_A, None), (2, POLICY_B, spans_b()), (3, "nothing here", None), (4, "  ", None)], schema)


def rules(spark):
    rows = [
        (1, 2, "concepto", r"tarifa (\w+)", True, False, None),
        (2, 2, "documento", r"inciso (\d)", True, False, None),
        (3, 3, "concepto", r"missing (\d+)", True, False, None),
        (4, 3, "zona", r"(\w+) 4 PTAS", True, False, (1, 0.0, 0.38, 1.0, 0.42)),
        (5, 3, "off", r"gnp", False, False, None),
        (6, 3, "draft", r"gnp", True, True, None),
        (7, 3, "broken", r"gnp(", True, False, None),
    ]
    return spark.createDataFrame(rows, m.RULE_SCHEMA)


def product_fields(spark):
    from fieldloom.operators.fields import product_fields as build

    products = spark.createDataFrame([(1, "Vehículos"), (2, "Vehículos"), (3, "Vehículos"), (9, "Vida")], "product_id bigint, line string")
    globals_ = spark.createDataFrame(
        [("documento", None, None), ("rfc", None, None), ("recargos", None, None), ("moneda", None, "MXN"), ("placas", "vehiculos", None), ("ramo", None, "AUTOS")],
        "field string, group string, fixed_value string",
    )
    specific = spark.createDataFrame([(2, "estado"), (2, "ramo"), (3, "estado"), (9, "rfc"), (9, "suma")], "product_id bigint, field string")
    return build(products, globals_, specific, dedupe=False)
