"""Field lists that come with the package: global fields and default fields per line.

They are starting values for the configuration tables; a project may store its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.text import lookup

GLOBAL_SCHEMA = "field string, label string, kind string, required boolean, order int, group string, fixed_value string"
LINE_SCHEMA = "line string, field string, label string, kind string, required boolean, order int"

# ---- fixed values: global fields (field, label, kind, required, order, group)
GLOBAL_FIELDS = [
    ("rfc", "R.F.C.", "texto", False, 6, None),
    ("documento", "Documento", "texto", True, 11, None),
    ("forma_pago", "Forma Pago", "catalogo", False, 13, None),
    ("moneda", "Moneda", "catalogo", False, 14, None),
    ("sub_ramo_sicas", "Sub Ramo", "catalogo", False, 15, None),
    ("desde", "Desde", "fecha", True, 19, None),
    ("hasta", "Hasta", "fecha", True, 20, None),
    ("prima_neta", "Prima Neta", "moneda", True, 22, None),
    ("descuento", "Descuento", "moneda", False, 23, None),
    ("recargos", "Recargos", "moneda", False, 24, None),
    ("derechos", "Derechos", "moneda", False, 25, None),
    ("sub_total", "Sub Total", "moneda", False, 26, None),
    ("iva", "IVA", "moneda", False, 27, None),
    ("prima_total", "Prima Total", "moneda", True, 28, None),
    ("concepto", "Concepto", "texto", False, 29, None),
    ("serie", "Serie", "texto", False, 30, "vehiculos"),
    ("descripcion_veh", "Descripción", "texto", False, 31, "vehiculos"),
    ("modelo", "Modelo", "numero", False, 32, "vehiculos"),
    ("motor", "Motor", "texto", False, 33, "vehiculos"),
    ("placas", "Placas", "texto", False, 34, "vehiculos"),
]

# ---- fixed values: default fields of each line (field, label, kind, required, order)
LINE_FIELDS = {
    "Vehículos": [
        ("documento", "N° de Póliza", "texto", True, 1), ("nombre_cliente", "Nombre / Razón Social", "texto", True, 2), ("rfc", "RFC", "texto", False, 3),
        ("descripcion_veh", "Descripción Vehículo", "texto", True, 4), ("placas", "Placas", "texto", False, 5), ("serie", "N° de Serie", "texto", False, 6),
        ("motor", "N° de Motor", "texto", False, 7), ("tipo_vehiculo", "Tipo de Vehículo", "texto", False, 8), ("forma_pago", "Forma de Pago", "texto", False, 10),
        ("moneda", "Moneda", "texto", False, 11), ("prima_neta", "Prima Neta", "moneda", True, 12), ("derechos", "Derechos / Gastos Exp.", "moneda", False, 13),
        ("iva", "IVA", "moneda", False, 15), ("prima_total", "Prima Total", "moneda", True, 16), ("desde", "Inicio de Vigencia", "fecha", True, 17),
        ("hasta", "Fin de Vigencia", "fecha", True, 18), ("colonia", "Colonia", "texto", False, 19), ("municipio", "Municipio / Alcaldía", "texto", False, 20),
        ("cp", "C.P.", "texto", False, 21), ("estado", "Estado", "texto", False, 22),
    ],
    "Accidentes y Enfermedades": [
        ("documento", "N° de Póliza", "texto", True, 1), ("nombre_cliente", "Contratante", "texto", True, 2), ("nombre_asegurado", "Titular / Asegurado", "texto", False, 3),
        ("rfc", "RFC", "texto", False, 4), ("fecha_nacimiento", "Fecha de Nacimiento", "fecha", False, 5), ("suma_asegurada", "Suma Asegurada", "moneda", True, 6),
        ("deducible", "Deducible", "moneda", False, 7), ("coaseguro", "Coaseguro %", "numero", False, 8), ("prima_neta", "Prima Neta", "moneda", True, 9),
        ("iva", "IVA", "moneda", False, 10), ("prima_total", "Prima Total", "moneda", True, 11), ("desde", "Inicio de Vigencia", "fecha", True, 12),
        ("hasta", "Fin de Vigencia", "fecha", True, 13), ("forma_pago", "Forma de Pago", "texto", False, 14), ("moneda", "Moneda", "texto", False, 15),
    ],
    "Vida": [
        ("documento", "N° de Póliza", "texto", True, 1), ("nombre_cliente", "Contratante", "texto", True, 2), ("nombre_asegurado", "Asegurado", "texto", False, 3),
        ("beneficiarios", "Beneficiarios", "texto", False, 4), ("rfc", "RFC", "texto", False, 5), ("suma_asegurada", "Suma Asegurada", "moneda", True, 6),
        ("prima_neta", "Prima Neta", "moneda", True, 7), ("prima_total", "Prima Total", "moneda", True, 8), ("desde", "Inicio de Vigencia", "fecha", True, 9),
        ("hasta", "Fin de Vigencia", "fecha", True, 10), ("forma_pago", "Forma de Pago", "texto", False, 11),
    ],
    "Daños": [
        ("documento", "N° de Póliza", "texto", True, 1), ("nombre_cliente", "Contratante / Asegurado", "texto", True, 2), ("rfc", "RFC", "texto", False, 3),
        ("objeto_asegurado", "Objeto Asegurado", "texto", False, 4), ("suma_asegurada", "Suma Asegurada", "moneda", True, 5), ("prima_neta", "Prima Neta", "moneda", True, 6),
        ("prima_total", "Prima Total", "moneda", True, 7), ("desde", "Inicio de Vigencia", "fecha", True, 8), ("hasta", "Fin de Vigencia", "fecha", True, 9),
        ("forma_pago", "Forma de Pago", "texto", False, 10),
    ],
    "Fianzas": [
        ("numero_fianza", "N° de Fianza", "texto", True, 1), ("afianzado", "Afianzado", "texto", True, 2), ("beneficiario", "Beneficiario / Acreedor", "texto", True, 3),
        ("monto_afianzado", "Monto Afianzado", "moneda", True, 4), ("prima_total", "Prima Total", "moneda", True, 5), ("desde", "Inicio de Vigencia", "fecha", True, 6),
        ("hasta", "Fin de Vigencia", "fecha", True, 7),
    ],
}

# ---- fixed values: labels shown for fields
FIELD_LABELS = {
    "documento": "N° Póliza", "numero_fianza": "N° Fianza", "agente": "Agente", "tipo_documento": "Tipo Documento", "sub_ramo_sicas": "Subramo Sicas",
    "renovacion": "Renovación", "nombre_cliente": "Cliente", "rfc": "RFC", "entidad": "Entidad", "ejecutivo_cuenta": "Ejecutivo Cuenta",
    "despacho": "Despacho", "vendedor": "Vendedor", "grupo": "Grupo", "nombre_asegurado": "Asegurado", "beneficiarios": "Beneficiarios",
    "beneficiario": "Beneficiario", "afianzado": "Afianzado", "fecha_nacimiento": "Fecha Nacimiento", "desde": "Inicio Vigencia", "hasta": "Fin Vigencia",
    "estatus": "Estatus", "forma_pago": "Forma Pago", "moneda": "Moneda", "prima_neta": "Prima Neta", "descuento": "Descuento", "recargos": "Recargos",
    "derechos": "Derechos/Gastos Exp.", "sub_total": "Subtotal", "subtotal": "Subtotal", "iva": "IVA", "prima_total": "Prima Total", "concepto": "Concepto",
    "suma_asegurada": "Suma Asegurada", "deducible": "Deducible", "coaseguro": "Coaseguro %", "monto_afianzado": "Monto Afianzado",
    "objeto_asegurado": "Objeto Asegurado", "placas": "Placas", "serie": "N° Serie", "motor": "N° Motor", "modelo": "Modelo (año)",
    "descripcion_veh": "Descripción Vehículo", "tipo_vehiculo": "Tipo Vehículo", "colonia": "Colonia", "municipio": "Municipio", "cp": "C.P.", "estado": "Estado",
}
# ---- end of fixed values


def global_fields(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*row, None) for row in GLOBAL_FIELDS], GLOBAL_SCHEMA)


def line_fields(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(line, *row) for line, rows in LINE_FIELDS.items() for row in rows], LINE_SCHEMA)


def field_label(field: Column) -> Column:
    """Readable label of a field, the name itself when there is none."""
    return F.coalesce(lookup(field, FIELD_LABELS), field)
