"""Validators and classifiers: boolean or label columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions.binding import keep_if, let, regexp_extract
from fieldloom.functions.text import strip, upper_plain

NATURAL, LEGAL = "Persona Física", "Persona Moral"

# ---- fixed values: words that mark a legal person, matched as whole words on
# the upper-case name without accents and dots
LEGAL_FORMS = [
    r"SA(?:\s+DE\s+CV)?",
    r"S\s+DE\s+RL(?:\s+DE\s+CV)?",
    r"SAS",
    r"S\s+EN\s+NC",
    r"S\s+EN\s+CS",
    r"S\s+EN\s+C\s+POR\s+A",
    r"SOCIEDAD\s+COOPERATIVA",
    r"SC\s+DE\s+RL",
    r"SC",
    r"AC",
    r"IAP",
    r"IBP",
    r"SINDICATO(?:\s+DE)?",
    r"ASOCIACION\s+PROFESIONAL",
    r"COLEGIO\s+DE",
    r"ASOCIACION\s+RELIGIOSA",
    r"AR",
    r"PARTIDO\s+POLITICO",
    r"GOBIERNO\s+FEDERAL",
    r"GOBIERNO\s+DEL\s+ESTADO",
    r"GOBIERNO\s+MUNICIPAL",
    r"H\s+AYUNTAMIENTO",
    r"AYUNTAMIENTO\s+DE",
    r"SECRETARIA\s+DE",
    r"MUNICIPIO\s+DE",
    r"ORGANISMO\s+PUBLICO\s+DESCENTRALIZADO",
    r"OPD",
    r"INSTITUTO",
    r"COMISION\s+NACIONAL",
    r"COMISION\s+ESTATAL",
]

# ---- fixed values: plate shapes, for 6 or 7 characters
PLATE_SHAPES = [
    r"[A-Z]{2,3}\d{3,4}",
    r"[A-Z]{4}\d{2,3}",
    r"\d{2,3}[A-Z]{3,4}",
    r"[A-Z]\d{2}[A-Z]{3}",
    r"[A-Z]{2}\d{2}[A-Z]{2}",
]

# ---- fixed values: plate entries that are words
PLATE_WORDS = ["permiso", "s/n", "sn", "sin placas", "pendiente", "en trámite", "en tramite", "n/a"]

# ---- fixed values: engine words that look like tax ids
ENGINE_WORDS = ["V6", "V8", "I4", "H6", "2ZRFE", "1.6L", "2.0L", "TSI", "TDI", "DOHC", "SOHC", "TURBO", "HYBRID", "ELECTRIC"]

# ---- fixed values: states
STATES = [
    "AGUASCALIENTES", "BAJA CALIFORNIA", "BAJA CALIFORNIA SUR", "CAMPECHE", "CHIAPAS", "CHIHUAHUA",
    "CIUDAD DE MEXICO", "COAHUILA", "COLIMA", "DURANGO", "GUANAJUATO", "GUERRERO", "HIDALGO",
    "JALISCO", "MEXICO", "ESTADO DE MEXICO", "MICHOACAN", "MORELOS", "NAYARIT", "NUEVO LEON", "OAXACA", "PUEBLA",
    "QUERETARO", "QUINTANA ROO", "SAN LUIS POTOSI", "SINALOA", "SONORA", "TABASCO", "TAMAULIPAS",
    "TLAXCALA", "VERACRUZ", "YUCATAN", "ZACATECAS",
]

# ---- fixed values: payment forms and currencies
PAYMENT_FORMS = ["CONTADO", "SEMESTRAL", "TRIMESTRAL", "MENSUAL", "ANUAL"]
CURRENCIES = ["PESOS", "DÓLARES", "USD", "MXN", "EUROS", "EUR"]

# ---- fixed values: legal phrases that are never a vehicle description
LEGAL_PHRASES = [
    "ESTA POLIZA AMPARA",
    "ESTIMADO ASEGURADO QUÁLITAS COMPAÑÍA DE SEGUROS",
    "ARTÍCULO 25 DE LA LEY SOBRE EL CONTRATO DE SEGURO",
    "NUESTRA UNIDAD ESPECIALIZADA DE ATENCIÓN A USUARIOS",
    "COMISIÓN NACIONAL PARA LA PROTECCIÓN Y DEFENSA",
    "AVISO DE PRIVACIDAD INTEGRAL",
    "GENERALES Y ESPECIALES DE ESTA PÓLIZA, EL VEHÍCULO CONTRA PÉRDIDAS O DAÑOS CAUSADOS POR CUALQUIERA DE LOS RIESGOS QUE SE",
]

# ---- fixed values: a name line is refused when it holds one of these
NAME_STOP_WORDS = [
    "DOMICILIO", "RFC", "C.P", "MUNICIPIO", "ESTADO", "VIGENCIA", "TELEFONO", "DESDE LAS",
    "INFORMACIÓN IMPORTANTE", "OFICINA", "ATENCIÓN", "CANAL",
]

# ---- fixed values: legal suffixes accepted in a name line
NAME_LEGAL_SUFFIXES = [
    r"S\.?A\.?\s+DE\s+C\.?V\.?",
    r"S\.?\s+DE\s+R\.?L\.?",
    r"SOCIEDAD\s+ANONIMA",
    r"SOCIEDAD\s+DE\s+RESPONSABILIDAD\s+LIMITADA",
]

# ---- fixed values: texts that mean "nothing found"
SENTINELS = [
    "", "no encontrado", "s/n",
    "no se encontraron rfcs válidos",
    "no se encontró prima neta",
    "no se encontró tasa de financiamiento",
    "no se encontró gastos de expedición",
    "no se encontró subtotal",
    "no se encontró prima total",
    "no se encontró nombre o razón social",
    "no se encontró i.v.a.",
    "forma de pago no encontrada",
    "moneda no encontrada",
    "no se encontró bloque de asegurado",
    "no se encontró colonia",
    "no encontrada",
]

# ---- fixed values: words that make a line of business vehicular
VEHICLE_LINE_WORDS = ["vehículo", "vehiculo", "auto", "moto", "camión", "camion", "transporte", "carga"]
# ---- end of fixed values

# ---- fixed values: shapes of amounts, as printed
AMOUNT_OPTIONAL_CENTS = r"\$?\s?\d{1,3}(?:,\d{3})*(?:\.\d{2})?"
AMOUNT_SIGNED = r"-?\d{1,3}(?:,\d{3})*(?:\.\d{2})?"
AMOUNT_WITH_CENTS = r"-?\d{1,3}(?:,\d{3})*\.\d{2}"
# ---- end of fixed values


def any_of(words: list[str]) -> str:
    return "(?:" + "|".join(words) + ")"


def full_match(value: Column, pattern: str, flags: str = "(?U)") -> Column:
    return F.rlike(value, F.lit(f"{flags}\\A(?:{pattern})\\z"))


def contains_any(value: Column, words: list[str]) -> Column:
    """Does the value hold one of the words, letter by letter?"""
    return F.rlike(value, F.lit("|".join(f"\\Q{w}\\E" for w in words)))


def real_value(value: Column) -> Column:
    """The value, or NULL when it is a "nothing found" text."""
    return keep_if(value, lambda v: ~F.lower(strip(v)).isin(*SENTINELS))


def person_type(tax_id: Column) -> Column:
    """Natural person for four leading letters and six digits, legal person for three."""
    head = F.length(regexp_extract(F.upper(strip(tax_id)), "^([A-ZÑ&]{3,4})[0-9]{6}", 1))
    return let(head, lambda n: F.when(n == 4, F.lit(NATURAL)).when(n == 3, F.lit(LEGAL)))


def normal_name(name: Column) -> Column:
    """Upper case without accents and dots, single blanks."""
    return strip(F.regexp_replace(F.replace(upper_plain(name), F.lit("."), F.lit("")), "\\s+", " "))


def is_legal_person_name(name: Column) -> Column:
    """Does the name hold the form of a legal person?"""
    return F.coalesce(F.rlike(normal_name(name), F.lit(f"\\b{any_of(LEGAL_FORMS)}\\b")), F.lit(False))


def is_plate(value: Column) -> Column:
    """Six or seven characters in one of the plate shapes."""
    return F.coalesce(
        F.length(value).isin(6, 7) & full_match(F.upper(value), any_of(PLATE_SHAPES)), F.lit(False)
    )


def is_plate_word(value: Column) -> Column:
    return F.lower(value).isin(*PLATE_WORDS)


def is_postal_code(value: Column) -> Column:
    return full_match(value, r"\d{4,5}")


def is_model_year(value: Column) -> Column:
    return full_match(value, r"(?:19|20)\d{2}")


def is_serial(value: Column) -> Column:
    return full_match(value, r"[A-HJ-NPR-Z0-9]{17}")


def is_agent_key(value: Column) -> Column:
    return full_match(value, r"\d{4,6}")


def is_amount(value: Column, shape: str = AMOUNT_WITH_CENTS) -> Column:
    """Does the value start with an amount of the given shape?"""
    return F.rlike(value, F.lit(f"\\A{shape}"))


def is_tax_id_candidate(value: Column) -> Column:
    """Cleaned tax id of a usable length that is no engine word."""
    return F.length(value).isin(10, 12, 13) & ~value.isin(*ENGINE_WORDS)


def is_state(value: Column) -> Column:
    return F.upper(value).isin(*STATES)


def has_legal_phrase(value: Column) -> Column:
    return contains_any(F.upper(value), LEGAL_PHRASES)


def looks_like_name(value: Column, letters: str = "A-ZÑÁÉÍÓÚ ,\\.&") -> Column:
    """Legal suffix, or at least two upper-case words; never a stop word."""
    suffix = F.rlike(value, F.lit("(?U)" + any_of(NAME_LEGAL_SUFFIXES)))
    words = full_match(value, f"[{letters}]{{5,}}") & F.rlike(value, F.lit("\\S\\s+\\S"))
    return (value != "") & ~contains_any(value, NAME_STOP_WORDS) & (suffix | words)


def is_vehicle_line(line_name: Column) -> Column:
    """Does the name of the line of business speak of vehicles?"""
    return F.coalesce(contains_any(F.lower(line_name), VEHICLE_LINE_WORDS), F.lit(False))


def company_gate(folded: Column, name: str | None, words: list[str]) -> Column:
    """Company name printed (if asked for) and at least one of the words, in the folded text."""
    gate = reduce(Column.__or__, [F.contains(folded, F.lit(w)) for w in words])  # in a whole text cheaper than ``contains_any``
    return gate if name is None else F.contains(folded, F.lit(name)) & gate


def filled(value: Column) -> Column:
    """Neither NULL nor empty."""
    return F.coalesce(value != "", F.lit(False))
