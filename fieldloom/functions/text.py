"""Text columns: lines, case, accents, context, small parsers."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions.binding import keep_if, let, regexp_extract

# What str.strip() and str.splitlines() regard as white space and line ends.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
RARE_LINE_END = "\\r\\n?|[\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
HAS_RARE_LINE_END = "[\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"  # one class of characters is searched faster
LAST_LINE_END = "\n\\z"


def _plain_letters() -> tuple[str, str]:
    """Accented letters and the plain letter each decomposes to."""
    marked, plain = [], []
    for code in range(0xC0, 0x250):
        parts = unicodedata.normalize("NFKD", chr(code))
        base = "".join(c for c in parts if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            marked.append(chr(code))
            plain.append(base)
    return "".join(marked), "".join(plain)


_MARKED, _PLAIN = _plain_letters()


def strip(value: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(value, F.lit(WHITESPACE))


def present(value: Column) -> Column:
    """NULL instead of the empty string."""
    return keep_if(value, lambda v: v != "")


def lines(text: Column) -> Column:
    """Lines of a text; a final line end adds no empty line."""
    plain = (
        F.when(F.rlike(text, F.lit(HAS_RARE_LINE_END)), F.regexp_replace(F.regexp_replace(text, RARE_LINE_END, "\n"), LAST_LINE_END, ""))
        .when(F.endswith(text, F.lit("\n")), F.regexp_replace(text, LAST_LINE_END, ""))
        .otherwise(text)
    )
    return F.split(plain, "\n")


def without_accents(value: Column) -> Column:
    """Latin letters without their marks, case kept."""
    return F.translate(F.regexp_replace(value, "\\p{Mn}+", ""), _MARKED, _PLAIN)


def upper_plain(value: Column) -> Column:
    """Upper case without accents."""
    return without_accents(F.upper(value))


def squeeze(value: Column) -> Column:
    """White space runs to one blank, trimmed."""
    return strip(F.regexp_replace(value, "(?U)\\s+", " "))


def title_case(value: Column) -> Column:
    """Capital after every non-letter, as in ``S.A. De C.V.``"""
    runs = F.regexp_extract_all(value, F.lit("(?s)(\\p{L}+|\\P{L}+)"), F.lit(0))
    cased = F.transform(runs, lambda r: F.concat(F.upper(F.substr(r, F.lit(1), F.lit(1))), F.lower(F.substr(r, F.lit(2)))))
    return F.array_join(cased, "")


def capitalize(value: Column) -> Column:
    """First letter upper, rest lower."""
    return F.concat(F.upper(F.substr(value, F.lit(1), F.lit(1))), F.lower(F.substr(value, F.lit(2))))


def alphanumeric(value: Column) -> Column:
    """Upper case, only A-Z and 0-9 kept."""
    return F.regexp_replace(F.upper(value), "[^A-Z0-9]", "")


def compact_tax_id(value: Column) -> Column:
    """Tax id without hyphens and blanks."""
    return F.regexp_replace(value, "(?U)[-\\s]", "")


def pad_postal_code(value: Column) -> Column:
    """Postal code with its leading zero restored."""
    return F.lpad(value, 5, "0")


def format_plate(value: Column) -> Column:
    """Plate with its hyphen; other lengths come back cleaned only."""
    hyphened = F.regexp_replace(alphanumeric(value), "\\A(.{3})(.{3}|[0-9].{3})\\z", "$1-$2")
    return F.regexp_replace(hyphened, "\\A([A-Z0-9]{4})([A-Z0-9]{3})\\z", "$1-$2")


def after_colon(line: Column) -> Column:
    """Trimmed text after the first colon, NULL without a colon."""
    return strip(F.get(F.split(line, ":", 2), F.lit(1)))


def after_label(line: Column, label_pattern: str) -> Column:
    """Trimmed text after a label, up to the next occurrence of the label."""
    return strip(F.get(F.split(line, label_pattern), F.lit(1)))


def context_window(text: Column, literal: Column, width: int) -> Column:
    """First case-blind hit of ``literal`` with ``width`` characters on each side."""
    at = F.instr(F.lower(text), F.lower(literal))
    start = F.greatest(F.lit(1), at - width)
    end = F.least(F.length(text), at + F.length(literal) - 1 + width)
    return F.when(at > 0, F.substr(text, start, end - start + 1))


def literal_at(text: Column, literal: Column) -> Column:
    """The hit itself, spelled as in the text."""
    at = F.instr(F.lower(text), F.lower(literal))
    return F.when(at > 0, F.substr(text, at, F.length(literal)))


def block_between(text: Column, start: str, end: str) -> Column:
    """Text between two anchors, shortest span, across lines; NULL when empty."""
    return present(regexp_extract(text, f"(?isuU){start}(.*?)(?:{end})", 1))


# ---- fixed values: abbreviated company forms and their spelling without dots.
# Longest form first; the connecting word keeps the case of the source.
COMPANY_FORMS = [
    (r"S\.?A\.?S\.?", "SAS"),
    (r"S\.?A\.?\s+(de)\s+C\.?V\.?", "SA $1 CV"),
    (r"S\.?A\.?", "SA"),
    (r"S\.?\s+(de)\s+R\.?L\.?\s+(de)\s+C\.?V\.?", "S $1 RL $2 CV"),
    (r"S\.?\s+(de)\s+R\.?L\.?", "S $1 RL"),
    (r"S\.?\s+(en)\s+N\.?C\.?", "S $1 NC"),
    (r"S\.?\s+(en)\s+C\.?S\.?", "S $1 CS"),
    (r"S\.?\s+(en)\s+C\.?\s+(por)\s+A\.?", "S $1 C $2 A"),
    (r"S\.?C\.?\s+(de)\s+R\.?L\.?", "SC $1 RL"),
    (r"S\.?C\.?", "SC"),
    (r"A\.?C\.?", "AC"),
    (r"I\.?A\.?P\.?", "IAP"),
    (r"I\.?B\.?P\.?", "IBP"),
]
# ---- end of fixed values


def plain_company_form(name: Column) -> Column:
    """Company-form abbreviations in capitals without dots (``SA de CV``)."""
    for form, replacement in COMPANY_FORMS:
        name = F.regexp_replace(name, F.lit(f"(?iuU)\\b{form}(?![A-Za-z])"), F.lit(replacement))
    return name


# ---- fixed values: key word -> vehicle origin, first hit wins
VEHICLE_ORIGINS = [
    ("ESTANCIA", "EXTRANJEROS CON ESTANCIA EN MÉXICO"),
    ("ANTIGU", "VEHÍCULOS ANTIGUOS"),
    ("BLINDAD", "VEHÍCULOS BLINDADOS"),
    ("CLASIC", "VEHÍCULOS CLÁSICOS"),
    ("FRONTERIZ", "VEHÍCULOS FRONTERIZOS"),
    ("IMPORTAD", "VEHÍCULOS IMPORTADOS"),
    ("LEGALIZAD", "VEHÍCULOS LEGALIZADOS"),
    ("RESIDENTE", "VEHÍCULOS RESIDENTES"),
]

# ---- fixed values: printed vehicle type -> product name
TYPE_TO_PRODUCT = {
    "camiones-panel": "Camiones",
    "camiones particulares": "Camiones",
    "camiones-particulares": "Camiones",
    "tractocamion": "Camiones",
    "motocicletas": "Motocicletas",
}

FLEET_PRODUCT = "Flotilla de Vehiculos"
# ---- end of fixed values


def first_category(value: Column, categories: list[tuple[str, str]], otherwise: Column | None = None) -> Column:
    """Category of the first key word contained in the value (accents and case ignored)."""

    def choose(key: Column) -> Column:
        result = F.lit(None).cast("string") if otherwise is None else otherwise
        for word, category in reversed(categories):
            result = F.when(F.contains(key, F.lit(word)), F.lit(category)).otherwise(result)
        return result

    return let(upper_plain(value), choose)


def vehicle_origin(value: Column) -> Column:
    """Canonical vehicle origin; an unknown value is kept, trimmed."""
    return first_category(value, VEHICLE_ORIGINS, strip(value))


def lookup(value: Column, table: dict[str, str]) -> Column:
    """Value of a small fixed table, NULL when the key is unknown."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), value)


def product_of_type(vehicle_type: Column) -> Column:
    """Product that a printed vehicle type stands for; NULL keeps the detected one."""
    return lookup(F.lower(squeeze(without_accents(vehicle_type))), TYPE_TO_PRODUCT)


def fleet_heading(text: Column) -> Column:
    """Fleet product when the fleet heading is printed."""
    return F.when(F.rlike(text, F.lit("(?iuU)\\bFLOTILLAS\\b")), F.lit(FLEET_PRODUCT))


ADDRESS = r"(?iuU)^.*?,\s*([^,]+),\s*([^,]+),\s*[^,]+,\s*C\.?\s*P\.?\s*(\d{4,5})\s*$"


def address_parts(address: Column) -> Column:
    """Colony, municipality and postal code of a one-line address."""
    part = lambda g: present(strip(regexp_extract(address, F.lit(ADDRESS), F.lit(g))))
    return F.struct(part(1).alias("colony"), part(2).alias("municipality"), part(3).alias("postal_code"))
