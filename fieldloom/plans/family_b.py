"""Recipes of the second document family: car policies printed as tables.

Values are found by geometry next to or below their label; line offsets and
patterns on the plain text are the second choice.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions import amounts, checks
from fieldloom.functions import text as tx
from fieldloom.functions.binding import keep_if, let, let2, regexp_extract
from fieldloom.functions.regex import cascade, find_all, first_match
from fieldloom.operators import layout
from fieldloom.operators import locate as loc
from fieldloom.plans import family_a  # noqa: F401  shared strategies are registered there
from fieldloom.plans.recipes import ACCEPT, Doc, Family, Recipe, strategy

# ---- fixed values: company, gate words, labels and patterns of this family
COMPANY = "GNP Seguros"
GATE_WORDS = ["vehículo asegurado", "auto individual", "automóvil", "tipo de uso", "serie", "placas"]
OWN_TAX_ID = "GNP9211244P0"
TAX_ID_SHAPE = r"[A-ZÑ&]{3,4}\d{6}[A-Z0-9]{0,3}"
PAYMENT_LABELS = ["forma de pago", "moneda", "plazo para el pago", "conducto de pago", "intermediario"]
PERIOD = (r"Desde\s+las\s+\d{1,2}\s+hrs\s+del\s+(\d{1,2}/\w{1,3}/\d{4})\s+"
          r"Hasta\s+las\s+\d{1,2}\s+hrs\s+del\s+(\d{1,2}/\w{1,3}/\d{4})")
NET = r"Prima\s+Neta\s*[:\-]?\s*\$?\s*([0-9,]+\.\d{2})"
NET_DISCOUNTED = r"Prima\s*Neta\s*con\s*Descuento\s*\$?\s*([0-9,]+\.\d{2})"
DISCOUNT_MARKS = r"(?iuU)(?:Experiencia|Renovaci[oó]n|Cliente\s+Integral)\s+GNP|Campañas"
PLATE_INLINE = r"(?:Placas|Placa)\s*[:\-]?\s*([A-Z0-9]{6,7})"
# ---- end of fixed values


def gate(doc: Doc) -> Column:
    return checks.company_gate(F.lower(doc.text), None, GATE_WORDS)


def contractor_section(spans: Column) -> Column:
    """Spans of the contractor section of the first page, or the whole page without its heading."""
    return _section(spans, lambda p: layout.find_label(p, "CONTRATANTE", exact=True), _vehicle_heading)


def _vehicle_heading(page: Column) -> Column:
    return F.coalesce(layout.find_label(page, "VEHÍCULO ASEGURADO"), layout.find_label(page, "VEHICULO ASEGURADO"))


def _section(spans: Column, start, end) -> Column:
    """Spans of the first page from the start span up to the end span, or 200 points."""

    def cut(page: Column, top: Column) -> Column:
        stop = F.coalesce(end(page)["y0"], top + 200)
        return F.when(top.isNull(), page).otherwise(let(stop, lambda bottom: layout.band(page, top, bottom)))

    return let(layout.on_page(spans, 1), lambda page: let(start(page)["y0"], lambda top: cut(page, top)))


def vehicle_section(spans: Column) -> Column:
    ending = lambda p: F.coalesce(layout.find_label(p, "CONSIDERACIONES IMPORTANTES"), layout.find_label(p, "DESGLOSE DE COBERTURAS"))
    return _section(spans, _vehicle_heading, ending)


def agent_section(spans: Column) -> Column:
    """Forty points below the agent heading of the last page that has one."""
    titles = F.filter(spans, lambda s: s["text"] == "AGENTE")
    last = F.array_max(F.transform(titles, lambda s: F.struct(s["page"].alias("page"), (-s["ord"]).alias("o"), s["y0"].alias("y"))))
    below = lambda t: F.filter(spans, lambda s: (s["page"] == t["page"]) & (s["y0"] > t["y"]) & (s["y0"] <= t["y"] + 40))
    return let(last, below)


SECTIONS = {
    "page": lambda spans: layout.on_page(spans, 1),
    "contractor": contractor_section,
    "vehicle": vehicle_section,
    "agent": agent_section,
}


@strategy
def nearest(doc: Doc, section: str, labels: list[str], exact: bool = True, exclude: list[str] | None = None,
            accept: list[str] | None = None, **geometry) -> Column:
    """Value next to or below a label of a section."""

    def find(spans: Column) -> Column:
        label = F.coalesce(*[layout.find_label(spans, x, exact) for x in labels])
        return layout.nearest_value(spans, label, exclude, **geometry)

    value = let(SECTIONS[section](doc.spans), find)
    for a in accept or []:
        value = keep_if(value, ACCEPT[a])
    return value


@strategy
def nearest_any_page(doc: Doc, label: str, exclude: list[str] | None = None, **geometry) -> Column:
    return layout.over_pages(doc.spans, label, None, lambda page, span: layout.nearest_value(page, span, exclude, **geometry))


@strategy
def column(doc: Doc, section: str, label: str, exclude: list[str], **geometry) -> Column:
    """Lines below a label of a section."""
    find = lambda spans: layout.column_lines(spans, layout.find_label(spans, label, True), exclude, **geometry)
    return let(SECTIONS[section](doc.spans), find)


@strategy
def money_in_line(doc: Doc, label: str) -> Column:
    pick = lambda t: F.replace(tx.present(regexp_extract(t, F.lit(r"\$?([0-9,]+\.\d{2})"), F.lit(1))), F.lit(","), F.lit(""))
    return layout.after_label_in_line(doc.spans, label, pick)


@strategy
def option_in_line(doc: Doc, label: str, options: list[str]) -> Column:
    """Known word after a label in its line."""

    def pick(t: Column) -> Column:
        return keep_if(tx.capitalize(tx.strip(t)), lambda word: word.isin(*options))

    return layout.after_label_in_line(doc.spans, label, pick)


@strategy
def net_amount(doc: Doc, other: str) -> Column:
    """Discounted net amount when the discounts are listed one by one."""
    alternative = F.replace(first_match(doc.text, NET_DISCOUNTED, 1), F.lit(","), F.lit(""))
    return amounts.discounted_net(doc.text, doc.known[other], alternative, DISCOUNT_MARKS)


@strategy
def name_below_contractor(doc: Doc) -> Column:
    """Eighth line after the heading; a vehicle heading in between ends the search."""
    lines = doc.lines
    limit = 8

    def verdict(i: Column) -> Column:
        between = F.slice(lines, i + 2, limit)
        blocked = F.exists(between, lambda x: F.contains(F.lower(x), F.lit("vehículo asegurado")))
        name = tx.strip(F.get(lines, i + limit))
        return F.when(blocked, F.lit("")).when(F.length(name) > 4, name)

    tried = F.transform(lines, lambda line, i: F.when(F.contains(F.lower(line), F.lit("contratante")), verdict(i)))
    return tx.present(loc.first_value(tried))


@strategy
def tax_id_in_section(doc: Doc) -> Column:
    value = F.upper(nearest(doc, "contractor", ["R.F.C.", "RFC"], False, ["código de cliente", "nombre", "dirección", "referencia"], same_row=False))
    return keep_if(value, lambda v: (v != OWN_TAX_ID) & checks.full_match(v, TAX_ID_SHAPE))


@strategy
def tax_id_in_text(doc: Doc) -> Column:
    found = F.concat(
        find_all(doc.text, rf"R\.?F\.?C\.?\s*[:\-]?\s*({TAX_ID_SHAPE})", 1), find_all(doc.text, rf"\b({TAX_ID_SHAPE})\b", 1)
    )
    usable = F.filter(F.transform(found, F.upper), lambda v: (v != OWN_TAX_ID) & F.length(v).between(10, 13))
    return F.get(usable, F.lit(0))


@strategy
def period(doc: Doc, part: int) -> Column:
    return first_match(doc.text, PERIOD, part, "(?uU)")


@strategy
def before_serial(doc: Doc) -> Column:
    """Description below its label, cut before the serial label."""
    value = column(doc, "vehicle", "Descripción", ["categoría"], tol_x=10, max_dy=40, max_lines=3)
    return tx.present(tx.strip(F.get(F.split(value, "(?iuU)\\bSerie\\b"), F.lit(0))))


@strategy
def description_lines(doc: Doc) -> Column:
    """Two lines after the description label that follows the vehicle heading."""
    usable = lambda v: (v != "") & ~checks.full_match(v, r"[A-HJ-NPR-Z0-9]{17}") & ~F.rlike(F.lower(v), F.lit("(?U)serie|modelo|placa|versión"))

    def two_lines(part: Column, i: Column) -> Column:
        line = lambda k: keep_if(tx.strip(F.get(part, i + k)), usable)
        return let2(line(2), line(3), lambda one, two: F.when(two.isNotNull(), F.concat(one, F.lit(" "), two)).otherwise(one))

    label = lambda x: F.contains(F.lower(x), F.lit("descripción"))
    return let(_below_vehicle_heading(doc), lambda part: let(loc.first_index(part, label), lambda i: two_lines(part, i)))


def _below_vehicle_heading(doc: Doc) -> Column:
    """Lines after the first vehicle heading."""
    head = loc.first_index(doc.lines, lambda x: F.contains(F.lower(x), F.lit("vehículo asegurado")))
    return let(head, lambda i: F.slice(doc.lines, i + 2, F.size(doc.lines)))


@strategy
def origin(doc: Doc) -> Column:
    """Vehicle origin in the row of its label, else split over two lines beside it."""
    exclude = ["circula en", "tipo de carga", "carga propia", "tipo", "de carga"]
    value = F.coalesce(
        nearest(doc, "vehicle", ["Procedencia"], True, exclude, max_dx=100),
        column(doc, "vehicle", "Procedencia", exclude, tol_x=80, max_dy=10, max_lines=2),
    )
    return let(value, tx.vehicle_origin)


@strategy
def model_year_lines(doc: Doc) -> Column:
    label = lambda x: F.contains(F.lower(x), F.lit("modelo"))
    return let(_below_vehicle_heading(doc), lambda part: loc.label_window(part, label, 1, 4, loc.whole(checks.is_model_year)))


@strategy
def plate_or_word(doc: Doc) -> Column:
    """Plate below its label, else from table, section or text; unusual entries are kept."""
    below = nearest(doc, "vehicle", ["Placas"], True, ["modelo", "motor"], same_row=False, max_dy=18)
    in_table = layout.table_row(layout.layout_lines(doc.spans), ["modelo", "placas"], PLATE_INLINE + r"\b", lambda v: v.isNotNull())
    section = loc.section(doc.text, r"VEH[ÍI]CULO ASEGURADO", r"\n{2,}|DESGLOSE|CONSIDERACIONES|IMPORTE|OBSERVACIONES")
    in_section = first_match(section, PLATE_INLINE + r"(?=\s|$|Motor|Serie|Modelo)", 1)
    anywhere = cascade(doc.text, [r"(?:Placas|Placa)\s+([A-Z0-9]{6,7})\b", r"\b(?:Placas|Placa)[\s:]+([A-Z0-9]{6,7})\b"])

    def tidy(value: Column) -> Column:
        clean = tx.alphanumeric(value)
        return F.when(checks.is_plate_word(value), F.upper(value)).when(checks.is_plate(clean), tx.format_plate(clean)).otherwise(value)

    return let(tx.strip(F.coalesce(below, in_table, in_section, anywhere)), tidy)


@strategy
def address_lines(doc: Doc) -> Column:
    """Up to three lines from the fourth after the label, up to the one with the postal code."""
    lines = doc.lines
    label = loc.first_index(lines, lambda x: F.contains(F.lower(x), F.lit("dirección")))

    def up_to_code(part: Column) -> Column:
        code = loc.first_index(part, lambda x: F.rlike(F.lower(x), F.lit(r"(?U)c\s*\.?\s*p\s*\.?[:\s]*\d{4,5}")))
        return F.filter(F.slice(part, 1, F.coalesce(code + 1, F.lit(3))), lambda x: x != "")

    part = let(label, lambda i: F.transform(F.slice(lines, i + 5, 3), tx.strip))
    return tx.present(F.array_join(let(part, up_to_code), " "))


@strategy
def address_part(doc: Doc, other: str, part: str) -> Column:
    return tx.address_parts(doc.known[other])[part]


NO_ROW = {"same_row": False}
MONEY_FIELDS = [
    ("derechos", r"Derecho\s+(?:de\s+)?P[oó]liza\s*[:\-]?\s*\$?\s*([0-9,]+\.\d{2})", "derecho"),
    ("iva", r"I\.?V\.?A\.?\s*[:\-]?\s*\$?([0-9,]+\.\d{2})", "iva"),
    ("prima_total", r"Importe\s+(?:por|a)\s+pagar\s*[:\-]?\s*\$?([0-9,]+\.\d{2})", "importe"),
    ("recargos", r"Recargo\s+por\s+pago\s+fraccionado\s*[:\-]?\s*\$?([0-9,]+\.\d{2})", "recargo"),
]

RECIPES = [
    Recipe("documento", "regex", {"patterns": [
        r"No\.?\s*P[oó]liza\s*[:\-]?\s*([A-Z0-9\-]+)",
        r"P[oó]liza\s*(?:No\.|Núm\.?|Número)?\s*[:\-]?\s*([A-Z0-9\-]+)",
    ], "post": ["no_commas"]}),
    Recipe("documento", "nearest", {"section": "page", "labels": ["No. Póliza"], "exact": False}),
    Recipe("renovacion", "nearest", {"section": "page", "labels": ["Renovación"], "exact": False, "exclude": ["versión", "renovación"], **NO_ROW}),
    Recipe("renovacion", "label_offset", {"labels": ["renovación"], "fold": "lower", "offsets": [2], "on": "lines", "first_only": False}),
    Recipe("nombre_cliente", "nearest", {"section": "contractor", "labels": ["Nombre"], "tol_x": 20, "max_dy": 90, "accept": ["longer_than_4"],
           "exclude": ["código de cliente", "r.f.c.", "dirección", "referencia"], **NO_ROW, "post": ["company_form"]}),
    Recipe("nombre_cliente", "name_below_contractor", {"post": ["company_form"]}),
    Recipe("rfc", "tax_id_in_section"),
    Recipe("rfc", "tax_id_in_text"),
    Recipe("desde", "period", {"part": 1}),
    Recipe("hasta", "period", {"part": 2}),
    Recipe("printed_net", "regex", {"patterns": [NET], "post": ["no_commas"]}),
    Recipe("printed_net", "money_in_line", {"label": "prima neta"}),
    Recipe("printed_net", "nearest_any_page", {"label": "Prima Neta", "exclude": ["prima neta con descuento"]}),
    *[r for name, pattern, word in MONEY_FIELDS for r in (
        Recipe(name, "regex", {"patterns": [pattern], "post": ["no_commas"]}), Recipe(name, "money_in_line", {"label": word}))],
    Recipe("forma_pago", "nearest_any_page", {"label": "Forma de Pago", "exclude": PAYMENT_LABELS, "max_dy": 20, **NO_ROW}),
    Recipe("moneda", "nearest_any_page", {"label": "Moneda", "exclude": PAYMENT_LABELS, "max_dy": 20, **NO_ROW}),
    Recipe("tipo_vehiculo", "origin"),
    Recipe("descripcion_veh", "before_serial"),
    Recipe("descripcion_veh", "description_lines"),
    Recipe("serie", "regex", {"patterns": [family_a.VIN], "flags": "(?uU)"}),
    Recipe("serie", "nearest", {"section": "vehicle", "labels": ["Serie"], "exclude": ["modelo", "placas", "motor"]}),
    Recipe("motor", "regex", {"patterns": [family_a.ENGINE_INLINE], "post": ["upper"]}),
    Recipe("motor", "nearest", {"section": "vehicle", "labels": ["Motor"], "exclude": ["modelo", "placas"], "max_dy": 18, **NO_ROW}),
    Recipe("modelo", "regex", {"patterns": [family_a.MODEL_INLINE]}),
    Recipe("modelo", "nearest", {"section": "vehicle", "labels": ["Modelo"], "exclude": ["placas", "motor"], "max_dy": 18, "accept": ["model_year"], **NO_ROW}),
    Recipe("modelo", "model_year_lines"),
    Recipe("placas", "plate_or_word"),
    Recipe("agente_clave", "nearest", {"section": "agent", "labels": ["Clave"], "exclude": ["agente", "fecha de expedición"], **NO_ROW}),
    Recipe("agente_clave", "label_offset", {"labels": ["agente"], "fold": "lower", "offsets": [4], "accept": ["digits"], "on": "lines"}),
    Recipe("agente_nombre", "nearest", {"section": "agent", "labels": ["Agente"], "exclude": ["clave", "fecha de expedición"], "accept": ["longer_than_5"], **NO_ROW}),
    Recipe("agente_nombre", "label_offset", {"labels": ["agente"], "fold": "lower", "offsets": [5], "accept": ["longer_than_5"], "on": "lines"}),
    Recipe("direccion_completa", "column", {"section": "contractor", "label": "Dirección", "tol_x": 20, "max_dy": 90, "max_lines": 3,
           "exclude": ["código de cliente", "nombre", "r.f.c.", "referencia"]}),
    Recipe("direccion_completa", "address_lines"),
    Recipe("printed_subtotal", "printed_subtotal"),
    Recipe("prima_neta", "net_amount", {"other": "printed_net"}, 1),
    Recipe("colonia", "address_part", {"other": "direccion_completa", "part": "colony"}, 1),
    Recipe("municipio", "address_part", {"other": "direccion_completa", "part": "municipality"}, 1),
    Recipe("cp", "address_part", {"other": "direccion_completa", "part": "postal_code"}, 1),
    Recipe("sub_total", "reconciled_subtotal", {}, 2),
]

FAMILY = Family(COMPANY, RECIPES, gate, hidden=("printed_subtotal", "printed_net"))
