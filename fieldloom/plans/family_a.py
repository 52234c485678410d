"""Recipes of the first document family: car policies printed as line blocks.

Labels and values stand in separate blocks, so most values are found a fixed
number of lines after their label.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions import amounts, checks, votes
from fieldloom.functions import text as tx
from fieldloom.functions.binding import keep_if, let, let2, regexp_extract
from fieldloom.functions.regex import find_all, first_match
from fieldloom.operators import layout
from fieldloom.operators import locate as loc
from fieldloom.plans.recipes import Doc, Family, Recipe, date_ranking, needs, strategy

# ---- fixed values: company, gate words, labels and patterns of this family
COMPANY = "Quálitas"
GATE_NAME = "QUALITAS"
GATE_WORDS = ["VEHÍCULO", "COBERTURA", "AUTOMÓVIL", "USO PARTICULAR", "PLACAS"]

DATES = [
    r"\d{2}/\d{2}/\d{4}",
    r"\d{2}-\d{2}-\d{4}",
    r"\d{4}-\d{2}-\d{2}",
    r"\d{2} de [A-ZÁÉÍÓÚÑ]+ de \d{4}",
    r"(\d{2}/(ENE|FEB|MAR|ABR|MAY|JUN|JUL|AGO|SEP|OCT|NOV|DIC)/\d{2,4})",
]
TAX_ID = r"\b[A-Z&Ñ]{3,4}[-\s]?\d{6}[-\s]?[A-Z0-9]{0,3}\b"
INSURED_BLOCK = r"INFORMACION DEL ASEGURADO.*?(?:\n\n|\Z)"
INSURED = r"INFORMACIÓN DEL ASEGURADO"
INSURED_ANY = r"INFORMACI[ÓO]N DEL ASEGURADO"
INSURED_LABELS = ["INFORMACIÓN DEL ASEGURADO", "INFORMACION DEL ASEGURADO"]
VEHICLE = r"DESCRIPCIÓN DEL VEHÍCULO ASEGURADO"
VEHICLE_ANY = r"DESCRIPCI[ÓO]N DEL VEH[ÍI]CULO ASEGURADO"
VEHICLE_LABELS = ["DESCRIPCIÓN DEL VEHÍCULO ASEGURADO", "DESCRIPCION DEL VEHICULO ASEGURADO", "DESCRIPCIÓN DEL VEHICULO ASEGURADO", "DESCRIPCION DEL VEHÍCULO ASEGURADO"]
VIN = r"\b([A-HJ-NPR-Z0-9]{17})\b"
ENGINE_INLINE = r"Motor\s*:\s*([A-Za-z0-9]+?)\s*(?=Color\s*:|Placas\s*:|\n|$)"
ENGINE_WORDS = ["HECHO EN", "FABRICADO EN", "ENSAMBLADO EN"]
MODEL_INLINE = r"Modelo\s*:\s*((?:19|20)\d{2})\b"
VEHICLE_TYPES = [
    r"Autom[oó]viles\s+Nacionales",
    r"Autom[oó]viles\s+Especiales",
    r"Autom[oó]viles\s+Importados",
    r"Camiones-Panel",
    r"Camiones[-\s]+Particulares",
    r"Motocicletas",
    r"Tractocami[oó]n",
]
PLATE_INLINE = r"(?:Placas|Placa)\s*[:\-]?\s*([A-Z0-9]{5,8})"
PLATE_ANYWHERE = [
    r"(?:Placas|Placa)\s+([A-Z0-9]{5,8})\b",
    r"\b(?:Placas|Placa)[\s:]+([A-Z0-9]{5,8})\b",
    r"\b([A-Z]{2,4}\d{2,5})\b",
    r"\b(\d{2,5}[A-Z]{2,4})\b",
    r"\b([A-Z0-9]{5,8})\b",
]
PLATE_LABELS = ["placas:", "placa:"]
STREET_WORDS = r"\b(MZA|MZ|MANZANA|LTE|LOTE|CALLE|AV\.?|AVENIDA|NO\.?\s*EXT|NO\.?\s*INT|COLONIA)\b"
SUBTOTAL_INLINE = r"Subtotal[^\n]*?(-?[\d,]+\.\d{2})"
PLATE_AFTER_LABEL = r"Placas?[\s:\-]*(?=[A-Z0-9]{6})" + checks.any_of(checks.PLATE_SHAPES)  # all labelled plates begin so
POLICY_TYPES = ["AMPLIA", "LIMITADA", "BÁSICA", "RESPONSABILIDAD CIVIL"]
# ---- end of fixed values


def gate(doc: Doc) -> Column:
    return checks.company_gate(doc.upper, GATE_NAME, GATE_WORDS)


def labelled(fold: str = "lower"):
    return lambda line: let(F.lower(line), loc.has(*PLATE_LABELS))


@strategy
def tax_id_vote(doc: Doc) -> Column:
    """Full-length ids first, those of the insured section before all others."""
    found = F.transform(find_all(doc.upper, TAX_ID, flags="(?uU)"), tx.compact_tax_id)
    usable = F.filter(found, lambda v: ~v.isin(*checks.ENGINE_WORDS))
    blocks = find_all(doc.upper, INSURED_BLOCK, flags="(?suU)")
    full = lambda v: F.length(v).isin(12, 13)
    inside = lambda v, bs: F.exists(bs, lambda b: F.contains(b, v))

    def choose(known: Column) -> Column:
        # where a block stands counts only among several full ids
        several = F.size(F.filter(F.array_distinct(known), full)) > 1
        in_block = let(F.when(several, blocks), lambda bs: votes.preferred(F.when(bs.isNotNull(), known), [lambda v: full(v) & inside(v, bs)]))
        return F.coalesce(in_block, votes.preferred(known, [full, lambda v: F.length(v) == 10]))

    return let(usable, choose)


@strategy
@needs(lambda doc: doc.printed("INFORMACION DEL ASEGURADO", "INFORMACIÓN DEL ASEGURADO"))
def name_after_label(doc: Doc) -> Column:
    """Name on the label line itself, else on one of the next five lines."""
    label = "INFORMACION DEL ASEGURADO|INFORMACIÓN DEL ASEGURADO"
    same_line = lambda lines, i: loc.whole(lambda v: ~checks.contains_any(v, checks.NAME_STOP_WORDS))(tx.after_label(F.get(lines, i), label))
    below = loc.step_window(1, 5, loc.whole(checks.looks_like_name))
    return loc.label_steps(doc.upper_lines, loc.has("INFORMACION DEL ASEGURADO", "INFORMACIÓN DEL ASEGURADO"), [same_line, below], first_only=True)


@strategy
def name_after_field(doc: Doc, other: str) -> Column:
    """Name on one of the two lines after the line that holds another field."""
    value = doc.known[other]
    after = loc.first_index(doc.upper_lines, lambda line: F.contains(line, value))
    pick = loc.whole(lambda v: checks.looks_like_name(v, "A-ZÑÁÉÍÓÚ ,\\.&0-9\\-"))
    return let(after, lambda i: F.get(loc.window_values(doc.upper_lines, i, 1, 2, pick), F.lit(0)))


@strategy
def engine_after_serial(doc: Doc) -> Column:
    """The line after the one with the serial number."""
    vin = first_match(doc.text, VIN, 1, "(?uU)")
    made = lambda line: F.rlike(F.upper(line), F.lit("^" + checks.any_of(ENGINE_WORDS)))
    return let(loc.relative_to(doc.lines, vin, 1), lambda line: F.when(made(line), tx.title_case(line)).otherwise(line))


@strategy
@needs(lambda doc: doc.printed("MOTOR"))
def engine_far_below(doc: Doc) -> Column:
    def usable(v: Column) -> Column:
        return F.when(F.rlike(v, F.lit(r"(?U)\b[A-Z0-9]{9,13}\b")), v).when(checks.contains_any(v, ENGINE_WORDS), tx.title_case(v))

    pick = lambda line: let(tx.strip(line), usable)
    return loc.label_offset(doc.upper_lines, loc.has("MOTOR"), [9, 10, 11], pick)


@strategy
@needs(lambda doc: doc.printed("SERIE"))
def serial_number(doc: Doc) -> Column:
    pick = loc.found(r"\b[A-Z0-9]{12,17}\b")
    return loc.label_offset(doc.upper_lines, loc.has("SERIE"), [0, 9, 10, 11, 12], pick)


def _plate(line: Column) -> Column:
    return loc.whole(checks.is_plate)(line)


@strategy
def plates(doc: Doc) -> Column:
    """Validated plate from several places, then looser forms near the label."""
    any_label = doc.printed("PLACA")  # no other letter is upper-case P, L, A or C
    shown = doc.quick("ASEGURADO")
    near_heading = F.when(doc.printed("ASEGURADO"), loc.label_window(doc.lines, loc.mentions(*INSURED_LABELS, *VEHICLE_LABELS), 0, 10, _plate, first_only=False, quick=shown))
    near_label = F.when(any_label, loc.label_window(doc.lines, labelled(), 0, 10, _plate, first_only=False, quick=doc.quick("PLACA")))
    in_table = layout.table_row(layout.layout_lines(doc.spans), ["modelo", "placas"], PLATE_INLINE + r"\b", checks.is_plate)
    in_vehicle = loc.section(doc.text, r"VEH[ÍI]CULO ASEGURADO", r"\n{2,}|DESGLOSE|CONSIDERACIONES|IMPORTE|OBSERVACIONES")
    in_section = first_match(in_vehicle, PLATE_INLINE + r"(?=\s|$|Motor|Serie|Modelo)", 1)
    valid = lambda v: keep_if(v, checks.is_plate)
    anywhere = [valid(first_match(doc.text, p, 1)) for p in PLATE_ANYWHERE]
    labelled_ones = [v for p, v in zip(PLATE_ANYWHERE, anywhere) if "Placa" in p]  # these come first
    after_label = F.when(any_label & F.rlike(doc.text, F.lit("(?iuU)" + PLATE_AFTER_LABEL)), F.coalesce(valid(in_section), *labelled_ones))
    strict = tx.format_plate(F.coalesce(near_heading, near_label, in_table, after_label, *anywhere[len(labelled_ones):]))

    described = tx.lines(F.when(any_label & doc.printed("CULO ASEGURADO"), tx.block_between(doc.text, VEHICLE_ANY, r"\n{2,}|DATOS|OBSERVACIONES|COBERTURAS|RESPONSABLE")))
    five = loc.first_value(
        F.transform(described, lambda x: F.when(labelled()(x), keep_if(tx.alphanumeric(tx.after_colon(x)), lambda v: F.length(v) == 5)))
    )

    def loose(i: Column) -> Column:
        far = tx.strip(loc.at(doc.lines, i + 7))
        inline = loc.without(tx.after_colon(loc.at(doc.lines, i)), ["none", ""])
        return F.when(far.isNotNull(), F.when(F.length(far).between(5, 10), far)).otherwise(F.coalesce(five, inline))

    return F.coalesce(strict, F.when(any_label, let(loc.first_index(doc.lines, labelled(), doc.quick("PLACA")), loose)))


def postal_code_candidates(text: Column, lines: Column, upper: Column | None = None) -> Column:
    """Postal codes from three anchors, in the order they are looked at.

    ``upper``: the upper-case text, where each anchor is looked for first.
    """
    upper = F.upper(text) if upper is None else upper
    code = loc.whole(checks.is_postal_code)

    def after(part: Column, label: loc.LineTest, first: int, last: int, only_first: bool) -> Column:
        def values(line: Column, i: Column) -> Column:
            held = loc.window_values(part, i, first, last, code)
            return F.when(label(line), F.slice(held, 1, 1) if only_first else held)

        return F.flatten(F.filter(F.transform(part, values), lambda v: v.isNotNull()))

    printed = lambda word, found: F.when(text.isNotNull(), F.when(F.contains(upper, F.lit(word)), found).otherwise(F.array().cast("array<string>")))
    inside = lambda block: let(tx.lines(block), lambda part: after(part, loc.word("C.P.:", r"\bC\.P\.:"), 7, 9, True))
    by_item = after(lines, loc.word("INCISO", r"\bINCISO\b"), 7, 9, False)
    blocks = F.split(text, "(?iuU)" + INSURED_ANY)
    inner = let(blocks, lambda bs: F.transform(F.slice(bs, 2, F.greatest(F.size(bs) - 1, F.lit(0))), inside))
    five = loc.found(r"\b\d{5}\b")
    by_note = F.filter(
        F.transform(lines, lambda line, i: F.when(loc.word("ENDOSO", r"\bENDOSO\b")(line), five(loc.at(lines, i + 10)))), lambda v: v.isNotNull()
    )
    in_blocks = F.when(F.contains(upper, F.lit("C.P.:")), F.flatten(inner)).otherwise(F.array().cast("array<string>"))
    return F.concat(printed("INCISO", by_item), printed("DEL ASEGURADO", in_blocks), printed("ENDOSO", by_note))


@strategy
def postal_code_vote(doc: Doc) -> Column:
    return tx.pad_postal_code(votes.most_common(postal_code_candidates(doc.text, doc.lines, doc.upper)))


@strategy
@needs(lambda doc: doc.printed("MUNICIPIO"))
def municipality(doc: Doc) -> Column:
    """Inline up to the state label, inline alone, else between postal code and state."""
    place = lambda v: keep_if(v, lambda x: (x != "") & ~checks.is_state(x) & ~checks.is_postal_code(x))
    inline = lambda pattern: lambda lines, i: place(tx.strip(regexp_extract(F.get(lines, i), F.lit("(?iuU)" + pattern), F.lit(1))))

    def between(lines: Column, i: Column) -> Column:
        return loc.between_at(lines, i, checks.is_postal_code, checks.is_state, 15)

    return loc.label_steps(
        doc.lines, loc.word("MUNICIPIO", r"\bMunicipio\b"),
        [inline(r"Municipio\s*:\s*(.*?)\s*Estado\s*:"), inline(r"Municipio\s*:\s*(.+)"), between], quick=doc.quick("MUNICIPIO"),
    )


@strategy
def vehicle_type(doc: Doc) -> Column:
    """Known type near the heading, by vote over all headings, else after any type label."""
    known = lambda v: keep_if(v, lambda x: F.rlike(x, F.lit("(?iuU)^" + checks.any_of(VEHICLE_TYPES))))
    labelled_type = lambda line: F.when(
        loc.mentions("TIPO")(line), known(tx.strip(regexp_extract(line, r"(?iuU)Tipo\s*:\s*(.+)", 1)))
    )
    pick = lambda line: F.coalesce(known(tx.strip(line)), labelled_type(line))
    heading = loc.mentions(VEHICLE)
    shown, typed = doc.quick(VEHICLE), doc.quick("TIPO")
    near = loc.label_window(doc.lines, heading, 0, 10, pick, quick=shown)
    both = lambda line: F.filter(F.array(known(tx.strip(line)), labelled_type(line)), lambda v: v.isNotNull())
    around = loc.tested(doc.lines, heading, lambda ok, i: F.when(ok, F.flatten(F.transform(F.slice(doc.lines, i + 1, 11), both))), shown)
    voted = votes.most_common(F.flatten(F.filter(around, lambda v: v.isNotNull())))
    anywhere = loc.tested(doc.lines, loc.mentions("TIPO"), lambda ok, i: F.when(ok, labelled_type(F.get(doc.lines, i))), typed)
    headed = F.when(doc.printed(VEHICLE), F.coalesce(near, voted))
    return F.coalesce(headed, F.when(doc.printed("TIPO"), loc.first_value(anywhere)))


@strategy
@needs(lambda doc: doc.printed("ENGLISH", "INFORMACIÓN IMPORTANTE", INSURED))
def vehicle_description(doc: Doc) -> Column:
    """Vote over up to four lines near three anchors; legal phrases void the result."""
    lines = doc.lines
    number = lambda i, k: tx.strip(loc.at(lines, i + k))
    is_number = lambda v: checks.full_match(v, r"\d{2,5}")

    def numbered(i: Column) -> Column:
        held = F.array().cast("array<string>")
        for k in (14, 13, 12):
            held = F.when(is_number(number(i, k)), F.array(number(i, k), number(i, k + 1))).otherwise(held)
        return held

    first_date = lambda block: F.get(date_ranking(tx.upper_plain(F.array_join(block, "\n")), DATES), F.lit(0))

    def before_date(block: Column, date: Column) -> Column:
        j = loc.first_index(block, lambda line: F.contains(line, date))
        return let(j, lambda k: F.when(k > 1, tx.strip(F.get(block, k - 1))))

    notice = "INFORMACIÓN IMPORTANTE"
    insured = F.when(doc.printed(notice), loc.section_lines(lines, loc.mentions(INSURED), loc.mentions(notice), doc.quick(notice)))
    dated = let(insured, lambda block: let(first_date(block), lambda date: before_date(block, date)))
    head = F.when(doc.printed(INSURED), loc.section_lines(lines, loc.mentions("PÓLIZA DE SEGURO DE AUTOMÓVILES"), loc.mentions(INSURED), doc.quick(INSURED)))
    at_end = let(head, lambda block: F.when(first_date(block).isNotNull() & (F.size(block) > 7), tx.strip(F.get(block, F.size(block) - 7))))

    def vote(dated_line: Column, end_line: Column) -> Column:
        by_number = let(F.when(doc.printed("ENGLISH"), loc.first_index(lines, loc.mentions("ENGLISH"), doc.quick("ENGLISH"))), numbered)
        void = F.coalesce(checks.has_legal_phrase(end_line), F.lit(False))
        return F.when(~void, votes.most_common(F.concat(by_number, F.array(dated_line, end_line))))

    return let2(dated, at_end, vote)


def _insured_block(lines: Column) -> Column:
    return loc.section_lines(
        lines, loc.has("INFORMACION DEL ASEGURADO", "INFORMACIÓN DEL ASEGURADO"),
        loc.has("DESCRIPCION DEL VEHICULO ASEGURADO", "DESCRIPCIÓN DEL VEHÍCULO ASEGURADO"),
    )


@strategy
@needs(lambda doc, other: doc.printed("DEL VEHICULO ASEGURADO", "DEL VEHÍCULO ASEGURADO"))
def colony(doc: Doc, other: str) -> Column:
    """Below its label or at the block end, preceded by a state; else after the municipality line."""
    state = lambda line: line.isin(*checks.STATES)
    labelled_line = lambda x: F.rlike(x, F.lit(r"(?iuU)\bCOLONIA:"))
    labelled_block = doc.printed("COLON")  # not the whole word, whose I stands for a dotted one too
    under = lambda lines, i: tx.after_colon(keep_if(F.get(lines, i + 1), labelled_line))

    def search(block: Column, place: Column) -> Column:
        below = F.when(labelled_block, loc.context_window(block, loc.word("COLONIA:", r"\bCOLONIA:"), 6, 9, 5, state))
        last = loc.penultimate_line(block, 5, state)
        after_place = F.when(labelled_block, loc.label_steps(doc.upper_lines, lambda line: F.contains(line, place), [under]))
        return F.when(block.isNotNull(), tx.title_case(F.coalesce(below, last, after_place)))

    return let2(_insured_block(doc.upper_lines), F.upper(doc.known[other]), search)


@strategy
@needs(lambda doc, start_date, postal_code: doc.printed(INSURED))
def address(doc: Doc, start_date: str, postal_code: str) -> Column:
    """Line before the postal code of the insured block, else near the start date."""
    lines = doc.lines
    block = F.when(doc.printed(VEHICLE), loc.section_lines(lines, loc.mentions(INSURED), loc.mentions(VEHICLE), doc.quick(VEHICLE)))
    code = lambda part: let(F.array_join(part, "\n"), lambda t: tx.pad_postal_code(votes.most_common(postal_code_candidates(t, part, F.upper(t)))))
    in_block = let(block, lambda part: F.when(part.isNotNull(), loc.line_before(part, code(part))))

    street = loc.whole(lambda v: F.rlike(v, F.lit("(?iuU)" + STREET_WORDS)))

    def near(i: Column, stop: Column) -> Column:
        tries = [F.when(i + k < stop, street(loc.at(lines, i + k))) for k in range(2, 6)]
        return F.when(i < stop, F.coalesce(*tries, loc.line_before(lines, doc.known[postal_code])))

    date_line = loc.first_index(lines, lambda line: F.contains(line, doc.known[start_date]))
    return F.coalesce(in_block, let2(date_line, loc.first_index(lines, loc.mentions(INSURED), doc.quick(INSURED)), near))


@strategy
@needs(lambda doc, part: F.contains(doc.text, F.lit("Agente:")))
def agent(doc: Doc, part: str) -> Column:
    return loc.numbered_block(doc.text, "Agente:", checks.is_agent_key)[part]


@strategy
@needs(lambda doc: doc.printed("SUBTOTAL"))
def printed_subtotal(doc: Doc) -> Column:
    exact = loc.equals("subtotal", F.lower)
    return F.coalesce(
        first_match(doc.text, SUBTOTAL_INLINE, 1),
        loc.label_offset(doc.lines, exact, [8], loc.whole(lambda v: checks.full_match(v, r"-?[\d,]+\.\d{2}")), quick=doc.quick("SUBTOTAL")),
    )


@strategy
def reconciled_subtotal(doc: Doc) -> Column:
    """Computed subtotal, checked against total and tax, else the printed one."""
    k = doc.known
    none = F.lit(None).cast("string")
    computed = amounts.subtotal(k["prima_neta"], k.get("descuento", none), k.get("recargos", none), k["derechos"])
    return amounts.reconcile(computed, k["printed_subtotal"], k["prima_total"], k["iva"])["value"]


RECIPES = [
    Recipe("documento", "regex", {"patterns": [r"INCISO\s+(\d{7,15})"], "flags": "(?uU)"}),
    Recipe("documento", "regex", {"patterns": [
        r"P[oó]liza\s*(?:No\.|Núm\.?|Número)?\s*[:\-]?\s*([A-Z0-9\-]{6,20})",
        r"No\.?\s*de\s*P[oó]liza\s*[:\-]?\s*([A-Z0-9\-]{6,20})",
        r"N°\s*P[oó]liza\s*[:\-]?\s*([A-Z0-9\-]{6,20})",
    ]}),
    Recipe("rfc", "tax_id_vote"),
    Recipe("dates", "date_list", {"patterns": DATES}),
    Recipe("desde", "pick_from", {"other": "dates", "place": 0}, 1),
    Recipe("hasta", "pick_from", {"other": "dates", "place": 1}, 1),
    Recipe("prima_neta", "label_offset", {"labels": ["PRIMA NETA"], "offsets": [8, 1], "value": checks.AMOUNT_OPTIONAL_CENTS, "post": ["no_blanks"]}),
    Recipe("descuento", "label_offset", {"labels": ["TASA FINANCIAMIENTO"], "offsets": [8, 1], "value": checks.AMOUNT_SIGNED, "first_only": False, "post": ["unsigned"]}),
    Recipe("derechos", "label_offset", {"labels": ["GASTOS POR EXPEDICIÓN", "GASTOS DE EXPEDICIÓN"], "offsets": [8, 1], "value": checks.AMOUNT_WITH_CENTS, "first_only": False}),
    Recipe("iva", "label_offset", {"labels": ["I.V.A.", "IVA"], "offsets": [7], "value": checks.AMOUNT_WITH_CENTS, "first_only": False}),
    Recipe("iva", "label_offset", {"labels": [r"16\s*%"], "test": "pattern", "offsets": [1], "value": checks.AMOUNT_WITH_CENTS, "first_only": False}),
    Recipe("prima_total", "label_steps", {"labels": ["IMPORTE TOTAL", "PRIMA TOTAL"], "steps": [
        {"at": 7, "value": checks.AMOUNT_WITH_CENTS},
        {"first": 1, "last": 35, "which": "last", "value": checks.AMOUNT_WITH_CENTS},
    ]}),
    Recipe("forma_pago", "label_offset", {"labels": ["FORMA DE PAGO"], "offsets": [1, 45], "accept": ["payment_form"], "first_only": False, "post": ["title"]}),
    Recipe("forma_pago", "word_vote", {"words": checks.PAYMENT_FORMS, "post": ["title"]}),
    Recipe("moneda", "label_offset", {"labels": ["MONEDA"], "offsets": [1], "accept": ["currency"], "first_only": False, "post": ["title"]}),
    Recipe("moneda", "word_vote", {"words": checks.CURRENCIES, "post": ["title"]}),
    Recipe("motor", "regex", {"patterns": [ENGINE_INLINE], "post": ["upper"]}),
    Recipe("motor", "engine_after_serial"),
    Recipe("motor", "engine_far_below"),
    Recipe("serie", "serial_number"),
    Recipe("modelo", "regex", {"patterns": [MODEL_INLINE]}),
    Recipe("modelo", "label_offset", {"labels": ["Color:"], "test": "equals", "offsets": [3], "accept": ["model_year"], "on": "lines"}),
    Recipe("placas", "constant_if", {"pattern": "tr[áa]mite", "value": "TRÁMITE"}),
    Recipe("placas", "plates"),
    Recipe("cp", "postal_code_vote"),
    Recipe("municipio", "municipality"),
    Recipe("tipo_vehiculo", "vehicle_type"),
    Recipe("descripcion_veh", "vehicle_description"),
    Recipe("agente_clave", "agent", {"part": "key"}),
    Recipe("agente_nombre", "agent", {"part": "name"}),
    Recipe("printed_subtotal", "printed_subtotal"),
    Recipe("policy_type", "line_vote", {"pattern": r"PLAN:\s*(AMPLIA|LIMITADA|BÁSICA|RESPONSABILIDAD CIVIL)", "post": ["title"]}),
    Recipe("policy_type", "word_vote", {"words": POLICY_TYPES, "post": ["title"]}),
    Recipe("nombre_cliente", "name_after_label", {"post": ["title", "company_form"]}, 2),
    Recipe("nombre_cliente", "name_after_field", {"other": "hasta", "post": ["title", "company_form"]}, 2),
    Recipe("nombre_cliente", "label_offset", {"labels": ["FAX"], "offsets": [7], "accept": ["not_stopped"], "first_only": False, "post": ["title", "company_form"]}, 2),
    Recipe("colonia", "colony", {"other": "municipio"}, 1),
    Recipe("direccion_completa", "address", {"start_date": "desde", "postal_code": "cp"}, 2),
    Recipe("sub_total", "reconciled_subtotal", {}, 1),
]

FAMILY = Family(COMPANY, RECIPES, gate, hidden=("dates", "printed_subtotal", "policy_type"))
