"""Worked cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import amounts, checks, regex, text, votes


@pytest.fixture(scope="module")
def evaluate(spark):
    def run(build, *values, types=None):
        ddl = ", ".join(f"c{i} {(types or ['string'] * len(values))[i]}" for i in range(len(values))) or "c0 string"
        df = spark.createDataFrame([tuple(values) or (None,)], ddl)
        return df.select(build(*[F.col(f"c{i}") for i in range(len(values))]).alias("v")).first()["v"]

    return run


@pytest.mark.parametrize("pattern, body, expected", [
    (r"total: \d+", "a\n TOTAL: 12 ", "TOTAL: 12"),
    (r"^x=(\w+)$", "y\nX=Ñandú\nz", "Ñandú"),
    (r"(?P<n>\d+)-(?P=n)", "12-13 14-14", "14"),
    (r"(a)|(b)", "b", None),
    (r"a(x)?b", "ab", "ab"),
    (r"(broken", "broken", None),
    (r"nothing", "text", None),
    (r"[[&]+", "a[&b", "[&"),
    (r"Ó", "ó", "ó"),
])
def test_apply_pattern(evaluate, pattern, body, expected):
    assert evaluate(lambda t: regex.apply_pattern(t, pattern), body) == expected


def test_patterns_per_row_agree_with_literal_patterns(spark):
    cases = [(r"total: \d+", "TOTAL: 12"), (r"^x=(\w+)$", "y\nx=1\nz"), (r"(a)|(b)", "b"), (r"a(x)?b", "ab"), ("(", "("), ("no", "yes")]
    df = spark.createDataFrame(cases, "p string, t string").withColumn("r", regex.prepare_column("p"))
    value = F.when(F.col("r.java").isNotNull(), regex.extract_value(
        F.col("t"), F.coalesce("r.java", F.lit("x")), F.coalesce("r.groups", F.lit(0)), F.coalesce("r.optional_first", F.lit(False))))
    got = {r["p"]: r["v"] for r in df.select("p", value.alias("v")).collect()}
    for p, t in cases:
        one = spark.createDataFrame([(t,)], "t string").select(regex.apply_pattern(F.col("t"), p).alias("v")).first()["v"]
        assert got[p] == one, p


@pytest.mark.parametrize("body, expected", [("a\r\nb\n\nc\n", ["a", "b", "", "c"]), ("a b", ["a", "b"]), ("a\n\n", ["a", ""]), ("x\x0by", ["x", "y"])])
def test_lines_like_splitlines(evaluate, body, expected):
    assert body.splitlines() == expected
    assert evaluate(text.lines, body) == expected


@pytest.mark.parametrize("value", ["S.A. DE C.V.", "maría o'neil 3rd", "ÑANDÚ-x"])
def test_title_case(evaluate, value):
    assert evaluate(text.title_case, value) == value.title()


@pytest.mark.parametrize("value, expected", [
    ("Empresa S.A. de C.V.", "Empresa SA de CV"), ("Academia del Sur", "Academia del Sur"), ("X S. DE R.L. DE C.V.", "X S DE RL DE CV"),
    ("Y s.a.s.", "Y SAS"), ("Z S. en C. por A.", "Z S en C por A"), ("W S.C. de R.L.", "W SC de RL"), ("V I.A.P.", "V IAP"), ("U A.C.", "U AC"),
])
def test_company_form(evaluate, value, expected):
    assert evaluate(text.plain_company_form, value) == expected


@pytest.mark.parametrize("value, expected", [("ABC123", "ABC-123"), ("abc1234", "ABC-1234"), ("ABCD123", "ABCD-123"), ("AB 12", "AB12")])
def test_plates(evaluate, value, expected):
    assert evaluate(text.format_plate, value) == expected


@pytest.mark.parametrize("value, ok", [("ABC123", True), ("AB12CD", True), ("123ABCD", True), ("A12BCD", True), ("ABCDE1", False), ("ABC12", False), (None, False)])
def test_plate_shapes(evaluate, value, ok):
    assert evaluate(checks.is_plate, value) is ok


@pytest.mark.parametrize("value, expected", [("LOMM800101", "Persona Física"), ("LOMM8001011A2", "Persona Física"), ("SLE120202M92", "Persona Moral"), ("AB120202", None), ("", None)])
def test_person_type(evaluate, value, expected):
    assert evaluate(checks.person_type, value) == expected


@pytest.mark.parametrize("value, ok", [("Empresa S.A. de C.V.", True), ("Sindicato de X", True), ("H. Ayuntamiento", True), ("Academia", False), ("Asociación Religiosa Y", True), ("", False)])
def test_legal_person(evaluate, value, ok):
    assert evaluate(checks.is_legal_person_name, value) is ok


@pytest.mark.parametrize("args, expected", [(("6490.48", "129.81", None, "870.00"), "7,230.67"), (("7146.70", None, "0.00", "590.00"), "7,736.70"), ((None, "1", "1", "1"), None), (("x", None, None, "5"), "5.00")])
def test_subtotal(evaluate, args, expected):
    assert evaluate(amounts.subtotal, *args) == expected


@pytest.mark.parametrize("args, value, status", [
    (("7,230.67", "9.00", "8,387.58", "1,156.91"), "7,230.67", "checked"), (("7,230.67", "9.00", "8,387.00", "1,156.91"), "9.00", "printed"),
    (("7,230.67", None, "1.00", None), "7,230.67", "unchecked"), ((None, None, None, None), None, None), ((None, "9.00", "1", "1"), "9.00", "printed"),
])
def test_reconcile(evaluate, args, value, status):
    got = evaluate(amounts.reconcile, *args)
    assert (got["value"], got["status"]) == (value, status)


def test_votes(evaluate):
    assert evaluate(lambda a: votes.most_common(a), ["b", "a", "a", "b", "c", None], types=["array<string>"]) == "b"
    assert evaluate(lambda a: votes.top_values(a, 2), ["x", "y", "y", "z"], types=["array<string>"]) == ["y", "x"]
    assert evaluate(lambda a: votes.most_common(a), [], types=["array<string>"]) is None
    assert evaluate(lambda t: votes.word_vote(t, ["CONTADO", "ANUAL"]), "nothing") is None
    assert evaluate(lambda t: votes.word_vote(t, ["CONTADO", "ANUAL"], legacy_vote=True), "nothing") == "CONTADO"
    assert evaluate(lambda t: votes.word_vote(t, ["CONTADO", "ANUAL"]), "ANUAL y ANUAL, CONTADO") == "ANUAL"


@pytest.mark.parametrize("value, expected", [("vehiculos residentes", "VEHÍCULOS RESIDENTES"), (" clásico ", "VEHÍCULOS CLÁSICOS"), (" otro ", "otro")])
def test_origin(evaluate, value, expected):
    assert evaluate(text.vehicle_origin, value) == expected


@pytest.mark.parametrize("value, expected", [("Camiones  Particulares", "Camiones"), ("Tractocamión", "Camiones"), ("Automóviles Nacionales", None)])
def test_product_of_type(evaluate, value, expected):
    assert evaluate(text.product_of_type, value) == expected


def test_small_parsers(evaluate):
    parts = evaluate(text.address_parts, "CALLE 1, CENTRO, PUEBLA, PUEBLA, C.P. 72000")
    assert tuple(parts) == ("CENTRO", "PUEBLA", "72000")
    assert evaluate(text.pad_postal_code, "1234") == "01234"
    assert evaluate(text.compact_tax_id, "SLE-120202-M92") == "SLE120202M92"
    assert evaluate(text.upper_plain, "Pólizâ Ñu") == "POLIZA NU"
    assert evaluate(checks.is_vehicle_line, "Vehículos") is True and evaluate(checks.is_vehicle_line, "Vida") is False
    assert evaluate(lambda v: checks.real_value(v), " S/N ") is None
    assert str(evaluate(amounts.to_date, "18/Ago/2026")) == "2026-08-18"
    assert evaluate(text.fleet_heading, "x FLOTILLAS AMPLIA") == "Flotilla de Vehiculos"
    assert evaluate(lambda t, v: text.context_window(t, v, 2), "abcDEfgh", "de") == "bcDEfg"


@pytest.mark.parametrize(
    ("pattern", "text", "value"),
    [
        (r"(?P<num_poliza>\d+)", "n 123", "123"), (r"(?P<a_b>x)(?P=a_b)", "xx", "x"), (r"\d{,3}z", "12z", "12z"), (r"(?#note)\d+", "n 7", "7"), (r"a{x", "a{x", "a{x"),
        (r"(zz)|(yy)|(c9)", "xx c9", None), (r"(P)?(?(1)a|b)", "Pa", None), (r"(?a)\w+", "abc", None), (r"\U00000041b", "ab", "ab"),
    ],
)
def test_python_only_patterns(spark, pattern, text, value):
    rows = spark.createDataFrame([(text, pattern)], "t string, p string")
    ready = regex.prepare_column(F.col("p"))
    per_row = rows.withColumn("r", ready).select(regex.extract_value(F.col("t"), F.col("r.java"), F.col("r.groups"), F.col("r.optional_first")).alias("v"))
    assert rows.select(regex.apply_pattern(F.col("t"), pattern).alias("v")).first()["v"] == value
    assert per_row.first()["v"] == value


def test_named_letters(spark):
    from fieldloom.functions.regex import apply_pattern, to_java

    assert to_java(r"\N{DIGIT ONE}[\N{DIGIT TWO}x]") == r"\x{31}[\x{32}x]"
    df = spark.createDataFrame([("a 12 b",), ("é1x",), ("13",)], "t string")
    assert [r[0] for r in df.select(apply_pattern(F.col("t"), r"(\N{DIGIT ONE}[\N{DIGIT TWO}x])")).collect()] == ["12", "1x", None]


def test_lines_of_any_ending(spark):
    whole = ["", "a", "a\n", "a\n\n", "\n", "a\r\nb\r\n", "a\rb\x0bc\x0cd\x1ce\x1df\x1eg\x85h\u2028i\u2029", "a\x85", "\r\n\r"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(whole)], "i int, t string").select("i", text.lines(F.col("t")).alias("l")).orderBy("i").collect()
    assert [r["l"] for r in rows] == [x.splitlines() or [""] for x in whole]
    assert text.HAS_RARE_LINE_END.startswith("[") and "|" not in text.HAS_RARE_LINE_END


def test_lines_are_folded_once_and_words_looked_for_before_cutting(spark):
    from fieldloom.operators import locate as loc

    made = spark.range(1).select(F.lit("Formas: Mención, MENCIÓN").alias("t"))
    shown = lambda c: made.select(c.alias("x"))._jdf.queryExecution().analyzed().toString()
    assert shown(loc.mentions("UNO", "DOS", "MENCIÓN")(F.col("t"))).count("upper(") == 1
    assert shown(votes.word_vote(F.col("t"), ["UNO", "DOS"])).lower().count("contains(") == 2
    assert shown(loc.numbered_block(F.col("t"), "Agente:", checks.is_agent_key)).lower().count("instr(") == 0
    found = made.select(loc.mentions("UNO", "MENCIÓN")(F.col("t")).alias("a"), loc.mentions("UNO")(F.col("t")).alias("b"), loc.mentions("UNO")(F.lit(None).cast("string")).alias("c"))
    assert tuple(found.first()) == (True, False, None)


def test_numbered_block_ends_after_its_length(spark):
    from fieldloom.operators import locate as loc

    text = "x\nAgente:\n ANA \n12345\nAgente:\n9999"
    block = lambda t, **k: spark.range(1).select(loc.numbered_block(F.lit(t).cast("string"), "Agente:", checks.is_agent_key, **k).alias("b")).first()["b"]
    assert tuple(block(text)) == ("12345", "ANA")
    assert block(text, length=14) is None and block("x\n12345") is None and block(None) is None


def test_word_vote_of_no_text(spark):
    at = lambda t, **k: spark.range(1).select(votes.word_vote(F.lit(t).cast("string"), ["CONTADO", "ANUAL"], **k).alias("w")).first()["w"]
    assert at(None) is None and at("") is None and at(None, legacy_vote=True) == at("", legacy_vote=True) == "CONTADO"
    assert at("ANUALANUAL CONTADO") == "ANUAL"
