import re

import pytest
from pyspark.sql import functions as F

from fieldloom.llm import pii

SCHEMA = "doc_id long, text string, entity string, _found int"
TEXTS = [
    "Mail jane.doe@corp.example.com or JANE.DOE@CORP.EXAMPLE.COM, not a@b.", "call +1 (017) 555-7713 or +1 (018) 555-7713; again +1 (017) 555-7713.",
    "card 4845168114407329 and 4845 1681 1440 7329, host 97.51.17.173 then 97.51.17.174", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"',
    "Frau Müller met Mr John Smith; Mr Smith left. Mrs Иванова stays. ssn 123-45-6789", None, "", "clean text of 2024, 3.14 and 1.2.3, v1.2.3.4.5 and 12345", "x " * 40000 + "jane.doe@corp.example.com",
]


@pytest.fixture(scope="module")
def replaced(spark):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "again", 1)], SCHEMA)
    out = pii.replace_pii(docs)
    assert out.columns == ["doc_id", "text", "entity", "_found", "n_entities"]
    rows = out.collect()
    assert len(rows) == len(TEXTS) + 1
    return {r["doc_id"]: (r["text"], r["n_entities"]) for r in rows}


def test_nothing_real_is_left(replaced):
    for real in ("jane.doe", "JANE", "7713", "48451681", "1440", "97.51.17", "04dbeb", "9233A8", "Müller", "Smith", "Иванова", "6789"):
        assert not any(real in (t or "") for t, _ in replaced.values()), real
    assert replaced[5] == (None, 0) and replaced[6] == ("", 0) and replaced[7] == (TEXTS[7], 0)
    assert [replaced[i][1] for i in range(5)] == [2, 3, 4, 2, 5]


def test_format_and_coreference(replaced):
    a, b = re.findall(r"\S+@\S+[a-zA-Z]", replaced[0][0])[:2]
    assert a.lower() == b.lower() and b.isupper() and a.endswith("@example.org") and a in replaced[8][0]
    one, two, three = re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}", replaced[1][0])
    assert one == three != two
    card, spaced, ip1, ip2 = re.match(r"card (\d{16}) and (\d{4} \d{4} \d{4} \d{4}), host (\S+) then (\S+)$", replaced[2][0]).groups()
    assert card == spaced.replace(" ", "") and ip1 != ip2
    assert re.fullmatch(r'token = "[0-9a-f]{40}" TOKEN = "[0-9A-F]{40}"', replaced[3][0])
    frau, first, last, again, cyrillic = re.match(r"Frau (\w+) met Mr (\w+) (\w+); Mr (\w+) left\. Mrs (\w+) stays\. ssn \d{3}-\d{2}-\d{4}$", replaced[4][0]).groups()
    assert last == again and re.fullmatch("[А-Яа-я]+", cyrillic) and first != last and frau != last


def test_collisions_are_resolved(spark, monkeypatch):
    """With few possible surrogates all distinct entities still get distinct ones, none of them real."""
    monkeypatch.setattr(pii, "surrogate", lambda e, n, key="k": F.concat(F.lit("u"), F.pmod(F.xxhash64(F.lower(e), n), F.lit(400)).cast("string"), F.lit("@ex.org")))
    real = [f"p{i}@corp.org" for i in range(120)] + [f"u{i}@ex.org" for i in range(40)]
    docs = spark.createDataFrame([(i // 2, real[i] + " and " + real[(i * 7) % 160], "", 1) for i in range(160)], SCHEMA)
    pairs = {}
    for old, new in zip(docs.collect(), pii.replace_pii(docs).orderBy("doc_id").collect()):
        pass
    joined = docs.withColumn("n", F.monotonically_increasing_id())
    out = pii.replace_pii(joined).select("n", F.col("text").alias("new")).join(joined, "n").collect()
    for r in out:
        for a, b in zip(r["text"].split(" and "), r["new"].split(" and ")):
            assert pairs.setdefault(a, b) == b
    assert len(set(pairs.values())) == len(pairs) == 160 and not set(pairs.values()) & set(real)


def test_empty_table_and_native_plan(spark):
    empty = spark.createDataFrame([], SCHEMA)
    out = pii.replace_pii(empty)
    assert out.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_parts_with_and_without_the_mark(spark):
    plain = "v1.2.3.4 (555) 123-4567user@x.com, aMr. Bob 12Dr. Who /Dr. No"
    rows = [(1, plain), (2, plain + pii.MARK), (3, ""), (4, None)]
    out = spark.createDataFrame(rows, "doc_id bigint, text string").select("doc_id", pii.parts_of(F.col("text")).alias("parts")).orderBy("doc_id").collect()
    found = ["1.2.3.4", "(555) 123-4567", "user@x.com", "Dr. No"]
    assert [r["parts"][1::2] for r in out] == [found, found, [], []]
    assert ["".join(r["parts"]) for r in out] == [plain, plain + pii.MARK, "", ""]


def _texts(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [r["text"] for r in pii.replace_pii(docs).orderBy("doc_id").collect()]


def test_persons_of_one_last_name_stay_apart(spark):
    both, one, other, alone, women = _texts(spark, [
        "Mr John Smith, Mr Bob Smith, Mr Smith", "Mr John Smith; Mr. Smith; Herr JOHN SMITH", "Mr Smith of Mr Bob Smith and Mrs Smith", "Mr Smith", "Mrs Ann Smith, Miss Smith, Mr Smith",
    ])
    john, bob, unclear = both.split(", ")
    assert john != bob and john.split()[2] != bob.split()[2] and len({john.split()[2], bob.split()[2], unclear.split()[1]}) == 3
    assert one == f"{john}; Mr. {john.split()[2]}; Herr {john.split(' ', 1)[1]}"
    assert other.startswith(f"Mr {bob.split()[2]} of {bob} and Mrs ") and other.split()[-1] != bob.split()[2]
    # without one full name to stand for, a mention is a person of its own everywhere
    assert alone == unclear and women.split(", ")[2] == unclear and women.split(", ")[1] == f"Miss {women.split(', ')[0].split()[2]}"


def test_a_phone_has_one_surrogate_in_all_spellings(spark):
    spelt = ["+1 415 555 2671", "+14155552671", "+1 (415) 555-2671", "+44 20 7946 0958", "+442079460958", "+351 21 123 4567", "+351211234567", "(415) 555-2671", "415-555-2671", "+41 5555 2671", "+0 415 555 2671"]
    new = _texts(spark, spelt)
    digits = [re.sub("[^+0-9]", "", x) for x in new]
    assert [re.sub("[0-9]", "9", x) for x in new] == [re.sub("[0-9]", "9", x) for x in spelt]
    assert digits[0] == digits[1] == digits[2] and digits[3] == digits[4] and digits[5] == digits[6] and digits[7] == digits[8]
    assert [d[:n] for d, n in zip(digits, (2, 2, 2, 3, 3, 4, 4), strict=False)] == ["+1", "+1", "+1", "+44", "+44", "+351", "+351"]
    assert len(set(digits)) == 6 and digits[9].startswith("+41") and digits[9][1:] != digits[7]


def test_all_spellings_are_compared(spark, monkeypatch):
    """The surrogate of a spelling that is not the smallest one of its entity is taken by another entity."""
    taken = {("A@x.org", 0): "one@ex.org", ("a@x.org", 0): "same@ex.org", ("b@x.org", 0): "same@ex.org"}

    def made(e, n, key="k"):
        new = F.concat(F.lower(e), F.lit("-"), n.cast("string"))
        for (entity, attempt), to in taken.items():
            new = F.when((e == entity) & (n == attempt), to).otherwise(new)
        return new

    monkeypatch.setattr(pii, "surrogate", made)
    a, upper, b = _texts(spark, ["a@x.org", "A@x.org", "b@x.org"])
    assert a != b and upper != b


def test_names_do_not_run_out(spark, monkeypatch):
    """Few syllables give few last names; longer ones follow until all persons differ."""
    monkeypatch.setitem(pii.SYLLABLES, "latin", ["ba", "be", "bi"])
    persons = [f"Mr {chr(65 + i % 26)}x Y{chr(97 + i // 26)}z" for i in range(130)]
    new = _texts(spark, persons)
    assert len({x.split()[2] for x in new}) == 130


LONG = ["x@" + "a." * 20000, "x@" + "a" * 60000 + ".com", "a." * 30000, "A" * 60000, "1" * 60000, "4111 " * 20000, "+1 " * 20000, "DE12 " * 15000, "f0" * 30000,
        "Mr " + "Ab" * 30000, "token = \"" + "aZ3-" * 15000 + "\"", "1.2." * 20000, "(123) " * 9000, "é" * 40000]


def test_long_runs_of_each_alphabet(spark):
    docs = spark.createDataFrame(list(enumerate(LONG)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.replace_pii(docs).collect()}
    assert len(rows) == len(LONG)
    assert rows[10]["n_entities"] == 1 and len(rows[10]["text"]) == len(LONG[10]) and rows[10]["text"] != LONG[10]
    assert rows[13]["text"] == LONG[13]


def test_columns_named_like_helpers_are_kept(spark):
    docs = spark.createDataFrame([(1, "mail a.b@c.com", 5, "u", 7, "v", 9)], "doc_id long, text string, _parts int, _text string, _n int, _odd string, _id int")
    (row,) = pii.replace_pii(docs).collect()
    assert (row["_parts"], row["_text"], row["_n"], row["_odd"], row["_id"], row["n_entities"]) == (5, "u", 7, "v", 9, 1)
    assert "a.b@c.com" not in row["text"]
