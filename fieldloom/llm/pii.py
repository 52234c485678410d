"""PII replaced by surrogates, in DataFrame functions only.

Entities (mail addresses, phone numbers, card numbers, IPv4 addresses, secrets after a
keyword, social security numbers, IBANs, titled names) are found by one pattern.  Each is
replaced by a surrogate of its type, made from a keyed digest of its normal form: the
same entity always gets the same surrogate (coreference), in the format in which it
stands (separators, length, letter case, alphabet); a name keeps its title and with it
its gender, and its script; a phone number keeps its country code.  Mail surrogates lie in
example.org and addresses in 240.0.0.0/4, which nobody uses.

Persons.  A full name is the title's gender, the first and the last name.  A mention by
the last name alone is the one full name of that gender and last name in its text; with
none or several it is a person of its own, the same in the whole corpus.

Distinctness.  All distinct spellings of the corpus and their surrogates are compared: of
the entities with the same surrogate the smallest keeps it, the others are made anew with the
next round's key until no two agree and none equals an entity of the corpus.  Names are
compared by gender and last name, so short mentions are told apart as well.  Only these
few exceptions are joined to documents, all other surrogates are computed in the row.

Scale.  The pattern runs where the text is.  What is shuffled is the entities, not the
texts; texts are only shuffled to documents with exceptions if those are too many to be
copied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.binding import let, let2
from fieldloom.llm.common import materialize, query, table, unused
from fieldloom.operators.bounds import fits

#: Key of the digests, most rounds of new surrogates.
KEY, ROUNDS = "surrogate-key", 40
#: Stands around entities while a text is cut.
MARK = "\x01"
#: Type and shape of the entities, the first that fits wins.
SHAPES = (
    # groups are repeated a bounded number of times, because Java's engine recurses for each (a host has at most 127 labels of 63 letters)
    # only a run's first letter, or what follows another entity, is tried as the start of an address
    ("email", r"(?:(?<![A-Za-z0-9._%+\-])|\G)[A-Za-z0-9._%+\-]+@(?:[A-Za-z0-9\-]{1,63}+\.){1,127}[A-Za-z]{2,63}"),
    ("secret", r"(?<=[\"= ])(?i:(?<=token = \")|(?<=password = \")|(?<=secret = \")|(?<=api_key = \")|(?<=token=)|(?<=token: ))[A-Za-z0-9+/=_\-]{16,}"),
    ("secret", r"\b(?:AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})\b"),
    ("secret", r"\b(?=[0-9A-Fa-f]*[0-9])(?=[0-9A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{40}\b"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ip", r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\d]|\.\d)"),
    ("phone", r"(?<![\w+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}(?!\d)"),
    ("phone", r"(?<![\w+(])\(\d{3}\) ?\d{3}[\-. ]\d{4}(?!\d)"),
    ("phone", r"(?<![\w.\-])\d{3}[\-.]\d{3}[\-.]\d{4}(?![\w\-])"),
    ("ssn", r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])"),
    ("card", r"(?<![\w.\-])\d{4}(?: \d{4} \d{4} \d{4}|-\d{4}-\d{4}-\d{4})(?![\w\-])"),
    ("card", r"(?<![\w.\-])\d{13,19}(?![\w\-])"),
    ("name", r"\b(?:Mr|Mrs|Ms|Miss|Dr|Herr|Frau|Monsieur|Madame|Señor|Señora)\.? \p{Lu}[\p{L}'’\-]+(?: \p{Lu}[\p{L}'’\-]+)?"),
)
#: Calling codes by their number of digits, spare ones of a block of three digits included; no code begins with another one.
CALLING_CODES = (
    "1 7",
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98",
    "210 211 212 213 214 215 216 217 218 219 220 221 222 223 224 225 226 227 228 229 230 231 232 233 234 235 236 237 238 239 "
    "240 241 242 243 244 245 246 247 248 249 250 251 252 253 254 255 256 257 258 259 260 261 262 263 264 265 266 267 268 269 "
    "290 291 292 293 294 295 296 297 298 299 350 351 352 353 354 355 356 357 358 359 370 371 372 373 374 375 376 377 378 379 "
    "380 381 382 383 384 385 386 387 388 389 420 421 422 423 424 425 426 427 428 429 500 501 502 503 504 505 506 507 508 509 "
    "590 591 592 593 594 595 596 597 598 599 670 671 672 673 674 675 676 677 678 679 680 681 682 683 684 685 686 687 688 689 "
    "690 691 692 693 694 695 696 697 698 699 800 801 802 803 804 805 806 807 808 809 850 851 852 853 854 855 856 857 858 859 "
    "870 871 872 873 874 875 876 877 878 879 880 881 882 883 884 885 886 887 888 889 960 961 962 963 964 965 966 967 968 969 "
    "970 971 972 973 974 975 976 977 978 979 990 991 992 993 994 995 996 997 998 999",
)
#: Titles of names that tell a gender.
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Señora")
#: Syllables of surrogate names by script.
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga go ka ke la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se so ta te ti to va ve vi vo za".split(),
    "cyrillic": "ба бе ви во га го да де жа за зо ка ко ла ле ли ма ме ми на не ни па по ра ре ро са се со та те ти".split(),
    "greek": "βα γε δα δο ζα θα θε κα κο λα λε μα μι να νε νο πα πε ρα ρο σα σι τα τε το".split(),
}
ENDING = {"latin": ("a", "n"), "cyrillic": ("а", "н"), "greek": ("α", "ν")}


def pattern() -> str:
    """All shapes as one pattern.

    Within a word nothing starts but an address of numbers after a letter, or what follows another
    entity, so the shapes are tried at few places.
    """
    ip = next(shape for kind, shape in SHAPES if kind == "ip")
    return r"(?=[A-Za-z0-9._%+\-(/=])(?:(?<![A-Za-z0-9])|\G)(?:" + "|".join(shape for _, shape in SHAPES) + rf")|(?=\d)(?<=[A-Za-z])(?:{ip})"


def kind_of(entity: Column) -> Column:
    """Type of a found entity; what stood before it is no longer known, so the shapes are told apart by their letters."""
    digits = F.regexp_replace(entity, "[^0-9]", "")
    return (
        F.when(F.contains(entity, F.lit("@")), "email")
        .when(F.rlike(entity, F.lit(r"^\d{1,3}(\.\d{1,3}){3}$")), "ip")
        .when(F.rlike(entity, F.lit(r"^\d{3}-\d{2}-\d{4}$")), "ssn")
        .when(F.rlike(entity, F.lit(r"^[+(]|^\d{3}[-.]\d{3}[-.]\d{4}$")), "phone")
        .when(F.rlike(entity, F.lit(r"^[A-Z]{2}\d{2}[A-Z0-9 ]{12,}$")) & ~F.rlike(entity, F.lit("^[0-9A-F]{40}$")), "iban")
        .when((F.length(digits) >= 13) & F.rlike(entity, F.lit(r"^[\d -]+$")), "card")
        .when(F.rlike(entity, F.lit(r"^(Mr|Mrs|Ms|Miss|Dr|Herr|Frau|Monsieur|Madame|Señor|Señora)\b")), "name")
        .otherwise("secret")
    )


def normal_form(entity: Column, kind: Column) -> Column:
    """What is the same entity has the same form, whatever its separators and case."""
    plain = F.regexp_replace(entity, "[ .()+\\-]", "")
    # a person is the title's gender, the last name and the first one if it is said
    return (
        F.when(kind == "email", F.lower(entity)).when(kind == "ip", entity)
        .when(kind == "name", F.concat_ws("/", short_name(entity), F.when(is_full_name(entity), F.lower(F.regexp_extract(entity, r"^\S+ (\S+) ", 1)))))
        # with and without a country code the same digits are two numbers
        .when((kind == "phone") & F.startswith(entity, F.lit("+")), F.concat(F.lit("+"), plain))
        .when(kind == "secret", entity).otherwise(F.upper(plain))
    )


def short_name(name: Column) -> Column:
    """The title's gender and the last name."""
    gender = F.when(F.rlike(name, F.lit("^(" + "|".join(FEMALE) + r")\b")), "f").when(F.startswith(name, F.lit("Dr")), "d").otherwise("m")
    return F.concat_ws("/", gender, F.lower(F.regexp_extract(name, r"(\S+)$", 1)))


def is_full_name(entity: Column) -> Column:
    return F.rlike(entity, F.lit(r"^(?:Mr|Mrs|Ms|Miss|Dr|Herr|Frau|Monsieur|Madame|Señor|Señora)\.? \p{Lu}\S* \p{Lu}\S*$"))


def is_short_name(entity: Column) -> Column:
    return F.rlike(entity, F.lit(r"^(?:Mr|Mrs|Ms|Miss|Dr|Herr|Frau|Monsieur|Madame|Señor|Señora)\.? \p{Lu}\S*$"))


def compared_form(entity: Column, kind: Column) -> Column:
    """By what surrogates are told apart: a name by what a short mention of it says, all others by their normal form."""
    return F.when(kind == "name", short_name(entity)).otherwise(normal_form(entity, kind))


def kept_length(form: Column, kind: Column) -> Column:
    """How many letters and digits of the entity stay: the country code of a phone number or an IBAN.

    A country code is read from the normal form, so it is the same in all spellings; digits after + that
    are no calling code are all replaced.
    """
    codes = "|".join(code for codes in CALLING_CODES for code in codes.split())
    code = F.when(F.startswith(form, F.lit("+")), F.length(F.regexp_extract(form, rf"^\+({codes})", 1))).otherwise(0)
    return F.when(kind == "phone", code).when(kind == "iban", 2).otherwise(0)


def _digest(kind: Column, form: Column, attempt: Column, part: str, key: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), kind, form, attempt.cast("string"), F.lit(part)), 256)


def _number(digest: Column, at: int, digits: int = 7) -> Column:
    return F.conv(F.substring(digest, at, digits), 16, 10).cast("bigint")


def _refilled(text: Column, stream: Column) -> Column:
    """Each digit and hex letter of the text replaced in place by the next of a long digest, class by class."""
    number = lambda i: F.conv(F.substr(stream, i * 2 + F.lit(1), F.lit(2)), 16, 10).cast("int")

    def one(c: Column, i: Column) -> Column:
        pick = lambda letters: F.substr(F.lit(letters), F.pmod(number(F.pmod(i, F.lit(120))), F.lit(len(letters))) + 1, F.lit(1))
        return F.when(F.rlike(c, F.lit("[0-9]")), pick("0123456789")).when(F.rlike(c, F.lit("[a-f]")), pick("abcdef")).when(F.rlike(c, F.lit("[A-F]")), pick("ABCDEF")).when(F.rlike(c, F.lit("[g-z]")), pick("ghijklmnopqrstuvwxyz")).when(F.rlike(c, F.lit("[G-Z]")), pick("GHIJKLMNOPQRSTUVWXYZ")).otherwise(c)

    return let(F.split(text, ""), lambda cs: F.array_join(F.transform(cs, one), ""))


def _long(kind: Column, form: Column, attempt: Column, key: str) -> Column:
    return F.concat(*[_digest(kind, form, attempt, p, key) for p in "abcd"])


def _name(entity: Column, digest: Column, attempt: Column) -> Column:
    """The title and new names of as many words, in the same script and for the same gender.

    Each new attempt makes a longer last name, up to seven syllables, so short names cannot run out.
    """
    title = F.regexp_extract(entity, r"^(\S+ )", 1)
    script = F.when(F.rlike(entity, F.lit(r"\p{IsCyrillic}")), "cyrillic").when(F.rlike(entity, F.lit(r"\p{IsGreek}")), "greek").otherwise("latin")
    female = F.rlike(entity, F.lit("^(" + "|".join(FEMALE) + r")\b"))

    def made(at: int, how: str, first: bool) -> Column:
        parts = [F.get(F.lit(SYLLABLES[how]), F.pmod(_number(digest, at + 7 * k), F.lit(len(SYLLABLES[how]))).cast("int")) for k in range(2 if first else 7)]
        said = F.concat(*parts) if first else F.array_join(F.slice(F.array(*parts), F.lit(1), F.least(F.lit(4) + attempt, F.lit(7))), "")
        end = F.when(female, ENDING[how][0]).otherwise(ENDING[how][1]) if first else F.lit(ENDING[how][1])
        return F.initcap(F.concat(said, end))

    def by_script(at: int, first: bool) -> Column:
        return F.when(script == "cyrillic", made(at, "cyrillic", first)).when(script == "greek", made(at, "greek", first)).otherwise(made(at, "latin", first))

    two = F.rlike(entity, F.lit(r"^\S+ \S+ \S+$"))
    return F.concat(title, F.when(two, F.concat(by_script(1, True), F.lit(" "))).otherwise(F.lit("")), by_script(15, False))


def surrogate(entity: Column, attempt: Column, key: str = KEY) -> Column:
    """The replacement of an entity as it stands in a text."""

    def by_kind(kind: Column) -> Column:
        def by_form(form: Column) -> Column:
            digest = _digest(kind, form, attempt, "", key)
            mail = F.concat(F.lit("user"), F.substring(digest, 1, 12), F.lit("@example.org"))
            mail = F.when(entity == F.upper(entity), F.upper(mail)).otherwise(mail)
            address = F.concat_ws(".", *[(F.pmod(_number(digest, 1 + 7 * k), F.lit(16 if k == 0 else 256)) + (240 if k == 0 else 0)).cast("string") for k in range(4)])
            return (
                F.when(kind == "email", mail).when(kind == "ip", address).when(kind == "name", _name(entity, digest, attempt))
                .otherwise(_spread(entity, kind, form, attempt, key))
            )

        return let(normal_form(entity, kind), by_form)

    return let(kind_of(entity), by_kind)


def _spread(entity: Column, kind: Column, form: Column, attempt: Column, key: str) -> Column:
    """New digits and letters depend on the form and on the place among digits and letters, not on separators."""

    def fill(stream: Column) -> Column:
        bare = F.regexp_replace(entity, "[^0-9A-Za-z]", "")
        kept = kept_length(form, kind)
        filled = F.concat(F.substr(bare, F.lit(1), kept), _refilled(F.substr(bare, kept + 1, F.length(bare)), stream))
        # filled without separators, which are put back where they stood
        is_letter = lambda x: F.rlike(x["c"], F.lit("[0-9A-Za-z]"))

        def put_back(new: Column, old: Column) -> Column:
            letters = F.transform(F.filter(old, is_letter), lambda x, k: F.struct(x["i"].alias("i"), F.get(new, k).alias("c")))
            return F.array_join(F.transform(F.array_sort(F.concat(letters, F.filter(old, lambda x: ~is_letter(x)))), lambda x: x["c"]), "")

        places = F.transform(F.split(entity, ""), lambda c, i: F.struct(i.alias("i"), c.alias("c")))
        return let2(F.split(filled, ""), places, put_back)

    return let(_long(kind, form, attempt, key), fill)


def entities_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({pattern()})"), F.lit(1)), F.array().cast("array<string>"))


def parts_of(text: Column) -> Column:
    """What stands between entities and the entities in turn, from one search; no part at all for null.

    Entities are marked and the text cut at the marks; a text that holds the mark itself is searched twice.
    """
    marked = F.split(F.regexp_replace(text, F.lit(f"({pattern()})"), F.lit(f"{MARK}$1{MARK}")), MARK, -1)
    both = let(entities_of(text), lambda found: F.flatten(F.transform(F.split(text, pattern(), -1), lambda x, i: F.when(i < F.size(found), F.array(x, F.get(found, i))).otherwise(F.array(x)))))
    return F.coalesce(F.when(F.contains(text, F.lit(MARK)), both).otherwise(marked), F.array().cast("array<string>"))


def persons(parts: Column) -> Column:
    """From (gender and last name) to the spelling of the only full name that has it among the entities of a text."""
    full = F.filter(parts, lambda x, i: (i % 2 == 1) & is_full_name(x))
    named = F.transform(F.array_distinct(full), lambda x: F.struct(short_name(x).alias("short"), normal_form(x, F.lit("name")).alias("form"), x.alias("name")))

    def single(rows: Column) -> Column:
        # sorted, so the rows of one person and those of one last name stand together
        firsts = F.filter(rows, lambda x, i: (i == 0) | (x["form"] != F.get(rows, i - 1)["form"]))
        return let(firsts, lambda xs: F.map_from_entries(F.transform(
            F.filter(xs, lambda x, i: ~F.coalesce(x["short"] == F.get(xs, i - 1)["short"], F.lit(False)) & ~F.coalesce(x["short"] == F.get(xs, i + 1)["short"], F.lit(False))),
            lambda x: F.struct(x["short"], x["name"]),
        )))

    return let(F.array_sort(named), single)


def collisions(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, form, attempt) of the entities whose first surrogate is taken.  ``entities``: distinct spellings.

    Compared are the surrogates of all spellings within a type, with each other and with real entities.
    """
    base = materialize(
        entities.select("entity", kind_of(F.col("entity")).alias("kind"))
        .withColumn("form", normal_form(F.col("entity"), F.col("kind"))).withColumn("real", compared_form(F.col("entity"), F.col("kind")))
    )
    real = base.select("kind", F.col("real").alias("new")).distinct()

    def made(rows: DataFrame) -> DataFrame:
        return rows.withColumn("new", compared_form(surrogate(F.col("entity"), F.col("attempt"), key), F.col("kind")))

    now = materialize(made(base.drop("real").withColumn("attempt", F.lit(0))))
    for _ in range(ROUNDS):
        first = now.groupBy("kind", "new").agg(F.min(F.struct("attempt", "form")).alias("o"), F.min("form").alias("least"), F.max("form").alias("most"))
        # an exact check: surrogates that several entities share, and surrogates that are real entities
        taken = first.filter("least <> most").select("kind", "new", F.col("o.form").alias("owner"))
        real_too = first.join(real, ["kind", "new"], "left_semi").select("kind", "new", F.lit(None).cast("string").alias("owner"))
        bad = taken.join(real_too.select("kind", "new"), ["kind", "new"], "left_anti").unionByName(real_too)
        # an entity is made anew in all its spellings if one of them is taken
        again = materialize(now.join(bad, ["kind", "new"]).filter(F.col("owner").isNull() | (F.col("form") != F.col("owner"))).select("kind", "form").distinct())
        if again.isEmpty():
            return now.filter("attempt > 0").select("kind", "form", "attempt").distinct()
        kept = now.join(again, ["kind", "form"], "left_anti")
        anew = now.join(again, ["kind", "form"], "left_semi").withColumn("attempt", F.col("attempt") + 1)
        now = materialize(kept.unionByName(made(anew.drop("new")).select(*kept.columns)))
    raise RuntimeError(f"surrogates still collide after {ROUNDS} rounds")


def replace_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY, count_col: str | None = "n_entities") -> DataFrame:
    """The rows with replaced entities in the text, and how many were replaced.

    A null text stays null with no entities; rows that repeat get the same result, an empty
    table gives no rows, all other columns are kept, whatever their names (one named like ``count_col`` is replaced).
    """
    kept = [c for c in docs.columns if c != count_col]
    names = [*docs.columns, count_col or ""]
    key_, odd_, parts_, text_, n_ = (unused(names, c) for c in ("_id", "_odd", "_parts", "_text", "_n"))
    found = F.explode_outer(F.array_distinct(entities_of(F.col(text_col)))).alias("entity")
    occurring = materialize(docs.select(F.col(id_col).alias(key_), found).filter(F.col("entity").isNotNull()))
    spelt = materialize(occurring.select("entity").distinct())
    odd = collisions(spelt, key)
    base = docs.select(*kept)
    if odd.isEmpty():
        base = base.withColumn(odd_, F.lit(None).cast("map<string,int>"))
    else:
        spellings = spelt.withColumn("kind", kind_of(F.col("entity"))).withColumn("form", normal_form(F.col("entity"), F.col("kind"))).join(odd, ["kind", "form"]).select("entity", "attempt")
        hit = occurring.join(spellings, "entity")
        per_doc = materialize(hit.groupBy(key_).agg(F.map_from_entries(F.collect_set(F.struct("entity", "attempt"))).alias(odd_)))
        base = base.join(F.broadcast(per_doc) if fits(per_doc) else per_doc, base[id_col].eqNullSafe(per_doc[key_]), "left").drop(key_)
    attempt = lambda e: F.coalesce(F.get(F.filter(F.map_entries(odd_), lambda x: x["key"] == e), F.lit(0))["value"], F.lit(0))

    def replaced(full: Column) -> Column:
        def one(x: Column) -> Column:
            person = F.when(is_short_name(x), F.try_element_at(full, short_name(x)))
            # a short mention has the title it stands with and the last name of the person's surrogate
            made = lambda who: let(surrogate(who, attempt(who), key), lambda new: F.when(who == x, new).otherwise(F.concat(F.regexp_extract(x, r"^(\S+ )", 1), F.regexp_extract(new, r"(\S+)$", 1))))
            return let(F.coalesce(person, x), made)

        return F.transform(parts_, lambda x, i: F.when(i % 2 == 1, one(x)).otherwise(x))

    rebuilt = F.array_join(let(persons(F.col(parts_)), replaced), "")
    text = F.when(F.size(parts_) > 1, rebuilt).otherwise(F.col(text_col))
    out = base.withColumn(parts_, parts_of(F.col(text_col))).withColumn(text_, text).withColumn(n_, F.coalesce(F.floor(F.size(parts_) / 2), F.lit(0)).cast("int"))
    columns = [F.col(text_).alias(text_col) if c == text_col else F.col(c) for c in kept]
    return out.select(*columns, *([F.col(n_).alias(count_col)] if count_col else []))


@query()
def op10_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    """All ``documents`` with surrogates for the entities of their texts."""
    return replace_pii(table(spark, folder, "documents").select("doc_id", "text"))
