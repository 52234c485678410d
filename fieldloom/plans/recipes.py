"""Recipes: which strategies give which field, in which order.

A recipe is one row (company, field, priority, stage, strategy, params).  The
runner turns all recipes of all companies into columns of one projection per
stage; a field of a later stage may refer to fields of earlier ones.  Nothing is
shuffled and the documents are read once, whatever the number of companies.
"""

from __future__ import annotations

import json
import multiprocessing
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom import model as m
from fieldloom.functions import checks, votes
from fieldloom.functions import text as tx
from fieldloom.functions.binding import let
from fieldloom.functions.regex import cascade, find_all
from fieldloom.operators import locate as loc
from fieldloom.operators.bounds import rows_within
from fieldloom.operators.fields import FIELDS

RECIPE_SCHEMA = "company string, field string, priority int, stage int, strategy string, params string"
MAX_RECIPES = 5_000


@dataclass(frozen=True)
class Recipe:
    field: str
    strategy: str
    params: dict = field(default_factory=dict)
    stage: int = 0


@dataclass
class Doc:
    """Columns a strategy may use."""

    text: Column
    upper: Column
    plain: Column
    lines: Column
    upper_lines: Column
    spans: Column
    known: dict[str, Column] = field(default_factory=dict)

    def scope(self, name: str) -> Column:
        return getattr(self, name)

    def printed(self, *words: str, on: str = "upper") -> Column:
        """Does the whole text hold one of the words?  Cheaper than a look at each line."""
        text = self.scope({"lines": "text", "upper_lines": "upper"}.get(on, on))
        return reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in words])

    def quick(self, *words: str) -> loc.Quick:
        """Test of the upper-case lines that comes before a dearer one of the lines."""
        return self.upper_lines, loc.has(*words)


Strategy = Callable[..., Column]
STRATEGIES: dict[str, Strategy] = {}
NEEDS: dict[str, Callable[..., Column | None]] = {}


def strategy(fn: Strategy) -> Strategy:
    """Register a strategy under its name."""
    STRATEGIES[fn.__name__] = fn
    return fn


def needs(condition: Callable[..., Column | None]) -> Callable[[Strategy], Strategy]:
    """What a document must fulfil for the strategy to give a value (None: nothing known); else it is not run.

    ``condition`` takes the same arguments as the strategy.
    """

    def register(fn: Strategy) -> Strategy:
        NEEDS[fn.__name__] = condition
        return fn

    return register


# ---- named helpers that parameters refer to ---------------------------------------

POST: dict[str, Callable[[Column], Column]] = {
    "title": tx.title_case,
    "upper": F.upper,
    "plate": tx.format_plate,
    "postal_code": tx.pad_postal_code,
    "no_blanks": lambda v: F.replace(v, F.lit(" "), F.lit("")),
    "no_commas": lambda v: F.replace(v, F.lit(","), F.lit("")),
    "unsigned": lambda v: F.ltrim(v, F.lit("-")),
    "company_form": lambda v: let(v, lambda n: F.when(checks.is_legal_person_name(n), tx.plain_company_form(n)).otherwise(n)),
    "origin": tx.vehicle_origin,
    "strip": tx.strip,
}

ACCEPT: dict[str, Callable[[Column], Column]] = {
    "plate": checks.is_plate,
    "postal_code": checks.is_postal_code,
    "model_year": checks.is_model_year,
    "name": checks.looks_like_name,
    "name_with_digits": lambda v: checks.looks_like_name(v, "A-ZÑÁÉÍÓÚ ,\\.&0-9\\-"),
    "not_stopped": lambda v: ~checks.contains_any(v, checks.NAME_STOP_WORDS),
    "payment_form": lambda v: v.isin(*checks.PAYMENT_FORMS),
    "currency": lambda v: v.isin(*checks.CURRENCIES),
    "place": lambda v: ~checks.is_state(v) & ~checks.is_postal_code(v),
    "amount": lambda v: checks.full_match(v, r"-?[\d,]+\.\d{2}"),
    "longer_than_4": lambda v: F.length(v) > 4,
    "longer_than_5": lambda v: F.length(v) > 5,
    "digits": lambda v: checks.full_match(F.replace(v, F.lit(" "), F.lit("")), r"\d+"),
}


def label_test(labels: list[str], test: str = "contains", fold: str | None = None) -> loc.LineTest:
    if test == "pattern":
        return loc.matches(checks.any_of(labels))
    if test == "equals":
        return loc.equals(labels[0], F.lower if fold == "lower" else None)
    base = loc.has(*labels)
    return (lambda line: base(F.lower(line))) if fold == "lower" else base


def value_pick(value: str | None = None, group: int = 0, accept: list[str] | None = None) -> loc.LinePick:
    if value is not None:
        return loc.found(value, group)
    return loc.whole(*[ACCEPT[a] for a in accept or []])


def label_printed(doc: Doc, labels: list[str], test: str = "contains", fold: str | None = None, on: str = "upper_lines", **_) -> Column | None:
    """A label line holds its label, so the text does."""
    if test == "pattern" or fold is not None or on not in ("lines", "upper_lines"):
        return None
    return doc.printed(*(labels[:1] if test == "equals" else labels), on=on)


# ---- general strategies --------------------------------------------------------------

@strategy
def regex(doc: Doc, patterns: list[str], group: int = 1, on: str = "text", flags: str = "(?iuUd)") -> Column:
    """First pattern that matches."""
    return cascade(doc.scope(on), patterns, group, flags)


@strategy
@needs(label_printed)
def label_offset(doc: Doc, labels: list[str], offsets: list[int], value: str | None = None, group: int = 0,
                 accept: list[str] | None = None, test: str = "contains", fold: str | None = None,
                 on: str = "upper_lines", first_only: bool = True) -> Column:
    return loc.label_offset(doc.scope(on), label_test(labels, test, fold), offsets, value_pick(value, group, accept), first_only)


@strategy
@needs(label_printed)
def label_window(doc: Doc, labels: list[str], first: int, last: int, value: str | None = None, group: int = 0,
                 accept: list[str] | None = None, test: str = "contains", fold: str | None = None,
                 on: str = "upper_lines", which: str = "first", first_only: bool = True) -> Column:
    return loc.label_window(doc.scope(on), label_test(labels, test, fold), first, last, value_pick(value, group, accept), which, first_only)


@strategy
@needs(label_printed)
def label_steps(doc: Doc, labels: list[str], steps: list[dict], test: str = "contains", fold: str | None = None,
                on: str = "upper_lines", first_only: bool = False) -> Column:
    """Steps: {"at": k, ...} or {"first": a, "last": b, "which": ...}, each with value or accept."""

    def build(s: dict):
        if "at" in s:
            return loc.step_at(s["at"], value_pick(s.get("value"), s.get("group", 0), s.get("accept")))
        pick = loc.last_found(s["value"]) if s.get("which") == "last" else value_pick(s.get("value"), s.get("group", 0), s.get("accept"))
        return loc.step_window(s["first"], s["last"], pick, s.get("which", "first"))

    return loc.label_steps(doc.scope(on), label_test(labels, test, fold), [build(s) for s in steps], first_only)


@strategy
def label_inline(doc: Doc, pattern: str, group: int = 1, on: str = "lines", accept: list[str] | None = None) -> Column:
    tests = [ACCEPT[a] for a in accept or []]
    return loc.label_inline(doc.scope(on), pattern, group, accept=tests[0] if tests else None)


@strategy
@needs(lambda doc, words, on="upper", legacy_vote=False: None if legacy_vote else doc.printed(*words, on=on))
def word_vote(doc: Doc, words: list[str], on: str = "upper", legacy_vote: bool = False) -> Column:
    return votes.word_vote(doc.scope(on), words, legacy_vote)


@strategy
def line_vote(doc: Doc, pattern: str, group: int = 1, on: str = "upper_lines") -> Column:
    return votes.most_common(loc.line_matches(doc.scope(on), pattern, group))


@strategy
def date_vote(doc: Doc, patterns: list[str], place: int, on: str = "plain") -> Column:
    """The most frequent (place 0) or second most frequent (place 1) date."""
    return F.get(date_ranking(doc.scope(on), patterns), F.lit(place))


@strategy
def date_list(doc: Doc, patterns: list[str], on: str = "plain") -> Column:
    """The two most frequent dates as an array, for ``pick_from``."""
    return date_ranking(doc.scope(on), patterns)


@strategy
def pick_from(doc: Doc, other: str, place: int) -> Column:
    """Element of a list found before."""
    return F.get(doc.known[other], F.lit(place))


# strategies whose result is a list, used by later stages only
LISTS = {"date_list"}


def date_ranking(text: Column, patterns: list[str]) -> Column:
    found = F.concat(*[find_all(text, p, flags="(?iud)") for p in patterns])
    return votes.top_values(found, 2)


@strategy
def relative_to(doc: Doc, other: str, offset: int, accept: list[str] | None = None, on: str = "lines") -> Column:
    return loc.relative_to(doc.scope(on), doc.known[other], offset, value_pick(None, 0, accept))


@strategy
def constant_if(doc: Doc, pattern: str, value: str) -> Column:
    return loc.constant_if(F.rlike(doc.text, F.lit("(?iuU)" + pattern)), value)


@strategy
def copy_field(doc: Doc, other: str) -> Column:
    return doc.known[other]


# ---- runner ---------------------------------------------------------------------------

@dataclass(frozen=True)
class Family:
    """Recipes of one company, its gate, and what happens after the strategies.

    ``hidden`` fields are computed for other fields only.
    """

    company: str
    recipes: list[Recipe]
    gate: Callable[[Doc], Column]
    hidden: tuple[str, ...] = ()


def to_rows(family: Family) -> list[tuple]:
    """Recipes as rows of ``RECIPE_SCHEMA``."""
    seen: dict[str, int] = {}
    rows = []
    for r in family.recipes:
        seen[r.field] = seen.get(r.field, 0) + 1
        rows.append((family.company, r.field, seen[r.field], r.stage, r.strategy, json.dumps(r.params, ensure_ascii=False)))
    return rows


def from_table(table: DataFrame, gates: dict[str, Callable[[Doc], Column]], hidden: tuple[str, ...] = ()) -> list[Family]:
    """Families from a recipe table (configuration, bounded)."""
    rows = rows_within(table.orderBy("company", "stage", "field", "priority"), MAX_RECIPES)
    if rows is None:
        raise ValueError(f"more than {MAX_RECIPES} recipes")
    by_company: dict[str, list[Recipe]] = {}
    for r in rows:
        by_company.setdefault(r["company"], []).append(Recipe(r["field"], r["strategy"], json.loads(r["params"]), r["stage"]))
    always = lambda doc: F.lit(True)
    return [Family(c, rs, gates.get(c, always), hidden) for c, rs in by_company.items()]


PREPARED = ("_upper", "_plain", "_lines", "_ulines")


def prepare_documents(docs: DataFrame, text: str = "text", needed: Column | None = None) -> DataFrame:
    """Forms of the text that the strategies share, computed once per document that needs them."""
    forms = {"_upper": F.upper(text), "_plain": tx.upper_plain(F.col(text)), "_lines": tx.lines(F.col(text)), "_ulines": tx.lines(F.upper(text))}
    staged = docs.withColumns({name: form if needed is None else F.when(needed, form) for name, form in forms.items()})
    return staged if "spans" in docs.columns else staged.withColumn("spans", F.lit(None).cast(f"array<{m.SPAN_TYPE}>"))


def run_recipe(doc: Doc, recipe: Recipe) -> Column:
    params = dict(recipe.params)
    post, exclude = params.pop("post", []), params.pop("exclude_values", None)
    value = STRATEGIES[recipe.strategy](doc, **params)
    if recipe.strategy in LISTS:
        return value
    if exclude:
        value = loc.without(value, exclude)
    for name in post:
        value = POST[name](value)
    needed = NEEDS[recipe.strategy](doc, **params) if recipe.strategy in NEEDS else None
    real = checks.real_value(value)
    return real if needed is None else F.when(needed, real)


def recipe_fields(docs: DataFrame, families: list[Family], text: str = "text", as_column: str = "recipe_fields") -> DataFrame:
    """Add the fields found by the recipes of the document's company.

    A document of another company, or one its gate refuses, gets an empty array.
    """
    current = prepare_documents(docs, text, F.col("company").isin(*[f.company for f in families]))
    result = F.array().cast(FIELDS)
    for n, fam in enumerate(families):
        doc = Doc(F.col(text), F.col("_upper"), F.col("_plain"), F.col("_lines"), F.col("_ulines"), F.col("spans"))
        mine = f"_mine{n}"
        current = current.withColumn(mine, F.coalesce((F.col("company") == fam.company) & fam.gate(doc), F.lit(False)))
        for stage in sorted({r.stage for r in fam.recipes}):
            by_field: dict[str, list[Column]] = {}
            for r in fam.recipes:
                if r.stage == stage:
                    by_field.setdefault(r.field, []).append(run_recipe(doc, r))
            columns = {}
            for name, options in by_field.items():
                if name in doc.known:
                    options = [doc.known[name], *options]
                columns[f"_f{n}_{stage}_{name}"] = F.when(F.col(mine), F.coalesce(*options))
            current = current.withColumns(columns)
            doc.known = {**doc.known, **{name: F.col(f"_f{n}_{stage}_{name}") for name in by_field}}
        items = [
            F.when(
                value.isNotNull(),
                F.struct(F.lit(name).alias("field"), value.alias("value"), F.lit(m.METHOD_RECIPE).alias("method"),
                         F.lit(None).cast("bigint").alias("rule_id")),
            )
            for name, value in doc.known.items()
            if name not in fam.hidden
        ]
        result = F.when(F.col(mine), F.array_compact(F.array(*items)).cast(FIELDS)).otherwise(result)
    return current.select(*docs.columns, result.alias(as_column))


class Watched:
    """An extractor in a child process: a hang or a crash ends the child, not the task.

    The child serves many documents and is replaced after it was ended.
    """

    def __init__(self, extractor: Callable[[str], dict[str, str]], seconds: float):
        self.extractor, self.seconds, self.child = extractor, seconds, None

    def _serve(self, pipe) -> None:
        while True:
            try:
                body = pipe.recv()
            except EOFError:
                return
            try:
                answer = {k: str(v) for k, v in (self.extractor(body) or {}).items() if v}, None
            except Exception as error:  # noqa: BLE001  any failure is a result here
                answer = None, str(error)
            pipe.send(answer)

    def _start(self) -> None:
        context = multiprocessing.get_context("fork")
        self.pipe, far = context.Pipe()
        self.child = context.Process(target=self._serve, args=(far,), daemon=True)
        self.child.start()
        far.close()

    def close(self) -> None:
        if self.child is not None:
            self.child.kill()
            self.child.join()
            self.pipe.close()
            self.child = None

    def __call__(self, body: str) -> dict[str, str]:
        if self.child is None:
            self._start()
        try:
            self.pipe.send(body)
            if not self.pipe.poll(self.seconds):
                self.close()
                raise TimeoutError(f"no answer within {self.seconds:g} seconds")
            found, error = self.pipe.recv()
        except (EOFError, BrokenPipeError, ConnectionResetError):
            self.close()
            raise RuntimeError("the extractor ended without an answer") from None
        if error is not None:
            raise RuntimeError(error)
        return found


def run_extractor(docs: DataFrame, extractor: Callable[[str], dict[str, str]], text: str = "text", seconds: float | None = None) -> DataFrame:
    """Escape hatch: a Python function text -> {field: value} as long rows.

    Runs in Arrow batches.  A document the function fails on gives one row with
    the error and no value; with ``seconds`` also one that it hangs or crashes on
    (the function then runs in a child process, ended after that time a document).
    """
    import pandas as pd

    def run(batches):
        call = extractor if seconds is None else Watched(extractor, seconds)
        try:
            for batch in batches:
                out = []
                for doc_id, body in zip(batch["doc_id"], batch[text]):
                    try:
                        found = call(body) or {}
                        out += [(doc_id, k, str(v), None) for k, v in found.items() if v]
                    except Exception as error:  # noqa: BLE001  any failure is a result here
                        out.append((doc_id, None, None, str(error)))
                yield pd.DataFrame(out, columns=["doc_id", "field", "value", "error"])
        finally:
            if seconds is not None:
                call.close()

    return docs.select("doc_id", text).mapInPandas(run, "doc_id bigint, field string, value string, error string")
