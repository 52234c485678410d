"""Patterns written for Python's ``re``, run by Spark's Java engine.

Rules and catalogues store patterns in Python syntax.  They are configuration,
so they are checked and rewritten once on the driver; the text itself never
leaves the executors.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions.binding import regexp_extract
from fieldloom.functions.text import present, strip

# Unicode case folding and classes, ^/$ per line, "\n" as the only line end:
# what re.IGNORECASE | re.MULTILINE does on a str.
SEARCH_FLAGS = "(?imuUd)"


#: A quantifier in braces; any other brace stands for itself.
BRACES = re.compile(r"\{(?:(\d+)(,\d*)?|,(\d*))\}")


class Untranslatable(ValueError):
    """A construct that Java's engine does not have."""


@dataclass(frozen=True)
class Pattern:
    """A usable pattern: Java source, number of groups, may group 1 be skipped."""

    source: str
    java: str
    groups: int
    optional_first: bool


def refusal(pattern: str | None) -> str | None:
    """Why a pattern cannot be used: broken, or without a counterpart in the engine; ``None`` if it can."""
    if pattern is None:
        return "no pattern"
    try:
        re.compile(pattern)
        to_java(pattern)
    except (re.error, OverflowError, RecursionError, Untranslatable) as e:
        return str(e)
    return None


def is_valid(pattern: str | None) -> bool:
    """True if the pattern compiles and the engine has a counterpart for all of it."""
    return refusal(pattern) is None


def _plain_names(names: list[str]) -> dict[str, str]:
    """Names of letters and digits for groups whose own names have other characters."""
    plain: dict[str, str] = {}
    for k, name in enumerate(names):
        plain[name] = name if re.fullmatch(r"[a-zA-Z][a-zA-Z0-9]*", name) else f"named{k}"
        while plain[name] != name and plain[name] in names:
            plain[name] += "x"
    return plain


def to_java(pattern: str) -> str:
    """Rewrite the constructs that Python and Java spell differently; raises ``Untranslatable`` for what Java lacks."""
    names = _plain_names(re.findall(r"\(\?P<(\w+)>", pattern))
    out: list[str] = []
    i, in_class = 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if pattern[i] == "\\":
            named = re.match(r"\\N\{([^}]+)\}", pattern[i:])
            if named:  # names are Python's, so the letter's number is written
                out.append(f"\\x{{{ord(unicodedata.lookup(named[1])):x}}}")
                i += named.end()
                continue
            wide = re.match(r"\\U([0-9a-fA-F]{8})|\\0([0-7]{0,2})", pattern[i:])
            if wide:
                out.append(f"\\x{{{int(wide[1], 16) if wide[1] else int(wide[2] or '0', 8):x}}}")
                i += wide.end()
                continue
            if two == "\\v" or (two == "\\b" and in_class):
                two = "\\x0B" if two == "\\v" else "\\x08"
            out.append("\\z" if two == "\\Z" and not in_class else two)
            i += 2
            continue
        if in_class:
            if pattern[i] == "]":
                in_class = False
                out.append("]")
            elif pattern[i] == "[" or two == "&&":
                out.append("\\" + pattern[i])
            else:
                out.append(pattern[i])
            i += 1
            continue
        if pattern[i] == "[":
            in_class = True
            head = re.match(r"\[\^?\]?", pattern[i:]).group(0)
            out.append(head[:-1] + "\\]" if head.endswith("]") else head)
            i += len(head)
            continue
        if pattern.startswith("(?P<", i):
            end = pattern.index(">", i)
            out.append("(?<" + names.get(pattern[i + 4 : end], pattern[i + 4 : end]) + ">")
            i = end + 1
            continue
        if pattern.startswith("(?P=", i):
            end = pattern.index(")", i)
            out.append("\\k<" + names.get(pattern[i + 4 : end], pattern[i + 4 : end]) + ">")
            i = end + 1
            continue
        if pattern.startswith("(?#", i):
            i = pattern.index(")", i) + 1
            continue
        if pattern.startswith("(?(", i):
            raise Untranslatable("conditional group")
        if re.match(r"\(\?[a-zA-Z]*[aL]", pattern[i:]):
            raise Untranslatable("ASCII or locale flag")
        if pattern[i] == "{":
            braces = BRACES.match(pattern, i)
            out.append("\\{" if not braces else "{0," + braces[3] + "}" if braces[1] is None else braces[0])
            i = braces.end() if braces else i + 1
            continue
        out.append(pattern[i])
        i += 1
    return "".join(out)


def prepare(pattern: str) -> Pattern | None:
    """Check and rewrite one pattern; ``None`` when it does not compile."""
    if not is_valid(pattern):
        return None
    groups = re.compile(pattern).groups
    optional = groups > 0 and bool(re.search(r"\)(?:[?*]|\{0)|\|", pattern))
    return Pattern(pattern, SEARCH_FLAGS + to_java(pattern), groups, optional)


def search(text: Column, pattern: str) -> Column:
    """Does the pattern occur?  A broken pattern never does."""
    ready = prepare(pattern)
    return F.rlike(text, F.lit(ready.java)) if ready else F.lit(False)


def extract_value(text: Column, java: Column, groups: Column, optional_first: Column) -> Column:
    """Group 1 if the pattern has groups and one took part, else the whole match.

    Works for literal and for per-row patterns.  No match gives NULL; a match of
    the empty string gives ''.  When the first group is empty but another one is
    not, the result is NULL.
    """
    whole = regexp_extract(text, java, F.lit(0))
    first = regexp_extract(text, java, F.least(groups, F.lit(1)))
    second = regexp_extract(text, java, F.least(groups, F.lit(2)))
    later = F.exists(F.sequence(F.lit(3), F.greatest(groups, F.lit(3))), lambda k: regexp_extract(text, java, F.least(groups, k)) != "")
    value = (
        F.when((groups == 0) | (first != ""), first)
        .when(((groups >= 2) & (second != "")) | ((groups >= 3) & later), F.lit(None).cast("string"))
        .when(optional_first, whole)
        .otherwise(first)
    )
    return F.when(F.rlike(text, java), strip(value))


def apply_pattern(text: Column, pattern: str) -> Column:
    """Value of one literal pattern; NULL for no match or a broken pattern."""
    ready = prepare(pattern)
    if ready is None:
        return F.lit(None).cast("string")
    java = F.lit(ready.java)
    if ready.groups == 0:
        return F.when(F.rlike(text, java), strip(regexp_extract(text, java, 0)))
    if ready.groups == 1 and not ready.optional_first:
        return F.when(F.rlike(text, java), strip(regexp_extract(text, java, 1)))
    return extract_value(text, java, F.lit(ready.groups), F.lit(ready.optional_first))


def first_match(text: Column, pattern: str, group: int = 0, flags: str = "(?iuUd)") -> Column:
    """Raw ``group`` of the first match, NULL when the match is absent or empty."""
    return present(regexp_extract(text, flags + to_java(pattern), group))


def cascade(text: Column, patterns: list[str], group: int = 1, flags: str = "(?iuUd)") -> Column:
    """First pattern that yields a value."""
    return F.coalesce(*[first_match(text, p, group, flags) for p in patterns])


def find_all(text: Column, pattern: str, group: int = 0, flags: str = "(?iuUd)") -> Column:
    """All matches, left to right."""
    return F.regexp_extract_all(text, F.lit(flags + to_java(pattern)), F.lit(group))


PREPARED = T.StructType().add("java", T.StringType()).add("groups", T.IntegerType()).add("optional_first", T.BooleanType())


@F.pandas_udf(PREPARED)
def prepare_column(patterns: pd.Series) -> pd.DataFrame:
    """``prepare`` for rule tables too large to look at on the driver."""
    seen = {p: prepare(p) for p in patterns.dropna().unique()}
    rows = [seen.get(p) for p in patterns]
    return pd.DataFrame(
        {
            "java": [r.java if r else None for r in rows],
            "groups": pd.array([r.groups if r else None for r in rows], dtype="Int32"),
            "optional_first": pd.array([r.optional_first if r else None for r in rows], dtype="boolean"),
        }
    )


@F.pandas_udf(T.BooleanType())
def compiles(patterns: pd.Series) -> pd.Series:
    """Does each pattern compile?"""
    seen = {p: is_valid(p) for p in patterns.dropna().unique()}
    return patterns.map(lambda p: seen.get(p, False)).astype(bool)


@F.pandas_udf(T.ArrayType(T.StringType()))
def keep_compilable(pattern_lists: pd.Series) -> pd.Series:
    """Drop the patterns that do not compile from each list."""
    return pattern_lists.map(lambda ps: [] if ps is None else [p for p in ps if is_valid(p)])
