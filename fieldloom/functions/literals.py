"""Literals that every match of a pattern holds, read from its syntax tree.

A pattern can only occur in a text that has one of them, so a table of many patterns is
first met through its literals and few patterns are tried on each text.
"""

from __future__ import annotations

import re
from re import _constants as kinds
from re import _parser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Shortest literal worth looking for, most alternatives of a pattern.
SHORTEST, MOST = 3, 64


def _better(a: list[str] | None, b: list[str] | None) -> list[str] | None:
    """Of two conditions that both hold the more selective one: longer shortest literal, then fewer."""
    if a is None or b is None:
        return a if b is None else b
    return max(a, b, key=lambda x: (min(map(len, x)), -len(x)))


def _of_sequence(items) -> list[str] | None:
    best, run = None, ""
    for kind, value in [*items, (None, None)]:
        if kind is kinds.LITERAL:
            run += chr(value).lower()
            continue
        if len(run) >= SHORTEST:
            best = _better(best, [run])
        run = ""
        best = _better(best, _of_item(kind, value))
    return best


def _of_item(kind, value) -> list[str] | None:
    if kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT):
        return _of_sequence(value[2]) if value[0] else None
    if kind is kinds.SUBPATTERN:
        return _of_sequence(value[3])
    if kind is kinds.ATOMIC_GROUP:
        return _of_sequence(value)
    if kind is kinds.BRANCH:
        parts = [_of_sequence(x) for x in value[1]]
        if any(p is None for p in parts):
            return None
        found = sorted({w for p in parts for w in p})
        return found if len(found) <= MOST else None
    # sets, places, look-arounds, references and conditions say nothing here
    return None


def required_literals(pattern: str) -> list[str] | None:
    """Lower-case literals of which each match of the pattern, whatever its case, holds one; None if nothing is known."""
    try:
        tree = _parser.parse(pattern, re.IGNORECASE | re.MULTILINE)
    except (re.error, RecursionError, OverflowError):
        return None
    if tree.state.flags & re.VERBOSE:
        return None
    return _of_sequence(list(tree))


@F.pandas_udf(T.ArrayType(T.StringType()))
def literals_column(patterns: pd.Series) -> pd.Series:
    """``required_literals`` for tables of patterns."""
    seen = {p: required_literals(p) for p in patterns.dropna().unique()}
    return patterns.map(lambda p: seen.get(p))
