"""Naming an intermediate value inside one expression.

Expressions inside higher-order functions are evaluated again for every element;
a value bound with ``let`` is evaluated once per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to an already evaluated ``value``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def let2(a: Column, b: Column, body: Callable[[Column, Column], Column]) -> Column:
    return let(a, lambda x: let(b, lambda y: body(x, y)))


def keep_if(value: Column, test: Callable[[Column], Column]) -> Column:
    """The value when it passes the test, else NULL; the value is evaluated once."""
    return F.get(F.filter(F.array(value), test), F.lit(0))


def regexp_extract(text: Column | str, pattern: Column | str, group: Column | int) -> Column:
    """``regexp_extract`` with columns (or plain values) for pattern and group."""
    return F.call_function(
        "regexp_extract",
        F.col(text) if isinstance(text, str) else text,
        F.lit(pattern) if isinstance(pattern, str) else pattern,
        F.lit(group) if isinstance(group, int) else group,
    )
