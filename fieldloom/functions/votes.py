"""Votes over the values of one document (arrays); ties go to the first seen.

The table form for votes across rows is in ``operators.voting``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions.binding import let


def tally(values: Column) -> Column:
    """Distinct values with count, most frequent first, first seen first."""

    def count(known: Column) -> Column:
        counted = F.transform(
            F.array_distinct(known),
            lambda v, i: F.struct(F.size(F.filter(known, lambda w: w == v)).alias("n"), (-i).alias("seen"), v.alias("value")),
        )
        return F.sort_array(counted, asc=False)

    return let(F.filter(values, lambda v: v.isNotNull()), count)


def top_values(values: Column, k: int) -> Column:
    """The ``k`` most frequent values."""
    return F.transform(F.slice(tally(values), 1, k), lambda t: t["value"])


def most_common(values: Column) -> Column:
    """The most frequent value, NULL for no values."""
    return F.get(tally(values), F.lit(0))["value"]


def preferred(values: Column, prefer: list) -> Column:
    """Most frequent value of the best class; ``prefer`` holds one test per class.

    Values that pass no test are out.
    """

    def winner(known: Column) -> Column:
        def first(test) -> Column:
            return F.get(F.filter(known, lambda t: test(t["value"])), F.lit(0))["value"]

        return F.coalesce(*map(first, prefer))

    return let(tally(values), winner)


def word_vote(text: Column, words: list[str], legacy_vote: bool = False) -> Column:
    """The fixed word that occurs most often in the text; ties by list order.

    Without any occurrence the result is NULL, or the first word when
    ``legacy_vote`` is set.
    """
    def occurrences(w: str) -> Column:
        left = F.length(text) - F.length(F.replace(text, F.lit(w), F.lit("")))
        # looking for a word is cheap, cutting it out is not
        return F.when(F.contains(text, F.lit(w)), F.floor(left / len(w)).cast("int")).when(text.isNotNull(), F.lit(0))

    counted = [F.struct(occurrences(w).alias("n"), F.lit(-i).alias("seen"), F.lit(w).alias("value")) for i, w in enumerate(words)]
    best = F.array_max(F.array(*counted))
    return best["value"] if legacy_vote else let(best, lambda b: F.when(b["n"] > 0, b["value"]))
