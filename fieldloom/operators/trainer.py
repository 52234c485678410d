"""Finding a selected value again in the other documents of its batch."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom import model as m
from fieldloom.functions.binding import let, let2
from fieldloom.functions.text import context_window, literal_at
from fieldloom.operators.bounds import literal, rows_within, unpack
from fieldloom.operators.terms import contains_join

MAX_SELECTIONS = 2_000
BLANKS = "[ \\t\\r\\n]+"


def inner_word(value: str | None) -> str | None:
    """Longest word with blanks on both sides: a text with the value has it as a word."""
    words = re.split(BLANKS, value or "")[1:-1]
    return max(words, key=len) or None if words else None


def locate_literals(selections: DataFrame, docs: DataFrame, batch: str = "product_id", width: int = m.LITERAL_CONTEXT,
                    max_selections: int = MAX_SELECTIONS) -> DataFrame:
    """(selection_id, doc_id, value, context) for every other document that holds the value.

    ``selections``: selection_id, <batch>, doc_id (origin), value; an empty value is held by every text.  A bounded number
    of selections is tested in one pass over the documents; more of them are found
    by the seed join.
    """
    slim = selections.select("selection_id", F.col(batch).alias("batch"), F.col("doc_id").alias("origin"), "value")
    rows = rows_within(slim.withColumn("value", F.lower("value")), max_selections)
    if rows is not None:
        by_batch: dict[str, list] = {}
        for r in rows:
            by_batch.setdefault(str(r["batch"]), []).append(
                {"selection_id": r["selection_id"], "origin": r["origin"], "value": r["value"], "anchor": inner_word(r["value"])}
            )
        table = literal(by_batch, "map<string,array<struct<selection_id:bigint,origin:bigint,value:string,anchor:string>>>")
        mine = F.try_element_at(table, F.col(batch).cast("string"))

        def held(low: Column, selected: Column) -> Column:
            # one hashed intersection decides for most values that they cannot occur
            words = F.array_intersect(F.transform(selected, lambda s: s["anchor"]), F.split(low, BLANKS))
            return let(words, lambda known: F.filter(selected, lambda s: (
                (s["anchor"].isNull() | F.array_contains(known, s["anchor"]))
                & ~s["origin"].eqNullSafe(F.col("doc_id")) & F.contains(low, s["value"])
            )))

        hit = docs.select("doc_id", "text", let2(F.lower("text"), mine, held).alias("_hits"))
        pairs = unpack(hit, ["doc_id", "text"], "_hits").select("selection_id", "doc_id", "value", "text")
    else:
        terms = slim.select(F.col("selection_id").alias("term_id"), F.col("batch").alias(batch), F.col("value").alias("term"))
        hits = contains_join(docs.select("doc_id", "text", batch), terms, same=[batch]).select(F.col("term_id").alias("selection_id"), "doc_id")
        # an empty value is held by every text of its batch, as in the other form
        empty = slim.filter("value = ''").select("selection_id", F.col("batch").alias(batch))
        hits = hits.unionByName(docs.filter(F.col("text").isNotNull()).select("doc_id", batch).join(empty, batch).select("selection_id", "doc_id"))
        pairs = (
            hits.join(slim, "selection_id").filter(~F.col("origin").eqNullSafe(F.col("doc_id")))
            .join(docs.select("doc_id", "text"), "doc_id").select("selection_id", "doc_id", "value", "text")
        )
    return pairs.select(
        "selection_id", "doc_id", literal_at(F.col("text"), F.col("value")).alias("value"),
        context_window(F.col("text"), F.col("value"), width).alias("context"),
    )


def literal_summary(selections: DataFrame, docs: DataFrame, hits: DataFrame, batch: str = "product_id") -> DataFrame:
    """Per selection: sibling documents with text, with and without the value."""
    totals = docs.filter(F.coalesce(F.length("text"), F.lit(0)) > 0).groupBy(batch).agg(F.count(F.lit(1)).alias("_docs"))
    n = hits.groupBy("selection_id").agg(F.count(F.lit(1)).alias("_found"))
    origin = docs.filter(F.coalesce(F.length("text"), F.lit(0)) > 0).select("doc_id", F.col(batch).alias("_ob"))
    own = selections.join(origin, (selections["doc_id"] == origin["doc_id"]) & (selections[batch] == origin["_ob"]), "left")
    return (
        own.select("selection_id", batch, F.col("_ob").isNotNull().cast("int").alias("_own"))
        .join(totals, batch, "left").join(n, "selection_id", "left")
        .select(
            "selection_id", F.coalesce("_found", F.lit(0)).alias("found"),
            (F.coalesce("_docs", F.lit(0)) - F.col("_own")).alias("total"),
        )
        .withColumn("not_found", F.col("total") - F.col("found"))
    )
