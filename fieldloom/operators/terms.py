"""Which terms occur in which documents, for term tables of any size.

``contains_join`` finds substrings through an equi-join on short seeds and then
checks each candidate, so no document is paired with all terms.
``pattern_hits`` meets regular expressions through the literals that they need; those
without one are run in batches of a bounded size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.binding import let
from fieldloom.operators.bounds import fits, join_small, literal, unpack
from fieldloom.session import materialize

SEED = 3
MAX_CANDIDATES = 20_000


def seeds(text, width: int):
    """Distinct substrings of one width."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{width}}}))"), F.lit(1)))


def contains_join(docs: DataFrame, terms: DataFrame, same: list[str] | None = None) -> DataFrame:
    """(doc_id, term_id, term) for every lower-case term contained in the lower-case text.

    ``docs``: doc_id, text.  ``terms``: term_id, term.  ``same`` names columns
    that must be equal on both sides.
    """
    same = same or []
    low = docs.select("doc_id", *same, F.lower("text").alias("_low"))
    wanted = terms.select("term_id", *same, F.lower("term").alias("term")).filter(F.col("term") != "")
    wanted = wanted.withColumn("_seed", F.substring("term", 1, SEED))
    by_width = wanted.groupBy(F.length("_seed").alias("w")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most SEED rows
    widths = sorted(r["w"] for r in by_width) or [SEED]
    parts = 1 + sum(r["n"] for r in by_width) // MAX_CANDIDATES
    if fits(wanted):
        return _found_in_place(low, wanted, same, widths)
    doc_seeds = low.select(
        "doc_id", *same,
        F.explode_outer(F.flatten(F.array(*[seeds(F.col("_low"), w) for w in widths]))).alias("_seed"),
    ).filter(F.col("_seed").isNotNull())
    pairs = doc_seeds.join(wanted, [*same, "_seed"])
    # a list holds at most about MAX_CANDIDATES terms; with fewer terms than that there
    # is one list per document and the text is shuffled once
    part = F.pmod(F.xxhash64("term_id"), F.lit(parts))
    candidates = pairs.groupBy("doc_id", part.alias("_part")).agg(F.collect_list(F.struct("term_id", "term")).alias("_cands"))
    found = low.select("doc_id", "_low").join(candidates, "doc_id").select(
        "doc_id", F.filter("_cands", lambda c: F.contains(F.col("_low"), c["term"])).alias("_hits")
    )
    return unpack(found, ["doc_id"], "_hits")


def _found_in_place(low: DataFrame, wanted: DataFrame, same: list[str], widths: list[int]) -> DataFrame:
    """``contains_join`` for terms that fit in every task: each text meets them where it is read, only ids are shuffled.

    Texts under one id count together, as in the other form: each that holds a term, once for each that has its seed.
    """
    few = wanted.groupBy(*same, "_seed", "term_id", "term").agg(F.count(F.lit(1)).alias("_copies"))
    met = low.select(
        "doc_id", *same, "_low", F.explode_outer(F.flatten(F.array(*[seeds(F.col("_low"), w) for w in widths]))).alias("_seed")
    ).filter(F.col("doc_id").isNotNull() & F.col("_seed").isNotNull())
    # the terms themselves stay behind: their number stands for them until the hits are known
    numbered = few.withColumn("_term", F.xxhash64("term"))
    tried = met.join(F.broadcast(numbered), [*same, "_seed"]).select(
        "doc_id", "term_id", "_term", "_copies", F.contains("_low", F.col("term")).cast("int").alias("_holds")
    )
    counts = tried.groupBy("doc_id", "term_id", "_term").agg(F.sum("_holds").alias("_held"), F.sum("_copies").alias("_met"))
    hits = counts.filter("_held > 0").select("doc_id", "term_id", "_term", F.explode(F.array_repeat(F.lit(0), (F.col("_held") * F.col("_met")).cast("int"))).alias("_n"))
    named = numbered.select("term_id", "_term", "term").distinct()
    return hits.join(F.broadcast(named), ["term_id", "_term"]).select("doc_id", "term_id", "term")


#: A letter that patterns take for s, and lower case leaves alone.
LONG_S = "\u017f"


def pattern_hits(docs: DataFrame, patterns: DataFrame, batch: int = 2_000) -> DataFrame:
    """(doc_id, term_id) for every pattern that occurs in the lower-case text.

    ``patterns``: term_id, java (already checked and rewritten), and ``literals`` if known
    (see ``functions.literals``).  Patterns with literals are tried where one of those occurs, in one
    pass for any number of them.  Of the others each batch is one pass without a
    shuffle; its hits are written out before the next one.
    """
    if "literals" in patterns.columns:
        known = F.coalesce(F.size("literals"), F.lit(0)) > 0
        return _hits_by_literals(docs, patterns.filter(known)).unionByName(pattern_hits(docs, patterns.filter(~known).drop("literals"), batch))
    parts, held = [], []

    def flush() -> None:
        config = literal(held, "array<struct<term_id:bigint,java:string>>")
        hits = let(F.lower("text"), lambda low: F.filter(config, lambda p: F.rlike(low, p["java"])))
        found = docs.select("doc_id", F.explode_outer(F.transform(hits, lambda p: p["term_id"])).alias("term_id"))
        parts.append(materialize(found.filter(F.col("term_id").isNotNull())))
        held.clear()

    for row in patterns.select("term_id", "java").toLocalIterator():
        held.append({"term_id": row["term_id"], "java": row["java"]})
        if len(held) == batch:
            flush()
    if held or not parts:
        flush()
    return reduce(DataFrame.unionByName, parts)


def _hits_by_literals(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """Hits of patterns that need a literal: documents meet literals, candidates are searched in the row of their text."""
    rows = patterns.select("term_id", "java", F.explode("literals").alias("literal")).withColumn("literal_id", F.xxhash64("literal"))
    plain = docs.select("doc_id", F.translate(F.lower("text"), LONG_S, "s").alias("text"))
    met = contains_join(plain, rows.select(F.col("literal_id").alias("term_id"), F.col("literal").alias("term")).distinct())
    tried = join_small(met.select("doc_id", F.col("term").alias("literal")), rows.select("literal", "term_id", "java"), "literal")
    lists = tried.groupBy("doc_id").agg(F.collect_set(F.struct("term_id", "java")).alias("_tried"))
    text = docs.select("doc_id", F.lower("text").alias("_low")).join(lists, "doc_id")
    return unpack(text.select("doc_id", F.filter("_tried", lambda p: F.rlike(F.col("_low"), p["java"])).alias("_hits")), ["doc_id"], "_hits").select("doc_id", "term_id")
