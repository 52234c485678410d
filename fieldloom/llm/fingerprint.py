"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

The five-word shingles of a text are hashed once.  A hash falls into one of BINS bins
by its highest bits; the smallest hash of a bin is its value.  An empty bin borrows from another one by optimal densification: a fixed
pseudo-random sequence of bins of its own is followed to the first that is not
empty, so equal sets of filled bins borrow alike and each filled bin is equally
likely.  Of each value BITS low-order bits are packed into the fingerprint.  Of two
fingerprints the share m of equal bins overstates the likeness by chance matches;
(m - 2^-BITS) / (1 - 2^-BITS) corrects it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.functions.binding import let
from fieldloom.llm.common import LOWER, UPPER, query, table

#: Bins, bits of a bin (two hex digits), words of a shingle, steps of a bin's sequence.
BINS, BITS, WIDTH, STEPS = 128, 8, 5, 12
#: Quantiles of the ids, rows of a range, most parts of the ids between two quantiles.
QUANTILES, ROWS_PER_RANGE, MOST_CUTS = 128, 20_000, 512
HALF = BINS // 2


def _sequence(bin_: int, steps: int) -> list[int]:
    """The first distinct bins that an empty bin asks, from a digest."""
    found: list[int] = []
    k = 0
    while len(found) < steps:
        for byte in hashlib.sha256(f"{bin_}/{k}".encode()).digest():
            if byte % BINS != bin_ and byte % BINS not in found and len(found) < steps:
                found.append(byte % BINS)
        k += 1
    return found


def shingle_hashes(text: Column) -> Column:
    """Hashes of the five-word shingles; the whole sequence is one if the words are fewer; none without words."""
    words = F.filter(F.split(F.translate(text, UPPER + "\t\n\x0b\x0c\r", LOWER + "     "), " +"), lambda w: w != "")

    def runs(hashed: Column) -> Column:
        many = F.transform(
            F.sequence(F.lit(0), F.size(hashed) - WIDTH),
            lambda i: F.xxhash64(*[F.get(hashed, i + k) for k in range(WIDTH)]),
        )
        return F.when(F.size(hashed) >= WIDTH, many).when(F.size(hashed) > 0, F.array(F.xxhash64(F.array_join(hashed.cast("array<string>"), " ")))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), runs)


def bin_values(hashes: Column) -> Column:
    """The smallest hash of each filled bin, ordered by bin; the bin is in the highest bits."""
    bits = BINS.bit_length() - 1

    def firsts(ordered: Column) -> Column:
        fresh = lambda x, i: (i == 0) | (F.shiftrightunsigned(x, 64 - bits) != F.shiftrightunsigned(F.get(ordered, i - 1), 64 - bits))
        return F.filter(ordered, fresh)

    return let(F.sort_array(hashes), firsts)


def _bin(value: Column) -> Column:
    """Bins in the order of signed hashes: the negative half comes first."""
    return F.shiftrightunsigned(value.bitwiseXOR(F.lit(-(1 << 63))), 65 - BINS.bit_length()).cast("int")


def fingerprint(text: Column) -> Column:
    """Two hex digits for each bin; the empty string for a text without words (or null)."""

    def pack(values: Column) -> Column:
        def mask(low: int) -> Column:
            bit = lambda acc, v: F.when((_bin(v) >= low) & (_bin(v) < low + HALF), acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), _bin(v) - low))).otherwise(acc)
            return F.aggregate(values, F.lit(0).cast("bigint"), bit)

        def spell(masks: Column) -> Column:
            low, high = masks["low"], masks["high"]
            filled = lambda b: F.when(b < HALF, F.call_function("getbit", low, F.pmod(b, F.lit(HALF)))).otherwise(F.call_function("getbit", high, F.pmod(b, F.lit(HALF)))) == 1
            upto = lambda m, n: F.bit_count(m.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("bigint"), n))))
            place = lambda b: F.when(b < HALF, upto(low, F.pmod(b, F.lit(HALF)))).otherwise(F.bit_count(low) + upto(high, F.pmod(b, F.lit(HALF))))
            table_ = F.lit([[b, *_sequence(b, STEPS)] for b in range(BINS)])

            def source(asked: Column) -> Column:
                own = F.get(asked, F.lit(0))
                hit = F.get(F.filter(asked, filled), F.lit(0))
                # later steps of the sequence: the filled bin that the digest of both puts first
                rank = lambda v: F.struct(F.xxhash64(own, _bin(v)), _bin(v).alias("b"))
                return F.when(filled(own), own).otherwise(F.coalesce(hit, F.array_min(F.transform(values, rank))["b"]))

            digits = F.transform(table_, lambda asked: F.lpad(F.lower(F.hex(let(source(asked), lambda b: F.get(values, place(b))).bitwiseAND(F.lit((1 << BITS) - 1)))), BITS // 4, "0"))
            return F.array_join(digits, "")

        return F.when(F.size(values) == 0, F.lit("")).otherwise(let(F.struct(mask(0).alias("low"), mask(HALF).alias("high")), spell))

    return let(bin_values(shingle_hashes(F.coalesce(text, F.lit("")))), pack)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints in [0, 1]; 1 for two empty ones, 0 for an empty one and another."""
    digits = BITS // 4
    equal = F.size(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.substr(a, i * digits + 1, F.lit(digits)) == F.substr(b, i * digits + 1, F.lit(digits))))
    chance = 2.0**-BITS
    corrected = F.greatest(F.lit(0.0), (equal / F.lit(BINS) - chance) / (1 - chance))
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(corrected)


def _place(key: Column, borders: list) -> Column:
    """Number of borders below the key."""
    return F.size(F.filter(F.lit(borders), lambda border: border < key))


def _range_of(docs: DataFrame, rows_per_range: int) -> Column:
    """Number of the range of an id, rising with it; -1 for null.

    Quantiles give the borders of up to QUANTILES ranges, a long one is cut evenly.  They
    only balance the ranges, any borders give the same result.
    """
    known = docs.agg(
        F.percentile_approx("doc_id", [i / QUANTILES for i in range(QUANTILES + 1)], 10_000).alias("q"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("doc_id").alias("n")
    ).first()
    if not known["n"]:
        return F.lit(-1)
    borders = sorted({known["low"], known["high"], *known["q"]})
    cuts = min(MOST_CUTS, 1 + known["n"] // (len(borders) * rows_per_range))
    key = F.col("doc_id")
    whole = F.lit([borders[0], *borders, borders[-1]])

    def number(place: Column, low: Column, high: Column) -> Column:
        within = F.when(high > low, F.floor((key - low) / (high - low) * (cuts - 1))).otherwise(F.lit(0))
        return place * cuts + within.cast("int")

    # the place is found once and its borders are looked up once: the plan, which the driver holds, stays short
    ends = lambda place: F.struct(place.alias("place"), F.get(whole, place).cast("double").alias("low"), F.get(whole, place + 1).cast("double").alias("high"))
    found = let(let(_place(key, borders), ends), lambda e: number(e["place"], e["low"], e["high"]))
    return F.when(key.isNull(), F.lit(-1)).otherwise(found)


def with_next(docs: DataFrame, column: str, made: dict[str, Column], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """doc_id, ``column``, the columns ``made`` of it, and ``next``: a struct of these of the next row.

    Order: descending doc_id, null last, equal ids by ``column``; after the last row comes
    the first.  Rows of a range of ids share a task; the last row of a range gets the
    first row of the range below from a table with one row per range.
    """
    ranged = docs.select("doc_id", column, _range_of(docs, rows_per_range).alias("_range"))
    rows = ranged.select("*", *[v.alias(k) for k, v in made.items()])
    next_row = F.struct(column, *made)
    inside = rows.withColumn("next", F.lead(next_row).over(Window.partitionBy("_range").orderBy(F.desc_nulls_last("doc_id"), column)))
    # a row per range: at most (QUANTILES + 2) * MOST_CUTS
    tops = ranged.groupBy("_range").agg(F.max("doc_id").alias("_top"))
    heads = (
        ranged.join(F.broadcast(tops), "_range").filter(F.col("doc_id").eqNullSafe(F.col("_top")))
        .groupBy("_range").agg(F.min(F.struct(column)).alias("_h")).select("_range", f"_h.{column}")
        .select(F.col("_range").alias("_from"), F.struct(column, *[v.alias(k) for k, v in made.items()]).alias("_head"))
    )
    # numbers of ranges alone meet in one place
    order = Window.orderBy("_range")
    below = ranged.select("_range").distinct().select("_range", F.coalesce(F.lag("_range").over(order), F.max("_range").over(Window.partitionBy())).alias("_from"))
    borders = below.join(heads, "_from").select("_range", "_head")
    return inside.join(borders, "_range").withColumn("next", F.coalesce("next", "_head")).drop("_range", "_head")


def edited_text(text: Column, next_text: Column) -> Column:
    """The last third of the code points replaced by the first as many (or all) of the next text."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - third), F.substr(next_text, F.lit(1), third))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    A null text is the empty text; its fingerprint is empty.  Equal texts have equal
    fingerprints.  A single row is its own next one.  An empty table gives no rows, rows
    that repeat are kept, other columns are not looked at.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(base, "text", {"fingerprint": fingerprint(F.col("text"))}, rows_per_range)
    rows = rows.withColumn("edited", edited_text(F.col("text"), F.col("next.text"))).withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next.fingerprint")).alias("near_next"),
    )


@query()
def op9_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all ``documents`` and of their edited texts."""
    return fingerprints(table(spark, folder, "documents"))
