"""Sharding by a minimax contiguous partition.

Groups of equal texts are atomic.  They are put in one order, and the order is cut
into contiguous shards so that the largest shard is as small as possible: a binary
search finds the smallest capacity for which greedy filling needs no more than the
given number of shards.

Order.  Groups larger than an equal share of what is left come first, the largest
in front; each gets a shard of its own (the smallest capacity for the shards left
is then that group) and the rest is cut again.  All other groups follow in the
order of a digest of their text.  As the order is a digest, a cut is a digest too,
and the shard of a row is a comparison with a few constants: rows are never joined
to groups.

Scale.  Running sums are taken inside buckets of the digest, which are even by
construction; only bucket totals meet in one place.  The search never sees all
groups: it works on the two outermost group ends in each of a bounded number of
bins, keeps a lower and an upper bound of the capacity, and looks closer at the bins
where a cut may fall until both bounds meet.  The result is exact.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import materialize, query, table

#: Buckets of the digest (four hex digits), bins in one look at the group ends, buckets of a shard for the slots.
BUCKET_DIGITS, BINS, SLOT_BUCKETS = 4, 1 << 14, 256


class Ends:
    """What is known of the sorted ends of the groups: some of them, and which spans between them hold no others."""

    def __init__(self, total: int):
        self.known = [0, total] if total else [0]
        self.closed: set[int] = set()  # an end in here has no unknown end between it and the next known one

    def learn(self, bins: list[tuple[int, int, int]], spans: list[tuple[int, int]]) -> None:
        """bins: (smallest end, largest end, number of ends); all ends of the spans lie in bins."""
        seen = sorted(bins)
        self.known = sorted({*self.known, *(x for b in seen for x in b[:2])})
        open_after = {low for low, high, n in seen if n > 2}
        for low, high in spans:
            for end in self.known[bisect_left(self.known, low) : bisect_left(self.known, high)]:
                if end not in open_after:
                    self.closed.add(end)

    def below(self, x: int) -> tuple[int, int]:
        """Bounds of the largest end that is at most x."""
        at = self.known[bisect_right(self.known, x) - 1]
        return at, at if at in self.closed or at == self.known[-1] else x

    def fill(self, capacity: int, shards: int, hopeful: bool) -> list[int]:
        """Ends of the shards that greedy filling makes; hopeful: every unknown end is where one would like it."""
        cuts, at, total = [], 0, self.known[-1]
        for _ in range(shards):
            at = self.below(min(at + capacity, total))[hopeful]
            cuts.append(at)
        return cuts

    def smallest(self, shards: int, hopeful: bool) -> int:
        low, high = 0, self.known[-1]
        while low < high:
            middle = (low + high) // 2
            if self.fill(middle, shards, hopeful)[-1] == self.known[-1]:
                high = middle
            else:
                low = middle + 1
        return low


def minimax_cuts(ends: DataFrame, total: int, shards: int, bins: int = BINS) -> list[int]:
    """Ends of the shards for the smallest feasible capacity.  ``ends``: column ``end`` (running sum of a group)."""
    found = Ends(total)
    if not total:
        return [0] * shards
    spans = [(0, total)]
    while True:
        step = max(1, -(-sum(b - a for a, b in spans) // bins))
        inside = F.lit(None).cast("bigint")
        for k, (a, b) in enumerate(spans):
            inside = F.when((F.col("end") > a) & (F.col("end") <= b), F.lit(k) * bins * 2 + F.floor((F.col("end") - 1 - a) / step)).otherwise(inside)
        rows = (
            ends.select("end", inside.alias("bin")).filter(F.col("bin").isNotNull())
            .groupBy("bin").agg(F.min("end").alias("low"), F.max("end").alias("high"), F.count(F.lit(1)).alias("n")).collect()  # at most two per bin
        )
        found.learn([(r["low"], r["high"], r["n"]) for r in rows], spans)
        least, most = found.smallest(shards, True), found.smallest(shards, False)
        cuts = found.fill(most, shards, False)
        if least == most:
            return cuts
        # a cut lies between where the bounds would put it: open those spans
        spans, reach = [], found.known
        for a, b in zip(found.fill(least, shards, False), found.fill(most, shards, True), strict=True):
            a, b = min(a, b), max(a, b)
            i, j = bisect_right(reach, a) - 1, bisect_left(reach, b)
            for k in range(max(i, 0), min(j + 1, len(reach) - 1)):
                if reach[k] not in found.closed:
                    spans.append((reach[k], reach[k + 1]))
        merged: list[tuple[int, int]] = []
        for a, b in sorted(set(spans)):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        spans = merged


def _measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("_text"),
    )


def _shard_of(digest: Column, alone: list[str], cuts: list[str | None]) -> Column:
    """cuts: the last digest of each further shard; None where a shard is empty."""
    shard = F.lit(len(alone) + len(cuts) - 1)
    for k in range(len(cuts) - 2, -1, -1):
        if cuts[k] is not None:
            shard = F.when(digest <= cuts[k], F.lit(len(alone) + k)).otherwise(shard)
        else:
            continue
    for k, text in enumerate(alone):
        shard = F.when(digest == text, F.lit(k)).otherwise(shard)
    return shard.cast("int")


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row; the largest shard is as small as whole groups allow.

    Size: bytes of the text and one more.  A null text is the empty text.  Equal
    texts share a shard; rows that repeat and null ids are rows like any other.
    Shards may be empty, as all are for an empty table.  Slots count the rows of a
    shard from 0 without gaps.  Other columns are not looked at.
    """
    rows = materialize(_measured(docs, id_col, text_col))
    groups = materialize(
        rows.groupBy("_text").agg(F.sum("size").alias("size"))
        .select("_text", "size", F.substring("_text", 1, BUCKET_DIGITS).alias("_bucket"))
    )
    left = groups.agg(F.sum("size")).first()[0] or 0
    alone: list[str] = []
    for r in groups.orderBy(F.desc("size"), "_text").limit(shards - 1).collect():  # fewer rows than shards
        if r["size"] * (shards - len(alone)) <= left:
            break
        alone.append(r["_text"])
        left -= r["size"]
    rest = groups.filter(~F.col("_text").isin(alone)) if alone else groups
    totals = sorted((r["_bucket"], r["n"]) for r in rest.groupBy("_bucket").agg(F.sum("size").alias("n")).collect())  # at most 16 ** BUCKET_DIGITS
    before, at = [], 0
    for bucket, n in totals:
        before.append((bucket, at))
        at += n
    spark = docs.sparkSession
    offsets = spark.createDataFrame(before, "_bucket string, _before bigint")
    running = F.sum("size").over(Window.partitionBy("_bucket").orderBy("_text").rowsBetween(Window.unboundedPreceding, 0))
    ends = materialize(rest.withColumn("_run", running).join(F.broadcast(offsets), "_bucket").select("_text", (F.col("_run") + F.col("_before")).alias("end")))
    cuts = minimax_cuts(ends, left, shards - len(alone), bins)
    last = {r["end"]: r["_text"] for r in ends.filter(F.col("end").isin(cuts)).collect()}  # one row per cut
    placed = rows.withColumn("shard", _shard_of(F.col("_text"), alone, [last.get(c) for c in cuts])).drop("_text")
    return with_slots(placed)


def with_slots(placed: DataFrame) -> DataFrame:
    """Adds ``slot``: rows of a shard numbered from 0, by buckets of the shard so that no task sorts a whole shard."""
    bucket = F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(SLOT_BUCKETS)).cast("int")
    rows = placed.withColumn("_bucket", bucket)
    counts = rows.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # as many rows as shards times SLOT_BUCKETS
    starts = counts.withColumn("_before", before).drop("_n")
    number = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("doc_id", "size", "text_crc32")) - 1
    return (
        rows.withColumn("_number", number).join(F.broadcast(starts), ["shard", "_bucket"])
        .withColumn("slot", (F.col("_before") + F.col("_number")).cast("long")).drop("_bucket", "_before", "_number")
    )


@query()
def op8_minimax_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All ``documents`` in 16 shards of nearly equal bytes."""
    placed = shard_documents(table(spark, folder, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
