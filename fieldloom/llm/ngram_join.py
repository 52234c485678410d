"""N-gram Jaccard self-join with prefixes under several global token orders.

Under any global order of tokens two sets of similarity t share a token among their
first n - ceil(t * n) + 1 (the prefix).  A candidate pair must share one under each of
several different orders: pairs are found under the first one and intersected with
those of the others before they are verified.

Orders.  Each starts with the estimated frequency of a token, rarest first, from a
count sketch of fixed size over all sets, so common passages stay out of the
prefixes, and breaks ties by a hash of its own.  Any order is exact; the sketch only
decides how many candidates there are.

Copies and groups.  Equal sets are one class, joined as one.  Within the sets that
share a prefix token (a block) not all pairs are made: first a set is paired with a
neighbour, a leader and the block's most central set, and links that hold give components.  Then only pairs of
different components are left.  They are compared by sizes and spreads in cells of
bounded size, and those that can be similar are verified, so no link between components
is lost.  A group of linked copies costs its size; only sets that share a prefix token
and are not linked are compared each with each, a few hundred bytes a set.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import materialize, query, slices, table
from fieldloom.llm.components import components
from fieldloom.llm.shingles import mix, shingle_sets
from fieldloom.operators.bounds import fits, join_small

#: Similarity and words of a shingle when a contract does not say otherwise.
SIMILARITY, WIDTH = Fraction(4, 5), 5
#: Token orders, counters of the sketch and of a part of it, blocks up to SMALL sets make all pairs at once, sets led by one, groups of the spread, sets in a part of a block.
ORDERS, SKETCH, CHUNK, SMALL, LED, SPREAD, TILE = 2, 1 << 20, 1 << 14, 4, 256, 256, 512
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def prefix_length(n: np.ndarray, t: Fraction) -> np.ndarray:
    return n - (n * t.numerator + t.denominator - 1) // t.denominator + (n > 0)


def token_sets(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, set_key, n, spread) of all documents, and rows (chunk, counts) of the token counts of each task.

    Texts of one set share set_key, which is null without words.  spread: how many tokens of
    the set fall into each of SPREAD groups; null if one number exceeds a byte.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(SKETCH, np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                tokens, counts = shingle_sets(batch.column("text"), width)
                held += np.bincount(_places(tokens), minlength=SKETCH)
                ends = np.cumsum(counts)
                names = [hashlib.sha256(tokens[e - c : e].tobytes()).digest()[:16] if c else None for e, c in zip(ends, counts, strict=True)]
                row = np.repeat(np.arange(len(counts)), counts)
                spread = np.bincount(row * SPREAD + (tokens % np.uint64(SPREAD)).astype(np.int64), minlength=len(counts) * SPREAD).reshape(-1, SPREAD)
                spelt = [x.tobytes() if ok else None for x, ok in zip(spread.astype(np.uint8), spread.max(axis=1, initial=0) < 256, strict=True)]
                nothing = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(names, pa.binary()), pa.array(counts, pa.int64()), pa.array(spelt, pa.binary()), pa.nulls(nothing, pa.int32()), pa.nulls(nothing, pa.binary())],
                    names=["doc_id", "set_key", "n", "spread", "chunk", "counts"],
                )
        parts = [held[i : i + CHUNK].tobytes() for i in range(0, SKETCH, CHUNK)]
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(parts), pa.int64()), pa.nulls(len(parts), pa.binary()), pa.nulls(len(parts), pa.int64()), pa.nulls(len(parts), pa.binary()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())],
            names=["doc_id", "set_key", "n", "spread", "chunk", "counts"],
        )

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(keys, "doc_id bigint, set_key binary, n bigint, spread binary, chunk int, counts binary")


def _places(tokens: np.ndarray) -> np.ndarray:
    return (mix(tokens) >> np.uint64(64 - (SKETCH.bit_length() - 1))).astype(np.int64)


def sketch(counted: DataFrame) -> np.ndarray:
    """A frequency class for each of SKETCH groups of tokens, from the counts of all tasks.

    Counts are summed in two steps, so that no task sees those of all others.
    """

    def total(part: pa.Table) -> pa.Table:
        held = np.zeros(CHUNK, np.int64)
        for x in part.column("counts"):
            held += np.frombuffer(x.as_py(), np.int64)
        return pa.table({"chunk": part.column("chunk")[:1], "counts": pa.array([held.tobytes()], pa.binary())})

    rows = counted.filter("chunk IS NOT NULL").select("chunk", "counts", F.pmod(F.xxhash64("counts"), F.lit(256)).alias("_s"))
    some = rows.groupBy("chunk", "_s").applyInArrow(total, "chunk int, counts binary")
    sums = some.groupBy("chunk").applyInArrow(total, "chunk int, counts binary")
    out = np.zeros(SKETCH, np.uint8)
    classes = lambda x: np.minimum(255, np.round(6 * np.log2(np.maximum(x, 1)))).astype(np.uint8)
    for r in sums.toLocalIterator():  # SKETCH / CHUNK rows of a fixed size
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = classes(np.frombuffer(r["counts"], np.int64))
    return out


def ranked(tokens: np.ndarray, row: np.ndarray, classes: np.ndarray, order: int) -> np.ndarray:
    """Places of the tokens, each row's in the global order: rarest class first, then the order's own hash."""
    return np.lexsort((mix(tokens + np.uint64(SEEDS[order])), classes[_places(tokens)], row))


def prefixes(tokens: np.ndarray, counts: np.ndarray, classes: np.ndarray, order: int, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the sets' prefixes and the number of the set of each."""
    row = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(len(tokens)) - (np.cumsum(counts) - counts)[row] < prefix_length(counts, t)[row]
    chosen = ranked(tokens, row, classes, order)[inside]
    return tokens[chosen], row[chosen]


def shared_within(xs: np.ndarray, xrow: np.ndarray, ys: np.ndarray, yrow: np.ndarray, rows: int) -> np.ndarray:
    """How many tokens the two sets of each row share."""
    row, tokens = np.concatenate([xrow, yrow]), np.concatenate([xs, ys])
    order = np.lexsort((tokens, row))
    tokens, row = tokens[order], row[order]
    same = (tokens[1:] == tokens[:-1]) & (row[1:] == row[:-1])
    return np.bincount(row[1:][same], minlength=rows)


def postings(texts: DataFrame, width: int, t: Fraction, classes) -> DataFrame:
    """(token, id, n): the tokens of each set's prefix under the first order.  ``texts``: id, text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                tokens, counts = shingle_sets(batch.column("text"), width)
                chosen, row = prefixes(tokens, counts, classes.value, 0, t)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(chosen.view(np.int64)), batch.column("id").take(pa.array(row)), pa.array(counts[row].astype(np.int32))], names=["token", "id", "n"]
                )

    return texts.select("id", "text").mapInArrow(find, "token bigint, id bigint, n int")


def first_pairs(posted: DataFrame, t: Fraction) -> DataFrame:
    """What the blocks give at once: rows (null, id, null, other) are pairs, rows (token, id, n, null) are larger blocks.

    The sets of a block stream by in the order of their sizes.  A block of up to SMALL
    sets makes all its pairs.  In a larger one a set meets the one before it and the
    leader of its run of LED sets.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, ids, n = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        before, done = 0, 0  # place of the first row held in its block, rows held that are dealt with
        for batch in _and_last(batches):
            last = batch is None
            if not last:
                token = np.concatenate([token, batch.column("token").to_numpy()])
                ids = np.concatenate([ids, batch.column("id").to_numpy()])
                n = np.concatenate([n, batch.column("n").to_numpy().astype(np.int64)])
            if not len(token):
                continue
            fresh = np.concatenate([[True], token[1:] != token[:-1]])
            starts = np.nonzero(fresh)[0]
            block = np.cumsum(fresh) - 1
            place = np.arange(len(token)) - starts[block] + np.where(block == 0, before, 0)
            size = (np.bincount(block) + np.where(np.arange(len(starts)) == 0, before, 0))[block]
            end = len(token) if last or size[-1] > SMALL else starts[-1]
            at = np.arange(done, end)
            large = size[at] > SMALL
            pairs = []
            for back in range(1, SMALL):
                use = at[(place[at] >= back) & (~large | (back == 1))]
                pairs.append((use, use - back))
            led = at[large & (place[at] % LED > 2)]
            pairs.append((led, led - place[led] % LED))
            x, y = (np.concatenate(c) for c in zip(*pairs, strict=True))
            near = np.minimum(n[x], n[y]) * t.denominator >= np.maximum(n[x], n[y]) * t.numerator
            x, y = ids[x[near]], ids[y[near]]
            keep = at[large]
            nothing = pa.nulls(len(x), pa.int64())
            yield pa.RecordBatch.from_arrays([nothing, pa.array(np.minimum(x, y)), pa.nulls(len(x), pa.int32()), pa.array(np.maximum(x, y))], names=["token", "id", "n", "other"])
            yield pa.RecordBatch.from_arrays([pa.array(token[keep]), pa.array(ids[keep]), pa.array(n[keep].astype(np.int32)), pa.nulls(len(keep), pa.int64())], names=["token", "id", "n", "other"])
            if end == len(token):  # the last block is large: its latest rows stay for the ones to come
                hold = max(starts[-1], len(token) - LED - SMALL)
                before, done = int(place[hold]), len(token) - hold
            else:
                hold, before, done = end, 0, 0
            token, ids, n = token[hold:], ids[hold:], n[hold:]

    return posted.repartition("token").sortWithinPartitions("token", "n", "id").mapInArrow(stream, "token bigint, id bigint, n int, other bigint")


def _and_last(batches):
    yield from batches
    yield None


def may_be_similar(na: np.ndarray, nb: np.ndarray, sa: np.ndarray, sb: np.ndarray, t: Fraction) -> np.ndarray:
    """Whether sizes and spreads allow the similarity: two sets share at most the smaller number of each group."""
    common = np.minimum(sa, sb).sum(axis=1, dtype=np.int64)
    return common * t.denominator >= (na + nb - common) * t.numerator


def possible(pairs: DataFrame, spreads: DataFrame, t: Fraction) -> DataFrame:
    """The pairs whose sizes and spreads allow the similarity.

    Small rows go to the pairs here, so that texts only go to what is left.
    """

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            good = np.minimum(na, nb) * t.denominator >= np.maximum(na, nb) * t.numerator
            known = np.nonzero(good & pc.and_(pc.is_valid(batch.column("sa")), pc.is_valid(batch.column("sb"))).to_numpy(zero_copy_only=False))[0]
            for some in np.array_split(known, max(1, len(known) // 4096)):
                at = pa.array(some)
                sa, sb = (np.frombuffer(b"".join(batch.column(c).take(at).to_pylist()), np.uint8).reshape(-1, SPREAD) for c in ("sa", "sb"))
                good[some] = may_be_similar(na[some], nb[some], sa, sb, t)
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    needed = materialize(join_small(spreads, ids, "id", "left_semi"))
    both = pairs.join(needed.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("spread").alias("sa")), "a")
    both = both.join(needed.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("spread").alias("sb")), "b")
    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(bound, "a bigint, b bigint")


def central_pairs(blocks: DataFrame, t: Fraction) -> DataFrame:
    """Pairs of each set of a larger block with the block's most central one.

    Central: the largest share of the own prefix lies in larger blocks.  Copies with edits of
    their own have tokens that nobody shares; what they were copied from has none.
    """
    held = blocks.groupBy("id").agg(F.count(F.lit(1)).alias("m"), F.first("n").alias("n"))
    least = F.ceil(F.col("n") * t.numerator / F.lit(t.denominator))
    score = held.select("id", (F.col("m") / (F.col("n") - least + 1)).alias("s"))
    scored = blocks.join(score, "id")
    hubs = scored.groupBy("token").agg(F.max(F.struct("s", "id", "n")).alias("h")).select("token", F.col("h.id").alias("hub"), F.col("h.n").alias("hub_n"))
    near = F.least("n", "hub_n") * t.denominator >= F.greatest("n", "hub_n") * t.numerator
    return blocks.join(hubs, "token").filter((F.col("id") != F.col("hub")) & near).select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))


def verified(pairs: DataFrame, texts: DataFrame, width: int, t: Fraction, classes, orders: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar: candidates under the other orders too, then exactly."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "ta", 2 << 20):
                xs, xn = shingle_sets(batch.column("ta"), width)
                ys, yn = shingle_sets(batch.column("tb"), width)
                rows = batch.num_rows
                good = np.ones(rows, bool)
                for k in range(1, orders):
                    good &= shared_within(*prefixes(xs, xn, classes.value, k, t), *prefixes(ys, yn, classes.value, k, t), rows) > 0
                xrow, yrow = np.repeat(np.arange(rows), xn), np.repeat(np.arange(rows), yn)
                xin, yin = good[xrow], good[yrow]
                common = shared_within(xs[xin], xrow[xin], ys[yin], yrow[yin], rows)
                good &= common * t.denominator >= (xn + yn - common) * t.numerator
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(good)), batch.column("b").filter(pa.array(good))], names=["a", "b"])

    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    needed = materialize(join_small(texts, ids, "id", "left_semi"))
    both = pairs.join(needed.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(needed.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(check, "a bigint, b bigint")


def cross_pairs(blocks: DataFrame, labels: DataFrame, spreads: DataFrame, t: Fraction) -> DataFrame:
    """The pairs of different components within a block whose sizes and spreads allow the similarity.

    Only blocks that still hold several components are looked at.  A block is cut into
    parts of about TILE sets, and each two parts meet in a cell of their own, so no task
    holds a whole block; a cell compares numbers and hands on the pairs that can be similar.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _and_last(batches):
            if batch is not None:
                rows = pa.Table.from_batches([batch])
                held = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
            if held is None or not held.num_rows:
                continue
            token, i, j, part, ids, n, c = (held.column(k).to_numpy() for k in ("token", "i", "j", "part", "id", "n", "c"))
            n = n.astype(np.int64)
            fresh = (token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            starts = np.concatenate([[0], np.nonzero(fresh)[0] + 1])
            ends = np.append(starts[1:], len(token))
            if batch is not None:  # more rows of the last cell may come
                starts, ends = starts[:-1], ends[:-1]
            known = pc.is_valid(held.column("spread")).to_numpy()
            nothing = bytes(SPREAD)
            spread = np.frombuffer(b"".join(x or nothing for x in held.column("spread").to_pylist()), np.uint8).reshape(-1, SPREAD)
            left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for s, e in zip(starts, ends, strict=True):
                at = slice(s, e)
                meets = (c[at, None] != c[None, at]) & (np.minimum.outer(n[at], n[at]) * t.denominator >= np.maximum.outer(n[at], n[at]) * t.numerator)
                if i[s] != j[s]:
                    meets &= part[at, None] != part[None, at]
                xs, ys = np.nonzero(np.triu(meets, 1))
                for k in range(0, len(xs), 4096):
                    x, y = xs[k : k + 4096] + s, ys[k : k + 4096] + s
                    good = may_be_similar(n[x], n[y], spread[x], spread[y], t) | ~known[x] | ~known[y]
                    left.append(ids[x[good]])
                    right.append(ids[y[good]])
            x, y = np.concatenate(left), np.concatenate(right)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])
            held = held.slice(ends[-1] if len(ends) else 0)

    base = blocks.join(labels, "id", "left").select("token", "id", "n", F.coalesce("component", "id").alias("c"))
    each = base.groupBy("token", "c").agg(F.count(F.lit(1)).alias("m"))
    mixed = each.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.ceil(F.sum("m") / F.lit(TILE)).cast("int").alias("parts")).filter("k > 1").select("token", "parts")
    rows = materialize(base.join(mixed, "token"))
    needed = materialize(join_small(spreads, rows.select("id").distinct(), "id", "left_semi"))
    cells = (
        rows.join(needed.select("id", "spread"), "id")
        .withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("token", F.least("part", "_other").alias("i"), F.greatest("part", "_other").alias("j"), "part", "id", "n", "c", "spread")
    )
    return cells.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(compare, "a bigint, b bigint").distinct()


def ngram_components(docs: DataFrame, width: int = WIDTH, similarity: Fraction = SIMILARITY, orders: int = ORDERS,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    n_shingles: size of the set of distinct ``width``-word shingles; fewer words are one
    shingle; no words (or null) give an empty set, linked with nothing.  component_id: the
    smallest doc_id that links reach, itself included; null for a null id.  Rows that
    repeat have one result each; different texts under one id are compared each for itself
    and tie their components together.  An empty table gives no rows.  Other
    columns are not looked at.
    """
    counted = materialize(token_sets(docs, width, id_col, text_col))
    sets = counted.filter("chunk IS NULL").select("doc_id", "set_key", "n")
    known = sets.filter(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    classes = materialize(known.groupBy("set_key").agg(F.min("doc_id").alias("id")))
    # only the first of equal sets is joined; the ids of the others are what is copied or shuffled
    others = sets.select(F.col("doc_id").alias("id")).join(classes.select("id"), "id", "left_anti").filter("id IS NOT NULL").distinct()
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL")
    texts = texts.join(F.broadcast(others), "id", "left_anti") if fits(others) else materialize(texts.join(others, "id", "left_anti"))
    spreads = counted.filter("chunk IS NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "n", "spread")
    if not known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").isEmpty():
        return _by_rows(docs, width, similarity, orders, id_col, text_col)
    frequency = docs.sparkSession.sparkContext.broadcast(sketch(counted))  # SKETCH bytes, whatever the input
    met = materialize(first_pairs(postings(texts, width, similarity, frequency), similarity))
    blocks = met.filter("token IS NOT NULL").select("token", "id", "n")
    first = met.filter("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b"))
    tried = materialize(first.unionByName(central_pairs(blocks, similarity)).distinct())
    likely = materialize(possible(tried, spreads, similarity))
    labels = components(verified(likely, texts, width, similarity, frequency, orders))
    rest = materialize(cross_pairs(blocks, labels, spreads, similarity).join(tried, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        more = materialize(verified(rest, texts, width, similarity, frequency, orders))
        if not more.isEmpty():
            labels = components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    named = classes.join(labels, "id", "left").select("set_key", F.coalesce("component", "id").alias("_c"))
    return sets.join(named, "set_key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("_c", "doc_id")).alias("component_id"))


def _by_rows(docs: DataFrame, width: int, similarity: Fraction, orders: int, id_col: str, text_col: str) -> DataFrame:
    """The same for ids that have several texts: rows are joined by keys of their own, then ids tie them."""
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("key"), F.col(text_col).alias("text")))
    done = ngram_components(rows, width, similarity, orders, "row", "text").withColumnRenamed("doc_id", "row")
    done = materialize(done.join(rows.select("row", "key"), "row").select("key", "n_shingles", F.col("component_id").alias("group")))
    least = materialize(done.groupBy("group").agg(F.min("key").alias("least")))
    tied = materialize(done.join(least, "group").select("key", "n_shingles", "least"))
    labels = components(tied.filter(F.col("key") != F.col("least")).select(F.col("key").alias("a"), F.col("least").alias("b")).distinct())
    out = tied.join(labels, tied["key"] == labels["id"], "left")
    return out.select(F.col("key").alias("doc_id"), "n_shingles", F.when(F.col("key").isNotNull(), F.coalesce("component", "key")).alias("component_id"))


@query()
def op7_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of all ``documents`` by four-word shingles and a similarity of 0.85."""
    return ngram_components(table(spark, folder, "documents"), 4, Fraction(85, 100))
