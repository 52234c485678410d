"""Importance resampling towards a target distribution over hashed word n-grams.

Documents are drawn in proportion to how much likelier their runs of one to three words are
among the target's texts than among all documents.  Both sides are counted in BUCKETS
buckets; a bucket's gain is the logarithm of the smoothed ratio, a document's weight the sum
of the gains of its runs, and noise of Gumbel's distribution turns the largest weights into
a sample without replacement.

Segments.  A newline separates words, so a text is its lines: the runs inside a line
depend on that line alone.  Equal lines of the whole corpus are brought together first,
each distinct line is cut into runs once and its counts are multiplied by its occurrences;
the runs that cross line ends are counted by themselves, from the documents.  For the
weights the same split is made in each run of rows, and a line's gain is added as often as
the line occurs.

Digests.  A run's crc32 is put together from those of its words: the crc32 of a
concatenation is that of its first part, moved on by the length of the second, xor that of
the second, and moving on is linear, so a few table reads do it for all runs at once.

Memory: BUCKETS numbers a task and on the driver, and a few MB of text at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from fieldloom.llm.common import materialize, query, slices, table, unused

#: Buckets of runs, words of the longest run, words a drawn document has at least, share drawn in percent, seed of the noise.
BUCKETS, WIDTH, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: What is no digit, a-z or beyond ASCII ends a word, once A-Z is lower-cased.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of text that a task holds as words at a time.
RUN_BYTES = 2 << 20
POLYNOMIAL, NEAR = 0xEDB88320, 64


def _moved(values: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """crc32 values moved on by as many bytes as the tables stand for."""
    out = tables[0][values & np.uint32(255)]
    for k in range(1, 4):
        out = out ^ tables[k][(values >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _move_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables (4, 256) for 0 to NEAR - 1 zero bytes, and for NEAR, 2 NEAR, 4 NEAR ... zero bytes."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), one >> np.uint32(1)).astype(np.uint32)
    now = np.arange(256, dtype=np.uint32)[None, :] << (np.uint32(8) * np.arange(4, dtype=np.uint32))[:, None]
    near = []
    for _ in range(NEAR):
        near.append(now)
        now = (now >> np.uint32(8)) ^ one[now & np.uint32(255)]
    far = [now]
    while len(far) < 26:  # texts are shorter than 2^31 bytes
        far.append(_moved(far[-1], far[-1]))
    return np.stack(near), far


MOVE_NEAR, MOVE_FAR = _move_tables()


def joined_crc(first: np.ndarray, second: np.ndarray, second_size: np.ndarray) -> np.ndarray:
    """crc32 of concatenations, from those of the two parts and the size of the second."""
    low, out = second_size % NEAR, np.zeros(len(first), np.uint32)
    for k in range(4):
        out ^= MOVE_NEAR[low, k, (first >> np.uint32(8 * k)) & np.uint32(255)]
    high = second_size // NEAR
    for bit, tables in enumerate(MOVE_FAR):
        if not high.any():
            break
        some = np.nonzero(high & 1)[0]
        out[some] = _moved(out[some], tables)
        high = high >> 1
    return out ^ second


@dataclass
class Lines:
    """Distinct lines cut into words.  ``word``: word numbers line after line, ``counts`` of them per line."""

    word: np.ndarray
    counts: np.ndarray
    crc: np.ndarray
    crc_open: np.ndarray
    size: np.ndarray

    def buckets(self, place: np.ndarray, following: list[np.ndarray]) -> np.ndarray:
        """Buckets of the runs of the words ``place``, each followed by ``following``."""
        value, opened = self.crc[place], self.crc_open[place]
        for k, word in enumerate(following):
            if k:
                opened = joined_crc(value, np.full(len(value), zlib.crc32(b" "), np.uint32), np.ones(len(value), np.int64))
            value = joined_crc(opened, self.crc[word], self.size[word])
        return (value % np.uint32(BUCKETS)).astype(np.int64)

    def inner_runs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(line, bucket) of all runs inside the lines, by length of the run."""
        line = np.repeat(np.arange(len(self.counts)), self.counts)
        for n in range(WIDTH):
            at = np.arange(max(0, len(line) - n))
            at = at[line[at] == line[at + n]] if n else at
            yield line[at], self.buckets(self.word[at], [self.word[at + k] for k in range(1, n + 1)])


def cut_lines(lines: pa.Array) -> Lines:
    clean = pc.replace_substring_regex(pc.ascii_lower(lines), NO_WORD, " ")
    lists = pc.split_pattern(pc.utf8_trim(clean, " "), " ")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.dictionary_encode(lists.flatten())
    words = [w.encode() for w in coded.dictionary.to_pylist()]
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if b"" in words:  # a line without words
        keep = codes != words.index(b"")
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[keep], minlength=len(counts)).astype(np.int64)
        codes = codes[keep]
    return Lines(
        codes, counts,
        np.fromiter(map(zlib.crc32, words), np.uint32, len(words)),
        np.fromiter((zlib.crc32(w + b" ") for w in words), np.uint32, len(words)),
        np.fromiter(map(len, words), np.int64, len(words)),
    )


@dataclass
class Texts:
    """Texts as runs of their distinct lines: line numbers text after text, ``counts`` of them per text."""

    lines: Lines
    line: np.ndarray
    counts: np.ndarray

    def crossing_runs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text, bucket) of all runs that cross at least one line end, by length of the run."""
        sizes = self.lines.counts[self.line]
        first = np.cumsum(self.lines.counts) - self.lines.counts
        start = np.cumsum(sizes) - sizes
        text = np.repeat(np.arange(len(self.counts)), self.counts)
        line = np.repeat(np.arange(len(self.line)), sizes)
        word = self.lines.word[np.arange(len(line)) + np.repeat(first[self.line] - start, sizes)]
        row = text[line] if len(line) else line
        for n in range(1, WIDTH):
            at = np.arange(max(0, len(line) - n))
            at = at[(line[at] != line[at + n]) & (row[at] == row[at + n])]
            yield row[at], self.lines.buckets(word[at], [word[at + k] for k in range(1, n + 1)])

    def words(self) -> np.ndarray:
        """Words of each text."""
        text = np.repeat(np.arange(len(self.counts)), self.counts)
        return np.bincount(text, weights=self.lines.counts[self.line], minlength=len(self.counts)).astype(np.int64)

    def weights(self, gains: np.ndarray) -> np.ndarray:
        """Sum of the gains of each text's runs: each distinct line's sum is made once."""
        text, out = np.repeat(np.arange(len(self.counts)), self.counts), np.zeros(len(self.counts), np.int64)
        own = np.zeros(len(self.lines.counts), np.int64)
        for line, bucket in self.lines.inner_runs():
            np.add.at(own, line, gains[bucket])
        np.add.at(out, text, own[self.line])
        for row, bucket in self.crossing_runs():
            np.add.at(out, row, gains[bucket])
        return out


def cut_texts(texts: pa.Array) -> Texts:
    lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    coded = pc.dictionary_encode(lists.flatten())
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return Texts(cut_lines(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts)


def _counter(count: Callable[[pa.RecordBatch, np.ndarray], None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's counts of all buckets, handed on once at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BUCKETS, np.int64)
        for whole in batches:
            for batch in slices(whole, whole.schema.names[0], RUN_BYTES):
                count(batch, held)
        some = np.nonzero(held)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(held[some], pa.int64())], names=["bucket", "n"])

    return run


def _count_lines(batch: pa.RecordBatch, held: np.ndarray) -> None:
    times = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
    for line, bucket in cut_lines(batch.column(0)).inner_runs():
        np.add.at(held, bucket, times[line])


def _count_crossings(batch: pa.RecordBatch, held: np.ndarray) -> None:
    for _, bucket in cut_texts(batch.column(0)).crossing_runs():
        held += np.bincount(bucket, minlength=BUCKETS)


def bucket_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Runs of all texts in each bucket."""
    texts = docs.select(F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    lines = texts.select(F.explode(F.split("text", "\n")).alias("line")).filter(F.col("line").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"))
    distinct = lines.groupBy("line").agg(F.count(F.lit(1)).alias("times"))
    inner = distinct.mapInArrow(_counter(_count_lines), "bucket long, n long")
    crossing = texts.mapInArrow(_counter(_count_crossings), "bucket long, n long")
    rows = inner.unionByName(crossing).groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most BUCKETS rows
    out = np.zeros(BUCKETS, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed ratio of the target's share to the source's) of each bucket."""
    s, t = source.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * float(source.sum() + BUCKETS) / ((s + 1) * float(target.sum() + BUCKETS)))).astype(np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, text_col: str = "text", words_out: str = "n_words", features_out: str = "n_features", weight_out: str = "weight") -> DataFrame:
    """The rows without their text, with the words, runs and weight of the text; columns of these names are replaced."""
    made = (words_out, features_out, weight_out)
    base = docs.select(*[c for c in docs.columns if c not in made or c == text_col])
    kept = [c for c in base.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col, RUN_BYTES):
                texts = cut_texts(batch.column(text_col))
                words = texts.words()
                runs = sum(np.maximum(words - n, 0) for n in range(WIDTH))
                new = [pa.array(x, pa.int64()) for x in (words, runs, texts.weights(gains))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], names=[*kept, *made])

    schema = StructType([*(base.schema[c] for c in kept), *(StructField(c, LongType()) for c in made)])
    return base.mapInArrow(run, schema)


def numbered(rows: DataFrame, order: list) -> DataFrame:
    """The rows with their place (from 1) in a global order, in a new last column ``_place``.

    Ranges are sorted where they are and written with their places inside; only the sizes of the ranges meet.
    """
    at = unused(rows.columns, "_at")
    done = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    part = F.shiftrightunsigned(F.col(at), 33)
    sizes = sorted((r["part"], r["n"]) for r in done.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # one row a range
    before, starts = 0, []
    for p, n in sizes:
        starts.append((p, before))
        before += n
    first = rows.sparkSession.createDataFrame(starts, "_part long, _first long")
    out = done.join(F.broadcast(first), part == F.col("_part"))
    return out.select(*rows.columns, (F.col("_first") + F.col(at).bitwiseAND((1 << 33) - 1) + 1).alias("_place"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """All documents without their texts, with ``n_features``, ``weight``, ``score`` and ``rank`` (null: not drawn).

    ``percent`` of the documents with ``least_words`` words are drawn by score, ties by id.  A null text has no
    words and weight 0.  A null id has the digest of the bare seed and comes after all others in a tie.  Rows that
    repeat are rows of their own, equal ones stand next to each other in any order.  Input columns named like a
    result are replaced, all others are kept.  An empty table gives no rows; an empty target changes gains only.
    """
    made = ["n_features", "weight", "score", "rank"]
    words = unused([*docs.columns, *made, "_place"], "_words")
    gains = bucket_gains(bucket_counts(docs, text_col), bucket_counts(target, text_col))
    rows = weigh(docs.select(*[c for c in docs.columns if c not in made or c in (id_col, text_col)]), gains, text_col, words)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    draw = (F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296
    rows = materialize(rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(draw))).cast("long")))
    able = F.col(words) >= least_words
    drawn = rows.filter(able).count() * percent // 100
    # equal rows are dealt to several ranges by a digest of their place in the written table
    spread = unused([*rows.columns, "_place"], "_spread")
    some = rows.filter(able).withColumn(spread, F.xxhash64(F.monotonically_increasing_id()))
    order = [F.col("score").desc(), F.col(id_col).asc_nulls_last(), F.col(spread)]
    ranked = numbered(some, order).withColumn("rank", F.when(F.col("_place") <= drawn, F.col("_place")))
    kept = [c for c in rows.columns if c != words]
    return ranked.select(*kept, "rank").unionByName(rows.filter(~able).select(*kept, F.lit(None).cast("long").alias("rank")))


_WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query(f"""
with codes as (
  select list(list_reduce(list_prepend(b, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by b) as t
  from (select unnest(range(256)) as b)
), words as (
  select 's' as side, doc_id as id, {_WORDS_SQL} as w from documents
  union all select 't', item_id, {_WORDS_SQL} from benchmark
), runs as (
  select side, id, unnest(list_concat(w, list_concat(
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) as f
  from words
), digests as (
  select f, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda h: ('0x' || h)::bigint)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 10000 as bucket
  from (select distinct f from runs), codes
), placed as (select side, id, bucket from runs join digests using (f)),
counts as (
  select b.bucket, coalesce(s, 0) as s, coalesce(t, 0) as t
  from (select unnest(range(10000)) as bucket) b
  left join (select bucket, count(*) filter (side = 's') as s, count(*) filter (side = 't') as t from placed group by 1) using (bucket)
), gains as (
  select bucket, floor(1000 * ln((t + 1)::double * ((sum(s) over ()) + 10000)::double / ((s + 1)::double * ((sum(t) over ()) + 10000)::double)))::bigint as gain from counts
), weights as (select id, sum(gain)::bigint as weight from placed join gains using (bucket) where side = 's' group by 1),
scored as (
  select id as doc_id, len(w) as n, greatest(len(w), 0) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || id), 1, 8))::bigint + 0.5) / 4294967296)))::bigint as score
  from words left join weights using (id) where side = 's'
), drawn as (
  select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as n from scored where n >= 20
)
select s.doc_id, n_features::bigint as n_features, weight, score, case when place <= floor(5 * d.n / 100) then place end as rank
from scored s left join drawn d using (doc_id)
""")
def op11_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """5 % of ``documents`` towards ``benchmark``, with every document's weight and score."""
    docs, target = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark").select("text")
    return resample(docs, target)
