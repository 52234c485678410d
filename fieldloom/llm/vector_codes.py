"""Product codes of vectors, searched through a lexicographic trie of the distinct parts.

Components become integers (floor(SCALE * x)) and vectors are cut into PARTS consecutive
parts.  Each part position has a codebook of ENTRIES entries, which starts as that part of the
vectors with the smallest ids; ROUNDS rounds assign every part to the nearest entry and move
each entry to the componentwise floor of its parts' mean.

The trie.  Sorted lexicographically, the distinct parts of a position are the leaves of a trie
whose edges are components.  It is walked depth first with an explicit stack: a
node hands its children the distances of its prefix to all entries, so a shared prefix is
measured once, and children of few leaves are finished together.  In there the shared levels are made level by level,
and what a leaf shares with no neighbour (its unbranched tail) is one matrix product.  Leaves
take the first smallest entry and add their part, times its occurrences, to that entry.

On Spark.  The distinct parts and their occurrences are counted once (pre-aggregated, so a vector that is
a third of all rows is one row of it); each round a task returns sums and counts of at most
ENTRIES entries a position.  The final codes are made where the vectors are, without a shuffle, by the
same walk over the distinct parts of a run of rows.  Only codebooks (PARTS * ENTRIES entries) reach the driver.

All arithmetic is exact: integers in doubles or 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from fieldloom.llm.common import materialize, query, table, unused
from fieldloom.operators.bounds import fits

#: Factor of components, parts of a vector, entries of a codebook (at most 256: two hex digits), rounds.
SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Leaves finished together, rows a task codes at a time, largest integer component (larger ones would not fit a long error).
BLOCK, RUN_ROWS, LARGEST = 2048, 16384, 1 << 28
#: Copies of the sums of labels when there are too many labels to be copied to every task.
SALTS = 32


class Trie:
    """Distinct parts of one position in lexicographic order, as leaves of a trie over their components."""

    def __init__(self, leaves: np.ndarray):
        self.leaves = leaves
        self.size, self.depth = leaves.shape
        same = leaves[1:] == leaves[:-1]
        # components that a leaf shares with the one before it
        self.shared = np.concatenate([[0], np.where(same.all(axis=1), self.depth, same.argmin(axis=1))]) if self.size else np.zeros(0, int)
        self.shared = self.shared.astype(np.int64)

    def nearest(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each leaf's first nearest entry and the squared distance to it."""
        code, error = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        largest = max(int(np.abs(self.leaves).max(initial=0)), int(np.abs(entries).max(initial=0)))
        exact_in_double = 4 * self.depth * largest * largest < 1 << 53
        kind = np.float64 if exact_in_double else np.int64
        leaves, table_ = self.leaves.astype(kind), entries.astype(kind)
        stack = [(0, self.size, 0, np.zeros(len(entries), kind))]
        while stack:
            low, high, depth, held = stack.pop()
            if low == high:
                continue
            if high - low <= BLOCK or depth == self.depth:
                found = self._finish(leaves, table_, low, high, depth, held)
                code[low:high] = found.argmin(axis=1)
                error[low:high] = np.take_along_axis(found, code[low:high, None], axis=1)[:, 0]
                continue
            starts = low + np.concatenate([[0], 1 + np.nonzero(self.shared[low + 1 : high] <= depth)[0]])
            ends = np.append(starts[1:], high)
            first = 0
            for k in range(len(starts)):  # children of few leaves are put together, a large one stands alone
                if ends[k] - starts[k] > BLOCK:
                    if first < k:
                        stack.append((int(starts[first]), int(starts[k]), depth, held))
                    step = leaves[starts[k], depth] - table_[:, depth]
                    stack.append((int(starts[k]), int(ends[k]), depth + 1, held + step * step))
                    first = k + 1
                elif ends[k] - starts[first] > BLOCK:
                    stack.append((int(starts[first]), int(starts[k]), depth, held))
                    first = k
            if first < len(starts):
                stack.append((int(starts[first]), high, depth, held))
        return code, error

    def _finish(self, leaves: np.ndarray, table_: np.ndarray, low: int, high: int, depth: int, held: np.ndarray) -> np.ndarray:
        """Distances of the leaves low to high, whose prefix of ``depth`` components is at the distances ``held``."""
        own, count = leaves[low:high], high - low
        before = self.shared[low:high].copy()
        before[0] = depth
        after = np.append(before[1:], depth)
        branch = np.clip(np.maximum(before, after), depth, self.depth)  # as deep as a leaf shares its prefix with a neighbour
        node, dist = np.zeros(count, np.int64), held[None, :]
        out = np.empty((count, len(table_)), leaves.dtype)
        for level in range(depth, self.depth + 1):
            done = np.nonzero(branch == level)[0]
            if len(done):  # unbranched tails: |x|^2 - 2 x.c + |c|^2 over the remaining components
                tail, rest = own[done, level:], table_[:, level:]
                out[done] = dist[node[done]] + ((tail * tail).sum(axis=1)[:, None] - 2 * (tail @ rest.T) + (rest * rest).sum(axis=1)[None, :])
            deeper = np.nonzero(branch > level)[0]
            if not len(deeper):
                break
            fresh = np.concatenate([[True], (before[deeper[1:]] <= level) | (np.diff(deeper) > 1)])
            heads = deeper[fresh]
            step = own[heads, level][:, None] - table_[None, :, level]
            dist = dist[node[heads]] + step * step
            node[deeper] = np.cumsum(fresh) - 1
        return out


def sorted_parts(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in lexicographic order, and the number of each row among them."""
    if not len(parts):
        return parts, np.zeros(0, np.int64)
    order = np.lexsort(parts.T[::-1]) if parts.shape[1] else np.arange(len(parts))
    moved = parts[order]
    fresh = np.concatenate([[True], (moved[1:] != moved[:-1]).any(axis=1)])
    inverse = np.empty(len(parts), np.int64)
    inverse[order] = np.cumsum(fresh) - 1
    return moved[fresh], inverse


def cuts(size: int) -> list[int]:
    """Bounds of the parts of a vector, equal ones if its size allows."""
    return [k * size // PARTS for k in range(PARTS + 1)]


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), size)


def kept_vectors(df: DataFrame, vector_col: str, out: str) -> DataFrame:
    """The rows with a usable vector (not null, no null or non-finite component), its integers in ``out``."""
    vector = F.col(vector_col)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(SCALE * x.cast("double")).cast("long"))
    return df.filter(vector.isNotNull() & F.coalesce(finite, F.lit(False))).withColumn(out, whole)


class Codebooks:
    """Entries of each part position: ``books[p]`` is (entries, components of part p)."""

    def __init__(self, books: list[np.ndarray], size: int):
        self.books, self.size = books, size

    def digest(self) -> str:
        """SHA-256 of all components in decimal by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(str(x) for b in self.books for x in b.ravel().tolist()).encode()).hexdigest()


def part_rows(rows: DataFrame, vector: str, size: int) -> DataFrame:
    """Distinct parts (position, components) with their occurrences."""
    bounds = cuts(size)
    parts = F.array(*[F.struct(F.lit(p).alias("pos"), F.slice(vector, bounds[p] + 1, bounds[p + 1] - bounds[p]).alias("part")) for p in range(PARTS)])
    return rows.select(F.explode(parts).alias("r")).groupBy("r.pos", "r.part").agg(F.count(F.lit(1)).alias("times"))


def _round(parts: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one assignment of all distinct parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
        for batch in batches:
            pos, times = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            for p, book in enumerate(books):
                some = np.nonzero(pos == p)[0]
                if not len(some):
                    continue
                leaves, inverse = sorted_parts(_matrix(batch.column(1).take(pa.array(some)), book.shape[1]))
                often = np.zeros(len(leaves), np.int64)
                np.add.at(often, inverse, times[some])
                code, _ = Trie(leaves).nearest(book)
                np.add.at(sums[p], code, np.column_stack([leaves, np.ones(len(leaves), np.int64)]) * often[:, None])
        rows = [(p, k, row.tolist()) for p, s in enumerate(sums) for k, row in enumerate(s) if row[-1]]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["pos", "entry", "sums"])

    found = parts.mapInArrow(run, "pos int, entry int, sums array<long>")
    cells = found.select("pos", "entry", F.posexplode("sums").alias("place", "n")).groupBy("pos", "entry", "place").agg(F.sum("n").alias("n"))
    out = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
    for r in cells.collect():  # at most ENTRIES * (components + PARTS) rows
        out[r["pos"]][r["entry"], r["place"]] = r["n"]
    return [np.where(s[:, -1:] > 0, s[:, :-1] // np.maximum(s[:, -1:], 1), b) for s, b in zip(out, books, strict=True)]


def fit(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of all usable vectors; None if there is none.

    The first entries are those of the smallest ids (null last, ties by components); their first row tells
    how many components a vector has, rows of another length are left out.
    """
    first = unused(df.columns, "_whole")
    rows = kept_vectors(df.select(id_col, vector_col), vector_col, first).filter(F.size(first) > 0)
    head = rows.orderBy(F.col(id_col).asc_nulls_last(), first).select(first).limit(1).collect()
    if not head:
        return None
    size = len(head[0][0])
    rows = rows.filter(F.size(first) == size).select(id_col, first)
    most = rows.agg(F.max(F.greatest(F.array_max(first), -1 - F.array_min(first)))).first()[0]
    if most > LARGEST:
        raise ValueError(f"components up to {LARGEST // SCALE} in size are supported")
    start = np.array([r[0] for r in rows.orderBy(F.col(id_col).asc_nulls_last(), first).select(first).limit(ENTRIES).collect()], np.int64)
    bounds = cuts(size)
    books = [start[:, bounds[p] : bounds[p + 1]] for p in range(PARTS)]
    parts = materialize(part_rows(rows, first, size))
    for _ in range(rounds):
        books = _round(parts, books)
    return Codebooks(books, size)


def encode(df: DataFrame, model: Codebooks, vector_col: str = "embedding", code_out: str = "code", error_out: str = "error") -> DataFrame:
    """The rows whose vector is usable and of the codebooks' size, without it, with code and error.

    Columns named like a result are replaced, all others are kept.
    """
    whole = unused(df.columns, "_whole")
    kept = [c for c in df.columns if c not in (vector_col, code_out, error_out)]
    rows = kept_vectors(df.select(*kept, vector_col), vector_col, whole).filter(F.size(whole) == model.size).select(*kept, whole)
    books, size, bounds = model.books, model.size, cuts(model.size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for all_ in batches:
            for at in range(0, all_.num_rows, RUN_ROWS):
                batch = all_.slice(at, RUN_ROWS)
                data = _matrix(batch.column(len(kept)), size)
                code, error = np.zeros((len(data), PARTS), np.uint8), np.zeros(len(data), np.int64)
                for p, book in enumerate(books):
                    leaves, inverse = sorted_parts(data[:, bounds[p] : bounds[p + 1]])
                    near, far = Trie(leaves).nearest(book)
                    code[:, p] = near[inverse]
                    error += far[inverse]
                text = code.tobytes().hex()
                step = 2 * PARTS
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[: len(kept)], pa.array([text[i : i + step] for i in range(0, len(text), step)], pa.string()), pa.array(error)],
                    names=[*kept, code_out, error_out])

    schema = StructType([*(rows.schema[c] for c in kept), StructField(code_out, StringType()), StructField(error_out, LongType())])
    return rows.mapInArrow(run, schema)


def with_group_sum(rows: DataFrame, key: Column, value: str, out: str) -> DataFrame:
    """The rows with the sum of ``value`` over rows of an equal key, null keys together."""
    name, salt, put = unused(rows.columns, "_key"), unused(rows.columns, "_salt"), unused(rows.columns, "_sum")
    sums = rows.groupBy(key.alias(name)).agg(F.sum(value).alias(put))
    if fits(sums):
        joined = rows.join(F.broadcast(sums), key.eqNullSafe(F.col(name)))
    else:  # many keys: the rows of a hot one go to SALTS tasks
        copies = sums.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = rows.withColumn(salt + "_", F.pmod(F.xxhash64(F.col(value), F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
        joined = dealt.join(copies, key.eqNullSafe(F.col(name)) & (F.col(salt) == F.col(salt + "_")))
    return joined.select(*rows.columns, F.col(put).alias(out))


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """Usable vectors without the vector, with ``code``, ``error``, ``label_error`` and ``codebooks_sha256``.

    A vector that is null or empty, holds a null or non-finite component, or has another length than that of the
    smallest id is left out.  Equal vectors get equal codes; rows that repeat are rows of their own; null labels are one label.
    With fewer rows than ENTRIES the codebooks have as many entries as rows.  Input columns named like a result are replaced.
    """
    made = ("code", "error", "label_error", "codebooks_sha256")
    model = fit(df, id_col, vector_col, rounds)
    names = [c for c in df.columns if c not in made or c in (id_col, vector_col, label_col)]
    if model is None:
        model = Codebooks([np.zeros((1, 0), np.int64)] * PARTS, -1)
    rows = materialize(encode(df.select(*names), model, vector_col))
    out = with_group_sum(rows, F.col(label_col), "error", "label_error")
    return out.withColumn("codebooks_sha256", F.lit(model.digest()))


def _sql() -> str:
    """The rounds one after the other; parts, entries and distances as rows."""
    steps = [
        f"kept as materialized (select vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v from embeddings "
        "where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0)",
        "parts as materialized (select vec_id, pos, v[pos * len(v) // 4 + 1:(pos + 1) * len(v) // 4] as part from kept, (select unnest(range(4)) as pos))",
        f"b0 as materialized (select pos, entry, part as c from parts join (select vec_id, row_number() over (order by vec_id) - 1 as entry from kept qualify entry < {ENTRIES}) using (vec_id))",
    ]
    for k in range(ROUNDS + 1):
        steps.append(
            f"a{k} as materialized (select vec_id, pos, min_by(entry, d * {ENTRIES} + entry) as entry, min(d) as d from (select vec_id, p.pos, entry, "
            f"list_sum(list_transform(list_zip(part, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from parts p join b{k} b on p.pos = b.pos) group by all)"
        )
        if k < ROUNDS:
            steps.append(
                f"m{k} as materialized (select pos, entry, list(m order by i) as c from (select pos, entry, i, floor(sum(x)::bigint / count(*))::bigint as m from "
                f"(select pos, entry, unnest(part) as x, unnest(range(len(part))) as i from parts join a{k} using (vec_id, pos)) group by all) group by all)"
            )
            steps.append(f"b{k + 1} as materialized (select pos, entry, coalesce(m.c, b.c) as c from b{k} b left join m{k} m using (pos, entry))")
    steps.append(f"coded as (select vec_id, string_agg(printf('%02x', entry::int), '' order by pos) as code, sum(d)::bigint as error from a{ROUNDS} group by 1)")
    return (
        "with " + ",\n".join(steps) + "\nselect vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, "
        f"(select sha256(string_agg(array_to_string(c, ','), ',' order by pos, entry)) from b{ROUNDS}) as codebooks_sha256 from coded join kept using (vec_id)"
    )


@query(_sql())
def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Codes of all ``embeddings``."""
    return compress(table(spark, folder, "embeddings").select("vec_id", "embedding", "label")).drop("label")
