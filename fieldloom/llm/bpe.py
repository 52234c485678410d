"""Byte-level BPE: encode and decode whole texts.

A text of one leaf is encoded in one go.  A longer text is cut at pre-token borders,
where encoding never looks across, into leaves that become rows of their own and
are encoded by different tasks.  A pre-token that is itself longer than a leaf
(unsplit text) is cut anywhere; its halves are then joined as a tree: around each
join a window is encoded again, and grows until its first token is a token of the
left half and its last token one of the right half.  In BPE a sequence of tokens
is the encoding of its bytes exactly when every pair of neighbours is the
encoding of theirs; each pair of the joined sequence stands in the left half, in
the window or in the right half, so the join is exact.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from fieldloom.llm.common import materialize, query, slices, table

#: Fixed value: pre-tokens of the byte-level scheme.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters (of unsplit text: bytes) of a leaf, bytes of the first window on each side.
LEAF, WINDOW = 1 << 14, 64


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        vocab = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            if spec["model"]["vocab"][left + right] != 256 + rank:
                raise ValueError("ids must follow the order of the merges")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pattern = "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))
        self.at_special = regex.compile(f"({pattern})") if pattern else None
        self.pre_token = regex.compile(PRE_TOKEN)
        self.core = tiktoken.Encoding("own", pat_str=PRE_TOKEN, mergeable_ranks=vocab, special_tokens={})
        pieces = {i: b for b, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        table_ = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        self.length = np.array([len(b) for b in table_], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(table_), dtype=np.uint8)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, special tokens written in it included."""
        if self.at_special is None or not any(s in text for s in self.special):
            return self.core.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
        parts = [
            np.array([self.special[p]], np.int32) if p in self.special else self.core.encode_to_numpy(p, disallowed_special=()).astype(np.int32)
            for p in self.at_special.split(text) if p
        ]
        return np.concatenate(parts) if parts else np.empty(0, np.int32)

    def encode_bytes(self, piece: bytes) -> list[int]:
        """Ids of one unsplit pre-token or a part of one."""
        return self.core._encode_single_piece(piece)

    def decode_bytes(self, ids: np.ndarray, most: int = 1 << 18) -> bytes:
        """Bytes of the ids, some at a time because each byte needs a place in memory while it is gathered."""
        parts = []
        for i in range(0, len(ids), most):
            some = ids[i : i + most]
            lengths = self.length[some]
            ends = np.cumsum(lengths)
            parts.append(self.bytes[np.arange(ends[-1]) + np.repeat(self.start[some] - (ends - lengths), lengths)].tobytes())
        return b"".join(parts)

    def texts(self, column: pa.Array) -> pa.Array:
        """The text of each list of ids."""
        ids = column.flatten().to_numpy(zero_copy_only=False)
        counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        data = self.decode_bytes(ids)
        ends = np.concatenate([[0], np.cumsum(self.length[ids])])[np.cumsum(counts, dtype=np.int64)].tolist()
        valid = pc.is_valid(column).to_pylist()
        return pa.array([data[a:b].decode("utf-8", errors="replace") if ok else None for a, b, ok in zip([0, *ends], ends, valid)], pa.string())

    def leaves(self, text: str, leaf: int) -> Iterator[tuple[int, str | None, bytes]]:
        """(run, text to encode, bytes of an unsplit piece) in order; pieces of one run are joined later."""
        run = 0
        for part in self.at_special.split(text) if self.at_special else [text]:
            if part in self.special:
                run += 1
                yield run, part, b""
                continue
            start = end = 0
            for m in self.pre_token.finditer(part):
                if m.end() - m.start() > leaf:
                    if end > start:
                        run += 1
                        yield run, part[start:end], b""
                    run += 1
                    raw = m.group().encode()
                    for i in range(0, len(raw), leaf):
                        yield run, None, raw[i : i + leaf]
                    start = m.end()
                elif m.end() - start > leaf:
                    run += 1
                    yield run, part[start : m.start()], b""
                    start = m.start()
                end = m.end()
            if end > start:
                run += 1
                yield run, part[start:end], b""


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def join_halves(left: list[int], right: list[int], size: Callable[[int], int], data: Callable[[int], bytes], encode: Callable[[bytes], list[int]], window: int = WINDOW) -> list[int]:
    """The encoding of two neighbouring byte strings from their own encodings.

    The window takes whole tokens on both sides of the join and grows until both
    sides agree; at its largest it is all of both.
    """
    while True:
        i, held = len(left), 0
        while i and held < window:
            i -= 1
            held += size(left[i])
        j, held = 0, 0
        while j < len(right) and held < window:
            held += size(right[j])
            j += 1
        again = encode(b"".join(map(data, left[i:])) + b"".join(map(data, right[:j])))
        starts_alike = i == 0 or again[0] == left[i]
        ends_alike = j == len(right) or again[-1] == right[j - 1]
        overlap = len(again) < 2 and not (i == 0 and j == len(right))
        if starts_alike and ends_alike and not overlap:
            return left[:i] + again + right[j:]
        window *= 2


def join_tree(parts: list[list[int]], **how) -> list[int]:
    """Halves joined pairwise, level by level."""
    while len(parts) > 1:
        parts = [join_halves(*parts[i : i + 2], **how) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else []


def _lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), type=pa.int32()))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF, decoded: bool = False) -> DataFrame:
    """(id, ids array<int>) of every whole text, as the tokenizers library encodes it without added tokens.

    ``decoded``: also the text that its ids decode to, from the same pass.

    A null text is the empty text and has no ids.  Rows that repeat are encoded each for
    itself.  Other columns are not looked at.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def whole_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for whole in batches:
            for batch in slices(whole, "text"):
                lists = _lists([own.encode(t or "") for t in batch.column("text").to_pylist()])
                back = own.texts(lists) if decoded else pa.nulls(batch.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("id"), lists, back], names=["id", "ids", "decoded"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for whole in batches:
            for batch in slices(whole, "text"):
                keys, run, text, raw = [], [], [], []
                for i, key, value in zip(batch.column("_row").to_pylist(), batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    for k, (r, t, b) in enumerate(own.leaves(value, leaf)):
                        keys.append((i, key, k)), run.append(r), text.append(t), raw.append(b)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], batch.schema.field("id").type), pa.array([k[2] for k in keys], pa.int32()), pa.array(run, pa.int32()), pa.array(text, pa.string()), pa.array(raw, pa.binary())],
                    names=["_row", "id", "part", "run", "text", "raw"],
                )

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            ids = [own.encode(t) if t is not None else np.array(own.encode_bytes(b), np.int32) for t, b in zip(batch.column("text").to_pylist(), batch.column("raw").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("_row", "id", "part", "run")] + [_lists(ids)], names=["_row", "id", "part", "run", "ids"])

    def joined(rows):
        import pandas as pd

        own = codec(path)
        how = {"size": lambda t: int(own.length[t]), "data": lambda t: own.bytes[own.start[t] : own.start[t] + own.length[t]].tobytes(), "encode": own.encode_bytes}
        out: list[int] = []
        for _, run in rows.sort_values("part").groupby("run", sort=True):
            out += join_tree([list(map(int, x)) for x in run["ids"]], **how)
        return pd.DataFrame({"id": rows["id"].iloc[:1], "ids": [out], "decoded": own.texts(_lists([np.array(out, np.int32)])).to_pylist()})

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    is_long = F.coalesce(F.length("text") > leaf, F.lit(False))
    short = base.filter(~is_long).mapInArrow(whole_ones, f"id {id_type}, ids array<int>, decoded string")
    # each leaf of a longer text is a row of its own, so one text is encoded by many tasks
    long_ = base.filter(is_long).withColumn("_row", F.monotonically_increasing_id())
    leaves = materialize(long_.mapInArrow(cut, f"_row bigint, id {id_type}, part int, run int, text string, raw binary"))
    encoded = leaves.repartition("_row", "part").mapInArrow(second, f"_row bigint, id {id_type}, part int, run int, ids array<int>")
    joined_ones = encoded.groupBy("_row").applyInPandas(joined, f"id {id_type}, ids array<int>, decoded string")
    return short.unionByName(joined_ones).select(F.col("id").alias(id_col), "ids", *(["decoded"] if decoded else []))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The frame with the text of its ids; bytes that are no UTF-8 become U+FFFD; null ids give null."""
    schema = StructType([*encoded.schema.fields, StructField(out_col, StringType())])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, own.texts(batch.column(ids_col))], names=[*batch.schema.names, out_col])

    return encoded.mapInArrow(texts, schema)


def digest(ids: list[int]) -> str:
    """Digest of ids as the query gives it; for tests."""
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    done = encode(docs, path, decoded=True)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query()
def op2_bpe_encoding(spark: SparkSession, folder: str) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded."""
    return round_trip(table(spark, folder, "documents"), default_vocabulary())
