import hashlib
import random

import pytest

from fieldloom.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
PATH = bpe.default_vocabulary()
TEXTS = [None, "", " ", "  \n\n x  y \n", "a<|endoftext|>b <|endoftext|>", "it's 'RE we'll don''t", "ñandú Straße 東京 😀  x", "x" * 500, "a b" * 5000,
         "\t\tcode(  x )\r\n" * 30, "é" * 777, "ab1!" * 900 + " z", "q" * 40000 + " " + "xy" * 30000]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.mark.parametrize("leaf", [1 << 14, 300, 64])
def test_ids_equal_the_library(spark, library, leaf):
    docs = spark.createDataFrame([(i, t, "clash", 3) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "again", 1)], "doc_id long, text string, ids string, part int")
    rows = bpe.decode(bpe.encode(docs, PATH, leaf=leaf), PATH).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        want = library.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == want
        assert r["decoded"] == library.decode(want, skip_special_tokens=False) == (TEXTS[r["doc_id"]] or "")


def test_joined_halves_are_exact():
    own, rng = bpe.codec(PATH), random.Random(5)
    how = {"size": lambda t: int(own.length[t]), "data": lambda t: own.bytes[own.start[t] : own.start[t] + own.length[t]].tobytes(), "encode": own.encode_bytes}
    for _ in range(300):
        raw = "".join(rng.choice(["the", "in", "ation", "q", "zz", "é", "ß", "aaaa", "東"]) for _ in range(rng.randint(2, 120))).encode()
        leaf = rng.randint(1, 40)
        parts = [own.encode_bytes(raw[i : i + leaf]) for i in range(0, len(raw), leaf)]
        assert bpe.join_tree(parts, window=rng.choice([1, 4, 64]), **how) == own.encode_bytes(raw)


def test_letters_of_all_scripts(library):
    own = bpe.codec(PATH)
    for first in range(0, 0x20000, 128):
        text = "".join(f"a{chr(c)}1 {chr(c)}" for c in range(first, first + 128) if not 0xD800 <= c < 0xE000)
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_digests_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "hello there")], "doc_id long, text string")
    row = bpe.round_trip(docs, PATH).first()
    assert row["decoded_sha256"] == hashlib.sha256(b"hello there").hexdigest()
    assert row["ids_sha256"] == bpe.digest(bpe.codec(PATH).encode("hello there").tolist())
    assert bpe.round_trip(docs.filter("false"), PATH).count() == 0


def test_no_ids_decode_to_nothing(spark):
    frame = spark.createDataFrame([(1, None), (2, []), (3, [50256, 255])], "k long, ids array<int>")
    out = {r["k"]: r["decoded"] for r in bpe.decode(frame, PATH).collect()}
    assert out[1] is None and out[2] == "" and out[3].startswith("<|endoftext|>")
