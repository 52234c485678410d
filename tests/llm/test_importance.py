import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from fieldloom.llm import importance as im


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def runs_of(text):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def counts_of(texts):
    out = np.zeros(10000, np.int64)
    for t in texts:
        for b in runs_of(t):
            out[b] += 1
    return out


def brute(rows, target):
    s, t = counts_of(x for _, x in rows), counts_of(target)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + 10000) / ((s[b] + 1) * (t.sum() + 10000)))) for b in range(10000)]
    out = []
    for i, x in rows:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in runs_of(x))
        out.append([i, len(runs_of(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(x))])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {}
    for place, r in enumerate(able[: 5 * len(able) // 100]):
        rank.setdefault(tuple(r[:4]), []).append(place + 1)
    return out, rank


def corpus():
    rng = np.random.default_rng(3)
    stock = ["the", "Stone", "élan", "x9", "日本", "of", "and", "ration", "ÀB", "q"]
    rows = []
    for i in range(120):
        lines = [" ".join(rng.choice(stock, int(rng.integers(0, 7)))) for _ in range(int(rng.integers(1, 12)))]
        rows.append((i, "\n".join(lines)))
    odd = [(200, None), (201, ""), (202, "\n\n \n"), (203, "one"), (204, "one\ntwo"), (205, "a\nb\nc\nd"), (206, "\r\nA-b\tC_d\x00e\x7ff\n"), (207, "w" * 5000 + "\n" + "é" * 700)]
    long = (300, "\n".join(" ".join(rng.choice(stock, 9)) for _ in range(6000)))
    return rows + odd + [long, rows[5], rows[5], (None, rows[6][1]), (None, rows[6][1]), (5, "the stone of ration " * 8)], ["the stone of\nthe ration", None, "", "x9 日本 élan"]


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 200, 70000])
def test_joined_crc(size):
    first, second = b"some words ", bytes(range(256)) * (size // 256 + 1)
    second = second[:size]
    got = im.joined_crc(np.array([zlib.crc32(first)], np.uint32), np.array([zlib.crc32(second)], np.uint32), np.array([size]))
    assert got.tolist() == [zlib.crc32(first + second)]


def test_equals_brute_force(spark):
    rows, target = corpus()
    docs = spark.createDataFrame([(i, x, "user", j, 1.5) for j, (i, x) in enumerate(rows)], "doc_id long, text string, score string, _words int, _at double")
    out = im.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"))
    assert out.columns == ["doc_id", "_words", "_at", "n_features", "weight", "score", "rank"]
    got = out.collect()
    want, rank = brute(rows, target)
    assert sorted(map(repr, ([r["_words"], r["doc_id"], r["n_features"], r["weight"], r["score"], r["_at"]] for r in got))) == sorted(
        map(repr, ([j, *r[:4], 1.5] for j, r in enumerate(want))))
    found = {}
    for r in sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"]):
        found.setdefault((r["doc_id"], r["n_features"], r["weight"], r["score"]), []).append(r["rank"])
    assert found == rank


def test_ties_of_score_go_by_id(spark):
    text = "the stone of ration " * 8
    rows = [(7, text)] * 40 + [(None, text)] * 20
    got = im.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("the",)], "text string"), percent=50).collect()
    want, rank = brute(rows, ["the"])
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 31))
    first = max((7, None), key=lambda i: next(r[3] for r in want if r[0] == i))
    assert {r["doc_id"] for r in got if r["rank"] == 1} == {first}


def test_empty_tables(spark):
    schema = "doc_id string, text string, more int"
    empty, docs = spark.createDataFrame([], schema), spark.createDataFrame([("a", "the stone " * 30, 1)], schema)
    assert im.resample(empty, docs).collect() == []
    (row,) = im.resample(docs, empty, percent=100).collect()
    assert (row["rank"], row["more"], row["n_features"]) == (1, 1, 177)


def test_repeated_corpus_multiplies_counts(spark):
    """Counts come from distinct lines with their occurrences: a repeated corpus is the same table of lines."""
    rows, _ = corpus()
    docs = spark.createDataFrame(rows * 3, "doc_id long, text string")
    assert (im.bucket_counts(docs) == 3 * counts_of(x for _, x in rows)).all()
