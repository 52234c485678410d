import os
import zlib

import numpy as np
import pyarrow as pa
import pytest

from fieldloom.llm import QUERIES
from fieldloom.llm import toxicity as tx

FOLDER = "/root/testdata/sf0.1"
CLEAN = ["stone", "river", "garden", "thing", "house", "élan", "nothing", "paper", "window", "letter"]


def corpus(n=900):
    rng = np.random.default_rng(2)
    out = []
    for i in range(n):
        words = list(rng.choice(CLEAN, int(rng.integers(15, 70))))
        if i % 3 == 0:
            words.insert(int(rng.integers(0, len(words))), ["vilewort", "vilegrub", "snarl"][i % 9 // 3])
        out.append((i, " ".join(words), int(i % 3 == 0)))
    return out


def test_gradients_equal_differences():
    rng = np.random.default_rng(4)
    net = tx.Network.fresh(rng)
    inputs = rng.standard_normal((9, 2 * tx.WIDTH))
    codes, counts = rng.integers(0, 9, 60), np.array([25, 3, 32])
    text, start, size = tx.windows_of(counts)
    word, held = tx.read(codes, start, size)
    pull = rng.standard_normal(len(text))

    def loss():
        return float(pull @ net.forward(*net.project(inputs), word, held))

    trace = {}
    net.forward(*net.project(inputs), word, held, trace)
    grads, to_inputs = net.backward(inputs, word, held, trace, pull)
    for values, grad in [*((net.dense[k], grads[k]) for k in tx.Network.DENSE), (inputs, to_inputs)]:
        flat, flat_grad = values.reshape(-1), np.asarray(grad).reshape(-1)
        for at in rng.choice(len(flat), min(6, len(flat)), replace=False):
            kept = flat[at]
            flat[at] = kept + 1e-5
            high = loss()
            flat[at] = kept - 1e-5
            low = loss()
            flat[at] = kept
            assert flat_grad[at] == pytest.approx((high - low) / 2e-5, rel=1e-4, abs=1e-6)


def test_windows_overlap_and_cover():
    counts = np.array([0, 1, 20, 21, 30, 31, 400, 0, 7])
    text, start, size = tx.windows_of(counts)
    base = np.cumsum(counts) - counts
    for k, n in enumerate(counts):
        own = [(s - base[k], m) for t, s, m in zip(text, start, size) if t == k]
        assert sorted({x for s, m in own for x in range(s, s + m)}) == list(range(n))
        assert all(0 < b[0] - a[0] <= tx.STEP for a, b in zip(own, own[1:]))


def test_words_in_a_row_are_read_once():
    codes, counts, words = tx.read_words(pa.array(["b b a a b", "b", None, "b b"]))
    assert [words[c] for c in codes] == ["b", "a", "b", "b", "b"] and counts.tolist() == [3, 1, 0, 1]


def test_learns_words_and_stems():
    rows = corpus()
    net = tx.train([t for _, t, _ in rows], [y for *_, y in rows])
    tail = "stone river garden thing house élan nothing paper window letter " * 30
    texts = [tail, tail + "snarl " + tail, "vilegrub house", "garden", "", None, "12 ..", "vileworm river thing", "stone " * 500]
    score = net.score(pa.array(texts))
    assert (score[[1, 2, 7]] > 0.5).all() and (score[[0, 3, 8]] < 0.5).all(), score
    assert (score[[4, 5, 6]] == 0).all()


def test_odd_rows(spark):
    rows = corpus()
    schema = "doc_id long, text string, score string, held_out int"
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t, _ in rows] + [(None, "snarl", "", 1), (1, "other text", "", 1)], schema)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (0, 0), (99999, 1)], "doc_id long, toxic int")
    net = tx.learn(docs, labels)
    long = "garden river " * 60000 + "snarl " + "stone paper " * 60000
    odd = [(1, None, "x", 1), (2, "", "x", 1), (None, long, "x", 1), (5, "snarl", "x", 1), (5, "snarl", "x", 1)]
    out = tx.predict(spark.createDataFrame(odd, schema), net)
    assert out.columns == ["doc_id", "text", "held_out", "score"]
    got = [r["score"] for r in sorted(out.collect(), key=lambda r: (r["doc_id"] or 0))]
    assert got[0] > 0.5 and got[1] == got[2] == 0 and got[3] == got[4] > 0.5
    empty = spark.createDataFrame([], schema)
    assert tx.predict(empty, net).count() == 0
    nothing = tx.learn(empty, labels)
    assert nothing == 0.0 and [r["score"] for r in tx.predict(docs, nothing).limit(2).collect()] == [0.0, 0.0]
    assert tx.learn(docs, labels.filter("toxic = 1")) == 1.0 and tx.learn(docs, labels.limit(0)) == 0.0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_held_out_scores(spark):
    out = QUERIES["op13_toxicity"](spark, FOLDER)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = out.join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    bad, good = ([r["score"] for r in held if r["toxic"] == y] for y in (1, 0))
    above = np.mean([np.mean(np.array(good) < s) for s in bad])
    assert above > 0.95, above
    assert np.mean(np.array(bad) >= 0.7) > 0.7 and np.mean(np.array(good) >= 0.7) < 0.01
