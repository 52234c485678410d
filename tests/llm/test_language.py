import itertools
import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import QUERIES
from fieldloom.llm import language as lg

FOLDER = "/root/testdata/sf0.01"
EN = ["the", "thing", "and", "ration", "with", "housing", "they", "nothing", "of", "stone"]
FR = ["le", "les", "eau", "être", "élan", "oiseau", "chaux", "une", "que", "voir"]


def corpus():
    rng = np.random.default_rng(0)
    out = [(i, " ".join(rng.choice(EN if i % 2 else FR, 40)), "en" if i % 2 else "fr") for i in range(120)]
    return out


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    counts, transition = np.array([3, 0, 5, 1]), rng.standard_normal((3, 3))
    scores = rng.standard_normal((9, 3))
    got, at = lg.posteriors(scores, counts, transition), 0
    for n in counts:
        own, weights = scores[at : at + n], {}
        for path in itertools.product(range(3), repeat=int(n)):
            weights[path] = np.exp(sum(own[t, y] for t, y in enumerate(path)) + sum(transition[a, b] for a, b in zip(path, path[1:])))
        total = sum(weights.values())
        for t in range(n):
            want = [sum(w for p, w in weights.items() if p[t] == y) / total for y in range(3)]
            assert got[at + t] == pytest.approx(want)
        at += n


def test_code_switched_text():
    rows = corpus()
    model = lg.train([t for _, t, _ in rows], [y for *_, y in rows])
    found, counts, _ = model.word_posteriors(pa.array([" ".join(EN + FR + EN)]))
    labels = [model.languages[k] for k in found.argmax(axis=1)]
    assert counts.tolist() == [30] and labels == ["en"] * 10 + ["fr"] * 10 + ["en"] * 10
    assert model.transition[0, 0] > model.transition[0, 1] and model.transition[1, 1] > model.transition[1, 0]


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, score string, label int"
    rows = [(i, t, y, "clash", 1) for i, t, y in corpus()]
    model = lg.learn(spark.createDataFrame(rows, schema))
    odd = [(1, None, None, "", 1), (2, "", "xx", "", 1), (3, "12 %% 3", "en", "", 1), (None, "the thing and", None, "", 1), (5, "les oiseau que " * 20000, None, "", 1), (5, "les oiseau que " * 20000, None, "", 1)]
    out = sorted(((r["doc_id"] or 0, r["lang_pred"], r["score"]) for r in lg.predict(spark.createDataFrame(odd, schema), model).collect()))
    assert [(i, y) for i, y, _ in out] == [(0, "en"), (1, "und"), (2, "und"), (3, "und"), (5, "fr"), (5, "fr")]
    assert all(0 <= s <= 1 for *_, s in out)
    empty = spark.createDataFrame([], schema)
    assert lg.predict(empty, lg.learn(empty)).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_held_out_accuracy(spark):
    out = QUERIES["op5_language_id"](spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    rows = out.join(docs, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    right = sum(r["lang_pred"] == r["lang"] for r in held) / len(held)
    assert right > 0.97, right
    assert out.filter(F.col("score").between(0, 1)).count() == len(rows)


def test_expected_transitions_are_exact():
    rng = np.random.default_rng(3)
    counts, transition = np.array([4, 1, 0, 5]), rng.standard_normal((2, 2))
    scores = rng.standard_normal((10, 2))
    at, want = 0, np.zeros((2, 2))
    for n in counts:
        own, weights = scores[at : at + n], {}
        for path in itertools.product(range(2), repeat=int(n)):
            weights[path] = np.exp(sum(own[t, y] for t, y in enumerate(path)) + sum(transition[a, b] for a, b in zip(path, path[1:])))
        for path, w in weights.items():
            for a, b in zip(path, path[1:]):
                want[a, b] += w / sum(weights.values())
        at += n
    assert lg.expected_transitions(scores, counts, transition)[1] == pytest.approx(want)


def test_all_languages_are_learned(spark):
    rows = [(i, f"wort{i % 150:03d} " * 5, f"l{i % 150:03d}") for i in range(1500)]
    model = lg.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 150
