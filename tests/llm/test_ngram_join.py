import random
import re
from fractions import Fraction

import pytest

from fieldloom.llm import components as comp
from fieldloom.llm import ngram_join as nj
from fieldloom.llm.common import WORD

SCHEMA = "doc_id long, text string, id int, n string"


def shingles(text, width):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(WORD, low)
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width, t):
    sets = [shingles(text, width) for _, text in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and len(x & y) * t.denominator >= len(x | y) * t.numerator:
                up[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), key), key)
    return sorted((key, len(sets[i]), least[root(i)]) for i, (key, _) in enumerate(rows))


def corpus(rng, docs, words=400):
    vocabulary = [f"v{i}" for i in range(words)]
    passage = [f"p{i}" for i in range(30)]
    out = []
    for _ in range(docs):
        kind = rng.random()
        if out and kind < 0.5:
            body = list(rng.choice(out[-40:]))
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                body[rng.randrange(len(body))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                body = body[: len(body) - rng.randint(0, 6)] or body
        else:
            body = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 4, 20, 60, 150]))]
            if rng.random() < 0.5:
                body += passage
        out.append(body)
    return [" ".join(w.upper() if rng.random() < 0.05 else w for w in b) for b in out]


@pytest.mark.parametrize(("seed", "width", "t"), [(1, 4, Fraction(85, 100)), (2, 5, Fraction(4, 5)), (3, 2, Fraction(1, 2))])
def test_equals_brute_force(spark, seed, width, t):
    rng = random.Random(seed)
    rows = [(rng.randrange(10**9), x) for x in corpus(rng, 400)] + [(-1, None), (-2, ""), (-3, " \t"), (-4, "x y"), (-5, "X  y")]
    docs = spark.createDataFrame([(i, t_, 1, "clash") for i, t_ in rows], SCHEMA)
    got = sorted(tuple(r) for r in nj.ngram_components(docs, width, t).collect())
    assert got == brute(rows, width, t)


def test_small_blocks_too(spark, monkeypatch):
    monkeypatch.setattr(nj, "LED", 3)
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(base[:k % 60] + [f"e{k}"] + base[k % 60 + 1 :])) for k in range(120)] + [(500 + k, " ".join(base[: 30 + k % 25] + [f"q{k}{i}" for i in range(12)])) for k in range(60)]
    docs = spark.createDataFrame([(i, t_, 1, "") for i, t_ in rows], SCHEMA)
    assert sorted(tuple(r) for r in nj.ngram_components(docs, 4, Fraction(85, 100)).collect()) == brute(rows, 4, Fraction(85, 100))


def test_blocks_in_several_parts(spark, monkeypatch):
    monkeypatch.setattr(nj, "TILE", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    rng = random.Random(6)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for k in range(150):
        body = list(base)
        for _ in range(rng.randint(1, 6)):
            body[rng.randrange(len(body))] = f"e{rng.randrange(9)}"
        rows.append((k, " ".join(body)))
    docs = spark.createDataFrame([(i, t_, 1, "") for i, t_ in rows], SCHEMA)
    try:
        assert sorted(tuple(r) for r in nj.ngram_components(docs, 4, Fraction(85, 100)).collect()) == brute(rows, 4, Fraction(85, 100))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_odd_tables(spark):
    assert nj.ngram_components(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c d e f", 1, ""), (3, "a b c d e f", 1, ""), (3, "a b c d e f", 1, ""), (2, "a B c d e f", 1, ""), (9, "long " * 30000 + "end", 1, "")]
    out = sorted((r["doc_id"] or -1, r["component_id"]) for r in nj.ngram_components(spark.createDataFrame(rows, SCHEMA)).collect())
    assert out == [(-1, None), (2, 2), (3, 2), (3, 2), (9, 9)]


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(100, 180)] + [(7, x) for x in range(1000, 1200)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(5, 5)]
    up = {x: x for e in links for x in e}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r["id"]: r["component"] for r in comp.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(i, i) == root(i) for i in up)


def test_texts_under_one_id_are_compared_each_for_itself(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = a.replace("a59", "other")
    rows = [(5, a), (5, b), (7, a), (9, near), (11, c), (None, b), (13, None)]
    out = nj.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in out) == [(0, 0), (5, 5), (5, 5), (7, 5), (9, 5), (11, 11), (13, 13)]
