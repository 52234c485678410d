import hashlib
import random

import pytest
from pyspark.sql import functions as F

from fieldloom.llm import fingerprint as fp

SCHEMA = "doc_id long, text string, next string, _range int"


def rows_of(spark, texts, **kw):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in texts], SCHEMA)
    return fp.fingerprints(docs, **kw).collect()


def edited(texts):
    order = sorted(texts, key=lambda x: (x[0] is None, -(x[0] or 0), x[1] or ""))
    out = {}
    for k, (i, t) in enumerate(order):
        t, n = t or "", (order[(k + 1) % len(order)][1] or "")
        third = len(t) // 3
        out[(i, t)] = t[: len(t) - third] + n[:third]
    return out


def jaccard(a, b):
    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 1.0


@pytest.mark.parametrize("rows_per_range", [1, 7, 20_000])
def test_edits_and_likeness(spark, rows_per_range):
    rng = random.Random(1)
    words = [f"w{i}é" for i in range(300)]
    texts = [(i * i - 50, " ".join(rng.choice(words) for _ in range(rng.choice([30, 200, 700])))) for i in range(60)]
    texts += [(None, "no id here at all"), (7_000_000, None), (7_000_001, ""), (7_000_002, "two words"), (7_000_003, texts[3][1]), (-9, "word " * 9000)]
    want, text_of = edited(texts), dict(texts)
    rows = rows_of(spark, texts, rows_per_range=rows_per_range)
    assert len(rows) == len(texts)
    prints = {}
    for r in rows:
        text = text_of[r["doc_id"]] or ""
        new = want[(r["doc_id"], text)]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and abs(r["near_edited"] - jaccard(text, new)) < 0.2
        assert len(r["fingerprint"]) == (256 if text.split() else 0)


def test_estimate_without_bias(spark):
    rng = random.Random(2)
    pairs = []
    for _ in range(40):
        base = [f"a{rng.random()}" for _ in range(80)]
        pairs.append((" ".join(base), " ".join(base[:60] + [f"b{rng.random()}" for _ in range(20)])))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(fp.likeness(fp.fingerprint(df.a), fp.fingerprint(df.b))).collect()]
    want = [jaccard(a, b) for a, b in pairs]
    assert abs(sum(got) / 40 - sum(want) / 40) < 0.04


def test_ties_and_single_rows(spark):
    assert rows_of(spark, []) == []
    one = rows_of(spark, [(1, "alone here")])[0]
    assert one["near_next"] == 1.0
    rows = rows_of(spark, [(5, "same text of five words"), (5, "same text of five words"), (5, None), (None, None)])
    assert len(rows) == 4 and len({r["fingerprint"] for r in rows}) == 2


def test_plan_is_native(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "", 1)], SCHEMA)
    plan = fp.fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Nested" not in plan


def test_numbers_of_ranges_make_a_short_plan(spark):
    docs = spark.range(-500, 3500).select((F.col("id") * F.col("id") - 7).alias("doc_id")).union(spark.createDataFrame([(None,)], "doc_id long"))
    ranged = docs.select("doc_id", fp._range_of(docs, 5).alias("r"))
    # the plan is held and rewritten on the driver, once for each stage
    assert len(ranged._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    rows = sorted((tuple(r) for r in ranged.filter("doc_id is not null").collect()), key=lambda x: x[0])
    numbers = [r for _, r in rows]
    assert numbers == sorted(numbers) and len(set(numbers)) > 128
    assert [r["r"] for r in ranged.filter("doc_id is null").collect()] == [-1]
