import re
from collections import defaultdict

import pytest

from fieldloom.llm import mixing


def fill(sizes, weights, cap=3):
    """Targets by repeated sharing of what is cut off."""
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in sizes if s not in capped]
        rest = total - sum(cap * sizes[s] for s in capped)
        share = rest / sum(weights[s] for s in free) if free else 0
        over = {s for s in free if share * weights[s] > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in capped else share * weights[s] for s in sizes}
        capped |= over


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, target int")


@pytest.mark.parametrize("layout", [{"a": 40, "b": 5, "c": 3, None: 2}, {"a": 9}, {"a": 1, "b": 1, "c": 200, "d": 1, "é": 30, "Z": 7}])
def test_budgets(spark, layout):
    rows, i = [], 0
    for s, n in layout.items():
        for k in range(n):
            rows.append((i, "w1, x " * (1 + (k * 7) % 11), s, "clash", 1))
            i += 1
    out = mixing.mix(docs_of(spark, rows), buckets=8).collect()
    assert len(out) == len(rows)
    sizes = defaultdict(int)
    for _, text, s, *_ in rows:
        sizes[s] += len(text.split())
    order = sorted((s for s in layout if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in layout)
    want = fill(dict(sizes), {s: 1 + k % 3 for k, s in enumerate(order)})
    taken = defaultdict(int)
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["taken"]
        epochs = int(r["target"] / r["source_size"])
        assert epochs * r["size"] <= r["taken"] <= (epochs + 1) * r["size"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_reruns_agree_and_buckets_do_not_matter(spark):
    rows = [(i, "abc " * (i % 9), "s" if i % 3 else None, "", 0) for i in range(200)]
    a = sorted(map(tuple, mixing.mix(docs_of(spark, rows), buckets=1).drop("target").collect()), key=repr)
    b = sorted(map(tuple, mixing.mix(docs_of(spark, rows[::-1]).repartition(5), buckets=64).drop("target").collect()), key=repr)
    assert a == b


def test_better_documents_come_first(spark):
    rows = [(i, ("good word " if i % 2 else "$$$$ #### ") * 4, "b", "", 0) for i in range(2000)] + [(9000 + i, "x " * 8, "a", "", 0) for i in range(2000)]
    out = [r for r in mixing.mix(docs_of(spark, rows), weights=(5, 1)).collect() if r["source"] == "b"]
    good, bad = (sum(r["taken"] for r in out if r["doc_id"] % 2 == k) for k in (1, 0))
    assert good > 2 * bad > 0


def test_odd_tables(spark):
    assert mixing.mix(docs_of(spark, [])).count() == 0
    out = mixing.mix(docs_of(spark, [(1, None, None, "", 0), (None, "", "a", "", 0), (2, " \t\n", "a", "", 0)])).collect()
    assert [r["taken"] for r in out] == [0, 0, 0] and {r["target"] for r in out} == {0.0}
    out = mixing.mix(docs_of(spark, [(1, "a b", "s", "", 0)] * 3 + [(2, "word " * 30000, "t", "", 0)])).collect()
    assert len(out) == 4 and max(r["size"] for r in out) == 30000
    assert re.fullmatch(mixing.WORD, "a b")
