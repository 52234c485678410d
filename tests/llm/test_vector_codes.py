import hashlib
import math

import numpy as np
import pytest

from fieldloom.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int, code int, _whole string"


def brute(rows, rounds=4):
    """(id, label, vector) -> (id, label, code, error, label error), digest; plain loops over plain numbers."""
    kept = [(i, y, [math.floor(1024 * x) for x in v]) for i, v, y in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])]
    size = len(kept[0][2])
    cut = [k * size // 4 for k in range(5)]
    books = [[v[cut[p] : cut[p + 1]] for _, _, v in kept[:256]] for p in range(4)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, c)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p in range(4):
            held = {}
            for _, _, v in kept:
                part = v[cut[p] : cut[p + 1]]
                held.setdefault(near(part, books[p])[1], []).append(part)
            books[p] = [[sum(c) // len(c) for c in zip(*held[k])] if k in held else c for k, c in enumerate(books[p])]
    out = []
    for i, y, v in kept:
        found = [near(v[cut[p] : cut[p + 1]], books[p]) for p in range(4)]
        out.append((i, y, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    total = {}
    for _, y, _, e in out:
        total[y] = total.get(y, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((*r, total[r[1]]) for r in out), key=repr), digest


def result(spark, rows):
    out = vc.compress(spark.createDataFrame([(*r, 7, "user") for r in rows], SCHEMA)).collect()
    assert all(r["_whole"] == "user" for r in out)
    assert len({r["codebooks_sha256"] for r in out}) <= 1
    return sorted(((r["vec_id"], r["label"], r["code"], r["error"], r["label_error"]) for r in out), key=repr), out[0]["codebooks_sha256"] if out else None


@pytest.mark.parametrize("block", [1, 3, 2048])
@pytest.mark.parametrize("large", [3, 1 << 27])
def test_trie_equals_direct_distances(monkeypatch, block, large):
    monkeypatch.setattr(vc, "BLOCK", block)
    rng = np.random.default_rng(block)
    parts = rng.integers(-large, large, (400, 5))
    parts[:200, :3] = parts[0, :3]  # long shared prefixes
    leaves, inverse = vc.sorted_parts(np.concatenate([parts, parts[:50]]))
    assert (leaves[inverse] == np.concatenate([parts, parts[:50]])).all()
    assert [tuple(x) for x in leaves.tolist()] == sorted({tuple(x) for x in parts.tolist()})
    book = rng.integers(-large, large, (17, 5))
    book[3] = book[9]
    code, error = vc.Trie(leaves).nearest(book)
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, c)) for c in book] for x in leaves]
    assert code.tolist() == [w.index(min(w)) for w in want] and error.tolist() == [min(w) for w in want]


def test_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.01 if i % 3 else 0.3, 10).tolist(), int(i % 4) or None) for i in range(340)]
    rows += [(400 + i, rows[17][1], 1) for i in range(170)]  # a vector that is a third of all rows
    rows += [(3, rows[3][1], 2), (3, rows[9][1], 2), (None, rows[8][1], None), (None, rows[30][1], None)]
    rows += [(-5, None, 1), (-4, [], 1), (-3, [None] * 10, 1), (-2, [float("nan")] + [0.0] * 9, 1), (-1, [float("inf")] + [0.0] * 9, 1), (999, [1.0] * 7, 1)]
    assert result(spark, rows) == brute(rows)


def test_few_and_no_rows(spark):
    few = [(2, [0.5, -0.5, 0.25, 1.0, 0.0], None), (1, [0.5, -0.5, 0.25, 1.0, 0.0], 3)]
    assert result(spark, few) == brute(few)
    assert result(spark, []) == ([], None)
    assert result(spark, [(1, None, 1), (2, [float("nan")], 2)]) == ([], None)
    with pytest.raises(ValueError, match="components"):
        result(spark, [(1, [1e300] * 4, 1)])


def test_many_labels_are_joined_in_salted_form(spark, monkeypatch):
    rows = spark.createDataFrame([(i % 7 or None, i) for i in range(500)], "y int, e long")
    want = sorted(((r["y"] or 0), r["e"], r["s"]) for r in vc.with_group_sum(rows, rows["y"], "e", "s").collect())
    monkeypatch.setattr(vc, "fits", lambda df: False)
    assert sorted(((r["y"] or 0), r["e"], r["s"]) for r in vc.with_group_sum(rows, rows["y"], "e", "s").collect()) == want
