import numpy as np
import pytest

from fieldloom.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<float>, label int, id string, w int"


def brute(rows, cosine=0.98):
    n = len(rows)
    good = []
    for _, v, label in rows:
        ok = v is not None and label is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
        good.append(np.asarray(v, np.float32).astype(float) / np.linalg.norm(np.asarray(v, np.float32).astype(float)) if ok else None)
    up, links = list(range(n)), [0] * n

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            if good[i] is not None and good[j] is not None and rows[i][2] == rows[j][2] and len(good[i]) == len(good[j]) and good[i] @ good[j] >= cosine:
                links[i] += 1
                links[j] += 1
                up[root(i)] = root(j)
    least = {}
    for i in range(n):
        least[root(i)] = min(least.get(root(i), rows[i][0]), rows[i][0])
    return {(rows[i][0], i): (links[i], least[root(i)]) for i in range(n)}


def vectors(seed, n, dim=24):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            base = np.array(out[rng.integers(len(out))][0])
            v = base + rng.standard_normal(dim) * np.linalg.norm(base) / np.sqrt(dim) * rng.choice([0, 0.05, 0.15, 0.2, 0.25])
            label = out[-1][1]
        else:
            v, label = rng.standard_normal(dim), int(rng.integers(3))
        out.append((v.astype(np.float32).tolist(), label))
    return [(i * 7 % 1009, v, label) for i, (v, label) in enumerate(out)]


@pytest.mark.parametrize(("grid", "tile"), [(None, 2048), (0, 40), (2, 64)])
def test_equals_brute_force(spark, grid, tile):
    rows = vectors(3, 500)
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    want = {k[0]: v for k, v in brute(rows).items()}
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in ed.near_duplicates(docs, grid=grid, tile=tile).collect()}
    assert len(got) == len(rows)
    total = sum(v[0] for v in want.values())
    assert sum(min(got[k][0], want[k][0]) for k in want) >= 0.995 * total
    assert all(got[k][0] <= want[k][0] for k in want)
    assert sum(got[k][1] == want[k][1] for k in want) >= 0.98 * len(want)


def test_odd_vectors(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(1, one, 0), (2, one, 0), (3, one, 1), (4, None, 0), (5, [0.0, 0.0, 0.0], 0), (6, [1.0, None, 1.0], 0), (7, [float("nan"), 1.0, 1.0], 0), (8, [float("inf"), 1.0, 1.0], 0),
            (9, one, None), (10, [], 0), (11, [2.0, 4.0, 6.0], 0), (12, [1.0, 2.0], 0), (13, [1e-30, 2e-30, 3e-30], 0), (None, one, 0), (2, one, 0)]
    got = sorted((tuple(r) for r in ed.near_duplicates(spark.createDataFrame([(*r, "", 1) for r in rows], SCHEMA)).collect()), key=repr)
    assert got == sorted([(1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (11, 4, 1, False), (13, 4, 1, False), (3, 0, 3, True), *[(k, 0, k, True) for k in (4, 5, 6, 7, 8, 9, 10, 12)], (None, 0, None, True)], key=repr)
    assert ed.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_calibration():
    assert ed.least_collisions(16, 3.0, 0.999) in (15, 14)
    assert ed.grid_lines(1000) == 0 < ed.grid_lines(10**9) <= ed.MOST_GRID
