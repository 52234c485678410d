import random
import zlib
from collections import defaultdict

import pytest

from fieldloom.llm import sharding


def greedy(sizes, capacity):
    shards, held = 1, 0
    for s in sizes:
        if s > capacity:
            return len(sizes) + 1
        if held + s > capacity:
            shards, held = shards + 1, 0
        held += s
    return shards


def best(sizes, shards):
    return next(c for c in range(max(sizes), sum(sizes) + 1) if greedy(sizes, c) <= shards)


@pytest.mark.parametrize("seed", range(6))
def test_capacity_is_the_smallest(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 3, 50, rng.randint(1, 400)]) for _ in range(rng.choice([1, 5, 60, 300]))]
    ends, at = [], 0
    for s in sizes:
        at += s
        ends.append((at,))
    shards = rng.choice([1, 3, 16])
    cuts = sharding.minimax_cuts(spark.createDataFrame(ends, "end long"), at, shards, bins=rng.choice([4, 16, 1 << 14]))
    assert len(cuts) == shards and cuts[-1] == at and {c for c in cuts} <= {e for e, in ends}
    assert max(b - a for a, b in zip([0, *cuts], cuts)) == best(sizes, shards)


def texts_of(rows):
    return [None, "", ""] + [f"text {i % 90} " + "x" * (i % 37) for i in range(rows)] + ["giant " * 50] * (rows // 3)


def check(rows, texts, shards):
    assert len(rows) == len(texts)
    where, held, slots = {}, defaultdict(int), defaultdict(list)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert r["size"] == len(text.encode()) + 1 and r["text_crc32"] == zlib.crc32(text.encode())
        assert where.setdefault(text, r["shard"]) == r["shard"] and 0 <= r["shard"] < shards
        held[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return held


def test_whole_groups_and_even_shards(spark):
    texts = texts_of(1500)
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in enumerate(texts)], "doc_id long, text string, size int, shard string")
    held = check(sharding.shard_documents(docs, 8, bins=32).collect(), texts, 8)
    sizes = defaultdict(int)
    for t in texts:
        sizes[t or ""] += len((t or "").encode()) + 1
    assert max(held.values()) == max(sizes.values())
    others = sorted(held.values())[:-1]
    assert others[-1] - others[0] <= 2 * sorted(sizes.values())[-2] and len(held) == 8


def test_odd_tables(spark):
    schema = "doc_id long, text string"
    assert sharding.shard_documents(spark.createDataFrame([], schema), 4).count() == 0
    rows = sharding.shard_documents(spark.createDataFrame([(None, None), (None, None), (1, "a"), (1, "a")], schema), 4).collect()
    assert len(rows) == 4 and len({r["shard"] for r in rows if r["doc_id"] == 1}) == 1
    one = sharding.shard_documents(spark.createDataFrame([(1, "long " * 20000)], schema), 4).collect()
    assert one[0]["slot"] == 0 and one[0]["size"] == 100001
