"""Expiry events of a stream against a plain walk over all activities."""

import random
from datetime import datetime, timedelta

import pytest

from fieldloom.streaming import expiry
from fieldloom.streaming.expiry import expiries, merge_spans

DAY = datetime(2024, 5, 1)


def at(minutes: float) -> datetime:
    return DAY + timedelta(minutes=minutes)


def run(spark, folder, arrivals, schema="batch_id string, ts timestamp, last string"):
    """Expiries after the given lists of rows have arrived one after the other."""
    for rows in arrivals:
        spark.createDataFrame(rows, schema).coalesce(2).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        query = expiries(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}/log")
        query.trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(f"{folder}/out").select("batch_id", "started", "expired", "n_activities").collect())


def lives(activities, until, limit=25):
    """(batch, started, expired, n) of the life spans that end before ``until``."""
    found = []
    for batch in {b for b, _ in activities}:
        times = sorted(t for b, t in activities if b == batch)
        start = 0
        for k in range(1, len(times) + 1):
            if k == len(times) or times[k] - times[k - 1] > timedelta(minutes=limit):
                found.append((batch, times[start], times[k - 1] + timedelta(minutes=limit), k - start))
                start = k
    return sorted(x for x in found if x[2] < until)


def test_spans_merge_at_the_limit():
    assert merge_spans([(50, 60, 1), (0, 25, 2)], 25) == [(0, 60, 3)]
    assert merge_spans([(51, 60, 1), (0, 25, 2)], 25) == [(0, 25, 2), (51, 60, 1)]
    assert merge_spans([(0, 90, 2), (10, 20, 1), (115, 115, 1)], 25) == [(0, 115, 4)]
    assert merge_spans([], 25) == []


def test_renewals_move_the_expiry(spark, tmp_path):
    first = [("a", at(0), ""), ("b", at(0), ""), ("c", at(0), ""), ("e", at(1), ""), (None, at(0), ""), ("a", None, "")]
    # a is renewed exactly at the limit, b one minute after it; e twice, by a late activity that joins both
    second = [("a", at(25), ""), ("b", at(26), ""), ("e", at(30), "")]
    late = [("e", at(22), ""), ("clock", at(31), "")]
    last = [("clock", at(200), "")]
    found = run(spark, str(tmp_path), [first, second, late, last])
    assert found == [
        ("a", at(0), at(50), 2), ("b", at(0), at(25), 1), ("b", at(26), at(51), 1), ("c", at(0), at(25), 1),
        ("clock", at(31), at(56), 1), ("e", at(1), at(55), 3),
    ]


def test_activity_after_the_expiry_begins_a_new_life(spark, tmp_path):
    found = run(spark, str(tmp_path), [[("a", at(0), ""), ("z", at(60), "")], [("a", at(10), ""), ("a", at(55), "")], [("z", at(300), "")]])
    # the watermark stands at 50: the activity of minute 10 is late and passed over
    assert found == [("a", at(0), at(25), 1), ("a", at(55), at(80), 1), ("z", at(60), at(85), 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_within_the_delay(spark, tmp_path, seed):
    rng = random.Random(seed)
    # one batch has a third of all activities, some of them in the same second
    rows = [("hot" if rng.random() < 0.33 else f"b{rng.randrange(40)}", at(rng.randrange(0, 2400) / 2)) for _ in range(900)]
    arrival = lambda row: row[1] + timedelta(minutes=rng.choice([0, 0, 0, 9]))
    slices = [[] for _ in range(4)]
    for row in rows:
        slices[min(3, int((arrival(row) - DAY) / timedelta(minutes=300)))].append((*row, ""))
    found = run(spark, str(tmp_path), slices)
    assert found == lives(rows, max(t for _, t in rows) - timedelta(minutes=10))


def test_no_activity_at_all(spark, tmp_path):
    assert run(spark, str(tmp_path), [[]]) == []


def test_batches_share_their_states(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(expiry, "BUCKETS", 5, raising=False)
    rows = [(f"b{k}", at(k % 7 + 20 * i), "") for k in range(200) for i in range(3)] + [("clock", at(75), "")]
    seen = []
    for part in (rows, [("clock", at(400), "")]):
        spark.createDataFrame(part, "batch_id string, ts timestamp, last string").write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("batch_id string, ts timestamp, last string").parquet(f"{tmp_path}/in")
        query = expiries(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/log")
        query = query.trigger(availableNow=True).start(f"{tmp_path}/out")
        query.awaitTermination()
        seen += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert 0 < max(seen) <= 5
    found = spark.read.parquet(f"{tmp_path}/out").select("batch_id", "started", "expired", "n_activities").collect()
    assert sorted(tuple(r) for r in found) == lives([(b, t) for b, t, _ in rows], at(390))
