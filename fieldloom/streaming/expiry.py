"""Expiry of batches on a stream: one event for each batch that stayed silent beyond its limit.

The batches are dealt over a fixed number of buckets by the hash of their key.  The state of a
bucket holds the open life spans of its batches and one event-time timer, set to the earliest
end.  Each activity (an arrival, a correction) renews the span it falls into and moves the
timer; a span is final, and its expiry written, once the watermark has passed its end.  So the
calls of a trigger are at most as many as the buckets, however many batches there are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, LongType, StructField, StructType, TimestampType

from fieldloom import model as m

PIECE = 60_000_000  # microseconds: activities of one batch within it travel as one row
BUCKETS = 4096  # groups that share a state; a running stream keeps the number it began with
SPAN = ["started", "last", "n"]

Span = tuple[int, int, int]  # first and last activity in microseconds, number of activities


def merge_rows(rows: pd.DataFrame, limit: int) -> pd.DataFrame:
    """Life spans (batch, started, last, n) in order of time; those of a batch at most ``limit`` apart are one."""
    if rows.empty:
        return rows
    rows = rows.assign(code=pd.factorize(rows["batch"])[0]).sort_values(["code", "started"], ignore_index=True)
    code, started = rows["code"].to_numpy(), rows["started"].to_numpy()
    reach = rows.groupby("code")["last"].cummax().to_numpy()
    fresh = np.append(True, (code[1:] != code[:-1]) | (started[1:] > reach[:-1] + limit))
    first = np.flatnonzero(fresh)
    return pd.DataFrame({
        "batch": rows["batch"].iloc[first].reset_index(drop=True), "started": started[first],
        "last": np.maximum.reduceat(reach, first), "n": np.add.reduceat(rows["n"].to_numpy(), first),
    })


def merge_spans(spans: Iterable[Span], limit: int) -> list[Span]:
    """``merge_rows`` for the spans of one batch."""
    rows = pd.DataFrame(list(spans), columns=SPAN, dtype="int64").assign(batch=0)
    return list(merge_rows(rows, limit)[SPAN].itertuples(index=False, name=None))


def _pieces(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Activities of a batch within the same minute as one row, so a busy batch sends few rows to its state."""
    for chunk in chunks:
        at = chunk["at"]
        grouped = chunk.assign(minute=at // PIECE).groupby(["batch", "minute"], dropna=False, sort=False)["at"]
        rows = grouped.agg(["min", "max", "count"]).reset_index()
        yield pd.DataFrame({
            "batch": rows["batch"], "time": pd.to_datetime(rows["max"], unit="us", utc=True),
            "started": rows["min"], "last": rows["max"], "n": rows["count"],
        })


def _expire(limit: int):
    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spans = pd.DataFrame(dict(zip(["batch", *SPAN], state.get))) if state.exists else None
        if not state.hasTimedOut:
            for chunk in chunks:  # merged chunk by chunk: the open spans are held, not the rows
                rows = chunk[["batch", *SPAN]]
                spans = merge_rows(rows if spans is None else pd.concat([spans, rows], ignore_index=True), limit)
        if spans is None:
            return
        # in whole milliseconds, as the watermark is
        passed = state.getCurrentWatermarkMs()
        ends = -(-(spans["last"] + limit) // 1000)
        over, still = spans[ends < passed], spans[ends >= passed]
        if len(still):
            state.update(tuple(still[c].tolist() for c in ("batch", *SPAN)))
            # a timer lies after the watermark; an end on the watermark is looked at with the next one
            state.setTimeoutTimestamp(max(int(ends[ends >= passed].min()), passed + 1))
        elif state.exists:
            state.remove()
        if len(over):
            time = lambda values: pd.to_datetime(values, unit="us", utc=True)
            yield pd.DataFrame({
                "batch": over["batch"], "started": time(over["started"]), "last_activity": time(over["last"]),
                "expired": time(over["last"] + limit), "n_activities": over["n"],
            })

    return step


def expiries(activity: DataFrame, batch: str = "batch_id", time: str = "ts", ttl_minutes: int = m.BATCH_TTL_MINUTES,
             delay: str = "10 minutes") -> DataFrame:
    """One row for each expiry on a stream: batch, started, last_activity, expired, n_activities.

    A batch lives while its last activity is at most the limit ago, so an activity exactly at
    the limit renews it.  A renewal that comes late, but within ``delay``, still counts and may
    join two spans; one that comes after the expiry was written begins a new life.  Activities
    older than the watermark are late by Spark's rule, measured on the last activity of the
    same minute in the same input chunk.  Rows without a time or a batch belong to no batch.
    """
    limit = ttl_minutes * 60_000_000
    key = activity.schema[batch].dataType
    moment = TimestampType()
    piece = StructType([StructField("batch", key), StructField("time", moment), *[StructField(c, LongType()) for c in SPAN]])
    events = StructType([
        StructField("batch", key), *[StructField(c, moment) for c in ("started", "last_activity", "expired")], StructField("n_activities", LongType()),
    ])
    kept = StructType([StructField("batch", ArrayType(key)), *[StructField(c, ArrayType(LongType())) for c in SPAN]])
    rows = activity.select(F.col(batch).alias("batch"), F.unix_micros(F.col(time).cast(moment)).alias("at")).dropna()
    pieces = rows.mapInPandas(_pieces, piece).withWatermark("time", delay)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("batch"), F.lit(BUCKETS)))
    spans = dealt.groupBy("bucket").applyInPandasWithState(_expire(limit), events, kept, "append", GroupStateTimeout.EventTimeTimeout)
    return spans.withColumnRenamed("batch", batch)
