"""Freshness as a stream (T1): a snapshot turns stale by itself.

``latest_snapshot`` answers whether a source is fresh when asked. Here each source is a key with one row of state, the time of its
newest snapshot, and an event-time timer at that time plus the source's TTL: a snapshot that lands before the timer fires
keeps the source fresh and moves the timer; a timer that fires reports the source stale, and the next snapshot reports it
fresh again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TRANSITIONS = "source string, at timestamp_ntz, state string, fetched_at timestamp_ntz"
FRESH, STALE = "fresh", "stale"
_US = pd.Timedelta(microseconds=1)
_EPOCH = pd.Timestamp(0)


def _micros(t) -> int:
    return (pd.Timestamp(t) - _EPOCH) // _US


def _stamp(us: int) -> pd.Timestamp:
    return _EPOCH + us * _US


def ends(batches: Iterator[pd.DataFrame], ttls: dict[str, int]) -> Iterator[pd.DataFrame]:
    """Per source and stretch of one TTL, the first and the last snapshot: all that the transitions depend on, as two
    snapshots within a stretch are never a TTL apart. A source with very many snapshots is reduced before the shuffle."""
    for pdf in batches:
        pdf = pdf[pdf["source"].isin(list(ttls)) & pdf["fetched_at"].notna()]
        if len(pdf):
            us = (pdf["fetched_at"] - _EPOCH) // _US
            stretch = us // (pdf["source"].map(ttls).astype("int64") * 1_000_000)
            per = pdf.groupby(["source", stretch], sort=False)["fetched_at"].agg(["min", "max"]).reset_index()
            both = pd.concat([per[["source", "min"]].rename(columns={"min": "fetched_at"}), per[["source", "max"]].rename(columns={"max": "fetched_at"})])
            yield both.drop_duplicates()


def transitions(source: str, times: list[int], last: int | None, ttl: int, stale: bool) -> tuple[list[tuple], int | None, bool]:
    """Transition rows for a source's snapshots (microseconds, ascending) after its newest one; the newest and its state afterwards."""
    rows = []
    for t in times:
        if last is not None and t <= last:
            continue  # late: the source has a newer snapshot
        if last is not None and not stale and t - last >= ttl:
            rows.append((source, _stamp(last + ttl), STALE, _stamp(last)))
            stale = True
        if last is None or stale:
            rows.append((source, _stamp(t), FRESH, _stamp(t)))
        last, stale = t, False
    return rows, last, stale


def freshness_transitions(snapshots: DataFrame, ttls: dict[str, int], delay: str = "0 seconds") -> DataFrame:
    """Stream of (source, at, state, fetched_at) from a stream of (source, fetched_at).

    ``ttls`` gives seconds per source; other sources are left out. ``delay`` is how far behind the newest time seen the
    watermark runs: a snapshot older than that may come too late to keep its source fresh. Stale is reported at the
    snapshot's time plus the TTL (age >= TTL), by the timer or by the first later row, whichever comes first.
    """
    limits = {s: int(t) for s, t in ttls.items()}

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        source, ttl = key[0], limits[key[0]] * 1_000_000
        last, stale = state.get if state.exists else (None, False)
        if state.hasTimedOut:
            state.update((last, True))
            yield pd.DataFrame([(source, _stamp(last + ttl), STALE, _stamp(last))], columns=["source", "at", "state", "fetched_at"])
            return
        times = sorted({_micros(t) for pdf in batches for t in pdf["fetched_at"]})
        rows, last, stale = transitions(source, times, last, ttl, bool(stale))
        if last is not None:
            state.update((last, stale))
            due = -(-(last + ttl) // 1000)
            if not stale:
                state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        if rows:
            yield pd.DataFrame(rows, columns=["source", "at", "state", "fetched_at"])

    few = snapshots.select("source", "fetched_at").mapInPandas(lambda b: ends(b, limits), "source string, fetched_at timestamp_ntz")
    timed = few.withColumn("event_time", few["fetched_at"].cast("timestamp")).withWatermark("event_time", delay)
    return timed.groupBy("source").applyInPandasWithState(step, TRANSITIONS, "last bigint, stale boolean", "append", GroupStateTimeout.EventTimeTimeout)


def start_freshness(snapshots: DataFrame, ttls: dict[str, int], path: str, checkpoint: str, delay: str = "0 seconds",
                    available_now: bool = True, interval: str = "1 minute"):
    """Append the transitions to a Parquet table; returns the StreamingQuery."""
    w = (freshness_transitions(snapshots, ttls, delay).writeStream.format("parquet").outputMode("append")
         .option("path", path).option("checkpointLocation", checkpoint))
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)).start()
