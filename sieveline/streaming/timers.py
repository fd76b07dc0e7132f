"""Keyed state with event-time timers (T1, T2, W20): a state machine per key.

``JobLeases``: a job is queued, claimed under a lease, kept alive by heartbeats, and done or
failed. A lease that runs out without a heartbeat, and a failure, give the job back to the
queue until its attempts are used up; then it is dead. ``CacheEntries``: an entry lives for its
time to live after its last write.

Spark's Python state costs milliseconds a group and batch, whatever the group holds. So keys are hashed into
buckets, which are the groups: a bucket's states are read and written at once, and its timer is the first of its
keys' ends. ``buckets`` has to stay the same over restarts, and should grow with the keys (``buckets_for``).

A timer fires when the watermark has passed it. A key's later row may be read before that, so
each row first settles what ran out before it: the output is the same however the rows
are cut into batches, as long as a key's rows come in the order of time. A row earlier than the
key's last one is reported as ``late`` and changes nothing.

State and timers are in the state store (RocksDB), so a restart from the checkpoint goes on.
Finished keys leave no state behind.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGE = "key long, at timestamp, change string, attempt int"
_CHANGE_MS = "key long, ms long, change string, attempt int"
#: Buckets of keys, and keys of a bucket where a table's keys decide.
BUCKETS, BUCKET_KEYS = 64, 256


def step_job(state: tuple | None, at: int, kind: str | None, lease_ms: int, attempts: int) -> tuple[tuple | None, list[tuple]]:
    """One row of a job, in milliseconds: the new state ``(status, attempt, lease_until, last)`` and its changes ``(at, change, attempt)``.

    ``kind`` None only settles what has run out by ``at``.
    """
    out = []
    status, attempt, until, last = state or (None, 0, 0, 0)

    def back(when: int) -> None:
        nonlocal status, attempt, until
        status, until = ("queued", 0) if attempt < attempts else ("dead", 0)
        out.append((when, "requeued" if status == "queued" else "dead", attempt))

    if status == "running" and until <= at:
        out.append((until, "expired", attempt))
        back(until)
    if kind is not None:
        if state and at < last:
            out.append((at, "late", attempt))
            return (status, attempt, until, last), out
        last = max(last, at)
        if kind == "enqueue" and status is None:
            status = "queued"
            out.append((at, "queued", attempt))
        elif kind == "claim" and status == "queued":
            status, attempt, until = "running", attempt + 1, at + lease_ms
            out.append((at, "running", attempt))
        elif kind == "heartbeat" and status == "running":
            until = at + lease_ms
        elif kind == "fail" and status == "running":
            out.append((at, "failed", attempt))
            back(at)
        elif kind == "done" and status == "running":
            out.append((at, "done", attempt))
            status = "done"
    if status in (None, "done", "dead"):
        return None, out
    return (status, attempt, until, last), out


def step_entry(state: tuple | None, at: int, kind: str | None, ttl_ms: int, _: int) -> tuple[tuple | None, list[tuple]]:
    """One write (``put``) or removal (``drop``) of a cache entry; the state is as a job's, ``attempt`` counts writes."""
    out = []
    status, writes, until, last = state or (None, 0, 0, 0)
    if status == "live" and until <= at:
        out.append((until, "expired", writes))
        status, writes = None, 0
    if kind is not None:
        if status and at < last:
            out.append((at, "late", writes))
            return (status, writes, until, last), out
        if kind == "put":
            out.append((at, "stored" if status is None else "refreshed", writes + 1))
            status, writes, until = "live", writes + 1, at + ttl_ms
        elif kind == "drop" and status == "live":
            out.append((at, "dropped", writes))
            status = None
        last = max(last, at)
    return ((status, writes, until, last) if status else None), out


class _Machines(StatefulProcessor):
    """The state machines of a bucket's keys; ``step`` is one of the functions above. One timer a bucket: the first of its keys' ends."""

    def __init__(self, step: Callable, span_ms: int, attempts: int):
        self.step, self.span_ms, self.attempts = step, span_ms, attempts

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "key long, status string, attempt int, until_ms long, last_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat([*rows], ignore_index=True).sort_values(["key", "ms", "seq"], kind="stable")
        yield from self._go(list(zip(every["key"].tolist(), every["ms"].tolist(), every["kind"].tolist())), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._go([], timerValues)

    def _go(self, rows: list[tuple], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        states = {k: tuple(rest) for k, *rest in self.held.get()} if self.held.exists() else {}
        known, before, changes = bool(states), _first(states), []

        def step(key: int, at: int, kind: str | None) -> None:
            state, new = self.step(states.get(key), at, kind, self.span_ms, self.attempts)
            changes.extend((key, *c) for c in new)
            if state:
                states[key] = state
            else:
                states.pop(key, None)

        for row in rows:
            step(*row)
        for key in [k for k, state in states.items() if 0 < state[2] <= passed]:
            step(key, passed, None)
        after = _first(states)
        if before and before != after:
            self.handle.deleteTimer(before)
        if after and before != after:
            self.handle.registerTimer(after)
        if states:
            self.held.put([(k, *state) for k, state in states.items()])
        elif known:
            self.held.clear()
        if changes:
            key, ms, change, attempt = zip(*changes)
            yield pd.DataFrame({"key": key, "ms": ms, "change": change, "attempt": np.array(attempt, "int32")})

    def close(self) -> None:
        pass


def _first(states: dict[int, tuple]) -> int:
    return min((state[2] for state in states.values() if state[2]), default=0)


def bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def buckets_for(rows: DataFrame, key: str) -> int:
    """Buckets of about ``BUCKET_KEYS`` keys, for the keys of this table."""
    return max(BUCKETS, -(-rows.agg(F.approx_count_distinct(key)).first()[0] // BUCKET_KEYS))


def _run(rows: DataFrame, step: Callable, span_ms: int, attempts: int, watermark: str, buckets: int) -> DataFrame:
    """``key, at, change, attempt`` from a stream of ``key long, at timestamp, kind string, seq long``."""
    marked = rows.where("key is not null and at is not null and kind is not null").withWatermark("at", watermark)
    timed = marked.select(bucket("key", buckets).alias("bucket"), "key", "at", F.unix_millis("at").alias("ms"), "kind", "seq")
    machines = _Machines(step, span_ms, attempts)
    changes = timed.groupBy("bucket").transformWithStateInPandas(machines, outputStructType=_CHANGE_MS, outputMode="append", timeMode="EventTime")
    return changes.select("key", F.timestamp_millis("ms").alias("at"), "change", "attempt")


def job_leases(rows: DataFrame, lease_seconds: int = 1800, attempts: int = 3, watermark: str = "1 minute", buckets: int = BUCKETS) -> DataFrame:
    """Changes of jobs: queued, running, expired, failed, requeued, dead, done, late. ``kind``: enqueue, claim, heartbeat, fail, done."""
    return _run(rows, step_job, lease_seconds * 1000, attempts, watermark, buckets)


def cache_entries(rows: DataFrame, ttl_seconds: int = 300, watermark: str = "1 minute", buckets: int = BUCKETS) -> DataFrame:
    """Changes of cache entries: stored, refreshed, dropped, expired, late. ``kind``: put, drop."""
    return _run(rows, step_entry, ttl_seconds * 1000, 0, watermark, buckets)


def with_rocksdb(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state in RocksDB, as timers need."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return own
