"""Retention, leases and task states as streams whose events come late, out of order and more than once.

Event time decides, not arrival. An event older than the watermark is left out by Spark; whatever may still come is waited for, so the rows that come out are those of
the batch rules over all events, in whatever order they came. State is kept by key and ends with a timer: of a retention the events since the one that is waited for, of a task its last state, and the
events that may still be repeated.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewright.shipping import ship
from tracewright.streaming.worker import accepted

#: What a retention stream gets: an event sets a new time (or none) for its key; seq tells events apart and orders those of one time.
TIMED = "id string, at timestamp, seq long, expires_at timestamp"
CHANGE = "id string, at timestamp, seq long, status string, failed boolean, gone boolean"


def decide(pending: list[list], watermark: int) -> tuple[list[list], list[list]]:
    """Of a key's events [at, seq, expires] in their order those that expired, and those to keep. An event expires unless another of its key comes before its time is over. Times
    in microseconds; below the watermark nothing comes any more."""
    out, i = [], 0
    while i < len(pending):
        at, _, expires = pending[i]
        after = pending[i + 1][0] if i + 1 < len(pending) else None
        if at >= watermark:
            break  # it may be repeated, or another may come before it
        if expires is not None and (after is None or after > expires):
            if expires >= watermark:
                break
            out.append(pending[i])
        i += 1
    return out, pending[i:]


def _due(pending: list[list], watermark: int) -> int:
    """When the first of the pending events is to be looked at again, in milliseconds."""
    at, _, expires = pending[0]
    return max(at if at >= watermark else expires, watermark) // 1000 + 1


def _expiries(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    watermark = state.getCurrentWatermarkMs() * 1000
    pending = json.loads(state.get[0]) if state.exists else []
    if not state.hasTimedOut:
        known = {e[1] for e in pending}
        for frame in frames:
            for at, seq, expires in zip(frame["at_us"], frame["seq"], frame["expires_us"], strict=True):
                if int(seq) not in known:
                    known.add(int(seq))
                    pending.append([int(at), int(seq), None if pd.isna(expires) else int(expires)])
        pending.sort(key=lambda e: (e[0], e[1]))
    out, pending = decide(pending, watermark)
    if pending:
        state.update((json.dumps(pending),))
        state.setTimeoutTimestamp(_due(pending, watermark))
    elif state.exists:
        state.remove()
    if out:
        yield pd.DataFrame({"id": key[0], "seq": [e[1] for e in out], "expires_us": [e[2] for e in out]})


def expiries(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """T-8, T-9: a stream of TIMED -> id, seq, expires_at of every event whose time was over before another event of its key came.

    A retention sets the time of a finished task's file and ends it when the task runs again or its file goes; a lease sets half an hour and ends it on release."""
    ship(events.sparkSession)
    micros = events.withWatermark("at", lateness).select("id", "at", F.unix_micros("at").alias("at_us"), "seq", F.unix_micros("expires_at").cast("double").alias("expires_us"))
    found = micros.groupBy("id").applyInPandasWithState(_expiries, "id string, seq long, expires_us long", "pending string", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("id", "seq", F.timestamp_micros("expires_us").alias("expires_at"))


def _states(free: bool) -> Callable:
    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs() * 1000
        status, at, seq, failures, version, gone, recent = (*state.get[:6], json.loads(state.get[6])) if state.exists else (None, -1, -1, 0, 0, False, {})
        if state.hasTimedOut:
            if gone:
                state.remove()  # nothing older than the tombstone can come any more
                return
            state.update((status, at, seq, failures, version, gone, "{}"))
            return
        before = (status, at, seq, failures, gone)
        rows = [(int(a), int(s), t, bool(f), bool(g)) for frame in frames for a, s, t, f, g in zip(frame["at_us"], frame["seq"], frame["status"], frame["failed"], frame["gone"], strict=True)]
        for a, s, to, fails, goes in sorted(rows, key=lambda r: r[:2]):
            if str(s) in recent:
                continue
            recent[str(s)] = a
            failures += fails
            if (a, s) > (at, seq) and not gone and (free or goes or accepted(status, to)):
                status, at, seq, gone = to, a, s, goes
        recent = {s: a for s, a in recent.items() if a >= watermark}
        if (status, at, seq, failures, gone) != before:
            version += 1
            yield pd.DataFrame({"id": [key[0]], "version": [version], "status": [status], "at_us": [at], "seq": [seq], "failures": [failures], "gone": [gone]})
        state.update((status, at, seq, failures, version, gone, json.dumps(recent)))
        state.setTimeoutTimestamp(max([watermark, at, *recent.values()]) // 1000 + 1)

    return fold


def states(events: DataFrame, lateness: str = "1 hour", *, free: bool = False) -> DataFrame:
    """T-1, T-13: a stream of CHANGE -> the versions of each key: id, version, status, at, seq, failures, gone. The last version holds.

    The newest event's status holds, however late an older one comes; a tombstone ends a key until nothing older can come. A repeated event counts once. Unless `free`, only steps of the task's
    state machine are taken."""
    ship(events.sparkSession)
    micros = events.withWatermark("at", lateness).select("id", "at", F.unix_micros("at").alias("at_us"), "seq", "status", "failed", "gone")
    kept = "status string, at_us long, seq long, failures long, version long, gone boolean, recent string"
    found = micros.groupBy("id").applyInPandasWithState(_states(free), "id string, version long, status string, at_us long, seq long, failures long, gone boolean", kept, "append", GroupStateTimeout.EventTimeTimeout)
    return found.withColumn("at", F.timestamp_micros("at_us")).drop("at_us")
