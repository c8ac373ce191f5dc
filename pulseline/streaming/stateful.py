"""Stateful streaming queries: the same steps as the batch folds, with state kept by key.

Rows of a micro-batch come in no order, so each call sorts its rows by time and number first. A row older than what
its key has already seen is folded at the key's latest time (late rows can't turn the clock back).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pulseline import schemas as S
from pulseline.operators.presence import device_step, heartbeat_step

DEVICE_OUT = "eid long, device_id int, now long, seq long, outcome string, device_status string"
HEART_OUT = "eid long, device_id int, now_ms long, seq long, outcome string, stopped boolean"
END_OUT = "eid long, terminated_at timestamp"


def device_changes(stream: DataFrame, refresh: int = S.REFRESH_SECONDS, stale: int = S.STALE_SECONDS) -> DataFrame:
    """stream(eid, device_id, now, seq, status): change decisions as in the batch fold."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["now", "seq"])
        own = dict(zip(("status", "activity", "seen"), state.get, strict=True)) if state.exists else {}
        out = []
        for r in rows.itertuples(index=False):
            if not own:
                own = {"status": "ONLINE", "activity": int(r.now), "seen": int(r.now)}
            own["seen"] = max(own["seen"], int(r.now))
            outcome = device_step(own, own["seen"], own["seen"], r.status, 2, stale, refresh)
            out.append((*key, r.now, r.seq, outcome, own["status"]))
        state.update((own["status"], own["activity"], own["seen"]))
        yield pd.DataFrame(out, columns=["eid", "device_id", "now", "seq", "outcome", "device_status"])

    return stream.groupBy("eid", "device_id").applyInPandasWithState(step, DEVICE_OUT, "status string, activity long, seen long", "append", GroupStateTimeout.NoTimeout)


HEART_STATE = ("missed", "counter", "timer", "max_missed", "sent", "status", "activity")


def heartbeats(stream: DataFrame) -> DataFrame:
    """stream(eid, device_id, now_ms, seq, kind): ticks and pongs; a stopped device's state is removed."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["now_ms", "seq"])
        own = dict(zip(HEART_STATE, state.get, strict=True)) if state.exists else {}
        out = []
        for r in rows.itertuples(index=False):
            outcome, stopped = heartbeat_step(own, r.kind, int(r.now_ms))
            out.append((*key, r.now_ms, r.seq, outcome, stopped))
        if own:
            state.update(tuple(own[k] for k in HEART_STATE))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["eid", "device_id", "now_ms", "seq", "outcome", "stopped"])

    kinds = "missed long, counter long, timer long, max_missed long, sent long, status string, activity long"
    return stream.groupBy("eid", "device_id").applyInPandasWithState(step, HEART_OUT, kinds, "append", GroupStateTimeout.NoTimeout)


def terminations(stream: DataFrame, stale: int = S.STALE_SECONDS) -> DataFrame:
    """stream(eid, device_id, ts, status) with a watermark on ts: a row when all devices of a user have been offline
    until `stale` seconds after the last sign of any. A device that comes back in time cancels it."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            _, _, last = state.get
            state.remove()
            yield pd.DataFrame([(key[0], pd.Timestamp(last + stale * 1000, unit="ms"))], columns=["eid", "terminated_at"])
            return
        ids, up, last = state.get if state.exists else ([], [], 0)
        devices = dict(zip(ids, up, strict=True))
        for r in pd.concat(list(batches)).sort_values("ts").itertuples(index=False):
            devices[int(r.device_id)] = r.status == "ONLINE"
            last = max(last, int(pd.Timestamp(r.ts).value // 1_000_000))
        state.update((list(devices), list(devices.values()), last))
        if not any(devices.values()):
            state.setTimeoutTimestamp(max(last + stale * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([], columns=["eid", "terminated_at"])

    return stream.groupBy("eid").applyInPandasWithState(step, END_OUT, "ids array<int>, up array<boolean>, last long", "append", GroupStateTimeout.EventTimeTimeout)
