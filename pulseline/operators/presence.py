"""User presence: roll-up of devices, change detection by ordered folds, grace deadlines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseline import schemas as S
from pulseline.functions.columns import epoch, presence_status, seconds_between
from pulseline.operators.devices import KEY, latest, live


def device_snapshot(stanzas: DataFrame) -> DataFrame:
    """(eid, device_id, status, last_seen): each device after its last stanza."""
    last = latest(stanzas.select(*KEY, "ts", "event_id", "status"), KEY, ["ts", "event_id"])
    return last.select(*KEY, presence_status(F.col("status")).alias("status"), F.col("ts").alias("last_seen"))


def presence_rollup(devices: DataFrame, as_of: Column, stale: int = S.STALE_SECONDS) -> DataFrame:
    """(eid, user_status, live_devices, online_device_ids, last_seen) from devices(eid, device_id, status, last_seen[, awareness_intention]).

    One hidden device hides the user. Ids are in order of last_seen, newest first.
    """
    hidden = F.coalesce(F.bool_or(F.col("awareness_intention") == S.HIDDEN), F.lit(False)) if "awareness_intention" in devices.columns else F.lit(False)
    up = live(F.col("status"), F.col("last_seen"), as_of, stale)
    ids = F.sort_array(F.collect_list(F.when(up, F.struct("last_seen", "device_id"))), asc=False)
    out = devices.groupBy("eid").agg(hidden.alias("_hidden"), ids.alias("_live"), F.max("last_seen").alias("last_seen"))
    shown = F.when(F.col("_hidden"), F.slice("_live", 1, 0)).otherwise(F.col("_live"))
    return out.select(
        "eid", F.when(F.size(shown) > 0, "ONLINE").otherwise("OFFLINE").alias("user_status"), F.size(shown).cast("long").alias("live_devices"),
        F.transform(shown, lambda x: x["device_id"]).alias("online_device_ids"), "last_seen",
    )


def grace_deadlines(devices: DataFrame, as_of: Column, stale: int = S.STALE_SECONDS) -> DataFrame:
    """(eid, seconds_left): how long an all-offline user's process is kept: stale less whole seconds since the last
    sign of any device, 0 at least."""
    g = devices.groupBy("eid").agg(F.bool_or(F.col("status") == "ONLINE").alias("up"), F.max("last_seen").alias("last_seen"))
    left = F.greatest(F.lit(stale) - seconds_between(as_of, F.coalesce("last_seen", as_of)), F.lit(0).cast("long"))
    return g.filter(~F.coalesce("up", F.lit(False))).select("eid", left.alias("seconds_left"))


def fold_sorted(rows: DataFrame, keys: list[str], order: list[str], schema: str, start: Callable[[], dict], step: Callable[[dict, object], tuple]) -> DataFrame:
    """An ordered fold of each key: step(state, row) returns the values to add to the row.

    Rows are dealt by key and sorted inside partitions; state passes along the sorted stream, so a key of any length
    needs memory for one batch. schema names the added columns.
    """
    columns = rows.columns
    added = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: tuple | None = None
        state: dict = {}
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                own = tuple(getattr(row, k) for k in keys)
                if own != key:
                    key, state = own, start()
                out.append(step(state, row))
            yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(out, columns=added)], axis=1)

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", " + schema
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, kinds).select(*columns, *added)


def device_step(state: dict, now: int, last_seen: int, status: str, intention: int, stale: int, refresh: int) -> str:
    """One change decision for a device; state has status and activity (seconds or None)."""
    current = "OFFLINE" if intention == S.HIDDEN or status != "ONLINE" or now - last_seen > stale else "ONLINE"
    if state["status"] != current:
        state["status"] = current
        state["activity"] = now
        return "changed"
    if state["activity"] is not None and now - state["activity"] >= refresh:
        state["activity"] = now
        return "refresh"
    return "unchanged"


def device_changes(rows: DataFrame, refresh: int = S.REFRESH_SECONDS, stale: int = S.STALE_SECONDS) -> DataFrame:
    """rows(eid, device_id, now, seq, status[, last_seen, awareness_intention]) with outcome and device_status.

    now and last_seen are whole seconds. A device starts ONLINE with its first row as last activity. The refresh
    clock runs from the last emission, not from the previous row.
    """
    rows = rows.withColumns({c: v for c, v in {"last_seen": F.col("now"), "awareness_intention": F.lit(2)}.items() if c not in rows.columns})

    def step(state: dict, row: object) -> tuple:
        if not state:
            state.update(status="ONLINE", activity=row.now)
        return device_step(state, row.now, row.last_seen, row.status, row.awareness_intention, stale, refresh), state["status"]

    return fold_sorted(rows, KEY, ["now", "seq"], "outcome string, device_status string", dict, step)


def stanza_device_changes(stanzas: DataFrame, refresh: int = S.REFRESH_SECONDS) -> DataFrame:
    rows = stanzas.select(*KEY, epoch(F.col("ts")).alias("now"), F.col("event_id").alias("seq"), presence_status(F.col("status")).alias("status"))
    return device_changes(rows, refresh)


def user_changes(rows: DataFrame, stale: int = S.STALE_SECONDS) -> DataFrame:
    """rows(eid, device_id, now, seq, status): after each row of a user, whether the user's status or set of live
    devices changed. Adds outcome, user_status and n_live.

    An ONLINE row makes its device live up to the device's next row, for `stale` seconds at most. Where it runs out before that row, an
    expiry of its own stands in the user's order, so running counts give the devices that are live after each row, and a user's set of live
    devices changed if the row's own device turned, or another one ran out since the user's row before.
    """
    own = Window.partitionBy(*KEY).orderBy("now", "seq")
    up = F.coalesce(F.col("status") == "ONLINE", F.lit(False))
    spans = rows.select("*", up.alias("_up")).withColumns({"_was": F.lag("_up").over(own), "_from": F.lag("now").over(own), "_to": F.lead("now").over(own)})
    ends = F.col("now") + stale + 1
    over = F.col("_up") & (F.col("_to").isNull() | (F.col("_to") >= ends))
    still = F.coalesce(F.col("_was") & (F.col("now") - F.col("_from") <= stale), F.lit(False))  # the device is live up to this row
    mine = F.struct(F.col("now").alias("at"), F.lit(1).alias("real"), (F.col("_up").cast("long") - still.cast("long")).alias("more"), F.lit(0).cast("long").alias("out"))
    gone = F.struct(ends.alias("at"), F.lit(0).alias("real"), F.lit(-1).cast("long").alias("more"), F.lit(1).cast("long").alias("out"))
    events = spans.select("*", F.inline(F.when(over, F.array(mine, gone)).otherwise(F.array(mine))))
    order = Window.partitionBy("eid").orderBy("at", "real", "seq")
    counted = events.withColumns({"n_live": F.sum("more").over(order), "_out": F.sum("out").over(order)}).filter("real = 1")
    before = {"_then": F.lag("now").over(order), "_then_out": F.lag("_out").over(order)}
    held = F.coalesce(F.col("_was") & (F.col("_then") - F.col("_from") <= stale), F.lit(False))  # live after the user's row before
    ran_out = held & (F.col("now") - F.col("_from") > stale)
    turned = F.col("_then").isNull() | (F.col("_up") != held) | (F.col("_out") - F.col("_then_out") > ran_out.cast("long"))
    return counted.withColumns(before).select(*rows.columns, F.when(turned, "changed").otherwise("unchanged").alias("outcome"), F.when(F.col("n_live") > 0, "ONLINE").otherwise("OFFLINE").alias("user_status"), "n_live")


def idle_users(changes: DataFrame, stale: int = S.STALE_SECONDS) -> DataFrame:
    """changes(eid, now, seq, outcome) with idle: `stale` seconds passed without a change, which restarts that clock. It
    runs from the last restart and not from the row before, so no window gives it."""

    def step(state: dict, row: object) -> tuple:
        force = state.setdefault("force", row.now)
        idle = row.outcome == "unchanged" and row.now - force >= stale
        if idle or row.outcome == "changed":
            state["force"] = row.now
        return (idle,)

    return fold_sorted(changes, ["eid"], ["now", "seq"], "idle boolean", dict, step)


def heartbeat_step(state: dict, kind: str, now_ms: int) -> tuple[str | None, bool]:
    """A tick or pong of one device; returns the change outcome (if asked) and whether the device stops."""
    if not state:
        state.update(missed=0, counter=0, timer=now_ms, max_missed=S.INITIAL_MAX_MISSED, sent=None, status="ONLINE", activity=now_ms // 1000)
    now = now_ms // 1000
    change = lambda status: device_step(state, now, now, status, 2, S.STALE_SECONDS, S.REFRESH_SECONDS)
    if kind == "tick":
        if now - state["timer"] // 1000 > S.MAX_TICK_DELAY_SECONDS:
            state.clear()
            return "terminated", True
        if state["missed"] >= state["max_missed"]:
            state["missed"], state["sent"] = state["max_missed"], None
            return change("OFFLINE"), False
        outcome = None
        state["counter"] += 1
        if state["counter"] >= S.PONG_LIMIT:
            state["counter"], outcome = 0, change("ONLINE")
        state["missed"] += 1
        state["timer"] = state["sent"] = now_ms
        return outcome, False
    rtt = now_ms - state["sent"] if state["sent"] is not None else 0
    state["counter"] += 1
    outcome = None
    if state["counter"] >= S.PONG_LIMIT:
        state["counter"], state["missed"], outcome = 0, 1, change("ONLINE")
    else:
        state["missed"] = 0
        level = "high" if rtt > S.RTT_HIGH_MS else "low" if rtt < S.RTT_LOW_MS else "medium"
        state["max_missed"] = S.MAX_MISSED[level]
    state["timer"] = state["sent"] = now_ms
    return outcome, False


def heartbeats(rows: DataFrame) -> DataFrame:
    """rows(eid, device_id, now_ms, seq, kind) with kind tick or pong: outcome, stopped, missed, counter, max_missed, device_status after each."""

    def step(state: dict, row: object) -> tuple:
        outcome, stopped = heartbeat_step(state, row.kind, row.now_ms)
        return outcome, stopped, state.get("missed"), state.get("counter"), state.get("max_missed"), state.get("status")

    return fold_sorted(rows, KEY, ["now_ms", "seq"], "outcome string, stopped boolean, missed long, counter long, max_missed long, device_status string", dict, step)
