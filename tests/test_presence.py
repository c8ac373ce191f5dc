"""Hand-written expectations for presence, change detection and heartbeats."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulseline.functions import columns as C
from pulseline.operators import devices as D
from pulseline.operators import presence as P

T = datetime(2025, 1, 1, 12)


def devices(spark, rows):
    data = [(e, d, s, T - timedelta(seconds=ago), i) for e, d, s, ago, i in rows]
    return spark.createDataFrame(data, "eid string, device_id string, status string, last_seen timestamp, awareness_intention int")


@pytest.mark.parametrize(
    ("rows", "status", "ids"),
    [
        ([("u", "d1", "ONLINE", 600, 2), ("u", "d2", "ONLINE", 601, 2)], "ONLINE", ["d1"]),
        ([("u", "d1", "ONLINE", 10, 1), ("u", "d2", "ONLINE", 5, 2)], "OFFLINE", []),
        ([("u", "d1", "AWAY", 5, 2)], "OFFLINE", []),
        ([("u", "d1", "ONLINE", 9, 2), ("u", "d2", "ONLINE", 3, None)], "ONLINE", ["d2", "d1"]),
    ],
)
def test_rollup(spark, rows, status, ids):
    row = P.presence_rollup(devices(spark, rows), F.lit(T)).first()
    assert (row.user_status, row.online_device_ids, row.live_devices) == (status, ids, len(ids))


def test_rollup_of_nothing(spark):
    assert P.presence_rollup(devices(spark, []), F.lit(T)).count() == 0


def test_strict_boundary(spark):
    d = devices(spark, [("u", "a", "ONLINE", 600, 2), ("u", "b", "ONLINE", 599, 2), ("u", "c", "OFFLINE", 1, 2)])
    assert [r.device_id for r in d.filter(D.active(F.col("status"), F.col("last_seen"), F.lit(T))).collect()] == ["b"]
    assert sorted(r.device_id for r in d.filter(D.live(F.col("status"), F.col("last_seen"), F.lit(T))).collect()) == ["a", "b"]


def test_whole_seconds(spark):
    r = spark.sql("SELECT timestamp'2025-01-01 00:00:00.9' a, timestamp'2025-01-01 00:00:02.1' b").select(C.seconds_between(F.col("b"), F.col("a")).alias("d")).first()
    assert r.d == 2


def test_refresh_clock_runs_from_last_emission(spark):
    steps = [(0, "ONLINE", "unchanged"), (100, "ONLINE", "unchanged"), (299, "ONLINE", "unchanged"), (300, "ONLINE", "refresh"), (500, "ONLINE", "unchanged"), (600, "ONLINE", "refresh"), (610, "OFFLINE", "changed")]
    rows = spark.createDataFrame([("u", "d", t, k, s) for k, (t, s, _) in enumerate(steps)], "eid string, device_id string, now long, seq long, status string")
    got = [r.outcome for r in P.device_changes(rows).orderBy("seq").collect()]
    assert got == [o for *_, o in steps]


def test_user_changes(spark):
    steps = [("a", 0, "OFFLINE", "changed", 0), ("a", 1, "OFFLINE", "unchanged", 0), ("a", 2, "ONLINE", "changed", 1), ("b", 3, "ONLINE", "changed", 2), ("a", 4, "ONLINE", "unchanged", 2), ("a", 5, "OFFLINE", "changed", 1), ("b", 6, "OFFLINE", "changed", 0)]
    rows = spark.createDataFrame([("u", d, t, t, s) for d, t, s, *_ in steps], "eid string, device_id string, now long, seq long, status string")
    got = [(r.outcome, r.n_live) for r in P.user_changes(rows).orderBy("seq").collect()]
    assert got == [(o, n) for *_, o, n in steps]


def test_fold_spans_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = spark.range(1000).selectExpr("'u' eid", "'d' device_id", "id * 100 now", "id seq", "'ONLINE' status")
        assert P.device_changes(rows).filter("outcome = 'refresh'").count() == 333
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def fold_users(rows, stale):
    """outcome, n_live, idle after each row (user, device, now, seq, status), one row at a time."""
    state, out = {}, []
    for user, device, now, seq, status in sorted(rows, key=lambda r: (r[2], r[3])):
        s = state.setdefault(user, {"devices": {}, "ids": None, "force": now})
        s["devices"][device] = (status, now)
        ids = sorted(d for d, (x, at) in s["devices"].items() if x == "ONLINE" and now - at <= stale)
        outcome = "changed" if ids != s["ids"] else "unchanged"
        idle = outcome == "unchanged" and now - s["force"] >= stale
        if idle or outcome == "changed":
            s["force"] = now
        s["ids"] = ids
        out.append((seq, outcome, "ONLINE" if ids else "OFFLINE", len(ids), idle))
    return sorted(out)


def test_user_changes_by_windows_are_those_of_a_fold(spark):
    rng = random.Random(3)
    rows = [(f"u{rng.randrange(6)}", f"d{rng.randrange(7)}", rng.randrange(500), k, rng.choice(["ONLINE", "ONLINE", "OFFLINE", "AWAY"])) for k in range(900)]
    frame = spark.createDataFrame(rows, "eid string, device_id string, now long, seq long, status string").repartition(3)
    out = P.user_changes(frame, 20)
    assert "Python" not in out._jdf.queryExecution().toString()
    got = sorted((r.seq, r.outcome, r.user_status, r.n_live, r.idle) for r in P.idle_users(out, 20).collect())
    assert got == fold_users(rows, 20)
    assert len({r[1:] for r in got}) > 8
    assert P.user_changes(frame.limit(0)).count() == 0


def test_heartbeat_steps():
    s = {}
    for t in range(0, 6 * 10_000, 10_000):
        assert P.heartbeat_step(s, "tick", t)[0] in (None, "unchanged")
    assert s["missed"] == 6
    assert P.heartbeat_step(s, "tick", 60_000) == ("changed", False)  # the limit of six missed pings: offline
    assert s["status"] == "OFFLINE"
    assert s["sent"] is None
    assert P.heartbeat_step(s, "tick", 200_000) == ("terminated", True)  # the timer stood still: too late
    assert not s
    s = {}
    P.heartbeat_step(s, "tick", 0)
    assert P.heartbeat_step(s, "pong", 700) == (None, False)
    assert (s["missed"], s["max_missed"], s["counter"]) == (0, 8, 2)
    for t in (710, 720):
        P.heartbeat_step(s, "pong", t)
    assert P.heartbeat_step(s, "pong", 730) == ("unchanged", False)
    assert (s["missed"], s["counter"], s["max_missed"]) == (1, 0, 3)


@pytest.mark.parametrize(("rtt", "interval", "missed"), [(99, 1000, 3), (100, 1000, 5), (500, 1000, 5), (501, 2000, 8), (None, 10_000, 5)])
def test_round_trip_buckets(spark, rtt, interval, missed):
    row = spark.createDataFrame([(rtt,)], "rtt long").select(C.ping_interval_ms(F.col("rtt")).alias("i"), C.max_missed(F.col("rtt")).alias("m")).first()
    assert (row.i, row.m) == (interval, missed)


def test_codes(spark):
    row = spark.sql("SELECT 'online' a, 'Offline' b, 'x' c, 13 d").select(C.status_code(F.col("a")), C.status_code(F.col("b")), C.status_code(F.col("c")), C.status_name(F.col("d")), C.legacy_status_code(F.lit("offline")), C.bearer_token(F.lit("Bearer t"))).first()
    assert tuple(row) == (1, 2, 0, "UNKNOWN", 4, "t")
