"""Keyed tables, log, queue, fan-out, validation."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pulseline import schemas as S
from pulseline.functions import stanzas as Z
from pulseline.operators import devices as D
from pulseline.operators import fanout
from pulseline.operators import log as L
from pulseline.sources import views as V
from pulseline.sources.table_store import TableStore

T = datetime(2025, 1, 1, 12)


def ids(df, column="msg_id"):
    return sorted(r[column] for r in df.collect())


def test_log_append_and_fetch(spark):
    empty = spark.createDataFrame([], "eid string, partition_id int, offset long, from string, to string, payload string")
    new = spark.createDataFrame([("u", 1, "alice", "bob", f"Hello {k}", k) for k in range(1, 6)], "eid string, partition_id int, from string, to string, payload string, seq int")
    log = L.append(empty, new, ["seq"])
    assert sorted((r.offset, r.payload) for r in log.collect()) == [(k, f"Hello {k}") for k in range(1, 6)]
    cursors = spark.createDataFrame([("u", 1, "d1", 0), ("u", 1, "d2", 3)], "eid string, partition_id int, device_id string, offset long")
    seen = []
    for _ in range(4):
        got = L.fetch(log, cursors, 2)
        seen.append(sorted((r.device_id, r.offset) for r in got.collect()))
        cursors = spark.createDataFrame(L.advance(cursors, got).collect(), "eid string, partition_id int, device_id string, offset long")
    assert seen == [[("d1", 1), ("d1", 2), ("d2", 4), ("d2", 5)], [("d1", 3), ("d1", 4)], [("d1", 5)], []]
    assert {r.offset for r in cursors.collect()} == {5}
    with pytest.raises(ValueError, match="negative"):
        L.fetch(log, cursors, -1)
    more = L.append(log.drop("seq"), new.withColumn("eid", F.lit("u")), ["seq"])
    assert sorted(r.offset for r in more.collect()) == [6, 7, 8, 9, 10]


def test_acks_are_marks(spark):
    log = spark.range(1, 6).selectExpr("'u' eid", "1 partition_id", "id offset")
    mark = spark.createDataFrame([("u", 1, "d1", 2)], "eid string, partition_id int, device_id string, offset long")
    acks = L.acknowledge(mark, mark)
    assert acks.count() == 1
    assert ids(L.unacked(log, acks, "d1"), "offset") == [1, 3, 4, 5]
    assert ids(L.unacked(log, acks, "d2"), "offset") == [1, 2, 3, 4, 5]


def test_queue(spark):
    empty = spark.createDataFrame([], "eid string, channel string, msg_id long, payload string")
    many = spark.range(1003).selectExpr("'u' eid", "'chat' channel", "cast(id as string) payload", "id seq")
    queue = L.enqueue(empty, many, ["seq"]).select("eid", "channel", "msg_id", "payload")
    assert ids(queue) == list(range(4, 1004))
    small = spark.range(1, 16).selectExpr("'u' eid", "'chat' channel", "id msg_id", "'x' payload").union(spark.sql("SELECT 'u', 'note', 1L, 'y'"))
    ack = lambda k: spark.createDataFrame([("u", "chat", k)], "eid string, channel string, msg_id long")
    left = L.ack_queue(small, ack(5))
    assert ids(left) == [1, *range(6, 16)]
    assert ids(L.ack_queue(left, ack(6))) == [1, *range(7, 16)]
    assert ids(L.ack_queue(left, ack(99))) == ids(left)
    assert ids(L.prune_sparse(small.filter("msg_id % 2 = 0"), 3)) == [10, 12, 14]


def test_fanout(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "b")], "owner_id string, subscriber_id string")
    events = spark.createDataFrame([("a", 1, 1, "b"), ("a", 2, 3, "b"), ("a", 3, 6, "b"), ("a", 4, 13, "b")], "eid string, event_id long, status int, to_eid string")
    got = fanout.group(events, edges)
    assert sorted((r.receiver, r.event_id) for r in got.collect()) == [("b", 1), ("b", 2), ("c", 1), ("c", 2)]
    users = spark.createDataFrame([("b",)], "eid string")
    assert sorted((r.receiver, r.event_id) for r in fanout.group(events, edges, users).collect()) == [("b", 1), ("b", 2)]
    assert sorted((r.receiver, r.event_id) for r in fanout.undelivered(got, users).collect()) == [("c", 1), ("c", 2)]
    up = spark.createDataFrame([("b", "d1", "ONLINE", T), ("b", "d2", "OFFLINE", T), ("c", "d3", "ONLINE", T)], "eid string, device_id string, status string, last_seen timestamp")
    assert sorted((r.event_id, r.to_device) for r in fanout.to_devices(got, up, F.lit(T)).collect()) == [(1, "d1"), (1, "d3")]  # away is dropped by receivers
    assert [(r.receiver, r.event_id) for r in fanout.peer(events).collect()] == [("b", 3)]
    assert fanout.ping_refresh_receivers(fanout.ping_refreshes(events.limit(1)), edges).count() == 2


def test_fanout_counts_of_a_hot_sender(spark):
    """group_counts() is group() counted by receiver, and joins one row for each sender."""
    edges = spark.createDataFrame([(o, s) for o in range(30) for s in range(3)] + [(None, 1), (5, None)], "owner_id long, subscriber_id long")
    events = spark.createDataFrame([(0 if k % 3 else k % 5, k, k % 8) for k in range(3000)] + [(None, 1, 1)], "eid long, event_id long, status int")
    users = spark.createDataFrame([(k,) for k in range(0, 60, 2)], "eid long")
    for known in (None, users):
        want = fanout.group(events, edges, known).groupBy("receiver").agg(F.count("*").alias("events"), F.min("event_id").alias("first_event"))
        assert sorted(map(str, fanout.group_counts(events, edges, known).collect())) == sorted(map(str, want.collect()))


def test_edges_are_dealt_by_rows(spark, sf_dir, monkeypatch):
    """No partition of edges holds many times the rows meant for it, however small the rows are once compressed."""
    monkeypatch.setattr(V, "LINES", 300)
    for by in (("owner_id", "subscriber_id"), ("owner_id",)):
        sizes = [r["count"] for r in V.edges(spark, sf_dir, by).groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert len(sizes) > 15 and sum(sizes) == V.edges(spark, sf_dir).count() and max(sizes) < 1500


def awareness(spark, **change):
    me = {"eid": "a", "connection_resource_id": "r"}
    row = {"id": "1", "from": me, "to": me, "type": 1, "status": 1, "location_sharing": 2, "latitude": None, "longitude": None, "ttl": 5, "details": None, "timestamp": 1, "node": None} | change
    return spark.createDataFrame([tuple(row.values())], S.AWARENESS).select(Z.awareness_error().alias("e")).first().e


@pytest.mark.parametrize(
    ("change", "field"),
    [
        ({}, None), ({"id": ""}, "id"), ({"id": None}, "id"), ({"from": None}, "from"), ({"from": {"eid": "a", "connection_resource_id": ""}}, "from.connection_resource_id"), ({"to": None}, "to"),
        ({"type": 2}, "type"), ({"status": 0}, "status"), ({"status": 12}, "status"), ({"status": None}, "status"), ({"location_sharing": 3}, "location_sharing"), ({"location_sharing": 1}, "coordinates"),
        ({"ttl": 0}, "ttl"), ({"timestamp": 0}, "timestamp"), ({"timestamp": None}, "timestamp"), ({"id": "", "ttl": 0}, "id"), ({"from": {"eid": None, "connection_resource_id": "r"}}, None),
    ],
)
def test_awareness_rules(spark, change, field):
    e = awareness(spark, **change)
    assert (e and e.field, e and e.code) == (field, field and 100)


@pytest.mark.parametrize(("change", "code", "field"), [({}, None, None), ({"timestamp": -1}, None, None), ({"timestamp": 0}, 100, "timestamp"), ({"type": 2}, 100, "type"), ({"type": 9}, 100, "type"), ({"to": {"eid": "b", "connection_resource_id": "r"}}, 401, "to"), ({"id": None}, 100, "id")])
def test_ping_rules(spark, change, code, field):
    row = {"id": "1", "to": {"eid": "a", "connection_resource_id": "r"}, "type": 1, "timestamp": 5, "details": None} | change
    e = spark.createDataFrame([tuple(row.values())], S.PING_PONG).select(Z.ping_error(F.lit("a"), F.lit("r")).alias("e")).first().e
    assert (e and e.code, e and e.field) == (code, field)


@pytest.mark.parametrize(("change", "code"), [({}, None), ({"to": None}, 100), ({"to": {"eid": "b", "connection_resource_id": "r"}}, 101), ({"to": {"eid": "a", "connection_resource_id": "x"}}, 102), ({"type": 2}, 103), ({"status": 1}, 104), ({"timestamp": 0}, 105)])
def test_logout_rules(spark, change, code):
    row = {"to": {"eid": "a", "connection_resource_id": "r"}, "type": 1, "status": 4, "timestamp": 5, "details": None} | change
    e = spark.createDataFrame([tuple(row.values())], S.LOGOUT).select(Z.logout_error(F.lit("a"), F.lit("r")).alias("e")).first().e
    assert (e and e.code) == code


def test_responses(spark):
    row = spark.range(1).select(
        Z.pong_stanza(F.lit("a"), F.lit("r"), F.lit(9)).alias("pong"), Z.pong_stanza(F.lit("a"), F.lit("r"), F.lit(9), F.lit("bad")).alias("error"),
        Z.logout_stanza(F.lit("a"), F.lit("r"), 3, F.lit(9)).alias("logout"), Z.awareness_error_stanza(F.lit("a"), F.lit("r"), F.lit("d"), F.lit(9)).alias("aware"), Z.error_stanza(F.lit(503), 2, F.lit("gone"), F.lit(9)).alias("e"),
    ).first()
    assert (row.pong.type, row.error.type, row.error.details, row.logout.status, row.aware.status, row.e.error_origin) == (2, 3, "bad", 3, 0, 2)


def test_sessions_and_patches(spark):
    schema = "eid string, device_id string, status string, status_source string, os string, last_offset long, last_seen timestamp, last_activity timestamp"
    old = spark.createDataFrame([("u", "d1", "OFFLINE", "PONG", "ios", 7, None, None)], schema)
    login = spark.createDataFrame([("u", "d1", "ONLINE", "android", 0), ("u", "d2", "ONLINE", "web", 0)], "eid string, device_id string, status string, os string, last_offset long")
    after = {r.device_id: r for r in D.upsert_sessions(old, login, F.lit(T)).collect()}
    assert (after["d1"].os, after["d1"].last_offset, after["d1"].status_source) == ("android", 7, "LOGIN")
    assert (after["d2"].last_offset, after["d2"].last_seen) == (0, T)
    patch = spark.createDataFrame([("u", "d1", "AWAY", "PONG", T), ("u", "zz", "AWAY", "PONG", T)], "eid string, device_id string, status string, source string, at timestamp")
    row = D.patch_status(old, patch).first()
    assert (row.status, row.last_activity, row.found, row.last_offset) == ("AWAY", T, True, 7)
    assert [r.device_id for r in D.unknown_patches(old, patch).collect()] == ["zz"]
    assert D.delete_devices(old, patch).count() == 0
    assert D.set_offset(old, spark.createDataFrame([("u", "d1", 9)], "eid string, device_id string, offset long")).first().last_offset == 9


def test_subscribers_and_awareness(spark):
    rows = spark.createDataFrame([("a", "b", "online", True, T, None), ("a", "c", "online", False, T, None)], S.SUBSCRIBERS)
    up = D.update_subscribers(rows, spark.createDataFrame([("a", "b", "offline")], "owner_id string, subscriber_id string, status string"), F.lit(T))
    row = {r.subscriber_id: r for r in up.collect()}
    assert (row["b"].status, row["b"].blocked, row["b"].inserted_at, row["c"].status) == ("offline", False, T, "online")
    assert D.add_subscribers(rows, rows.limit(1)).count() == 2
    assert sorted(r[0] for r in D.subscriber_ids(rows, "a").collect()) == ["b", "c"]
    changes = spark.createDataFrame([("u", 1, T, 0), ("v", 1, T, 0), ("v", 3, T, 1)], "eid string, awareness int, ts timestamp, seq long")
    assert {r.eid: r.awareness for r in D.upsert_awareness(changes).collect()} == {"u": 2, "v": 3}


def test_revocation(spark):
    tokens = spark.createDataFrame([("x", datetime(2025, 1, 1, 13)), ("y", datetime(2025, 1, 1, 11))], S.REVOKED)
    written = D.revoke(tokens, F.lit(T))
    assert [r.jti for r in written.collect()] == ["x"]
    assert [r.jti for r in D.not_revoked(spark.createDataFrame([("x",), ("y",)], "jti string"), written, F.lit(T)).collect()] == ["y"]


def test_table_store(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    with pytest.raises(LookupError):
        store.read("acks")
    store.create_if_missing("acks", S.ACKS)
    store.create_if_missing("acks", S.ACKS)
    assert store.read("acks").count() == 0
    store.replace("acks", store.read("acks").union(spark.createDataFrame([("u", "d", 1, 5)], S.ACKS)))
    store.replace("acks", store.read("acks").withColumn("offset", F.col("offset") + 1))
    assert store.lookup("acks", F.col("eid") == "u").first().offset == 6


def test_coordinates_are_numbers(spark):
    row = lambda lat, lon, share=1: ("i", ("a", "r"), ("b", "s"), 1, 1, share, lat, lon, 1, "", 1, 0)
    nan = float("nan")
    rows = spark.createDataFrame([row(1.0, 2.0), row(nan, 2.0), row(1.0, nan), row(None, nan), row(nan, nan, 2)], S.AWARENESS)
    got = [(r.e.field, r.e.description) if r.e else None for r in rows.select(Z.awareness_error().alias("e")).collect()]
    odd = ("coordinates", "Latitude and Longitude must be numeric when sharing is enabled")
    assert got == [None, odd, odd, ("coordinates", "Latitude and Longitude required when sharing is enabled"), None]
