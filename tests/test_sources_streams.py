"""Codec, framed files, and streams against their batch folds."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulseline import schemas as S
from pulseline.operators import presence as P
from pulseline.sources import codec, framed_log
from pulseline.streaming import stateful


def drain(stream, name, spark):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@pytest.mark.skipif(not codec.available(), reason="no protobuf runtime")
def test_codec(spark):
    ping = bytes.fromhex("0803") + b"\x1a\x1f" + bytes.fromhex("0a0131") + b"\x12\x16\x0a\x0ca@domain.com\x12\x06aaaaa1" + b"\x18\x02" + b"\x20\x05"
    frames = spark.createDataFrame([(1, bytearray(ping)), (2, bytearray(b"")), (3, None), (4, bytearray(b"\x0a\xff")), (5, bytearray(b"\x08\x09"))], "n int, frame binary")
    rows = {r.n: r for r in codec.decode_frames(frames).collect()}
    assert set(rows) == {1, 4, 5}
    assert (rows[1].route, rows[1].kind, rows[1].ping_pong.to.eid, rows[1].ping_pong.type) == (3, "ping_pong", "a@domain.com", 2)
    assert [r.n for r in codec.served(codec.decode_frames(frames)).collect()] == [1]
    assert sorted(r.n for r in codec.quarantine(codec.decode_frames(frames)).collect()) == [4, 5]
    me = {"eid": "a", "connection_resource_id": "r"}
    row = ("7", me, me, 1, 2, 1, 1.5, 2.5, 5, None, 99, None)
    stanzas = spark.createDataFrame([(2, row)], f"route long, awareness struct<{S.AWARENESS}>")
    back = codec.decode_frames(codec.encode_frames(stanzas).select("frame")).first()
    assert (back.route, back.awareness.id, back.awareness.latitude, back.awareness.to.connection_resource_id, back.awareness.timestamp) == (2, "7", 1.5, "r", 99)


def test_framed_log(spark, tmp_path):
    made = spark.createDataFrame([(bytearray(b"one"),), (bytearray(b""),), (bytearray(b"three"),)], "body binary").select(framed_log.frame(F.col("body")).alias("f"))
    data = b"".join(bytes(r.f) for r in made.collect())
    (tmp_path / "good.seg").write_bytes(data)
    (tmp_path / "corrupt.seg").write_bytes(data[:-1] + b"X")
    (tmp_path / "short.seg").write_bytes(data[:-2])
    (tmp_path / "empty.seg").write_bytes(b"")
    rows = framed_log.read_framed(spark, str(tmp_path)).collect()
    by = {n: sorted((r.number, r.body and bytes(r.body), r.problem) for r in rows if r.path.endswith(n)) for n in ("good.seg", "corrupt.seg", "short.seg", "empty.seg")}
    assert [x[1] for x in by["good.seg"]] == [b"one", b"", b"three"]
    assert by["corrupt.seg"][-1] == (2, None, "checksum")
    assert by["short.seg"][-1] == (2, None, "short body")
    assert by["empty.seg"] == []


def events(spark, tmp_path, schema, rows, parts=3):
    for k in range(parts):  # in time order, one micro-batch each
        part = rows[k * len(rows) // parts : (k + 1) * len(rows) // parts]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_device_stream_equals_batch(spark, tmp_path):
    schema = "eid long, device_id int, now long, seq long, status string"
    rows = [(k % 3, k % 2, k * 97, k, "OFFLINE" if k % 11 == 0 else "ONLINE") for k in range(300)]
    got = drain(stateful.device_changes(events(spark, tmp_path, schema, rows)), "device_changes", spark)
    want = P.device_changes(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, got.select("seq", "outcome", "device_status").collect())) == sorted(map(tuple, want.select("seq", "outcome", "device_status").collect()))


def test_heartbeat_stream_equals_batch(spark, tmp_path):
    schema = "eid long, device_id int, now_ms long, seq long, kind string"
    rows = [(k % 2, 0, k * 9_000 + (200_000 if k > 150 else 0), k, "pong" if k % 5 == 0 else "tick") for k in range(240)]
    got = drain(stateful.heartbeats(events(spark, tmp_path, schema, rows)), "heartbeats", spark)
    want = P.heartbeats(spark.createDataFrame(rows, schema))
    assert sorted(map(str, got.select("seq", "outcome", "stopped").collect())) == sorted(map(str, want.select("seq", "outcome", "stopped").collect()))
    assert got.filter("stopped").count() == 2


def test_termination_timer(spark, tmp_path):
    schema = "eid long, device_id int, ts timestamp, status string"
    t = pd.Timestamp("2025-01-01")
    at = lambda s: (t + pd.Timedelta(seconds=s)).to_pydatetime()
    rows = [(1, 0, at(0), "ONLINE"), (1, 0, at(10), "OFFLINE"), (2, 0, at(20), "OFFLINE"), (2, 0, at(300), "ONLINE"), (3, 0, at(5000), "ONLINE"), (3, 0, at(5001), "ONLINE")]
    stream = events(spark, tmp_path, schema, rows, parts=6).withWatermark("ts", "0 seconds")
    got = drain(stateful.terminations(stream), "terminations", spark).collect()
    assert [(r.eid, r.terminated_at) for r in got] == [(1, at(610))]


def test_log_sink(spark, tmp_path):
    from pulseline.streaming.sinks import LogSink, frames_by_receiver

    schema = "eid string, partition_id int, payload string, seq long"
    rows = [("uv"[k % 2], 1, f"m{k}", k) for k in range(12)]
    sink = LogSink(spark, str(tmp_path / "log"), ["seq"])
    sink.start(events(spark, tmp_path, schema, rows), str(tmp_path / "check"), availableNow=True).awaitTermination()
    got = {(r.eid, r.offset): r.payload for r in sink.read().collect()}
    assert got == {("uv"[k % 2], k // 2 + 1): f"m{k}" for k in range(12)}
    last = spark.createDataFrame(rows[8:], schema)
    sink.write(last, 2)  # the last batch once more: same offsets, no new rows
    assert {(r.eid, r.offset): r.payload for r in sink.read().collect()} == got
    frames = spark.createDataFrame([("a", 2, bytearray(b"2")), ("a", 1, bytearray(b"1"))], "receiver string, n int, frame binary")
    assert [bytes(f) for f in frames_by_receiver(frames, ["n"]).first().frames] == [b"1", b"2"]
