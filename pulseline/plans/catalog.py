"""Registry of the presence and messaging queries, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseline.functions import columns as C
from pulseline.functions import stanzas as Z
from pulseline.operators import devices as D
from pulseline.operators import fanout, presence
from pulseline.operators import log as L
from pulseline.sources import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Threshold of snapshot queries in seconds: the test events are hours apart.
STALE, REFRESH = 86_400, 3_000


def query(sql: str | None = None):  # noqa: ANN201
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _with(*views: str) -> str:
    return "WITH " + ",\n".join(views)


CLOCK_SQL = "clock AS (SELECT max(ts) AS as_of FROM events)"
SNAPSHOT_SQL = """snapshot AS (
  SELECT eid, device_id, CASE WHEN status = 2 THEN 'OFFLINE' ELSE 'ONLINE' END AS status, ts AS last_seen
  FROM (SELECT *, row_number() OVER (PARTITION BY eid, device_id ORDER BY ts DESC, event_id DESC) AS n FROM stanzas) WHERE n = 1)"""
ONLINE_SQL = f"(status = 'ONLINE' AND datediff('second', last_seen, as_of) <= {STALE})"
STATUS_SQL = "CASE {0} WHEN 1 THEN 'ONLINE' WHEN 2 THEN 'OFFLINE' WHEN 3 THEN 'AWAY' WHEN 4 THEN 'BUSY' WHEN 5 THEN 'DND' WHEN 6 THEN 'TYPING' WHEN 7 THEN 'RECORDING' WHEN 8 THEN 'FORWARDED' WHEN 9 THEN 'DELIVERED' WHEN 10 THEN 'READ' WHEN 11 THEN 'RESUME' ELSE 'UNKNOWN' END"


def _clock(spark: SparkSession, sf_dir: str) -> Column:
    """The latest event time, as a scalar subquery."""
    return V.as_of(V.table(spark, sf_dir, "events")).scalar()


def _clocked(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return df.withColumn("as_of", _clock(spark, sf_dir))


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presence.device_snapshot(V.stanzas(spark, sf_dir))


def _text(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")


# ---- devices and presence ------------------------------------------------------------------------------------------


@query(_with(V.STANZAS_SQL, SNAPSHOT_SQL, CLOCK_SQL) + f"""
SELECT eid, CASE WHEN count(*) FILTER ({ONLINE_SQL}) > 0 THEN 'ONLINE' ELSE 'OFFLINE' END AS user_status,
       CAST(count(*) FILTER ({ONLINE_SQL}) AS BIGINT) AS live_devices,
       coalesce(string_agg(CAST(device_id AS VARCHAR), ',' ORDER BY last_seen DESC, device_id DESC) FILTER ({ONLINE_SQL}), '') AS online_devices,
       max(last_seen) AS last_seen
FROM snapshot, clock GROUP BY eid""")
def presence_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup(_snapshot(spark, sf_dir), _clock(spark, sf_dir))


def _rollup(devices: DataFrame, clock: Column) -> DataFrame:
    out = presence.presence_rollup(devices, clock, STALE)
    return out.select("eid", "user_status", "live_devices", _text(F.col("online_device_ids")).alias("online_devices"), "last_seen")


@query(_with(V.STANZAS_SQL, SNAPSHOT_SQL, CLOCK_SQL, "h AS (SELECT *, CASE WHEN device_id = 0 AND eid % 5 = 0 THEN 1 ELSE 2 END AS intention FROM snapshot)") + f"""
SELECT eid, CASE WHEN min(intention) > 1 AND count(*) FILTER ({ONLINE_SQL}) > 0 THEN 'ONLINE' ELSE 'OFFLINE' END AS user_status,
       CAST(CASE WHEN min(intention) > 1 THEN count(*) FILTER ({ONLINE_SQL}) ELSE 0 END AS BIGINT) AS live_devices,
       CASE WHEN min(intention) > 1 THEN coalesce(string_agg(CAST(device_id AS VARCHAR), ',' ORDER BY last_seen DESC, device_id DESC) FILTER ({ONLINE_SQL}), '') ELSE '' END AS online_devices,
       max(last_seen) AS last_seen
FROM h, clock GROUP BY eid""")
def presence_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roll-up where device 0 of every fifth user hides the user."""
    devices = _snapshot(spark, sf_dir).withColumn("awareness_intention", F.when((F.col("device_id") == 0) & (F.col("eid") % 5 == 0), 1).otherwise(2))
    return _rollup(devices, _clock(spark, sf_dir))


@query(_with(V.STANZAS_SQL, SNAPSHOT_SQL) + " SELECT * FROM snapshot")
def device_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presence.device_snapshot(V.stanzas(spark, sf_dir))


@query(_with(V.STANZAS_SQL, SNAPSHOT_SQL, CLOCK_SQL) + f" SELECT eid, device_id, last_seen FROM snapshot, clock WHERE {ONLINE_SQL}")
def active_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshot(spark, sf_dir).filter(D.live(F.col("status"), F.col("last_seen"), _clock(spark, sf_dir), STALE)).select("eid", "device_id", "last_seen")


@query(_with(V.STANZAS_SQL, SNAPSHOT_SQL, CLOCK_SQL) + f" SELECT eid, device_id, last_seen FROM snapshot, clock WHERE status = 'ONLINE' AND last_seen > as_of - INTERVAL {STALE} SECOND")
def active_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshot(spark, sf_dir).filter(D.active(F.col("status"), F.col("last_seen"), _clock(spark, sf_dir), STALE)).select("eid", "device_id", "last_seen")


@query(_with(V.STANZAS_SQL, SNAPSHOT_SQL) + " SELECT eid, bool_or(status = 'ONLINE') AS any_online FROM snapshot GROUP BY eid")
def any_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presence.device_snapshot(V.stanzas(spark, sf_dir)).groupBy("eid").agg(F.bool_or(F.col("status") == "ONLINE").alias("any_online"))


@query(_with(V.STANZAS_SQL) + " SELECT eid, string_agg(CAST(device_id AS VARCHAR), ',' ORDER BY device_id) AS device_ids FROM (SELECT DISTINCT eid, device_id FROM stanzas) GROUP BY eid")
def device_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.device_ids(V.stanzas(spark, sf_dir)).select("eid", _text(F.col("device_ids")).alias("device_ids"))


@query(_with(V.STANZAS_SQL, SNAPSHOT_SQL, CLOCK_SQL) + f"""
SELECT eid, CAST(greatest({STALE} - datediff('second', max(last_seen), max(as_of)), 0) AS BIGINT) AS seconds_left
FROM snapshot, clock GROUP BY eid HAVING NOT bool_or(status = 'ONLINE')""")
def grace_deadline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presence.grace_deadlines(_snapshot(spark, sf_dir), _clock(spark, sf_dir), STALE)


PATCHED_SQL = "odd AS (SELECT eid, device_id, max(ts) AS at FROM stanzas WHERE status = 2 GROUP BY ALL)"


@query(_with(V.STANZAS_SQL, SNAPSHOT_SQL, PATCHED_SQL) + """
SELECT s.eid, s.device_id, CASE WHEN o.at IS NULL THEN s.status ELSE 'AWAY' END AS status, CASE WHEN o.at IS NULL THEN 'LOGIN' ELSE 'PONG' END AS status_source,
       o.at AS last_activity, coalesce(o.at, s.last_seen) AS last_seen, o.at IS NOT NULL AS found
FROM snapshot s LEFT JOIN odd o ON s.eid = o.eid AND s.device_id = o.device_id""")
def device_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    stanzas = V.stanzas(spark, sf_dir)
    devices = presence.device_snapshot(stanzas).withColumns({"status_source": F.lit("LOGIN"), "last_activity": F.lit(None).cast("timestamp_ntz")})
    patches = stanzas.filter("status = 2").groupBy("eid", "device_id").agg(F.max("ts").alias("at")).withColumns({"status": F.lit("AWAY"), "source": F.lit("PONG")})
    return D.patch_status(devices, patches).select("eid", "device_id", "status", "status_source", "last_activity", "last_seen", "found")


@query(_with(V.STANZAS_SQL, SNAPSHOT_SQL) + " SELECT * FROM snapshot WHERE status <> 'OFFLINE'")
def device_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices whose last stanza took them offline are deleted."""
    devices = _snapshot(spark, sf_dir)
    return D.delete_devices(devices, devices.filter("status = 'OFFLINE'"))


@query(_with(V.STANZAS_SQL, """logins AS (SELECT eid, device_id, max(event_id) AS last_offset, CAST(max(rtt_ms) AS VARCHAR) AS os FROM stanzas WHERE status = 1 GROUP BY ALL)""",
             "old AS (SELECT eid, device_id, min(event_id) AS last_offset, 'old' AS os FROM stanzas WHERE status <> 1 GROUP BY ALL)", CLOCK_SQL) + """
SELECT eid, device_id, CASE WHEN l.eid IS NOT NULL THEN 'ONLINE' ELSE 'OFFLINE' END AS status, CASE WHEN l.eid IS NOT NULL THEN 'LOGIN' ELSE 'PONG' END AS status_source,
       coalesce(l.os, o.os) AS os, coalesce(o.last_offset, l.last_offset) AS last_offset, CASE WHEN l.eid IS NOT NULL THEN as_of END AS last_seen
FROM (old o FULL JOIN logins l USING (eid, device_id)), clock""")
def session_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logins (signup stanzas) upserted into devices known from other stanzas."""
    stanzas = V.stanzas(spark, sf_dir)
    old = stanzas.filter("status <> 1").groupBy("eid", "device_id").agg(F.min("event_id").alias("last_offset"))
    old = old.select("eid", "device_id", F.lit("OFFLINE").alias("status"), F.lit("PONG").alias("status_source"), F.lit("old").alias("os"), "last_offset", F.lit(None).cast("timestamp_ntz").alias("last_seen"))
    new = stanzas.filter("status = 1").groupBy("eid", "device_id").agg(F.max("event_id").alias("last_offset"), F.max("rtt_ms").cast("string").alias("os"))
    return D.upsert_sessions(old, new.withColumn("status", F.lit("ONLINE")), _clock(spark, sf_dir))


@query(_with(V.STANZAS_SQL) + " SELECT eid, CAST(CASE WHEN count(*) = 1 THEN 2 ELSE max_by(status, (ts, event_id)) END AS INT) AS awareness, max(ts) AS updated_at FROM stanzas GROUP BY eid")
def awareness_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.upsert_awareness(V.stanzas(spark, sf_dir).select("eid", F.col("status").alias("awareness"), "ts", F.col("event_id").alias("seq")))


CHANGE_SQL = f"""
WITH RECURSIVE {V.STANZAS_SQL},
r AS (SELECT eid, device_id, event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS now, CASE WHEN status = 2 THEN 'OFFLINE' ELSE 'ONLINE' END AS cur,
             row_number() OVER (PARTITION BY eid, device_id ORDER BY date_trunc('second', ts), event_id) AS n FROM stanzas),
f AS (
  SELECT eid, device_id, event_id, n, cur AS device_status, now AS activity, CASE WHEN cur <> 'ONLINE' THEN 'changed' WHEN 0 >= {REFRESH} THEN 'refresh' ELSE 'unchanged' END AS outcome
  FROM r WHERE n = 1
  UNION ALL
  SELECT r.eid, r.device_id, r.event_id, r.n, r.cur, CASE WHEN r.cur <> f.device_status OR r.now - f.activity >= {REFRESH} THEN r.now ELSE f.activity END,
         CASE WHEN r.cur <> f.device_status THEN 'changed' WHEN r.now - f.activity >= {REFRESH} THEN 'refresh' ELSE 'unchanged' END
  FROM f JOIN r ON r.eid = f.eid AND r.device_id = f.device_id AND r.n = f.n + 1)
SELECT eid, device_id, event_id, outcome, device_status FROM f"""


@query(CHANGE_SQL)
def device_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presence.stanza_device_changes(V.stanzas(spark, sf_dir), REFRESH).select("eid", "device_id", F.col("seq").alias("event_id"), "outcome", "device_status")


_LAST = "last_value(CASE WHEN device_id = {d} THEN {v} END IGNORE NULLS) OVER (PARTITION BY eid ORDER BY now, event_id)"
USER_SQL = _with(V.STANZAS_SQL, "r AS (SELECT *, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS now, CASE WHEN status = 2 THEN 0 ELSE 1 END AS up FROM stanzas)") + f""",
s AS (SELECT eid, event_id, now, {", ".join(f"{_LAST.format(d=d, v='up')} AS u{d}, {_LAST.format(d=d, v='now')} AS t{d}" for d in range(3))} FROM r),
l AS (SELECT eid, event_id, now, {" || ".join(f"CASE WHEN u{d} = 1 AND now - t{d} <= {STALE} THEN '{d}' ELSE '' END" for d in range(3))} AS ids FROM s)
SELECT eid, event_id, CASE WHEN ids = '' THEN 'OFFLINE' ELSE 'ONLINE' END AS user_status, CAST(length(ids) AS BIGINT) AS n_live,
       CASE WHEN ids IS DISTINCT FROM lag(ids) OVER (PARTITION BY eid ORDER BY now, event_id) THEN 'changed' ELSE 'unchanged' END AS outcome
FROM l"""


@query(USER_SQL)
def user_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.stanzas(spark, sf_dir).select("eid", "device_id", C.epoch(F.col("ts")).alias("now"), F.col("event_id").alias("seq"), C.presence_status(F.col("status")).alias("status"))
    return presence.user_changes(rows, STALE).select("eid", F.col("seq").alias("event_id"), "user_status", "n_live", "outcome")


IDLE_SQL = f"""
WITH RECURSIVE c AS ({USER_SQL}),
o AS (SELECT c.*, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS now, row_number() OVER (PARTITION BY c.eid ORDER BY date_trunc('second', ts), c.event_id) AS n
      FROM c JOIN (SELECT event_id, ts FROM events) USING (event_id)),
f AS (
  SELECT eid, event_id, user_status, n, now AS force, false AS idle FROM o WHERE n = 1
  UNION ALL
  SELECT o.eid, o.event_id, o.user_status, o.n, CASE WHEN o.outcome = 'changed' OR o.now - f.force >= {STALE} THEN o.now ELSE f.force END, o.outcome = 'unchanged' AND o.now - f.force >= {STALE}
  FROM f JOIN o ON o.eid = f.eid AND o.n = f.n + 1)
SELECT eid, event_id, user_status FROM f WHERE idle"""


@query(IDLE_SQL)
def idle_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stanzas at which an unchanged user has been idle long enough to be announced again."""
    rows = V.stanzas(spark, sf_dir).select("eid", "device_id", C.epoch(F.col("ts")).alias("now"), F.col("event_id").alias("seq"), C.presence_status(F.col("status")).alias("status"))
    changes = presence.user_changes(rows, STALE).select("eid", "now", "seq", "outcome", "user_status")
    return presence.idle_users(changes, STALE).filter("idle").select("eid", F.col("seq").alias("event_id"), "user_status")


#: One step a row; row 0 of a device is a state that has ended, from which every row starts anew.
HEARTBEAT_SQL = f"""
WITH RECURSIVE {V.STANZAS_SQL},
r AS (SELECT eid, device_id, event_id AS seq, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS now_ms, CASE WHEN status = 6 THEN 'tick' ELSE 'pong' END AS kind,
             row_number() OVER (PARTITION BY eid, device_id ORDER BY date_trunc('second', ts), event_id) AS n FROM stanzas),
f AS (
  SELECT DISTINCT eid, device_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS now_ms, CAST(NULL AS BIGINT) AS seq, '' AS kind, CAST(NULL AS VARCHAR) AS outcome, true AS stopped,
         CAST(NULL AS BIGINT) AS missed, CAST(NULL AS BIGINT) AS counter, CAST(NULL AS BIGINT) AS max_missed, CAST(NULL AS VARCHAR) AS device_status,
         CAST(NULL AS BIGINT) AS timer, CAST(NULL AS BIGINT) AS sent, CAST(NULL AS BIGINT) AS activity FROM r
  UNION ALL
  SELECT eid, device_id, n, now_ms, seq, kind, outcome, b = 'end',
         CASE b WHEN 'end' THEN NULL WHEN 'off' THEN m WHEN 'pong' THEN 0 WHEN 'pong_on' THEN 1 ELSE missed + 1 END,
         CASE b WHEN 'end' THEN NULL WHEN 'off' THEN counter WHEN 'tick' THEN counter + 1 WHEN 'pong' THEN counter + 1 ELSE 0 END,
         CASE b WHEN 'end' THEN NULL WHEN 'pong' THEN CASE WHEN coalesce(now_ms - sent, 0) > 500 THEN 8 WHEN coalesce(now_ms - sent, 0) < 100 THEN 3 ELSE 5 END ELSE m END,
         CASE WHEN b <> 'end' THEN coalesce(want, status) END,
         CASE WHEN b = 'off' THEN timer WHEN b <> 'end' THEN now_ms END, CASE WHEN b NOT IN ('end', 'off') THEN now_ms END,
         CASE WHEN b = 'end' THEN NULL WHEN outcome IN ('changed', 'refresh') THEN now_ms // 1000 ELSE activity END
  FROM (
    SELECT *, CASE WHEN b = 'end' THEN 'terminated' WHEN want IS NULL THEN NULL WHEN status <> want THEN 'changed' WHEN now_ms // 1000 - activity >= 300 THEN 'refresh' ELSE 'unchanged' END AS outcome
    FROM (
      SELECT *, CASE WHEN b = 'off' THEN 'OFFLINE' WHEN b IN ('tick_on', 'pong_on') THEN 'ONLINE' END AS want
      FROM (
        SELECT *, CASE WHEN kind = 'tick' AND now_ms // 1000 - timer // 1000 > 120 THEN 'end' WHEN kind = 'tick' AND missed >= m THEN 'off'
                       WHEN counter + 1 >= 5 THEN kind || '_on' ELSE kind END AS b
        FROM (
          SELECT r.*, CASE WHEN f.stopped THEN 0 ELSE f.missed END AS missed, CASE WHEN f.stopped THEN 0 ELSE f.counter END AS counter, CASE WHEN f.stopped THEN 6 ELSE f.max_missed END AS m,
                 CASE WHEN f.stopped THEN r.now_ms ELSE f.timer END AS timer, CASE WHEN NOT f.stopped THEN f.sent END AS sent, CASE WHEN f.stopped THEN 'ONLINE' ELSE f.device_status END AS status,
                 CASE WHEN f.stopped THEN r.now_ms // 1000 ELSE f.activity END AS activity
          FROM f JOIN r ON r.eid = f.eid AND r.device_id = f.device_id AND r.n = f.n + 1)))))
SELECT eid, device_id, now_ms, seq, kind, outcome, stopped, missed, counter, max_missed, device_status FROM f WHERE n > 0"""


@query(HEARTBEAT_SQL)
def heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks (views) and pongs (other events) of each device, time run a thousand times faster."""
    rows = V.stanzas(spark, sf_dir).select("eid", "device_id", C.epoch(F.col("ts")).alias("now_ms"), F.col("event_id").alias("seq"), F.when(F.col("status") == 6, "tick").otherwise("pong").alias("kind"))
    return presence.heartbeats(rows)


@query(_with(V.STANZAS_SQL, f"""g AS (SELECT *, CASE WHEN coalesce(datediff('second', lag(ts) OVER w, ts) > {STALE}, true) THEN 1 ELSE 0 END AS fresh FROM stanzas WINDOW w AS (PARTITION BY eid, device_id ORDER BY ts, event_id))""") + """
SELECT eid, device_id, session, min(ts) AS started, max(ts) AS ended, count(*) AS stanzas
FROM (SELECT *, CAST(sum(fresh) OVER (PARTITION BY eid, device_id ORDER BY ts, event_id) AS BIGINT) AS session FROM g) GROUP BY eid, device_id, session""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.session_starts(V.stanzas(spark, sf_dir), STALE)
    return rows.groupBy("eid", "device_id", "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("stanzas"))


@query(_with(V.STANZAS_SQL, CLOCK_SQL, f"""g AS (SELECT *, CASE WHEN coalesce(datediff('second', lag(ts) OVER w, ts) > {STALE} OR lag(status) OVER w = 2, true) THEN 1 ELSE 0 END AS fresh FROM stanzas WINDOW w AS (PARTITION BY eid, device_id ORDER BY ts, event_id))""") + f"""
SELECT eid, device_id, session, min(ts) AS started, max(ts) AS ended,
       CASE WHEN max_by(status, (ts, event_id)) = 2 THEN 'closed' WHEN datediff('second', max(ts), max(as_of)) > {STALE} THEN 'timeout' ELSE 'open' END AS ended_by
FROM (SELECT *, CAST(sum(fresh) OVER (PARTITION BY eid, device_id ORDER BY ts, event_id) AS BIGINT) AS session FROM g), clock GROUP BY eid, device_id, session""")
def session_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.session_ends(V.stanzas(spark, sf_dir), STALE, F.col("status") == 2, _clock(spark, sf_dir))


# ---- codes, buckets, routing ---------------------------------------------------------------------------------------


@query(_with(V.STANZAS_SQL) + f" SELECT event_id, {STATUS_SQL.format('status + 0')} AS name, {STATUS_SQL.format('status + 1')} AS next_name, CAST(CASE {STATUS_SQL.format('status')} WHEN 'ONLINE' THEN 1 WHEN 'OFFLINE' THEN 2 ELSE 0 END AS INT) AS code FROM stanzas")
def status_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = C.status_name(F.col("status"))
    return V.stanzas(spark, sf_dir).select("event_id", name.alias("name"), C.status_name(F.col("status") + 1).alias("next_name"), C.status_code(name).alias("code"))


@query(_with(V.STANZAS_SQL) + """
SELECT CAST(CASE WHEN rtt_ms > 500 THEN 2000 ELSE 1000 END AS INT) AS interval_ms, CAST(CASE WHEN rtt_ms > 500 THEN 8 WHEN rtt_ms < 100 THEN 3 ELSE 5 END AS INT) AS max_missed, count(*) AS n
FROM stanzas GROUP BY ALL""")
def rtt_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.stanzas(spark, sf_dir)
    return s.groupBy(C.ping_interval_ms(F.col("rtt_ms")).alias("interval_ms"), C.max_missed(F.col("rtt_ms")).alias("max_missed")).agg(F.count("*").alias("n"))


@query(_with(V.STANZAS_SQL) + f"""
SELECT event_id, CASE WHEN status BETWEEN 1 AND 5 THEN 'group' WHEN status BETWEEN 6 AND 11 THEN 'peer' ELSE 'dropped' END AS route,
       CASE WHEN status BETWEEN 1 AND 5 THEN {STATUS_SQL.format('status')} WHEN status BETWEEN 6 AND 11 THEN 'ONLINE' END AS sender_status,
       CASE WHEN event_id % 14 BETWEEN 1 AND 2 OR event_id % 14 BETWEEN 6 AND 11 THEN 'fan_out' WHEN event_id % 14 = 12 THEN 'update' ELSE 'dropped' END AS receiver,
       CASE event_id % 5 WHEN 2 THEN 'awareness' WHEN 3 THEN 'ping_pong' ELSE 'dropped' END AS inbound
FROM stanzas""")
def route_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.stanzas(spark, sf_dir)
    return s.select("event_id", C.send_route(F.col("status")).alias("route"), C.sender_status(F.col("status")).alias("sender_status"), C.receive_action(F.col("event_id") % 14).alias("receiver"), C.stanza_route(F.col("event_id") % 5).alias("inbound"))


# ---- validation ----------------------------------------------------------------------------------------------------


def _identity(eid: Column, device: Column) -> Column:
    return F.struct(eid.cast("string").alias("eid"), device.alias("connection_resource_id"))


def _faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Awareness stanzas with a fault or two chosen by event_id."""
    e = F.col("event_id")
    return V.stanzas(spark, sf_dir).select(
        "event_id",
        F.when(e % 13 == 1, None).when(e % 13 == 2, "").otherwise(e.cast("string")).alias("id"),
        F.when(e % 13 != 3, _identity(F.col("eid"), F.when(e % 13 == 4, "").otherwise(F.col("device_id").cast("string")))).alias("from"),
        F.when(e % 13 != 5, _identity(F.col("eid"), F.when(e % 13 != 6, F.lit("x")))).alias("to"),
        F.when(e % 11 == 3, 2).otherwise(1).alias("type"),
        F.when(e % 11 == 4, 12).otherwise(F.col("status")).alias("status"),
        (e % 4).cast("int").alias("location_sharing"),
        F.when(e % 7 != 3, 1.5).alias("latitude"),
        F.lit(2.5).alias("longitude"),
        F.when(e % 17 == 5, 0).otherwise(5).alias("ttl"),
        F.when(e % 19 == 6, F.lit(-1)).otherwise(e).cast("long").alias("timestamp"),
    )


FAULTY_SQL = """faulty AS (
  SELECT event_id, CASE WHEN event_id % 13 = 1 THEN NULL WHEN event_id % 13 = 2 THEN '' ELSE CAST(event_id AS VARCHAR) END AS id,
         event_id % 13 = 3 AS no_from, event_id % 13 = 4 AS no_from_id, event_id % 13 = 5 AS no_to, event_id % 13 = 6 AS no_to_id,
         CASE WHEN event_id % 11 = 3 THEN 2 ELSE 1 END AS type, CASE WHEN event_id % 11 = 4 THEN 12 ELSE status END AS status,
         event_id % 4 AS loc, event_id % 7 = 3 AS no_lat, CASE WHEN event_id % 17 = 5 THEN 0 ELSE 5 END AS ttl, CASE WHEN event_id % 19 = 6 THEN -1 ELSE event_id END AS ms
  FROM stanzas)"""


@query(_with(V.STANZAS_SQL, FAULTY_SQL) + """
SELECT event_id, CAST(CASE WHEN field IS NULL THEN 0 ELSE 100 END AS BIGINT) AS code, coalesce(field, '') AS field FROM (
  SELECT event_id, CASE WHEN id IS NULL OR id = '' THEN 'id' WHEN no_from THEN 'from' WHEN no_from_id THEN 'from.connection_resource_id' WHEN no_to THEN 'to'
    WHEN no_to_id THEN 'to.connection_resource_id' WHEN type <> 1 THEN 'type' WHEN status NOT BETWEEN 1 AND 11 THEN 'status' WHEN loc NOT IN (1, 2) THEN 'location_sharing'
    WHEN loc = 1 AND no_lat THEN 'coordinates' WHEN ttl <= 0 THEN 'ttl' WHEN ms <= 0 THEN 'timestamp' END AS field FROM faulty)""")
def validate_awareness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _faulty(spark, sf_dir).select("event_id", Z.awareness_error().alias("e")).select("event_id", F.coalesce("e.code", F.lit(0)).cast("long").alias("code"), F.coalesce("e.field", F.lit("")).alias("field"))


@query(_with(V.STANZAS_SQL) + """
SELECT event_id, CAST(CASE WHEN field IS NULL THEN 0 WHEN field = 'to' THEN 401 ELSE 100 END AS BIGINT) AS code, coalesce(field, '') AS field FROM (
  SELECT event_id, CASE WHEN event_id % 13 = 2 THEN 'id' WHEN event_id % 13 = 3 THEN 'to.eid' WHEN event_id % 13 = 4 THEN 'to.connection_resource_id'
    WHEN event_id % 11 <> 0 AND event_id % 11 > 8 THEN 'type' WHEN event_id % 11 = 2 THEN 'type' WHEN event_id % 17 = 5 THEN 'timestamp' WHEN event_id % 7 = 1 THEN 'to' END AS field FROM stanzas)""")
def validate_ping(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = V.stanzas(spark, sf_dir).select(
        "event_id", F.col("eid").cast("string").alias("eid"), F.col("device_id").cast("string").alias("device"),
        F.when(e % 13 == 2, "").otherwise("p").alias("id"),
        F.when(e % 13 != 3, F.struct(F.when(e % 7 == 1, "other").otherwise(F.col("eid").cast("string")).alias("eid"), F.when(e % 13 != 4, F.col("device_id").cast("string")).alias("connection_resource_id"))).alias("to"),
        F.when(e % 11 > 8, 9).when(e % 11 == 2, 2).otherwise(1).alias("type"), F.when(e % 17 == 5, 0).otherwise(-1).alias("timestamp"),
    )
    return rows.select("event_id", Z.ping_error(F.col("eid"), F.col("device")).alias("e")).select("event_id", F.coalesce("e.code", F.lit(0)).cast("long").alias("code"), F.coalesce("e.field", F.lit("")).alias("field"))


@query(_with(V.STANZAS_SQL) + """
SELECT event_id, CAST(CASE field WHEN 'to' THEN 100 WHEN 'to.eid' THEN 101 WHEN 'to.connection_resource_id' THEN 102 WHEN 'type' THEN 103 WHEN 'status' THEN 104 WHEN 'timestamp' THEN 105 ELSE 0 END AS BIGINT) AS code, coalesce(field, '') AS field FROM (
  SELECT event_id, CASE WHEN event_id % 13 = 3 THEN 'to' WHEN event_id % 7 = 1 THEN 'to.eid' WHEN event_id % 7 = 2 THEN 'to.connection_resource_id'
    WHEN event_id % 11 = 2 THEN 'type' WHEN event_id % 5 = 1 THEN 'status' WHEN event_id % 17 = 5 THEN 'timestamp' END AS field FROM stanzas)""")
def validate_logout(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = V.stanzas(spark, sf_dir).select(
        "event_id", F.col("eid").cast("string").alias("eid"), F.col("device_id").cast("string").alias("device"),
        F.when(e % 13 != 3, F.struct(F.when(e % 7 == 1, "other").otherwise(F.col("eid").cast("string")).alias("eid"), F.when(e % 7 == 2, "other").otherwise(F.col("device_id").cast("string")).alias("connection_resource_id"))).alias("to"),
        F.when(e % 11 == 2, 2).otherwise(1).alias("type"), F.when(e % 5 == 1, 1).otherwise(4).alias("status"), F.when(e % 17 == 5, 0).otherwise(e + 1).alias("timestamp"),
    )
    return rows.select("event_id", Z.logout_error(F.col("eid"), F.col("device")).alias("e")).select("event_id", F.coalesce("e.code", F.lit(0)).cast("long").alias("code"), F.coalesce("e.field", F.lit("")).alias("field"))


@query(_with(V.STANZAS_SQL, FAULTY_SQL) + """
SELECT event_id, 2 AS type, CASE WHEN loc = 1 THEN CASE WHEN NOT no_lat THEN 1.5 END ELSE 0.0 END::DOUBLE AS latitude, CASE WHEN loc = 1 THEN 2.5 ELSE 0.0 END::DOUBLE AS longitude, event_id * 1000 AS "timestamp" FROM faulty""")
def awareness_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.awareness_response(_faulty(spark, sf_dir), F.col("event_id") * 1000).select("event_id", "type", "latitude", "longitude", "timestamp")


DETAILS_SQL = _with(V.STANZAS_SQL, FAULTY_SQL) + """
SELECT event_id, 'Field ' || chr(39) || field || chr(39) || ' → ' || text AS details, 'eid=' || eid || ', status=' || status AS pairs FROM (
  SELECT event_id, CASE WHEN id IS NULL THEN ['id', 'Missing awareness id'] WHEN id = '' THEN ['id', 'Awareness id cannot be empty'] WHEN no_from THEN ['from', 'Missing from identity']
    WHEN no_from_id THEN ['from.connection_resource_id', 'Missing from.connection_resource_id'] WHEN no_to THEN ['to', 'Missing to identity']
    WHEN no_to_id THEN ['to.connection_resource_id', 'Missing to.connection_resource_id'] WHEN type <> 1 THEN ['type', 'Invalid type — user can only send REQUEST (1)']
    WHEN status NOT BETWEEN 1 AND 11 THEN ['status', 'Invalid status — must be one of 1..11'] WHEN loc NOT IN (1, 2) THEN ['location_sharing', 'Invalid location_sharing — must be 1 or 2']
    WHEN loc = 1 AND no_lat THEN ['coordinates', 'Latitude and Longitude required when sharing is enabled'] WHEN ttl <= 0 THEN ['ttl', 'Missing or invalid ttl']
    WHEN ms <= 0 THEN ['timestamp', 'Missing or invalid timestamp'] END AS found, found[1] AS field, found[2] AS text, status FROM faulty) f
JOIN (SELECT event_id, eid FROM stanzas) USING (event_id) WHERE field IS NOT NULL"""


@query(DETAILS_SQL)
def error_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is told of every faulty stanza."""
    rows = _faulty(spark, sf_dir).withColumn("e", Z.awareness_error()).filter("e is not null")
    text = Z.error_details(F.col("e.description"), F.col("e.field"))
    pairs = Z.map_details(F.create_map(F.lit("status"), F.col("status").cast("string"), F.lit("eid"), F.col("eid")))
    rows = rows.join(V.stanzas(spark, sf_dir).select("event_id", F.col("eid").cast("string").alias("eid")), "event_id")
    return rows.select("event_id", text.alias("details"), pairs.alias("pairs"))


RESPONSE_SQL = _with(V.STANZAS_SQL) + " SELECT event_id, CAST(eid AS VARCHAR) AS to_eid, CAST(device_id AS VARCHAR) AS to_device, {0} FROM stanzas"


def _response(spark: SparkSession, sf_dir: str, stanza: Callable[[Column, Column, Column], Column], *fields: str) -> DataFrame:
    """A response to the device of each stanza, its time the event's number."""
    rows = V.stanzas(spark, sf_dir).select("event_id", "status", F.col("eid").cast("string").alias("eid"), F.col("device_id").cast("string").alias("device_id"))
    rows = rows.select("event_id", stanza(F.col("eid"), F.col("device_id"), F.col("event_id")).alias("s"))
    return rows.select("event_id", F.col("s.to.eid").alias("to_eid"), F.col("s.to.connection_resource_id").alias("to_device"), *(f"s.{f}" for f in fields))


@query(RESPONSE_SQL.format("2 AS type, event_id AS \"timestamp\", CAST(NULL AS VARCHAR) AS details"))
def pong_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _response(spark, sf_dir, Z.pong_stanza, "type", "timestamp", "details")


@query(RESPONSE_SQL.format("3 AS type, event_id AS \"timestamp\", 'status ' || status AS details"))
def ping_error_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _response(spark, sf_dir, lambda e, d, t: Z.pong_stanza(e, d, t, F.concat(F.lit("status "), F.col("status"))), "type", "timestamp", "details")


@query(RESPONSE_SQL.format("2 AS type, 3 AS status, event_id AS \"timestamp\", CAST(NULL AS VARCHAR) AS details"))
def logout_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _response(spark, sf_dir, lambda e, d, t: Z.logout_stanza(e, d, 3, t), "type", "status", "timestamp", "details")


@query(RESPONSE_SQL.format("3 AS type, 0 AS status, event_id AS \"timestamp\", 'status ' || status AS details"))
def awareness_error_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _response(spark, sf_dir, lambda e, d, t: Z.awareness_error_stanza(e, d, F.concat(F.lit("status "), F.col("status")), t), "type", "status", "timestamp", "details")


@query(_with(V.STANZAS_SQL) + " SELECT event_id, CAST(100 + status AS INT) AS code, 2 AS error_origin, 'status ' || status AS details, event_id AS \"timestamp\" FROM stanzas")
def error_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Z.error_stanza((F.col("status") + 100).cast("int"), 2, F.concat(F.lit("status "), F.col("status")), F.col("event_id"))
    return V.stanzas(spark, sf_dir).select("event_id", e.alias("e")).select("event_id", "e.*")


@query(_with(V.STANZAS_SQL) + """ SELECT event_id, coalesce(status IN (1, 2, 6) AND event_id % 7 <> 3, false) AS ok, 'token ' || event_id AS token FROM stanzas""")
def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stanzas as claims of sessions: some lack their id, and some tokens are of no known type."""
    s = V.stanzas(spark, sf_dir)
    kind = F.when(F.col("status") == 1, "access").when(F.col("status").isin(2, 6), "refresh").otherwise("id")
    ok = C.claims_ok(F.col("eid"), F.col("device_id"), F.when(F.col("event_id") % 7 != 3, F.col("event_id")), kind)
    return s.select("event_id", ok.alias("ok"), C.bearer_token(F.concat(F.lit("Bearer token "), F.col("event_id"))).alias("token"))


@query(_with(V.STANZAS_SQL, CLOCK_SQL) + " SELECT event_id FROM stanzas, clock WHERE epoch_ms(as_of) <= epoch_ms(ts) + rtt_ms * 100000")
def stanza_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _clocked(V.stanzas(spark, sf_dir), spark, sf_dir)
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    return rows.filter(Z.live_stanza(ms("ts"), F.col("rtt_ms") * 100_000, ms("as_of"))).select("event_id")


# ---- fan-out -------------------------------------------------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.stanzas(spark, sf_dir).select("eid", "event_id", "status", ((F.col("eid") * 7 + F.col("event_id")) % 200).alias("to_eid"))


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.stanzas(spark, sf_dir).select("eid").distinct()


USERS_SQL = "users AS (SELECT DISTINCT eid FROM stanzas)"
GROUP_SQL = "routed AS (SELECT s.eid AS sender, event_id, status, owner_id AS receiver FROM stanzas s JOIN edges ON subscriber_id = s.eid WHERE status BETWEEN 1 AND 5)"
PEER_SQL = "routed AS (SELECT eid AS sender, event_id, status, (eid * 7 + event_id) % 200 AS receiver FROM stanzas WHERE status BETWEEN 6 AND 11)"


@query(_with(V.STANZAS_SQL, V.EDGES_SQL, USERS_SQL, GROUP_SQL) + " SELECT receiver, count(*) AS events, min(event_id) AS first_event FROM routed SEMI JOIN users ON receiver = eid GROUP BY receiver")
def fanout_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fanout.group_counts(_events(spark, sf_dir), V.edges(spark, sf_dir), _users(spark, sf_dir))


@query(_with(V.STANZAS_SQL, USERS_SQL, PEER_SQL) + " SELECT sender AS eid, receiver, event_id, status FROM routed SEMI JOIN users ON receiver = eid")
def fanout_peer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fanout.peer(_events(spark, sf_dir), _users(spark, sf_dir)).select("eid", "receiver", "event_id", "status")


@query(_with(V.STANZAS_SQL, USERS_SQL, PEER_SQL) + " SELECT receiver, count(*) AS dropped FROM routed ANTI JOIN users ON receiver = eid GROUP BY receiver")
def fanout_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fanout.undelivered(fanout.peer(_events(spark, sf_dir)), _users(spark, sf_dir)).groupBy("receiver").agg(F.count("*").alias("dropped"))


@query(_with(V.STANZAS_SQL, SNAPSHOT_SQL, CLOCK_SQL, PEER_SQL, f"up AS (SELECT eid, device_id FROM snapshot, clock WHERE {ONLINE_SQL})") + " SELECT event_id, receiver, device_id AS to_device FROM routed JOIN up ON receiver = eid")
def fanout_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = fanout.peer(_events(spark, sf_dir))
    devices = _snapshot(spark, sf_dir)
    return fanout.to_devices(routed, devices, _clock(spark, sf_dir), STALE).select("event_id", "receiver", "to_device")


@query(_with(V.STANZAS_SQL, V.EDGES_SQL) + " SELECT owner_id AS receiver, count(*) AS updates FROM stanzas s JOIN edges ON subscriber_id = s.eid WHERE status = 1 GROUP BY owner_id")
def ping_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    pings = fanout.ping_refreshes(V.stanzas(spark, sf_dir).filter("status = 1").select("eid", "event_id"))
    return fanout.ping_refresh_receivers(pings, V.edges(spark, sf_dir)).groupBy("receiver").agg(F.count("*").alias("updates"))


@query(_with(V.EDGES_SQL) + " SELECT owner_id, count(*) AS friends FROM edges GROUP BY owner_id")
def friend_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.edges(spark, sf_dir).groupBy("owner_id").agg(F.count("*").alias("friends"))


@query(_with(V.STANZAS_SQL, V.EDGES_SQL, "u AS (SELECT eid, max_by(status, (ts, event_id)) AS status, max(ts) AS ts FROM stanzas GROUP BY eid)") + """
SELECT owner_id, subscriber_id, CASE WHEN u.eid IS NULL THEN 'offline' ELSE CAST(u.status AS VARCHAR) END AS status, u.eid IS NULL AND (owner_id % 2 = 0) AS blocked
FROM edges LEFT JOIN u ON subscriber_id = u.eid""")
def subscriber_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges as subscriber rows, updated with each friend's last status; an update unblocks."""
    table = V.edges(spark, sf_dir).select("owner_id", "subscriber_id", F.lit("offline").alias("status"), (F.col("owner_id") % 2 == 0).alias("blocked"), F.lit(None).cast("timestamp_ntz").alias("last_seen"))
    last = D.latest(V.stanzas(spark, sf_dir).select("eid", "ts", "event_id", "status"), ["eid"], ["ts", "event_id"])
    updates = V.edges(spark, sf_dir).join(last.select(F.col("eid").alias("subscriber_id"), F.col("status").cast("string").alias("status")), "subscriber_id")
    return D.update_subscribers(table, updates, F.lit(None).cast("timestamp_ntz")).drop("last_seen")


@query(_with(V.EDGES_SQL) + " SELECT subscriber_id, string_agg(CAST(owner_id AS VARCHAR), ',' ORDER BY owner_id) AS owners FROM edges GROUP BY subscriber_id")
def subscriber_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index from a subscriber to those it belongs to."""
    return V.edges(spark, sf_dir).groupBy("subscriber_id").agg(_text(F.sort_array(F.collect_list("owner_id"))).alias("owners"))


@query(_with(V.STANZAS_SQL, V.EDGES_SQL) + """
SELECT owner_id, subscriber_id, CASE WHEN n IS NULL THEN 'old' ELSE 'new ' || n END AS status FROM edges LEFT JOIN (SELECT eid, count(*) AS n FROM stanzas GROUP BY eid) ON owner_id = eid
UNION ALL SELECT eid, 0, 'new ' || count(*) FROM stanzas GROUP BY eid""")
def subscriber_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of users with stanzas added again, and one of a new subscriber for each of them."""
    edges, users = V.edges(spark, sf_dir), V.stanzas(spark, sf_dir).groupBy(F.col("eid").alias("owner_id")).agg(F.concat(F.lit("new "), F.count("*")).alias("status"))
    new = V.edges(spark, sf_dir, ("owner_id",)).join(users, "owner_id").unionByName(users.select("owner_id", F.lit(0).cast(edges.schema["subscriber_id"].dataType).alias("subscriber_id"), "status"))
    return D.add_subscribers(edges.withColumn("status", F.lit("old")), new)


@query(_with(V.EDGES_SQL) + " SELECT subscriber_id FROM edges WHERE owner_id = 1")
def subscribers_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.subscriber_ids(V.edges(spark, sf_dir), 1)


@query(_with(V.STANZAS_SQL, SNAPSHOT_SQL) + """
SELECT s.eid, s.device_id, s.status, s.last_seen, coalesce(o.m, 0) AS last_offset FROM snapshot s LEFT JOIN (SELECT eid, device_id, max(event_id) AS m FROM stanzas WHERE status = 10 GROUP BY ALL) o
ON s.eid = o.eid AND s.device_id = o.device_id""")
def device_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices with the offset of their last read event; 0 where there is none."""
    read = V.stanzas(spark, sf_dir).filter("status = 10").groupBy("eid", "device_id").agg(F.max("event_id").alias("offset"))
    return D.set_offset(_snapshot(spark, sf_dir).withColumn("last_offset", F.lit(0).cast("long")), read)


@query(_with(V.STANZAS_SQL, CLOCK_SQL) + " SELECT eid AS jti, max(ts + INTERVAL 30 DAY) AS exp FROM stanzas, clock WHERE ts + INTERVAL 30 DAY > as_of GROUP BY eid")
def revocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of thirty days, one name for all of a user's; only those with time left are written."""
    tokens = V.stanzas(spark, sf_dir).select(F.col("eid").alias("jti"), F.expr("ts + INTERVAL 30 DAY").alias("exp"))
    return D.revoke(tokens, _clock(spark, sf_dir))


@query(_with(V.STANZAS_SQL, CLOCK_SQL, "revoked AS (SELECT event_id AS jti, ts + INTERVAL 30 DAY AS exp FROM stanzas WHERE status = 2)") + " SELECT event_id FROM stanzas WHERE event_id NOT IN (SELECT jti FROM revoked, clock WHERE exp > as_of)")
def unrevoked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stanzas as sessions; each error stanza revokes its token for thirty days."""
    s = V.stanzas(spark, sf_dir)
    tokens = _clocked(s.filter("status = 2").select(F.col("event_id").alias("jti"), F.expr("ts + INTERVAL 30 DAY").alias("exp")), spark, sf_dir)
    return D.not_revoked(s.select(F.col("event_id").alias("jti")), tokens, F.col("as_of")).withColumnRenamed("jti", "event_id")


# ---- log and queue -------------------------------------------------------------------------------------------------


def _cursors(log: DataFrame) -> DataFrame:
    keys = log.select("eid", "partition_id").distinct()
    return keys.select("*", F.explode(F.array(F.struct(F.lit("d0").alias("device_id"), F.lit(0).cast("long").alias("offset")), F.struct(F.lit("d2").alias("device_id"), F.lit(2).cast("long").alias("offset")))).alias("c")).select("eid", "partition_id", "c.*")


CURSORS_SQL = "cursors AS (SELECT DISTINCT eid, partition_id, d AS device_id, CAST(c AS BIGINT) AS cursor FROM log, (VALUES ('d0', 0), ('d2', 2)) AS v(d, c))"
FETCHED_SQL = """fetched AS (SELECT l.eid, l.partition_id, device_id, "offset", "from", payload FROM log l JOIN cursors c ON l.eid = c.eid AND l.partition_id = c.partition_id WHERE "offset" >= cursor + 1
  QUALIFY row_number() OVER (PARTITION BY l.eid, l.partition_id, device_id ORDER BY "offset") <= 2)"""


@query(_with(V.LOG_SQL, CURSORS_SQL, FETCHED_SQL) + " SELECT * FROM fetched")
def log_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = V.message_log(spark, sf_dir)
    return L.fetch(log, _cursors(log), 2).select("eid", "partition_id", "device_id", "offset", "from", "payload")


@query(_with(V.LOG_SQL, CURSORS_SQL, FETCHED_SQL) + """ SELECT c.eid, c.partition_id, c.device_id, coalesce(max("offset"), max(cursor)) AS "offset" FROM cursors c LEFT JOIN fetched f ON c.eid = f.eid AND c.partition_id = f.partition_id AND c.device_id = f.device_id GROUP BY ALL""")
def log_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = V.message_log(spark, sf_dir)
    cursors = _cursors(log)
    return L.advance(cursors, L.fetch(log, cursors, 2)).select("eid", "partition_id", "device_id", "offset")


@query(_with(V.LOG_SQL) + """ SELECT eid, "offset" FROM log WHERE "from" <> 'user'""")
def log_unacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = V.message_log(spark, sf_dir)
    marks = log.filter("from = 'user'").select("eid", "partition_id", F.lit("d0").alias("device_id"), "offset")
    return L.unacked(log, L.acknowledge(marks, marks), "d0").select("eid", "offset")


@query(_with(V.LOG_SQL) + """ SELECT eid, m + row_number() OVER (PARTITION BY eid ORDER BY "offset") AS new_offset, payload FROM (SELECT *, max("offset") OVER (PARTITION BY eid) AS m FROM log)""")
def log_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every log once more, appended to itself."""
    log = V.message_log(spark, sf_dir)
    more = log.select("eid", "partition_id", "from", "payload", F.col("offset").alias("_seq"))
    return L.append(log, more, ["_seq"]).select("eid", F.col("offset").alias("new_offset"), "payload")


@query(_with(V.LOG_SQL) + """ SELECT eid, max("offset") + 1 AS next_offset FROM log GROUP BY eid""")
def log_next_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.next_offsets(V.message_log(spark, sf_dir)).select("eid", "next_offset")


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.message_log(spark, sf_dir).select("eid", F.lit("chat").alias("channel"), F.col("offset").alias("msg_id"), "payload")


@query(_with(V.LOG_SQL) + """ SELECT eid, "offset" AS msg_id, payload FROM log QUALIFY row_number() OVER (PARTITION BY eid ORDER BY "offset" DESC) <= 3""")
def queue_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.prune(_queue(spark, sf_dir), 3).select("eid", "msg_id", "payload")


@query(_with(V.LOG_SQL, """twice AS (SELECT eid, "offset" AS id, payload FROM log UNION ALL SELECT eid, "offset" + max("offset") OVER (PARTITION BY eid), payload FROM log)""") + " SELECT eid, id AS msg_id, payload FROM twice QUALIFY row_number() OVER (PARTITION BY eid ORDER BY id DESC) <= 5")
def queue_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = _queue(spark, sf_dir)
    more = queue.select("eid", "channel", "payload", F.col("msg_id").alias("_seq"))
    return L.enqueue(queue, more, ["_seq"], 5).select("eid", "msg_id", "payload")


@query(_with(V.LOG_SQL) + """ SELECT eid, "offset" AS msg_id FROM log WHERE "offset" > CASE WHEN eid IN (SELECT eid FROM log WHERE "offset" = 4) THEN 4 WHEN eid IN (SELECT eid FROM log WHERE "offset" = 2) THEN 2 ELSE 0 END""")
def queue_ack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acks of ids 2, 4 and 1000 in every queue; ids that aren't there settle nothing."""
    queue = _queue(spark, sf_dir)
    acks = queue.select("eid", "channel").distinct().withColumn("msg_id", F.explode(F.array(*(F.lit(k).cast("long") for k in (2, 4, 1000)))))
    return L.ack_queue(queue, acks).select("eid", "msg_id")


@query(_with(V.LOG_SQL) + """ SELECT eid, "offset" AS msg_id, CAST((row_number() OVER (PARTITION BY eid ORDER BY "offset") - 1) // 2 AS BIGINT) AS batch FROM log""")
def queue_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.batches(_queue(spark, sf_dir), 2).select("eid", "msg_id", "batch")


@query(_with(V.LOG_SQL) + """ SELECT eid, "offset" AS msg_id FROM log WHERE "offset" > 1 QUALIFY row_number() OVER (PARTITION BY eid ORDER BY "offset") <= 2""")
def queue_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = _queue(spark, sf_dir)
    cursors = queue.select("eid", "channel").distinct().withColumn("msg_id", F.lit(1).cast("long"))
    return L.fetch_queue(queue, cursors, 2).select("eid", "msg_id")


@query(_with(V.LOG_SQL) + """ SELECT eid, count(*) AS n, min("offset") AS first_id, max("offset") AS last_id, true AS has_data FROM log GROUP BY eid""")
def queue_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.queue_index(_queue(spark, sf_dir)).drop("channel")
