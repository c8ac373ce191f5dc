"""Keyed device tables: sessions, patches, deletes, awareness, subscribers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseline import schemas as S
from pulseline.functions.columns import seconds_between

KEY = ["eid", "device_id"]


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by `order`: an aggregate that is merged before the shuffle, so hot keys cost a row a task."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*").select(rows.columns)


def upsert_sessions(devices: DataFrame, logins: DataFrame, as_of: Column) -> DataFrame:
    """Log devices in. A new device takes all fields of its login; a known one changes status, status_source,
    ip_address, app_version, os and last_seen and keeps the rest, offset included."""
    fresh = logins.select(*KEY, F.struct(*[c for c in logins.columns if c not in KEY]).alias("_new"))
    old = devices.select(*KEY, F.struct(*[c for c in devices.columns if c not in KEY]).alias("_old"))
    both = old.join(fresh, KEY, "full_outer")
    patched = {"status", "ip_address", "app_version", "os"} & set(logins.columns)

    def field(name: str) -> Column:
        was = F.col(f"_old.{name}")
        new = F.col(f"_new.{name}") if name in logins.columns else F.lit(None)
        if name == "status_source":
            return F.when(F.col("_new").isNotNull(), F.lit("LOGIN")).otherwise(was)
        if name == "last_seen":
            return F.when(F.col("_new").isNotNull(), as_of).otherwise(was)
        if name in patched:
            return F.when(F.col("_new").isNotNull(), new).otherwise(was)
        return F.when(F.col("_old").isNull(), new).otherwise(was)

    return both.select(*KEY, *(field(f.name).cast(f.dataType).alias(f.name) for f in devices.schema if f.name not in KEY))


def patch_status(devices: DataFrame, patches: DataFrame) -> DataFrame:
    """Patches(eid, device_id, status, source, at): set status, source, last_activity and last_seen of known devices.

    found tells which rows a patch met; patches of unknown devices insert nothing (see unknown_patches).
    """
    p = patches.select(*KEY, F.struct("status", "source", "at").alias("_p"))
    new = {"status": "status", "status_source": "source", "last_activity": "at", "last_seen": "at"}
    columns = [F.when(F.col("_p").isNotNull(), F.col(f"_p.{new[c]}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in devices.columns]
    return devices.join(p, KEY, "left").select(*columns, F.col("_p").isNotNull().alias("found"))


def unknown_patches(devices: DataFrame, patches: DataFrame) -> DataFrame:
    return patches.join(devices.select(*KEY), KEY, "left_anti")


def set_offset(devices: DataFrame, offsets: DataFrame) -> DataFrame:
    """offsets(eid, device_id, offset) replace last_offset; all other fields stay."""
    joined = devices.join(offsets.select(*KEY, F.col("offset").alias("_o")), KEY, "left")
    return joined.select(*(F.coalesce("_o", c).alias(c) if c == "last_offset" else F.col(c) for c in devices.columns))


def delete_devices(devices: DataFrame, gone: DataFrame) -> DataFrame:
    return devices.join(gone.select(*KEY), KEY, "left_anti")


def live(status: Column, last_seen: Column, as_of: Column, stale: int = S.STALE_SECONDS) -> Column:
    """ONLINE and seen at most `stale` whole seconds ago."""
    return F.coalesce((status == "ONLINE") & (seconds_between(as_of, last_seen) <= stale), F.lit(False))


def active(status: Column, last_seen: Column, as_of: Column, stale: int = S.STALE_SECONDS) -> Column:
    """ONLINE and seen strictly after as_of less `stale` seconds; unlike live(), exactly `stale` ago is too old."""
    return F.coalesce((status == "ONLINE") & (last_seen > as_of - F.make_dt_interval(secs=F.lit(stale))), F.lit(False))


def upsert_awareness(changes: DataFrame) -> DataFrame:
    """changes(eid, awareness, ts, seq): the table after all of them. The first insert of a user always stores 2."""
    n = changes.groupBy("eid").agg(F.count("*").alias("n"), F.max_by("awareness", F.struct("ts", "seq")).alias("last"), F.max("ts").alias("updated_at"))
    return n.select("eid", F.when(F.col("n") == 1, 2).otherwise(F.col("last")).cast("int").alias("awareness"), "updated_at")


def add_subscribers(table: DataFrame, new: DataFrame) -> DataFrame:
    """One row an (owner, subscriber): a later add replaces the row."""
    keys = ["owner_id", "subscriber_id"]
    return table.join(new.select(*keys), keys, "left_anti").unionByName(new)


def update_subscribers(table: DataFrame, updates: DataFrame, as_of: Column) -> DataFrame:
    """updates(owner_id, subscriber_id, status[, blocked]): set status and last_seen; blocked falls back to false
    unless given; inserted_at stays."""
    keys = ["owner_id", "subscriber_id"]
    blocked = F.coalesce("blocked", F.lit(False)) if "blocked" in updates.columns else F.lit(False)
    u = updates.select(*keys, F.struct("status", blocked.alias("blocked")).alias("_u"))
    hit = F.col("_u").isNotNull()
    new = {"status": F.col("_u.status"), "blocked": F.col("_u.blocked"), "last_seen": as_of}
    return table.join(u, keys, "left").select(*(F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in table.columns))


def subscriber_ids(table: DataFrame, owner: object) -> DataFrame:
    return table.filter(F.col("owner_id") == owner).select("subscriber_id")


def device_ids(devices: DataFrame) -> DataFrame:
    """(eid, device_ids): ids in ascending order."""
    return devices.groupBy("eid").agg(F.sort_array(F.collect_set("device_id")).alias("device_ids"))


def not_revoked(sessions: DataFrame, revoked: DataFrame, as_of: Column) -> DataFrame:
    """Sessions whose jti has no unexpired revocation."""
    return sessions.join(revoked.filter(F.col("exp") > as_of).select("jti"), "jti", "left_anti")


def revoke(tokens: DataFrame, as_of: Column) -> DataFrame:
    """Revocations to write: only tokens that have time left."""
    return tokens.filter(F.col("exp") > as_of).select("jti", "exp").groupBy("jti").agg(F.max("exp").alias("exp"))


def session_starts(stanzas: DataFrame, gap: int, closes: Column | None = None) -> DataFrame:
    """Sessions of a device: a pause of over `gap` seconds, or a stanza that closes the one before (logout, closed socket), starts a new one.
    Adds session (from 1)."""
    w = Window.partitionBy(*KEY).orderBy("ts", "event_id")
    new = F.coalesce(seconds_between(F.col("ts"), F.lag("ts").over(w)) > gap, F.lit(True))
    if closes is not None:
        new = new | F.coalesce(F.lag(closes).over(w), F.lit(False))
    return stanzas.withColumn("_new", new.cast("long")).withColumn("session", F.sum("_new").over(w)).drop("_new")


def session_ends(stanzas: DataFrame, gap: int, closes: Column, as_of: Column) -> DataFrame:
    """(eid, device_id, session, started, ended, ended_by): closed by its last stanza, timeout once `gap` seconds have passed, or open."""
    rows = session_starts(stanzas, gap, closes).withColumn("_closes", F.coalesce(closes, F.lit(False)))
    out = rows.groupBy(*KEY, "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.max_by("_closes", F.struct("ts", "event_id")).alias("_closed"))
    by = F.when(F.col("_closed"), "closed").when(seconds_between(as_of, F.col("ended")) > gap, "timeout").otherwise("open")
    return out.select(*KEY, "session", "started", "ended", by.alias("ended_by"))
