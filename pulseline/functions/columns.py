"""Column functions: whole-second differences, code tables, round-trip buckets, routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulseline import schemas as S


def epoch(ts: Column) -> Column:
    """Whole seconds since 1970, rounded down."""
    return F.unix_seconds(ts.cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    """Each side cut to whole seconds, then subtracted."""
    return epoch(later) - epoch(earlier)


def lookup(code: Column, names: dict[int, str], other: str | None) -> Column:
    out: Column = F.lit(other)
    for k, v in names.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def status_name(code: Column) -> Column:
    return lookup(code, S.STATUS_NAMES, "UNKNOWN")


def status_code(name: Column) -> Column:
    """ONLINE is 1, OFFLINE 2 in any case; all else 0."""
    return F.when(F.upper(name) == "ONLINE", 1).when(F.upper(name) == "OFFLINE", 2).otherwise(0)


def legacy_status_code(name: Column) -> Column:
    """The old table of lower-case names: online 1, offline 4, else null."""
    return F.when(name == "online", 1).when(name == "offline", 4)


def rtt_level(rtt: Column, high: int = S.RTT_HIGH_MS, low: int = S.RTT_LOW_MS) -> Column:
    return F.when(rtt > high, "high").when(rtt < low, "low").otherwise("medium")


def ping_interval_ms(rtt: Column) -> Column:
    """Interval to the next ping; the default where no round trip is known."""
    level = rtt_level(rtt)
    known = F.when(level == "high", S.INTERVALS_MS["high"]).when(level == "low", S.INTERVALS_MS["low"]).otherwise(S.INTERVALS_MS["medium"])
    return F.when(rtt.isNull(), S.DEFAULT_INTERVAL_MS).otherwise(known)


def max_missed(rtt: Column) -> Column:
    level = rtt_level(rtt)
    return F.when(level == "high", S.MAX_MISSED["high"]).when(level == "low", S.MAX_MISSED["low"]).otherwise(S.MAX_MISSED["medium"])


def send_route(status: Column) -> Column:
    """Where a status stanza goes: 1..5 to the group, 6..11 to the peer, else nowhere."""
    return F.when(status.between(1, 5), "group").when(status.between(6, 11), "peer").otherwise("dropped")


def sender_status(status: Column) -> Column:
    """The status that a stanza leaves its own device with."""
    return F.when(status.between(1, 5), status_name(status)).when(status.between(6, 11), "ONLINE")


def receive_action(status: Column) -> Column:
    """What a receiver does: 1, 2 and 6..11 update and fan out to devices, 12 only updates, else dropped."""
    return F.when(status.between(1, 2) | status.between(6, 11), "fan_out").when(status == S.PING_REFRESH, "update").otherwise("dropped")


def stanza_route(route: Column) -> Column:
    """Inbound dispatch: only awareness and ping_pong are served."""
    return F.when(route == 2, "awareness").when(route == 3, "ping_pong").otherwise("dropped")


def presence_status(status: Column) -> Column:
    """A device's ONLINE/OFFLINE after a stanza: 2 is OFFLINE, every other code ONLINE."""
    return F.when(status == 2, "OFFLINE").otherwise("ONLINE")


def bearer_token(header: Column) -> Column:
    return F.regexp_replace(header, "^Bearer ", "")


def claims_ok(eid: Column, device_id: Column, jti: Column, kind: Column) -> Column:
    """Claims that a session needs: three strings and a known token type."""
    return F.coalesce(eid.isNotNull() & device_id.isNotNull() & jti.isNotNull() & kind.isin("access", "refresh"), F.lit(False))
