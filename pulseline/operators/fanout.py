"""Fan-out: status events to subscribers' owners, to peers, and to their live devices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseline import schemas as S
from pulseline.functions.columns import receive_action, send_route
from pulseline.operators.devices import live


def group(events: DataFrame, edges: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Status events 1..5 to every owner that follows the sender; with users(eid), to owners with a live process.

    A plain equi-join on the sender: Spark broadcasts the edges where they are small and splits hot senders.
    """
    return _to_owners(events.filter(send_route(F.col("status")) == "group"), edges, users)


def group_counts(events: DataFrame, edges: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """(receiver, events, first_event) of group(): events are counted by sender before they meet its owners, so no row is made for each pair."""
    sent = events.filter(send_route(F.col("status")) == "group").groupBy("eid").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    return _to_owners(sent, edges, users).groupBy("receiver").agg(F.sum("n").alias("events"), F.min("first").alias("first_event"))


def _to_owners(sent: DataFrame, edges: DataFrame, users: DataFrame | None) -> DataFrame:
    out = sent.join(edges.select(F.col("subscriber_id").alias("eid"), "owner_id"), "eid").withColumnRenamed("owner_id", "receiver")
    return out if users is None else out.join(users.select(F.col("eid").alias("receiver")), "receiver", "left_semi")


def peer(events: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Status events 6..11 to the user they name in to_eid."""
    out = events.filter(send_route(F.col("status")) == "peer").withColumnRenamed("to_eid", "receiver")
    return out if users is None else out.join(users.select(F.col("eid").alias("receiver")), "receiver", "left_semi")


def undelivered(routed: DataFrame, users: DataFrame) -> DataFrame:
    """Routed events whose receiver has no process: they are dropped."""
    return routed.join(users.select(F.col("eid").alias("receiver")), "receiver", "left_anti")


def to_devices(routed: DataFrame, devices: DataFrame, as_of: Column, stale: int = S.STALE_SECONDS) -> DataFrame:
    """One row for each live device of the receiver, of events that receivers pass on to devices."""
    up = devices.filter(live(F.col("status"), F.col("last_seen"), as_of, stale)).select(F.col("eid").alias("receiver"), F.col("device_id").alias("to_device"))
    return routed.filter(receive_action(F.col("status")) == "fan_out").join(up, "receiver")


def ping_refreshes(pings: DataFrame) -> DataFrame:
    """The status that a ping spreads to the group's subscriber rows; devices never see it."""
    return pings.withColumn("status", F.lit(S.PING_REFRESH))


def ping_refresh_receivers(refreshes: DataFrame, edges: DataFrame) -> DataFrame:
    return refreshes.join(edges.select(F.col("subscriber_id").alias("eid"), "owner_id"), "eid").withColumnRenamed("owner_id", "receiver").filter(receive_action(F.col("status")) == "update")
