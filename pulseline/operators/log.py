"""Offset log: dense offsets, fetch after a cursor, acknowledgements; and the bounded queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseline import schemas as S

LOG_KEY = ["eid", "partition_id"]
QUEUE_KEY = ["eid", "channel"]


def next_offsets(log: DataFrame) -> DataFrame:
    """(eid, partition_id, next_offset): one past the greatest offset."""
    return log.groupBy(*LOG_KEY).agg((F.max("offset") + 1).alias("next_offset"))


def append(log: DataFrame, records: DataFrame, order: list[str]) -> DataFrame:
    """records(eid, partition_id, ...) with offsets that continue each key's log: dense, from 1."""
    w = Window.partitionBy(*LOG_KEY).orderBy(*order)
    known = records.join(next_offsets(log), LOG_KEY, "left")
    return known.withColumn("offset", F.coalesce("next_offset", F.lit(1).cast("long")) + F.row_number().over(w) - 1).drop("next_offset")


def fetch(log: DataFrame, cursors: DataFrame, limit: int = 10) -> DataFrame:
    """The next `limit` records after each device's cursor, in offset order.

    cursors(eid, device_id, partition_id, offset): the last offset that a device has had (0: none). Adds device_id.
    """
    if limit < 0:
        raise ValueError("limit can't be negative")
    c = cursors.select(*LOG_KEY, "device_id", F.col("offset").alias("_cursor"))
    rows = log.join(c, LOG_KEY).filter(F.col("offset") >= F.col("_cursor") + 1)
    w = Window.partitionBy(*LOG_KEY, "device_id").orderBy("offset")
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).drop("_n", "_cursor")


def advance(cursors: DataFrame, fetched: DataFrame) -> DataFrame:
    """Cursors after a fetch: the last offset returned; unchanged where nothing was."""
    keys = [*LOG_KEY, "device_id"]
    last = fetched.groupBy(*keys).agg(F.max("offset").alias("_last"))
    return cursors.join(last, keys, "left").select(*keys, F.coalesce("_last", "offset").alias("offset"))


def acknowledge(acks: DataFrame, new: DataFrame) -> DataFrame:
    """Acks are marks of single offsets; marking twice changes nothing, and no cursor moves."""
    keys = [*LOG_KEY, "device_id", "offset"]
    return acks.select(*keys).unionByName(new.select(*keys)).distinct()


def unacked(log: DataFrame, acks: DataFrame, device_id: object) -> DataFrame:
    """Records that a device has not acknowledged."""
    own = acks.filter(F.col("device_id") == device_id).select(*LOG_KEY, "offset")
    return log.join(own, [*LOG_KEY, "offset"], "left_anti")


def enqueue(queue: DataFrame, messages: DataFrame, order: list[str], bound: int = S.QUEUE_BOUND) -> DataFrame:
    """Messages(eid, channel, ...) get ids after the last one of their queue; each queue keeps its newest `bound`."""
    last = queue.groupBy(*QUEUE_KEY).agg(F.max("msg_id").alias("_last"))
    w = Window.partitionBy(*QUEUE_KEY).orderBy(*order)
    new = messages.join(last, QUEUE_KEY, "left").withColumn("msg_id", F.coalesce("_last", F.lit(0).cast("long")) + F.row_number().over(w)).drop("_last")
    return prune(queue.unionByName(new, allowMissingColumns=True), bound)


def prune(queue: DataFrame, bound: int = S.QUEUE_BOUND) -> DataFrame:
    """The newest `bound` messages of each queue. Ids are dense, so the greatest id tells what goes: an aggregate and a join, no sort."""
    top = queue.groupBy(*QUEUE_KEY).agg(F.max("msg_id").alias("_top"))
    return queue.join(top, QUEUE_KEY).filter(F.col("msg_id") > F.col("_top") - bound).drop("_top").select(queue.columns)


def prune_sparse(queue: DataFrame, bound: int = S.QUEUE_BOUND) -> DataFrame:
    """As prune, for ids with gaps."""
    w = Window.partitionBy(*QUEUE_KEY).orderBy(F.desc("msg_id"))
    return queue.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= bound).drop("_n")


def ack_queue(queue: DataFrame, acks: DataFrame) -> DataFrame:
    """Messages after the acknowledged ones: acks(eid, channel, msg_id) settle their id and all before it, if the id exists."""
    known = acks.join(queue.select(*QUEUE_KEY, "msg_id"), [*QUEUE_KEY, "msg_id"], "left_semi")
    upto = known.groupBy(*QUEUE_KEY).agg(F.max("msg_id").alias("_upto"))
    return queue.join(upto, QUEUE_KEY, "left").filter(F.col("msg_id") > F.coalesce("_upto", F.lit(0))).drop("_upto").select(queue.columns)


def fetch_queue(queue: DataFrame, cursors: DataFrame, limit: int) -> DataFrame:
    """The first `limit` messages after cursors(eid, channel, msg_id)."""
    c = cursors.select(*QUEUE_KEY, F.col("msg_id").alias("_cursor"))
    w = Window.partitionBy(*QUEUE_KEY).orderBy("msg_id")
    rows = queue.join(c, QUEUE_KEY, "left").filter(F.col("msg_id") > F.coalesce("_cursor", F.lit(0)))
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).select(queue.columns)


def batches(queue: DataFrame, size: int) -> DataFrame:
    """Adds batch (from 0): runs of `size` messages of a queue in id order."""
    w = Window.partitionBy(*QUEUE_KEY).orderBy("msg_id")
    return queue.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("long"))


def queue_index(queue: DataFrame) -> DataFrame:
    """(eid, channel, n, first_id, last_id, has_data)."""
    return queue.groupBy(*QUEUE_KEY).agg(F.count("*").alias("n"), F.min("msg_id").alias("first_id"), F.max("msg_id").alias("last_id"), (F.count("*") > 0).alias("has_data"))
