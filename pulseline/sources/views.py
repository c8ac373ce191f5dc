"""Domain views over the star-schema and event tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_STATUS = {"signup": 1, "error": 2, "view": 6, "purchase": 10, "click": 11}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stanzas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(eid, device_id, ts, event_id, status, rtt_ms): one status stanza for each event."""
    device = F.get_json_object("props", "$.k").cast("int") % 3
    status: Column = F.lit(None).cast("int")
    for name, code in EVENT_STATUS.items():
        status = F.when(F.col("event_type") == name, code).otherwise(status)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("eid"), device.alias("device_id"), "ts", "event_id", status.alias("status"), F.floor(F.col("value") * 10).cast("long").alias("rtt_ms")
    )


STANZAS_SQL = """stanzas AS (
  SELECT user_id AS eid, CAST(json_extract_string(props, '$.k') AS INT) % 3 AS device_id, ts, event_id,
         CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN 2 WHEN 'view' THEN 6 WHEN 'purchase' THEN 10 WHEN 'click' THEN 11 END AS status,
         CAST(floor(value * 10) AS BIGINT) AS rtt_ms
  FROM events)"""


#: Orders and order lines for each partition of edges().
LINES = 500_000


def edge_parts(spark: SparkSession, sf_dir: str) -> int:
    """Partitions for edges(), from the row counts that Parquet keeps: tasks hold LINES rows each on average, of tables of any size.
    Left to itself Spark deals by compressed size, and tens of millions of keys can share a partition."""
    return max(1, math.ceil(sum(table(spark, sf_dir, t).count() for t in ("orders", "lineitem")) / LINES))


def edges(spark: SparkSession, sf_dir: str, by: tuple[str, ...] = ("owner_id", "subscriber_id")) -> DataFrame:
    """(owner_id, subscriber_id): customers follow the suppliers that they have ordered from; no more rows than order lines.

    Rows are dealt by the columns `by`, so that a join or an aggregate on these needs no shuffle of its own."""
    n = edge_parts(spark, sf_dir)
    o, i = table(spark, sf_dir, "orders").repartition(n, "o_orderkey"), table(spark, sf_dir, "lineitem").repartition(n, "l_orderkey")
    pairs = o.join(i, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("owner_id"), F.col("l_suppkey").alias("subscriber_id"))
    return pairs.repartition(n, *by).distinct()


EDGES_SQL = """edges AS (
  SELECT DISTINCT o_custkey AS owner_id, l_suppkey AS subscriber_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""


def message_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(eid, partition_id, offset, from, payload): the turns of each conversation, offsets from 1."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("eid"), F.lit(1).alias("partition_id"), (F.col("turn") + 1).alias("offset"), F.col("role").alias("from"), F.col("text").alias("payload")
    )


LOG_SQL = """log AS (
  SELECT conv_id AS eid, 1 AS partition_id, turn + 1 AS "offset", role AS "from", text AS payload FROM conversations)"""


def as_of(events: DataFrame, ts: str = "ts") -> DataFrame:
    """One row with the latest event time: the clock of snapshot queries, never the wall clock."""
    return events.agg(F.max(ts).alias("as_of"))
