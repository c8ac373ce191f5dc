"""Streaming sinks: the offset log with dense offsets, and ordered frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulseline.operators import log as L
from pulseline.sources.table_store import TableStore

NEXT = "eid string, partition_id int, next_offset long, batch long"


class LogSink:
    """Appends records(eid, partition_id, ...) of a stream to root/records, a folder a micro-batch, with offsets that
    continue each key's log. Next offsets are a table of one row a key; it remembers the batch that wrote it, so a
    batch that is run again after a failure gets the offsets that it had."""

    def __init__(self, spark: SparkSession, root: str, order: list[str]) -> None:
        self.spark, self.root, self.order = spark, root.rstrip("/"), order
        self.store = TableStore(spark, f"{self.root}/state")
        self.store.create_if_missing("next", NEXT)

    def write(self, batch: DataFrame, batch_id: int) -> None:
        known = self.store.read("next").filter(F.col("batch") < batch_id)  # later rows are from an earlier try
        last = known.groupBy(*L.LOG_KEY).agg((F.max("next_offset") - 1).alias("offset"))
        folder = f"{self.root}/records/batch={batch_id}"
        L.append(last, batch, self.order).write.mode("overwrite").parquet(folder)
        new = L.next_offsets(self.spark.read.parquet(folder)).withColumn("batch", F.lit(batch_id).cast("long"))
        # a key keeps its row of an earlier batch beside the new one until the next batch proves this one done
        newest = known.groupBy(*L.LOG_KEY).agg(F.max_by(F.struct("next_offset", "batch"), "batch").alias("r")).select(*L.LOG_KEY, "r.*")
        self.store.replace("next", newest.unionByName(new))

    def start(self, stream: DataFrame, checkpoint: str, **trigger: object) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint).trigger(**trigger).start()

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/records").drop("batch")


def frames_by_receiver(frames: DataFrame, order: list[str]) -> DataFrame:
    """(receiver, frames): each receiver's frames of a micro-batch as one ordered list. Lists are as long as a
    micro-batch makes them; bound that with the source's rate options."""
    listed = F.array_sort(F.collect_list(F.struct(*order, "frame")))
    return frames.groupBy("receiver").agg(F.transform(listed, lambda x: x["frame"]).alias("frames"))


def to_each(stream: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str, **trigger: object) -> StreamingQuery:
    """Hands every micro-batch to send(rows, batch_id)."""
    return stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(**trigger).start()
