"""Keyed tables as versioned Parquet folders: create if missing, read the newest version, replace atomically."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession


class TableStore:
    """Each table is root/name/v<n>; a version counts once Spark's commit marker is there, so readers never see half a write."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self, name: str) -> list[int]:
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = folder.getFileSystem(conf)
        if not fs.exists(folder):
            return []
        found = [f.getPath() for f in fs.listStatus(folder)]
        return sorted(int(p.getName()[1:]) for p in found if p.getName().startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def create_if_missing(self, name: str, schema: str) -> None:
        if not self._versions(name):
            self.replace(name, self.spark.createDataFrame([], schema))

    def read(self, name: str) -> DataFrame:
        versions = self._versions(name)
        if not versions:
            raise LookupError(f"no table {name}")
        return self.spark.read.parquet(f"{self.root}/{name}/v{versions[-1]}")

    def lookup(self, name: str, condition: Column) -> DataFrame:
        return self.read(name).filter(condition)

    def replace(self, name: str, rows: DataFrame) -> None:
        """Writes the next version; rows may be computed from the current one."""
        n = max([0, *self._versions(name)]) + 1
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/v{n}")
