"""Shared helpers: tables, work tables in the shared folder, digests, graph components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and all run in one process."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="pulseline-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends here and a lost executor costs no rerun."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/work/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a table made by cut() once nothing reads it any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/work/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def packed(docs: DataFrame, need: list[str], name: str) -> DataFrame:
    """The columns of docs in need, and all others as one struct column `name`, so that no name of theirs meets one of ours."""
    return docs.select(*need, F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in need), F.lit(0).alias("_end")).alias(name))


def schema_of(df: DataFrame, own: list[str], ddl: str) -> StructType:
    """The columns `own` of df as they are, then those of ddl."""
    return StructType([*(df.schema[c] for c in own), *StructType.fromDDL(ddl).fields])


def unpacked(rest: str, columns: list[str], results: list[str]) -> list[Column]:
    """The fields `columns` of struct column rest as columns of their own; one named like a result gets `_in` at its end, as often as needed."""
    taken, out = {c.lower() for c in results}, []
    for c in columns:
        new = c
        while new.lower() in taken:
            new += "_in"
        taken.add(new.lower())
        out.append(F.col(rest)[c].alias(new))
    return out


def text_key(text: Column) -> Column:
    """16-byte digest of a text; null stays null."""
    return F.unhex(F.md5(text.cast("binary")))


def row_key(doc_id: Column, tkey: Column) -> Column:
    """One value for doc_id and the text's key, never null: rows with equal values are copies of one another."""
    return F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(F.hex(tkey), F.lit("null"))))


#: 64-bit words of a sieve: at most so many rows are broadcast.
SIEVE = 1 << 20


def marked(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """rows with _may: whether column `name` may be among keys(name). It is true for all that are, and for some others.

    Keys set bits of a table of at most SIEVE words, which is broadcast, so rows are told apart where they are read and before
    they are shuffled. Where there are more keys than bits nearly all rows may, and the join that follows does the work alone.
    """
    bit = F.pmod(F.xxhash64(name), F.lit(SIEVE * 64))
    word = F.floor(bit / 64)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))
    words = cut(keys.select(word.alias("_word"), one.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits")), "sieve")
    held = rows.join(F.broadcast(words), word == F.col("_word"), "left")
    return held.withColumn("_may", F.coalesce(F.col("_bits").bitwiseAND(one) != 0, F.lit(False))).drop("_word", "_bits")


def sieve(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """The rows whose column `name` may be among keys(name)."""
    return marked(rows, keys, name).filter("_may").drop("_may")


#: Edges a task of components() takes where they are few; up to so many, labels are broadcast.
PACK, SMALL = 1 << 16, 1 << 17


def _toward_least(edges: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The same components with fewer edges: each vertex and its smaller neighbours hang on the least of these."""
    low = edges.groupBy("b").agg(F.min("a").alias("m"))
    hung = edges.join(near(low), "b")
    return hung.select(F.col("m").alias("a"), F.col("a").alias("b")).union(hung.select("m", "b")).filter("a <> b").distinct()


def components(edges: DataFrame, tag: str, shrink: int = 2) -> DataFrame:
    """Connected components of edges(a, b): rows (v, root), root the smallest vertex reachable.

    Edges are first hung on least neighbours `shrink` times, which takes most of them away where groups are dense.
    Then minimum labels travel along edges and every round follows the label's own label, so paths halve. Each round
    is written to the shared folder and ends in one count; only that count reaches the driver.
    The number of edges sets the tasks and files of a round, so a small graph doesn't cost a task and a file for each shuffle
    partition and round; labels of up to SMALL edges are broadcast, those of more are shuffled.
    """
    n = edges.count()
    few = lambda df, name: cut(df.coalesce(max(1, -(-n // PACK))), f"{tag}-{name}")
    near = F.broadcast if n <= SMALL else lambda df: df
    loops = edges.filter("a = b").select("a", "b")
    thin = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for _ in range(shrink):
        thin = few(_toward_least(thin, near), "thin")
    both = few(thin.union(thin.select(F.col("b"), F.col("a"))).union(loops).distinct(), "edges")
    labels = few(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.min("a")).alias("root")), "labels")
    while True:
        seen = both.join(near(labels.select(F.col("v").alias("b"), F.col("root").alias("far"))), "b")
        low = seen.groupBy(F.col("a").alias("v")).agg(F.min("far").alias("far"))
        step = low.join(near(labels), "v").select("v", "root", F.least("root", "far").alias("to"))  # each vertex has an edge, so a row in low
        jump = step.join(near(labels.select(F.col("v").alias("to"), F.col("root").alias("over"))), "to", "left")
        new = few(jump.select("v", F.least("to", "over").alias("root"), F.col("root").alias("was")), "labels")
        moved = new.filter("root <> was").limit(1).count()
        forget(labels)
        labels = new.select("v", "root")
        if not moved:
            forget(both)
            return labels
