"""Quality by importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k sampling.

Words (lower case) and pairs of neighbours are hashed into BUCKETS. Two smoothed bag models are counted: raw text
over every document, target text over every document labelled good. A document's
log weight is the sum over its n-grams of log target share minus log raw share. Each adds a Gumbel variate drawn from a
keyed hash of doc_id and text, and the k greatest sums are kept, k being the share KEEP of all rows: sampling without
replacement in proportion to the weights. The k-th sum is found by counting ever finer ranges, so nothing is sorted
or gathered; the counts of a range (at most 4096 numbers) and the two models (BUCKETS numbers each) are all that
the driver sees.

Edge cases: null and empty texts have no n-grams and log weight 0. Rows that tie exactly with the k-th (repeated
rows) are all kept. A null doc_id is drawn by its text alone and is never target. Without target rows both models are
the raw one: all weights are 0 and the sample is uniform. A text of any length is counted as a whole in linear time. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytes_np as B
from .common import cut, marked, table

BUCKETS, KEEP, SEED = 1 << 14, 0.85, 9
U = np.uint64
PAIR = U(0x9E3779B97F4A7C15)


def ngram_buckets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of rows i..j: the bucket of every word and pair, and the row (from 0) that it is in."""
    data, at = B.text_buffers(column)
    for i, j in B.chunks(at):
        part, local = data[at[i] : at[j]], at[i : j + 1] - at[i]
        starts, ends, first = B.word_spans(part, local)
        words = B.word_hashes(part, starts, ends)
        row = np.repeat(np.arange(j - i), np.diff(first))
        pairs = B.mix(words[:-1] * PAIR + words[1:])
        inside = row[:-1] == row[1:]
        yield i, j, (np.concatenate((words, pairs[inside])) % U(BUCKETS)).astype(np.int64), np.concatenate((row, row[:-1][inside]))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        good = batch.column("target").to_numpy(zero_copy_only=False).astype(bool)
        for i, j, bucket, row in ngram_buckets(batch.column("text")):
            raw += np.bincount(bucket, minlength=BUCKETS)
            target += np.bincount(bucket[good[i:j][row]], minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(raw), pa.array(target)], ["bucket", "raw", "target"])


def _weights(ratio: np.ndarray, seed: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, weight = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            for i, j, bucket, row in ngram_buckets(batch.column("text")):
                n[i:j] = np.bincount(row, minlength=j - i)
                weight[i:j] = np.bincount(row, ratio[bucket], minlength=j - i)
            draw = B.mix(batch.column("draw").to_numpy().view(np.uint64) + U(seed))
            uniform = ((draw >> U(11)).astype(np.float64) + 0.5) / 2**53
            total = weight - np.log(-np.log(uniform))
            bits = (total + 0.0).view(np.int64)
            key = np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)  # orders like the number
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(weight), pa.array(key)], ["doc_id", "n_grams", "log_weight", "key"])

    return run


def kth_greatest(keys: DataFrame, k: int, ranges: int = 4096) -> int:
    """The k-th greatest value of column key (long), by counts of ever finer ranges."""
    low, width = -(1 << 63), 1 << 64
    while width > 1:
        high = low + width  # where the range found before ends
        width //= ranges if width >= ranges else width
        step = F.floor((F.col("key").cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)")).cast("int")
        inside = keys.filter((F.col("key") >= low) & (F.col("key") <= high - 1))
        counts = {r["at"]: r["n"] for r in inside.groupBy(step.alias("at")).agg(F.count("*").alias("n")).collect()}
        for at in sorted(counts, reverse=True):
            if k <= counts[at]:
                low += at * width
                break
            k -= counts[at]
    return low


def with_target(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, target) for each row of docs: whether it is labelled good. Texts that a table of bits rules out stay where they are read; only the others are shuffled."""
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("g_id")).distinct()
    split = marked(docs.select(F.col("doc_id").cast("long").alias("g_id"), "text"), good, "g_id")
    asked = split.filter("_may").join(good.withColumn("target", F.lit(True)), "g_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    return asked.union(split.filter("not _may").select("text", F.lit(False).alias("target")))


def importance_sample(docs: DataFrame, labels: DataFrame, keep: float = KEEP, seed: int = SEED) -> DataFrame:
    """(doc_id, n_grams, log_weight, kept) for each row of docs(doc_id, text)."""
    counts = with_target(docs, labels).mapInArrow(_counts, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for r in counts:
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum()) if target.sum() > BUCKETS else np.zeros(BUCKETS)
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("draw"))
    scored = cut(rows.mapInArrow(_weights(ratio, seed), "doc_id long, n_grams long, log_weight double, key long"), "importance")
    k = round(keep * scored.count())
    least = kth_greatest(scored, k) if k else (1 << 63) - 1
    return scored.select("doc_id", "n_grams", "log_weight", (F.col("key") >= least).alias("kept"))


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op9_importance_resampling": op9_importance_resampling}
SQL: dict[str, str] = {}
