"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Labelled rows outside the held-out fold (crc32 of doc_id mod 4 is 2) are split by that remainder: from 0 and 1 a lexicon is
learned (words and four-letter word starts that stand in toxic texts far oftener than in others), from 3 the trees and,
on another half of them, the calibration. Lexicon and trees see different texts, so the trees learn how far
lexicon hits can be trusted. Features: densities of lexicon words, word starts and disguised lexicon words, their
weight, how many stand next to a second-person word, capitals, punctuation, and rates of disguise and of
stretched words. lang, source and doc_id are never features.

At most TRAIN_ROWS labelled rows are used, chosen by a hash of doc_id, and at most LEXICON entries; both bound what is
broadcast to tasks. Every text is scored, as a whole, where it is read; nothing of it is shuffled.

Edge cases: null and empty texts have zero features and are scored like any other. Without labelled rows of both
kinds every score is the share of toxic ones (0 if none). A null doc_id is not held out and takes no part in learning.
Repeated rows are scored alike. A text of any length is scored as a whole in linear time. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytes_np as B
from .common import cut, table

TRAIN_ROWS, LEXICON, MEMO, STEM = 24_000, 4_000, 300_000, 4
FEATURES = ("n_words", "word_hits", "stem_hits", "disguised_hits", "word_density", "stem_density", "weight", "weight_density", "distinct_hits", "near_you", "you_density", "capitals", "exclaim", "punctuation", "disguise_rate", "stretched_rate")
YOU = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus su usted ustedes vosotros".split())
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
MIXED = re.compile(r"[^\W\d_][^\w\s'’-]+[^\W\d_]|[^\W\d_][0-9]+[^\W\d_]|[0-9][^\W\d_]{2}")
LONG_RUN = re.compile(r"([^\W\d_])\1\1")
PLAIN = str.maketrans("013457@$!|", "oieastasil")
WORD_HIT, STEM_HIT, DISGUISED_HIT, SECOND, DISGUISED, STRETCHED = 1, 2, 4, 8, 16, 32


def clean(token: str) -> str:
    return EDGE.sub("", token).lower()


def undisguised(word: str) -> str:
    """Digits and signs as the letters they stand for, other signs dropped, long runs of a letter cut to one."""
    word = "".join(c for c in word.translate(PLAIN) if c.isalpha())
    return re.sub(r"(.)\1{2,}", r"\1", word)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words (w:) and word starts (s:) of each labelled text."""
    for batch in batches:
        units, marks = [], []
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = {clean(t) for t in set((text or "").split())} - {""}
            own = {f"w:{w}" for w in words if len(w) < 64} | {f"s:{w[:STEM]}" for w in words if len(w) > STEM}
            units += own
            marks += [toxic] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(units, pa.string()), pa.array(marks, pa.int32())], ["unit", "toxic"])


class Features:
    def __init__(self, lexicon: dict[str, float]) -> None:
        self.words = {k[2:]: v for k, v in lexicon.items() if k[0] == "w"}
        self.stems = {k[2:]: v for k, v in lexicon.items() if k[0] == "s"}
        self.memo: dict[str, int] = {}
        self.weight: dict[str, float] = {}

    def flags(self, token: str) -> int:
        if len(self.memo) > MEMO:
            self.memo.clear()
            self.weight.clear()
        word, out, weight = clean(token), 0, 0.0
        if word in self.words:
            out, weight = WORD_HIT, self.words[word]
        elif len(word) > STEM and word[:STEM] in self.stems:
            out, weight = STEM_HIT, self.stems[word[:STEM]]
        if MIXED.search(token):
            out |= DISGUISED
        if LONG_RUN.search(word):
            out |= STRETCHED
        if out & (DISGUISED | STRETCHED) and not out & (WORD_HIT | STEM_HIT) and (plain := undisguised(word)) in self.words:
            out |= DISGUISED_HIT
            weight = self.words[plain]
        if word in YOU:
            out |= SECOND
        self.memo[token] = out
        if weight:
            self.weight[token] = weight
        return out

    def row(self, text: str) -> list[float]:
        tokens = text.split()
        memo = self.memo
        try:
            flags = [memo[t] for t in tokens]
        except KeyError:
            for t in set(tokens):
                if t not in memo:
                    self.flags(t)
            flags = [memo[t] if t in memo else self.flags(t) for t in tokens]
        n = max(len(tokens), 1)
        marked = [i for i, f in enumerate(flags) if f]
        hits = [i for i in marked if flags[i] & (WORD_HIT | STEM_HIT | DISGUISED_HIT)]
        count = lambda bit: sum(1 for i in marked if flags[i] & bit)
        word, stem, hidden, you = count(WORD_HIT), count(STEM_HIT), count(DISGUISED_HIT), count(SECOND)
        weight = sum(self.weight.get(tokens[i], 0.0) for i in hits)
        near = sum(1 for i in hits if any(f & SECOND for f in flags[max(0, i - 4) : i + 5]))
        return [math.log1p(len(tokens)), word, stem, hidden, 100 * word / n, 100 * stem / n, weight, 100 * weight / n, len({tokens[i] for i in hits}), near, 100 * you / n, 100 * count(DISGUISED) / n, 100 * count(STRETCHED) / n]


PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def _features(lexicon: dict[str, float], columns: list[str]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Features(lexicon)
        for batch in batches:
            data, at = B.text_buffers(batch.column("text"))
            for i, j in B.chunks(at, 1 << 21):
                part = data[at[i] : at[j]]
                ends = at[i : j + 1] - at[i]
                sums = [np.concatenate((np.zeros(1, np.int64), np.cumsum(m, dtype=np.int64))) for m in ((part >= 65) & (part <= 90), (part == 33) | (part == 63), PUNCTUATION[part])]
                size = np.maximum(np.diff(ends), 1)
                capitals, exclaim, punctuation = ((s[ends[1:]] - s[ends[:-1]]) * 100 / size for s in sums)
                rows = np.array([own.row(t or "") for t in batch.column("text").slice(i, j - i).to_pylist()], np.float64).reshape(j - i, 13)
                table = np.column_stack((rows[:, :11], capitals, exclaim, punctuation, rows[:, 11:]))
                out = [batch.column(c).slice(i, j - i) for c in columns]
                yield pa.RecordBatch.from_arrays([*out, *(pa.array(table[:, k]) for k in range(len(FEATURES)))], [*columns, *FEATURES])

    return run


def features(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    columns = [c for c in docs.columns if c != "text"]
    kinds = "".join(f"`{c}` {t}, " for c, t in docs.dtypes if c != "text") + ", ".join(f"{f} double" for f in FEATURES)
    return docs.select(*columns, "text").mapInArrow(_features(lexicon, columns), kinds)


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """From rows(text, toxic): the units with their log odds, at most LEXICON of them."""
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    if not bad or not good:
        return {}
    seen = rows.mapInArrow(_units, "unit string, toxic int").groupBy("unit").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    odds = F.log((F.col("bad") + 0.1) / bad * good / (F.col("good") + 0.5))
    best = seen.filter(F.col("bad") >= max(3, 0.004 * bad)).withColumn("odds", odds).filter(F.col("odds") >= math.log(12))
    return {r["unit"]: r["odds"] for r in best.orderBy(F.desc(F.col("bad") * F.col("odds")), "unit").limit(LEXICON).collect()}


def _fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4))


class ToxicityModel:
    """A lexicon, boosted trees and the calibration of their margin."""

    def __init__(self, docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> None:
        marked = labels.select(F.col("doc_id").alias("l_id"), F.col("toxic").cast("int").alias("toxic")).filter("l_id is not null and toxic in (0, 1)").filter(_fold(F.col("l_id")) != 2)
        n = marked.count()
        # a hash threshold keeps the sample near, and the limit surely at, its bound
        share = min(1.0, 0.97 * train_rows / max(n, 1))
        chosen = marked.filter(F.pmod(F.xxhash64("l_id"), F.lit(1 << 20)) < int(share * (1 << 20))).limit(train_rows)
        rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"))
        rows = cut(rows.select("doc_id", "text", "toxic"), "toxic-rows")
        self.lexicon = learn_lexicon(rows.filter(_fold(F.col("doc_id")) < 2).select("text", "toxic"))
        self.assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        rest = cut(features(rows.filter(_fold(F.col("doc_id")) == 3), self.lexicon), "toxic-features")
        rest = self.assemble.transform(rest).select("features", F.col("toxic").cast("double").alias("label"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("calibrate"))
        kinds = {(r["calibrate"], r["label"]): r["n"] for r in rest.groupBy("calibrate", "label").agg(F.count("*").alias("n")).collect()}
        total = sum(kinds.values())
        self.share = sum(v for (_, label), v in kinds.items() if label) / total if total else 0.0
        self.trees = self.calibration = None
        if min(kinds.get((False, 0.0), 0), kinds.get((False, 1.0), 0)) > 0:
            train = rest.filter("not calibrate").repartition(2).cache()
            self.trees = GBTClassifier(maxIter=20, maxDepth=3, maxBins=32, stepSize=0.3, minInstancesPerNode=4, seed=11, cacheNodeIds=False, checkpointInterval=-1).fit(train)
            train.unpersist()
            points = self._margin(rest.filter("calibrate" if min(kinds.get((True, 0.0), 0), kinds.get((True, 1.0), 0)) > 20 else "true"))
            self.calibration = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="score").fit(points)

    def _margin(self, rows: DataFrame) -> DataFrame:
        return self.trees.transform(rows).withColumn("margin", vector_to_array("probability").getItem(1)).drop("rawPrediction", "probability", "prediction")

    def score(self, docs: DataFrame) -> DataFrame:
        """docs(doc_id, text) with score from 0 to 1."""
        rows = features(docs.select("doc_id", "text"), self.lexicon)
        if self.trees is None:
            return rows.select("doc_id", F.lit(float(self.share)).alias("score"))
        scored = self.calibration.transform(self._margin(self.assemble.transform(rows)))
        # a small part of the margin breaks the calibration's ties
        return scored.select("doc_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score") * 0.99 + F.col("margin") * 0.01)).alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs(doc_id, text)."""
    scored = ToxicityModel(docs, labels).score(docs)
    return scored.select("doc_id", F.coalesce(_fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op7_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op7_boosted_toxicity": op7_boosted_toxicity}
SQL: dict[str, str] = {}
