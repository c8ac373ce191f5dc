"""A corpus pipeline in five stages: quality rules, near-duplicates, repeated lines, benchmark leaks, encoding.

Each stage takes all that the one before kept, as rows with the columns of documents, and its decisions take effect.
Decisions on rows are functions of doc_id and text, so null and repeated ids and repeated rows need no care; columns that
documents has beyond the known ones are carried through. A null or empty text fails the quality rules; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseline.llm.common import cut, forget, row_key, table, text_key
from pulseline.llm.decontaminate import decontaminate
from pulseline.llm.line_dedup import dedup_lines
from pulseline.llm.near_dedup import near_duplicates
from pulseline.llm.quality_rules import BLANK, quality_rules
from pulseline.llm.sentencepiece_codec import encode


def _keyed(docs: DataFrame) -> DataFrame:
    """Each row of docs whole, as struct doc, beside its key: no name of its columns meets one of ours."""
    return docs.select(row_key(F.col("doc_id"), text_key(F.col("text"))).alias("_k"), F.struct("*").alias("doc"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(docs, carry=True).filter("kept").select("doc.*").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8): the one with the least id.

    Of rows with that id and text the one with the least hash of all its columns stays, then the least n_chars, lang and source.
    Documents without words are linked with nothing and stay.
    """
    found = near_duplicates(docs, percent=80).filter("kept and comp is not null")
    first = found.groupBy("comp").agg(F.min(row_key(F.col("doc_id"), F.col("tkey"))).alias("_k")).select("_k")
    order = F.struct(F.xxhash64("doc"), "doc.n_chars", "doc.lang", "doc.source")
    stay = _keyed(docs).join(first, "_k").groupBy("_k").agg(F.min_by("doc", order).alias("doc")).select("doc.*")
    return stay.union(docs.filter(F.length(F.translate(F.coalesce("text", F.lit("")), BLANK, "")) == 0))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of lines and sentences that stand in an earlier one, or earlier in the same; n_chars is counted anew."""
    carried = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    out = dedup_lines(docs.select("doc_id", "text", (F.struct(*(F.col(f"`{c}`") for c in carried)) if carried else F.lit(0)).alias("_rest")))
    new = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")}
    return out.select(*(new.get(c, F.col("_rest")[c].alias(c)) for c in docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item leaks into."""
    leaks = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    leaks = leaks.select(row_key(F.col("doc_id"), F.col("tkey")).alias("_k")).distinct()
    return _keyed(docs).join(leaks, "_k", "left_anti").select("doc.*")


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as SentencePiece ids under merge-dropout, each decoded again and compared with its text."""
    return encode(docs, check=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_good),
    ("near_dedup", drop_near_copies),
    ("line_dedup", drop_repeated_lines),
    ("decontamination", drop_leaks),
    ("sentencepiece", to_pieces),
]

#: No SQL: linked near-duplicates, robust estimates and pieces are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
