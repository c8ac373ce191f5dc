"""Substring dedup by line hashing, in lines cut at sentence ends.

A text is cut into units: at every line feed, and in a line behind . ! or ? with white space after it. A unit keeps the
white space behind it, so the units of a text put together are the text. Units are normalised (lower case, runs of white
space as one space, trimmed) and hashed; a digest's earliest occurrence (lowest doc_id, then text, then place) stays
and all later ones are repeats, wherever they are. Repeats that follow one another in a text make a passage; a passage of
`least` words or more goes, a shorter one stays: single lines and sentences repeat by chance and as stock lines. So a
passage is found inside lines too, but for its first and last unit where these are joined to other words. Offsets of
what goes are those of the input text, in code points.

Digests are grouped with a map-side minimum, so a unit in a third of all documents is one row a task before the shuffle.
Units whose digest may occur twice, by a bounded table of bits, are joined with the digests that do; the digests of over 1 / HOT of all units, of which there are at most HOT, are
joined by broadcast, so that no task gets all rows of a frequent one.

Edge cases: a null text stays null, an empty one empty; a text whose units all go becomes empty, its row stays.
A text of any length is cut in linear time and is held by one task with its units. Repeated rows (also with one doc_id) are
copies: one of them keeps its text. Null doc_ids rank last. Extra columns are returned as they are; one named like a result column
comes back with `_in` at the end of its name. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, forget, marked, packed, schema_of, sieve, table, unpacked

LEAST, HOT = 20, 2_000
LAST = (1 << 63) - 1
UNIT = re.compile(r"(?:[^\n.!?]|[.!?]+[^\x20\x09-\x0D.!?])*+[.!?]*+[\x20\x09-\x0D]*+")
RESULTS = ["n_units", "n_removed", "removed_chars", "removed_spans"]


def units(text: str) -> list[str]:
    return UNIT.findall(text)[:-1]  # the last match is the empty one at the end


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each unit that has a word: its row, its place among the row's units and its digest."""
    for batch in batches:
        for at in range(0, len(batch), 512):
            part = batch.slice(at, 512)
            rows, places, digests = [], [], []
            for row, text in enumerate(part.column("text").to_pylist()):
                for place, unit in enumerate(units(text or "")):
                    words = unit.lower().encode("utf-8", "surrogatepass").split()
                    if words:
                        rows.append(row)
                        places.append(place)
                        digests.append(hashlib.md5(b" ".join(words)).digest())
            take = pa.array(rows, pa.int64())
            kept = [part.column(c).take(take) for c in ("_u_row", "_u_id", "_u_text")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(places, pa.int32()), pa.array(digests, pa.binary())], ["_u_row", "_u_id", "_u_text", "place", "digest"])


def passages(text: str, repeats: set[int], least: int) -> tuple[int, list[tuple[int, int, int]]]:
    """The number of units; (start, stop, units) for each run of repeats that has `least` words or more."""
    own, found = units(text), []
    at = start = words = count = 0
    for place, unit in enumerate([*own, None]):
        if place in repeats:
            start = start if count else at
            words += len(unit.encode("utf-8", "surrogatepass").split())
            count += 1
        else:
            if count and words >= least:
                found.append((start, at, count))
            words = count = 0
        at += len(unit or "")
    return len(own), found


def _rebuild(least: int):  # noqa: ANN202
    """Texts without their repeated passages; offsets of these as start-stop, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, numbers, counts, chars, offsets = [], [], [], [], []
            for text, repeats in zip(batch.column("text").to_pylist(), batch.column("_u_again").to_pylist(), strict=True):
                n, found = passages(text or "", set(repeats or ()), least)
                numbers.append(n)
                counts.append(sum(k for _, _, k in found))
                chars.append(sum(b - a for a, b, _ in found))
                offsets.append(",".join(f"{a}-{b}" for a, b, _ in found))
                edges = [0, *(x for a, b, _ in found for x in (a, b)), len(text or "")]
                texts.append("".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if found else text)
            new = [pa.array(texts, pa.string()), pa.array(numbers, pa.int64()), pa.array(counts, pa.int64()), pa.array(chars, pa.int64()), pa.array(offsets, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_u_rest"), *new], ["doc_id", "_u_rest", "text", *RESULTS])

    return run


def dedup_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with repeated passages taken out of text, and n_units, n_removed (units), removed_chars, removed_spans (as `0-17,30-42`)."""
    extra = [c for c in docs.columns if c not in ("doc_id", "text")]
    rank = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_u_id")
    rows = packed(docs, ["doc_id", "text"], "_u_rest").select("*", F.monotonically_increasing_id().alias("_u_row"), rank, F.xxhash64("text").alias("_u_text"))
    rows = cut(rows, "line-rows")
    own = cut(rows.select("text", "_u_row", "_u_id", "_u_text").mapInArrow(_hashed, "_u_row long, _u_id long, _u_text long, place int, digest binary"), "line-units")
    # most digests occur once: these are dropped where they are read
    twice = cut(own.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest"), "line-twice")
    few = sieve(own.select("digest", "_u_row", "_u_id", "_u_text", "place"), twice, "digest")
    first = few.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("_u_id", "_u_text", "_u_row", "place")).alias("first")).filter("n > 1")
    first = cut(first.select("digest", "n", "first._u_row", "first.place").withColumnsRenamed({"_u_row": "f_row", "place": "f_place"}), "line-first")
    often = own.count() / HOT
    rare = few.join(first.filter(F.col("n") <= often), "digest")
    hot = few.join(F.broadcast(first.filter(F.col("n") > often)), "digest")
    again = rare.union(hot).filter((F.col("_u_row") != F.col("f_row")) | (F.col("place") != F.col("f_place")))
    again = cut(again.groupBy("_u_row").agg(F.collect_list("place").alias("_u_again")), "line-again")
    # texts without a repeat stay where they are
    split = marked(rows.drop("_u_id", "_u_text"), again.select("_u_row"), "_u_row")
    full = split.filter("_may").join(again, "_u_row", "left").drop("_u_row", "_may")
    full = full.unionByName(split.filter("not _may").drop("_u_row", "_may"), allowMissingColumns=True)
    kinds = schema_of(full, ["doc_id", "_u_rest"], "text string, n_units long, n_removed long, removed_chars long, removed_spans string")
    out = cut(full.mapInArrow(_rebuild(least), kinds), "line-kept")
    for done in (rows, own, twice, first, again):
        forget(done)
    return out.select("doc_id", "text", *RESULTS, *unpacked("_u_rest", extra, ["doc_id", "text", *RESULTS]))


def op1_line_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP1_SQL = r"""
WITH cut AS (
  SELECT doc_id, unnest(us) AS unit, unnest(range(1, len(us) + 1)) AS place
  FROM (SELECT doc_id, regexp_extract_all(text, '(?:[^\n.!?]|[.!?]+[^\x20\x09-\x0D.!?])*[.!?]*[\x20\x09-\x0D]*') AS us
        FROM documents WHERE text IS NOT NULL AND text <> '')
), normal AS (
  SELECT doc_id, unit, place, trim(regexp_replace(lower(unit), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm,
         CAST(sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY place) AS BIGINT) - length(unit) AS start
  FROM cut WHERE unit <> ''
), ranked AS (
  SELECT *, norm <> '' AND row_number() OVER (PARTITION BY norm ORDER BY doc_id, place) > 1 AS again,
         CASE WHEN norm = '' THEN 0 ELSE len(string_split(norm, ' ')) END AS words
  FROM normal
), runs AS (
  SELECT *, count(*) FILTER (NOT again) OVER (PARTITION BY doc_id ORDER BY place) AS run FROM ranked
), judged AS (
  SELECT *, again AND sum(words) FILTER (again) OVER (PARTITION BY doc_id, run) >= 20 AS gone FROM runs
), spans AS (
  SELECT doc_id, run, min(start) AS a, max(start + length(unit)) AS b FROM judged WHERE gone GROUP BY doc_id, run
), listed AS (
  SELECT doc_id, string_agg(a || '-' || b, ',' ORDER BY a) AS removed_spans FROM spans GROUP BY doc_id
), kept AS (
  SELECT doc_id, count(*) AS n_units, count(*) FILTER (gone) AS n_removed,
         coalesce(sum(length(unit)) FILTER (gone), 0) AS removed_chars,
         coalesce(string_agg(unit, '' ORDER BY place) FILTER (NOT gone), '') AS text
  FROM judged GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL OR d.text = '' THEN d.text ELSE k.text END AS text,
       CAST(coalesce(n_units, 0) AS BIGINT) AS n_units, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(removed_chars, 0) AS BIGINT) AS removed_chars, coalesce(removed_spans, '') AS removed_spans
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN listed USING (doc_id)
"""

QUERIES = {"op1_line_hash_dedup": op1_line_hash_dedup}
SQL = {"op1_line_hash_dedup": OP1_SQL}
