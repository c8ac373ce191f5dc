"""Framed log files: records of length (u32, big-endian), CRC-32 (u32) and bytes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def frame(body: Column) -> Column:
    """One record, as bytes: built from SQL functions, so writers need no Python."""
    word = lambda n: F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0"))
    return F.concat(word(F.octet_length(body)), word(F.crc32(body)), body)


def records(data: bytes) -> Iterator[tuple[int, int, bytes | None, str | None]]:
    """(number, position, body, problem): a short or corrupt record is the last one, with its problem."""
    at = n = 0
    while at < len(data):
        if len(data) - at < 8:
            yield n, at, None, "short header"
            return
        size, crc = struct.unpack_from(">II", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(body) < size:
            yield n, at, None, "short body"
            return
        if zlib.crc32(body) != crc:
            yield n, at, None, "checksum"
            return
        yield n, at, body, None
        n, at = n + 1, at + 8 + size


def read_framed(spark: SparkSession, path: str) -> DataFrame:
    """(path, number, position, body, problem) of every record of every file under path; each segment file is one task's work."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, data in zip(batch["path"], batch["content"], strict=True):
                rows = [(file, *r) for r in records(bytes(data))]
                yield pd.DataFrame(rows, columns=["path", "number", "position", "body", "problem"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, number long, position long, body binary, problem string")
