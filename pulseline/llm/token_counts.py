"""Token counts by rank-synchronous merging of whole batches of pre-tokens.

A text is cut at special strings, each piece is cut at spaces and line feeds (no token crosses one), and the counts
of a text's chunks are added up. Chunks that a task has not met before are normalised, split into pre-tokens and
held as one ragged numpy array of symbol ids; in every round each pre-token's lowest-rank pair is merged wherever it
occurs in that pre-token, all pre-tokens at once, until none has a known pair. A learned merge can only form pairs of
higher rank, so this equals merging one pair at a time. Counts of recent chunks are kept, at most MEMO of them.

Reads tokenizer files with a BPE model, an end-of-word suffix and a splitting pattern; the path is a parameter.

Edge cases: null and empty texts count 0 bytes and 0 tokens; a text of white space only has 0 tokens. A text of any length is counted as a whole. doc_id is only
carried along, so null and repeated ids are fine; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytes_np as B
from .common import table

LIMIT, MEMO = 2048, 400_000
NONE = np.int64(1) << 40
#: The tokenizer's own \s; str.split knows a few more characters.
BLANK = regex.compile(r"\p{White_Space}+")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable Latin-1, else from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MergeTable:
    """A vocabulary's pairs as sorted arrays, its splitting pattern and special strings."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + suffix] for s in symbols], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.n = len(vocab)
        code = np.array([vocab[a] * self.n + vocab[b] for a, b in pairs], np.int64)
        result = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(code, kind="stable")
        self.code, self.rank, self.result = code[order], order.astype(np.int64), result[order]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        special = [t["content"] for t in spec["added_tokens"]]
        self.marks = special
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def pre_tokens(self, chunk: str) -> list[str]:
        import unicodedata

        chunk = BLANK.sub(" ", unicodedata.normalize("NFC", chunk))
        return self.pattern.findall(chunk.replace("Σ", "σ").lower())

    def lengths(self, tokens: list[str]) -> np.ndarray:
        """The number of symbols that each pre-token ends with."""
        raw = [t.encode() for t in tokens]
        size = np.array([len(r) for r in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        symbol = self.inner[flat]
        ends = np.cumsum(size) - 1
        symbol[ends] = self.last[flat[ends]]
        row = np.repeat(np.arange(len(raw)), size)
        out = np.ones(len(raw), np.int64)
        while len(symbol):
            code = symbol[:-1] * self.n + symbol[1:]
            k = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
            known = (self.code[k] == code) & (row[:-1] == row[1:])
            rank = np.append(np.where(known, self.rank[k], NONE), NONE)
            first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            low = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(row)))
            out[row[first]] = size
            open_rows = np.repeat(low < NONE, size)
            hit = open_rows & (rank == np.repeat(low, size))
            # in a run of overlapping occurrences every second one merges, from the left
            at = np.flatnonzero(hit)
            new = np.concatenate(([True], at[1:] != at[:-1] + 1)) if len(at) else np.zeros(0, bool)
            step = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0)) if len(at) else at
            at = at[step % 2 == 0]
            symbol[at] = self.result[k[at]]
            stay = open_rows
            stay[at + 1] = False
            symbol, row = symbol[stay], row[stay]
        return out


class ChunkCounter:
    def __init__(self, path: str) -> None:
        self.merges = MergeTable(path)
        self.known: dict[str, int] = {"": 0}

    def learn(self, chunks: list[str]) -> None:
        words = [self.merges.pre_tokens(c) for c in chunks]
        distinct = list({w: None for ws in words for w in ws})
        if distinct:
            size = dict(zip(distinct, self.merges.lengths(distinct).tolist(), strict=True))
        for chunk, ws in zip(chunks, words, strict=True):
            self.known[chunk] = sum(size[w] for w in ws) if ws else 0

    def count(self, texts: list[str | None]) -> list[int]:
        extra, parts = [], []
        for text in texts:
            text = text or ""
            marks = 0
            if any(m in text for m in self.merges.marks):
                text, marks = self.merges.special.subn(" ", text)
            extra.append(marks)
            parts.append(text.replace("\n", " ").split(" "))
        new = list({c: None for p in parts for c in p if c not in self.known})
        if len(self.known) + len(new) > MEMO:
            self.known = {"": 0}
            new = list({c: None for p in parts for c in p if c})
        if new:
            self.learn(new)
        get = self.known.__getitem__
        return [n + sum(map(get, p)) for n, p in zip(extra, parts, strict=True)]


@lru_cache(maxsize=2)
def counter(path: str) -> ChunkCounter:
    return ChunkCounter(path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _count(vocabulary: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary if "/" in vocabulary else tokenizer_path(vocabulary))
        for batch in batches:
            text = batch.column("text")
            _, at = B.text_buffers(text)
            n = [x for i, j in B.chunks(at, 1 << 21) for x in own.count(text.slice(i, j - i).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row; vocabulary is a path, or the name of a public file."""
    counted = docs.select("doc_id", "text").mapInArrow(_count(vocabulary), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op2_rank_synchronous_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


QUERIES = {"op2_rank_synchronous_token_counts": op2_rank_synchronous_token_counts}
SQL: dict[str, str] = {}
