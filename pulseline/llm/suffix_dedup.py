"""Exact substring dedup over a logarithmic family of sparse suffix arrays.

A byte goes if some `span`-byte string that covers it also starts anywhere else in the corpus, same text included.

Sampled suffixes. A suffix of a text is sampled where its `seed`-byte prefix has the least hash of all prefixes in
some window of `span` bytes. The choice depends on the window's own bytes, so equal windows sample at equal offsets
and no match is missed; about one position in (span - seed) / 2 is sampled, and no more than one in a period of repetitive text. A suffix array holds the sampled
suffixes of a batch, ordered by the digest of their seed prefix (equal prefixes are neighbours, which is all that
matching needs), with a flag for prefixes that occur more than once.

Index family. The corpus comes in `batches` batches. Each gets its suffix array, which is merge-scanned against
every existing level for prefixes in both; then levels of equal size merge, so that n batches leave at most
log2(n) + 1 levels and a suffix is rewritten log2(n) times.

Extension. Each sampled suffix stands for the windows in which it is the least (its context). Suffixes with equal
prefix and equal context repeat each other's windows entirely. Where a prefix has several contexts, one suffix of
each context is compared with the others window by window, in tasks that hold a prefix's contexts; a prefix with more
than `hot` contexts is spread by window digest over all tasks instead. Windows are equal if their 64-bit
digests and their prefix digests are equal.

Edge cases: a null or empty text, and a text shorter than `span`, loses nothing (n_removed 0, n_spans 0) and the
digest is that of its bytes. Repeated rows are copies, so they lose every byte from `span` bytes on. doc_id is only
carried along: it may be null or repeated. A text of any length is sampled as a whole in linear time. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytes_np as B
from .common import cut, forget, sieve, table, text_key

SPAN, SEED, BATCHES, HOT = 400, 160, 4, 1024
U = np.uint64


def _rolling_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours: running minima of blocks from both sides."""
    n = len(x) - width + 1
    y = np.concatenate((x, np.full(-len(x) % width, x[-1], x.dtype))).reshape(-1, width)
    left = np.minimum.accumulate(y, axis=1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def sampled(data: np.ndarray, span: int, seed: int) -> tuple[np.ndarray, ...]:
    """Of one text: sampled positions, prefix digests, context digests, first and last start of their windows.

    A window samples the position with the least upper half of the prefix digest in it, the leftmost of equals.
    """
    p = B.prefix_hashes(data)
    _, down = B.powers(len(data) + 1)
    n = len(data) - seed + 1
    prefix = B.mix((p[seed:] - p[:n]) * down[:n])
    ranked = (prefix & U(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    chosen = (_rolling_min(ranked, span - seed + 1) & U(0xFFFFFFFF)).astype(np.int64)
    lo = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
    hi = np.append(lo[1:], len(chosen)) - 1
    at = chosen[lo]
    context = B.mix(B.mix((p[hi + span] - p[lo]) * down[lo]) + (at - lo).astype(np.uint64) * U(1_000_003) + (hi - lo).astype(np.uint64))
    return at, prefix[at], context, lo, hi


def _suffixes(span: int, seed: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = B.text_buffers(batch.column("text"))
            keys = batch.column("tkey")
            parts: list[tuple] = []
            size = 0
            for row in np.flatnonzero(np.diff(at) >= span).tolist():
                parts.append((row, *sampled(data[at[row] : at[row + 1]], span, seed)))
                size += len(parts[-1][1])
                if size > 200_000:
                    yield _suffix_rows(parts, keys)
                    parts, size = [], 0
            if parts:
                yield _suffix_rows(parts, keys)

    return run


def _suffix_rows(parts: list[tuple], keys: pa.Array) -> pa.RecordBatch:
    rows = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts])
    at, prefix, context, lo, hi = (np.concatenate([p[k] for p in parts]) for k in range(1, 6))
    columns = [keys.take(pa.array(rows)), pa.array(at.astype(np.int64)), pa.array(prefix.view(np.int64)), pa.array(context.view(np.int64)), pa.array((at - lo).astype(np.int32)), pa.array((hi - at).astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, ["tkey", "pos", "prefix", "context", "back", "ahead"])


class SuffixIndexFamily:
    """Levels of prefix-ordered suffix arrays; every level is a written table of (prefix, often)."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []
        self.repeats: list[DataFrame] = []
        self.written: list[DataFrame] = []  # arrays, scans and levels merged into others

    def add(self, batch: DataFrame) -> None:
        """batch(prefix): builds its array, scans it against all levels, then merges levels of equal size."""
        array = batch.groupBy("prefix").agg((F.count("*") > 1).alias("often")).sortWithinPartitions("prefix")
        array = cut(array, "suffix-array")
        self.written.append(array)
        self.repeats.append(array.filter("often").select("prefix"))
        scans = [array.select("prefix").join(level.select("prefix"), "prefix") for _, level in self.levels]
        scans = [cut(scan, "suffix-scan") for scan in scans]
        self.repeats += scans
        self.written += scans
        size = 1
        while self.levels and self.levels[-1][0] == size:
            _, old = self.levels.pop()
            self.written.append(old)
            merged = old.union(array).groupBy("prefix").agg(F.max("often").alias("often")).sortWithinPartitions("prefix")
            array, size = cut(merged, "suffix-level"), 2 * size
        self.levels.append((size, array))

    def forget(self) -> None:
        for written in (*(level for _, level in self.levels), *self.written):
            forget(written)

    def repeated(self) -> DataFrame:
        """The prefixes that start at two places or more."""
        found = self.repeats[0]
        for more in self.repeats[1:]:
            found = found.union(more)
        return found.distinct()


def _contexts(span: int):  # noqa: ANN202
    """From (text, wanted suffixes of it) to one row a suffix with the bytes of its context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = B.text_buffers(batch.column("text"))
            want = batch.column("want")
            rows = want.flatten()
            owner = np.repeat(np.arange(len(batch)), np.diff(want.offsets.to_numpy()))
            pos, back, ahead = (rows.field(c).to_numpy() for c in ("pos", "back", "ahead"))
            a = at[:-1][owner] + pos - back
            body = [data[x:y].tobytes() for x, y in zip(a.tolist(), (a + back + ahead + span).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.field("prefix"), rows.field("context"), rows.field("back"), rows.field("ahead"), rows.field("crowd"), pa.array(body, pa.binary())], ["prefix", "context", "back", "ahead", "crowd", "body"])

    return run


def _windows(body: pa.Array, prefix: np.ndarray, back: np.ndarray, ahead: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """Every window of every context: its row, its start relative to the suffix, and its digest with the prefix."""
    data, at = B.text_buffers(body)
    p = B.prefix_hashes(data)
    count = (back + ahead + 1).astype(np.int64)
    row = np.repeat(np.arange(len(count)), count)
    step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    a = at[:-1][row] + step
    digest = B.mix((p[a + span] - p[a]) * B.powers(len(data) + 1)[1][a])
    shift = step - back[row]
    return row, shift, B.mix(digest + B.mix(prefix.view(np.uint64)[row] + shift.astype(np.uint64) * U(0x9E3779B97F4A7C15)))


def _runs(row: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of neighbouring shifts of a row: row, first shift, last shift."""
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (shift[1:] != shift[:-1] + 1))) if len(row) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(row)])) - 1 if len(first) else first
    return row[first], shift[first], shift[last]


def _compare(span: int):  # noqa: ANN202
    """Rows come sorted by prefix; whole prefixes are compared together, many at a time."""

    def shared(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        prefix, context, back, ahead = (rows.column(c).to_numpy() for c in ("prefix", "context", "back", "ahead"))
        row, shift, digest = _windows(rows.column("body").combine_chunks(), prefix, back, ahead, span)
        order = np.argsort(digest, kind="stable")
        d = digest[order]
        same = np.concatenate(([False], d[1:] == d[:-1]))
        same[:-1] |= same[1:].copy()
        hit = np.sort(order[same])
        k, first, last = _runs(row[hit], shift[hit])
        return pa.RecordBatch.from_arrays([pa.array(prefix[k]), pa.array(context[k]), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["prefix", "context", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for start in range(0, len(batch), 4096):
                held.append(batch.slice(start, 4096))
                if sum(map(len, held)) >= 8192:
                    all_rows = pa.Table.from_batches(held)
                    prefix = all_rows.column("prefix").to_numpy()
                    split = int(np.searchsorted(prefix, prefix[-1]))
                    if split:
                        yield shared(all_rows.slice(0, split))
                        held = all_rows.slice(split).to_batches()
        if held:
            yield shared(pa.Table.from_batches(held))

    return run


def _spread(span: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 1024):
                part = batch.slice(start, 1024)
                prefix, context, back, ahead = (part.column(c).to_numpy() for c in ("prefix", "context", "back", "ahead"))
                row, shift, digest = _windows(part.column("body"), prefix, back, ahead, span)
                yield pa.RecordBatch.from_arrays([pa.array(prefix[row]), pa.array(context[row]), pa.array(shift.astype(np.int32)), pa.array(digest.view(np.int64))], ["prefix", "context", "shift", "digest"])

    return run


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repeated shifts of each context as runs."""
    for batch in batches:
        shifts = batch.column("shifts")
        row = np.repeat(np.arange(len(batch)), np.diff(shifts.offsets.to_numpy()))
        shift = shifts.flatten().to_numpy()
        order = np.lexsort((shift, row))
        k, first, last = _runs(row[order], shift[order])
        take = pa.array(k)
        yield pa.RecordBatch.from_arrays([batch.column("prefix").take(take), batch.column("context").take(take), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["prefix", "context", "first", "last"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (tkey, text, spans) to what is left: counts, the digest and the kept runs of bytes."""
    for batch in batches:
        data, at = B.text_buffers(batch.column("text"))
        spans = batch.column("spans")
        limits = spans.offsets.to_numpy()
        starts, stops = (spans.flatten().field(c).to_numpy() for c in ("start", "stop"))
        removed, runs, digests = [], [], []
        for row in range(len(batch)):
            a, b = starts[limits[row] : limits[row + 1]], stops[limits[row] : limits[row + 1]]
            own = data[at[row] : at[row + 1]]
            order = np.argsort(a, kind="stable")
            a, b = a[order], np.maximum.accumulate(b[order])
            new = np.concatenate(([True], a[1:] > b[:-1]))
            a, b = a[new], np.concatenate((b[:-1][new[1:]], b[-1:]))
            left = hashlib.sha256()
            at_byte = 0
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                left.update(own[at_byte:x].tobytes())
                at_byte = y
            left.update(own[at_byte:].tobytes())
            removed.append(int((b - a).sum()))
            runs.append([{"start": x, "stop": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
            digests.append(left.hexdigest())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("tkey"), pa.array(removed, pa.int64()), pa.array(runs, kind), pa.array(digests, pa.string())], ["tkey", "n_removed", "removed", "sha"])


def repeated_substrings(docs: DataFrame, span: int = SPAN, seed: int = SEED, batches: int = BATCHES, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed) for each row of docs(doc_id, text).

    removed lists the maximal removed runs as byte offsets [start, stop) of the input text.
    """
    docs = docs.select("doc_id", "text").withColumn("tkey", text_key(F.coalesce("text", F.lit(""))))
    rows = docs.filter(F.octet_length("text") >= span).select("tkey", "text")
    suffixes = cut(rows.mapInArrow(_suffixes(span, seed), "tkey binary, pos long, prefix long, context long, back int, ahead int"), "suffixes")
    family = SuffixIndexFamily()
    for k in range(batches):
        family.add(suffixes.filter(F.pmod(F.xxhash64("tkey"), F.lit(batches)) == k).select("prefix"))
    # copies of a text sample the same suffixes: one row for all, with their number
    # tables on the small side of joins: Spark splits a hot key only where both sides come straight from a shuffle
    repeated = cut(family.repeated(), "suffix-repeated")
    family.forget()
    hits = cut(suffixes.join(repeated, "prefix"), "suffix-hits")
    matched = cut(hits.groupBy("prefix", "context", "tkey", "pos", "back", "ahead").agg(F.count("*").alias("copies")), "suffix-matched")
    forget(hits)
    # one row a context: at how many places its windows stand, and one suffix that shows its bytes
    kinds = matched.groupBy("prefix", "context").agg(F.sum("copies").alias("n"), F.min(F.struct("tkey", "pos", "back", "ahead")).alias("one"))
    kinds = cut(kinds, "suffix-contexts")
    several = kinds.groupBy("prefix").agg(F.count("*").alias("crowd"), F.min("n").alias("least")).filter("crowd > 1 and least = 1").drop("least")
    several = cut(several, "suffix-several")
    open_kinds = kinds.join(several, "prefix").select("prefix", "context", "crowd", "one.*")
    wanted = open_kinds.groupBy("tkey").agg(F.collect_list(F.struct("prefix", "context", "crowd", "pos", "back", "ahead")).alias("want"))
    # texts with a repeated prefix, once each: the only ones that may lose bytes
    touched = cut(matched.select("tkey").distinct(), "suffix-touched")
    # other texts are dropped and copies collapse in the tasks that read them, before the shuffle
    own = sieve(rows, touched, "tkey")
    texts = cut(own.groupBy("tkey").agg(F.first("text").alias("text")).join(touched.join(wanted, "tkey", "left"), "tkey"), "suffix-texts")
    bodies = texts.filter("want is not null").select("text", "want").mapInArrow(_contexts(span), "prefix long, context long, back int, ahead int, crowd long, body binary")
    bodies = cut(bodies, "suffix-bodies")
    calm = bodies.filter(F.col("crowd") <= hot).drop("crowd").repartition("prefix").sortWithinPartitions("prefix")
    found = calm.mapInArrow(_compare(span), "prefix long, context long, first int, last int")
    windows = bodies.filter(F.col("crowd") > hot).drop("crowd").mapInArrow(_spread(span), "prefix long, context long, shift int, digest long")
    again = windows.groupBy("prefix", "digest").agg(F.count("*").alias("n")).filter("n > 1").select("prefix", "digest")
    crowded = windows.join(again, ["prefix", "digest"]).groupBy("prefix", "context").agg(F.collect_list("shift").alias("shifts")).mapInArrow(_fold, "prefix long, context long, first int, last int")
    whole = kinds.filter("n > 1").select("prefix", "context", (-F.col("one.back")).alias("first"), F.col("one.ahead").alias("last"))
    verdicts = found.union(crowded).union(whole).groupBy("prefix", "context").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    verdicts = cut(verdicts, "suffix-verdicts")
    spans = matched.select("tkey", "pos", "prefix", "context").join(verdicts, ["prefix", "context"])
    spans = spans.select("tkey", "pos", F.explode("runs").alias("r")).select("tkey", (F.col("pos") + F.col("r.first")).alias("start"), (F.col("pos") + F.col("r.last") + span).alias("stop"))
    spans = spans.groupBy("tkey").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    gone = texts.select("tkey", "text").join(spans, "tkey").mapInArrow(_remove, "tkey binary, n_removed long, removed array<struct<start long, stop long>>, sha string")
    gone = cut(gone, "suffix-removed")
    for done in (texts, bodies, matched, kinds, suffixes, verdicts, repeated, several, touched):
        forget(done)
    facts = docs.select("doc_id", "tkey", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("full_sha"))
    out = facts.join(gone, "tkey", "left")
    return out.select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("sha", "full_sha").alias("kept_sha256"), "removed",
    )


def op10_log_index_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op10_log_index_suffix_dedup": op10_log_index_suffix_dedup}
SQL: dict[str, str] = {}
