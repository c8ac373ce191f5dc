"""Near-duplicate documents by a chosen-path set similarity join.

Documents with the same shingle set are one vertex. Each of TREES independent trees branches the vertices: at
every level a vertex follows its minwise shingle under that level's hash, so the path of a vertex is a list of
minwise shingles, and two sets of similarity s share a path of length d with probability s**d. A node of at most
`leaf` vertices is not branched further; a node that is still larger at the last level is compared block by
block, never capped. With s = 0.85, DEPTH = 4 and TREES = 24 a pair is missed with probability
(1 - 0.85**4)**24 = 2e-8.

Comparison is in two rounds. First every vertex is compared with one other, the node leader (a node's smallest
vertex) that it meets in most nodes. Then, in nodes that still hold several components, pairs of different components are
compared exhaustively by an estimate over the 96 minwise values (for a threshold of 0.85 its cut-off of 0.65 lies over five
standard deviations below). Alike vertices form clusters, and inside a cluster all pairs of different components are
compared, block against block, on full shingle sets. Tasks return links of stars and chains, never pairs: a group of
copies costs its size in rows, not its square.

Edge cases: null and empty texts, and texts of white space only, have no shingles, are linked with nothing and
keep their own doc_id. A text of one to four words is one shingle. Repeated rows share a set, so they share a
component. A null doc_id takes part with its text and never names a component (unless all ids of it are null).
Only doc_id and text are read, so extra columns don't matter. A text of any length is one set, held by one task at a time. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytes_np as B
from .common import components, cut, forget, sieve, table, text_key

WORDS, TREES, DEPTH, LEAF, BLOCK = 5, 24, 4, 32, 256
BLOCK_SHINGLES = 1_000_000
SLACK = 0.20
U = np.uint64
_rng = np.random.default_rng(77)
MIX_IN = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) * U(2) + U(1)
PLUS = _rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)
TIMES = _rng.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * U(2) + U(1)


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of rows i..j: the sorted distinct shingle hashes of all, and each row's start among them."""
    data, at = B.text_buffers(column)
    for i, j in B.chunks(at):
        part, local = data[at[i] : at[j]], at[i : j + 1] - at[i]
        starts, ends, first = B.word_spans(part, local)
        words = B.word_hashes(part, starts, ends)
        sums = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
        for k in range(WORDS):
            sums += words[k : k + len(sums)] * MIX_IN[k]
        sums = B.mix(sums)
        sets = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= WORDS:
                sets.append(np.unique(sums[a : b - WORDS + 1]))
            elif b > a:
                short = (words[a:b] * MIX_IN[: b - a]).sum(dtype=np.uint64)[None] + U(b - a)
                sets.append(B.mix(short))
            else:
                sets.append(np.zeros(0, np.uint64))
        yield i, j, np.concatenate(sets), np.cumsum([0, *map(len, sets)])


def set_keys(flat: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """16 bytes that name each set; None for an empty one."""
    full = np.flatnonzero(np.diff(at))
    out: list[bytes | None] = [None] * (len(at) - 1)
    if len(full):
        halves = [np.add.reduceat(B.mix(flat ^ U(c)), at[full]) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
        for k, x in zip(full.tolist(), np.stack(halves, 1), strict=True):
            out[k] = x.tobytes()
    return out


def minwise(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """TREES * DEPTH minwise values of each set, as int32; 0 for an empty one."""
    full = np.flatnonzero(np.diff(at))
    out = np.zeros((len(at) - 1, TREES * DEPTH), np.int32)
    step = 0
    while step < len(full):  # as many sets at a time as stay in the processor's cache
        stop = max(step + 1, int(np.searchsorted(at[full], at[full[step]] + 40_000)))
        own = full[step:stop]
        x, cuts = flat[at[own[0]] : at[own[-1] + 1]], at[own] - at[own[0]]
        for f in range(TREES * DEPTH):
            low = np.minimum.reduceat((x ^ PLUS[f]) * TIMES[f], cuts)
            out[own, f] = (B.mix(low) >> U(32)).astype(np.uint32).view(np.int32)
        step = stop
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("text")
        for i, j, flat, at in shingle_sets(text):
            values = minwise(flat, at)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, TREES * DEPTH, dtype=np.int32)), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(i, j - i), batch.column("tkey").slice(i, j - i), pa.array(np.diff(at).astype(np.int64)), pa.array(set_keys(flat, at), pa.binary()), lists],
                ["doc_id", "tkey", "n_shingles", "skey", "mh"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, flat, at in shingle_sets(batch.column("text")):
            own = [flat[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("rid").slice(i, j - i), pa.array(own, pa.binary())], ["rid", "shingles"])


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The exact intersection and union sizes of pairs with both sets."""
    for batch in batches:
        xs, ys = batch.column("x"), batch.column("y")
        n, m = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
        for k in range(len(batch)):
            x, y = (np.frombuffer(c[k].as_buffer(), np.uint64) for c in (xs, ys))
            both = np.concatenate((x, y))
            both.sort(kind="stable")
            n[k] = np.count_nonzero(both[1:] == both[:-1])
            m[k] = len(both) - n[k]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(n), pa.array(m)], ["a", "b", "shared", "together"])


class Forest:
    """Joined sets of the numbers below n."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.root(x)] = self.root(y)

    def links(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each joined number's name with the name of its set's root: a star a set, of as many links as members less one."""
        roots = np.array([self.root(x) for x in range(len(self.up))], np.int64)
        out = np.flatnonzero(roots != np.arange(len(roots)))
        a, b = names[roots[out]], names[out]
        keep = a != b
        return a[keep], b[keep]


def _link(percent: int, least: float):  # noqa: ANN202
    """Rows come sorted by (root, block, role), the bases of a block first (role 0), then its probes: links of different components."""

    class Block:
        def __init__(self) -> None:
            self.rid, self.comp, self.sets = [], [], []
            self.values: list[np.ndarray] = []
            self.own = Forest(0)
            self.name: dict[int, int] = {}

        def place(self, comp: int) -> int:
            """The number of a component in the forest of those met so far."""
            if comp not in self.name:
                self.name[comp] = len(self.own.up)
                self.own.up.append(len(self.own.up))
            return self.name[comp]

        def meet(self, rows: pa.RecordBatch, keep: bool) -> Iterator[tuple[int, int]]:
            """Links of these rows with the bases so far; with keep they become bases as well."""
            lists = rows.column("mh").flatten().to_numpy().reshape(len(rows), -1)
            for k, (rid, comp) in enumerate(zip(rows.column("rid").to_pylist(), rows.column("comp").to_pylist(), strict=True)):
                own = np.frombuffer(rows.column("shingles")[k].as_buffer(), np.uint64)
                me = self.place(comp)
                size = np.array([len(x) for x in self.sets])
                if len(size):
                    fit = np.flatnonzero((np.array(self.comp) != comp) & (np.minimum(size, len(own)) * 100 >= np.maximum(size, len(own)) * percent))
                    if len(fit):
                        fit = fit[(np.stack([self.values[q] for q in fit]) == lists[k]).sum(1) >= least * lists.shape[1]]
                    for q in fit.tolist():
                        other = self.place(self.comp[q])
                        if self.own.root(me) != self.own.root(other):  # what is one component already needs no comparison
                            both = np.concatenate((own, self.sets[q]))
                            both.sort(kind="stable")
                            shared = int(np.count_nonzero(both[1:] == both[:-1]))
                            if shared * 100 >= (len(both) - shared) * percent:
                                self.own.join(me, other)
                                yield self.rid[q], rid
                if keep:
                    self.rid.append(rid)
                    self.comp.append(comp)
                    self.sets.append(own)
                    self.values.append(lists[k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, name = Block(), None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("root", "block", "role")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(batch)]
            found: list[tuple[int, int]] = []
            for start, end in zip(cuts, cuts[1:], strict=False):
                if start == end:
                    continue
                if tuple(keys[start, :2]) != name:
                    block, name = Block(), tuple(keys[start, :2])
                found += block.meet(batch.slice(start, end - start), keep=keys[start, 2] == 0)
            out = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])

    return run


def _compare(least: float, share: float):  # noqa: ANN202
    def pairs(run: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        rows = pa.Table.from_batches(run).combine_chunks()
        rid, comp, size, role = (rows.column(c).to_numpy() for c in ("rid", "comp", "n_shingles", "role"))
        values = rows.column("mh").combine_chunks().flatten().to_numpy().reshape(len(rows), -1)
        base, probe = np.flatnonzero(role != 1), np.flatnonzero(role != 0)
        own = Forest(len(rid))
        for p in probe:
            low, high = np.minimum(size[base], size[p]), np.maximum(size[base], size[p])
            fit = base[(comp[base] != comp[p]) & (low >= share * high) & ((role[base] == 0) | (rid[base] > rid[p]))]
            if len(fit):
                for q in fit[(values[fit] == values[p]).sum(1) >= least * values.shape[1]].tolist():
                    own.join(int(p), q)
        return own.links(rid)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (node, block, role): bases first, so a block holds its bases and one batch of probes."""
        held: list[pa.RecordBatch] = []
        name = None
        for batch in batches:
            nodes, parts = batch.column("node").to_numpy(), batch.column("block").to_numpy()
            ends = [*(np.flatnonzero((nodes[1:] != nodes[:-1]) | (parts[1:] != parts[:-1])) + 1).tolist(), len(batch)]
            start = 0
            for end in ends:
                if end == start:
                    continue
                key = (nodes[start], parts[start])
                if name is not None and key != name:
                    a, b = pairs(held)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                    held = []
                name = key
                held.append(batch.slice(start, end - start))
                if sum(map(len, held)) > 64 * BLOCK:  # a long run of probes: compare, then keep the bases alone
                    a, b = pairs(held)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                    held = [x for x in (h.filter(pa.array(h.column("role").to_numpy() == 0)) for h in held) if len(x)]
                start = end
        if held:
            a, b = pairs(held)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return blocks


def _nodes(reps: DataFrame, leaf: int) -> list[DataFrame]:
    """One written table a level: (node, rid, n, leader) for each node of two vertices or more."""
    value = lambda k: F.element_at("mh", F.col("t") * DEPTH + k)
    live = reps.select("rid", "mh", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("t")).select(
        "rid", F.xxhash64("t", value(1)).alias("node"), *(value(k).alias(f"m{k}") for k in range(2, DEPTH + 1))
    )
    levels = []
    for level in range(1, DEPTH + 1):
        sizes = live.groupBy("node").agg(F.count("*").alias("n"), F.min("rid").alias("leader")).filter("n > 1")
        sizes = cut(sizes, "near-sizes")  # as a table: Spark splits a hot node only where both sides come straight from a shuffle
        levels.append(cut(live.join(sizes, "node"), f"near-level{level}"))
        if level == DEPTH or not levels[-1].filter(F.col("n") > leaf).limit(1).count():
            break
        live = levels[-1].filter(F.col("n") > leaf).drop("n", "leader").withColumn("node", F.xxhash64("node", f"m{level + 1}"))
    return levels


def _full_sets(ids: DataFrame, reps: DataFrame, docs: DataFrame, tag: str) -> DataFrame:
    """The full shingle sets of ids(rid), from one text of each."""
    need = cut(reps.join(ids, "rid", "left_semi").select("rid", F.col("tkey").alias("want")), "near-need")
    # texts that aren't wanted are dropped and copies collapse in the tasks that read them, before the shuffle
    texts = sieve(docs.select("tkey", "text"), need.select(F.col("want").alias("tkey")), "tkey").groupBy("tkey").agg(F.first("text").alias("text")).join(need, F.col("tkey") == F.col("want")).select("rid", "text")
    return cut(texts.mapInArrow(_sets, "rid long, shingles binary"), tag)


def _confirm(pairs: DataFrame, reps: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold."""
    pairs = cut(pairs, "near-pairs")
    sets = _full_sets(pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).distinct(), reps, docs, "near-pair-sets")
    left = pairs.join(sets.select(F.col("rid").alias("a"), F.col("shingles").alias("x")), "a")
    full = left.join(sets.select(F.col("rid").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    links = cut(full.mapInArrow(_overlaps, "a long, b long, shared long, together long").filter(F.col("shared") * 100 >= F.col("together") * percent), "near-links")
    forget(sets)
    return links.select("a", "b")


def _cluster_links(alike: DataFrame, roots: DataFrame, reps: DataFrame, docs: DataFrame, percent: int, least: float) -> DataFrame:
    """Links between components inside the clusters that alike(a, b) connects.

    Every row is a base in one block of its cluster. The rows outside the cluster's largest component are probes in all blocks, so a
    cluster that is one component but for a few rows costs its size, however large it is.
    """
    named = components(alike, "near-cluster").select(F.col("v").alias("rid"), "root")
    named = named.join(reps.select("rid", "mh", "n_shingles"), "rid").join(roots.select(F.col("v").alias("rid"), F.col("root").alias("_c")), "rid", "left")
    named = cut(named.select("root", "rid", F.coalesce("_c", "rid").alias("comp"), "mh", "n_shingles"), "near-clusters")
    each = named.groupBy("root", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("m"))
    sizes = each.groupBy("root").agg(F.greatest(F.ceil(F.sum("n") / BLOCK), F.ceil(F.sum("m") / BLOCK_SHINGLES)).cast("long").alias("parts"), F.max_by("comp", F.struct("n", "comp")).alias("main"))
    sets = _full_sets(named.select("rid"), reps, docs, "near-cluster-sets")
    rows = named.join(cut(sizes, "near-cluster-sizes"), "root").join(sets, "rid").withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")))
    long = lambda x: F.lit(x).cast("long")
    blocks = F.when(F.col("comp") == F.col("main"), F.array(F.struct(F.col("part").alias("block"), long(0).alias("role"))))
    blocks = blocks.otherwise(F.transform(F.sequence(long(0), F.col("parts") - 1), lambda p: F.struct(p.alias("block"), F.when(p == F.col("part"), long(0)).otherwise(long(1)).alias("role"))))
    rows = rows.select("root", "rid", "comp", "mh", "shingles", F.inline(blocks))
    rows = rows.repartition("root", "block").sortWithinPartitions("root", "block", "role")
    links = cut(rows.mapInArrow(_link(percent, least), "a long, b long"), "near-cluster-links")
    forget(sets)
    forget(named)
    return links


def _alike(pairs: DataFrame, reps: DataFrame, percent: int, least: float) -> DataFrame:
    """The pairs (a, b) whose set sizes allow the threshold and whose minwise values agree often enough."""
    side = lambda c: reps.select(F.col("rid").alias(c), F.col("mh").alias(f"mh_{c}"), F.col("n_shingles").alias(f"n_{c}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    return pairs.filter(F.size(F.filter(F.zip_with("mh_a", "mh_b", lambda x, y: x == y), lambda same: same)) >= least * TREES * DEPTH).select("a", "b")


def _open(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of nodes that hold several components: (node, rid, n, comp), and the node's least component."""
    named = cut(rows.join(roots.withColumnRenamed("v", "rid"), "rid", "left").select("node", "rid", "n", F.coalesce("root", "rid").alias("comp")), "near-named")
    several = named.groupBy("node").agg(F.min("comp").alias("main"), F.max("comp").alias("top")).filter("main <> top")
    several = cut(several, "near-several")
    return named.join(several.select("node", "main"), "node")


def near_duplicates(docs: DataFrame, percent: int = 80, leaf: int = LEAF) -> DataFrame:
    """(doc_id, tkey, n_shingles, component_id, kept) for every row of docs(doc_id, text)."""
    docs = docs.select("doc_id", "text", text_key(F.col("text")).alias("tkey"))
    feats = cut(docs.mapInArrow(_features, "doc_id long, tkey binary, n_shingles long, skey binary, mh array<int>"), "near-features")
    one = feats.filter("skey is not null").groupBy("skey").agg(F.min("doc_id").alias("label"), F.min("tkey").alias("tkey"), F.first("n_shingles").alias("n_shingles"), F.first("mh").alias("mh"))
    reps = cut(one.withColumn("rid", F.monotonically_increasing_id()), "near-sets")
    levels = _nodes(reps, leaf)
    share, least = percent / 100, percent / 100 - SLACK
    rows = None
    for k, level in enumerate(levels):
        last = F.lit(True) if k == len(levels) - 1 else F.col("n") <= leaf
        own = level.select("node", "rid", "n", "leader", last.alias("last"))
        rows = own if rows is None else rows.union(own)
    picks = rows.filter("rid <> leader").groupBy("rid", "leader").agg(F.count("*").alias("met")).groupBy("rid").agg(F.max_by("leader", F.struct("met", "leader")).alias("leader"))
    links = _confirm(_alike(picks.select(F.col("leader").alias("a"), F.col("rid").alias("b")), reps, percent, least), reps, docs, percent)
    roots = components(links, "near-first")

    opened = _open(cut(rows.filter("last"), "near-nodes"), roots)
    # in a large node the main component is dealt out once; the rest meet every block
    opened = opened.withColumn("parts", F.when(F.col("n") > 2 * BLOCK, F.ceil(F.col("n") / BLOCK)).otherwise(F.lit(1)))
    whole = opened.filter("parts = 1").select("node", F.lit(0).cast("long").alias("block"), "rid", "comp", F.lit(2).alias("role"))
    bases = opened.filter("parts > 1").select("node", F.pmod(F.xxhash64("rid"), F.col("parts")).alias("block"), "rid", "comp", F.lit(0).alias("role"))
    probes = opened.filter("parts > 1 and comp <> main").select("node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("block"), "rid", "comp", F.lit(1).alias("role"))
    dealt = whole.union(bases).union(probes).join(reps.select("rid", "mh", "n_shingles"), "rid")
    dealt = dealt.repartition("node", "block").sortWithinPartitions("node", "block", "role")
    alike = cut(dealt.mapInArrow(_compare(least, share), "a long, b long").distinct(), "near-alike")
    if alike.limit(1).count():
        links = links.union(_cluster_links(alike, roots, reps, docs, percent, least))
        roots = components(links, "near-all")

    for done in (*levels, alike):
        forget(done)
    named = reps.join(roots.withColumnRenamed("v", "rid"), "rid", "left").select("skey", "label", F.coalesce("root", "rid").alias("comp"))
    ids = named.groupBy("comp").agg(F.min("label").alias("component_id"))
    named = named.join(ids, "comp").select("skey", "comp", "component_id")
    out = feats.drop("mh").join(named, "skey", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "tkey", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "comp")


def op6_chosen_path_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85).select("doc_id", "n_shingles", "component_id", "kept")


QUERIES = {"op6_chosen_path_near_dedup": op6_chosen_path_near_dedup}
SQL: dict[str, str] = {}
