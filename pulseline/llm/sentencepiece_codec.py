"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

A text is cut where no piece crosses: before every run of spaces, at every line feed, and between a letter and a mark
if no piece holds the two together. Each chunk is encoded by an
agenda of candidate merges, best score first and leftmost among equals. With a dropout rate each candidate that comes up is skipped
if a keyed hash of (seed, text, candidate's place, lengths of its sides) falls under the rate, so every occurrence of a word has
draws of its own, and every run with one seed gives the same pieces, on any cluster. The agendas of all chunks of a batch advance together in
numpy arrays, one candidate a chunk and round; a chunk of over SHORT characters has a heap of its own. With rate 0 the pieces are the library's own.

Characters without a piece become byte pieces, and so does a literal U+2581, which would otherwise come back
as a space; thus decoding the pieces gives the text itself, byte for byte.

Edge cases: a null text gives null pieces, decodes to null and counts 0; an empty text gives no pieces. Equal texts
are encoded alike, whatever their rows. doc_id is only carried along; extra columns are returned as they are by encode().
A text of any length, with or without spaces, takes time in proportion to n log n. Columns named like a result come back with `_in` at the
end of their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytes_np as B
from .common import packed, schema_of, table, unpacked

DROPOUT, SEED, SHORT = 0.1, 17, 64
MARK = "▁"
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~"
U = np.uint64
FULL = (1 << 64) - 1
NO_PIECE = (1 << 20) - 1  # what a character in no piece has for an id
NEVER = (1 << 31) - 1  # the rank of a pair that is no candidate
PLACE, LEFT, RIGHT = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9


def drawn(base: int, place: int, left: int, right: int) -> int:
    """32 bits for the candidate at a place of a text, of these lengths; base holds seed and text. The same as draws() gives."""
    x = base ^ ((place * PLACE + left * LEFT + right * RIGHT) & FULL)
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & FULL
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & FULL
    return (x ^ (x >> 31)) >> 32


def draws(base: np.ndarray, place: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return B.mix(base ^ (place.astype(np.uint64) * U(PLACE) + left.astype(np.uint64) * U(LEFT) + right.astype(np.uint64) * U(RIGHT))) >> U(32)


class Pairs:
    """A hash table in arrays, from two neighbouring ids to the rank of their merge (0 the best) and the id it makes."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, into: np.ndarray) -> None:
        keys = (left.astype(np.int64) << 20) | right
        self.bits = max(4, int(len(keys) * 8).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank, self.into = np.full(1 << self.bits, NEVER, np.int64), np.zeros(1 << self.bits, np.int64)
        slot, rest = self._slot(keys), np.arange(len(keys))
        while len(rest):
            _, first = np.unique(slot[rest], return_index=True)
            own = rest[first]
            own = own[self.keys[slot[own]] < 0]
            self.keys[slot[own]], self.rank[slot[own]], self.into[slot[own]] = keys[own], rank[own], into[own]
            rest = np.setdiff1d(rest, own, assume_unique=True)
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * U(PLACE)) >> U(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The slot of each pair, or one that is empty."""
        keys = (left.astype(np.int64) << 20) | right
        slot = self._slot(keys)
        held = self.keys[slot]
        rest = np.flatnonzero((held != keys) & (held >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[rest]]
            rest = rest[(held != keys[rest]) & (held >= 0)]
        return slot


class Model:
    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.n = n = sp.get_piece_size()
        ids: dict[str, int] = {}
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        bodies = [b""] * n
        for i in range(n):
            if sp.is_byte(i):
                bodies[i] = bytes([int(sp.id_to_piece(i)[3:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                ids[sp.id_to_piece(i)] = i
                bodies[i] = sp.id_to_piece(i).replace(MARK, " ").encode()
        scores = sorted({sp.get_score(i) for i in ids.values()}, reverse=True)
        rank = {score: k for k, score in enumerate(scores)}
        # characters that stand in pieces without being one have ids from n on
        code = dict(ids)
        for c in sorted({c for piece in ids for c in piece} - set(ids)):
            code[c] = n + len(code) - len(ids)
        rows = [(code[p[:k]], code[p[k:]], rank[sp.get_score(i)], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in code and p[k:] in code]
        self.pairs = Pairs(*(np.array(x, np.int64) for x in zip(*rows, strict=True)))
        self.pair = {(a << 20) | b: (r, i) for a, b, r, i in rows}
        self.char = np.full(0x110000, NO_PIECE, np.int64)
        for c, k in code.items():
            if len(c) == 1 and c != MARK:
                self.char[ord(c)] = k
        self.char[ord(" ")] = code[MARK]
        # a mark that no piece has right behind a letter starts a chunk there: no merge crosses the place
        joined = {b for piece in ids for a, b in zip(piece, piece[1:], strict=False) if a.isalpha()}
        self.letter, self.cut = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
        self.letter[[ord(c) for c in code if len(c) == 1 and c.isalpha()]] = True
        self.cut[[ord(c) for c in MARKS if c not in joined]] = True
        self.size = np.array([len(b) for b in bodies], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(bodies), np.uint8)

    def decode(self, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts one after the other and each text's start; the first space of a text is the encoder's."""
        size = self.size[flat]
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
        place = np.arange(ends[-1]) - np.repeat(ends[:-1] - self.start[flat], size)
        data, starts = self.bytes[place], ends[at]
        lead = starts[:-1][np.diff(at) > 0]
        lead = lead[data[lead] == 32] if len(lead) else lead
        keep = np.ones(len(data), bool)
        keep[lead] = False
        return data[keep], starts - np.searchsorted(lead, starts)


class Encoder:
    def __init__(self, path: str, rate: float, seed: int) -> None:
        self.model, self.skip, self.seed = Model(path), int(rate * 2**32), b"%d" % seed

    def base(self, text: str) -> int:
        """What all draws of a text are made from."""
        return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8, key=self.seed).digest(), "little")

    def chunks(self, code: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Where chunks start in these characters; heads are where texts start, each with the space that stands before it."""
        start = (code == 32) | (code == 10) | self.model.cut[code]
        start[1:] &= ((code[1:] != 32) | (code[:-1] != 32)) & (~self.model.cut[code[1:]] | self.model.letter[code[:-1]])
        start[heads] = True
        return np.flatnonzero(start)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has."""
        counts = np.zeros(len(texts), np.int64)
        full = [k for k, t in enumerate(texts) if t]
        if not full:
            return np.zeros(0, np.int32), counts
        code = np.frombuffer("".join(" " + texts[k] for k in full).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.array([len(texts[k]) + 1 for k in full])
        heads = np.cumsum(size) - size
        base = np.array([self.base(texts[k]) for k in full] if self.skip else [0] * len(full), np.uint64)
        start = self.chunks(code, heads)
        text = np.searchsorted(heads, start, "right") - 1
        tok = self.model.char[code]
        width = np.ones(len(code), np.int64)  # characters of the token that starts here, 0 for none
        span = np.diff(np.append(start, len(code)))
        short = span <= SHORT
        self._together(tok, width, start[short], span[short], heads[text[short]], base[text[short]])
        for k in np.flatnonzero(~short).tolist():
            self._by_heap(tok, width, int(start[k]), int(span[k]), int(heads[text[k]]), int(base[text[k]]))
        at = np.flatnonzero(width)
        tok = tok[at]
        cp = code[at]
        odd = tok >= self.model.n  # single characters that are no piece: their bytes
        many = np.where(odd, 1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF), 1)
        out = np.repeat(tok, many).astype(np.int32)
        if odd.any():
            data = np.frombuffer("".join(map(chr, cp[odd].tolist())).encode("utf-8", "surrogatepass"), np.uint8)
            out[np.repeat(odd, many)] = self.model.byte[data]
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(many)))
        counts[full] = np.diff(ends[np.searchsorted(at, np.append(heads, len(code)))])
        return out, counts

    def _together(self, tok: np.ndarray, width: np.ndarray, start: np.ndarray, span: np.ndarray, head: np.ndarray, base: np.ndarray) -> None:
        """The agendas of all these chunks: in each round the best candidate of every chunk is merged or skipped.

        Tokens are linked lists in arrays; key holds rank and place of each one's candidate with the next. Once most chunks are
        done, arrays are made anew of the rest. What is found goes to tok and width.
        """
        pairs, never = self.model.pairs, NEVER << 32
        keep = span > 1
        start, span, head, base = start[keep], span[keep], head[keep], base[keep]
        at = np.arange(span.sum()) + np.repeat(start - (np.cumsum(span) - span), span)
        own, wide = tok[at], np.ones(len(at), np.int64)
        slot = pairs.find(own, np.append(own[1:], NO_PIECE))
        rank, into = pairs.rank[slot], pairs.into[slot]
        rank[np.cumsum(span) - 1] = NEVER
        while len(span):
            first = np.cumsum(span) - span
            after, before = np.arange(1, len(at) + 1), np.arange(-1, len(at) - 1)
            after[first + span - 1] = before[first] = -1
            key = (rank << 32) | np.arange(len(at))
            while True:
                best = np.minimum.reduceat(key, first)
                live = best < never
                chunk = np.flatnonzero(live)
                if len(chunk) * 2 < len(first) or not len(chunk):
                    break
                i = best[chunk] & 0xFFFFFFFF
                j = after[i]
                if self.skip:
                    skips = draws(base[chunk], at[i] - head[chunk], wide[i], wide[j]) < U(self.skip)
                    key[i[skips]] = never
                    i, j = i[~skips], j[~skips]
                own[i] = into[i]
                wide[i] += wide[j]
                wide[j] = 0
                k = after[j]
                after[i] = k
                key[i] = key[j] = never
                more = k >= 0
                before[k[more]] = i[more]
                p = before[i]
                a, b = np.concatenate((i[more], p[p >= 0])), np.concatenate((k[more], i[p >= 0]))
                slot = pairs.find(own[a], own[b])
                key[a] = (pairs.rank[slot] << 32) | a
                into[a] = pairs.into[slot]
            tok[at], width[at] = own, wide
            stay = np.repeat(live, span) & (wide > 0)
            span = np.add.reduceat((wide > 0).astype(np.int64), first)[live]
            head, base = head[live], base[live]
            at, own, wide, into, rank = at[stay], own[stay], wide[stay], into[stay], key[stay] >> 32

    def _by_heap(self, tok: np.ndarray, width: np.ndarray, start: int, span: int, head: int, base: int) -> None:
        """The agenda of one chunk of any length: a heap, with candidates checked again when they come up."""
        own, wide = tok[start : start + span].tolist(), [1] * span
        after, before = list(range(1, span + 1)), list(range(-1, span - 1))
        agenda: list[tuple[int, int, int, int, int, int]] = []
        pair = self.model.pair.get

        def offer(left: int, right: int) -> None:
            found = pair((own[left] << 20) | own[right])
            if found is not None:
                heapq.heappush(agenda, (found[0], left, right, wide[left], wide[right], found[1]))

        for i in range(span - 1):
            offer(i, i + 1)
        while agenda:
            _, left, right, a, b, into = heapq.heappop(agenda)
            if wide[left] != a or wide[right] != b or after[left] != right:
                continue
            if self.skip and drawn(base, start + left - head, a, b) < self.skip:
                continue
            own[left], wide[left], wide[right] = into, a + b, 0
            nxt = after[left] = after[right]
            if nxt < span:
                before[nxt] = left
                offer(left, nxt)
            if before[left] >= 0:
                offer(before[left], left)
        tok[start : start + span], width[start : start + span] = own, wide


@lru_cache(maxsize=4)
def encoder(path: str, rate: float, seed: int) -> Encoder:
    return Encoder(path, rate, seed)


def model_path(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _encode(columns: list[str], name: str, rate: float, seed: int, check: bool):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_path(name), rate, seed)
        for whole in batches:
            _, at = B.text_buffers(whole.column("text"))
            for i, j in B.chunks(at, 1 << 20):
                batch = whole.slice(i, j - i)
                text = batch.column("text")
                flat, size = own.encode([t or "" for t in text.to_pylist()])
                starts = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
                valid = pa.array(np.append(~text.is_null().to_numpy(zero_copy_only=False), True))
                offsets = pa.array(starts.astype(np.int32), mask=~valid.to_numpy(zero_copy_only=False)) if text.null_count else pa.array(starts.astype(np.int32))
                out = [*(batch.column(c) for c in columns), pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.array(size)]
                names = [*columns, "pieces", "n_pieces"]
                if check:
                    data, own_at = own.model.decode(flat, starts)
                    want, want_at = B.text_buffers(text)
                    same = np.array([data[a:b].tobytes() == want[c:d].tobytes() for a, b, c, d in zip(own_at[:-1].tolist(), own_at[1:].tolist(), want_at[:-1].tolist(), want_at[1:].tolist(), strict=True)], bool)
                    out.append(pa.array(same, pa.bool_()))
                    names.append("lossless")
                yield pa.RecordBatch.from_arrays(out, names)

    return run


def _decode(columns: list[str], name: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(model_path(name), 0.0, 0).model
        for batch in batches:
            texts: list[str | None] = []
            for ids in batch.column("pieces").to_pylist():
                data = None if ids is None else model.decode(np.array(ids, np.int64), np.array([0, len(ids)]))[0]
                texts.append(None if data is None else data.tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(texts, pa.string())], [*columns, "text"])

    return run


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model", rate: float = DROPOUT, seed: int = SEED, check: bool = False) -> DataFrame:
    """All columns of docs but text, with pieces array<int>, n_pieces and, if check, whether decoding gives the text."""
    rest = packed(docs, ["text"], "_rest")
    results = ["pieces", "n_pieces", "lossless"][: 2 + check]
    kinds = schema_of(rest, ["_rest"], "pieces array<int>, n_pieces long" + ", lossless boolean" * check)
    out = rest.select("_rest", "text").mapInArrow(_encode(["_rest"], model, rate, seed, check), kinds)
    return out.select(*unpacked("_rest", [c for c in docs.columns if c != "text"], results), *results)


def decode(encoded: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """All columns of encoded but pieces, with the text they stand for."""
    rest = packed(encoded, ["pieces"], "_rest")
    out = rest.select("_rest", "pieces").mapInArrow(_decode(["_rest"], model), schema_of(rest, ["_rest"], "text string"))
    return out.select(*unpacked("_rest", [c for c in encoded.columns if c != "pieces"], ["text"]), "text")


def op8_dropout_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, check=True).select("doc_id", "n_pieces", "lossless", "pieces")


QUERIES = {"op8_dropout_sentencepiece": op8_dropout_sentencepiece}
SQL: dict[str, str] = {}
