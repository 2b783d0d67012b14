"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding.

Texts of a batch are one array of code points. Each code point has a class (letter, number, space of
several kinds, apostrophe that opens a contraction, other); the classes drive an automaton whose state
is the kind of token that is open. Its steps are transition functions; blocks of code points are
composed function by function, the block functions are then chained, and a last pass gives the state
and so the token starts at every place. No regular expression is used. The slices between starts are
looked up in a cache of merged pieces; pieces that are not there are merged together, as arrays.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import unicodedata
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgrade.llm.common import bound_batches, worker_cache

# Classes of code points and states of the automaton.
L, N, O, A2, A3, WS, WS_LAST, SPACE_LAST = range(8)
FRESH, IN_L, IN_N, IN_O, IN_WS, AFTER_SPACE, LEFT1, LEFT2 = range(8)
# Code points with the Unicode property White_Space.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# What may follow an apostrophe as a contraction.
SHORT, LONG = "stmd", ("re", "ve", "ll")
BLOCK = 64  # code points composed into one transition function
CACHE = 400_000  # pieces kept in the cache of a worker
TEXT_AT_ONCE = 1 << 20  # code points that are split together


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """``next[class, state]`` and ``starts[class, state]``: whether a token starts at the code point."""
    after, starts = np.zeros((8, 8), np.uint8), np.ones((8, 8), bool)
    for cls, state, glue in ((L, IN_L, (IN_L, AFTER_SPACE)), (N, IN_N, (IN_N, AFTER_SPACE)), (O, IN_O, (IN_O, AFTER_SPACE))):
        after[cls] = state
        starts[cls, list(glue)] = False
    for cls, state in ((A2, LEFT1), (A3, LEFT2)):  # an apostrophe is plain where it goes on with a token
        after[cls] = state
        after[cls, [IN_O, AFTER_SPACE]] = IN_O
        starts[cls, [IN_O, AFTER_SPACE]] = False
    after[L, LEFT1], after[L, LEFT2] = FRESH, LEFT1
    starts[L, [LEFT1, LEFT2]] = False
    after[WS] = IN_WS
    starts[WS, IN_WS] = False
    after[WS_LAST], after[SPACE_LAST] = FRESH, AFTER_SPACE
    return after, starts


NEXT, STARTS = _automaton()


class Splitter:
    """Token starts of texts under the pattern of the public rank files."""

    def __init__(self) -> None:
        kinds = [unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)]
        self.classes = np.array([{"L": L, "N": N}.get(k, O) for k in kinds], np.uint8)
        self.classes[WHITE_SPACE] = WS

    def starts(self, points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
        """Places in ``points`` where a token starts; each text is split by itself."""
        n = len(points)
        cls = self.classes[points]
        last = np.zeros(n + 1, bool)  # the next code point belongs to another text
        last[text_starts[1:] - 1] = True
        last[n - 1] = True
        ahead = np.r_[cls[1:], np.uint8(WS)]
        ends_run = (cls == WS) & (ahead != WS) & ~last[:n]
        cls[ends_run] = np.where(points[ends_run] == 32, SPACE_LAST, WS_LAST)
        for p in np.flatnonzero(points == 39).tolist():
            two = "" if last[p] else chr(points[p + 1]) + ("" if last[p + 1] else chr(points[p + 2]))
            if two[:1] in SHORT and two:
                cls[p] = A2
            elif two in LONG:
                cls[p] = A3
        begins = np.zeros(n, bool)
        begins[text_starts] = True
        return np.flatnonzero(self._scan(cls, begins))

    def _scan(self, cls: np.ndarray, begins: np.ndarray) -> np.ndarray:
        n, blocks = len(cls), -(-len(cls) // BLOCK)
        steps = np.zeros(blocks * BLOCK, np.uint8)
        steps[:n] = cls
        reset = np.zeros(blocks * BLOCK, bool)
        reset[:n] = begins
        # one row of a step's table is its transition function; a text start maps every state from FRESH
        table = np.concatenate([NEXT, np.repeat(NEXT[:, FRESH : FRESH + 1], 8, axis=1)])
        step = (steps + reset * np.uint8(8)).reshape(blocks, BLOCK).T.copy()
        flat = table.ravel()
        composed = np.tile(np.arange(8, dtype=np.uint8), (blocks, 1))
        for row in step:
            composed = flat[(row[:, None].astype(np.uint16) << 3) | composed]
        entry, state = np.zeros(blocks, np.uint8), FRESH
        for i, function in enumerate(composed.tolist()):
            entry[i] = state
            state = function[state]
        out = np.zeros((BLOCK, blocks), bool)
        opens = np.concatenate([STARTS, np.ones((8, 8), bool)]).ravel()
        for j, row in enumerate(step):
            at = (row.astype(np.uint16) << 3) | entry
            out[j] = opens[at]
            entry = flat[at]
        return out.T.ravel()[:n]


class Merges:
    """Rank of every pair of tokens that together are a token."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [
            (ranks[t[:i]] << 20 | ranks[t[i:]], rank)
            for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks
        ]
        keys = np.array([k for k, _ in pairs], np.uint64)
        self.bits = max(1, int(len(keys) * 4).bit_length())
        self.slots = np.full(1 << self.bits, np.iinfo(np.uint64).max, np.uint64)
        self.values = np.full(1 << self.bits, NONE, np.int64)
        waiting, probe = np.arange(len(keys)), self._slot(keys)
        while len(waiting):  # open addressing: of the keys that meet in a free slot one goes in
            free = self.slots[probe[waiting]] == np.iinfo(np.uint64).max
            self.slots[probe[waiting[free]]] = keys[waiting[free]]
            placed = self.slots[probe[waiting]] == keys[waiting]
            self.values[probe[waiting[placed]]] = np.array([pairs[i][1] for i in waiting[placed]], np.int64)
            waiting = waiting[~placed]
            probe[waiting] = (probe[waiting] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)  # fixed value: odd multiplier

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(20)) | right.astype(np.uint64)
        at, out = self._slot(keys), np.full(len(keys), NONE, np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            found = self.slots[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != np.iinfo(np.uint64).max)]
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
        return out

    def merge(self, pieces: Sequence[bytes]) -> list[list[int]]:
        """Ids of each piece: the pair of the lowest rank, leftmost of equal ones, is merged until none is left."""
        out: list = [None] * len(pieces)
        open_ = []
        for i, piece in enumerate(pieces):
            if (rank := self.ranks.get(piece)) is not None:
                out[i] = [rank]
            elif len(piece) > 512:
                out[i] = self._merge_long(piece)
            else:
                open_.append(i)
        sizes = np.array([len(pieces[i]) for i in open_], np.int64)
        ids = self.byte[np.frombuffer(b"".join(pieces[i] for i in open_), np.uint8)]
        owner = np.repeat(np.arange(len(open_)), sizes)
        while len(ids):
            pair = np.full(len(ids), NONE, np.int64)
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            pair[inner] = self.rank(ids[inner], ids[inner + 1])
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            low = np.minimum.reduceat(pair * (1 << 22) + (np.arange(len(ids)) & ((1 << 22) - 1)), starts)
            counts = np.diff(np.r_[starts, len(ids)])
            done = low >= NONE * (1 << 22)
            for k in np.flatnonzero(done):
                out[open_[owner[starts[k]]]] = ids[starts[k] : starts[k] + counts[k]].tolist()
            base = starts & ~((1 << 22) - 1)
            at = base + (low & ((1 << 22) - 1))
            at = np.where(at < starts, at + (1 << 22), at)[~done]
            ids[at] = low[~done] >> 22
            keep = np.repeat(~done, counts)
            keep[at + 1] = False
            ids, owner = ids[keep], owner[keep]
        return out

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same for one long piece: a heap of pairs over a linked list, in n log n steps."""
        import heapq

        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        tokens, ranks = self.tokens, self.ranks
        rank = lambda i: ranks.get(tokens[ids[i]] + tokens[ids[after[i]]]) if after[i] < len(ids) else None
        heap = [(r, i) for i in range(len(ids)) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] is None or rank(i) != r:
                continue
            j = after[i]
            ids[i], ids[j], after[i] = r, None, after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (again := rank(k)) is not None:
                    heapq.heappush(heap, (again, k))
        return [x for x in ids if x is not None]


NONE = 1 << 30  # no such pair


class Encoder:
    """Encodes and decodes texts by one rank file; holds the cache of a worker."""

    def __init__(self, path: str) -> None:
        self.splitter, self.merges, self.cache = Splitter(), Merges(path), {}
        self.sizes = np.array([len(t) for t in self.merges.tokens], np.int64)
        self.places = np.r_[0, np.cumsum(self.sizes)]
        self.bytes = np.frombuffer(b"".join(self.merges.tokens), np.uint8)

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Ids of each text as a ``uint32`` array."""
        out, group, size = [], [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= TEXT_AT_ONCE:
                out += self._encode(group)
                group, size = [], 0
        return out + (self._encode(group) if group else [])

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(texts)
        if not joined:
            return [np.zeros(0, np.uint32) for _ in texts]
        lengths = np.array([len(t) for t in texts], np.int64)
        bounds = np.r_[0, np.cumsum(lengths)]
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = self.splitter.starts(points, bounds[:-1][lengths > 0])
        cuts = starts.tolist()
        pieces = list(map(joined.__getitem__, map(slice, cuts, [*cuts[1:], len(joined)])))
        cache = self.cache
        found = list(map(cache.get, pieces))
        if None in found:
            new = list({p for p, ids in zip(pieces, found) if ids is None})
            if len(cache) + len(new) > CACHE:
                cache.clear()
            made = dict(zip(new, self.merges.merge([p.encode("utf-8", "surrogatepass") for p in new])))
            found = [made[p] if ids is None else ids for p, ids in zip(pieces, found)]
            cache.update((p, ids) for p, ids in made.items() if len(p) <= 64)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum()))
        ends = np.r_[0, np.cumsum(counts)]
        at = ends[np.searchsorted(starts, bounds)]
        return [ids[a:b] for a, b in zip(at[:-1], at[1:])]

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where each token starts in the bytes of the text, and where the last ends."""
        return np.r_[0, np.cumsum(self.sizes[ids])]

    def decode(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        shift = np.repeat(self.places[ids] - (np.cumsum(sizes) - sizes), sizes)
        return self.bytes[shift + np.arange(len(shift))].tobytes()


def encoder(path: str) -> Encoder:
    """The encoder of this worker for a rank file."""
    return worker_cache(f"ranks {path}", lambda: Encoder(path))


def encode_documents(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, offsets`` of every row: token ids, and the byte where each token starts.

    ``ranks`` is the path of a rank file on every machine. Null texts count as empty and have no ids;
    special tokens in a text are ordinary text. Repeated rows and null ids are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(ranks)
        for batch in batches:
            ids = coder.encode(batch.column(1).to_pylist())
            offsets = [coder.offsets(i)[:-1] for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(offsets, pa.list_(pa.int64()))], ["doc_id", "ids", "offsets"])

    chosen, kind = _chosen(docs, id_col, text_col)
    return chosen.mapInArrow(run, f"doc_id {kind}, ids array<int>, offsets array<long>")


def decode_documents(encoded: DataFrame, ranks: str) -> DataFrame:
    """``doc_id, data``: the bytes of every row of ``doc_id, ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(ranks)
        for batch in batches:
            data = [coder.decode(np.array(i or [], np.int64)) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, data binary")


def digests(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encoding and decoding in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(ranks)
        for batch in batches:
            ids = coder.encode(batch.column(1).to_pylist())
            named = [hashlib.sha256(b",".join(map(_DECIMAL.__getitem__, i.tolist()))).hexdigest() for i in ids]
            back = [hashlib.sha256(coder.decode(i)).hexdigest() for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array(named), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    chosen, kind = _chosen(docs, id_col, text_col)
    return chosen.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


_DECIMAL = [b"%d" % i for i in range(1 << 17)]


def _chosen(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    bound_batches(docs.sparkSession)
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return chosen, chosen.schema["doc_id"].dataType.simpleString()
