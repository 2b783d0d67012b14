"""Best-fit packing of tokenised documents into sequences, in bulk-synchronous rounds.

Documents are cut into pieces of at most ``capacity`` tokens and range-sorted by length, longest first;
a piece is then known by its length and its rank among the pieces of that length. A round sweeps the
open gaps and the waiting pieces together: each gap takes its predecessor among the lengths, the longest
piece that fits. Where several gaps want the same length, the gap's rank decides which piece it gets.
Gaps shrink and the next round begins; when no gap takes a piece any more, as many of the longest pieces
as the rest needs at least open new sequences. Only length and rank matter to a sweep, so it works on
runs of equal gaps and of equal lengths, of which there are never more than ``capacity``; its matches are
ranges of ranks, by which Spark places the pieces.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain, repeat
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textgrade.llm.common import bound_batches, give_back, saved, worker_cache

CAPACITY = 2048
CHUNKS, NAMES = 349_000, 50_000  # chunks and words kept in the caches of a worker; from 349,526 on a dict is twice as large
GROUP = 1 << 18  # characters encoded together
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed value: bytes that are a letter of their own in the file
_LETTERS = np.arange(256, dtype="<u2")  # the letter of each byte in the file; a space stays, it only parts words here
_LETTERS[sorted({*range(256)} - {*_SHOWN})] = 256 + np.arange(256 - len(_SHOWN))
_LETTERS[32] = 32


def _word_rule() -> re.Pattern:
    """The word rule of the vocabulary file, spelt out for code points below U+0250 and what they are in lower case."""
    points = {c for i in range(0x250) for c in chr(i) + chr(i).lower()}
    of = {k: "".join(re.escape(c) for c in sorted(points) if category(c)[0] == k) for k in "LN"}
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{of['L']}]+|[{of['N']}]|[^\s{of['L']}{of['N']}]+")  # fixed value: the rule


_WORD = _word_rule()


class Tokens:
    """Ids of texts by a vocabulary file of ``tokenizers``, through a cache of chunks between white space.

    White space always parts words in this vocabulary and is dropped, so the ids of a text are those of
    its chunks. Words not seen before go to the library's model one by one, in the letters that stand for
    their bytes there. A text with code points from U+0250 on, where case and composition are less plain,
    or with a special token's string goes to the library as a whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; each thread would keep memory of its own
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model  # each look at it makes another wrapper
        self.chunks, self.words = _Lists(CHUNKS), _Lists(NAMES)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        plain = [i for i, t in enumerate(texts) if _plain(t)]
        parts = [texts[i].lower().split() for i in plain]
        flat, ends = self.chunks.get(list(chain.from_iterable(parts)), self._chunks)
        bounds = ends[np.cumsum([0, *map(len, parts)])]
        out: list = [None] * len(texts)
        for i, a, b in zip(plain, bounds[:-1], bounds[1:]):
            out[i] = flat[a:b]
        for i, ids in enumerate(out):
            if ids is None:
                out[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return out

    def _chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks; a chunk that is one word is held as a chunk already and takes no second place."""
        parts = [[c] if c.isalpha() else _WORD.findall(c) for c in chunks]
        alone = [len(p) == 1 for p in parts]
        single, ends_1 = self._words([p[0] for p in parts if len(p) == 1])
        mixed, ends_2 = self.words.get([w for p in parts if len(p) != 1 for w in p], self._words)
        ends_2 = ends_2[np.cumsum([0, *(len(p) for p in parts if len(p) != 1)])]
        # both lists end to end, then in the order of the chunks
        order = np.empty(len(parts), np.int64)
        order[np.r_[np.flatnonzero(alone), np.flatnonzero(~np.array(alone, bool))]] = np.arange(len(parts))
        flat, starts = np.r_[single, mixed], np.r_[ends_1[:-1], len(single) + ends_2[:-1]][order]
        sizes = np.r_[np.diff(ends_1), np.diff(ends_2)][order]
        ends = np.r_[0, np.cumsum(sizes)]
        return flat[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])], ends

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not words:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        tokenize, text = self.model.tokenize, " ".join(words)
        if not (text.isascii() and text.isprintable()):
            words = _LETTERS[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-16-le").split(" ")
        lists = [[t.id for t in tokenize(w)] for w in words]
        ends = np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))
        return np.fromiter(chain.from_iterable(lists), np.uint32, int(ends[-1])), np.r_[0, ends]


def _plain(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        if max(text) >= "\u0250":
            return False
    return "<|" not in text and not any(c in text for c in "\x1c\x1d\x1e\x1f")


class _Lists:
    """A cache from strings to lists of ids, held as one array.

    It is filled once, and so with what is common; what comes later is made each time it is needed. When
    that has happened twice as often as there are entries, the texts have changed and it starts anew.
    """

    def __init__(self, limit: int) -> None:
        self.limit, self.n, self.missed = limit, 0, 0
        self.place: dict[str, int] = {}
        self.ids, self.ends = np.zeros(1 << 20, np.uint32), np.zeros(1 << 16, np.int64)

    def get(self, keys: list[str], make) -> tuple[np.ndarray, np.ndarray]:
        """The lists of ``keys`` end to end, and the bounds of each; ``make`` gives those not held."""
        at = np.fromiter(map(self.place.get, keys, repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            wanted = list(map(keys.__getitem__, missing))
            new = list(dict.fromkeys(wanted))
            flat, bounds = make(new)
            used, last = self.ends[self.n], self.n + len(new)
            if used + len(flat) > len(self.ids):
                self.ids = np.r_[self.ids[:used], np.zeros(used + 2 * len(flat), np.uint32)]
            if last >= len(self.ends):
                self.ends = np.r_[self.ends[: self.n + 1], np.zeros(last + 1, np.int64)]
            # entries beyond the limit stand behind the others until the next call
            self.ids[used : used + len(flat)] = flat
            self.ends[self.n + 1 : last + 1] = used + bounds[1:]
            numbers = dict(zip(new, range(self.n, last)))
            at[missing] = np.fromiter(map(numbers.__getitem__, wanted), np.int64, len(wanted))
        starts, sizes = self.ends[at], self.ends[at + 1] - self.ends[at]
        bounds = np.r_[0, np.cumsum(sizes)]
        out = self.ids[np.repeat(starts - bounds[:-1], sizes) + np.arange(bounds[-1])]
        if missing:
            kept = max(0, min(len(new), self.limit - self.n))
            self.place.update(zip(new[:kept], range(self.n, self.n + kept)))
            self.n += kept
            self.missed += len(new) - kept
            if self.missed > 2 * self.limit:
                self.place.clear()
                self.n = self.missed = 0
        return out, bounds


def _encoded(tokens: Tokens, texts: list[str]) -> Iterator[np.ndarray]:
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size > GROUP:
            yield from tokens.encode(group)
            group, size = [], 0
    yield from tokens.encode(group)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: every document, its ids and a closing 0, cut at ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = worker_cache(f"words {vocabulary}", lambda: Tokens(vocabulary))
        for batch in batches:
            owner, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(_encoded(tokens, batch.column(1).to_pylist())):
                ids = np.append(ids, np.uint32(0))
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    owner.append(i), piece.append(k), start.append(at), length.append(len(part)), crc.append(zlib.crc32(part.astype("<u4").tobytes()))
            columns = [pa.array(c, k) for c, k in ((piece, pa.int32()), (start, pa.int64()), (length, pa.int64()), (crc, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *columns], ["doc_id", "piece", "start", "length", "ids_crc32"])
            give_back()  # what a batch leaves behind would stand beside the next one's

    bound_batches(docs.sparkSession)
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def sweep(waiting: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """The matches of all rounds for ``waiting`` pieces by length.

    Each is ``(length, rank, count, sequence, offset)``: ``count`` pieces of this length, from this rank
    on, go to as many sequences from this one on, at this offset.
    """
    left, used = {n: c for n, c in waiting.items() if c}, dict.fromkeys(waiting, 0)
    lengths = sorted(left)  # of what waits
    matches, gaps, sequences = [], [], 0  # gaps: (room, first sequence, count)

    def take(length: int, count: int, sequence: int, room: int) -> None:
        matches.append((length, used[length], count, sequence, capacity - room))
        used[length] += count
        left[length] -= count
        if not left[length]:
            lengths.remove(length)

    while lengths:
        again = []
        while gaps and lengths:  # rounds, until no gap takes a piece
            placed, nxt = False, []
            for room, first, count in sorted(gaps):
                while count and (at := bisect_right(lengths, room)):
                    length = lengths[at - 1]
                    n = min(count, left[length])
                    take(length, n, first, room)
                    if room > length:
                        nxt.append((room - length, first, n))
                    first, count, placed = first + n, count - n, True
                if count:
                    again.append((room, first, count))
            gaps = nxt
            if not placed:
                break
        gaps = again + gaps
        if not lengths:
            break
        # what is longer than half a sequence opens one in any case; else as many as the rest fills
        total = sum(n * c for n, c in left.items())
        need = max(sum(c for n, c in left.items() if 2 * n > capacity), -(-total // capacity) // 2, 1)
        while need and lengths:
            length = lengths[-1]
            n = min(need, left[length])
            take(length, n, sequences, capacity)
            if length < capacity:
                gaps.append((capacity - length, sequences, n))
            sequences, need = sequences + n, need - n
    return matches


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``cut`` (see :func:`pieces`) with ``sequence_id`` and ``offset``.

    Pieces of one sequence lie one after the other from 0 on; none is longer than ``capacity``. Of equal
    lengths the smaller id (null first) and piece has the lower rank; repeated rows are packed each.
    """
    cut = saved(cut)
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    matches = sweep(counts, capacity)
    # ranks: rows of a length are dealt to blocks by hash, the counts of blocks give where each begins
    blocks = max(1, sum(counts.values()) // 5_000)
    dealt = cut.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)).cast("int"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begin = dealt.groupBy("length", "block").agg(F.count("*").alias("n"))
    begin = begin.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    within = Window.partitionBy("block", "length").orderBy(F.col("doc_id").asc_nulls_first(), "piece", "ids_crc32")
    ranked = dealt.withColumn("within", F.row_number().over(within) - 1).join(begin, ["length", "block"])
    ranked = ranked.withColumn("rank", F.col("begin") + F.col("within"))
    # which match a rank belongs to: matches of a length are consecutive in rank
    plan: dict[int, tuple[list, list, list]] = {}
    for length, rank, _, sequence, offset in matches:
        for column, value in zip(plan.setdefault(length, ([], [], [])), (rank, sequence, offset)):
            column.append(value)
    arrays = {n: tuple(np.array(c, np.int64) for c in cols) for n, cols in plan.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = np.asarray(batch["length"]), np.asarray(batch["rank"])
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length).tolist():
                ranks, sequences, offsets = arrays[n]
                rows = np.flatnonzero(length == n)
                at = np.searchsorted(ranks, rank[rows], side="right") - 1
                sequence[rows], offset[rows] = sequences[at] + rank[rows] - ranks[at], offsets[at]
            kept = [batch[c] for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = ", ".join(f"{c} {ranked.schema[c].dataType.simpleString()}" for c in columns)
    return ranked.select(*columns, "rank").mapInArrow(place, f"{kinds}, sequence_id long, offset long")
