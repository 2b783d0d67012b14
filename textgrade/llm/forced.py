"""BPE encoding and decoding by forced boundaries, for vocabulary files of ``tokenizers`` with word ends.

Merging only ever makes tokens of the vocabulary. So where two neighbouring bytes stand side by side in no
token, no merge can reach across, and the place between them is a certain cut. The last byte of a word
carries the end-of-word mark and counts as a byte of its own kind. Words are cut at all such places; the
fragments are merged independently, each different one once as long as the cache of a worker holds it, and
their ids put one after the other are the ids of the word.

White space always parts words in these vocabularies and is dropped, so a text is a row of chunks between
white space and of special tokens. Chunks of code points below U+0250 are lower-cased and split into words
here; others, whose case, composition or class is a matter of Unicode tables, are normalised and split by
the library's own normaliser and pre-tokeniser.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgrade.llm.common import ListCache, bound_batches, give_back, worker_cache

END = b"\xff"  # closes a word; no byte of UTF-8
CHUNK_BYTES, FRAGMENT_BYTES = 40 << 20, 24 << 20  # of the caches of a worker
TEXT_AT_ONCE = 1 << 20  # code points that are encoded together
LONG = 256  # symbols from which on a fragment is merged by a queue
# The word rule of the vocabulary file, code points that are white space there, and the mark of a word's last token.
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_SPACE = regex.compile("[\t-\r \x85\xa0  -     　]+")
_CLOSE = "</w>"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in such files: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Coder:
    """Encodes and decodes texts by one vocabulary file; holds the caches of a worker."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.normalise, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.any_special = regex.compile("|".join(sorted(map(regex.escape, self.special), key=len, reverse=True)) or r"(?!)")
        self.size = 1 + max([*vocabulary.values(), *self.special.values()])
        self.strings = [b""] * self.size
        for token, i in chain(vocabulary.items(), self.special.items()):
            self.strings[i] = token.encode()
        letters = byte_letters()
        self.symbol = np.full(512, -1, np.int64)  # id of each byte, and from 256 on of each byte that ends a word
        self.inside = np.zeros((256, 512), bool)  # pairs of bytes that stand side by side in some token
        for token, i in vocabulary.items():
            ends = token.endswith(_CLOSE) and len(token) > len(_CLOSE)
            data = [letters[c] for c in (token[: -len(_CLOSE)] if ends else token)]
            data[-1] += 256 * ends
            self.inside[data[:-1], data[1:]] = True
            if len(data) == 1:
                self.symbol[data[0]] = i
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)  # by rank
        self.chunks, self.fragments = ListCache(CHUNK_BYTES), ListCache(FRAGMENT_BYTES)

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

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens with a space between them, as UTF-8: the library has no decoder for such a file."""
        return b" ".join(map(self.strings.__getitem__, ids.tolist()))

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        parts = list(map(self._parts, texts))
        flat, ends = self.chunks.get(list(chain.from_iterable(parts)), self._of_chunks)
        bounds = ends[np.cumsum([0, *map(len, parts)])]
        return [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])]

    def _parts(self, text: str) -> list[str]:
        """Chunks between white space, and special tokens, in order."""
        if "<|" in text and (marks := list(self.any_special.finditer(text))):
            bounds = [0, *chain.from_iterable(m.span() for m in marks), len(text)]
            return list(chain.from_iterable(
                [text[a:b]] if k % 2 else self._parts(text[a:b]) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))
            ))
        if text.isascii() or _plain(text):
            text = text.lower()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [c for c in _SPACE.split(text) if c]
        return text.split()

    def _of_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``chunks`` end to end, and the bounds of each."""
        words = [[] if c in self.special else self._words(c) for c in chunks]
        counts = np.cumsum([0, *map(len, words)])
        cuts, owners = self.cut([w.encode() for w in chain.from_iterable(words)])
        flat, ends = self.fragments.get(cuts, self.merge)
        bounds = ends[np.searchsorted(owners, counts)]
        special = [i for i, c in enumerate(chunks) if c in self.special]
        if special:
            flat = np.insert(flat, bounds[special], [self.special[chunks[i]] for i in special])
            extra = np.zeros(len(bounds), np.int64)
            extra[np.array(special) + 1] = 1
            bounds = bounds + np.cumsum(extra)
        return flat, bounds

    def _words(self, chunk: str) -> list[str]:
        if _plain(chunk):
            return _WORD.findall(chunk.lower())
        chunk = self.normalise(chunk)
        return [chunk[a:b] for _, (a, b) in self.split(chunk)]

    def cut(self, words: Sequence[bytes]) -> tuple[list[bytes], np.ndarray]:
        """The fragments of ``words`` between forced boundaries, and the word of each.

        A fragment that ends its word ends with ``END``.
        """
        if not words:
            return [], np.zeros(0, np.int64)
        joined = END.join(words) + END
        data = np.frombuffer(joined, np.uint8).astype(np.int64)
        ends = data == END[0]
        kind = data.copy()
        kind[:-1] += 256 * ends[1:]
        kept = np.zeros(len(data), bool)  # whether the place after a byte is no cut
        kept[:-1] = self.inside[data[:-1], kind[1:]] | ends[1:]
        kept[ends] = False
        stops = np.flatnonzero(~kept) + 1
        starts = np.r_[0, stops[:-1]]
        owners = (np.cumsum(ends) - ends)[starts]
        return list(map(joined.__getitem__, map(slice, starts.tolist(), stops.tolist()))), owners

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of merging each pair; the number of merges where there is none."""
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), max(len(self.keys) - 1, 0))
        if not len(self.keys):
            return np.zeros(len(wanted), np.int64)
        return np.where(self.keys[at] == wanted, self.rank[at], len(self.made))

    def _symbols(self, fragment: bytes) -> np.ndarray:
        data = np.frombuffer(fragment, np.uint8).astype(np.int64)
        if fragment.endswith(END):
            data = data[:-1].copy()
            data[-1] += 256
        return self.symbol[data]

    def merge(self, fragments: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``fragments`` end to end and the bounds of each.

        In each the pair of the lowest rank, leftmost of equal ones, is merged until none is left.
        """
        out: list = [None] * len(fragments)
        short = []
        for i, fragment in enumerate(fragments):
            if len(fragment) > LONG:
                out[i] = self._merge_long(self._symbols(fragment).tolist())
            else:
                short.append(i)
        parts = [self._symbols(fragments[i]) for i in short]
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(short)), [len(p) for p in parts])
        none = len(self.made)
        while len(ids):
            rank = np.full(len(ids), none, np.int64)
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            rank[inner] = self._ranks(ids[inner], ids[inner + 1])
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            low = np.minimum.reduceat((rank << 32) | np.arange(len(ids)), starts)
            counts, done = np.diff(np.r_[starts, len(ids)]), low >> 32 == none
            for k in np.flatnonzero(done).tolist():
                out[short[owner[starts[k]]]] = ids[starts[k] : starts[k] + counts[k]]
            at = low[~done] & 0xFFFFFFFF
            ids[at] = self.made[low[~done] >> 32]
            keep = np.repeat(~done, counts)
            keep[at + 1] = False
            ids, owner = ids[keep], owner[keep]
        bounds = np.cumsum([0, *map(len, out)])
        return np.concatenate([*out, np.zeros(0, np.int64)]).astype(np.uint32), bounds

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same for one long fragment: a queue of pairs over a linked list, in n log n steps."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self._ranks(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64)) if n > 1 else np.zeros(0, np.int64)
        waiting = [(r, i) for i, r in enumerate(first.tolist()) if r < len(self.made)]
        known: dict[tuple[int, int], int] = {}

        def rank(i: int) -> int:
            if after[i] >= n:
                return len(self.made)
            pair = ids[i], ids[after[i]]
            if pair not in known:
                known[pair] = int(self._ranks(np.array([pair[0]]), np.array([pair[1]]))[0])
            return known[pair]

        heapq.heapify(waiting)
        while waiting:
            r, i = heapq.heappop(waiting)
            if ids[i] < 0 or rank(i) != r:
                continue
            j = after[i]
            ids[i], ids[j], after[i] = int(self.made[r]), -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (again := rank(k)) < len(self.made):
                    heapq.heappush(waiting, (again, k))
        return [i for i in ids if i >= 0]


def _plain(text: str) -> bool:
    """Whether Python's lower case and the word rule are those of the library: below U+0250, without U+0130."""
    if text.isascii():
        return True
    return max(text) < "ɐ" and "İ" not in text


def coder(path: str) -> Coder:
    """The coder of this worker for a vocabulary file."""
    return worker_cache(f"forced {path}", lambda: Coder(path))


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` of every row. ``vocabulary`` is the path of a file on every machine.

    Null texts count as empty and have no ids. The strings of special tokens in a text are those tokens,
    as in the library; truncation and padding of the file are not used. Every row stands for itself:
    repeated rows, null and equal ids are kept, other columns dropped, an empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocabulary)
        for batch in batches:
            ids = own.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
        give_back()

    chosen, kind = _chosen(docs, id_col, text_col)
    return chosen.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, text`` of every row of ``doc_id, ids``; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocabulary)
        for batch in batches:
            texts = [own.decode(np.array(i or [], np.int64)).decode() for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])
        give_back()

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encoding and decoding in one pass over the texts.

    Digests are of the ids as little-endian unsigned 32-bit integers and of the decoded text in UTF-8;
    rows are handled as in :func:`encode_documents`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocabulary)
        for batch in batches:
            ids = own.encode(batch.column(1).to_pylist())
            named = [hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids]
            back = [hashlib.sha256(own.decode(i)).hexdigest() for i in ids]
            columns = [batch.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array(named), pa.array(back)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        give_back()

    chosen, kind = _chosen(docs, id_col, text_col)
    return chosen.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _chosen(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    bound_batches(docs.sparkSession)
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return chosen, chosen.schema["doc_id"].dataType.simpleString()
