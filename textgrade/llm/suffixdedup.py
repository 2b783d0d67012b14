"""Suffix-array dedup: bytes that an earlier document holds in a string of ``match`` bytes go.

A suffix has a long enough previous factor exactly if a suffix with the same first ``match`` bytes
starts in a document with a smaller id, and such suffixes are neighbours in suffix order, wherever they
come from. So the order need not be built in one place: suffixes are dealt by content, their windows of
``match`` bytes are sorted bucket by bucket, and the smallest document of each group of equal windows
decides. This replaces the array of longest previous factors, which is not computed.

To deal only suffixes that can repeat, each window of ``match`` bytes is represented by an anchor: the
``GRAM`` bytes in it with the smallest hash. Equal windows have equal anchors at equal places, and the
windows of an anchor lie in its context, the bytes around it.

1. Documents are packed into cells of a few megabytes, each one row of a table in the shared folder.
2. Every cell sends each distinct anchor and context once, with its smallest document, to the bucket of
   the anchor's hash. A bucket tells the cells which contexts stand in a smaller document (all windows
   go) and asks for the bytes of contexts whose anchor also has other contexts.
3. Buckets sort the suffixes of these contexts and answer which windows have a previous factor.
4. Cells mark what the windows cover, and give the rest.

A cell sends a context once however often it occurs, so a string that is everywhere costs each bucket at
most one entry for each cell and text around it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgrade.llm.common import bound_batches, cell_count, give_back, saved, worker_cache

MATCH = 50
GRAM = 16
CELL_BYTES = 4 << 20
AT_ONCE = 1 << 20  # bytes whose anchors are found together
FIRST = np.iinfo(np.int64).min  # place of a null id in the order
_ODD = np.uint64(0x9E3779B97F4A7C15)  # fixed value: odd multiplier of the hashes


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)  # fixed value: odd multiplier of the mix
    return x ^ (x >> np.uint64(29))


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` over each ``width`` values in a row."""
    size, out = 1, x
    while size * 2 <= width:
        out = pick(out[:-size], out[size:])
        size *= 2
    return out if size == width else pick(out[: len(x) - width + 1], out[width - size :])


class Anchors:
    """Anchors of a buffer of documents: place, document, hash of the gram, context."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, match: int) -> None:
        self.data, self.ends, self.match, self.side = data, ends, match, match - GRAM
        self.starts = np.r_[0, ends[:-1]]
        self.padded = np.r_[np.zeros(self.side, np.uint8), data, np.zeros(2 * match, np.uint8)]
        places, hashes = [], []
        for a, b in self._parts():
            p, h = self._find(a, b)
            places.append(p)
            hashes.append(h)
        self.place = np.concatenate(places) if places else np.zeros(0, np.int64)
        self.gram = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.place, first = np.unique(self.place, return_index=True)
        self.gram = self.gram[first]
        self.doc = np.searchsorted(ends, self.place, side="right")
        self.left = np.minimum(self.side, self.place - self.starts[self.doc])
        self.right = np.minimum(self.side, ends[self.doc] - self.place - GRAM)
        self.context = np.zeros(len(self.place), np.uint64)
        for at in range(0, len(self.place), AT_ONCE >> 4):
            part = slice(at, at + (AT_ONCE >> 4))
            words = self.bytes_of(part).view(np.uint64)
            total = (self.left[part] * 1000 + self.right[part]).astype(np.uint64)
            for column in words.T:
                total = _mixed((total ^ column) * _ODD + np.uint64(1))
            self.context[part] = total

    def _parts(self) -> Iterator[tuple[int, int]]:
        """Pieces of the buffer that together hold every window."""
        at = 0
        while at < len(self.data):
            yield at, min(len(self.data), at + AT_ONCE + self.match - 1)
            at += AT_ONCE

    def _find(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        n = b - a
        if n < self.match:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total, size, factor = self.data[a:b].astype(np.uint64) + np.uint64(1), 1, np.array([_ODD])
        while size < GRAM:
            total = total[:-size] * factor + total[size:]
            size, factor = size * 2, factor * factor
        total = _mixed(total)
        value = np.maximum((total >> np.uint64(32)).astype(np.uint32), np.uint32(1))
        low = _slide(value, self.side + 1, np.minimum)  # of each window
        inside = self.ends[(self.ends > a) & (self.ends < b + self.match)] - a
        for end in inside.tolist():  # windows that leave their document
            low[max(0, end - self.match + 1) : end] = 0
        padded = np.zeros(len(value) + self.side, np.uint32)
        padded[self.side : self.side + len(low)] = low
        best = _slide(padded, self.side + 1, np.maximum)
        chosen = np.flatnonzero(best == value)
        return chosen + a, total[chosen]

    def bytes_of(self, which) -> np.ndarray:
        """Contexts as rows; a byte that is outside of the document is 0."""
        width = -(-(2 * self.side + GRAM) // 8) * 8
        place, left, right = self.place[which], self.left[which], self.right[which] + GRAM
        out = np.lib.stride_tricks.sliding_window_view(self.padded, width)[place]
        columns = np.arange(width) - self.side
        out[:, 2 * self.side + GRAM :] = 0
        cut = np.flatnonzero((left < self.side) | (right < self.side + GRAM))
        out[cut] *= (columns >= -left[cut][:, None]) & (columns < right[cut][:, None])
        return out


class Cell:
    """A packed cell, and its distinct pairs of anchor and context."""

    def __init__(self, row: dict, match: int) -> None:
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.ends = np.cumsum(np.frombuffer(row["sizes"], np.int64))
        data = zstandard.ZstdDecompressor().decompress(row["blob"], max_output_size=int(self.ends[-1]) + 1 if len(self.ends) else 1)
        self.data = np.frombuffer(data, np.uint8)
        self.anchors = a = Anchors(self.data, self.ends, match)
        # sorted by gram, context and document: the first of each pair is its smallest document
        order = np.lexsort((self.ids[a.doc], a.context, a.gram))
        new = np.ones(len(order), bool)
        new[1:] = (a.gram[order[1:]] != a.gram[order[:-1]]) | (a.context[order[1:]] != a.context[order[:-1]])
        self.first = order[new]  # an anchor for each pair
        self.pair = np.empty(len(order), np.int64)
        self.pair[order] = np.cumsum(new) - 1
        self.gram, self.context = a.gram[self.first], a.context[self.first]
        self.id = self.ids[a.doc[self.first]]

    def find(self, gram: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Numbers of pairs; contexts tell pairs apart but for chance, grams settle that."""
        if not len(gram):
            return np.zeros(0, np.int64)
        keys = _mixed(self.gram ^ (self.context * _ODD))
        order = np.argsort(keys)
        return order[np.searchsorted(keys[order], _mixed(gram ^ (context * _ODD)))]


def _pack(docs: DataFrame, text_col: str, cell_bytes: int) -> DataFrame:
    """Cells ``cell, ids, sizes, blob, rest``; the other columns travel along in ``rest``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("passages", int)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            part = (np.cumsum(sizes) - sizes) // cell_bytes
            edges = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(texts)].tolist()
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                ids = batch.column(batch.num_columns - 2).slice(a, b - a).fill_null(int(FIRST))
                sink = pa.BufferOutputStream()
                rest = batch.slice(a, b - a).select(range(batch.num_columns - 2))
                with pa.ipc.new_stream(sink, rest.schema) as writer:
                    writer.write_batch(rest)
                squeeze = zstandard.ZstdCompressor(level=3).compress
                row = {
                    "cell": [uuid.uuid4().int >> 65],
                    "ids": [np.asarray(ids).tobytes()],
                    "sizes": [sizes[a:b].tobytes()],
                    "blob": [squeeze(b"".join(texts[a:b]))],
                    "rest": [squeeze(sink.getvalue().to_pybytes())],
                }
                yield pa.RecordBatch.from_pydict(row)
        give_back()

    return docs.mapInArrow(run, "cell long, ids binary, sizes binary, blob binary, rest binary")


def _rows(batch: pa.RecordBatch | pa.Table) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def _sent(cell: Cell, number: int, which: np.ndarray, buckets: int, with_bytes: bool = False) -> Iterator[pa.RecordBatch]:
    """Pairs of a cell as one row for each bucket, on request with the bytes of their contexts."""
    bucket = ((cell.gram[which] >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0, True]) if len(order) else np.zeros(1, np.int64)
    parts = [which[order[a:b]] for a, b in zip(edges[:-1], edges[1:])]
    if parts:
        data = {
            "bucket": [int(bucket[order[a]]) for a in edges[:-1]],
            "cell": [number] * len(parts),
            "gram": [cell.gram[p].tobytes() for p in parts],
            "context": [cell.context[p].tobytes() for p in parts],
            "id": [cell.id[p].tobytes() for p in parts],
        }
        if with_bytes:
            a = cell.anchors
            data["bytes"] = [a.bytes_of(cell.first[p]).tobytes() for p in parts]
            data["sides"] = [np.stack([a.left[cell.first[p]], a.right[cell.first[p]]], 1).astype(np.uint8).tobytes() for p in parts]
        yield pa.RecordBatch.from_pydict(data)


_REPLY = "cell long, gram binary, context binary, mask binary"


def _replies(cells: np.ndarray, gram: np.ndarray, context: np.ndarray, mask: np.ndarray) -> pa.Table:
    """One row for each cell that gets an answer; mask 0 asks for the bytes of the context."""
    order = np.argsort(cells, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(cells[order]) != 0, True]) if len(order) else np.zeros(1, np.int64)
    parts = [order[a:b] for a, b in zip(edges[:-1], edges[1:])]
    columns = {
        "cell": pa.array([int(cells[p[0]]) for p in parts], pa.int64()),
        "gram": pa.array([gram[p].tobytes() for p in parts], pa.binary()),
        "context": pa.array([context[p].tobytes() for p in parts], pa.binary()),
        "mask": pa.array([mask[p].tobytes() for p in parts], pa.binary()),
    }
    return pa.table(columns)


def _joined(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Entries of a bucket: cell, gram, context, id."""
    part = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
    gram = part("gram", np.uint64)
    counts = [len(x) // 8 for x in table["gram"].to_pylist()]
    return np.repeat(np.asarray(table["cell"]), counts), gram, part("context", np.uint64), part("id", np.int64)


def _segments(*keys: np.ndarray) -> np.ndarray:
    """Number of the run of equal keys at each place."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def _settle(match: int):
    everything = np.uint64((1 << (match - GRAM + 1)) - 1)

    def run(table: pa.Table) -> pa.Table:
        worker_cache("passages", int)
        give_back()
        cell, gram, context, ids = _joined(table)
        order = np.lexsort((ids, context, gram))
        cell, gram, context, ids = cell[order], gram[order], context[order], ids[order]
        pair, anchor = _segments(gram, context), _segments(gram)
        starts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        owner = np.zeros(len(ids), bool)
        owner[starts] = True
        least = ids[starts][pair]  # smallest document of the pair
        contexts = np.bincount(anchor[starts])[anchor]
        low = np.minimum.reduceat(ids, np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]))[anchor]
        high = np.maximum.reduceat(least, np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]))[anchor]
        full = ids > least
        ask = (owner | (ids == least)) & (contexts > 1) & (low < high)
        chosen = np.flatnonzero(full | ask)
        mask = np.where(full, everything, np.uint64(0))[chosen]
        return _replies(cell[chosen], gram[chosen], context[chosen], mask)

    return run


def previous_factors(contexts: np.ndarray, sides: np.ndarray, group: np.ndarray, ids: np.ndarray, match: int) -> np.ndarray:
    """For each context the windows (bit ``j``: the one that starts ``j`` bytes in) with a previous factor.

    The suffixes of all contexts are sorted by group and their first ``match`` bytes; in that order the
    next smaller documents above and below share ``match`` bytes exactly if they lie in the same run.
    """
    side = match - GRAM
    out = np.zeros(len(contexts), np.uint64)
    words = -(-match // 8)
    for j in range(side + 1):
        held = np.flatnonzero((sides[:, 0] >= side - j) & (sides[:, 1] >= j))
        if not len(held):
            continue
        window = np.zeros((len(held), words * 8), np.uint8)
        window[:, :match] = contexts[held, j : j + match]
        keys = [window[:, 8 * w : 8 * w + 8].copy().view(np.uint64)[:, 0] for w in range(words)]
        order = np.lexsort((*keys[::-1], group[held]))
        run = _segments(group[held][order], *[k[order] for k in keys])
        starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        least = np.minimum.reduceat(ids[held][order], starts)[run]
        hit = order[ids[held][order] > least]
        out[held[hit]] |= np.uint64(1) << np.uint64(j)
    return out


def _refine(match: int):
    side = match - GRAM
    width = -(-(2 * side + GRAM) // 8) * 8

    def run(table: pa.Table) -> pa.Table:
        worker_cache("passages", int)
        give_back()
        cell, gram, context, ids = _joined(table)
        contexts = np.frombuffer(b"".join(table["bytes"].to_pylist()), np.uint8).reshape(-1, width)
        sides = np.frombuffer(b"".join(table["sides"].to_pylist()), np.uint8).reshape(-1, 2).astype(np.int64)
        order = np.argsort(gram, kind="stable")
        cell, gram, context, ids, contexts, sides = (x[order] for x in (cell, gram, context, ids, contexts, sides))
        mask = previous_factors(contexts, sides, _segments(gram), ids, match)
        chosen = np.flatnonzero(mask)
        return _replies(cell[chosen], gram[chosen], context[chosen], mask[chosen])

    return run


def _answers(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(b"".join(table[name].to_pylist()), np.uint64) for name in ("gram", "context", "mask"))


def _covered(cell: Cell, replies: pa.Table, match: int) -> np.ndarray:
    """Which bytes of the cell go."""
    a, side = cell.anchors, match - GRAM
    masks = np.zeros(len(cell.first), np.uint64)
    gram, context, mask = _answers(replies)
    np.bitwise_or.at(masks, cell.find(gram, context), mask)
    own = masks[cell.pair]
    own[cell.ids[a.doc] > cell.id[cell.pair]] = np.uint64((1 << (side + 1)) - 1)
    change = np.zeros(len(cell.data) + 1, np.int32)
    hit = np.flatnonzero(own)
    for j in range(side + 1):
        ok = hit[(own[hit] >> np.uint64(j)) & np.uint64(1) == 1]
        ok = ok[(a.left[ok] >= side - j) & (a.right[ok] >= j)]
        at = a.place[ok] - (side - j)
        np.add.at(change, at, 1)
        np.subtract.at(change, at + match, 1)
    return np.cumsum(change[:-1]) > 0


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", match: int = MATCH, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """``docs`` with the kept bytes, ``n_bytes, n_removed, n_spans, kept``, in place of the text column.

    A byte goes if a string of ``match`` bytes that covers it also starts in a document with a smaller id;
    strings overlap and are judged on the input, and matches never cross documents. Null texts count as
    empty. A null id is smaller than any other; documents of one id, repeated rows too, take nothing from
    each other. The first occurrence stays, so does all of a document shorter than ``match``. Columns
    already called like the results are replaced. An empty table gives no rows.
    """
    names = ("n_bytes", "n_removed", "n_spans", "kept")
    own = [c for c in docs.columns if c != text_col and c not in names]
    given = docs.select(
        *[F.col(f"`{c}`") for c in own],
        F.col(id_col).cast("long").alias("__id"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("__text"),
    )
    bound_batches(docs.sparkSession)
    cells = saved(_pack(given, "__text", cell_bytes))
    buckets = cell_count(docs, text_col, cell_bytes)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                cell = Cell(row, match)
                yield from _sent(cell, row["cell"], np.arange(len(cell.first)), buckets)
        give_back()

    slim = cells.select("cell", "ids", "sizes", "blob")
    sent = slim.mapInArrow(first, "bucket long, cell long, gram binary, context binary, id binary")
    settled = saved(sent.groupBy("bucket").applyInArrow(_settle(match), _REPLY))

    def second(left: pa.Table, right: pa.Table) -> pa.Table:
        give_back()
        out = []
        for row in _rows(left):
            gram, context, mask = _answers(right)
            if (mask == 0).any():
                cell = Cell(row, match)
                out += _sent(cell, row["cell"], np.unique(cell.find(gram[mask == 0], context[mask == 0])), buckets, True)
        return pa.Table.from_batches(out, asked) if out else asked.empty_table()

    asked = pa.schema([("bucket", pa.int64()), ("cell", pa.int64())] + [(n, pa.binary()) for n in ("gram", "context", "id", "bytes", "sides")])
    bytes_sent = slim.groupBy("cell").cogroup(settled.groupBy("cell")).applyInArrow(
        second, "bucket long, cell long, gram binary, context binary, id binary, bytes binary, sides binary"
    )
    refined = saved(bytes_sent.groupBy("bucket").applyInArrow(_refine(match), _REPLY))

    def third(left: pa.Table, right: pa.Table) -> pa.Table:
        give_back()
        out = []
        for row in _rows(left):
            cell = Cell(row, match)
            gone = _covered(cell, right, match)
            rest = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(row["rest"])).read_all()
            edge = np.diff(np.r_[False, gone].astype(np.int8)) == 1
            removed, spans, kept = [], [], []
            for a, b in zip(cell.anchors.starts.tolist(), cell.ends.tolist()):
                part = gone[a:b]
                removed.append(int(part.sum()))
                spans.append(int(edge[a + 1 : b].sum()) + int(a < b and part[0]))
                kept.append(cell.data[a:b][~part].tobytes())
            sizes = np.frombuffer(row["sizes"], np.int64)
            for name, column in zip(names, (pa.array(sizes), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary()))):
                rest = rest.append_column(name, column)
            out.append(rest)
        return pa.concat_tables(out) if out else None

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in given.select(*[F.col(f"`{c}`") for c in own]).schema]
    schema = ", ".join([*kinds, "n_bytes long", "n_removed long", "n_spans long", "kept binary"])
    every = settled.union(refined).union(cells.select("cell", *[F.lit(b"").alias(c) for c in ("gram", "context", "mask")]))
    return cells.groupBy("cell").cogroup(every.groupBy("cell")).applyInArrow(third, schema)
