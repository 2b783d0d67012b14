"""SimHash near-duplicates through an inverted index of byte positions with count filtering.

Two 64-bit fingerprints that differ in at most ``d`` bits share at least ``8 - d`` of their eight
positional bytes. Postings are therefore keyed by every choice of that many positions together with
the bytes found there, so a pair with enough matches meets under some key and lists stay short. Under
a key, the matching bytes of a pair are tallied, pairs below the guaranteed minimum fall away and the
rest are verified bit by bit. Only a spanning forest of each list's links is given out, never all its
pairs; lists that are too long for one task are compared in blocks spread over tasks. Components of
these links are the near-duplicate classes.

The pairs of :func:`alike_classes` can be far apart in bits, since a shingle set with a given Jaccard
similarity to another has a fingerprint that is only likely to be near. So wide a bound takes in
unrelated texts as well, as many as the square of their number says, whatever the positions. The index
is therefore keyed by shingles: two sets of a wanted similarity share one of the first shingles of each,
if both are in one order and the first ones are as many as may be missing, and one. In the order by the
number of sets that hold a shingle, rare ones come first, and those of one set alone need no list. From
the places of a shared shingle follows how much two sets can have in common at most. Of the pairs that are
left, near fingerprints come first: they are tallied by matching positions, finer than bytes and more than
bits that may differ, and verified bit by bit. This joins most of what is alike at little cost. Sets that meet
and are still in different classes are then compared whatever their bits, for a similarity doesn't bound
them, and every pair is verified by its shingle sets before it links: no similar pair is left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgrade.llm.common import bound_batches, components, give_back, passing, saved, wide_batches, worker_cache

SEED = 42  # fixed value: seed of the shingle hash
BITS_AT_ONCE = 1 << 15  # shingles whose bits are counted together
SHORT_LIST = 32  # lists up to this length are compared by shifts
BLOCK = 4096  # fingerprints of a list that one task compares with each other
THRESHOLD = 0.8  # Jaccard similarity of shingle sets that are alike
SPARE = 2  # positions of a wide index beyond the bits that may differ: the matches that every near pair has
WIDE_BITS = 16  # sets of similarity 0.8 differ in 9.7 bits on the average: 99 of 100, of short ones 93, in at most so many
PAIRS_AT_ONCE = 1 << 17
COUNTED_AT_ONCE = 1 << 21  # shingles that one task counts together
LISTED_AT_ONCE = 1 << 16  # entries of lists that are compared together
CELL_SETS = 250
CELLS_AT_ONCE = 8
CROWD = 2048  # sets of a crowd that one task compares with each other


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of every ``width``-word shingle of a text, repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - width + 1)
    slices = map(slice, starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist())
    hashes = map(xxhash.xxh64_intdigest, map(joined.__getitem__, slices), repeat(SEED))
    return np.fromiter(hashes, np.uint64, n)


def simhash(text: bytes | None, width: int = 4) -> int:
    """Fingerprint of a text: each bit is set in more than half of the shingle hashes."""
    return majority(shingle_hashes(text or b"", width))


def majority(hashes: np.ndarray) -> int:
    """Each bit that is set in more than half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BITS_AT_ONCE):
        part = hashes[at : at + BITS_AT_ONCE]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """``doc_id, digest, fp`` of every row: id, hash of the text, fingerprint (0 for null and without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("fingerprints", int)
        for batch in batches:
            fps = np.fromiter((simhash(t.as_py(), width) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["doc_id", "digest", "fp"])
        give_back()

    bound_batches(docs.sparkSession)
    text = F.col(text_col)
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("digest"), text.cast("binary").alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"doc_id {kind}, digest long, fp long")


def runs(positions: int) -> list[tuple[int, int]]:
    """First bit and end of every position: the 64 bits cut into ``positions`` runs, as even as can be."""
    edges = [64 * i // positions for i in range(positions + 1)]
    return list(zip(edges, edges[1:]))


def postings(fps: DataFrame, max_bits: int = 4, positions: int = 8, together: int | None = None) -> DataFrame:
    """The rows of ``fps`` for each choice of ``together`` positions: its number, their bits, the row.

    Fingerprints that differ in at most ``max_bits`` bits agree in ``positions - max_bits`` positions at
    least, so they meet under one choice or more of up to that many, which is the default.
    """
    if not 0 <= max_bits < positions <= 64:
        raise ValueError("there must be more positions than bits that may differ, and at most 64")
    masks = [(1 << b) - (1 << a) for a, b in runs(positions)]
    keys = []
    for at, places in enumerate(combinations(masks, together or positions - max_bits)):
        mask = sum(places)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(at).cast("int").alias("places"), F.col("fp").bitwiseAND(F.lit(signed)).alias("bytes")))
    return fps.select("*", F.explode(F.array(*keys)).alias("key")).select("key.places", "key.bytes", *fps.columns)


def close(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Whether pairs share enough positional bytes and differ in at most ``max_bits`` bits."""
    differ = a ^ b
    shared = (differ[..., None].view(np.uint8) == 0).sum(axis=-1)
    out = shared >= 8 - max_bits
    out[out] = np.bitwise_count(differ[out]) <= max_bits
    return out


def tally(differ: np.ndarray, positions: int) -> np.ndarray:
    """In how many positions pairs match, ``differ`` being the bits in which they don't."""
    spans = runs(positions)
    # the first bit of a run stands for the run: it is set if any of its bits is
    first = [np.uint64(sum(1 << a for a, b in spans if b - a > shift)) for shift in range(max(b - a for a, b in spans))]
    found, part = differ & first[0], np.empty_like(differ)
    for shift, mask in enumerate(first[1:], 1):
        np.right_shift(differ, np.uint64(shift), out=part)
        part &= mask
        found |= part
    return positions - np.bitwise_count(found)


def forest(left: np.ndarray, right: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between (and within, if they are the same) two lists."""
    nodes = np.unique(np.concatenate([left, right]))
    inner, edges = len(nodes) == len(left) == len(right), []
    waiting = np.ones(len(nodes), bool)
    in_left, in_right = np.isin(nodes, left), np.isin(nodes, right)
    while waiting.any():
        frontier = [int(np.argmax(waiting))]
        waiting[frontier[0]] = False
        while frontier:
            u = frontier.pop()
            reach = waiting if inner else waiting & ((in_right & in_left[u]) | (in_left & in_right[u]))
            places = np.flatnonzero(reach)
            found = places[np.bitwise_count(nodes[places] ^ nodes[u]) <= max_bits]
            waiting[found] = False
            edges += [(int(nodes[u]), int(nodes[v])) for v in found]
            frontier += found.tolist()
    return edges


def _sweep(max_bits: int, block_size: int):
    """Over postings sorted by key: links of the lists, and the members of lists too long for a task."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("places", pa.int16()), ("bytes", pa.int64()), ("block", pa.int32())])

    def rows(a, b=None, places=None, key=None, block=None):
        n = len(a)
        cols = [a, b, places, key, block]
        return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if c is None else pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    def lists(places, key, fps):
        """Links inside complete lists, all at once where they are short."""
        starts = np.flatnonzero(np.r_[True, (places[1:] != places[:-1]) | (key[1:] != key[:-1])])
        sizes = np.diff(np.r_[starts, len(fps)])
        run = np.repeat(np.arange(len(starts)), sizes)
        short = np.repeat((sizes > 1) & (sizes <= SHORT_LIST), sizes)
        x, r = fps[short], run[short]
        for shift in range(1, min(SHORT_LIST, len(x))):
            same = np.flatnonzero(r[shift:] == r[:-shift])
            if not len(same):
                break
            a, b = x[same], x[same + shift]
            keep = close(a, b, max_bits)
            yield rows(a[keep].view(np.int64), b[keep].view(np.int64))
        for k in np.flatnonzero(sizes > SHORT_LIST):
            members = fps[starts[k] : starts[k] + sizes[k]]
            edges = np.array(forest(members, members, max_bits), np.uint64).reshape(-1, 2)
            if len(edges):
                yield rows(edges[:, 0].copy().view(np.int64), edges[:, 1].copy().view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, long_key, dealt = None, None, 0
        for batch in batches:
            now = [np.asarray(batch.column(i)) for i in range(3)]
            now[2] = now[2].view(np.uint64)
            if long_key is not None:  # the rest of a list that is dealt out
                more = int(np.argmin(np.r_[(now[0] == long_key[0]) & (now[1] == long_key[1]), False]))
                yield rows(now[2][:more].view(np.int64), None, np.full(more, long_key[0]), np.full(more, long_key[1]), (dealt + np.arange(more)) // block_size)
                dealt += more
                now = [c[more:] for c in now]
                if not len(now[0]):
                    continue
                long_key = None
            held = now if held is None else [np.concatenate(c) for c in zip(held, now)]
            last = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
            cut = int(np.argmax(last))
            if cut:
                yield from lists(*[c[:cut] for c in held])
            held = [c[cut:] for c in held]
            if len(held[0]) > block_size:
                long_key, dealt = (held[0][0], held[1][0]), len(held[0])
                yield rows(held[2].view(np.int64), None, held[0], held[1], np.arange(dealt) // block_size)
                held = None
        if held is not None and len(held[0]):
            yield from lists(*held)

    return run


def links(fps: DataFrame, max_bits: int = 4, block_size: int = BLOCK) -> DataFrame:
    """``a, b``: enough links between distinct fingerprints to connect all that are near."""
    keyed = postings(fps.select("fp").distinct(), max_bits).withColumn("places", F.col("places").cast("short"))
    dealt = keyed.repartition(F.hash("places", "bytes")).sortWithinPartitions("places", "bytes", "fp")
    with wide_batches(fps.sparkSession):
        swept = saved(dealt.mapInArrow(_sweep(max_bits, block_size), "a long, b long, places short, bytes long, block int"))
    found = swept.filter("block IS NULL").select("a", "b")
    long = swept.filter("block IS NOT NULL")
    if long.isEmpty():
        return found
    blocks = long.groupBy("places", "bytes").agg(F.max("block").alias("last"))
    met = long.join(blocks, ["places", "bytes"]).select(
        "places", "bytes", "a", "block", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other")
    )

    def tile(table: pa.Table) -> pa.Table:
        fp, block = np.asarray(table["a"]).view(np.uint64), np.asarray(table["block"])
        low = block == block.min()
        left, right = (fp[low], fp[~low]) if not low.all() else (fp, fp)
        edges = np.array(forest(np.unique(left), np.unique(right), max_bits), np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"a": pa.array(edges[:, 0]), "b": pa.array(edges[:, 1])})

    tiles = met.groupBy("places", "bytes", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return found.union(tiles.applyInArrow(tile, "a long, b long"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, max_bits: int = 4
) -> DataFrame:
    """``doc_id, digest, fp, component_id`` of every row of ``docs``; ``digest`` is a hash of the text.

    A-Z is lower-cased, words are what ASCII white space separates, and a shingle is ``width`` words
    (fewer words: all of them). Fingerprints link at ``max_bits`` differing bits or less;
    ``component_id`` is the smallest id that links reach. Null and empty texts have fingerprint 0 and
    link like any other. A null id is never a component id unless all ids of the component are null.
    Repeated rows are kept; an empty table gives no rows.
    """
    fps = saved(fingerprints(docs, id_col, text_col, width))
    own = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(fps, max_bits)).select(F.col("node").alias("fp"), "root")
    classes = saved(own.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = classes.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "digest", "fp", "component_id")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, max_bits: int = 4) -> DataFrame:
    """``docs`` with one row of each near-duplicate class: the smallest id (null last), then hash of the text.

    Of rows equal in id and text one stays.
    """
    found = near_duplicates(docs, id_col, text_col, width, max_bits)
    # a class without any id has no component id; its fingerprint stands in
    group = F.struct("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("fp"))
    stays = found.groupBy(group.alias("group")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("row"))
    stays = stays.select(F.col("row.doc_id").alias("__id"), F.col("row.digest").alias("__digest"))
    digest = F.xxhash64(F.col(text_col))
    met = docs.join(stays, F.col(id_col).eqNullSafe(F.col("__id")) & (digest == F.col("__digest")))
    return met.dropDuplicates(["__id", "__digest"]).drop("__id", "__digest")


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """``doc_id, digest, mark, fp, n, shingles`` of every row; ``shingles`` are 32-bit hashes, once each.

    ``mark`` is a hash of the set and ``fp`` the fingerprint of its members, so equal sets have both in common.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("fingerprints", int)
        for batch in batches:
            found = [np.unique(shingle_hashes(t.as_py() or b"", width)) for t in batch.column(2)]
            fps = np.fromiter(map(majority, found), np.uint64, len(found)).view(np.int64)
            short = [np.unique((h >> np.uint64(32)).astype(np.uint32)).view(np.int32) for h in found]
            marks = np.fromiter((xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in short), np.uint64, len(found)).view(np.int64)
            columns = [*batch.columns[:2], pa.array(marks), pa.array(fps), pa.array([len(h) for h in short], pa.int32()), pa.array(short, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "mark", "fp", "n", "shingles"])
        give_back()

    bound_batches(docs.sparkSession)
    text = F.col(text_col)
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("digest"), text.cast("binary").alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"doc_id {kind}, digest long, mark long, fp long, n int, shingles array<int>")


def set_cells(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """The distinct shingle sets of ``docs``, each once, many in a row: ``cell, mark, fp, n, least, shingles``.

    ``shingles`` holds those of all sets as bytes, one set after another, ``least`` of each set the first row that
    has it: the smallest id (null last), then hash of the text.
    """
    rows = shingle_sets(docs, id_col, text_col, width)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("least")
    sets = rows.groupBy("mark").agg(*[F.first(c).alias(c) for c in ("fp", "n", "shingles")], least)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("fingerprints", int)
        for batch in batches:
            for low in range(0, batch.num_rows, CELL_SETS):
                part = batch.slice(low, CELL_SETS)
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(c)) for c in ("mark", "fp", "n", "least")]
                held = pa.array([np.asarray(part.column("shingles").flatten()).tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65]), *lists, held], ["cell", "mark", "fp", "n", "least", "shingles"])
        give_back()

    kind = rows.schema["doc_id"].dataType.simpleString()
    least_kind = f"array<struct<none:boolean,doc_id:{kind},digest:bigint>>"
    return sets.mapInArrow(pack, f"cell long, mark array<long>, fp array<long>, n array<int>, least {least_kind}, shingles binary")


def _dealt(shingles: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of shingles by bucket, and the ends of the buckets in it."""
    bucket = shingles % np.uint32(buckets)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def shared_shingles(cells: DataFrame, threshold: float) -> DataFrame:
    """``mark, key, at``: the shingles by which sets of the wanted similarity meet, and their places.

    Sets are in the order by the number of sets that hold a shingle (65,535 at most), then by shingle.
    Sets with a similarity of ``threshold`` or more have one of the given shingles in common: of ``n``
    at least ``threshold * n`` are, so the first ones, as many as may be missing and one, hold the
    first common one. Shingles of one set alone are left out.
    """
    total = cells.agg(F.sum(F.expr("aggregate(n, 0L, (x, y) -> x + y)")).alias("n")).first()["n"] or 0
    buckets = max(1, -(-total // COUNTED_AT_ONCE))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("fingerprints", int)
        for batch in batches:
            for cell, held in zip(batch.column("cell").to_pylist(), batch.column("shingles")):
                shingles = np.frombuffer(held.as_buffer(), np.uint32)
                order, ends = _dealt(shingles, buckets)
                full = np.flatnonzero(np.diff(ends)).tolist()
                parts = [shingles[order[ends[b] : ends[b + 1]]].tobytes() for b in full]
                yield pa.RecordBatch.from_arrays([pa.array([cell] * len(full), pa.int64()), pa.array(full, pa.int32()), pa.array(parts, pa.binary())], ["cell", "bucket", "shingles"])
        give_back()

    def count(table: pa.Table) -> pa.Table:
        give_back()
        ordered = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table["shingles"]])
        ordered.sort()
        starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        n = np.diff(np.r_[starts, len(ordered)])
        known, n = ordered[starts[n > 1]], np.minimum(n[n > 1], (1 << 16) - 1).astype(np.uint16)
        found = []
        for x in table["shingles"]:
            part = np.frombuffer(x.as_buffer(), np.uint32)
            place = np.minimum(np.searchsorted(known, part), max(0, len(known) - 1))
            holders = np.where(known[place] == part, n[place], np.uint16(1)) if len(known) else np.ones(len(part), np.uint16)
            found.append(holders.astype(np.uint16).tobytes())
        return pa.table({"cell": table["cell"], "bucket": table["bucket"], "holders": pa.array(found, pa.binary())})

    def first(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)]
        if left.num_rows and right.num_rows:
            mark, n = (np.asarray(left[c][0].values) for c in ("mark", "n"))
            shingles = np.frombuffer(left["shingles"][0].as_buffer(), np.uint32)
            holders = np.zeros(len(shingles), np.uint16)
            in_order = right.sort_by("bucket")["holders"].to_pylist()
            holders[_dealt(shingles, buckets)[0]] = np.frombuffer(b"".join(in_order), np.uint16)
            own = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((shingles, holders, own))
            at = np.arange(len(own)) - np.repeat(np.cumsum(n, dtype=np.int64) - n, n)
            most = n - np.ceil(threshold * n - 1e-6).astype(np.int64) + 1
            kept = (at < most[own]) & (holders[order] > 1)
            out = [mark[own[kept]], shingles[order[kept]].view(np.int32), at[kept].astype(np.int32)]
        return pa.table([pa.array(x) for x in out], ["mark", "key", "at"])

    with wide_batches(cells.sparkSession, CELLS_AT_ONCE):
        dealt = cells.select("cell", "shingles").mapInArrow(deal, "cell long, bucket int, shingles binary")
        counted = saved(dealt.groupBy("bucket").applyInArrow(count, "cell long, bucket int, holders binary"))
    sets = cells.select("cell", "mark", "n", "shingles").groupBy("cell")
    return sets.cogroup(counted.groupBy("cell")).applyInArrow(first, "mark long, key int, at int")


def wide_pairs(
    nodes: DataFrame, max_bits: int | None, threshold: float, first: bool, positions: int | None = None, shared: DataFrame | None = None
) -> DataFrame:
    """``a, b``: marks of ``nodes (mark, fp, n, root)`` within ``max_bits`` (None: any) whose sizes allow the similarity.

    With ``first``, each node of a list is given one node near it only; else it is given all that have
    another root. With ``shared`` (see :func:`shared_shingles`), nodes are compared that share a shingle and
    can be similar by its places. Without, all nodes are, through postings of one position and its bits:
    sizes that allow the similarity are in one class or in neighbouring ones, so a node stands in its own
    class and visits the next.
    """
    if max_bits is None and shared is None:
        raise ValueError("without shared shingles, fingerprints need a bound")
    positions = positions or (max_bits or 0) + SPARE
    if shared is not None:
        lists = max(1, -(-shared.count() // LISTED_AT_ONCE))
        met = nodes.select("mark", "fp", "n", "root").join(shared.select("mark", "key", "at"), "mark")
        keyed = met.select("*", F.lit(True).alias("home"), F.pmod("key", F.lit(lists)).alias("list"))
        groups = ["list"]
    else:
        sized = F.when(F.col("n") > 0, F.floor(F.log("n") / F.lit(float(np.log(1 / threshold) * 1.01)))).otherwise(-2).cast("int")
        met = nodes.select("mark", "fp", "n", "root", sized.alias("own"), F.explode(F.array(sized, sized + 1)).alias("size"))
        fixed = [F.lit(0).alias("key"), F.lit(0).alias("at"), (F.col("own") == F.col("size")).alias("home")]
        keyed = postings(met, max_bits, positions, together=1).select("*", *fixed)
        groups = ["places", "bytes", "size"]

    def compare(table: pa.Table) -> pa.Table:
        mark, fp, n, root, key, at, home = (np.asarray(table[c]) for c in ("mark", "fp", "n", "root", "key", "at", "home"))
        fp, common, out = fp.view(np.uint64), (n - at).astype(np.int64), [np.zeros((0, 2), np.int64)]
        # lists one after another, each in an order of its own, so that what is compared first differs
        mixed = (mark.view(np.uint64) ^ key.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)  # fixed value: odd multiplier
        order = np.lexsort((mixed, key))

        def near(u, v) -> np.ndarray:
            found = (home[u] | home[v]) & (np.minimum(common[u], common[v]) >= threshold / (1 + threshold) * (n[u] + n[v]) - 1e-6)
            if max_bits is not None:
                differ = fp[u] ^ fp[v]
                found &= tally(differ, positions) >= positions - max_bits
                found &= np.bitwise_count(differ) <= max_bits
            return found if first else found & (root[u] != root[v])

        def give(u: np.ndarray, v: np.ndarray) -> None:
            out.append(np.stack([np.minimum(mark[u], mark[v]), np.maximum(mark[u], mark[v])], axis=1))

        edges = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0, True])
        sizes = np.diff(edges)
        short = np.repeat(sizes <= SHORT_LIST, sizes)
        x, run, found = order[short], np.repeat(np.arange(len(sizes)), sizes)[short], []
        for shift in range(1, min(SHORT_LIST, len(x))):
            same = np.flatnonzero(run[shift:] == run[:-shift])
            if not len(same):
                break
            same = same[near(x[same], x[same + shift])]
            found.append(np.stack([same, same + shift]))
        if found:
            u, v = np.concatenate(found, axis=1)
            if first:
                ranked = np.lexsort((u, v))
                u, v = u[ranked], v[ranked]
                one = np.r_[True, v[1:] != v[:-1]][: len(v)]
                u, v = u[one], v[one]
            give(x[u], x[v])
        for k in np.flatnonzero(sizes > SHORT_LIST).tolist():
            members = order[edges[k] : edges[k + 1]]
            if first:  # the first takes all near it, then the first of those left
                while len(members) > 1:
                    hub, members = members[0], members[1:]
                    taken = near(hub, members)
                    give(np.full(int(taken.sum()), hub), members[taken])
                    members = members[~taken]
                continue
            _, kind = np.unique(root[members], return_inverse=True)
            large = kind == np.argmax(np.bincount(kind))  # these need no comparing among themselves
            rest, step = np.flatnonzero(~large), max(1, PAIRS_AT_ONCE // len(members))
            for low in range(0, len(rest), step):
                rows = rest[low : low + step]
                i, j = np.nonzero(near(members[rows][:, None], members[None, :]))
                once = large[j] | (rows[i] < j)
                give(members[rows[i[once]]], members[j[once]])
        pairs = np.concatenate(out)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return keyed.groupBy(*groups).applyInArrow(compare, "a long, b long").distinct()


def mixed_lists(nodes: DataFrame, shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lists whose nodes ``(mark, root)`` have more than one root: ``shared`` of short ones, and crowds ``place, mark``.

    A crowd is made of long lists. Lists of one group of near copies hold much the same roots, so their
    place is the smallest hash of a root: a set then stands in one crowd or few, not in one for each list.
    """
    listed = saved(nodes.select("mark", "root").join(shared, "mark"))
    lists = listed.groupBy("key").agg(
        F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), F.min(F.xxhash64("root")).alias("place")
    )
    mixed = saved(lists.filter("low <> high").select("key", "n", "place"))
    short = listed.join(mixed.filter(F.col("n") <= SHORT_LIST).select("key"), "key").select("mark", "key", "at")
    long = listed.join(mixed.filter(F.col("n") > SHORT_LIST).select("key", "place"), "key")
    return saved(short), saved(long.select("place", "mark").distinct())


def crowd_links(crowds: DataFrame, sets: DataFrame, max_bits: int | None, threshold: float, positions: int | None = None, size: int = CROWD) -> DataFrame:
    """``a, b``: links that join the roots of a crowd's sets ``(mark, fp, n, root, shingles)`` wherever two are alike.

    Pairs are verified where they meet and only a spanning forest of their links is given, so no pair is
    a row. Crowds of more than ``size`` sets are cut into blocks that meet two by two. ``max_bits`` of None is no bound.
    """
    positions = positions or (max_bits or 0) + SPARE
    blocks = crowds.groupBy("place").agg(F.ceil(F.count("*") / F.lit(size)).cast("int").alias("blocks"))
    dealt = crowds.join(blocks, "place").withColumn("block", F.pmod(F.xxhash64("mark"), F.col("blocks")).cast("int"))
    met = dealt.select("place", "mark", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tiles = met.join(sets, "mark").withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))

    def compare(table: pa.Table) -> pa.Table:
        mark, fp, n, root, block = (np.asarray(table[c]) for c in ("mark", "fp", "n", "root", "block"))
        fp, apart, out = fp.view(np.uint64), block.min() != block.max(), []
        held, which = np.unique(np.asarray(table["shingles"].combine_chunks().flatten()), return_inverse=True)
        ends = np.cumsum(n, dtype=np.int64)
        starts = ends - n
        _, kind = np.unique(root, return_inverse=True)
        kind = kind.copy()
        for u in np.flatnonzero(kind != np.argmax(np.bincount(kind))).tolist():
            v = np.flatnonzero(kind != kind[u])
            if apart:
                v = v[block[v] != block[u]]
            v = v[(np.minimum(n[v], n[u]) >= threshold * np.maximum(n[v], n[u]) - 1e-6) & (n[v] > 0)]
            if max_bits is not None:
                differ = fp[v] ^ fp[u]
                v = v[(tally(differ, positions) >= positions - max_bits) & (np.bitwise_count(differ) <= max_bits)]
            if not len(v):
                continue
            has = np.zeros(len(held), bool)
            has[which[starts[u] : ends[u]]] = True
            bounds = np.cumsum(n[v], dtype=np.int64)
            tokens = which[np.repeat(starts[v] - bounds + n[v], n[v]) + np.arange(bounds[-1])]
            both = np.add.reduceat(has[tokens].astype(np.int64), bounds - n[v])
            v = v[both / (n[u].astype(np.int64) + n[v] - both) >= threshold]
            kinds, place = np.unique(kind[v], return_index=True)
            out += [(mark[u], mark[x]) for x in v[place].tolist()]
            kind[np.isin(kind, kinds)] = kind[u]
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(pairs.min(axis=1)), "b": pa.array(pairs.max(axis=1))})

    return tiles.groupBy("place", "i", "j").applyInArrow(compare, "a long, b long")


def alike_sets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, max_bits: int = WIDE_BITS, threshold: float = THRESHOLD
) -> DataFrame:
    """``mark, root, least`` of every distinct shingle set: classes of sets that are alike, and the first row of each set.

    A Jaccard similarity of ``threshold`` or more links two sets. First each set is compared with one near it,
    within ``max_bits`` bits, under every key; sets that this leaves in different classes then meet in pairs
    whatever their bits, those of long lists where they are verified, so large groups cost no square of rows.
    Texts without words are alike in full.
    """
    spark = docs.sparkSession

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("fingerprints", int)
        for batch in batches:
            for mark, n, shingles in zip(batch.column("mark"), batch.column("n"), batch.column("shingles")):
                ends = np.r_[0, np.cumsum(np.asarray(n.values))].astype(np.int32)
                held = pa.array(np.frombuffer(shingles.as_buffer(), np.int32))
                yield pa.RecordBatch.from_arrays([mark.values, pa.ListArray.from_arrays(pa.array(ends), held)], ["mark", "shingles"])
        give_back()

    with passing(spark) as keep:
        cells = saved(set_cells(docs, id_col, text_col, width))
        shared = saved(shared_shingles(cells, threshold))
        nodes = saved(cells.select(F.explode(F.arrays_zip("mark", "fp", "n")).alias("x")).select("x.*"))

        def sets_of(marks: DataFrame) -> DataFrame:
            with wide_batches(spark, CELLS_AT_ONCE):
                every = cells.select("mark", "n", "shingles").mapInArrow(unpack, "mark long, shingles array<int>")
                return saved(every.join(saved(marks.distinct()), "mark", "left_semi"))

        def verified(pairs: DataFrame) -> DataFrame:
            sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("mark")))
            met = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
            both = F.size(F.array_intersect("x", "y"))
            return saved(met.filter(both / (F.size("x") + F.size("y") - both) >= threshold).select("a", "b"))

        tried = saved(wide_pairs(nodes.withColumn("root", F.col("mark")), max_bits, threshold, True, shared=shared))
        links = verified(tried)
        classes = components(links).toDF("mark", "root")
        placed = saved(nodes.join(classes, "mark", "left").select("mark", "fp", "n", F.coalesce("root", "mark").alias("root")))
        short, crowds = mixed_lists(placed, shared)
        rest = saved(wide_pairs(placed, None, threshold, False, shared=short).join(tried, ["a", "b"], "left_anti"))
        links = links.union(verified(rest))
        if not crowds.isEmpty():
            links = links.union(saved(crowd_links(crowds, placed.join(sets_of(crowds.select("mark")), "mark"), None, threshold)))
        roots = components(links).toDF("mark", "root")
        least = cells.select(F.explode(F.arrays_zip("mark", "least")).alias("x")).select("x.*")
        return keep(least.join(roots, "mark", "left").select("mark", F.coalesce("root", "mark").alias("root"), "least"))


def alike_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, max_bits: int = WIDE_BITS, threshold: float = THRESHOLD
) -> DataFrame:
    """``doc_id, digest, mark, root`` of every row: the classes of :func:`alike_sets`."""
    sets = alike_sets(docs, id_col, text_col, width, max_bits, threshold).select("mark", "root")
    return shingle_sets(docs, id_col, text_col, width).select("doc_id", "digest", "mark").join(sets, "mark").select("doc_id", "digest", "mark", "root")


def without_alike(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, max_bits: int = WIDE_BITS, threshold: float = THRESHOLD
) -> DataFrame:
    """``docs`` with one row of each class of :func:`alike_sets`: the smallest id (null last), then hash of the text."""
    found = alike_sets(docs, id_col, text_col, width, max_bits, threshold)
    stays = found.groupBy("root").agg(F.min("least").alias("row"))
    stays = stays.select(F.col("row.doc_id").alias("__id"), F.col("row.digest").alias("__digest"))
    met = docs.join(stays, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text_col)) == F.col("__digest")))
    return met.dropDuplicates(["__id", "__digest"]).drop("__id", "__digest")
