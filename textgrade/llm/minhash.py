"""Document fingerprints by MinHash: many universal hash permutations over word shingles, in numpy.

A fingerprint is the smallest value of each of ``perms`` permutations ``a * x + b`` of 32-bit shingle
hashes; equal places estimate the Jaccard similarity of two texts. Bands of a signature are join keys:
:func:`near_duplicates` joins them in Spark, verifies the exact Jaccard similarity of the shingle sets
and gives the classes of near-duplicates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgrade.llm.common import bound_batches, components, saved
from textgrade.llm.order import in_order, pairs

PERMS, WIDTH = 128, 5
AT_ONCE = 1 << 17  # shingles that are permuted together
_STEP = np.uint64(0x9E3779B97F4A7C15)  # fixed value: odd multiplier of the word and shingle hashes
_SEPARATES = np.zeros(256, bool)
_SEPARATES[[9, 10, 11, 12, 13, 32]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)  # fixed value: odd multiplier of the mix
    return x ^ (x >> np.uint64(29))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, modulo 2**64, for at least ``n`` bytes."""
    if len(_powers.kept[0]) < n:
        inverse = np.uint64(pow(int(_STEP), -1, 1 << 64))
        _powers.kept = tuple(np.cumprod(np.r_[np.uint64(1), np.full(2 * n, m)]) for m in (_STEP, inverse))
    return _powers.kept


_powers.kept = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hash of every word of a text; words are parted by ASCII white space, A-Z counts as a-z."""
    out, at = [], 0
    while at < len(data):
        end = at + (1 << 20)
        if end < len(data):  # cut behind a word
            gaps = np.flatnonzero(_SEPARATES[np.frombuffer(data, np.uint8, offset=end)[: 1 << 16]])
            end = end + int(gaps[0]) if len(gaps) else len(data)
        out.append(_piece_hashes(data[at:end].lower()))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _piece_hashes(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    inside = np.r_[False, ~_SEPARATES[b], False]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers(len(b) + 1)
    sums = np.r_[np.uint64(0), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)])]
    return _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """32-bit hashes of the ``width``-word shingles (of all words, if there are fewer; none without words)."""
    words = word_hashes(text.encode("utf-8", "surrogatepass"))
    if not len(words):
        return np.zeros(0, np.uint32)
    width = min(width, len(words))
    n = len(words) - width + 1
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total = total * _STEP + words[i : i + n]
    return (_mixed(total + np.uint64(width)) >> np.uint64(32)).astype(np.uint32)


def _family(perms: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 1 << 32, perms, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, perms, np.uint32)


def signatures(texts: list[str], perms: int = PERMS, width: int = WIDTH) -> np.ndarray:
    """One row of ``perms`` 32-bit minima for each text; all ones without words."""
    a, b = _family(perms)
    out = np.full((len(texts), perms), 0xFFFFFFFF, np.uint32)
    held, owners, n = [], [], 0

    def flush():
        if not held:
            return
        x = np.concatenate(held)
        starts = np.cumsum([0, *map(len, held[:-1])])
        for p in range(perms):
            low = np.minimum.reduceat(x * a[p] + b[p], starts)
            np.minimum.at(out[:, p], owners, low)

    for i, text in enumerate(texts):
        own = shingles(text, width)
        for at in range(0, len(own), AT_ONCE):
            held.append(own[at : at + AT_ONCE])
            owners.append(i)
            n += len(held[-1])
            if n >= AT_ONCE:
                flush()
                held, owners, n = [], [], 0
    flush()
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal places: an estimate of the Jaccard similarity."""
    return (a == b).mean(axis=1)


def hexed(signature: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in np.ascontiguousarray(signature.astype(">u4"))]


def fingerprints_and_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", perms: int = PERMS) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    The edited text of a document has its last ``n_chars // 2`` code points replaced by as many first
    ones (or all) of the next document by id; the first follows the last. Null texts count as empty; null
    ids come first, equal ids go by text; every row gives a row. Texts without words are alike in full.
    """
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, following in pairs(batches):
            n = [len(t) for t in texts]
            edited = [t[: m - m // 2] + f[: m // 2] for t, m, f in zip(texts, n, following)]
            own = signatures(texts + following[-1:], perms)
            changed = signatures(edited, perms)
            sha = [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited]
            columns = [ids, n, sha, hexed(own[:-1]), hexed(changed), likeness(own[:-1], changed), likeness(own[:-1], own[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    bound_batches(docs.sparkSession)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string())]
        + [("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    )
    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs, id_col, text_col).mapInArrow(run, kinds)


ROWS = 5  # minima in a band: texts of similarity 0.8 share one of 25 bands but for 5 cases in 100,000
THRESHOLD = 0.8


def _banded(docs: DataFrame, id_col: str, text_col: str, perms: int, width: int) -> DataFrame:
    """``doc_id, digest, bands, shingles`` of every row: bands as hashes, shingles once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            found = signatures(texts, perms, width)
            keys = np.zeros((len(texts), perms // ROWS), np.uint64)
            for i in range(ROWS):
                keys = _mixed(keys * _STEP + found[:, i : perms // ROWS * ROWS : ROWS] + np.uint64(1))
            sets = [np.unique(shingles(t, width)).view(np.int32) for t in texts]
            columns = [*batch.columns[:2], pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())), pa.array(sets, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "bands", "shingles"])

    bound_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.md5(text.cast("binary")).alias("digest"), text.alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"doc_id {kind}, digest string, bands array<long>, shingles array<int>")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, perms: int = PERMS, width: int = WIDTH
) -> DataFrame:
    """``doc_id, digest, component_id`` of every row: classes of texts whose shingle sets are alike.

    Texts that share a band are candidates; their exact Jaccard similarity must reach ``threshold``. In
    each band all texts are compared with the first one; what this has linked is one class and needs no
    more comparing, and only texts of a band that are still in different classes meet in pairs. Equal
    texts count once. ``component_id`` is the smallest id that links reach (null only if no id is
    there). Null texts count as empty; texts without words are alike in full.
    """
    rows = saved(_banded(docs, id_col, text_col, perms, width))
    texts = saved(rows.select("digest", "bands", "shingles").dropDuplicates(["digest"]))
    keys = texts.select("digest", F.posexplode("bands").alias("band", "key"))
    hubs = keys.groupBy("band", "key").agg(F.min("digest").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    shared = saved(keys.join(hubs, ["band", "key"]).select("band", "key", "hub", "digest"))
    sets = texts.select("digest", "shingles")

    def verified(pairs: DataFrame) -> DataFrame:
        met = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
        both = F.size(F.array_intersect("x", "y"))
        every = F.size("x") + F.size("y") - both
        return met.filter(both >= threshold * every).select("a", "b")

    tried = shared.filter("digest <> hub").select(F.col("hub").alias("a"), F.col("digest").alias("b")).distinct()
    links = saved(verified(tried))
    classes = components(links).toDF("digest", "root")
    placed = shared.join(classes, "digest", "left").select("band", "key", "digest", F.coalesce("root", "digest").alias("root"))
    left, right = placed.toDF("band", "key", "a", "p"), placed.toDF("band", "key", "b", "q")
    apart = left.join(right, ["band", "key"]).filter("a < b AND p <> q").select("a", "b").distinct()
    every = links.union(verified(apart.join(tried, ["a", "b"], "left_anti")))
    roots = components(every).toDF("digest", "root")
    named = rows.select("doc_id", "digest").join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "root").select("doc_id", "digest", "component_id")
