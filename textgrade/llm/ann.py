"""Approximate nearest neighbours by learned partitions.

The neighbour graph of a bounded sample is cut into parts of equal size with few edges between them. A
small network learns, from a vector alone, how its neighbours are spread over the parts. It puts every
vector of the table into its most probable part and sends every query to as many of the most probable
parts as the wanted recall takes on the sample, and to more where these hold too few rows. There the query is compared with all vectors, and its
best are ranked by their exact inner product.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textgrade.llm.common import saved

SAMPLE = 6000  # vectors the index is fitted on, at most
PARTS = 32
NEIGHBOURS = 20  # edges of a vector in the graph, and hits by which recall is set
RECALL = 0.96  # wanted on the sample; what is farther apart there is closer among all vectors
BLOCK = 4096  # vectors, and queries, that meet in one task


def usable(vector: str) -> Column:
    """Neither null nor zero, with finite components only."""
    x = F.col(vector)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return x.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(x, lambda v: v != 0)


def graph(vectors: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` vectors of largest inner product with each, without itself."""
    out = np.empty((len(vectors), k), np.int64)
    for at in range(0, len(vectors), 1024):
        near = vectors[at : at + 1024] @ vectors.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -np.inf
        out[at : at + 1024] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(vectors: np.ndarray, edges: np.ndarray, parts: int, rounds: int = 8) -> np.ndarray:
    """A part for each vector, all of nearly equal size, with many edges inside of parts.

    Starts from median cuts along the widest directions; then vectors move to the part most of their
    neighbours are in, largest gain first, as long as no part gets more than a twentieth above its share.
    """
    part = np.zeros(len(vectors), np.int64)
    made = 1
    while made < parts:
        for p in range(made):
            rows = np.flatnonzero(part == p)
            centred = vectors[rows] - vectors[rows].mean(axis=0)
            direction = np.linalg.eigh(centred.T @ centred)[1][:, -1]
            part[rows[np.argsort(centred @ direction, kind="stable")[len(rows) // 2 :]]] = p + made
        made *= 2
    capacity = int(np.ceil(1.05 * len(vectors) / made))
    both = np.concatenate([np.stack([np.repeat(np.arange(len(edges)), edges.shape[1]), edges.ravel()], 1), np.stack([edges.ravel(), np.repeat(np.arange(len(edges)), edges.shape[1])], 1)])
    for _ in range(rounds):
        links = np.zeros((len(vectors), made), np.int64)
        np.add.at(links, (both[:, 0], part[both[:, 1]]), 1)
        sizes = np.bincount(part, minlength=made)
        gain = links.max(axis=1) - links[np.arange(len(part)), part]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            to = int(links[i].argmax())
            if sizes[to] < capacity:
                sizes[part[i]] -= 1
                sizes[to] += 1
                part[i] = to
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """A network with one hidden layer: chances of each part to hold neighbours of a vector."""

    layers: list[np.ndarray]
    probes: int = 1

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.layers[0] + self.layers[1], 0)

    def chances(self, x: np.ndarray) -> np.ndarray:
        score = self.hidden(x) @ self.layers[2] + self.layers[3] + x @ self.layers[4]
        score = np.exp(score - score.max(axis=1, keepdims=True))
        return score / score.sum(axis=1, keepdims=True)

    def fit(self, x: np.ndarray, wanted: np.ndarray, epochs: int = 30, rate: float = 3e-3) -> None:
        rng = np.random.default_rng(3)
        mean, square, step = [np.zeros_like(p) for p in self.layers], [np.zeros_like(p) for p in self.layers], 0
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
                step += 1
                h = self.hidden(x[rows])
                gap = (self.chances(x[rows]) - wanted[rows]) / len(rows)
                inner = gap @ self.layers[2].T * (h > 0)
                slopes = [x[rows].T @ inner, inner.sum(axis=0), h.T @ gap, gap.sum(axis=0), x[rows].T @ gap]
                for i, slope in enumerate(slopes):
                    mean[i] = 0.9 * mean[i] + 0.1 * slope
                    square[i] = 0.99 * square[i] + 0.01 * slope**2
                    self.layers[i] -= rate * mean[i] / (1 - 0.9**step) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-8)


def learn(vectors: np.ndarray, parts: int = PARTS, recall: float = RECALL) -> Router:
    """Fit a router to a sample, and set how many parts a query visits."""
    n, width = vectors.shape
    rng = np.random.default_rng(5)
    scale = max(float(np.sqrt((vectors**2).sum(axis=1).mean())), 1e-300)
    vectors = vectors / scale
    size = 1
    while size * 2 <= min(parts, n // 32):
        size *= 2
    router = Router([rng.normal(0, width**-0.5, (width, 64)), np.zeros(64), rng.normal(0, 0.1, (64, size)), np.zeros(size), np.zeros((width, size))])
    if size > 1:
        edges = graph(vectors, min(NEIGHBOURS, n - 1))
        part = balanced_parts(vectors, edges, size)
        wanted = np.zeros((n, size))
        np.add.at(wanted, (np.repeat(np.arange(n), edges.shape[1]), part[edges].ravel()), 1 / edges.shape[1])
        wanted[np.arange(n), part] += 1
        router.fit(vectors, wanted / 2)
        chances = router.chances(vectors)
        place = chances.argmax(axis=1)
        rank = np.empty_like(chances, dtype=np.int64)
        np.put_along_axis(rank, np.argsort(-chances, axis=1), np.arange(size)[None, :], axis=1)
        reached = np.sort(np.take_along_axis(rank, place[edges], axis=1).ravel())
        router.probes = int(reached[min(len(reached) - 1, int(np.ceil(recall * len(reached))) - 1)]) + 1
    router.layers[0] = router.layers[0] / scale
    router.layers[4] = router.layers[4] / scale
    return router


def nearest(
    rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    sample: int = SAMPLE, parts: int = PARTS, recall: float = RECALL,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for every row that is a query.

    Nearest is the largest inner product, in double precision; ties go to the smaller id. Every row but
    the query's own is a candidate; a row is known by its id, so rows of the query's own id are left out,
    and of rows that repeat an id the best counts. Vectors that are null, zero or have null or non-finite
    components and those without id take no part. Vectors of another length are a search of their own, for
    an inner product needs equal lengths. A query that finds fewer than ``k`` ids in the parts it visits goes
    on down its order of parts until there are enough, so it gets ``k`` rows, or all candidates if they are
    fewer. An empty table gives no rows.
    """
    fine = rows.filter(usable(vector_col) & F.col(id_col).isNotNull())
    slim = fine.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    sizes = slim.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"), F.count_if("q").alias("queries")).collect()
    spark = rows.sparkSession
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    parts_of = [
        _nearest_of_width(slim.filter(F.size("v") == r["n"]), r["n"], r["rows"], r["queries"], k, sample, parts, recall)
        for r in sorted(sizes, key=lambda r: r["n"]) if r["queries"]
    ]
    if not parts_of:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = reduce(DataFrame.unionByName, parts_of)
    if len(parts_of) > 1:  # an id that stands with vectors of several lengths has one list all the same
        found = _best(found, k)
    return found


def _best(met: DataFrame, k: int) -> DataFrame:
    """The best ``k`` ids of each query; negative scores sort the array of at most k from each block."""
    best = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).groupBy("query_id").agg(
        F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k).alias("best")
    )
    return best.select("query_id", F.posexplode("best").alias("rank", "b")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.far")).alias("score")
    )


def enough(order: Column, held: Sequence[int], probes: int, wanted: int) -> Column:
    """The first parts of ``order``: ``probes`` of them, and more until they hold ``wanted`` ids."""
    sizes = F.array(*[F.lit(int(n)).cast("long") for n in held])
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("ids"))
    step = lambda a, p: F.when(
        (a["n"] < probes) | (a["ids"] < wanted), F.struct((a["n"] + 1).alias("n"), (a["ids"] + F.get(sizes, p)).alias("ids"))
    ).otherwise(a)
    return F.slice(order, F.lit(1), F.aggregate(order, start, step, lambda a: a["n"]))


def _nearest_of_width(
    slim: DataFrame, width: int, count: int, queries: int, k: int, sample: int, parts: int, recall: float
) -> DataFrame:
    """Search among vectors of one length."""
    spark = slim.sparkSession
    draw = F.pmod(F.xxhash64(F.lit("sample"), "vec_id"), F.lit(1 << 30))
    drawn = slim.filter(draw < int(min(1.0, 1.1 * sample / count) * (1 << 30))).select(draw.alias("d"), "vec_id", "v").collect()
    drawn = sorted(drawn, key=lambda r: (r["d"], r["vec_id"]))[:sample]
    shared = spark.sparkContext.broadcast(learn(np.array([r["v"] for r in drawn], np.float64).reshape(len(drawn), width), parts, recall))
    n_parts = len(shared.value.layers[3])

    def place(batches):
        router = shared.value
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, width)
            chances = router.chances(x)
            order = np.argsort(-chances, axis=1, kind="stable").astype(np.int32)
            # queries keep their whole order, other rows the one part they are held in
            asked = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool)
            listed = asked[:, None] | (np.arange(order.shape[1]) == 0)[None, :]
            ends = np.concatenate([[0], np.cumsum(listed.sum(axis=1))]).astype(np.int32)
            visits = pa.ListArray.from_arrays(ends, order[listed])
            yield pa.RecordBatch.from_arrays([*batch.columns, visits], ["vec_id", "v", "q", "parts"])

    placed = saved(slim.mapInArrow(place, "vec_id long, v array<double>, q boolean, parts array<int>"))
    # every id counts in one part only, so parts that hold k + 1 ids hold k candidates beside the query's own
    own = placed.groupBy("vec_id").agg(F.min(F.get("parts", 0)).alias("part")).groupBy("part").agg(F.count("*").alias("n"))
    ids = {r["part"]: r["n"] for r in own.collect()}  # a row a part
    visits = enough(F.col("parts"), [ids.get(p, 0) for p in range(n_parts)], max(shared.value.probes, 1), k + 1)
    ways = max(1, -(-count // (n_parts * BLOCK))), max(1, -(-queries // (n_parts * BLOCK)))
    # by id and vector, so that an id with many vectors does not fill one block
    salt = lambda n, name: F.pmod(F.xxhash64(F.lit(name), "vec_id", "v"), F.lit(n)).cast("int").alias(name)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = placed.select("vec_id", "v", F.get("parts", 0).alias("part"), salt(ways[0], "i")).withColumn("j", every(ways[1]))
    asks = placed.filter("q").select("vec_id", "v", F.explode(visits).alias("part"), salt(ways[1], "j")).withColumn("i", every(ways[0]))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
        ids, asked = np.asarray(left["vec_id"]), np.asarray(right["vec_id"])
        by_id = np.argsort(ids, kind="stable")
        x = np.asarray(left["v"].combine_chunks().flatten()).reshape(len(ids), width)[by_id]
        ids = ids[by_id]
        starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))  # rows that repeat an id are one candidate
        y = np.asarray(right["v"].combine_chunks().flatten()).reshape(len(asked), width)
        out = []
        for at in range(0, len(asked), 256):
            near = y[at : at + 256] @ x.T
            near[asked[at : at + 256, None] == ids[None, :]] = -np.inf
            if len(starts) > k:
                floor = -np.partition(-np.maximum.reduceat(near, starts, axis=1), k - 1, axis=1)[:, k - 1 : k]
                hits = near >= floor - 1e-9 * (1 + np.abs(floor))  # rounding of the product can't lose one
            else:
                hits = np.ones(near.shape, bool)
            hits &= near > -np.inf
            q, c = np.nonzero(hits)
            score = (y[at + q] * x[c]).sum(axis=1)
            order = np.lexsort((-score, ids[c], q))
            q, c, score = q[order], c[order], score[order]
            if len(starts) < len(ids) and len(q):
                best = np.concatenate([[True], (q[1:] != q[:-1]) | (ids[c][1:] != ids[c][:-1])])
                q, c, score = q[best], c[best], score[best]
            order = np.lexsort((ids[c], -score, q))
            q, c, score = q[order], c[order], score[order]
            first = np.searchsorted(q, q)
            keep = np.arange(len(q)) - first < k
            out.append((asked[at + q[keep]], ids[c[keep]], score[keep]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], names)

    met = held.groupBy("part", "i", "j").cogroup(asks.groupBy("part", "i", "j")).applyInArrow(meet, "query_id long, vec_id long, score double")
    return _best(met, k)
