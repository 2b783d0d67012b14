"""Exact k nearest neighbours as an equi-join on cells.

Training vectors belong to the cell of their nearest pivot. From the distances to the pivots alone
a query gets an upper bound for its k-th neighbour and, by the triangle inequality, the cells that
can hold a nearer one. That leaves few cells where vectors have few dimensions or lie in clusters; in
many even dimensions it leaves all, and a query is compared with every training row. Cells are cut
into blocks of bounded size, and so are the queries of a block: no task sees more than one block of
each, compares them by a matrix product, and gives back only its k nearest per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textgrade.operators.ranking import seeded_key

PIVOTS = 64
BLOCK = 4096
ROUTED = 128  # queries that are sent to their cells together: each goes to all cells at worst
CELLS_AT_ONCE = 1 << 20  # distances of a block's queries and rows that are held together
SLACK = 1e-9  # rounding of the bounds must never exclude a true neighbour
DECIMALS = 9  # distances are compared at this precision, equal ones by id


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances between rows, by differences: exact zero for equal rows."""
    out = np.empty((len(x), len(y)))
    step = max(1, 2_000_000 // max(1, y.size))
    for at in range(0, len(x), step):
        diff = x[at : at + step, None, :] - y[None, :, :]
        out[at : at + step] = np.einsum("ijk,ijk->ij", diff, diff)
    return out


def neighbours(queries: DataFrame, train: DataFrame, k: int, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """``id, neighbour_id, distance, place`` of the k nearest rows of ``train`` per query.

    Both sides have ``id`` (long) and ``features`` (array); distances are squared.
    """
    # of equal vectors only the k lowest ids can be among the k nearest
    same = Window.partitionBy("features").orderBy("id")
    data = train.select("id", F.col("features").cast("array<double>").alias("features"))
    data = data.withColumn("_copy", F.row_number().over(same)).where(F.col("_copy") <= k).drop("_copy")
    asked = queries.select("id", F.col("features").cast("array<double>").alias("features"))

    chosen = data.orderBy(seeded_key("id"), "id").limit(pivots).select("features").toPandas()["features"]
    if len(chosen) == 0:
        return queries.sparkSession.createDataFrame([], "id long, neighbour_id long, distance double, place int")
    centers = np.stack(chosen.to_numpy()).astype(np.float64)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            d = np.sqrt(_distances(np.stack(batch["features"].to_numpy()), centers))
            cell = d.argmin(axis=1)
            yield batch.assign(cell=cell.astype(np.int32), radius=d[np.arange(len(d)), cell])

    placed = data.mapInPandas(assign, "id long, features array<double>, cell int, radius double")

    # per cell: size, reach, and the k shortest radii; at most pivots x k numbers
    near = Window.partitionBy("cell").orderBy("radius", "id")
    shortest = placed.select("cell", "radius", "id").withColumn("_at", F.row_number().over(near)).where(F.col("_at") <= k)
    stats = placed.groupBy("cell").agg(
        F.count("*").alias("n"), F.min("radius").alias("low"), F.max("radius").alias("high")
    ).toPandas()
    radii = shortest.select("cell", "radius").toPandas()
    cells = stats["cell"].to_numpy()
    low, high = stats["low"].to_numpy(), stats["high"].to_numpy()
    blocks = np.ceil(stats["n"].to_numpy() / block).astype(np.int64)
    radius_cell, radius = radii["cell"].to_numpy(), radii["radius"].to_numpy()

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (b.iloc[a : a + ROUTED] for b in batches for a in range(0, len(b), ROUTED)):
            d = np.sqrt(_distances(np.stack(batch["features"].to_numpy()), centers))
            upper = d[:, radius_cell] + radius[None, :]
            at = min(k, upper.shape[1]) - 1
            bound = np.partition(upper, at, axis=1)[:, at] if upper.shape[1] > k else np.full(len(d), np.inf)
            lower = np.maximum(d[:, cells] - high[None, :], low[None, :] - d[:, cells])
            row, hit = np.nonzero(lower <= bound[:, None] * (1 + SLACK) + SLACK)
            yield batch.iloc[row].assign(cell=cells[hit].astype(np.int32))

    routed = asked.mapInPandas(route, "id long, features array<double>, cell int")
    per_cell = {int(c): int(b) for c, b in zip(cells, blocks)}
    n_blocks = F.element_at(F.create_map(*[F.lit(v) for pair in per_cell.items() for v in pair]), F.col("cell"))

    # every query of a cell meets all its blocks; the queries are cut as well, by a count per cell,
    # a table of at most as many rows as pivots, and each cut meets a copy of the block
    cuts = F.broadcast(routed.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("cuts")))
    left = (
        routed.join(cuts, "cell")
        .withColumn("cut", F.pmod(F.xxhash64("id", F.lit(1)), F.col("cuts")).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    )
    right = (
        placed.join(cuts, "cell")
        .withColumn("block", F.pmod(F.xxhash64("id"), n_blocks).cast("int"))
        .withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    )

    def nearest(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if q.empty or t.empty:
            return pd.DataFrame({"id": [], "neighbour_id": [], "distance": []})
        x, y = np.stack(q["features"].to_numpy()), np.stack(t["features"].to_numpy())
        step = max(1, CELLS_AT_ONCE // len(y))
        ids, asked = t["id"].to_numpy(), q["id"].to_numpy()
        return pd.concat([nearest_few(x[a : a + step], asked[a : a + step], y, ids) for a in range(0, len(x), step)], ignore_index=True)

    def nearest_few(x: np.ndarray, asked: np.ndarray, y: np.ndarray, every: np.ndarray) -> pd.DataFrame:
        # a matrix product finds all that can be among the k nearest, differences then give exact distances
        size = (x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None, :]
        rough = size - 2 * (x @ y.T)
        at = min(k, len(y)) - 1
        limit = np.partition(rough, at, axis=1)[:, at : at + 1]
        row, hit = np.nonzero(rough <= limit + SLACK * (1 + size) + 2 * 10.0**-DECIMALS)
        d = np.round(((x[row] - y[hit]) ** 2).sum(axis=1), DECIMALS)
        ids = every[hit]
        order = np.lexsort((ids, d, row))
        row, ids, d = row[order], ids[order], d[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        return pd.DataFrame({"id": asked[row[first]], "neighbour_id": ids[first], "distance": d[first]})

    keys = ["cell", "block", "cut"]
    candidates = (
        left.select("id", "features", *keys)
        .groupBy(*keys)
        .cogroup(right.select("id", "features", *keys).groupBy(*keys))
        .applyInPandas(nearest, "id long, neighbour_id long, distance double")
    )
    best = Window.partitionBy("id").orderBy("distance", "neighbour_id")
    return candidates.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def vote(found: DataFrame, labels: DataFrame) -> DataFrame:
    """``id, prediction``: commonest label of the neighbours, the lowest one on a tie."""
    named = found.join(labels.select(F.col("id").alias("neighbour_id"), "label"), "neighbour_id")
    counts = named.groupBy("id", "label").agg(F.count("*").alias("n"))
    best = F.max_by("label", F.struct(F.col("n"), -F.col("label")))
    return counts.groupBy("id").agg(best.alias("prediction"))


class NearestNeighbours(Estimator):
    """Estimator over ``id``, ``features`` (vector) and ``label``; fitting keeps the training rows."""

    def __init__(self, k: int = 5):
        super().__init__()
        self.k = k

    def _fit(self, dataset: DataFrame) -> NearestNeighboursModel:
        return NearestNeighboursModel(dataset, self.k)


class NearestNeighboursModel(Model):
    def __init__(self, train: DataFrame, k: int):
        super().__init__()
        self.train, self.k = train, k

    def _transform(self, dataset: DataFrame) -> DataFrame:
        def arrays(df: DataFrame) -> DataFrame:
            return df.select("id", vector_to_array("features").alias("features"))

        found = neighbours(arrays(dataset), arrays(self.train), self.k)
        votes = vote(found, self.train.select("id", F.col("label").cast("int").alias("label")))
        return dataset.join(votes.withColumn("prediction", F.col("prediction").cast("double")), "id")
