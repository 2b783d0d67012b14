"""Support vector machine with a radial basis kernel, a machine for each pair of classes.

The kernel is taken at landmarks (Nystroem): with ``L`` landmarks, ``phi(x) = k(x, L) k(L, L)^(-1/2)``. With all
different rows as landmarks this is the kernel itself; where there are more rows than ``landmarks``, the centres of
Spark's k-means stand for them. In these coordinates every pair of classes is a linear machine with the hinge loss.

It is solved by Newton steps on the softplus ``h log(1 + exp(z / h))``, a hinge rounded off over a width ``h`` that
shrinks. One pass over the rows adds up gradient, curvature, the loss for every step length tried and, since the
slope of the rounded hinge is a feasible dual point, both sides of the duality gap of the true hinge; fitting ends
when the gap is below ``gap`` of the objective. All pairs share the pass. Nothing is kept per row between passes, so
a lost executor costs its part of one pass; the driver holds (landmarks + 1)^2 numbers a pair, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgrade.fixed_values import SEED
from textgrade.session import materialize

LANDMARKS = 256
GAP = 1e-3
PASSES = 200  # Newton passes at most; the gap reached is in the model
STEPS = 2.0 ** -np.arange(17)
_FIRST_WIDTH, _SHRINK = 1.0, 0.25
_OPEN = 0.3  # a width is left when at most this share of the gap is not due to the rounding
_BLOCK = 64  # rows of a curvature matrix that travel together
_HEAD = len(STEPS) + 2  # losses by step, true hinge, sum of the dual point


@dataclass(frozen=True)
class Basis:
    """Landmarks and the map from kernel values at them to coordinates; the last coordinate is the constant 1."""

    points: np.ndarray
    turn: np.ndarray
    gamma: float

    def kernel(self, x: np.ndarray) -> np.ndarray:
        square = (x**2).sum(axis=1)[:, None] + (self.points**2).sum(axis=1)[None, :] - 2 * (x @ self.points.T)
        return np.exp(-self.gamma * np.maximum(square, 0))

    def coordinates(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([self.kernel(x) @ self.turn, np.ones(len(x))])


def make_basis(points: np.ndarray, gamma: float) -> Basis:
    raw = Basis(points, np.empty((0, 0)), gamma)
    values, vectors = np.linalg.eigh(raw.kernel(points))
    used = values > 1e-10 * values.max()
    return Basis(points, vectors[:, used] / np.sqrt(values[used]), gamma)


def scale_gamma(rows: DataFrame) -> float:
    """One over number of features times variance of all their values; 1 where all values are equal."""
    size, mean = F.size("x"), F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / F.size("x")
    square = F.aggregate(F.transform("x", lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda a, v: a + v)
    found = rows.select(size.alias("d"), mean.alias("mean"), (square / size).alias("within")).agg(
        F.max("d").alias("d"), (F.var_pop("mean") + F.avg("within")).alias("variance")
    ).first()
    return 1.0 / (found["d"] * found["variance"]) if found["variance"] else 1.0


def choose_landmarks(rows: DataFrame, landmarks: int, seed: int = SEED) -> np.ndarray:
    """All different rows where there are at most ``landmarks``, or else as many k-means centres."""
    few = rows.select("x").distinct().limit(landmarks + 1).toPandas()["x"]
    if len(few) <= landmarks:
        return np.array(sorted(map(tuple, few)), dtype=np.float64)
    vectors = rows.select(F.col("features"))
    return np.array(KMeans(k=landmarks, seed=seed, maxIter=10).fit(vectors).clusterCenters(), dtype=np.float64)


def _rounded_hinge(z: np.ndarray, h: float) -> np.ndarray:
    return np.maximum(z, 0) + h * np.log1p(np.exp(-np.abs(z) / h))


def _slope(z: np.ndarray, h: float) -> np.ndarray:
    away = np.exp(-np.abs(z) / h)
    return np.where(z > 0, 1.0, away) / (1 + away)


def add_up(
    batches: Iterator[pd.DataFrame], basis: Basis, pairs: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, float]]
) -> Iterator[pd.DataFrame]:
    """One task's sums a pair ``(weights, direction, width)``: head and gradient in block -1, then curvature in blocks."""
    size = basis.turn.shape[1] + 1
    heads = {p: np.zeros(_HEAD + size) for p in pairs}
    curves = {p: np.zeros((size, size)) for p in pairs}
    for batch in batches:
        if batch.empty:
            continue
        phi, label = basis.coordinates(np.stack(batch["x"].to_numpy())), batch["label"].to_numpy()
        for (a, b), (weights, direction, h) in pairs.items():
            mine = (label == a) | (label == b)
            if not mine.any():
                continue
            x, y = phi[mine], np.where(label[mine] == a, 1.0, -1.0)
            z, change = 1 - y * (x @ (weights + direction)), y * (x @ direction)
            slope = _slope(z, h)
            head = heads[a, b]
            # at step t the distance to the margin is z + (1 - t) * change
            head[: len(STEPS)] += [_rounded_hinge(z + (1 - t) * change, h).sum() for t in STEPS]
            head[len(STEPS)] += np.maximum(z, 0).sum()
            head[len(STEPS) + 1] += slope.sum()
            head[_HEAD:] += x.T @ (y * slope)
            curves[a, b] += x.T @ (x * (slope * (1 - slope))[:, None])
    for (a, b), head in heads.items():
        blocks = [head] + [curves[a, b][i : i + _BLOCK].ravel() for i in range(0, size, _BLOCK)]
        yield pd.DataFrame({"a": a, "b": b, "block": range(-1, len(blocks) - 1), "sums": blocks})


def _sum_blocks(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"a": [key[0]], "b": [key[1]], "block": [key[2]], "sums": [np.sum(np.stack(parts["sums"].to_numpy()), axis=0)]})


@dataclass
class PairFit:
    """State of one pair on the driver: accepted weights, the step under trial, and the width of the hinge."""

    weights: np.ndarray
    direction: np.ndarray
    width: float = _FIRST_WIDTH
    loss: float | None = None  # rounded objective at the accepted weights
    descent: float = 0.0  # slope of the objective along the direction
    gap: float = np.inf
    done: bool = False

    def advance(self, head: np.ndarray, curve: np.ndarray, c: float, gap: float) -> None:
        """Take the longest step that lowers the objective enough, or the next Newton step, or a narrower hinge."""
        trial = self.weights + self.direction
        if self.loss is not None:
            losses = [0.5 * ((self.weights + t * self.direction)[:-1] ** 2).sum() + c * head[i] for i, t in enumerate(STEPS)]
            fit = [i for i, t in enumerate(STEPS) if losses[i] <= self.loss + 1e-4 * t * self.descent + 1e-12 * self.loss]
            if not fit:  # no step helps any more: the sums are exact to rounding
                self.direction = np.zeros_like(trial)
                self._narrow()
                return
            if fit[0] > 0:  # sums of the shorter step come with the next pass
                self.weights, self.loss = self.weights + STEPS[fit[0]] * self.direction, None
                self.direction = np.zeros_like(trial)
                return
        self.weights, self.loss = trial, 0.5 * (trial[:-1] ** 2).sum() + c * head[0]
        hinge, dual, pull = c * head[len(STEPS)], c * head[len(STEPS) + 1], c * head[_HEAD:]
        primal = 0.5 * (trial[:-1] ** 2).sum() + hinge
        # a dual point out of balance by pull[-1] is off by at most that much times the constant
        bound = dual - 0.5 * (pull[:-1] ** 2).sum() - abs(pull[-1]) * max(1.0, abs(trial[-1]))
        self.gap = (primal - bound) / max(primal, 1e-12)
        if self.gap <= gap:
            self.done, self.direction = True, np.zeros_like(trial)
            return
        slope = np.append(trial[:-1], 0.0) - pull
        bend = curve * (c / self.width)
        bend[np.diag_indices(len(bend) - 1)] += 1.0
        bend[-1, -1] += 1e-12 * np.trace(bend)
        self.direction = -np.linalg.solve(bend, slope)
        self.descent = float(slope @ self.direction)
        unsettled = 0.5 * (slope[:-1] ** 2).sum() + abs(pull[-1]) * max(1.0, abs(trial[-1]))
        if unsettled <= _OPEN * (primal - bound):
            self.direction = np.zeros_like(trial)
            self._narrow()

    def _narrow(self) -> None:
        self.width, self.loss = self.width * _SHRINK, None
        self.done = self.width < 1e-7


class KernelMachine(Estimator):
    """Estimator over ``features`` (vector) and ``label`` (whole numbers); needs two classes at least."""

    def __init__(self, c: float = 1.0, gamma: float | None = None, landmarks: int = LANDMARKS, gap: float = GAP, seed: int = SEED):
        super().__init__()
        self.c, self.gamma, self.landmarks, self.gap, self.seed = c, gamma, landmarks, gap, seed

    def _fit(self, dataset: DataFrame) -> KernelMachineModel:
        rows = materialize(
            dataset.where("label IS NOT NULL").select("features", vector_to_array("features").alias("x"), F.col("label").cast("int").alias("label"))
        )
        labels = sorted(r["label"] for r in rows.select("label").distinct().collect())
        if len(labels) < 2:
            raise ValueError("a kernel machine needs rows of two classes")
        gamma = scale_gamma(rows) if self.gamma is None else self.gamma
        basis = make_basis(choose_landmarks(rows, self.landmarks, self.seed), gamma)
        size = basis.turn.shape[1] + 1
        fits = {pair: PairFit(np.zeros(size), np.zeros(size)) for pair in combinations(labels, 2)}
        for _ in range(PASSES):
            pending = {pair: (f.weights, f.direction, f.width) for pair, f in fits.items() if not f.done}
            if not pending:
                break
            for pair, (head, curve) in self._sums(rows, basis, pending).items():
                fits[pair].advance(head, curve, self.c, self.gap)
        return KernelMachineModel(basis, {p: f.weights for p, f in fits.items()}, {p: float(f.gap) for p, f in fits.items()})

    @staticmethod
    def _sums(rows: DataFrame, basis: Basis, pending: dict) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        schema = "a int, b int, block int, sums array<double>"
        parts = rows.select("x", "label").mapInPandas(lambda batches: add_up(batches, basis, pending), schema)
        found = parts.groupBy("a", "b", "block").applyInPandas(_sum_blocks, schema).toPandas().sort_values("block")
        size = basis.turn.shape[1] + 1
        return {
            pair: (np.asarray(mine["sums"].iloc[0], np.float64), np.concatenate(mine["sums"].iloc[1:].to_list()).reshape(size, size))
            for pair, mine in found.groupby(["a", "b"])
        }


class KernelMachineModel(Model):
    """``weights`` and relative duality ``gaps`` by pair of classes; a row gets the class with most pairs, the lowest on a tie."""

    def __init__(self, basis: Basis, weights: dict[tuple[int, int], np.ndarray], gaps: dict[tuple[int, int], float]):
        super().__init__()
        self.basis, self.weights, self.gaps = basis, weights, gaps

    def decisions(self, x: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        phi = self.basis.coordinates(x)
        return {pair: phi @ w for pair, w in self.weights.items()}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        labels = sorted({c for pair in self.weights for c in pair})
        decisions = self.decisions

        @F.pandas_udf("double")
        def predicted(xs: pd.Series) -> pd.Series:
            if xs.empty:
                return pd.Series([], dtype="float64")
            votes = np.zeros((len(xs), len(labels)))
            for (a, b), value in decisions(np.stack(xs.to_numpy())).items():
                votes[:, labels.index(a)] += value > 0
                votes[:, labels.index(b)] += value <= 0
            return pd.Series(np.array(labels, dtype=np.float64)[votes.argmax(axis=1)])

        return dataset.withColumn("prediction", predicted(vector_to_array("features")))
