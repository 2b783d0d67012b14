"""Linear discriminant analysis from class moments."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgrade.models.moments import class_moments, column_means, moment_matrices
from textgrade.models.scoring import score_batches

RANK_TOLERANCE = 1e-4


@dataclass
class Discriminant:
    """Scores are ``x @ coef.T + intercept``, one per class."""

    classes: list
    coef: np.ndarray
    intercept: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return x @ self.coef.T + self.intercept

    def importance(self) -> np.ndarray:
        """Sum over classes of squared coefficients; two classes share one difference vector."""
        coef = self.coef[1:] - self.coef[:1] if len(self.classes) == 2 else self.coef
        return (coef**2).sum(axis=0)


def solve(
    matrices: dict[object, np.ndarray], features: Sequence[int] | None = None, centre: np.ndarray | None = None
) -> Discriminant:
    """Discriminant of the classes' moments, over all or some features (0-based), taken less ``centre``."""
    classes = sorted(matrices)
    size = next(iter(matrices.values())).shape[0]
    at = np.arange(1, size) if features is None else np.asarray(features) + 1
    counts = np.array([matrices[c][0, 0] for c in classes])
    means = np.array([matrices[c][0, at] / matrices[c][0, 0] for c in classes])
    scatter = sum(matrices[c][np.ix_(at, at)] - n * np.outer(mu, mu) for c, n, mu in zip(classes, counts, means))
    total = counts.sum()
    priors, center = counts / total, counts @ means / total
    # within-class scatter of standardized features; directions without spread are dropped
    spread = np.sqrt(np.clip(np.diag(scatter), 0, None) / total)
    spread[spread == 0] = 1.0
    values, vectors = np.linalg.eigh(scatter / np.outer(spread, spread) / max(total - len(classes), 1))
    keep = values > RANK_TOLERANCE**2
    scaling = (vectors[:, keep] / np.sqrt(values[keep])) / spread[:, None]
    offsets = (means - center) @ scaling
    coef = offsets @ scaling.T
    intercept = np.log(priors) - 0.5 * (offsets**2).sum(axis=1) - coef @ center
    if centre is not None:
        intercept = intercept - coef @ centre[at - 1]
    return Discriminant(classes, coef, intercept)


class LinearDiscriminant(Estimator):
    """Estimator over ``features`` (vector) and ``label``; one aggregation, then a small solve."""

    def _fit(self, dataset: DataFrame) -> LinearDiscriminantModel:
        rows = dataset.select(F.col("label").cast("int").alias("label"), vector_to_array("features").alias("features"))
        centre = column_means(rows)
        moments = moment_matrices(class_moments(rows, ["label"], centre=centre), ["label"])
        return LinearDiscriminantModel(solve({k[0]: m for k, m in moments.items()}, centre=centre))


class LinearDiscriminantModel(Model):
    def __init__(self, discriminant: Discriminant):
        super().__init__()
        self.discriminant = discriminant

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return score_batches(dataset, {None: self.discriminant})
