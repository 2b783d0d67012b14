"""Gaussian naive Bayes from class moments, for one training set or all folds at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from textgrade.models.moments import class_moments, column_means, moment_matrices, without_fold
from textgrade.models.scoring import score_batches

SMOOTHING = 1e-9  # of the largest feature variance


@dataclass
class GaussianBayes:
    classes: list
    means: np.ndarray
    variances: np.ndarray
    log_priors: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        columns = []
        for mu, var, prior in zip(self.means, self.variances, self.log_priors):
            columns.append(prior - 0.5 * np.log(2 * np.pi * var).sum() - 0.5 * ((x - mu) ** 2 / var).sum(axis=1))
        return np.column_stack(columns)


def solve(matrices: dict[object, np.ndarray], centre: np.ndarray | float = 0.0) -> GaussianBayes:
    """Model from the classes' moments, which were taken less ``centre``."""
    classes = sorted(matrices)
    counts = np.array([matrices[c][0, 0] for c in classes])
    sums = np.array([matrices[c][0, 1:] for c in classes])
    squares = np.array([np.diag(matrices[c])[1:] for c in classes])
    means = sums / counts[:, None]
    overall = squares.sum(axis=0) / counts.sum() - (sums.sum(axis=0) / counts.sum()) ** 2
    variances = squares / counts[:, None] - means**2 + SMOOTHING * overall.max()
    return GaussianBayes(classes, means + centre, variances, np.log(counts / counts.sum()))


def fit(train: DataFrame, vector: str = "features") -> GaussianBayes:
    centre = column_means(train, vector)
    moments = class_moments(train, ["label"], vector, full=False, centre=centre)
    return solve({k[0]: m for k, m in moment_matrices(moments, ["label"]).items()}, centre)


def cross_predict(df: DataFrame, fold: str = "fold", vector: str = "features") -> DataFrame:
    """Each row predicted by the model of all other folds; one aggregation serves every fold."""
    centre = column_means(df, vector)
    matrices = moment_matrices(class_moments(df, [fold, "label"], vector, full=False, centre=centre), [fold, "label"])
    models = {f: solve(without_fold(matrices, f), centre) for f in sorted({k[0] for k in matrices})}
    return score_batches(df, models, fold, vector)
