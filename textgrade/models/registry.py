"""The classifiers that are compared, by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.ml import Estimator
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, NaiveBayes

from textgrade.fixed_values import SEED
from textgrade.models.kernel import KernelMachine
from textgrade.models.knn import NearestNeighbours
from textgrade.models.lda import LinearDiscriminant
from textgrade.models.trees import BOOSTED, BOOSTED_FOREST, FOREST, TreeEnsemble


def boosted_trees(rounds: int = 100, depth: int = 6, seed: int = SEED) -> Estimator:
    """Gradient boosting of a softmax over all classes, a tree a class and round."""
    return TreeEnsemble(replace(BOOSTED, rounds=rounds, depth=depth, seed=seed))


def forest(trees: int = 100, depth: int = 40, seed: int = SEED) -> Estimator:
    """Forest of bootstrapped trees that see the square root of the features a node."""
    return TreeEnsemble(replace(FOREST, members=trees, depth=depth, seed=seed))


def boosted_forest(trees: int = 100, depth: int = 6, seed: int = SEED) -> Estimator:
    """One round of parallel trees a class, on 80 % of the rows and 80 % of the features a node."""
    return TreeEnsemble(replace(BOOSTED_FOREST, members=trees, depth=depth, seed=seed))


MODELS: dict[str, Callable[[], Estimator]] = {
    "LR": lambda: LogisticRegression(family="multinomial", maxIter=50),
    "LDA": LinearDiscriminant,
    "KNN": NearestNeighbours,
    "CART": lambda: DecisionTreeClassifier(seed=SEED),
    "NB": lambda: NaiveBayes(modelType="gaussian"),
    "SVM": KernelMachine,
    "RF": forest,
    "XGB": boosted_trees,
    "XGBRF": boosted_forest,
}
FOLD_MODELS = ("LDA", "RF", "XGB", "XGBRF")
