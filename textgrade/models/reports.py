"""Result tables by fold and by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgrade.operators.groups import fold_tuples
from textgrade.operators.metrics import CLASSES, class_scores, weighted_scores

SCORES = ("precision", "recall", "f1", "support", "accuracy")


def fold_result_table(
    predictions: DataFrame, folds: DataFrame, group_labels: DataFrame, group_titles: DataFrame,
    models: Sequence[str], labels: Sequence[int] = CLASSES,
) -> DataFrame:
    """One row per fold: its groups, label and title of the first, and five scores per model."""
    scores = weighted_scores(predictions, ["model", "fold"], labels)
    by_model = scores.groupBy("fold").pivot("model", list(models)).agg(*[F.first(s).alias(s) for s in SCORES])
    tuples = fold_tuples(folds, labels)
    first = F.coalesce(*[F.col(f"group_{l}") for l in labels])
    named = (
        tuples.withColumn("group", first)
        .join(group_labels, "group", "left")
        .join(group_titles, "group", "left")
        .withColumnRenamed("group", "first_group")
    )
    return named.join(by_model, "fold")


def group_result_table(
    predictions: DataFrame, folds: DataFrame, group_titles: DataFrame, models: Sequence[str],
    labels: Sequence[int] = (0, 1), zero_division: float | None = 0.0,
) -> DataFrame:
    """One row per fold and class with its group, title and per-class scores of every model.

    Scores meet their group by fold and label, so a class missing from a fold shifts nothing.
    """
    scores = class_scores(predictions, ["model", "fold"], labels, zero_division)
    wide = scores.groupBy("fold", "label").pivot("model", list(models)).agg(
        *[F.first(s).alias(s) for s in ("precision", "recall", "f1", "support")]
    )
    return folds.join(wide, ["fold", "label"]).join(group_titles, "group", "left")
