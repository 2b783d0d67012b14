"""Classification metrics over long prediction tables ``…, label, prediction``.

Undefined values follow ``zero_division``: None leaves them NULL and out of averages, 0 counts
them as zero.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASSES = (0, 1, 2)


def _stack(df: DataFrame, keys: Sequence[str], rows: Sequence[Column]) -> DataFrame:
    exploded = df.select(*keys, F.explode(F.array(*rows)).alias("_r"))
    return exploded.select(*keys, "_r.*")


def _total(condition: Column, weight: str | None) -> Column:
    """Rows that meet a condition; of counted rows, the sum of their counts."""
    if weight is None:
        return F.count_if(condition)
    return F.coalesce(F.sum(F.when(condition, F.col(weight))), F.lit(0).cast("long"))


def confusion(
    df: DataFrame, by: Sequence[str] = (), labels: Sequence[int] = CLASSES, weight: str | None = None
) -> DataFrame:
    """Confusion matrix per key with every label of the fixed set: ``by, label, pred_0, pred_1, …``."""
    cells = [
        _total((F.col("label") == a) & (F.col("prediction") == b), weight).alias(f"_{a}_{b}") for a in labels for b in labels
    ]
    rows = [F.struct(F.lit(a).alias("label"), *[F.col(f"_{a}_{b}").alias(f"pred_{b}") for b in labels]) for a in labels]
    return _stack(df.groupBy(*by).agg(*cells), by, rows)


def class_scores(
    df: DataFrame,
    by: Sequence[str] = (),
    labels: Sequence[int] = CLASSES,
    zero_division: float | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Precision, recall, F1 and support per class: one aggregation, whatever the number of keys.

    With ``weight`` each row stands for that many predictions.
    """
    counts = []
    for c in labels:
        truth, guess = F.col("label") == c, F.col("prediction") == c
        counts += [
            _total(truth & guess, weight).alias(f"_tp{c}"),
            _total(guess, weight).alias(f"_pred{c}"),
            _total(truth, weight).alias(f"_true{c}"),
        ]
    rows = [
        F.struct(
            F.lit(c).alias("label"), F.col(f"_tp{c}").alias("tp"), F.col(f"_pred{c}").alias("predicted"), F.col(f"_true{c}").alias("support")
        )
        for c in labels
    ]

    def share(top: Column, bottom: Column) -> Column:
        value = F.try_divide(top.cast("double"), bottom.cast("double"))
        return value if zero_division is None else F.coalesce(value, F.lit(float(zero_division)))

    return _stack(df.groupBy(*by).agg(*counts), by, rows).select(
        *by,
        "label",
        share(F.col("tp"), F.col("predicted")).alias("precision"),
        share(F.col("tp"), F.col("support")).alias("recall"),
        share(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"),
        "support",
        "predicted",
        "tp",
    )


def weighted_scores(
    df: DataFrame,
    by: Sequence[str] = (),
    labels: Sequence[int] = CLASSES,
    zero_division: float | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Support-weighted precision, recall, F1 and accuracy per key."""
    scores = class_scores(df, by, labels, zero_division, weight)

    def weighted(m: str) -> Column:
        defined = F.sum(F.when(F.col(m).isNotNull(), F.col("support")))
        return F.try_divide(F.sum(F.col(m) * F.col("support")), defined).alias(m)

    return scores.groupBy(*by).agg(
        weighted("precision"),
        weighted("recall"),
        weighted("f1"),
        F.sum("support").alias("support"),
        F.try_divide(F.sum("tp").cast("double"), F.sum("support")).alias("accuracy"),
    )


def macro_f1(df: DataFrame, by: Sequence[str] = (), labels: Sequence[int] = CLASSES) -> DataFrame:
    """Plain mean of F1 over the classes that occur as label or prediction."""
    scores = class_scores(df, by, labels, zero_division=0.0)
    occurring = scores.where((F.col("support") > 0) | (F.col("predicted") > 0))
    return occurring.groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def cv_summary(df: DataFrame, by: Sequence[str] = ("model",), fold: str = "fold", labels: Sequence[int] = CLASSES) -> DataFrame:
    """Mean and population deviation of macro F1 over folds."""
    return macro_f1(df, [*by, fold], labels).groupBy(*by).agg(
        F.avg("macro_f1").alias("mean"), F.stddev_pop("macro_f1").alias("std"), F.count("*").alias("n_folds")
    )


def classification_report(df: DataFrame, by: Sequence[str] = (), labels: Sequence[int] = CLASSES) -> DataFrame:
    """Rows per class, then accuracy, macro and weighted average; undefined values count as 0."""
    scores = class_scores(df, by, labels, zero_division=0.0)
    per_class = scores.select(*by, F.col("label").cast("string").alias("row"), "precision", "recall", "f1", "support")
    weight = F.col("support")

    def by_support(m: str) -> Column:
        return F.try_divide(F.sum(F.col(m) * weight), F.sum(weight))

    accuracy = F.try_divide(F.sum("tp").cast("double"), F.sum(weight))
    summary = scores.groupBy(*by).agg(
        *[F.avg(m).alias(f"_m_{m}") for m in ("precision", "recall", "f1")],
        *[by_support(m).alias(f"_w_{m}") for m in ("precision", "recall", "f1")],
        accuracy.alias("_acc"),
        F.sum(weight).alias("_n"),
    )
    none = F.lit(None).cast("double")

    def line(name: str, p: Column, r: Column, f: Column) -> Column:
        return F.struct(
            F.lit(name).alias("row"), p.alias("precision"), r.alias("recall"), f.alias("f1"), F.col("_n").alias("support")
        )

    rows = [
        line("accuracy", none, none, F.col("_acc")),
        line("macro avg", F.col("_m_precision"), F.col("_m_recall"), F.col("_m_f1")),
        line("weighted avg", F.col("_w_precision"), F.col("_w_recall"), F.col("_w_f1")),
    ]
    return per_class.unionByName(_stack(summary, by, rows))


def mean_weighted_f1(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean over folds of the weighted F1, folds without one skipped."""
    return scores.groupBy(*by).agg(F.avg(F.nanvl("f1", F.lit(None).cast("double"))).alias("f1"))


def mean_class_f1(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean of all per-class F1 values over all folds, undefined ones skipped."""
    return mean_weighted_f1(scores, by)


METRICS: dict[str, Callable[[DataFrame, Sequence[str], Sequence[int]], DataFrame]] = {
    "accuracy": lambda df, by, labels: weighted_scores(df, by, labels).select(*by, F.col("accuracy").alias("value")),
    "precision": lambda df, by, labels: weighted_scores(df, by, labels).select(*by, F.col("precision").alias("value")),
    "recall": lambda df, by, labels: weighted_scores(df, by, labels).select(*by, F.col("recall").alias("value")),
    "f1": lambda df, by, labels: weighted_scores(df, by, labels).select(*by, F.col("f1").alias("value")),
    "macro_f1": lambda df, by, labels: macro_f1(df, by, labels).select(*by, F.col("macro_f1").alias("value")),
}


def register_metric(name: str, fn: Callable[[DataFrame, Sequence[str], Sequence[int]], DataFrame]) -> None:
    """Add a metric: a function of predictions, keys and labels that returns ``keys, value``."""
    METRICS[name] = fn


def evaluate(
    df: DataFrame, metrics: Sequence[str], by: Sequence[str] = (), labels: Sequence[int] = CLASSES
) -> DataFrame:
    """The named metrics as long rows ``by, metric, value``."""
    parts = [METRICS[m](df, by, labels).select(*by, F.lit(m).alias("metric"), "value") for m in metrics]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
