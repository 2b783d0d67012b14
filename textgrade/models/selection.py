"""Feature importance, recursive elimination and forward curves."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import OneVsRestModel
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textgrade.models import lda
from textgrade.models.crossval import THREADS, train_model
from textgrade.models.moments import class_moments, column_means, moment_matrices, without_fold
from textgrade.models.trees import Fit, TreeEnsemble, TreeEnsembleModel, bin_rows, run_fits, run_importances
from textgrade.operators.metrics import CLASSES, mean_weighted_f1, weighted_scores
from textgrade.session import materialize


def importances(model) -> np.ndarray:
    """Importance per feature of a fitted model; of one-against-rest models, the mean."""
    if isinstance(model, PipelineModel):
        return importances(model.stages[-1])
    if isinstance(model, OneVsRestModel):
        return np.mean([importances(m) for m in model.models], axis=0)
    if isinstance(model, lda.LinearDiscriminantModel):
        return model.discriminant.importance()
    if isinstance(model, TreeEnsembleModel):
        return model.importance()
    return model.featureImportances.toArray()


def feature_importance(df: DataFrame, models: Mapping[str, Callable[[], Estimator]], names: Sequence[str]) -> DataFrame:
    """``model, feat, importance, place``: features by falling importance."""
    data = materialize(df.select("features", F.col("label").cast("double").alias("label")))
    made = {m: models[m]() for m in models}
    trees = [m for m in models if isinstance(made[m], TreeEnsemble)]
    fitted: dict[str, np.ndarray] = {}
    if trees:  # grown together over rows binned once; only importances reach the driver
        found = run_importances(bin_rows(data), [Fit(made[m].spec, tuple(range(len(names)))) for m in trees]).collect()
        for i, m in enumerate(trees):
            values = np.zeros(len(names))
            for r in found:
                if r["fit"] == i:
                    values[r["feature"]] = r["importance"]
            fitted[m] = values / values.sum() if values.sum() > 0 else values
    others = [m for m in models if m not in trees]
    with ThreadPoolExecutor(THREADS) as pool:
        fitted |= zip(others, pool.map(lambda m: importances(made[m].fit(data)), others))
    rows = [(m, f, float(v)) for m in models for f, v in zip(names, fitted[m])]
    table = df.sparkSession.createDataFrame(rows, "model string, feat string, importance double")
    return table.withColumn("place", F.row_number().over(Window.partitionBy("model").orderBy(F.desc("importance"), "feat")))


class _Elimination:
    """Features still in play for one model, and those dropped round by round."""

    def __init__(self, names: Sequence[str], step: int):
        self.names, self.step, self.left, self.rounds = names, step, list(range(len(names))), []

    def drop(self, weights: Sequence[float]) -> None:
        """Drop the lightest features; ``weights`` are those of ``left``, equal ones go by name."""
        order = sorted(range(len(self.left)), key=lambda i: (weights[i], self.names[self.left[i]]))
        dropped = [self.left[i] for i in order[: min(self.step, len(self.left) - 1)]]
        self.rounds.append(dropped)
        self.left = [f for f in self.left if f not in dropped]

    def ranks(self) -> list[int]:
        """1 for the last one left, one more per round for those dropped before."""
        ranks = [1] * len(self.names)
        for distance, dropped in enumerate(reversed(self.rounds)):
            for f in dropped:
                ranks[f] = distance + 2
        return ranks


def rfe_ranks(
    df: DataFrame, models: Mapping[str, Callable[[], Estimator]], names: Sequence[str], step: int | Mapping[str, int] = 1
) -> DataFrame:
    """Recursive elimination, ``model, feat, rank``; ``step`` features go per round.

    LDA needs one aggregation for all rounds, since the moments of fewer features are a part of those
    of all. Tree ensembles are binned once and each round grows those of all models together. Other
    models are fitted anew on slices of the vectors, which are computed once.
    """
    data = materialize(df.select("features", F.col("label").cast("double").alias("label")))
    made = {name: models[name]() for name in models}
    trees = [name for name in made if isinstance(made[name], TreeEnsemble)]
    runs = {name: _Elimination(names, step if isinstance(step, int) else step.get(name, 1)) for name in models}

    def grow() -> None:
        binned = bin_rows(df)
        while going := [name for name in trees if len(runs[name].left) > 1]:
            fits = [Fit(made[name].spec, tuple(runs[name].left)) for name in going]
            found = {(r["fit"], r["feature"]): r["importance"] for r in run_importances(binned, fits).collect()}
            for i, name in enumerate(going):
                runs[name].drop([found[(i, f)] for f in runs[name].left])

    def run(name: str) -> None:
        if isinstance(made[name], lda.LinearDiscriminant):
            rows = data.select(F.col("label").cast("int").alias("label"), vector_to_array("features").alias("features"))
            centre = column_means(rows)
            moments = {k[0]: m for k, m in moment_matrices(class_moments(rows, ["label"], centre=centre), ["label"]).items()}

            def weigh(left: list[int]) -> np.ndarray:
                return lda.solve(moments, left, centre).importance()
        else:

            def weigh(left: list[int]) -> np.ndarray:
                slicer = VectorSlicer(inputCol="_all", outputCol="features", indices=left)
                return importances(models[name]().fit(slicer.transform(data.withColumnRenamed("features", "_all"))))

        while len(runs[name].left) > 1:
            runs[name].drop(weigh(runs[name].left))

    with ThreadPoolExecutor(THREADS) as pool:
        jobs = [pool.submit(grow)] if trees else []
        jobs += [pool.submit(run, name) for name in models if name not in trees]
        for job in jobs:
            job.result()
    rows = [(m, f, int(r)) for m in models for f, r in zip(names, runs[m].ranks())]
    return df.sparkSession.createDataFrame(rows, "model string, feat string, rank int")


def rank_table(ranks: DataFrame, models: Sequence[str]) -> DataFrame:
    """Feature by model."""
    return ranks.groupBy("feat").pivot("model", list(models)).agg(F.first("rank"))


def sorted_features(ranks: DataFrame, models: Sequence[str]) -> DataFrame:
    """Names by rank, then name, one column per model, with an explicit ``place``."""
    placed = ranks.withColumn("place", F.row_number().over(Window.partitionBy("model").orderBy("rank", "feat")))
    return placed.groupBy("place").pivot("model", list(models)).agg(F.first("feat"))


def top_features(ranks: DataFrame, model: str, n: int) -> list[str]:
    """The n best features of a model, by rank and name."""
    rows = ranks.where(F.col("model") == model).orderBy("rank", "feat").limit(n).collect()
    return [r["feat"] for r in rows]


def lda_curve_counts(df: DataFrame, order: Sequence[int], sizes: Sequence[int]) -> DataFrame:
    """``n_features, fold, label, prediction, n`` of LDA with the top features, for all sizes at once.

    One aggregation gives the moments of every fold, one scoring pass counts the outcomes of all
    models inside each task.
    """
    centre = column_means(df)
    moments = moment_matrices(class_moments(df, ["fold", "label"], centre=centre), ["fold", "label"])
    folds = sorted({k[0] for k in moments})
    solved = {(n, f): lda.solve(without_fold(moments, f), list(order[:n]), centre) for n in sizes for f in folds}
    at = {n: np.asarray(order[:n]) for n in sizes}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for fold, part in batch.groupby("fold"):
                x = np.stack(part["features"].to_numpy()).astype(np.float64)
                for n in sizes:
                    model = solved[(n, fold)]
                    guess = np.asarray(model.classes)[model.scores(x[:, at[n]]).argmax(axis=1)]
                    cells = pd.DataFrame({"label": part["label"].to_numpy(), "prediction": guess})
                    counted = cells.groupby(["label", "prediction"]).size().reset_index(name="n")
                    yield counted.assign(n_features=n, fold=fold)[["n_features", "fold", "label", "prediction", "n"]]

    cells = df.select("fold", "label", "features").mapInPandas(
        run, "n_features int, fold int, label int, prediction int, n long"
    )
    return cells.groupBy("n_features", "fold", "label", "prediction").agg(F.sum("n").alias("n"))


def forward_curve(
    df: DataFrame,
    models: Mapping[str, Callable[[], Estimator]],
    names: Sequence[str],
    ranked: Mapping[str, Sequence[str]],
    sizes: Sequence[int] | None = None,
    labels: Sequence[int] = CLASSES,
) -> DataFrame:
    """Mean weighted F1 over folds with the best 1, 2, … features: ``model, n_features, f1``.

    ``ranked`` gives each model's features in order; ``sizes`` defaults to every number of features.
    ``df`` has ``id, features, label, fold``, without the test fold.
    """
    sizes = list(sizes or range(1, len(names) + 1))
    data = materialize(df.select("id", "features", F.col("label").cast("double").alias("label"), "fold"))
    folds = [r["fold"] for r in data.select("fold").distinct().orderBy("fold").collect()]
    spot = {name: i for i, name in enumerate(names)}
    parts: list[DataFrame] = []
    for name in models:
        if models[name] is lda.LinearDiscriminant:
            rows = data.select("fold", F.col("label").cast("int").alias("label"), vector_to_array("features").alias("features"))
            counts = lda_curve_counts(rows, [spot[f] for f in ranked[name]], sizes)
            scores = weighted_scores(counts, ["n_features", "fold"], labels, weight="n")
            parts.append(mean_weighted_f1(scores, ["n_features"]).withColumn("model", F.lit(name)))
    made = {name: models[name]() for name in models}
    grown = [(m, n, f) for m in models if isinstance(made[m], TreeEnsemble) for n in sizes for f in folds]
    if grown:  # all models, sizes and folds grow together
        binned = bin_rows(data)
        fits = [Fit(made[m].spec, tuple(sorted(spot[x] for x in ranked[m][:n])), f) for m, n, f in grown]
        numbers = df.sparkSession.createDataFrame(
            [(i, m, n, int(f)) for i, (m, n, f) in enumerate(grown)], "fit int, model string, n_features int, fold int"
        )
        predicted = run_fits(binned, fits).groupBy("fit", "label", "prediction").agg(F.count("*").alias("n"))
        scores = weighted_scores(predicted.join(F.broadcast(numbers), "fit"), ["model", "n_features", "fold"], labels, weight="n")
        parts.append(mean_weighted_f1(scores, ["n_features", "model"]))
    alone = [m for m in models if models[m] is not lda.LinearDiscriminant and not isinstance(made[m], TreeEnsemble)]
    others = [(m, n, f) for m in alone for n in sizes for f in folds]

    def run(job: tuple[str, int, int]) -> DataFrame:
        name, n, fold = job
        slicer = VectorSlicer(inputCol="_all", outputCol="features", indices=[spot[f] for f in ranked[name][:n]])
        sliced = slicer.transform(data.withColumnRenamed("features", "_all"))
        predicted = train_model(models[name](), sliced.where(F.col("fold") != fold), sliced.where(F.col("fold") == fold), name, fold)
        return weighted_scores(predicted, ["model", "fold"], labels).withColumn("n_features", F.lit(n))

    if others:
        with ThreadPoolExecutor(THREADS) as pool:
            scored = list(pool.map(run, others))
        united = scored[0]
        for part in scored[1:]:
            united = united.unionByName(part)
        parts.append(mean_weighted_f1(united, ["n_features", "model"]))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.select("model", "n_features", "f1")


def curve_table(curve: DataFrame, models: Sequence[str]) -> DataFrame:
    """Curve with one column per model."""
    return curve.groupBy("n_features").pivot("model", list(models)).agg(F.first("f1"))
