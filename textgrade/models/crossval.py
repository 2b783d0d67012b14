"""Assembling vectors, training, and cross-validation into long prediction tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Estimator
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgrade.models import lda
from textgrade.models.moments import class_moments, column_means, moment_matrices, without_fold
from textgrade.models.scoring import score_batches
from textgrade.models.trees import Fit, TreeEnsemble, bin_rows, hold_out, run_fits
from textgrade.session import materialize

PREDICTION_COLUMNS = ("model", "fold", "id", "label", "prediction")
THREADS = 4


def assemble(
    df: DataFrame, features: Sequence[str], drop_features: Sequence[str] = (), impute: bool = True
) -> DataFrame:
    """``features`` as one vector of named columns.

    Undefined values take the column's mean, or with ``impute`` off their rows are left out.
    """
    names = [f for f in features if f not in drop_features]
    if impute:
        df = Imputer(inputCols=names, outputCols=names).fit(df).transform(df)
    return VectorAssembler(inputCols=names, outputCol="features", handleInvalid="error" if impute else "skip").transform(df)


def from_array(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(column).cast("array<double>")))


def train_model(model: Estimator, train: DataFrame, validation: DataFrame, name: str, fold: int) -> DataFrame:
    """Fit and predict: ``model, fold, id, label, prediction``."""
    # rows without a label or prediction cannot be scored, and one class alone cannot be learnt
    predicted = hold_out(model.spec, train, validation) if isinstance(model, TreeEnsemble) else model.fit(train).transform(validation)
    return predicted.select(
        F.lit(name).alias("model"),
        F.lit(fold).cast("int").alias("fold"),
        "id",
        F.col("label").cast("int").alias("label"),
        F.col("prediction").cast("int").alias("prediction"),
    )


def cross_validate(
    df: DataFrame,
    models: Mapping[str, Callable[[], Estimator]],
    test_fold: int | None = None,
    evaluate_holdout: bool = False,
    threads: int = THREADS,
) -> DataFrame:
    """Predictions of every model for every validation fold.

    ``df`` has ``id, features, label, fold``. Rows of ``test_fold`` are kept out of training and
    validation; ``evaluate_holdout`` adds them, scored by models of all other rows. The input is
    computed once; tree ensembles grow together, other fits run side by side from a small driver pool.
    """
    data = materialize(df.select("id", "features", F.col("label").cast("double").alias("label"), "fold"))
    open_rows = data if test_fold is None else data.where(F.col("fold") != test_fold)
    folds = [r["fold"] for r in open_rows.select("fold").distinct().orderBy("fold").collect()]
    if evaluate_holdout and test_fold is not None:
        folds.append(test_fold)
    jobs = [(name, f) for f in folds for name in models]
    made = {name: models[name]() for name in models}
    grown = [(name, f) for name, f in jobs if isinstance(made[name], TreeEnsemble)]
    parts = [_grow(data, made, grown, test_fold)] if grown else []

    def run(job: tuple[str, int]) -> DataFrame:
        name, fold = job
        return train_model(models[name](), open_rows.where(F.col("fold") != fold), data.where(F.col("fold") == fold), name, fold)

    with ThreadPoolExecutor(threads) as pool:
        parts += pool.map(run, [j for j in jobs if j not in grown])
    return reduce(DataFrame.unionByName, parts)


def _grow(data: DataFrame, made: Mapping[str, TreeEnsemble], jobs: Sequence[tuple[str, int]], test_fold: int | None) -> DataFrame:
    """The tree ensembles of all folds and models in one batch."""
    binned = bin_rows(data)
    apart = () if test_fold is None else (test_fold,)
    every = tuple(range(len(binned.edges)))
    fits = [Fit(made[name].spec, every, fold, apart) for name, fold in jobs]
    numbers = data.sparkSession.createDataFrame([(i, name, int(fold)) for i, (name, fold) in enumerate(jobs)], "fit int, model string, fold int")
    return run_fits(binned, fits).join(F.broadcast(numbers), "fit").select(*PREDICTION_COLUMNS)


def lda_cross_predict(df: DataFrame, fold: str = "fold", vector: str = "features") -> DataFrame:
    """LDA predictions of each row by the model of all other folds, from one aggregation."""
    centre = column_means(df, vector)
    matrices = moment_matrices(class_moments(df, [fold, "label"], vector, centre=centre), [fold, "label"])
    models = {f: lda.solve(without_fold(matrices, f), centre=centre) for f in sorted({k[0] for k in matrices})}
    return score_batches(df, models, fold, vector)
