"""Scoring of vectors in Arrow batches with small models held by every task."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Scorer(Protocol):
    classes: list

    def scores(self, x: np.ndarray) -> np.ndarray: ...


def score_batches(df: DataFrame, models: dict[object, Scorer], fold: str | None = None, vector: str = "features") -> DataFrame:
    """Add ``prediction``, the class with the highest score; with ``fold`` each row meets its fold's model."""
    is_vector = isinstance(df.schema[vector].dataType, VectorUDT)
    x = vector_to_array(vector) if is_vector else F.col(vector).cast("array<double>")
    fold_at = df.columns.index(fold) if fold else None

    @F.pandas_udf(T.DoubleType())
    def predict(xs: pd.Series, folds: pd.Series) -> pd.Series:
        matrix = np.stack(xs.to_numpy()).astype(np.float64)
        out = np.full(len(matrix), np.nan)
        for key, model in models.items():
            rows = np.ones(len(matrix), bool) if key is None else (folds == key).to_numpy()
            if rows.any():
                out[rows] = np.asarray(model.classes, dtype=np.float64)[model.scores(matrix[rows]).argmax(axis=1)]
        return pd.Series(out)

    key = F.lit(0) if fold_at is None else F.col(fold)
    return df.withColumn("prediction", predict(x, key))
