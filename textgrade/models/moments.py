"""Class moments: counts, sums and products of feature vectors, summed per task, then per key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def column_means(df: DataFrame, vector: str = "features") -> np.ndarray:
    """Mean of every feature, to centre moments by: sums of raw squares lose small variances of large values."""
    values = df.select(F.posexplode(F.col(vector).cast("array<double>")).alias("at", "value"))
    rows = values.groupBy("at").agg(F.avg("value").alias("mean")).orderBy("at").collect()
    return np.array([r["mean"] for r in rows])


def class_moments(
    df: DataFrame, by: Sequence[str], vector: str = "features", full: bool = True, centre: np.ndarray | None = None
) -> DataFrame:
    """Rows ``by, i, j, value`` with sums of ``x_i * x_j``, where ``x_0`` is 1 for every row.

    With ``centre`` the features are taken less these values.

    ``(0, 0)`` is therefore the count and ``(0, i)`` the sum of feature i. With ``full`` all pairs
    ``i <= j`` are given, else only squares. Every task sends one small matrix per key; the size of
    the result depends on keys and features, not on rows.
    """
    keys = list(by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if batch.empty:
                continue
            x = np.stack(batch["_x"].to_numpy()).astype(np.float64)
            x = x if centre is None else x - centre
            x = np.hstack([np.ones((len(x), 1)), x])
            for key, rows in batch.groupby(keys).indices.items():
                part = x[rows]
                m = part.T @ part
                key = key if isinstance(key, tuple) else (key,)
                sums[key] = sums[key] + m if key in sums else m
        for key, m in sums.items():
            if full:
                i, j = np.triu_indices(len(m))
            else:
                d = np.arange(1, len(m))
                i, j = np.concatenate([np.zeros(len(m), int), d]), np.concatenate([np.arange(len(m)), d])
            frame = pd.DataFrame({k: [v] * len(i) for k, v in zip(keys, key)})
            frame["i"], frame["j"], frame["value"] = i.astype(np.int32), j.astype(np.int32), m[i, j]
            yield frame

    fields = [df.schema[k] for k in keys]
    schema = T.StructType(
        [T.StructField(f.name, f.dataType) for f in fields]
        + [T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("value", T.DoubleType())]
    )
    parts = df.select(*keys, F.col(vector).cast("array<double>").alias("_x")).mapInPandas(run, schema)
    return parts.groupBy(*keys, "i", "j").agg(F.sum("value").alias("value"))


def moment_matrices(moments: DataFrame, by: Sequence[str]) -> dict[tuple, np.ndarray]:
    """Moments as one symmetric matrix per key on the driver: (features + 1) squared numbers each."""
    rows = moments.toPandas()
    size = int(rows["j"].max()) + 1
    matrices: dict[tuple, np.ndarray] = {}
    for key, part in rows.groupby(list(by)):
        m = np.zeros((size, size))
        m[part["i"], part["j"]] = part["value"]
        m[part["j"], part["i"]] = part["value"]
        matrices[key if isinstance(key, tuple) else (key,)] = m
    return matrices


def without_fold(matrices: dict[tuple, np.ndarray], fold: object) -> dict[object, np.ndarray]:
    """Moments per label of all folds but one: the total less the fold."""
    result: dict[object, np.ndarray] = {}
    for (f, label), m in matrices.items():
        if f != fold:
            result[label] = result[label] + m if label in result else m.copy()
    return result
