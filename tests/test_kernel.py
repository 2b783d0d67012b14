"""The kernel machine against a plain solver of the full dual problem."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from textgrade.models import kernel
from textgrade.models.registry import MODELS


def table(spark, x, y):
    rows = [(i, [float(v) for v in r], None if c is None else float(c)) for i, (r, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, x array<double>, label double")
    return df.withColumn("features", array_to_vector("x")).drop("x")


def plain_machine(x, y, gamma, c=1.0):
    """Sequential minimal optimisation over the most violating pair: the weights of the rows and the constant."""
    k = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    alpha, slope = np.zeros(len(y)), -np.ones(len(y))
    while True:
        up = np.where((y > 0) & (alpha < c) | (y < 0) & (alpha > 0), -y * slope, -np.inf)
        low = np.where((y > 0) & (alpha > 0) | (y < 0) & (alpha < c), -y * slope, np.inf)
        i, j = up.argmax(), low.argmin()
        if up[i] - low[j] < 1e-6:
            return alpha * y, (up[i] + low[j]) / 2
        step = (up[i] - low[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        step = min(step, c - alpha[i] if y[i] > 0 else alpha[i], alpha[j] if y[j] > 0 else c - alpha[j])
        alpha[i] += y[i] * step
        alpha[j] -= y[j] * step
        slope += y * (k[i] - k[j]) * step


def clouds(n, seed, classes=3, d=4):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % classes
    return rng.normal(size=(n, d)) + np.eye(classes, d)[y] * 1.5, y


def test_all_rows_as_landmarks_give_the_exact_machine(spark):
    x, y = clouds(120, 1)
    x[5:10] = x[0:5]  # repeated rows
    df = table(spark, x, y).repartition(4)
    model = kernel.KernelMachine(gap=1e-4).fit(df)
    gamma = 1 / (x.shape[1] * x.var())
    assert model.basis.gamma == pytest.approx(gamma)
    fresh, _ = clouds(300, 2)
    got = model.decisions(fresh)
    votes = np.zeros((len(fresh), 3))
    for a, b in combinations(range(3), 2):
        mine = (y == a) | (y == b)
        pull, constant = plain_machine(x[mine], np.where(y[mine] == a, 1.0, -1.0), gamma)
        exact = np.exp(-gamma * ((fresh[:, None] - x[mine][None]) ** 2).sum(axis=2)) @ pull + constant
        assert np.abs(got[a, b] - exact).max() < 0.05
        votes[:, a] += exact > 0
        votes[:, b] += exact <= 0
    sure = np.all([np.abs(v) > 0.05 for v in got.values()], axis=0)
    predicted = {r["id"]: r["prediction"] for r in model.transform(table(spark, fresh, [0] * 300)).collect()}
    assert sure.mean() > 0.8 and all(predicted[i] == votes[i].argmax() for i in np.flatnonzero(sure))
    assert max(model.gaps.values()) <= 1e-4


def test_fewer_landmarks_stay_close(spark):
    x, y = clouds(600, 3)
    df = table(spark, x, y)
    fresh, truth = clouds(300, 4)
    asked = table(spark, fresh, truth)
    right = {}
    for landmarks in (40, 600):
        model = kernel.KernelMachine(landmarks=landmarks).fit(df)
        assert max(model.gaps.values()) <= kernel.GAP and model.basis.points.shape == (landmarks, 4)
        right[landmarks] = model.transform(asked).where("label = prediction").count() / 300
    assert right[600] > 0.6 and right[40] > right[600] - 0.04


def test_odd_rows(spark):
    flat = table(spark, [[1.0, 1.0]] * 6, [0, 1, 1, 1, 0, None])
    model = MODELS["SVM"]().fit(flat)  # equal rows of two classes: the constant alone decides
    assert {r["prediction"] for r in model.transform(flat).collect()} == {1.0}
    assert model.transform(flat.limit(0)).count() == 0
    apart = table(spark, [[0.0], [0.1], [5.0], [5.1]], [7, 7, 2, 2])
    assert [r["prediction"] for r in MODELS["SVM"]().fit(apart).transform(apart).orderBy("id").collect()] == [7.0, 7.0, 2.0, 2.0]
    with pytest.raises(ValueError, match="two classes"):
        MODELS["SVM"]().fit(flat.where(F.col("label") == 1))


def test_sums_come_to_the_driver_without_arrow(spark):
    """With Arrow off, Spark's default, an array column reaches the driver as lists."""
    x, y = clouds(60, 5)
    df = table(spark, x, y)
    want = kernel.KernelMachine().fit(df)
    setting = "spark.sql.execution.arrow.pyspark.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        got = kernel.KernelMachine().fit(df)
    finally:
        spark.conf.set(setting, before)
    for pair, weights in want.weights.items():
        np.testing.assert_allclose(got.weights[pair], weights, atol=1e-6)
