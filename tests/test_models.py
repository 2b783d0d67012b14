"""Classifiers, metrics and selection against brute force and worked examples."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from textgrade.functions.arrays import argmax
from textgrade.models import crossval, gnb, knn, lda, selection
from textgrade.models.moments import class_moments, moment_matrices
from textgrade.models.registry import MODELS, boosted_forest, boosted_trees, forest
from textgrade.operators import metrics, sampling
from textgrade.plans import modelling


def blobs(spark, n=300, d=5, k=3, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 2, (k, d))
    label = rng.integers(0, k, n)
    x = centers[label] + rng.normal(0, 1, (n, d))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], int(label[i])) for i in range(n)], "id long, features array<double>, label int")
    return df, x, label


@pytest.mark.parametrize("copies,pivots,block", [(0, 8, 16), (120, 8, 16), (120, 64, 4096), (0, 1, 50)])
def test_knn_matches_brute_force(spark, copies, pivots, block):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(0, 1, (240, 3)), 2)
    if copies:
        x[:copies] = x[0]  # one vector holds half of the rows
    q = np.vstack([x[:40], np.round(rng.normal(0, 3, (40, 3)), 2)])
    to_rows = lambda m: [(i, [float(v) for v in r]) for i, r in enumerate(m)]
    train = spark.createDataFrame(to_rows(x), "id long, features array<double>").repartition(5)
    queries = spark.createDataFrame(to_rows(q), "id long, features array<double>")
    got = {}
    for r in knn.neighbours(queries, train, 5, pivots, block).collect():
        got.setdefault(r["id"], {})[r["place"]] = r["neighbour_id"]
    for i, v in enumerate(q):
        d = np.round(((x - v) ** 2).sum(axis=1), 9)
        want = sorted(range(len(x)), key=lambda j: (d[j], j))[:5]
        assert [got[i][p] for p in range(1, 6)] == want


def test_knn_holds_few_distances_at_a_time(spark, monkeypatch):
    """Neither queries on their way to all cells nor distances of a block stand in memory together."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(0, 1, (300, 8)))]
    df = spark.createDataFrame(rows, "id long, features array<double>").repartition(3)
    want = sorted(map(tuple, knn.neighbours(df, df, 4, 8, 100).collect()))
    monkeypatch.setattr(knn, "ROUTED", 7)
    monkeypatch.setattr(knn, "CELLS_AT_ONCE", 200)
    assert sorted(map(tuple, knn.neighbours(df, df, 4, 8, 100).collect())) == want


def test_knn_with_fewer_rows_than_neighbours(spark):
    train = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "id long, features array<double>")
    query = spark.createDataFrame([(9, [0.2])], "id long, features array<double>")
    rows = knn.neighbours(query, train, 5).orderBy("place").collect()
    assert [r["neighbour_id"] for r in rows] == [1, 2]


def test_vote_takes_the_lower_label_on_a_tie(spark):
    found = spark.createDataFrame([(1, n) for n in (10, 11, 12, 13)], "id long, neighbour_id long")
    labels = spark.createDataFrame([(10, 2), (11, 1), (12, 2), (13, 1)], "id long, label int")
    assert knn.vote(found, labels).first()["prediction"] == 1


def test_lda_matches_closed_form(spark):
    df, x, label = blobs(spark)
    matrices = {k[0]: m for k, m in moment_matrices(class_moments(df.repartition(7), ["label"]), ["label"]).items()}
    model = lda.solve(matrices)
    means = np.array([x[label == c].mean(axis=0) for c in range(3)])
    pooled = sum(((x[label == c] - means[c]).T @ (x[label == c] - means[c])) for c in range(3)) / (len(x) - 3)
    inverse = np.linalg.inv(pooled)
    priors = np.bincount(label) / len(label)
    center = x.mean(axis=0)
    coef = (means - center) @ inverse
    np.testing.assert_allclose(model.coef, coef, rtol=1e-8)
    scores = x @ inverse @ means.T - 0.5 * np.einsum("ij,jk,ik->i", means, inverse, means) + np.log(priors)
    assert (model.scores(x).argmax(axis=1) == scores.argmax(axis=1)).all()
    np.testing.assert_allclose(model.importance(), (coef**2).sum(axis=0), rtol=1e-8)
    # a constant and a repeated feature change nothing
    wide = df.withColumn("features", F.concat("features", F.array(F.lit(3.0)), F.slice("features", 1, 1)))
    again = lda.solve({k[0]: m for k, m in moment_matrices(class_moments(wide, ["label"]), ["label"]).items()})
    xw = np.hstack([x, np.full((len(x), 1), 3.0), x[:, :1]])
    assert (again.scores(xw).argmax(axis=1) == model.scores(x).argmax(axis=1)).all()


def test_all_folds_at_once_equal_one_by_one(spark):
    df, _, _ = blobs(spark)
    rows = sampling.k_folds(df, "id", 4)
    bayes = {r["id"]: r["prediction"] for r in gnb.cross_predict(rows).collect()}
    linear = {r["id"]: r["prediction"] for r in crossval.lda_cross_predict(rows).collect()}
    from textgrade.models.scoring import score_batches

    for fold in range(4):
        train, val = rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)
        for r in score_batches(val, {None: gnb.fit(train)}).collect():
            assert bayes[r["id"]] == r["prediction"]
        ready = crossval.from_array(train, "features")
        for r in MODELS["LDA"]().fit(ready).transform(crossval.from_array(val, "features")).collect():
            assert linear[r["id"]] == r["prediction"]


def predictions(spark, pairs):
    return spark.createDataFrame(pairs, "label int, prediction int")


def test_metrics_by_hand(spark):
    df = predictions(spark, [(0, 0), (0, 0), (1, 0), (2, 2)])
    skip = metrics.weighted_scores(df).first()
    zero = metrics.weighted_scores(df, zero_division=0.0).first()
    assert skip["precision"] == pytest.approx(0.7778, abs=1e-4) and zero["precision"] == pytest.approx(0.5833, abs=1e-4)
    assert skip["recall"] == skip["accuracy"] == 0.75
    rows = [tuple(r[1:]) for r in metrics.confusion(df).orderBy("label").collect()]
    assert rows == [(2, 0, 0), (1, 0, 0), (0, 0, 1)]
    counted = df.groupBy("label", "prediction").agg(F.count("*").alias("n"))
    assert metrics.weighted_scores(counted, weight="n").first() == skip
    assert [tuple(r[1:]) for r in metrics.confusion(counted, weight="n").orderBy("label").collect()] == rows
    report = {r["row"]: r for r in metrics.classification_report(df).collect()}
    assert report["accuracy"]["f1"] == 0.75 and report["macro avg"]["f1"] == pytest.approx((0.8 + 0 + 1) / 3)
    assert report["weighted avg"]["precision"] == pytest.approx(0.5833, abs=1e-4)


def test_macro_f1_leaves_out_absent_classes(spark):
    df = predictions(spark, [(0, 0), (1, 1), (1, 0)])
    assert metrics.macro_f1(df).first()["macro_f1"] == pytest.approx((2 / 3 + 2 / 3) / 2)


def test_metric_registry(spark):
    metrics.register_metric("share_of_zero", lambda df, by, labels: df.groupBy(*by).agg(F.avg((F.col("prediction") == 0).cast("double")).alias("value")))
    df = predictions(spark, [(0, 0), (1, 1)])
    got = {r["metric"]: r["value"] for r in metrics.evaluate(df, ["accuracy", "share_of_zero"]).collect()}
    assert got == {"accuracy": 1.0, "share_of_zero": 0.5}


def test_argmax(spark):
    df = spark.createDataFrame([([0.1, 0.9, 0.9],), ([3.0],), ([],)], "a array<double>")
    assert [r[0] for r in df.select(argmax(F.col("a"))).collect()] == [1, 0, None]


def test_models_beat_the_majority_class(spark):
    df, _, label = blobs(spark, n=240)
    rows = crossval.from_array(sampling.k_folds(df, "id", 3), "features")
    small = {**MODELS, "RF": lambda: forest(8, 4), "XGB": lambda: boosted_trees(3, 3), "XGBRF": lambda: boosted_forest(8, 4)}
    got = crossval.cross_validate(rows, small)
    accuracy = {r["model"]: r["accuracy"] for r in metrics.weighted_scores(got, ["model"]).collect()}
    assert set(accuracy) == set(MODELS)
    majority = np.bincount(label).max() / len(label)
    assert all(a > majority + 0.15 for a in accuracy.values()), accuracy
    assert got.count() == 240 * len(small)


def test_holdout_is_scored_only_on_request(spark):
    df, _, _ = blobs(spark, n=120)
    rows = crossval.from_array(sampling.k_folds(df, "id", 3), "features")
    models = {"LDA": MODELS["LDA"]}
    assert {r["fold"] for r in crossval.cross_validate(rows, models, test_fold=0).select("fold").distinct().collect()} == {1, 2}
    both = crossval.cross_validate(rows, models, test_fold=0, evaluate_holdout=True)
    assert both.count() == 120 and both.select("fold").distinct().count() == 3


def test_elimination_keeps_the_telling_features(spark):
    rng = np.random.default_rng(8)
    label = rng.integers(0, 2, 300)
    x = rng.normal(0, 1, (300, 6))
    x[:, 2] += 3 * label
    x[:, 4] += 2 * label
    df = spark.createDataFrame([([float(v) for v in r], int(l)) for r, l in zip(x, label)], "features array<double>, label int")
    df = df.withColumn("features", array_to_vector("features"))
    names = list("abcdef")
    ranks = selection.rfe_ranks(df, {"LDA": MODELS["LDA"], "RF": lambda: forest(8, 3)}, names)
    table = {(r["model"], r["feat"]): r["rank"] for r in ranks.collect()}
    for model in ("LDA", "RF"):
        assert sorted(table[(model, f)] for f in names) == [1, 2, 3, 4, 5, 6]
        assert selection.top_features(ranks, model, 2) == ["c", "e"]
    first = selection.sorted_features(ranks, ["LDA", "RF"]).orderBy("place").first()
    assert (first["LDA"], first["RF"]) == ("c", "c")
    assert selection.rank_table(ranks, ["LDA", "RF"]).count() == 6


def test_forward_curve_equals_single_fits(spark):
    df, _, _ = blobs(spark, n=180, d=4)
    rows = crossval.from_array(sampling.k_folds(df, "id", 3), "features")
    names = list("abcd")
    order = ["c", "a", "d", "b"]
    curve = selection.forward_curve(rows, {"LDA": MODELS["LDA"], "CART": MODELS["CART"]}, names, {"LDA": order, "CART": order}, (1, 3))
    got = {(r["model"], r["n_features"]): r["f1"] for r in curve.collect()}
    sliced = df.withColumn("features", F.array(F.col("features")[2], F.col("features")[0], F.col("features")[3]))
    single = crossval.lda_cross_predict(sampling.k_folds(sliced, "id", 3)).withColumn("prediction", F.col("prediction").cast("int"))
    want = metrics.mean_weighted_f1(metrics.weighted_scores(single.withColumn("m", F.lit(1)), ["m", "fold"]), ["m"]).first()["f1"]
    assert got[("LDA", 3)] == pytest.approx(want)
    assert set(got) == {("LDA", 1), ("LDA", 3), ("CART", 1), ("CART", 3)}


def test_assemble_imputes_or_drops(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 4.0), (3.0, 6.0)], "a double, b double")
    assert [list(r["features"]) for r in crossval.assemble(df, ["a", "b"]).collect()] == [[1, 2], [2, 4], [3, 6]]
    assert crossval.assemble(df, ["a", "b"], impute=False).count() == 2
    assert list(crossval.assemble(df, ["a", "b"], drop_features=["a"]).first()["features"]) == [2]


def test_small_spread_of_large_values(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [(i, i % 2, [1e9 + 3 * (i % 2) + float(rng.normal()), float(rng.normal())]) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, label int, features array<double>")
    model = gnb.fit(df)
    assert np.isfinite(model.variances).all() and (abs(model.variances - 1) < 0.2).all()
    folded = df.withColumn("fold", (df.id % 7).cast("int"))
    for predicted in (gnb.cross_predict(folded), crossval.lda_cross_predict(folded)):
        assert predicted.where("prediction = label").count() > 900


def test_ensembles_have_a_hundred_members():
    specs = {m: MODELS[m]().spec for m in ("RF", "XGB", "XGBRF")}
    assert specs["RF"].members == specs["XGBRF"].members == specs["XGB"].rounds == 100
    assert specs["XGB"].depth == specs["XGBRF"].depth == 6 and specs["RF"].depth >= 30
    assert {m: modelling.GROUPED[m] for m in specs} == {m: modelling.TREES[m] for m in specs} == {m: MODELS[m] for m in specs}
