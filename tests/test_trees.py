"""Tree ensembles: batches against single fits, both ways of growing, boosting against a plain version."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from textgrade.models import crossval, selection, trees
from textgrade.models.registry import boosted_forest, boosted_trees, forest
from textgrade.operators import metrics

SMALL = {
    "RF": replace(trees.FOREST, members=5, depth=6),
    "XGB": replace(trees.BOOSTED, rounds=3, depth=3),
    "XGBRF": replace(trees.BOOSTED_FOREST, members=4, depth=3),
}


def rows_of(spark, n=160, d=6, seed=3):
    rng = np.random.default_rng(seed)
    label = rng.integers(0, 3, n)
    x = rng.normal(0, 1, (n, d))
    x[:, 1] += 2 * (label == 1)
    x[:, 4] -= 2 * (label == 2)
    x[:, 5] = np.round(x[:, 5])
    rows = [(int(i), [float(v) for v in x[i]], int(label[i]), int(i % 3)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, features array<double>, label int, fold int").repartition(4), x, label


def predictions(table):
    return {(r["fit"], r["id"]): r["prediction"] for r in table.collect()}


def test_spread_rows_grow_the_same_trees(spark, monkeypatch):
    df, _, _ = rows_of(spark)
    every = tuple(range(6))
    fits = [trees.Fit(s, every, fold) for s in SMALL.values() for fold in (0, None)] + [trees.Fit(SMALL["XGB"], (1, 4), 2, (1,))]
    data = trees.bin_rows(df)
    here = predictions(trees.run_fits(data, fits))
    weights = {(r["fit"], r["feature"]): r["importance"] for r in trees.run_importances(data, fits).collect()}
    monkeypatch.setattr(trees, "LOCAL_BYTES", 0)
    assert not data.small
    assert predictions(trees.run_fits(data, fits)) == here
    spread = {(r["fit"], r["feature"]): r["importance"] for r in trees.run_importances(data, fits).collect()}
    assert spread.keys() == weights.keys()
    for key, value in weights.items():
        assert spread[key] == pytest.approx(value, rel=1e-9, abs=1e-12)


def test_batches_equal_single_fits(spark):
    df, _, _ = rows_of(spark)
    data = trees.bin_rows(df)
    fits = [trees.Fit(s, f, fold) for s in SMALL.values() for f in ((0, 1, 4), (1, 5)) for fold in (0, 1)]
    together = predictions(trees.run_fits(data, fits))
    for i, fit in enumerate(fits):
        alone = predictions(trees.run_fits(data, [fit]))
        assert {k[1]: v for k, v in together.items() if k[0] == i} == {k[1]: v for k, v in alone.items()}
        bins, ids, labels, folds = data.shared().value
        on = folds != fit.fold
        want = trees.importances(trees.fit_here(fit, bins[on].astype(int), ids[on], labels[on], 3), fit, 6)
        got = {r["feature"]: r["importance"] for r in trees.run_importances(data, [fit]).collect()}
        total = sum(got.values())
        np.testing.assert_allclose([got[f] / total for f in range(6)], want, atol=1e-12)


def plain_boosting(bins, y, rounds, depth, rate=0.3, reg=1.0, floor=1.0):
    """Softmax boosting by trying every feature and cut of every node."""
    margins = np.zeros((len(y), 3))
    for _ in range(rounds):
        p = np.exp(margins)
        p /= p.sum(axis=1, keepdims=True)
        add = np.zeros_like(margins)
        for k in range(3):
            g, h = p[:, k] - (y == k), 2 * p[:, k] * (1 - p[:, k])

            def node(rows, level):
                best = (1e-6, None)
                score = lambda r: g[r].sum() ** 2 / (h[r].sum() + reg)
                for f in range(bins.shape[1] if level < depth else 0):
                    for cut in range(trees.BINS - 1):
                        left, right = rows[bins[rows, f] <= cut], rows[bins[rows, f] > cut]
                        if h[left].sum() >= floor and h[right].sum() >= floor:
                            gain = score(left) + score(right) - score(rows)
                            if gain > best[0] * (1 + 1e-9):
                                best = gain, (left, right)
                if best[1] is None:
                    add[rows, k] = -rate * g[rows].sum() / (h[rows].sum() + reg)
                else:
                    for part in best[1]:
                        node(part, level + 1)

            node(np.arange(len(y)), 0)
        margins += add
    return margins


def test_boosting_by_gradient_and_curvature(spark):
    df, _, _ = rows_of(spark, n=60, d=6)
    data = trees.bin_rows(df)
    bins, ids, labels, _ = data.shared().value
    bins = bins[:, [1, 4, 5]].astype(int)
    fit = trees.Fit(replace(trees.BOOSTED, rounds=3, depth=3), (0, 1, 2))
    got = trees.class_scores(trees.fit_here(fit, bins, ids, labels, 3), fit, bins, 3)
    np.testing.assert_allclose(got, plain_boosting(bins, labels, 3, 3), atol=1e-9)


def test_forest_grows_to_pure_leaves(spark):
    df, _, label = rows_of(spark)
    bins, ids, labels, _ = trees.bin_rows(df).shared().value
    fit = trees.Fit(trees.FOREST, tuple(range(6)))
    grown = trees.fit_here(fit, bins.astype(int), ids, labels, 3)
    scores = trees.class_scores(grown, fit, bins.astype(int), 3)
    assert (scores.argmax(axis=1) == labels).mean() > 0.97 and np.allclose(scores.sum(axis=1), 1)
    leaf = grown[0].feature < 0
    assert (grown[0].value[leaf].max(axis=1) == 1).mean() > 0.9


def test_estimators_and_cross_validation_agree(spark):
    df, _, _ = rows_of(spark)
    rows = crossval.from_array(df, "features")
    models = {"RF": lambda: forest(6, 5), "XGB": lambda: boosted_trees(3, 3), "XGBRF": lambda: boosted_forest(5, 3)}
    got = crossval.cross_validate(rows, models, test_fold=0, evaluate_holdout=True)
    assert got.count() == 160 * 3
    score = {(r["model"], r["fold"]): r["accuracy"] for r in metrics.weighted_scores(got, ["model", "fold"]).collect()}
    assert set(score) == {(m, f) for m in models for f in range(3)} and min(score.values()) > 0.5
    alone = models["XGB"]().fit(rows).transform(rows)
    assert alone.where(F.col("prediction") == F.col("label")).count() > 120


def test_elimination_and_curve_of_all_ensembles(spark):
    """One feature a round, every size: run for real, on a slice."""
    df, _, _ = rows_of(spark)
    rows, names = crossval.from_array(df, "features"), list("abcdef")
    models = {"RF": lambda: forest(6, 5), "XGB": lambda: boosted_trees(3, 3), "XGBRF": lambda: boosted_forest(5, 3)}
    ranks = selection.rfe_ranks(rows, models, names)
    table = {(r["model"], r["feat"]): r["rank"] for r in ranks.collect()}
    for m in models:
        assert sorted(table[(m, f)] for f in names) == [1, 2, 3, 4, 5, 6]
        assert set(selection.top_features(ranks, m, 2)) == {"b", "e"}
    ranked = {m: selection.top_features(ranks, m, 6) for m in models}
    curve = selection.curve_table(selection.forward_curve(rows, models, names, ranked), list(models)).orderBy("n_features").collect()
    assert [r["n_features"] for r in curve] == [1, 2, 3, 4, 5, 6] and curve[1]["XGB"] > curve[0]["XGB"]


def test_odd_rows(spark):
    rows = [(1, [1.0, float("nan")], 0), (2, [2.0, 5.0], 2), (2, [2.0, 5.0], 2), (3, [1.0, float("nan")], 0)]
    df = spark.createDataFrame(rows, "id long, features array<double>, label int")
    data = trees.bin_rows(df)
    for spec in SMALL.values():
        got = trees.run_fits(data, [trees.Fit(spec, (0, 1))]).collect()
        assert len(got) == 4 and {r["prediction"] for r in got} <= {0, 2}


def test_few_members_at_a_time_grow_the_same_trees(spark, monkeypatch):
    """Memory goes by ``PAIRS`` and not by rows times members, and a forest may be dealt out in pieces."""
    df, x, label = rows_of(spark)
    data = trees.bin_rows(df)
    fits = [trees.Fit(s, (0, 1, 2, 3, 4, 5), fold) for s in SMALL.values() for fold in (0, None)]
    whole = predictions(trees.run_fits(data, fits))
    bins, ids, labels, _ = data.shared().value
    one = trees.fit_here(fits[1], bins, ids, labels, 3)[0]
    monkeypatch.setattr(trees, "PAIRS", 200)
    monkeypatch.setattr(trees, "ROWS", 50)
    assert [p.members for p in fits[1].handfuls(len(ids), 3)] == [1] * 5
    few = trees.fit_here(fits[1], bins, ids, labels, 3)[0]
    scores = [trees.outputs(t, fits[1], bins, 3) for t in (one, few)]
    np.testing.assert_allclose(*scores, atol=1e-12)
    monkeypatch.setattr(trees, "DEAL", 1)
    monkeypatch.setattr(trees, "PIECE", 2)
    monkeypatch.setattr(trees.Fit.pieces, "__defaults__", (2,))
    assert predictions(trees.run_fits(data, fits)) == whole


def test_held_out_rows_keep_ids_and_labels(spark, monkeypatch):
    """Trees are grown in tasks, not on the driver; rows asked may repeat an id and have labels that no tree knows."""
    df, _, _ = rows_of(spark)
    rows = crossval.from_array(df, "features")
    asked = rows.where("fold = 0").withColumn("label", F.when(F.col("id") == 0, 9).otherwise(F.col("label")))
    asked = asked.unionByName(asked.where("id = 3"))
    train = rows.where("fold <> 0")
    monkeypatch.setattr(trees.TreeEnsemble, "fit", None)
    for model in (forest(6, 5), boosted_trees(3, 3), boosted_forest(5, 3)):
        got = crossval.train_model(model, train, asked, "M", 0).collect()
        assert len(got) == asked.count() and sum(r["id"] == 3 for r in got) == 2
        assert next(r["label"] for r in got if r["id"] == 0) == 9
        assert sum(r["label"] == r["prediction"] for r in got) > 0.45 * len(got)


def test_histograms_two_features_at_a_time():
    """All ways to add up give the sums that a plain loop gives."""
    rng = np.random.default_rng(7)
    bins = rng.integers(0, trees.BINS, (3000, 5)).astype(np.uint8)
    row = np.tile(np.arange(3000), 3)
    tree = np.repeat(np.arange(3), 3000)
    stats = rng.normal(size=(9000, 2))

    def plain(row, slots, stats, subset):
        out = np.zeros((*subset.shape, trees.BINS, 2))
        for r, s, x in zip(row, slots, stats):
            for j, f in enumerate(subset[s]):
                out[s, j, bins[r, f]] += x
        return out

    every = np.broadcast_to(np.arange(5), (3, 5))
    want = plain(row, tree, stats, every)
    both = trees.paired(bins, range(5))
    for matrix in (bins, np.asfortranarray(bins)):
        for kind in ({}, {"pairs": both, "n_features": 5}, {"pairs": both, "n_features": 5, "tiled": True}):
            np.testing.assert_allclose(trees.histograms(matrix, row, tree, stats, every, **kind), want, atol=1e-9)
        few = rng.choice(9000, 700, replace=False)
        for subset in (every, np.sort(rng.permuted(every, axis=1)[:, :3], axis=1), np.sort(rng.permuted(every, axis=1)[:, :2], axis=1), every[:, ::-1]):
            for some in (np.arange(9000), few):
                got = trees.histograms(matrix, row[some], tree[some], stats[some], subset, both, 5)
                np.testing.assert_allclose(got, plain(row[some], tree[some], stats[some], subset), atol=1e-9)
    assert both.dtype == np.uint16 and both.shape == (3000, 3)
    # what a boosted fit notes down as each row's leaf is what its trees say
    fit, label = trees.Fit(SMALL["XGB"], (0, 2, 4)), rng.integers(0, 3, 3000)
    ends = np.full((3, 3000), -1)
    grown = trees.grow_here(fit, 0, bins, np.arange(3000), label, np.zeros((3000, 3)), 3, ends=ends)
    assert len(grown.feature) > 3 and (ends == grown.leaves(bins)).all()
