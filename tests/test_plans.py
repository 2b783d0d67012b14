"""Shape of the physical plans: no cross joins, pruned scans, few shuffles."""

import os

import pytest

import __spark_entry__ as entry
from textgrade.plans import load_all, modelling
from textgrade.plans.document_features import FEATURE_SQL

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# fits and driver-side solves run jobs while the query is built; their plans are covered by the others
PLANNED = [
    n for n in load_all()[0]
    if n not in FEATURE_SQL  # parts of the feature sets, which are here
    and not n.endswith(("_predictions", "_cv_models", "_scores"))
    and not n.startswith(("rfe", "forward", "knn", "cv_", "gnb", "lda", "macro", "mean_class", "mean_weighted", "confusion", "class", "document_cv"))
]


@pytest.mark.parametrize("name", PLANNED)
def test_no_cross_join(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_features_shuffle_only_document_rows(spark):
    """One shuffle merges the documents' sums."""
    text = plan(entry.queries()["dependency_features"](spark, FOLDER))
    assert text.count("Exchange hashpartitioning") == 1
    assert "Window" not in text and "Expand" not in text
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in text


def test_light_features_read_two_columns(spark):
    text = plan(entry.queries()["auto_read_index"](spark, FOLDER))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    assert "BroadcastHashJoin" not in text


def test_count_shuffle_is_shared(spark):
    df = entry.queries()["word_frequency_features"](spark, FOLDER)
    df.collect()
    text = plan(df).split("Initial Plan")[0]
    assert text.count("Generate posexplode(_words") == 2  # once for the documents, once for the dictionary's collection


@pytest.mark.parametrize("name", [
    "group_folds", "binary_folds", "fold_tuples", "train_validation_rows", "three_way_rows", "fold_group_rows", "rows_outside_fold",
    "fold_sizes", "folds_but_one", "training_groups", "documents_with_group_names",
])
def test_fold_queries_read_the_saved_keys(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    assert 1 <= text.count("FileScan parquet") <= 3 and "documents.parquet" not in text and "[text" not in text


def test_kept_tables_follow_their_source(spark, tmp_path):
    from textgrade import session
    from textgrade.session import kept

    source, made = str(tmp_path / "t"), []

    def table():
        made.append(1)
        return spark.read.parquet(source).selectExpr("count(*) AS n")

    spark.range(5).write.parquet(source)
    first = kept(spark, "rows", source, table)
    assert first.first()["n"] == kept(spark, "rows", source, table).first()["n"] == 5 and len(made) == 1
    spark.range(3).write.mode("append").parquet(source)
    changed = kept(spark, "rows", source, table)
    assert changed.first()["n"] == 8 and len(made) == 2
    key = next(k for k in session._KEPT if k[1:3] == ("rows", (source,)))
    session._KEPT[key] = str(tmp_path / "gone"), session._KEPT[key][1]
    assert kept(spark, "rows", source, table).first()["n"] == 8 and len(made) == 3


def test_class_filter_reaches_the_scan(spark):
    from textgrade.sources.tables import read_table

    text = plan(read_table(spark, FOLDER, "lineitem").where("l_quantity < 5").select("l_orderkey"))
    assert "PushedFilters: [IsNotNull(l_quantity), LessThan(l_quantity,5.0)]" in text


def test_tree_curve_has_every_size_and_model(spark, monkeypatch):
    asked = {}

    def curve(df, models, names, ranked, sizes=None, labels=None):
        asked["curve"] = (set(models), list(sizes or range(1, len(names) + 1)))
        return df.sparkSession.createDataFrame([(m, 1, 0.5) for m in models], "model string, n_features int, f1 double")

    def ranks(df, models, names, step=1):
        asked["step"] = step
        return df.sparkSession.createDataFrame([(m, n, i) for m in models for i, n in enumerate(names)], "model string, feat string, rank int")

    monkeypatch.setattr(modelling.selection, "forward_curve", curve)
    monkeypatch.setattr(modelling.selection, "rfe_ranks", ranks)
    table = entry.queries()["forward_curve_trees"](spark, "/root/testdata/sf0.001")
    assert table.columns == ["n_features", "RF", "XGBRF", "XGB"]
    assert asked == {"curve": ({"RF", "XGBRF", "XGB"}, list(range(1, 65))), "step": 1}


def test_elimination_drops_one_feature_a_round_and_is_saved(spark, monkeypatch):
    steps = []

    def ranks(df, models, names, step=1):
        steps.append((set(models), step))
        return df.sparkSession.createDataFrame([(m, n, i) for m in models for i, n in enumerate(names)], "model string, feat string, rank int")

    monkeypatch.setattr(modelling.selection, "rfe_ranks", ranks)
    monkeypatch.setattr(modelling, "_SAVED", {})
    for name in ("rfe_ranks", "rfe_table", "rfe_sorted"):
        entry.queries()[name](spark, FOLDER)
    assert steps == [({"LDA", "RF", "XGB", "XGBRF"}, 1)]  # and shared by the three
