"""Registered queries against their SQL on the smallest test set."""

import os

import pytest

import __spark_entry__ as entry
from check import connect, difference

FOLDER = "/root/testdata/sf0.001"
CHECKED = [
    "readability_scores", "surface_features", "lexical_diversity", "pos_features", "verb_features", "pronoun_features",
    "dependency_features", "annotated_tokens", "conllu_parsed", "word_syllables", "lemma_frequency_features", "word_frequency_features",
    "feature_table", "chapter_files", "numbered_chapters", "corpus_union_capped", "language_profiles", "language_kept_text",
    "document_groups", "group_folds", "train_validation_rows", "three_way_rows", "fold_sizes", "split_train_test", "split_stratified",
    "stratified_group_folds", "text_files_round_trip", "csv_corpus_round_trip", "csv_missing_round_trip", "json_round_trip", "dictionary_round_trip",
    "ranking_round_trip", "rank_forward_fill", "describe_table", "histograms", "knn_neighbours", "gnb_cv_predictions", "classification_report",
    "fold_result_table", "group_result_table", "lda_moments",
    "lda_measures_predictions", "cv_protocol_predictions", "cv_protocol_scores", "language_detect", "language_accuracy",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", CHECKED)
def test_same_rows_as_sql(spark, con, name):
    found = difference(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name])
    assert found is None, found


def test_registry_is_consistent():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and set(CHECKED) <= set(sql)


def test_entry(spark):
    df = entry.entry(spark)
    assert "flesch_ease" in df.columns and df.count() == 200
