"""Queries for classifiers, their metrics, feature selection and result tables, over ``embeddings``."""

from __future__ import annotations

from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textgrade.functions.arrays import argmax, unnest_scores
from textgrade.models import crossval, gnb, knn, reports, selection
from textgrade.models.moments import class_moments
from textgrade.models.registry import FOLD_MODELS, MODELS
from textgrade.operators import groups, metrics, sampling
from textgrade.operators.features import FEATURE_NAMES
from textgrade.plans.document_features import dictionary_counts, documents, feature_table
from textgrade.plans.registry import register, rounded, sql_rounded
from textgrade.session import materialize
from textgrade.sources.tables import read_table

DIMENSIONS = 64
NAMES = [f"f{i:02d}" for i in range(DIMENSIONS)]


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """``id, features, label, group``: each of the ten given labels is a group of one of three classes."""
    df = read_table(spark, folder, "embeddings")
    return df.select(
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("features"),
        F.pmod("label", F.lit(3)).cast("int").alias("label"),
        F.col("label").alias("group"),
    )


def folded(spark: SparkSession, folder: str, k: int = 10) -> DataFrame:
    return sampling.k_folds(vectors(spark, folder), "id", k)


def split(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    parts = sampling.train_test_split(vectors(spark, folder), "id")
    return parts.where(F.col("part") == "train"), parts.where(F.col("part") == "test")


def ml_ready(df: DataFrame) -> DataFrame:
    return crossval.from_array(df, "features")


BASE_SQL = """
vec AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, (label % 3)::INTEGER AS label, label AS grp,
  row_number() OVER (ORDER BY md5(vec_id || '|42'), vec_id) AS p, count(*) OVER () AS n_all FROM embeddings),
part AS (SELECT *, ((p - 1) % 10)::INTEGER AS fold, p > n_all - ceil(n_all * 0.2::DOUBLE) AS test FROM vec)"""

# --- nearest neighbours -------------------------------------------------------------------------------

KNN_SQL = f"""{BASE_SQL},
pairs AS (SELECT q.id, t.id AS neighbour_id, t.label, row_number() OVER (PARTITION BY q.id ORDER BY
    round(list_sum(list_transform(range(1, 65), lambda i: (q.x[i] - t.x[i]) * (q.x[i] - t.x[i]))), 9), t.id) AS place
  FROM part q, part t WHERE q.test AND NOT t.test),
near AS (SELECT * FROM pairs WHERE place <= 5),
votes AS (SELECT id, label, count(*) AS n FROM near GROUP BY ALL),
voted AS (SELECT id, arg_max(label, struct_pack(n, o := -label)) AS prediction FROM votes GROUP BY id)"""


def _neighbours(spark: SparkSession, folder: str) -> DataFrame:
    train, test = split(spark, folder)
    return knn.neighbours(test, train, 5)


register(
    "knn_neighbours",
    lambda s, f: _neighbours(s, f).select("id", "neighbour_id", "place"),
    f"WITH {KNN_SQL} SELECT id, neighbour_id, place::INTEGER AS place FROM near",
)
register(
    "knn_predict",
    lambda s, f: knn.vote(_neighbours(s, f), vectors(s, f)),
    f"WITH {KNN_SQL} SELECT id, prediction FROM voted",
)

# --- Gaussian naive Bayes -----------------------------------------------------------------------------


def _bayes_sql(rows: str, fold: str) -> str:
    """Predictions of each fold's rows from the moments of all other folds."""
    return f"""
pts AS (SELECT id, label, {fold} AS fold, unnest(x) AS v, unnest(range(1, 65)) AS d FROM {rows}),
m AS (SELECT fold, label, d, count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM pts GROUP BY ALL),
tot AS (SELECT label, d, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM m GROUP BY ALL),
tr AS (SELECT f.fold, t.label, t.d, (t.n - coalesce(m.n, 0))::DOUBLE AS n, t.s - coalesce(m.s, 0) AS s, t.q - coalesce(m.q, 0) AS q
  FROM (SELECT DISTINCT fold FROM m) f CROSS JOIN tot t LEFT JOIN m ON m.fold = f.fold AND m.label = t.label AND m.d = t.d),
eps AS (SELECT fold, max(var) * 1e-9::DOUBLE AS eps FROM
  (SELECT fold, d, sum(q) / sum(n) - (sum(s) / sum(n)) * (sum(s) / sum(n)) AS var FROM tr GROUP BY ALL) GROUP BY fold),
par AS (SELECT fold, label AS cls, d, s / n AS mu, q / n - (s / n) * (s / n) + eps AS var,
  ln(n / sum(n) OVER (PARTITION BY fold, d)) AS prior FROM tr JOIN eps USING (fold) WHERE n > 0),
sc AS (SELECT id, label, fold, cls, max(prior) + sum(-0.5::DOUBLE * ln(2 * pi() * var) - 0.5::DOUBLE * (v - mu) * (v - mu) / var) AS score
  FROM pts JOIN par USING (fold, d) GROUP BY ALL),
pred AS (SELECT 'NB' AS model, id, fold, label, arg_max(cls, score) AS prediction FROM sc GROUP BY ALL)"""


def _bayes_cv(spark: SparkSession, folder: str) -> DataFrame:
    predicted = gnb.cross_predict(folded(spark, folder))
    return predicted.select(
        F.lit("NB").alias("model"), "id", "fold", "label", F.col("prediction").cast("int").alias("prediction")
    )


def _bayes_holdout(spark: SparkSession, folder: str) -> DataFrame:
    from textgrade.models.scoring import score_batches

    train, test = split(spark, folder)
    return score_batches(test, {None: gnb.fit(train)}).select("id", "label", F.col("prediction").cast("int").alias("prediction"))


PRED_SQL = f"{BASE_SQL}, {_bayes_sql('part', 'fold')}"
register(
    "gnb_cv_predictions",
    _bayes_cv,
    f"WITH {PRED_SQL} SELECT model, id, fold, label, prediction FROM pred",
)
register(
    "gnb_predict",
    _bayes_holdout,
    f"WITH {BASE_SQL}, {_bayes_sql('part', 'CASE WHEN test THEN 1 ELSE 0 END')} SELECT id, label, prediction FROM pred WHERE fold = 1",
)

# --- metrics over the cross-validated predictions -------------------------------------------------------

_CELLS = ", ".join(f"count(*) FILTER (WHERE label = l AND prediction = {b}) AS pred_{b}" for b in metrics.CLASSES)


def _confusion_sql(keys: str) -> str:
    group = f"GROUP BY {keys}l" if keys else "GROUP BY l"
    return f"WITH {PRED_SQL} SELECT {keys}l AS label, {_CELLS} FROM pred, (SELECT unnest([0, 1, 2])::INTEGER AS l) {group}"


register(
    "confusion_by_fold",
    lambda s, f: metrics.confusion(_bayes_cv(s, f), ["model", "fold"]),
    _confusion_sql("model, fold, "),
)
register("confusion_total", lambda s, f: metrics.confusion(_bayes_cv(s, f), ["model"]), _confusion_sql("model, "))


def _scores_sql(zero: str, keys: str = "model, fold") -> str:
    def share(top: str, bottom: str) -> str:
        return f"coalesce(({top})::DOUBLE / nullif({bottom}, 0), {zero})"

    return f"""counts AS (SELECT {keys}, l AS label, count(*) FILTER (WHERE label = l AND prediction = l) AS tp,
  count(*) FILTER (WHERE prediction = l) AS predicted, count(*) FILTER (WHERE label = l) AS support
  FROM pred, (SELECT unnest([0, 1, 2])::INTEGER AS l) GROUP BY {keys}, l),
scores AS (SELECT {keys}, label, {share('tp', 'predicted')} AS precision, {share('tp', 'support')} AS recall,
  {share('2 * tp', 'predicted + support')} AS f1, support, predicted, tp FROM counts)"""


def _shown(columns) -> str:
    return ", ".join(f"{sql_rounded(c)} AS {c}" for c in columns)


def _rounded(df: DataFrame, columns) -> DataFrame:
    return df.select(*[rounded(c).alias(c) if c in columns else F.col(c) for c in df.columns])


_PRF = ("precision", "recall", "f1")
_WEIGHTED = ", ".join(f"sum({m} * support) / sum(support) FILTER (WHERE {m} IS NOT NULL) AS {m}" for m in _PRF)


def _weighted_sql(zero: str = "NULL", keys: str = "model, fold") -> str:
    return f"""{_scores_sql(zero, keys)}, weighted AS (SELECT {keys}, {_WEIGHTED}, sum(support)::BIGINT AS support,
  sum(tp)::DOUBLE / sum(support) AS accuracy FROM scores GROUP BY {keys})"""


register(
    "class_scores",
    lambda s, f: _rounded(metrics.class_scores(_bayes_cv(s, f), ["model", "fold"]), _PRF).drop("tp"),
    f"WITH {PRED_SQL}, {_scores_sql('NULL')} SELECT model, fold, label, {_shown(_PRF)}, support, predicted FROM scores",
)
register(
    "binary_class_scores",
    lambda s, f: _rounded(
        metrics.class_scores(_bayes_cv(s, f).where("label < 2"), ["fold"], labels=(0, 1), zero_division=0.0), _PRF
    ).drop("tp"),
    f"WITH {PRED_SQL.replace('AS prediction FROM sc', 'AS prediction FROM sc WHERE label < 2')}, {_scores_sql('0', 'fold').replace('[0, 1, 2]', '[0, 1]')}"
    f" SELECT fold, label, {_shown(_PRF)}, support, predicted FROM scores",
)
register(
    "weighted_scores",
    lambda s, f: _rounded(metrics.weighted_scores(_bayes_cv(s, f), ["model", "fold"]), (*_PRF, "accuracy")),
    f"WITH {PRED_SQL}, {_weighted_sql()} SELECT model, fold, {_shown((*_PRF, 'accuracy'))}, support FROM weighted",
)
register(
    "accuracy",
    lambda s, f: _bayes_cv(s, f)
    .groupBy("fold")
    .agg(rounded(F.avg((F.col("label") == F.col("prediction")).cast("double"))).alias("accuracy")),
    f"WITH {PRED_SQL} SELECT fold, {sql_rounded('avg((label = prediction)::INTEGER)')} AS accuracy FROM pred GROUP BY fold",
)
register(
    "combined_metrics",
    lambda s, f: _rounded(metrics.evaluate(_bayes_cv(s, f), ["accuracy", "recall", "precision", "f1"], ["fold"]), ("value",)),
    f"WITH {PRED_SQL}, {_weighted_sql()} "
    + " UNION ALL ".join(
        f"SELECT fold, '{m}' AS metric, {sql_rounded(m)} AS value FROM weighted" for m in ("accuracy", "recall", "precision", "f1")
    ),
)
_MACRO = "macro AS (SELECT model, fold, avg(f1) AS macro_f1 FROM scores WHERE support > 0 OR predicted > 0 GROUP BY ALL)"
register(
    "macro_f1",
    lambda s, f: _rounded(metrics.macro_f1(_bayes_cv(s, f), ["model", "fold"]), ("macro_f1",)),
    f"WITH {PRED_SQL}, {_scores_sql('0')}, {_MACRO} SELECT model, fold, {_shown(['macro_f1'])} FROM macro",
)
register(
    "cv_summary",
    lambda s, f: _rounded(metrics.cv_summary(_bayes_cv(s, f)), ("mean", "std")),
    f"WITH {PRED_SQL}, {_scores_sql('0')}, {_MACRO} SELECT model, {sql_rounded('avg(macro_f1)')} AS mean,"
    f" {sql_rounded('stddev_pop(macro_f1)')} AS std, count(*) AS n_folds FROM macro GROUP BY model",
)
register(
    "mean_weighted_f1",
    lambda s, f: _rounded(
        metrics.mean_weighted_f1(metrics.weighted_scores(_bayes_cv(s, f), ["model", "fold"]), ["model"]), ("f1",)
    ),
    f"WITH {PRED_SQL}, {_weighted_sql()} SELECT model, {sql_rounded('avg(f1)')} AS f1 FROM weighted GROUP BY model",
)
register(
    "mean_class_f1",
    lambda s, f: _rounded(metrics.mean_class_f1(metrics.class_scores(_bayes_cv(s, f), ["model", "fold"]), ["model"]), ("f1",)),
    f"WITH {PRED_SQL}, {_scores_sql('NULL')} SELECT model, {sql_rounded('avg(f1)')} AS f1 FROM scores GROUP BY model",
)
register(
    "classification_report",
    lambda s, f: _rounded(metrics.classification_report(_bayes_cv(s, f), ["model"]), _PRF),
    f"""WITH {PRED_SQL}, {_scores_sql('0', 'model')},
lines AS (SELECT model, label::VARCHAR AS row, precision, recall, f1, support FROM scores
UNION ALL SELECT model, 'accuracy', NULL, NULL, sum(tp)::DOUBLE / sum(support), sum(support) FROM scores GROUP BY model
UNION ALL SELECT model, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM scores GROUP BY model
UNION ALL SELECT model, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
  sum(f1 * support) / sum(support), sum(support) FROM scores GROUP BY model)
SELECT model, row, {_shown(_PRF)}, support::BIGINT AS support FROM lines""",
)

# --- arrays of scores -----------------------------------------------------------------------------------

register(
    "argmax_predictions",
    lambda s, f: read_table(s, f, "embeddings").select("vec_id", argmax(F.col("embedding")).cast("int").alias("prediction")),
    "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS prediction FROM embeddings",
)
register(
    "unnested_scores",
    lambda s, f: unnest_scores(
        read_table(s, f, "embeddings").select("vec_id", "embedding", F.transform("embedding", lambda v: v > 0).alias("positive")),
        ["embedding", "positive"],
        "position",
    ),
    "SELECT vec_id, unnest(range(len(embedding)))::INTEGER AS position, unnest(embedding) AS embedding,"
    " unnest(list_transform(embedding, lambda v: v > 0)) AS positive FROM embeddings",
)
register(
    "label_cast",
    lambda s, f: read_table(s, f, "labels").select("doc_id", F.col("quality").cast("double").cast("int").alias("label")),
    "SELECT doc_id, quality::DOUBLE::INTEGER AS label FROM labels",
)

# --- group folds and result tables ----------------------------------------------------------------------

GROUP_SQL = f"""{BASE_SQL},
folds AS (SELECT (row_number() OVER (PARTITION BY label ORDER BY grp) - 1)::INTEGER AS fold, label, grp FROM (SELECT DISTINCT label, grp FROM vec)),
gpart AS (SELECT part.* EXCLUDE (fold), folds.fold FROM part JOIN folds USING (grp) WHERE folds.fold <> 0),
{_bayes_sql('gpart', 'fold')}"""


def _group_rows(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    df = vectors(spark, folder)
    folds = groups.create_folds(df)
    return groups.with_fold(df, folds).where(F.col("fold") != 0), folds


def _group_predictions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows, folds = _group_rows(spark, folder)
    predicted = gnb.cross_predict(rows).select(
        F.lit("NB").alias("model"), "fold", "id", "label", F.col("prediction").cast("int").alias("prediction")
    )
    return predicted, folds


def _titles(spark: SparkSession, folder: str) -> DataFrame:
    """A title per group, from the names of the nations."""
    return read_table(spark, folder, "nation").select(F.col("n_nationkey").alias("group"), F.col("n_name").alias("title"))


_SCORE_NAMES = ("precision", "recall", "f1", "accuracy")


def _fold_table(spark: SparkSession, folder: str) -> DataFrame:
    predicted, folds = _group_predictions(spark, folder)
    table = reports.fold_result_table(
        predicted.unionByName(predicted.withColumn("model", F.lit("NB2"))),
        folds, groups.group_labels(vectors(spark, folder)), _titles(spark, folder), ["NB", "NB2"],
    )
    return _rounded(table, [f"{m}_{s}" for m in ("NB", "NB2") for s in _SCORE_NAMES])


register(
    "fold_result_table",
    _fold_table,
    f"""WITH {GROUP_SQL}, {_weighted_sql()},
tup AS (SELECT fold, max(grp) FILTER (WHERE label = 0) AS group_0, max(grp) FILTER (WHERE label = 1) AS group_1,
  max(grp) FILTER (WHERE label = 2) AS group_2 FROM folds GROUP BY fold)
SELECT fold, coalesce(group_0, group_1, group_2) AS first_group, group_0, group_1, group_2,
  (coalesce(group_0, group_1, group_2) % 3)::INTEGER AS label, n_name AS title, """
    + ", ".join(
        ", ".join(f"{sql_rounded(m)} AS {p}_{m}" for m in _SCORE_NAMES) + f", support AS {p}_support" for p in ("NB", "NB2")
    )
    + " FROM tup JOIN weighted USING (fold) LEFT JOIN nation ON n_nationkey = coalesce(group_0, group_1, group_2)",
)


def _group_table(spark: SparkSession, folder: str) -> DataFrame:
    predicted, folds = _group_predictions(spark, folder)
    table = reports.group_result_table(predicted, folds, _titles(spark, folder), ["NB"], labels=(0, 1, 2))
    return _rounded(table, [f"NB_{m}" for m in _PRF])


register(
    "group_result_table",
    _group_table,
    f"""WITH {GROUP_SQL}, {_scores_sql('0')}
SELECT scores.fold, scores.label, grp AS "group", n_name AS title, {", ".join(f"{sql_rounded(m)} AS NB_{m}" for m in _PRF)},
  support AS NB_support FROM scores
JOIN folds ON folds.fold = scores.fold AND folds.label = scores.label LEFT JOIN nation ON n_nationkey = grp""",
)
register(
    "score_columns",
    lambda s, f: _rounded(
        metrics.weighted_scores(_group_predictions(s, f)[0], ["model", "fold"])
        .withColumn("score", F.struct("precision", "recall", "f1", "support", "accuracy"))
        .select("fold", "score.*"),
        _SCORE_NAMES,
    ),
    f"WITH {GROUP_SQL}, {_weighted_sql()} SELECT fold, {_shown(_SCORE_NAMES)}, support FROM weighted",
)

# --- discriminant analysis -------------------------------------------------------------------------------

register(
    "lda_moments",
    lambda s, f: _rounded(class_moments(vectors(s, f), ["label"]), ("value",)),
    f"""WITH {BASE_SQL}, one AS (SELECT id, label, unnest(list_concat([1::DOUBLE], x)) AS v, unnest(range(65)) AS d FROM part)
SELECT a.label, a.d::INTEGER AS i, b.d::INTEGER AS j, {sql_rounded('sum(a.v * b.v)')} AS value
FROM one a JOIN one b ON a.id = b.id AND a.d <= b.d GROUP BY ALL""",
)
register(
    "lda_cv_predictions",
    lambda s, f: crossval.lda_cross_predict(folded(s, f)).select("id", "fold", "label", F.col("prediction").cast("int").alias("prediction")),
)

# Three measures are few enough for SQL to invert their scatter by cofactors, so predictions can be compared row by row.
_LDA_MEASURES = ("l_extendedprice", "l_discount", "l_tax")
_LDA_FOLDS = 5


def _measures(spark: SparkSession, folder: str) -> DataFrame:
    """``id, features, label, fold``: low, middle and high charges, to be told from price, discount and tax."""
    charge = F.col("l_extendedprice").cast("double") * (1 - F.col("l_discount").cast("double"))
    return read_table(spark, folder, "lineitem").select(
        (F.col("l_orderkey").cast("long") * 10 + F.col("l_linenumber").cast("long")).alias("id"),
        F.array(*[F.col(c).cast("double") for c in _LDA_MEASURES]).alias("features"),
        F.when(charge <= 35_000, 0).when(charge <= 65_000, 1).otherwise(2).alias("label"),
        F.pmod("l_orderkey", F.lit(_LDA_FOLDS)).cast("int").alias("fold"),
    )


def _measures_sql(training: str) -> str:
    """Predictions of every row by the classes' moments over folds ``t`` that train for fold ``f``."""
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    s = lambda i, j: f"s{min(i % 3, j % 3)}{max(i % 3, j % 3)}"
    # the cofactors of a symmetric matrix, taken round the clock, need no signs
    cofactor = lambda i, j: f"({s(i + 1, j + 1)} * {s(i + 2, j + 2)} - {s(i + 1, j + 2)} * {s(i + 2, j + 1)})"
    det = " + ".join(f"{s(0, j)} * {cofactor(0, j)}" for j in range(3))
    centred = ", ".join(f"{c}::DOUBLE - avg({c}::DOUBLE) OVER () AS x{i}" for i, c in enumerate(_LDA_MEASURES))
    return f"""
li AS (SELECT l_orderkey::BIGINT * 10 + l_linenumber::BIGINT AS id, (l_orderkey % {_LDA_FOLDS})::INTEGER AS fold, {centred},
  l_extendedprice::DOUBLE * (1 - l_discount::DOUBLE) AS charge, CASE WHEN charge <= 35000 THEN 0 WHEN charge <= 65000 THEN 1 ELSE 2 END AS label,
  row_number() OVER () AS r FROM lineitem),
part AS (SELECT fold AS t, label, count(*)::DOUBLE AS n, {", ".join(f"sum(x{i}) AS a{i}" for i in range(3))},
  {", ".join(f"sum(x{i} * x{j}) AS p{i}{j}" for i, j in pairs)} FROM li GROUP BY ALL),
moment AS (SELECT f, label, sum(n) AS n, {", ".join(f"sum(a{i}) / sum(n) AS m{i}" for i in range(3))},
  {", ".join(f"sum(p{i}{j}) - sum(a{i}) * sum(a{j}) / sum(n) AS w{i}{j}" for i, j in pairs)}
  FROM part JOIN (SELECT DISTINCT fold AS f FROM li) ON {training} GROUP BY f, label),
scatter AS (SELECT f, sum(n) AS total, {", ".join(f"sum(w{i}{j}) / (sum(n) - count(*)) AS s{i}{j}" for i, j in pairs)} FROM moment GROUP BY f),
turned AS (SELECT f, label, n / total AS prior, m0, m1, m2,
  {", ".join(f"({' + '.join(f'{cofactor(i, j)} * m{j}' for j in range(3))}) / ({det}) AS c{i}" for i in range(3))} FROM moment JOIN scatter USING (f)),
score AS (SELECT r, id, fold, li.label, turned.label AS guess,
  c0 * (x0 - m0 / 2) + c1 * (x1 - m1 / 2) + c2 * (x2 - m2 / 2) + ln(prior) AS v FROM li JOIN turned ON f = fold),
pred AS (SELECT r, id, fold, label, arg_max(guess, v)::INTEGER AS prediction FROM score GROUP BY ALL)"""


register(
    "lda_measures_predictions",
    lambda s, f: crossval.lda_cross_predict(_measures(s, f)).select("id", "fold", "label", F.col("prediction").cast("int").alias("prediction")),
    f"WITH {_measures_sql('t <> f')} SELECT id, fold, label, prediction FROM pred",
)
register(
    "cv_protocol_predictions",  # fold 0 is kept out of training and scored by the models of all others
    lambda s, f: crossval.cross_validate(ml_ready(_measures(s, f)), {"LDA": MODELS["LDA"]}, test_fold=0, evaluate_holdout=True),
    f"WITH {_measures_sql('t <> f AND t <> 0')} SELECT 'LDA' AS model, fold, id, label, prediction FROM pred",
)
register(
    "cv_protocol_scores",
    lambda s, f: _rounded(
        metrics.weighted_scores(
            crossval.cross_validate(ml_ready(_measures(s, f)), {"LDA": MODELS["LDA"]}, test_fold=0, evaluate_holdout=True), ["model", "fold"]
        ).select("model", "fold", "accuracy"),
        ("accuracy",),
    ),
    f"""WITH {_measures_sql('t <> f AND t <> 0')}
SELECT 'LDA' AS model, fold, {sql_rounded('avg(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS accuracy FROM pred GROUP BY fold""",
)

# --- trained models, checked by tests -----------------------------------------------------------------------


def _holdout(name: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        train, test = split(spark, folder)
        return crossval.train_model(MODELS[name](), ml_ready(train), ml_ready(test), name, 0)

    return run


for _key, _model in (
    ("logistic_regression", "LR"), ("discriminant_analysis", "LDA"), ("nearest_neighbours", "KNN"), ("decision_tree", "CART"),
    ("naive_bayes", "NB"), ("kernel_machine", "SVM"), ("random_forest", "RF"), ("boosted_trees", "XGB"), ("boosted_forest", "XGBRF"),
):
    _by_sql = {
        "KNN": f"WITH {KNN_SQL} SELECT 'KNN' AS model, 0 AS fold, id, label, prediction FROM voted JOIN part USING (id)",
        "NB": f"WITH {BASE_SQL}, {_bayes_sql('part', 'CASE WHEN test THEN 1 ELSE 0 END')}"
        " SELECT model, 0 AS fold, id, label, prediction FROM pred WHERE fold = 1",
    }
    register(f"{_key}_predictions", _holdout(_model), _by_sql.get(_model))

GROUPED = {m: MODELS[m] for m in FOLD_MODELS}
TREES = {m: MODELS[m] for m in ("RF", "XGBRF", "XGB")}


def _cv_models(spark: SparkSession, folder: str) -> DataFrame:
    return crossval.cross_validate(ml_ready(folded(spark, folder)), MODELS)


def _group_cv(spark: SparkSession, folder: str) -> DataFrame:
    df = vectors(spark, folder)
    groups.validate_folds(df)
    folds = groups.create_folds(df)
    return crossval.cross_validate(ml_ready(groups.with_fold(df, folds)), GROUPED, test_fold=0, evaluate_holdout=True)


# --- two classes: the third is dropped, folds are made of what is left, models see two classes only ----------


def _binary_rows(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    df = vectors(spark, folder).where("label < 2")
    folds = groups.create_folds(df, labels=(0, 1))
    return groups.with_fold(df, folds).where("fold <> 0"), folds


def _binary_bayes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows, folds = _binary_rows(spark, folder)
    predicted = gnb.cross_predict(rows)
    return predicted.select(F.lit("NB").alias("model"), "fold", "id", "label", F.col("prediction").cast("int").alias("prediction")), folds


BINARY_SQL = GROUP_SQL.replace("FROM embeddings)", "FROM embeddings WHERE label % 3 < 2)")


def _binary_report(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(metrics.classification_report(_binary_bayes(spark, folder)[0], ["model"], labels=(0, 1)), _PRF)


def _binary_table(spark: SparkSession, folder: str) -> DataFrame:
    predicted, folds = _binary_bayes(spark, folder)
    return _rounded(reports.group_result_table(predicted, folds, _titles(spark, folder), ["NB"], labels=(0, 1)), [f"NB_{m}" for m in _PRF])


register(
    "binary_predictions",
    lambda s, f: _binary_bayes(s, f)[0],
    f"WITH {BINARY_SQL} SELECT model, fold, id, label, prediction FROM pred",
)
register(
    "binary_group_table",
    _binary_table,
    f"""WITH {BINARY_SQL}, {_scores_sql('0').replace('[0, 1, 2]', '[0, 1]')}
SELECT scores.fold, scores.label, grp AS "group", n_name AS title, {", ".join(f"{sql_rounded(m)} AS NB_{m}" for m in _PRF)},
  support AS NB_support FROM scores
JOIN folds ON folds.fold = scores.fold AND folds.label = scores.label LEFT JOIN nation ON n_nationkey = grp""",
)
register(
    "binary_report",
    _binary_report,
    f"""WITH {BINARY_SQL}, {_scores_sql('0', 'model').replace('[0, 1, 2]', '[0, 1]')},
lines AS (SELECT model, label::VARCHAR AS row, precision, recall, f1, support FROM scores
UNION ALL SELECT model, 'accuracy', NULL, NULL, sum(tp)::DOUBLE / sum(support), sum(support) FROM scores GROUP BY model
UNION ALL SELECT model, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM scores GROUP BY model
UNION ALL SELECT model, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
  sum(f1 * support) / sum(support), sum(support) FROM scores GROUP BY model)
SELECT model, row, {_shown(_PRF)}, support::BIGINT AS support FROM lines""",
)


def _binary_cv(spark: SparkSession, folder: str) -> DataFrame:
    """The four models, trained on two classes, with their scores per fold."""
    rows, _ = _binary_rows(spark, folder)
    return metrics.weighted_scores(crossval.cross_validate(ml_ready(rows), GROUPED), ["model", "fold"])


register("binary_cv_scores", _binary_cv)
register("cv_models", lambda s, f: metrics.cv_summary(_cv_models(s, f)))
register("fold_predictions", _group_cv)
register("group_cv_models", lambda s, f: metrics.weighted_scores(_group_cv(s, f), ["model", "fold"]))


def _feature_cv(spark: SparkSession, folder: str) -> DataFrame:
    """From raw text to scores: the feature table, group folds, and LDA over all folds."""
    table = materialize(feature_table(documents(spark, folder), dictionary_counts(spark, folder)))
    assembled = crossval.assemble(table, FEATURE_NAMES).select(
        F.col("doc_id").alias("id"), vector_to_array("features").alias("features"), "label", "group"
    )
    folds = groups.create_folds(assembled)
    rows = groups.with_fold(assembled, folds).where(F.col("fold") != 0)
    predicted = crossval.lda_cross_predict(rows)
    return metrics.weighted_scores(predicted.withColumn("model", F.lit("LDA")), ["model", "fold"])


register("document_cv_scores", _feature_cv)
register(
    "feature_importance",
    lambda s, f: selection.feature_importance(ml_ready(vectors(s, f)), {m: MODELS[m] for m in ("RF", "XGB", "XGBRF")}, NAMES),
)


def _ranks(spark: SparkSession, folder: str) -> DataFrame:
    """One feature per round for every model, from the training rows; saved for the queries that show it."""
    key = ("ranks", spark.sparkContext.applicationId, *sorted(read_table(spark, folder, "embeddings").inputFiles()))
    if key not in _SAVED:
        _SAVED[key] = materialize(selection.rfe_ranks(ml_ready(split(spark, folder)[0]), GROUPED, NAMES))
    return _SAVED[key]


_SAVED: dict[tuple, DataFrame] = {}
register("rfe_ranks", _ranks)
register("rfe_table", lambda s, f: selection.rank_table(_ranks(s, f), FOLD_MODELS))
register("rfe_sorted", lambda s, f: selection.sorted_features(_ranks(s, f), FOLD_MODELS))


def _curve(spark: SparkSession, folder: str, models) -> DataFrame:
    rows, _ = _group_rows(spark, folder)
    ranks = materialize(selection.rfe_ranks(ml_ready(rows), models, NAMES))
    ranked = {m: selection.top_features(ranks, m, len(NAMES)) for m in models}
    return selection.forward_curve(ml_ready(rows), models, NAMES, ranked)


register("forward_curve", lambda s, f: _curve(s, f, {"LDA": GROUPED["LDA"]}))
register(
    "forward_curve_trees",
    lambda s, f: selection.curve_table(_curve(s, f, TREES), ("RF", "XGBRF", "XGB")),
)


_MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
register(
    "assembled_vectors",
    lambda s, f: crossval.assemble(read_table(s, f, "lineitem"), _MEASURES, drop_features=("l_tax",)).select(
        "l_orderkey", "l_linenumber", vector_to_array("features").alias("features")
    ),
    "SELECT l_orderkey, l_linenumber, [l_quantity, l_extendedprice, l_discount] AS features FROM lineitem",
)


def _sliced(spark: SparkSession, folder: str) -> DataFrame:
    """The ten features of largest variance, in that order, as vectors of their own."""
    df = vectors(spark, folder)
    spread = df.select(F.posexplode("features").alias("at", "v")).groupBy("at").agg(F.round(F.var_pop("v"), 9).alias("variance"))
    best = [r["at"] for r in spread.orderBy(F.desc("variance"), "at").limit(10).collect()]
    sliced = VectorSlicer(inputCol="features", outputCol="top", indices=best).transform(ml_ready(df))
    return sliced.select("id", vector_to_array("top").alias("top"), "label", "group")


register(
    "sliced_vectors",
    _sliced,
    f"""WITH {BASE_SQL}, spread AS (SELECT d, round(var_pop(v), 9) AS variance FROM
  (SELECT unnest(x) AS v, unnest(range(1, 65)) AS d FROM part) GROUP BY d),
best AS (SELECT list(d ORDER BY variance DESC, d) AS picked FROM (SELECT * FROM spread ORDER BY variance DESC, d LIMIT 10))
SELECT id, list_transform(picked, lambda i: x[i]) AS top, label, grp AS "group" FROM part, best""",
)
