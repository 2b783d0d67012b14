"""Groups (one per book title), folds of groups, and the train/validation roles they give."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textgrade.fixed_values import SEED, THIRD_CLASS_FIRST_GROUP, THIRD_CLASS_GROUPS, THIRD_CORPUS_TITLE
from textgrade.functions.names import title
from textgrade.operators.ranking import number_rows, seeded_key
from textgrade.session import materialize

FOLD_BLOCK = 1024
DIGITS = 6  # spreads of folds, in rows, that agree so far are equal


def title_groups(df: DataFrame, seed: int = SEED) -> DataFrame:
    """Group number from 0 per distinct book title, in seeded order."""
    titles = df.select(title(F.col("name")).alias("title")).where(F.col("title") != THIRD_CORPUS_TITLE).distinct()
    numbered = number_rows(titles, seeded_key("title", seed), out="_n", tie=["title"])
    return numbered.select("title", (F.col("_n") - 1).cast("int").alias("group"))


def round_robin_groups(
    df: DataFrame, first: int = THIRD_CLASS_FIRST_GROUP, groups: int = THIRD_CLASS_GROUPS, seed: int = SEED
) -> DataFrame:
    """Third-corpus rows with ``group``: dealt in seeded order over ``groups`` numbers from ``first`` on.

    Where books have more titles than ``first``, the numbers begin after theirs.
    """
    titles = df.select(title(F.col("name")).alias("title")).where(F.col("title") != THIRD_CORPUS_TITLE)
    begin = F.greatest(F.lit(first).cast("long"), titles.agg(F.countDistinct("title")).scalar())
    third = df.where(title(F.col("name")) == THIRD_CORPUS_TITLE)
    numbered = number_rows(third, seeded_key("name", seed), out="_n", tie=["name"])
    turn = (begin + F.pmod(F.col("_n") - 1, F.lit(groups))).cast("int")
    return numbered.select(*df.columns, turn.alias("group"))


def with_groups(df: DataFrame, seed: int = SEED) -> DataFrame:
    """Add ``group``: by title for books, by turns for the third corpus, NULL for other names.

    The three kinds are handled apart, so that the third corpus, one title for any number of rows,
    never meets the join on titles.
    """
    titled = df.withColumn("title", title(F.col("name")))
    books = titled.where(F.col("title") != THIRD_CORPUS_TITLE).join(title_groups(df, seed), "title").select(*df.columns, "group")
    others = titled.where(F.col("title").isNull()).select(*df.columns, F.lit(None).cast("int").alias("group"))
    return books.unionByName(round_robin_groups(df, seed=seed)).unionByName(others)


def group_labels(df: DataFrame) -> DataFrame:
    """One label per group; the highest label of a group counts."""
    return df.groupBy("group").agg(F.max("label").alias("label"))


def group_titles(df: DataFrame) -> DataFrame:
    """One title per group: that of the last name in order."""
    return df.groupBy("group").agg(F.max_by(title(F.col("name")), F.col("name")).alias("title"))


def label_conflicts(df: DataFrame) -> DataFrame:
    """Groups seen under more than one label; they would sit in training and validation at once."""
    seen = df.select("group", "label").distinct().groupBy("group").agg(F.count("*").alias("n_labels"))
    return seen.where(F.col("n_labels") > 1)


def validate_folds(df: DataFrame) -> None:
    """Raise when a group has more than one label."""
    conflicts = label_conflicts(df)
    total, shown = conflicts.agg(F.count("*")).first()[0], conflicts.orderBy("group").limit(20).collect()
    if total:
        raise ValueError("groups with more than one label: " + ", ".join(str(r["group"]) for r in shown) + f" ({total} in all)")


def create_folds(df: DataFrame, labels: Sequence[int] = (0, 1, 2), n_folds: int | None = None) -> DataFrame:
    """``fold, label, group``: the n-th group of every label forms fold n; fold 0 is the test fold.

    Labels with fewer groups are absent from the last folds. ``n_folds`` deals the groups over that
    many folds instead of one fold per group rank.
    """
    pairs = df.where(F.col("label").isin(*labels)).select("label", "group").distinct()
    block = F.floor(F.col("group") / FOLD_BLOCK)
    numbered = number_rows(pairs, F.col("group"), out="_n", partition_by=["label"], bucket=block)
    fold = F.col("_n") - 1
    if n_folds:
        fold = F.pmod(fold, F.lit(n_folds))
    return numbered.select(fold.cast("int").alias("fold"), "label", "group")


def fold_tuples(folds: DataFrame, labels: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """One row per fold with the group of each label side by side, NULL where a label has run out."""
    columns = [F.max(F.when(F.col("label") == l, F.col("group"))).alias(f"group_{l}") for l in labels]
    return folds.groupBy("fold").agg(*columns)


def with_fold(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Add the fold of each row's group."""
    return df.join(folds.select("group", "fold").distinct(), "group")


def train_validation_split(df: DataFrame, folds: DataFrame, validation: int, test: int = 0) -> DataFrame:
    """Rows of the training folds with ``role`` val or train; the test fold is left out."""
    role = F.when(F.col("fold") == validation, "val").otherwise("train")
    return with_fold(df, folds).where(F.col("fold") != test).withColumn("role", role)


def three_way_split(df: DataFrame, folds: DataFrame, validation: int, test: int = 0) -> DataFrame:
    """All rows with ``role`` val, test or train, train being the rows in neither of the other two."""
    special = folds.where(F.col("fold").isin(validation, test)).select("group", "fold").distinct()
    role = F.when(F.col("fold") == validation, "val").when(F.col("fold") == test, "test").otherwise("train")
    return df.join(special, "group", "left").select(*df.columns, role.alias("role"))


def fold_sizes(df: DataFrame, folds: DataFrame, test: int = 0) -> DataFrame:
    """Rows in validation and training for every fold; training is the total less the fold."""
    per_fold = with_fold(df, folds).where(F.col("fold") != test).groupBy("fold").agg(F.count("*").alias("n_val"))
    total = F.sum("n_val").over(Window.partitionBy())
    return per_fold.select("fold", "n_val", (total - F.col("n_val")).alias("n_train"))


def training_groups(folds: DataFrame, validation: int, test: int = 0) -> DataFrame:
    """Distinct groups of all folds but the validation and the test fold."""
    return folds.where(~F.col("fold").isin(validation, test)).select("group").distinct()


def deal_kinds(kinds: Sequence[tuple[Sequence[int], int]], k: int) -> list[tuple[list[int], list[int]]]:
    """Folds for ``(class counts, groups)`` kinds, in the given order: what the first groups of a kind get, and a cycle for the rest.

    Each group goes to the fold that leaves the spread of the classes over the folds least, spreads being
    summed over the classes with every class given equal weight; then to the fold with fewest rows, then the
    first. A group more in every fold changes no spread, so once ``k`` groups of a kind have gone to ``k``
    different folds, their order repeats and the rest of the kind is dealt at once.
    """
    if not kinds:
        return []
    counts = np.array([c for c, _ in kinds], dtype=np.int64)
    total = (counts * np.array([m for _, m in kinds])[:, None]).sum(axis=0)
    weight = total.sum() / np.maximum(total, 1)
    state = np.zeros((k, counts.shape[1]), np.int64)
    out = []
    for vector, (_, n) in zip(counts, kinds):
        first: list[int] = []
        while len(first) < n and len(set(first[-k:])) < k:
            level = (state - state.min(axis=0)).astype(float)  # spreads do not depend on what all folds share
            squares = (level**2).sum(axis=0) - level**2 + (level + vector) ** 2
            variance = squares / k - ((level.sum(axis=0) + vector) / k) ** 2
            spread = (np.sqrt(np.maximum(variance, 0)) * weight).sum(axis=1).round(DIGITS)
            fold = min(range(k), key=lambda f: (spread[f], state[f].sum(), f))
            state[fold] += vector
            first.append(fold)
        cycle = first[-k:]
        rounds, rest = divmod(n - len(first), k)
        state += vector * rounds
        for fold in cycle[:rest]:
            state[fold] += vector
        out.append((first, cycle))
    return out


def stratified_group_folds(df: DataFrame, k: int) -> DataFrame:
    """``group, main, n, fold`` in k folds alike in class mix, groups whose class counts differ most being placed first.

    Equal counts make groups alike, so only the distinct kinds of counts come to the driver: with one label a
    group there are at most about sqrt(2 x rows) of them a class. Spark numbers the groups of a kind and looks
    their folds up; ties go by class counts, then by group.
    """
    counts = df.groupBy("group", "label").agg(F.count("*").alias("n"))
    mixes = materialize(
        counts.groupBy("group").agg(
            F.max_by("label", F.struct(F.col("n"), -F.col("label"))).alias("main"),
            F.sum("n").alias("n"),
            F.to_json(F.sort_array(F.collect_list(F.struct("label", "n")))).alias("kind"),  # an entry per class
        )
    )
    found = [({e.get("label"): e["n"] for e in json.loads(r["kind"])}, r["kind"], r["m"]) for r in mixes.groupBy("kind").agg(F.count("*").alias("m")).collect()]
    labels = sorted({label for mix, _, _ in found for label in mix}, key=lambda label: (label is not None, label))
    kinds = [([mix.get(label, 0) for label in labels], kind, m) for mix, kind, m in found]
    # variance over the classes, times their number twice so that it stays whole
    kinds.sort(key=lambda e: (sum(e[0]) ** 2 - len(labels) * sum(n * n for n in e[0]), e[0]))
    dealt = deal_kinds([(vector, m) for vector, _, m in kinds], k)
    rows = [(kind, first, cycle) for (_, kind, _), (first, cycle) in zip(kinds, dealt)]
    folds = df.sparkSession.createDataFrame(rows, "kind string, first array<int>, cycle array<int>")
    numbered = number_rows(mixes, F.col("group"), out="_n", partition_by=["kind"], bucket=F.floor(F.col("group") / FOLD_BLOCK))
    later = F.pmod(F.col("_n") - 1 - F.size("first"), F.size("cycle"))
    fold = F.when(F.col("_n") <= F.size("first"), F.get("first", F.col("_n") - 1)).otherwise(F.get("cycle", later))
    return numbered.join(folds, "kind").select("group", "main", "n", fold.cast("int").alias("fold"))


def lookup_by_group(df: DataFrame, labels: DataFrame, titles: DataFrame) -> DataFrame:
    """Add the label and title columns of each row's group."""
    return df.join(labels, "group", "left").join(titles, "group", "left")
