"""Seeded shuffles, folds and splits that come out the same on any partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textgrade.fixed_values import SEED
from textgrade.operators.ranking import number_rows, seeded_key

TEST_SHARE = 0.2


def shuffled(df: DataFrame, key: str, seed: int = SEED) -> DataFrame:
    """Add ``position``, the place of each row in the seeded order."""
    return number_rows(df, seeded_key(key, seed), tie=[key])


def k_folds(df: DataFrame, key: str, k: int = 10, seed: int = SEED) -> DataFrame:
    """Add ``fold`` 0..k-1; fold sizes differ by one row at most."""
    numbered = number_rows(df, seeded_key(key, seed), out="_n", tie=[key])
    return numbered.withColumn("fold", F.pmod(F.col("_n") - 1, F.lit(k)).cast("int")).drop("_n")


def hash_folds(df: DataFrame, key: str, k: int = 10, seed: int = SEED) -> DataFrame:
    """Add ``fold`` by hash: no numbering and no shuffle, sizes even only on average."""
    number = F.conv(F.substring(seeded_key(key, seed), 1, 8), 16, 10).cast("long")
    return df.withColumn("fold", F.pmod(number, F.lit(k)).cast("int"))


def train_test_split(df: DataFrame, key: str, share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Add ``part``: exactly the ceiling of ``share`` of the rows is test."""
    numbered = number_rows(df, seeded_key(key, seed), out="_n", tie=[key], total="_total")
    test = F.col("_n") > F.col("_total") - F.ceil(F.col("_total") * F.lit(share))
    return numbered.withColumn("part", F.when(test, "test").otherwise("train")).drop("_n", "_total")


def stratified_split(df: DataFrame, key: str, label: str, share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Add ``part``: test rows per label in proportion, their sum the ceiling of the share.

    What rounding down leaves over goes to the labels with the largest remainders.
    """
    classes = df.groupBy(label).agg(F.count("*").alias("_c"))
    everything = Window.partitionBy()
    wanted = F.col("_c") * F.lit(share)
    base = classes.withColumn("_base", F.floor(wanted)).withColumn("_rest", F.round(wanted - F.floor(wanted), 9))
    spare = F.ceil(F.sum("_c").over(everything) * F.lit(share)) - F.sum("_base").over(everything)
    turn = F.row_number().over(Window.orderBy(F.desc("_rest"), label))
    quotas = base.withColumn("_spare", spare).select(
        F.col(label).alias("_label"), (F.col("_base") + F.when(turn <= F.col("_spare"), 1).otherwise(0)).alias("_quota")
    )
    numbered = number_rows(df, seeded_key(key, seed), out="_n", partition_by=[label], tie=[key])
    joined = numbered.join(quotas, F.col(label).eqNullSafe(F.col("_label")))
    test = F.col("_n") <= F.col("_quota")
    return joined.withColumn("part", F.when(test, "test").otherwise("train")).select(*df.columns, "part")


def head(df: DataFrame, order: Sequence[str], n: int = 20) -> DataFrame:
    """The first rows in key order."""
    return df.orderBy(*order).limit(n)
