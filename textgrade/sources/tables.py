"""Typed table sources: labelled corpora, feature files, dictionaries, rankings, Parquet tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textgrade.fixed_values import FEATURE_HEADERS

CORPUS_SCHEMA = T.StructType(
    [T.StructField("label", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("text", T.StringType())]
)
FREQUENCY_SCHEMA = T.StructType(
    [
        T.StructField("rank", T.DoubleType()),
        T.StructField("form", T.StringType()),
        T.StructField("freq", T.DoubleType()),
        T.StructField("recalc_freq", T.DoubleType()),
        T.StructField("fict_freq", T.DoubleType()),
        T.StructField("branch_freq", T.DoubleType()),
        T.StructField("journal_freq", T.DoubleType()),
        T.StructField("freq_char", T.StringType()),
    ]
)
FEATURE_FILE_SCHEMA = T.StructType(
    [T.StructField("name", T.StringType())]
    + [T.StructField(header, T.DoubleType()) for header in FEATURE_HEADERS]
    + [T.StructField("group", T.IntegerType()), T.StructField("label", T.IntegerType())]
)


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, null_value: str | None = "_", multi_line: bool = False
) -> DataFrame:
    """Headed CSV with doubled quotes; with ``multi_line`` cells may hold line breaks, and one file is one task.

    Only ``null_value`` is missing, so ``NA`` stays text; with None the empty cell is missing too.
    """
    reader = spark.read.schema(schema).option("header", True).option("multiLine", multi_line).option("escape", '"')
    reader = reader.option("nullValue", "" if null_value is None else null_value)
    return reader.csv(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Feature file with our column names; cells that are not numbers, such as ``NA``, become NULL."""
    as_text = T.StructType(
        [T.StructField(f.name, T.StringType() if f.dataType == T.DoubleType() else f.dataType) for f in FEATURE_FILE_SCHEMA]
    )
    raw = read_csv(spark, path, as_text)
    numbers = [F.col(f"`{header}`").try_cast("double").alias(col) for header, col in FEATURE_HEADERS.items()]
    return raw.select("name", *numbers, "group", "label")


def read_labelled(spark: SparkSession, path: str, classes: Sequence[int]) -> DataFrame:
    """Corpus with declared classes; a label outside of them raises when it is read."""
    df = read_csv(spark, path, CORPUS_SCHEMA, null_value=None, multi_line=True)
    wrong = F.raise_error(F.concat(F.lit("undeclared label "), F.coalesce(F.col("label").cast("string"), F.lit("NULL"))))
    checked = F.when(F.col("label").isin(*classes), F.col("label")).otherwise(wrong.cast("int"))
    return df.select(checked.alias("label"), "name", "text")


def read_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """Headerless tab-separated dictionary with the place of every row.

    Quoting is off and only an empty cell is missing: a bare quote mark and ``null`` are words.
    ``file``, ``split`` and ``row`` give the order of the rows; ``split`` rises inside a file.
    """
    reader = spark.read.schema(FREQUENCY_SCHEMA).option("sep", "\t").option("quote", "").option("nullValue", "")
    df = reader.csv(path)
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"),
    )


def read_rankings(spark: SparkSession, path: str, models: Sequence[str]) -> DataFrame:
    """Feature ranks, one column per model, as long rows ``model, feat, rank``."""
    schema = T.StructType(
        [T.StructField("feat", T.StringType())] + [T.StructField(m, T.IntegerType()) for m in models]
    )
    return read_csv(spark, path, schema).unpivot("feat", list(models), "model", "rank")


def read_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def spread(df: DataFrame, key: str, partitions: int) -> DataFrame:
    """``df`` dealt over a given number of partitions, for tables in fewer files than there are cores."""
    return df.repartition(partitions, F.xxhash64(key))
