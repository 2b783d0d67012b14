"""Sinks: CSV, JSON, Parquet and one text per document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgrade.sources.named_files import FORMAT, NamedTextFiles


def write_csv(df: DataFrame, path: str, null_value: str = "_") -> None:
    """Headed CSV with doubled quotes; blanks at the ends of a text and empty texts stay what they are."""
    writer = df.write.option("header", True).option("escape", '"').option("nullValue", null_value).option("emptyValue", '""')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_frequencies(df: DataFrame, path: str) -> None:
    """Headerless tab-separated dictionary without quoting, missing values empty."""
    df.write.option("sep", "\t").option("quote", "").option("nullValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, one object per row."""
    df.write.json(path)


def write_documents(df: DataFrame, path: str) -> None:
    """Parquet table ``name, text``: the form later stages read."""
    df.select("name", "text").write.parquet(path)


def write_text_per_name(df: DataFrame, path: str) -> None:
    """One file per row of ``name, text`` in a folder that is new or empty, line ends untouched, a null text as an empty file.

    Names that repeat, are null, or can't be the name of a file that Spark reads raise before anything is
    written. ``df`` is read twice, so give a saved table where it is dear to compute.
    """
    unfit = F.col("name").isNull() | ~F.coalesce("name", F.lit("")).rlike(r"^[^/\x00._][^/\x00]*$")
    wrong = df.groupBy("name").agg(F.count("*").alias("n")).where((F.col("n") > 1) | unfit)
    shown = [str(r["name"]) for r in wrong.limit(20).collect()]
    if shown:
        raise ValueError("names that repeat or can't be file names: " + ", ".join(sorted(shown)))
    df.sparkSession.dataSource.register(NamedTextFiles)
    df.select("name", F.col("text").cast("string").alias("text")).write.format(FORMAT).mode("append").save(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """Long prediction table, one folder per model."""
    df.write.partitionBy("model").parquet(path)
