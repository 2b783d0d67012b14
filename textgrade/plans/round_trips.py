"""Queries that write given tables through the sinks and read them back through the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textgrade.plans.document_features import NAMED_SQL, named_documents
from textgrade.plans.registry import register
from textgrade.session import shared_folder
from textgrade.sources import sinks, tables
from textgrade.sources.tables import read_table
from textgrade.sources.text import read_documents

MODELS = ("LDA", "RF")


def _place(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/written-{uuid.uuid4().hex}"


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return named_documents(read_table(spark, folder, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


def text_files(spark: SparkSession, folder: str, glob: str = "*.txt") -> DataFrame:
    """Every document as a file of its own, and the files of a glob read back whole; Spark passes over empty ones."""
    path = _place(spark)
    sinks.write_text_per_name(_documents(spark, folder), path)
    return read_documents(spark, path, glob)


register(
    "text_files_round_trip",
    text_files,
    f"WITH {NAMED_SQL} SELECT name AS file_name, text FROM named WHERE text <> ''",
)
register(
    "text_files_by_prefix",
    lambda s, f: text_files(s, f, "0*_Edika_a1-a2_*.txt").select("file_name", F.length("text").alias("n_chars")),
    f"WITH {NAMED_SQL} SELECT name AS file_name, length(text)::INTEGER AS n_chars FROM named WHERE text <> '' AND label = 0 AND doc_id % 10000 < 1000",
)


def labelled_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """``label, name, text`` by way of a CSV corpus whose cells hold line breaks and quotes."""
    path = _place(spark)
    sinks.write_csv(_documents(spark, folder).select("label", "name", "text"), path, null_value="")
    return tables.read_labelled(spark, path, (0, 1, 2))


register("csv_corpus_round_trip", labelled_corpus, f"WITH {NAMED_SQL} SELECT label, name, text FROM named")


def missing_values(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations by way of a CSV file in which ``_`` is missing, and other words are not."""
    path = _place(spark)
    turns = read_table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    sinks.write_csv(turns, path)
    return tables.read_csv(spark, path, turns.schema, multi_line=True)


register("csv_missing_round_trip", missing_values, "SELECT conv_id, turn, role, text FROM conversations")


def json_rows(spark: SparkSession, folder: str) -> DataFrame:
    path = _place(spark)
    docs = _documents(spark, folder).select("name", "label", "n_chars", "text")
    sinks.write_json(docs, path)
    return spark.read.schema(docs.schema).json(path)


register("json_round_trip", json_rows, f"WITH {NAMED_SQL} SELECT name, label, n_chars, text FROM named")


def document_table(spark: SparkSession, folder: str) -> DataFrame:
    path = _place(spark)
    sinks.write_documents(_documents(spark, folder), path)
    return spark.read.parquet(path)


register("document_table_round_trip", document_table, f"WITH {NAMED_SQL} SELECT name, text FROM named")


def dictionary_file(spark: SparkSession, folder: str) -> DataFrame:
    """Words of the documents with their counts, by way of a tab-separated dictionary without quoting."""
    path = _place(spark)
    words = read_table(spark, folder, "documents").select(F.explode(F.split(F.col("text"), r"[\s]+")).alias("form"))
    counts = words.where("form <> ''").groupBy("form").agg(F.count("*").cast("double").alias("freq"))
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in tables.FREQUENCY_SCHEMA[3:]]
    sinks.write_frequencies(counts.select(F.lit(None).cast("double").alias("rank"), "form", "freq", *blank), path)
    return tables.read_frequencies(spark, path).select("form", "freq")


register(
    "dictionary_round_trip",
    dictionary_file,
    r"SELECT form, count(*)::DOUBLE AS freq FROM (SELECT unnest(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+')) AS form FROM documents)"
    " WHERE form <> '' GROUP BY form",
)


def ranking_file(spark: SparkSession, folder: str) -> DataFrame:
    """Two rankings of the parts side by side in a CSV file, read back as long rows."""
    path = _place(spark)
    parts = read_table(spark, folder, "part")
    name = F.concat(F.lit("part "), F.col("p_partkey").cast("string"))
    sinks.write_csv(parts.select(name.alias("feat"), F.col("p_partkey").cast("int").alias("LDA"), F.col("p_size").cast("int").alias("RF")), path)
    return tables.read_rankings(spark, path, MODELS)


register(
    "ranking_round_trip",
    ranking_file,
    "SELECT 'LDA' AS model, 'part ' || p_partkey AS feat, p_partkey::INTEGER AS rank FROM part"
    " UNION ALL SELECT 'RF', 'part ' || p_partkey, p_size::INTEGER FROM part",
)
