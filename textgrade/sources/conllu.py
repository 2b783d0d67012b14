"""CoNLL-U source: annotated sentences as a token table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textgrade.operators.annotate import feature_map


def read_conllu(spark: SparkSession, path: str) -> DataFrame:
    """Token table of CoNLL-U files; every sentence block carries ``# doc_id`` and ``# sent_id``."""
    blocks = spark.read.text(path, lineSep="\n\n").select(F.col("value").alias("block"))
    doc = F.regexp_extract("block", r"(?m)^# doc_id = (.*)$", 1).try_cast("long")
    sent = F.regexp_extract("block", r"(?m)^# sent_id = (.*)$", 1).try_cast("int")
    return parse_blocks(blocks.select(doc.alias("doc_id"), sent.alias("sent_id"), "block"))


def parse_blocks(blocks: DataFrame) -> DataFrame:
    """Token rows of ``doc_id, sent_id, block`` rows; comments, ranges and empty nodes are skipped."""
    lines = blocks.select("doc_id", "sent_id", F.explode(F.split("block", "\n")).alias("line"))
    words = lines.where(F.col("line").rlike(r"^[0-9]+\t")).select(
        "doc_id", "sent_id", F.split("line", "\t").alias("f")
    )

    def field(i: int) -> Column:
        return F.get("f", F.lit(i))

    lemma = F.when((field(2) != "_") | (field(1) == "_"), field(2))
    return words.select(
        "doc_id",
        "sent_id",
        field(0).cast("int").alias("word_id"),
        field(1).alias("text"),
        lemma.alias("lemma"),
        F.nullif(field(3), F.lit("_")).alias("upos"),
        feature_map(field(5)).alias("feats"),
        field(6).try_cast("int").alias("head"),
    )


def to_line(feats: Column) -> Column:
    """One CoNLL-U line from the columns of a token table."""
    missing = F.lit("_")
    return F.concat_ws(
        "\t",
        F.col("word_id").cast("string"),
        F.coalesce("text", missing),
        F.coalesce("lemma", missing),
        F.coalesce("upos", missing),
        missing,
        feats,
        F.coalesce(F.col("head").cast("string"), missing),
        missing,
        missing,
        missing,
    )


def to_blocks(lines: DataFrame) -> DataFrame:
    """``doc_id, sent_id, block`` of ``doc_id, sent_id, word_id, line`` rows in which a sentence's words follow one another.

    Token tables are made so, sentence by sentence, and nothing is shuffled. Where another sentence comes, or
    ``word_id`` does not rise, a new block begins: words out of order make more blocks, none is lost.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rows: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if open_rows is None else pa.concat_tables([open_rows, rows])
            starts = _starts(rows)
            if len(starts) > 1:  # the last sentence may go on in the next batch
                yield from _joined(rows.slice(0, starts[-1]), starts[:-1])
            open_rows = rows.slice(starts[-1]) if len(starts) else rows
        if open_rows is not None and open_rows.num_rows:
            yield from _joined(open_rows, _starts(open_rows))

    schema = lines.select("doc_id", "sent_id", F.lit("").alias("block")).schema
    return lines.select("doc_id", "sent_id", "word_id", "line").mapInArrow(run, schema)


def _starts(rows: pa.Table) -> np.ndarray:
    if not rows.num_rows:
        return np.zeros(0, np.int64)
    new = np.diff(rows["word_id"].to_numpy()) <= 0
    for key in ("doc_id", "sent_id"):
        values = rows[key].combine_chunks()
        missing = values.is_null().to_numpy(zero_copy_only=False)
        known = pc.fill_null(values, pa.scalar(0, values.type)).to_numpy(zero_copy_only=False)
        new |= (np.diff(known) != 0) | (missing[1:] != missing[:-1])
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def _joined(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    offsets = pa.array(np.append(starts, rows.num_rows).astype(np.int32))
    blocks = pc.binary_join(pa.ListArray.from_arrays(offsets, pa.concat_arrays([c.cast(pa.string()) for c in rows["line"].chunks])), "\n")
    first = rows.select(["doc_id", "sent_id"]).take(pa.array(starts)).combine_chunks()
    yield pa.RecordBatch.from_arrays([first["doc_id"].combine_chunks(), first["sent_id"].combine_chunks(), blocks], ["doc_id", "sent_id", "block"])


def feature_string(feats: Column) -> Column:
    """``Key=Val|Key=Val`` in key order, ``_`` when there are none."""
    pairs = F.transform(F.array_sort(F.map_entries(feats)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return F.coalesce(F.nullif(F.array_join(pairs, "|"), F.lit("")), F.lit("_"))
