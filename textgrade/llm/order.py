"""Documents in id order over many tasks, each with its successor at hand."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgrade.llm.common import cell_count

CELL_BYTES = 64 << 20  # of text in a cell at most, on average
CELLS_A_PARTITION = 4


def in_order(docs: DataFrame, id_col: str, text_col: str, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """``cell, extra, doc_id, text``: ranges of ids as cells, each partition sorted, rows of a cell together.

    The last row of a cell (``extra`` is true) is a copy of the first row that follows in the order of
    all documents, and of the very first one in the last cell. So every row that is not ``extra`` has its
    successor right after it. The bounds of the ranges are approximate quantiles of the ids; like those of
    any range partitioning there is one for each cell. Null ids come first; equal ids go by text.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * CELLS_A_PARTITION
    cells = max(spread, cell_count(rows, "text", cell_bytes))
    marks = ids.agg(F.percentile_approx("doc_id", [i / cells for i in range(1, cells)], 100 * cells)).first()[0] if cells > 1 else []
    bounds = np.unique(np.array(marks or [], np.int64))

    @F.pandas_udf("int")
    def cell_of(doc_id: pd.Series) -> pd.Series:
        known = doc_id.notna().to_numpy()
        out = np.zeros(len(doc_id), np.int32)
        out[known] = 1 + np.searchsorted(bounds, doc_id[known].astype("int64").to_numpy(), side="right")
        return pd.Series(out)

    firsts = ids.groupBy(cell_of("doc_id").alias("cell")).agg(F.min("doc_id").alias("doc_id")).collect()
    used = sorted((r["cell"], r["doc_id"]) for r in firsts)
    goes_to = {used[i][0]: used[i - 1][0] for i in range(len(used))}  # the cell before; the last for the first
    first_id = dict(used)
    spark = docs.sparkSession
    placed = rows.withColumn("cell", cell_of("doc_id"))
    if not used:
        return placed.select("cell", F.lit(False).alias("extra"), "doc_id", "text")
    table = spark.createDataFrame([(c, first_id[c], goes_to[c]) for c in goes_to], "cell int, least long, before int")
    copies = placed.join(F.broadcast(table), "cell").withColumn("to", F.when(F.col("doc_id").eqNullSafe(F.col("least")), F.col("before")))
    sent = copies.select(
        F.explode(
            F.array_compact(
                F.array(
                    F.struct(F.col("cell"), F.lit(False).alias("extra")),
                    F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("cell"), F.lit(True).alias("extra"))),
                )
            )
        ).alias("at"),
        "doc_id",
        "text",
    ).select("at.*", "doc_id", "text")
    return sent.repartition("cell").sortWithinPartitions("cell", "extra", F.col("doc_id").asc_nulls_first(), F.md5(F.col("text").cast("binary")))


def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str], list[str]]]:
    """Over a partition of :func:`in_order`: ids, texts and the texts that follow, in small lists.

    Of several rows that could follow the last of a cell, the first counts.
    """
    ids, texts, cells, size = [], [], [], 0
    last_was_extra = None

    def give(upto: int):
        return ids[:upto], texts[:upto], texts[1 : upto + 1]

    for batch in batches:
        for cell, extra, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if extra:
                if last_was_extra == cell:
                    continue
                last_was_extra = cell
                texts.append(text)
                yield give(len(ids))
                ids, texts, size = [], [], 0
                continue
            ids.append(doc_id)
            texts.append(text)
            size += len(text)
            if size > 4 << 20 and len(ids) > 1:
                yield give(len(ids) - 1)
                ids, texts, size = ids[-1:], texts[-1:], len(text)
