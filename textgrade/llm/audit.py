"""Filter interaction audit: what each filter removes, in every order in which the filters can be applied.

The filters a row fails are a mask. A row of a mask matrix has 0 where the filter fails and infinity
elsewhere; an order is a column of positions, its inverse permutation. Their min-plus product is the step
at which a row of this mask goes under this order, infinity if it stays. Masks are all a row matters by,
so Spark counts rows by part, mask and labels first; the weights of the 2^k masks of a part are then
scattered over its (order, step) cells, and what is redundant, lost or shared follows from the same steps.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textgrade.llm.common import saved

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT, UPPER = 200, 50, 2  # words; distinct words and capital letters of a hundred
SPACE = r"[ \t\n\x0B\f\r]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
STAYS = 1 << 20  # stands for infinity


def failing(text: Column) -> list[Column]:
    """Whether ``text`` fails A to D: few words, few distinct words, many capital letters, odd signs."""
    words = F.array_remove(F.split(text, SPACE), "")
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [
        n < MIN_WORDS,
        100 * F.size(F.array_distinct(words)) < DISTINCT * n,
        100 * capitals > UPPER * F.length(text),
        text.rlike("[#$%&*|]"),
    ]


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: rows by source and failing filters, filter ``A`` being bit 0.

    E fails where a smaller ``doc_id`` has the same text: texts are compared by SHA-256 and each is looked
    up by its least id, so a text that many rows share is one row of the lookup. Null texts are empty, a
    null source is the empty string; null ids are smaller than none and never fail E. A row is good or toxic
    if any label of its id says so. Every row counts, repeated ones too; other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    seen = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    bits = [fails.cast("int") * (1 << i) for i, fails in enumerate(failing(F.col("text")))]
    seen = seen.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum(bits[1:], bits[0]).alias("mask"))
    # rows equal in all that is counted are one row from here on
    facts = saved(seen.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n")))
    said = labels.groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    # by text and id at once, so that a text of many ids is no hot key: rows that meet nothing have a smaller id before them
    least = facts.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(0))
    later = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.coalesce("first", F.lit(1))) * (1 << FILTERS.index("E"))
    marked = facts.join(least, ["digest", "doc_id"], "left").withColumn("mask", F.col("mask") + later)
    marked = marked.join(said, "doc_id", "left")
    return marked.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"),
    )


def removal_steps(n_filters: int) -> tuple[np.ndarray, np.ndarray]:
    """All orders of the filters, and ``steps[mask, order]``: the step from 0 at which a mask goes, or ``STAYS``."""
    orders = np.array(list(permutations(range(n_filters))))
    position = np.argsort(orders, axis=1)  # inverse permutations
    masks = (np.arange(1 << n_filters)[:, None] >> np.arange(n_filters)) & 1
    barred = np.where(masks == 1, 0, STAYS)
    # min-plus product of the mask matrix with the position matrix
    return orders, (barred[:, None, :] + position[None, :, :]).min(axis=2).clip(max=STAYS)


def interactions(counts: np.ndarray, orders: np.ndarray, steps: np.ndarray) -> dict[str, np.ndarray]:
    """``COUNTS`` as arrays (part, order, step) from ``counts[part, mask, (n, good, toxic)]``."""
    n_orders, k = orders.shape
    parts, n_masks = counts.shape[:2]
    goes = np.zeros((parts, 3, n_orders, k), np.int64)
    mask, order = np.nonzero(steps < k)
    where = order * k + steps[mask, order]
    weights = counts.transpose(0, 2, 1)[:, :, mask].reshape(parts * 3, -1)
    flat = goes.reshape(parts * 3, n_orders * k)
    for row, weight in zip(flat, weights):
        np.add.at(row, where, weight)
    removed = goes[:, 0]
    total = counts[:, :, 0].sum(axis=1)
    fails = (np.arange(n_masks)[:, None] >> np.arange(k)) & 1
    failed = counts[:, :, 0] @ fails  # part, filter
    alone = counts[:, 1 << np.arange(k), 0]
    shares = np.zeros((parts, k), np.int64)
    for f in range(k):
        shares[:, f] = removed[:, orders == f].sum(axis=1)
    return {
        "kept": total[:, None, None] - removed.cumsum(axis=2),
        "removed": removed,
        "redundant": failed[:, orders] - removed,
        "unique_fails": alone[:, orders],
        "good_lost": goes[:, 1],
        "toxic_lost": goes[:, 2],
        "shapley": shares[:, orders],
    }


def audit(counts: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """``part, filter_order, step`` and ``COUNTS``: a row for every part, order of ``filters`` and step.

    ``counts`` has ``part, mask, n, good, toxic``, a part and mask once. ``removed`` rows go at this step,
    ``redundant`` ones fail its filter but went before, ``unique_fails`` fail no other; ``shapley`` is what
    the step's filter removes in all orders together. Without counts there are no rows.
    """
    k = len(filters)
    cells = F.sort_array(F.collect_list(F.struct("mask", "n", "good", "toxic")))  # at most 2^k of a part
    by_part = counts.groupBy("part").agg(cells.alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, steps = removal_steps(k)
        names = ["".join(filters[f] for f in order) for order in orders]
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                few = batch.slice(at, 64)
                table = np.zeros((few.num_rows, 1 << k, 3), np.int64)
                for i, found in enumerate(few.column(1).to_pylist()):
                    for cell in found:
                        table[i, cell["mask"]] = cell["n"], cell["good"], cell["toxic"]
                got = interactions(table, orders, steps)
                each = len(orders) * k
                part = few.column(0).take(pa.array(np.repeat(np.arange(few.num_rows), each)))
                order = pa.array([name for name in names for _ in range(k)] * few.num_rows)
                step = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), few.num_rows * len(orders)))
                values = [pa.array(got[c].reshape(-1)) for c in COUNTS]
                yield pa.RecordBatch.from_arrays([part, order, step, *values], ["part", "filter_order", "step", *COUNTS])

    return by_part.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
