"""Exact numbering and forward fill without a window over a whole table.

``row_number() over (order by …)`` moves every row into one task. Here the order is cut into
buckets first: one pass counts rows per bucket, a running sum over that small table gives each
bucket its offset, and the window then runs inside single buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textgrade.fixed_values import SEED


def seeded_key(key: Column | str, seed: int = SEED) -> Column:
    """md5 of key and seed: a shuffle order that does not depend on the partitioning."""
    col = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(col.cast("string"), F.lit(f"|{seed}")).cast("binary"))


def number_rows(
    df: DataFrame,
    order: Column,
    out: str = "position",
    partition_by: Sequence[str] = (),
    tie: Sequence[str] = (),
    bucket: Column | None = None,
    weight: Column | None = None,
    total: str | None = None,
) -> DataFrame:
    """Number rows from 1 in ``order`` (per ``partition_by``), exactly and in parallel.

    ``bucket`` must rise with ``order``; the default, the first three digits of a hex key such as
    :func:`seeded_key`, gives at most 4,096 even buckets whatever the data. With ``weight`` the
    result is the running sum of weights *before* the row. ``total`` adds the (weighted) row total.
    """
    parts = list(partition_by)
    step = F.lit(1).cast("long") if weight is None else weight.cast("long")
    keyed = df.withColumn("_order", order)
    keyed = keyed.withColumn("_bucket", F.substring("_order", 1, 3) if bucket is None else bucket)

    sizes = keyed.groupBy(*parts, "_bucket").agg(F.sum(step).alias("_size"))
    running = Window.partitionBy(*parts).orderBy("_bucket")
    columns = [*parts, "_bucket", (F.sum("_size").over(running) - F.col("_size")).alias("_offset")]
    if total:
        columns.append(F.sum("_size").over(Window.partitionBy(*parts)).alias(total))
    offsets = sizes.select(*columns)

    inside = Window.partitionBy(*parts, "_bucket").orderBy("_order", *tie)
    if weight is None:
        local = F.row_number().over(inside)
    else:
        local = F.sum(step).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - step
    joined = keyed.withColumn("_local", local)
    for p in parts:  # NULL partition keys form a partition too
        joined, offsets = joined.withColumnRenamed(p, f"_l_{p}"), offsets.withColumnRenamed(p, f"_r_{p}")
    match = F.col("l._bucket").eqNullSafe(F.col("r._bucket"))  # NULL keys have a bucket too
    for p in parts:
        match = match & F.col(f"_l_{p}").eqNullSafe(F.col(f"_r_{p}"))
    result = joined.alias("l").join(offsets.alias("r"), match)
    kept = [F.col(f"_l_{c}").alias(c) if c in parts else F.col(f"l.{c}") for c in df.columns]
    kept.append((F.col("_offset") + F.col("_local")).cast("long").alias(out))
    if total:
        kept.append(F.col(total))
    return result.select(*kept)


def count_rank(df: DataFrame, value: str, out: str = "rank") -> DataFrame:
    """``rank() over (order by value desc)`` by way of the distinct values.

    For frequencies, the distinct values number at most about sqrt(2 x total), so the running sum
    over them stays small while the rows themselves are only joined back.
    """
    sizes = df.groupBy(value).agg(F.count("*").alias("_n"))
    above = F.sum("_n").over(Window.orderBy(F.desc(value))) - F.col("_n")
    ranks = sizes.select(value, (above + 1).cast("long").alias(out))
    return df.join(ranks, value)


def forward_fill(
    df: DataFrame,
    value: str,
    order_by: Sequence[str],
    block: Column,
    partition_by: Sequence[str] = (),
    start: object = None,
    out: str | None = None,
) -> DataFrame:
    """Replace NULLs by the last value seen in order; ``start`` before the first one.

    ``block`` rises with the order (a file split, an hour). Each block is filled on its own and the
    last value of every block is carried forward over the small table of blocks, so that neither one
    long sequence nor one hot partition key lands in a single task.
    """
    out = out or value
    parts = list(partition_by)
    keys = [*parts, "_block"]
    blocked = df.withColumn("_block", block)
    inside = Window.partitionBy(*keys).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    filled = blocked.withColumn("_filled", F.last(value, ignorenulls=True).over(inside))

    last_of_block = blocked.groupBy(*keys).agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order_by))).alias("_last")
    )
    before = Window.partitionBy(*parts).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = last_of_block.select(*keys, F.last("_last", ignorenulls=True).over(before).alias("_carry"))

    for k in keys:  # NULL keys form a sequence too
        carry = carry.withColumnRenamed(k, f"_r_{k}")
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    joined = filled.join(carry, match)
    result = F.coalesce("_filled", "_carry", F.lit(start)) if start is not None else F.coalesce("_filled", "_carry")
    others = [c for c in df.columns if c != out]
    return joined.select(*others, result.alias(out))
