"""Table profiles: class sizes, shape, descriptions with exact quartiles, histograms."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUARTILES = (0.25, 0.5, 0.75)
SLOTS = 1024  # parts of a bracket counted in one pass
EVEN, FROM_LOW, FROM_HIGH = range(3)  # how a bracket is cut: equal parts, or halves towards one of its ends


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("long"))


def _long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    return doubles.unpivot([], list(columns), "column", "value").where(F.col("value").isNotNull() & ~F.isnan("value"))


@dataclass
class _Bracket:
    """Values of one column from ``low`` to ``high``, both taken, that hold the wanted ``ranks``."""

    column: str
    low: float
    high: float
    below: int  # values under the bracket
    inside: int
    ranks: list[int]
    way: int = EVEN


def _slot() -> Column:
    """The part of its bracket a value lies in; it rises with the value, and the two ends never share one."""
    value, low, high = (F.col(c) * F.col("_unit") for c in ("value", "_low", "_high"))
    from_low, from_high = (value - low) / (high - low), (high - value) / (high - low)

    def halvings(share: Column) -> Column:
        return F.least(F.floor(F.coalesce(-F.log2(share), F.lit(float(SLOTS)))), F.lit(SLOTS - 2))

    towards_low = F.when(F.col("value") == F.col("_low"), 0).otherwise(SLOTS - 1 - halvings(from_low))
    towards_high = F.when(F.col("value") == F.col("_high"), SLOTS - 1).otherwise(halvings(from_high))
    even = F.least(F.floor(from_low * SLOTS), F.lit(SLOTS - 1))
    return F.when(F.col("_way") == EVEN, even).when(F.col("_way") == FROM_LOW, towards_low).otherwise(towards_high).cast("int")


def _narrowed(bracket: _Bracket, slots: Sequence) -> list[_Bracket]:
    """The slots of a counted bracket that hold wanted ranks, each from its least to its greatest value."""
    out, below = [], bracket.below
    for slot in sorted(slots, key=lambda r: r["slot"]):
        ranks = [r for r in bracket.ranks if below <= r < below + slot["n"]]
        if ranks:
            crowded = 2 * slot["n"] > bracket.inside  # most values sit close together: cut another way next time
            way = (bracket.way + 1) % 3 if crowded else EVEN
            out.append(_Bracket(bracket.column, slot["first"], slot["last"], below, slot["n"], ranks, way))
        below += slot["n"]
    return out


def select_ranks(long: DataFrame, wanted: Mapping[str, Sequence[int]], extent: Mapping[str, Mapping]) -> tuple[dict[tuple[str, int], float], int]:
    """Values at the 0-based ``wanted`` ranks of every column of ``column, value``, and the passes it took.

    All ranks of all columns go down together: a pass counts ``SLOTS`` parts of every open bracket by partial
    aggregation, and what holds a wanted rank is the next bracket, until its values are all equal. No value is
    sorted or ranked; the driver gets at most ``SLOTS`` counts for each column and rank. Where most of a bracket
    falls into one part, as next to outliers, the next pass halves towards one of the ends, which finds the
    magnitude at once.
    """
    found: dict[tuple[str, int], float] = {}
    todo: list[_Bracket] = []
    for column, ranks in wanted.items():
        e = extent[column]
        finite = [r for r in ranks if e["lowest"] <= r < e["lowest"] + e["finite"]]
        found |= {(column, r): -math.inf if r < e["lowest"] else math.inf for r in ranks if r not in finite}
        if finite:
            todo.append(_Bracket(column, e["low"], e["high"], e["lowest"], e["finite"], finite))
    passes = 0
    while True:
        for b in (b for b in todo if b.low == b.high):
            found |= {(b.column, r): b.low for r in b.ranks}
        todo = [b for b in todo if b.low < b.high]
        if not todo:
            return found, passes
        rows = [(i, b.column, b.low, b.high, 0.5 if math.isinf(b.high - b.low) else 1.0, b.way) for i, b in enumerate(todo)]
        schema = "_i int, column string, _low double, _high double, _unit double, _way int"
        # a row for each column and wanted rank at most, the caller's own lists
        brackets = F.broadcast(long.sparkSession.createDataFrame(rows, schema))
        inside = long.join(brackets, "column").where(F.col("value").between(F.col("_low"), F.col("_high")))
        slots = inside.groupBy("_i", _slot().alias("slot")).agg(
            F.count("*").alias("n"), F.min("value").alias("first"), F.max("value").alias("last")
        )
        by_bracket: dict[int, list] = {}
        for row in slots.collect():
            by_bracket.setdefault(row["_i"], []).append(row)
        todo = [new for i, b in enumerate(todo) for new in _narrowed(b, by_bracket[i])]
        passes += 1


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float] = QUARTILES) -> DataFrame:
    """Interpolated quantiles ``column, p, value`` by distributed selection; see :func:`select_ranks`.

    NULL and NaN count as missing; a column without values has no row. ``df`` is read once for the extent and once
    for each pass, so give a saved table where it is dear to compute.
    """
    long = _long(df, columns)
    finite = F.when(~F.abs("value").isin(math.inf), F.col("value"))
    rows = long.groupBy("column").agg(
        F.count("*").alias("n"), F.count(finite).alias("finite"), F.count_if(F.col("value") == -math.inf).alias("lowest"),
        F.min(finite).alias("low"), F.max(finite).alias("high"),
    ).collect()
    extent = {r["column"]: r.asDict() for r in rows}
    places = {(c, float(p)): float(p) * (e["n"] - 1) for c, e in extent.items() for p in probabilities}
    wanted: dict[str, list[int]] = {}
    for (column, _), place in places.items():
        wanted[column] = sorted({*wanted.get(column, ()), math.floor(place), math.ceil(place)})
    found, _ = select_ranks(long, wanted, extent)
    out = []
    for (column, p), place in places.items():
        a, b = found[column, math.floor(place)], found[column, math.ceil(place)]
        out.append((column, p, a if a == b else a + (b - a) * (place - math.floor(place))))
    return df.sparkSession.createDataFrame(out, "column string, p double, value double")


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation (n-1), minimum, quartiles and maximum, one row per column; NULL and NaN are left out."""
    moments = _long(df, columns).groupBy("column").agg(
        F.count("*").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(df, columns).groupBy("column").agg(
        *[F.max(F.when(F.col("p") == p, F.col("value"))).alias(f"p{round(p * 100)}") for p in QUARTILES]
    )
    return moments.join(quartiles, "column").select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def histograms(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Equal-width bins ``column, bin, n``, empty ones included; the highest value is in the last."""
    ranges = df.agg(
        *[F.min(F.col(c).cast("double")).alias(f"{c}|lo") for c in columns],
        *[F.max(F.col(c).cast("double")).alias(f"{c}|hi") for c in columns],
    ).select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}|lo`").alias("_lo"), F.col(f"`{c}|hi`").alias("_hi")) for c in columns])
        ).alias("r")
    ).select("r.*")
    long = _long(df, columns).join(F.broadcast(ranges), "column")
    # a constant column is spread half a unit to both sides, which puts it in the middle
    flat = F.col("_hi") == F.col("_lo")
    lo = F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo"))
    width = F.when(flat, F.lit(1.0)).otherwise(F.col("_hi") - F.col("_lo"))
    bin_ = F.least(F.floor((F.col("value") - lo) / width * bins), F.lit(bins - 1)).cast("int")
    counts = long.select("column", bin_.alias("bin")).groupBy("column", "bin").agg(F.count("*").alias("n"))
    grid = ranges.select("column", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counts, ["column", "bin"], "left").select("column", "bin", F.coalesce("n", F.lit(0)).alias("n"))
