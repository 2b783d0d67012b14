"""Array columns: argmax, guarded means, tidy score arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def argmax(scores: Column) -> Column:
    """0-based position of the first largest score, NULL for an empty array."""
    return F.nullif(F.array_position(scores, F.array_max(scores)), F.lit(0)) - 1


def unnest_scores(df: DataFrame, arrays: Sequence[str], position: str) -> DataFrame:
    """One row per position of parallel arrays; the shorter ones give NULLs."""
    others = [c for c in df.columns if c not in arrays]
    zipped = df.select(*others, F.posexplode_outer(F.arrays_zip(*arrays)).alias(position, "_z"))
    return zipped.select(*others, position, *[F.col(f"_z.{a}").alias(a) for a in arrays])
