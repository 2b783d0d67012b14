"""From whole texts to a labelled corpus: units, chapter names, class blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textgrade.fixed_values import PAGE_BREAK, PUBLISHER
from textgrade.functions import names
from textgrade.functions.text import normalized, split_units
from textgrade.operators.ranking import number_rows, seeded_key


def allow_names(df: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed; a semi join, so the list may be long."""
    return df.join(allowed.select(key), key, "left_semi")


def deny_names(df: DataFrame, denied: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not listed."""
    return df.join(denied.select(key), key, "left_anti")


def units(df: DataFrame, pieces: Column, keep: Sequence[str]) -> DataFrame:
    """One row per piece of a text, numbered from 1."""
    exploded = df.select(*keep, F.posexplode(pieces).alias("_at", "unit"))
    return exploded.select(*keep, (F.col("_at") + 1).alias("unit_id"), "unit")


def numbered_chapters(files: DataFrame, key: str, delimiter: str = PAGE_BREAK) -> DataFrame:
    """Chapters of ``key, text`` files with a number in the file and one over all files.

    Files come in the order of the seeded key; the offset of a file is the number of chapters in the
    files before it, summed over the file table, never over chapters.
    """
    split = files.select(*[c for c in files.columns if c != "text"], split_units(normalized(F.col("text")), delimiter).alias("_units"))
    sized = split.withColumn("_count", F.size("_units"))
    offsets = number_rows(
        sized.select(key, "_count"), seeded_key(key), out="_offset", tie=[key], weight=F.col("_count")
    ).select(key, "_offset")
    placed = sized.join(offsets, key)
    others = [c for c in files.columns if c != "text"]
    return placed.select(*others, "_offset", F.posexplode("_units").alias("_at", "text")).select(
        *others,
        (F.col("_at") + 1).alias("chapter"),
        (F.col("_offset") + F.col("_at") + 1).alias("global_id"),
        "text",
    )


def chapter_corpus(files: DataFrame, publisher: str = PUBLISHER, delimiter: str = PAGE_BREAK) -> DataFrame:
    """``name, text`` of every chapter of ``file_name, text`` book files."""
    chapters = numbered_chapters(files, "file_name", delimiter)
    file_name = F.col("file_name")
    name = names.chapter_name(
        F.col("global_id"), names.level_part(file_name), names.title_part(file_name), F.col("chapter"), publisher
    )
    return chapters.select(name.alias("name"), "text")


def label_by_name(df: DataFrame) -> DataFrame:
    """Class from the level marker in the name; rows without one are dropped."""
    return df.withColumn("label", names.class_of(F.col("name"))).where(F.col("label").isNotNull())


def capped(df: DataFrame, order: Sequence[str], cap: int, partition_by: Sequence[str] = ()) -> DataFrame:
    """The first ``cap`` rows (per partition key); map-side limits keep hot keys small."""
    if not partition_by:
        return df.orderBy(*order).limit(cap)
    w = Window.partitionBy(*partition_by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def labelled_corpus(chapters: DataFrame, third: DataFrame, cap: int | None = None) -> DataFrame:
    """``label, name, text``: chapters labelled by name, then the third-class texts, at most ``cap`` if given."""
    books = label_by_name(chapters).select("label", "name", "text")
    rest = (third if cap is None else capped(third, ["name"], cap)).select(F.lit(2).alias("label"), "name", "text")
    return books.unionByName(rest)


def reassembled(kept: DataFrame, key: str, position: str, unit: str, out: str = "text") -> DataFrame:
    """Kept units of each document joined in their original order.

    A group is what is left of one document, which was a single row to begin with.
    """
    ordered = F.array_sort(F.collect_list(F.struct(position, unit)))
    return kept.groupBy(key).agg(F.array_join(F.transform(ordered, lambda u: u[unit]), "").alias(out))
