"""Frequency dictionaries and the per-document statistics looked up in them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textgrade.operators.ranking import count_rank, forward_fill

HEAD_ROWS = 10_000


def filled_ranks(dictionary: DataFrame, row: Sequence[str], block: Column) -> DataFrame:
    """Blank ranks take the last rank above them, 0 at the top."""
    return forward_fill(dictionary, "rank", row, block, start=0.0)


def last_wins(dictionary: DataFrame, key: str, row: Sequence[str]) -> DataFrame:
    """One row per key; of repeated keys the last row counts."""
    others = [c for c in dictionary.columns if c not in (key, *row)]
    newest = F.max_by(F.struct(*others), F.struct(*row)).alias("_row")
    return dictionary.groupBy(key).agg(newest).select(key, *[F.col(f"_row.{c}").alias(c) for c in others])


def form_counts(tokens: DataFrame) -> DataFrame:
    """How often each document uses each word form and lemma: ``doc_id, text, lemma, n``.

    The one heavy shuffle of the lookups. Dictionary, word and lemma lookups all read its result;
    for that its keys are never NULL (a missing form is the empty string), or else every reader
    would push a filter of its own below the shuffle.
    """
    tokens = tokens.where(F.col("doc_id").isNotNull())
    keys = ["doc_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lemma")]]
    return tokens.select(*keys).groupBy("doc_id", "text", "lemma").agg(F.count("*").alias("n"))


def form_uses(tokens: DataFrame) -> DataFrame:
    """Rows as of :func:`form_counts`, but one per token and without a shuffle, for lookups that add up anyway."""
    forms = [F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lemma")]
    return tokens.where(F.col("doc_id").isNotNull()).select("doc_id", *forms, F.lit(1).cast("long").alias("n"))


def fits_head(dictionary: DataFrame, head_rows: int = HEAD_ROWS) -> bool:
    """Whether a dictionary has no more entries than are broadcast."""
    return dictionary.select("form").limit(head_rows + 1).count() <= head_rows


def dictionary_from_counts(counts: DataFrame, form: str, min_freq: int = 1) -> DataFrame:
    """Dictionary ``form, freq, rank`` of a collection; rarer forms than ``min_freq`` are left out."""
    totals = counts.groupBy(F.col(form).alias("form")).agg(F.sum("n").alias("freq"))
    totals = totals.where(F.when(F.col("form") == "", F.lit(False)).otherwise(F.col("freq") >= min_freq))
    return count_rank(totals, "freq").select("form", "freq", "rank")


def look_up(counts: DataFrame, form: str, dictionary: DataFrame, head_rows: int = HEAD_ROWS) -> DataFrame:
    """Inner join of ``counts`` with a dictionary of any size.

    Word use is so uneven that joining on the form would send the commonest word of every document
    to one task. The ``head_rows`` commonest entries are therefore broadcast, a fixed number of rows,
    and only the rest, where no form is common any more, is joined by key. A dictionary that has no
    more entries has no rest: its misses are dropped where they are.
    """
    used = counts.select("doc_id", F.col(form).alias("form"), "n")
    entries = dictionary.select("form", "freq", "rank")
    if fits_head(dictionary, head_rows):
        return used.join(F.broadcast(entries), "form")
    head = F.broadcast(entries.orderBy(F.desc("freq"), "form").limit(head_rows))
    tried = used.join(head, "form", "left")
    common = tried.where(F.col("freq").isNotNull())
    rare = tried.where(F.col("freq").isNull()).select("form", "doc_id", "n").join(entries, "form")
    return common.unionByName(rare)


def frequency_aggregates(prefix: str, n: Column, freq: str = "freq", rank: str = "rank") -> list[Column]:
    """Mean and lowest frequency, mean and highest rank over looked-up forms; ``n`` is NULL for misses."""
    return [
        (F.sum(n * F.col(freq)) / F.sum(n)).alias(f"mean_{prefix}_freq"),
        F.min(freq).cast("double").alias(f"min_{prefix}_freq"),
        (F.sum(n * F.col(rank)) / F.sum(n)).alias(f"mean_{prefix}_rank"),
        F.max(rank).cast("double").alias(f"max_{prefix}_rank"),
    ]


def frequency_features(counts: DataFrame, form: str, dictionary: DataFrame, prefix: str) -> DataFrame:
    """Mean and lowest frequency, mean and highest rank per document over the forms found."""
    return look_up(counts, form, dictionary).groupBy("doc_id").agg(*frequency_aggregates(prefix, F.col("n")))


def with_entries(tokens: DataFrame, form: str, dictionary: DataFrame, prefix: str) -> DataFrame:
    """Tokens with ``{prefix}_freq`` and ``{prefix}_rank`` of a dictionary that fits the head, NULL for misses."""
    key = f"_{prefix}_form"
    entries = dictionary.select(F.col("form").alias(key), F.col("freq").alias(f"{prefix}_freq"), F.col("rank").alias(f"{prefix}_rank"))
    return tokens.join(F.broadcast(entries), F.col(form) == F.col(key), "left").drop(key)
