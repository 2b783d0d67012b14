"""Line dedup by winnowing: runs of lines that were seen before are deleted.

The lines of a document that are not blank are hashed. Every window of ``run`` such lines in a row has
a smallest hash; these window minima are the fingerprints, so every run of that many lines holds one.
Positions with the same fingerprint are joined through the list of fingerprints found more than once.
The windows around them are then grouped by their own hash, which replaces joining positions and
extending matches; a window whose lines stand earlier too is a repeat, and repeats that touch make one run. All lines of repeats are
deleted, the first occurrence stays. Grouping by window keeps this linear: no pairs of positions arise.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgrade.llm.common import bound_batches, passing, saved

RUN = 2  # lines of the shortest run that is deleted
BLANK = " \t\r"


def fingerprints(docs: DataFrame, run: int) -> DataFrame:
    """``doc_id, digest, mark, windows``: each window minimum with the windows ``(at, g1, g2)`` around it."""
    lines = F.filter(
        F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("at"), x.alias("line"))),
        lambda s: F.btrim(s["line"], F.lit(BLANK)) != "",
    )
    hashed = docs.select("doc_id", "digest", lines.alias("lines")).filter(F.size("lines") >= run).select(
        "doc_id",
        "digest",
        F.transform("lines", lambda s: F.xxhash64(s["line"])).alias("h1"),
        F.transform("lines", lambda s: F.xxhash64(F.lit("second"), s["line"])).alias("h2"),
    )
    windows = F.transform(
        F.sequence(F.lit(1), F.size("h1") - run + 1),
        lambda i: F.struct(
            (i - 1).alias("at"),
            F.array_min(F.slice("h1", i, run)).alias("mark"),
            F.xxhash64(F.slice("h1", i, run)).alias("g1"),
            F.xxhash64(F.slice("h2", i, run)).alias("g2"),
        ),
    )
    found = hashed.select("doc_id", "digest", F.explode(windows).alias("w"))
    return found.select("doc_id", "digest", "w.*")


def repeats(docs: DataFrame, run: int = RUN) -> DataFrame:
    """``doc_id, digest, at``: the windows that stand earlier too, ``at`` counting lines that are not blank."""
    windows = saved(fingerprints(docs, run))
    shared = windows.groupBy("mark").agg(F.count("*").alias("n")).filter("n > 1").select("mark")
    extended = windows.join(shared, "mark").select("g1", "g2", F.struct("doc_id", "digest", "at").alias("place"))
    first = extended.groupBy("g1", "g2").agg(F.min("place").alias("first"), F.max("place").alias("last")).filter("NOT first <=> last")
    later = extended.join(first, ["g1", "g2"]).filter("NOT place <=> first")
    return later.select("place.*")


def _without(texts: pd.Series, repeated: pd.Series, run: pd.Series) -> pd.DataFrame:
    rows = []
    for text, at, width in zip(texts, repeated, run):
        lines = text.split("\n")
        solid = [i for i, line in enumerate(lines) if line.strip(BLANK)]
        gone, runs, covered = set(), 0, -1
        for first in sorted(set(at)) if at is not None else ():
            runs += first > covered
            covered = first + width
            gone.update(solid[first:covered])
        kept = text if not gone else "\n".join(line for i, line in enumerate(lines) if i not in gone)
        rows.append((kept, len(lines), len(gone), runs))
    return pd.DataFrame(rows, columns=["text", "n_lines", "n_removed", "n_runs"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN) -> DataFrame:
    """``docs`` with repeated runs of lines deleted, and ``n_lines, n_removed, n_runs`` in columns of these names.

    A line that is not blank is deleted when it lies in ``run`` consecutive such lines that also stand
    earlier: in a document with a smaller id (null is smallest) or further up in the same one. Windows are
    judged on the input and may overlap. Blank lines stay. Null texts stay null and count one empty line;
    of different texts under one id the one with the smaller hash is the earlier; rows equal in id and
    text are one document and are treated alike. Columns already called like the counts are replaced.
    """
    bound_batches(docs.sparkSession)
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed", "n_runs")]
    digest = F.xxhash64(F.col(text_col))
    keyed = docs.select(F.col(id_col).alias("doc_id"), digest.alias("digest"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    with passing(docs.sparkSession) as keep:
        at = keep(repeats(keyed, run).groupBy("doc_id", "digest").agg(F.collect_set("at").alias("at")))
    at = at.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), F.col("at").alias("__at"))
    met = docs.select(*own).join(at, F.col(id_col).eqNullSafe(F.col("__id")) & (digest == F.col("__digest")), "left")
    without = F.pandas_udf(_without, "text string, n_lines long, n_removed long, n_runs long")
    out = met.withColumn("__out", without(F.coalesce(F.col(text_col), F.lit("")), "__at", F.lit(run)))
    text = F.when(F.col(text_col).isNotNull(), F.col("__out.text"))
    return out.select(
        *[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in own],
        *[F.col(f"__out.{c}").alias(c) for c in ("n_lines", "n_removed", "n_runs")],
    )
