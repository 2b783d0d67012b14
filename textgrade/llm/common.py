"""Shared helpers: tables in the shared folder, sizes of a distributed job, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from itertools import repeat
from typing import Any

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SAVED: list[str] = []


def read_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a local session without it gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='textgrade-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as Parquet in the shared folder: short lineage, safe from lost executors."""
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SAVED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_saved(spark: SparkSession, but: int = 0) -> None:
    """Delete the tables that :func:`saved` has written, but for the first ``but``; call it when no result is read any more."""
    jvm = spark.sparkContext._jvm
    while len(_SAVED) > but:
        path = jvm.org.apache.hadoop.fs.Path(_SAVED.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables saved inside are deleted at its end, but for those saved by the function that it gives."""
    before, stay = len(_SAVED), []

    def keep(df: DataFrame) -> DataFrame:
        out = saved(df)
        stay.append(_SAVED.pop())
        return out

    try:
        yield keep
    finally:
        drop_saved(spark, before)
        _SAVED.extend(stay)


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXTS_AT_ONCE = 1000


def bound_batches(spark: SparkSession) -> None:
    """Let Python workers get at most ``TEXTS_AT_ONCE`` rows in a batch: texts are long and batches go by rows."""
    if int(spark.conf.get(BATCH_ROWS)) > TEXTS_AT_ONCE:
        spark.conf.set(BATCH_ROWS, str(TEXTS_AT_ONCE))


_HELD: dict[str, Any] = {}


def worker_cache(name: str, make: Callable[[], Any]) -> Any:
    """What this Python worker keeps from task to task under ``name``.

    Workers outlive operators, so only one thing is kept: a task that asks for another drops it.
    """
    if name not in _HELD:
        _HELD.clear()
        give_back()
        _HELD[name] = make()
    return _HELD[name]


def give_back() -> None:
    """Return freed memory of this worker to the machine, which its other processes need."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # of the C library only some have it
        ctypes.CDLL(None).malloc_trim(0)


ENTRY_BYTES = 150  # about what a key costs beside its characters


class ListCache:
    """A cache from strings to lists of ids, held as one array, of ``limit`` bytes at most.

    It is filled once, and so with what is common; what comes later is made each time it is needed. When
    what was left out would have filled it twice, the texts have changed and it starts anew.
    """

    def __init__(self, limit: int) -> None:
        self.limit, self.n, self.held, self.missed = limit, 0, 0, 0
        self.place: dict[Any, int] = {}
        self.ids, self.ends = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)

    def get(self, keys: list, make: Callable[[list], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The lists of ``keys`` end to end, and the bounds of each; ``make`` gives those not held, in this form."""
        at = np.fromiter(map(self.place.get, keys, repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            wanted = list(map(keys.__getitem__, missing))
            new = list(dict.fromkeys(wanted))
            flat, bounds = make(new)
            used, last = int(self.ends[self.n]), self.n + len(new)
            if used + len(flat) > len(self.ids):
                self.ids = np.r_[self.ids[:used], np.zeros(used // 2 + len(flat), np.uint32)]
            if last >= len(self.ends):
                self.ends = np.r_[self.ends[: self.n + 1], np.zeros(len(new) + self.n // 2 + 1, np.int64)]
            # entries beyond the limit stand behind the others until the next call
            self.ids[used : used + len(flat)] = flat
            self.ends[self.n + 1 : last + 1] = used + bounds[1:]
            numbers = dict(zip(new, range(self.n, last)))
            at[missing] = np.fromiter(map(numbers.__getitem__, wanted), np.int64, len(wanted))
        starts, sizes = self.ends[at], self.ends[at + 1] - self.ends[at]
        ends = np.r_[0, np.cumsum(sizes)]
        out = self.ids[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])]
        if missing:
            cost = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)) + 4 * np.diff(bounds) + ENTRY_BYTES)
            kept = int(np.searchsorted(cost, self.limit - self.held, side="right"))
            self.place.update(zip(new[:kept], range(self.n, self.n + kept)))
            self.n += kept
            self.held += int(cost[kept - 1]) if kept else 0
            self.missed += int(cost[-1] - (cost[kept - 1] if kept else 0))
            if self.missed > 2 * self.limit:
                self.place.clear()
                self.n = self.held = self.missed = 0
        return out, ends


@contextmanager
def wide_batches(spark: SparkSession, rows: int = 10_000) -> Iterator[None]:
    """Batches of many rows for what is computed inside, where rows are a few numbers."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def literal_rows(spark: SparkSession, rows: list[tuple[int, ...]], schema: str) -> DataFrame:
    """A few rows of numbers as a table; none give an empty table."""
    names = [c.split()[0] for c in schema.split(",")]
    if not rows:
        return spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {c.split()[1]}) AS {c.split()[0]}" for c in schema.split(","))).limit(0)
    values = ", ".join(f"({', '.join(map(str, row))})" for row in rows)
    casts = ", ".join(f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in schema.split(","))
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({', '.join(names)})")


def text_bytes(col: str) -> Column:
    """UTF-8 bytes of a text; none for null."""
    return F.coalesce(F.octet_length(F.col(col)), F.lit(0)).cast("long")


def cell_count(df: DataFrame, text_col: str, cell_bytes: int) -> int:
    """How many hash cells hold about ``cell_bytes`` of text each."""
    total = df.agg(F.sum(text_bytes(text_col)).alias("n")).first()["n"] or 0
    return max(1, -(-total // cell_bytes))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges (a, b)``: rows ``(node, root)``, root being the smallest node.

    Alternating large-star and small-star steps until no edge changes. Each step aggregates before it
    shuffles; its result is kept as a table in the shared folder. Null ends and loops carry no link.
    """
    stars = saved(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    state = _mark(stars)
    while state[0]:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = saved(small.union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        before, state = state, _mark(stars)
        if state == before:
            break
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _mark(stars: DataFrame) -> tuple[int, int]:
    """Number and order-free digest of the edges, to see when they stop changing."""
    row = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)
