"""K-d tree sharding: cut a table into shards of nearly equal bytes that are close in metadata.

Rows of equal text form one unit, so copies stay together; a group heavier than a sixteenth of a shard
is dealt out in several units. Every unit is a point in the space of the given metadata dimensions. A
node that must hold several shards is cut at the weighted median of its widest dimension, in
proportion to the shards on either side, until each leaf is one shard. Medians are found by histograms
that Spark fills and that shrink around the cut, for all nodes of a level at once, so no group of rows
ever meets in one task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textgrade.llm.common import saved, text_bytes

BINS = 4096  # histogram slots of a node in one pass
GRID, TIE = 31, 31  # bits of a coordinate, and of the hash that cuts ties on the grid
PIECES = 16  # a group of copies heavier than this part of a shard is dealt out
BROADCAST_ROWS = 100_000  # small rows that may be broadcast
SALTS = 64


def default_dimensions(length: str = "n_chars", categories: tuple[str, ...] = ("lang", "source")) -> dict[str, Column]:
    """Log length, and categories placed by hash, as coordinates of a point."""
    dims = {"d_length": F.log2(F.greatest(F.coalesce(F.col(length).cast("double"), F.lit(0.0)), F.lit(0.0)) + 1)}
    for name in categories:
        dims[f"d_{name}"] = F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")).cast("double")
    return dims


def kd_shards(
    docs: DataFrame, dims: Mapping[str, Column], shards: int | None = None, target_bytes: int | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Rows ``doc_id, size, text_crc32, shard, slot`` for every row of ``docs``.

    ``size`` is the UTF-8 length of the text (null: none) plus 1; ``slot`` counts from 0 without gaps in
    a shard. Give the number of ``shards`` or the ``target_bytes`` of one. Null coordinates count as 0,
    null ids sort first, repeated rows (equal or null ids too) are separate rows of one group and are dealt out like
    others where it is heavy. An empty table gives no rows.
    """
    digest = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        (text_bytes(text_col) + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        digest.alias("digest"),
        *[F.coalesce(c, F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(dims.values())],
    )
    axes = [f"x{i}" for i in range(len(dims))]
    # the number tells repeated rows apart, and stays what it is because it is saved
    rows = saved(slim.withColumn("row", F.monotonically_increasing_id()))
    total = rows.agg(F.sum("size").alias("n")).first()["n"] or 0
    if shards is None:
        shards = max(1, -(-total // target_bytes))
    piece = max(1, total // (shards * PIECES))
    heavy = rows.groupBy("digest").agg(F.sum("size").alias("w")).filter(F.col("w") > piece)
    parts = heavy.select("digest", F.ceil(F.col("w") / piece).alias("parts"))
    unit_of_row = _with_parts(rows, parts, shards * PIECES).withColumn(
        "part", F.coalesce(F.pmod(F.xxhash64("doc_id", "row"), "parts"), F.lit(0))
    )
    units = saved(
        unit_of_row.groupBy("digest", "part").agg(F.sum("size").alias("w"), *[F.min(a).alias(a) for a in axes])
    )
    placed = _leaves(units, axes, shards)
    out = unit_of_row.select("digest", "part", "doc_id", "size", "text_crc32").join(placed, ["digest", "part"])
    return _slots(out.select("doc_id", "size", "text_crc32", "shard"), total)


def _with_parts(rows: DataFrame, parts: DataFrame, most: int) -> DataFrame:
    """Add ``parts``, the units of a heavy group. Fewer than ``most`` groups are heavy, for they weigh no more than the
    whole: where that is few they are broadcast, else every group is joined in salted pieces."""
    if most <= BROADCAST_ROWS:
        return rows.join(F.broadcast(parts), "digest", "left")
    salted = parts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS))).join(salted, ["digest", "salt"], "left").drop("salt")


def _leaves(units: DataFrame, axes: list[str], shards: int) -> DataFrame:
    """``digest, part, shard`` of every unit; nodes, cuts and histograms are tables, however many leaves there are."""
    spark = units.sparkSession
    span = units.agg(*[F.struct(F.min(a).alias("lo"), F.max(a).alias("hi")).alias(a) for a in axes]).first()
    tie = F.shiftrightunsigned(F.xxhash64("digest", "part"), 64 - TIE)
    grid = [
        F.shiftleft(
            F.floor((F.col(a) - span[a]["lo"]) / ((span[a]["hi"] - span[a]["lo"]) or 1.0) * ((1 << GRID) - 1)).cast("long"), TIE
        ).bitwiseOR(tie)
        if span[a]["lo"] is not None
        else F.lit(0).cast("long")
        for a in axes
    ]
    points = units.select("digest", "part", "w", *[g.alias(a) for g, a in zip(grid, axes)], F.lit(0).cast("long").alias("node"))
    # node, its first shard, how many it must hold
    nodes = spark.range(1).selectExpr("id AS node", "0 AS first", f"{shards} AS n")
    widest = shards
    while widest > 1:
        points = saved(points)
        cuts = _cuts(points, nodes.filter("n > 1"), axes).select("node", "axis", F.col("lo").alias("cut"))
        key = F.element_at(F.array(*axes), F.col("axis"))
        child = F.when(key < F.col("cut"), F.col("node") * 2 + 1).when(key.isNotNull(), F.col("node") * 2 + 2).otherwise(F.col("node"))
        points = points.join(cuts, "node", "left").select("digest", "part", "w", *axes, child.alias("node"))
        nodes = nodes.selectExpr(
            "inline(if(n > 1, array(named_struct('node', node * 2 + 1, 'first', first, 'n', int(n div 2)),"
            " named_struct('node', node * 2 + 2, 'first', int(first + n div 2), 'n', int(n - n div 2))),"
            " array(named_struct('node', node, 'first', first, 'n', n))))"
        )
        widest -= widest // 2
    return points.join(nodes, "node").select("digest", "part", F.col("first").alias("shard"))


def _cuts(points: DataFrame, nodes: DataFrame, axes: list[str]) -> DataFrame:
    """``node, axis, lo`` of every node that holds points: those below ``lo`` go left, as near to the wanted weight as units allow.

    A cut lies in ``[lo, hi]``. Every pass counts ``BINS`` slots of that range in all nodes at once and goes on
    with the slot where the wanted weight is reached; the driver only asks whether a range is still open.
    """
    stats = points.groupBy("node").agg(
        F.sum("w").alias("w"), *[F.struct(F.min(a).alias("lo"), F.max(a).alias("hi")).alias(f"s_{a}") for a in axes]
    )
    sides = F.array(*[
        F.struct((F.shiftright(F.col(f"s_{a}.hi"), TIE) - F.shiftright(F.col(f"s_{a}.lo"), TIE)).alias("width"), F.lit(i + 1).alias("axis"), F.col(f"s_{a}.lo").alias("lo"), F.col(f"s_{a}.hi").alias("hi"))
        for i, a in enumerate(axes)
    ])
    cuts = saved(
        nodes.join(stats, "node").withColumn("side", F.array_max(sides)).select(
            "node", "side.axis", "side.lo", (F.col("side.hi") + 1).alias("hi"), F.lit(0).cast("long").alias("below"),
            F.expr("w * double(n div 2) / n").alias("want"),
        )
    )
    is_open = F.col("hi") - F.col("lo") > 1
    running = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # BINS rows at most
    while not cuts.filter(is_open).isEmpty():
        wide = cuts.filter(is_open).withColumn("step", F.expr(f"(hi - lo + {BINS - 1}) div {BINS}"))
        counted = (
            points.join(wide.drop("below", "want"), "node")
            .withColumn("key", F.element_at(F.array(*axes), F.col("axis")))
            .filter("key >= lo AND key < hi")
            .groupBy("node", F.expr("(key - lo) div step").alias("bin"))
            .agg(F.sum("w").alias("w"), F.min("key").alias("first"), F.max("key").alias("last"))
            .withColumn("upto", F.sum("w").over(running))
        )
        reached = (
            counted.join(wide.select("node", "below", "want"), "node").filter("below + upto >= want")
            .groupBy("node").agg(F.min_by(F.struct("w", "first", "last", "upto"), "bin").alias("r"))
        )
        before = F.expr("below + r.upto - r.w")
        # one point left: it goes to the side that comes nearer
        nearer = F.when(F.col("want") - before < before + F.col("r.w") - F.col("want"), F.col("r.first")).otherwise(F.col("r.first") + 1)
        single = F.col("r.first") == F.col("r.last")
        narrowed = wide.join(reached, "node", "left").select(
            "node", "axis",
            F.when(F.col("r").isNull(), F.col("hi")).when(single, nearer).otherwise(F.col("r.first")).alias("lo"),
            F.when(F.col("r").isNull(), F.col("hi")).when(single, nearer).otherwise(F.col("r.last") + 1).alias("hi"),
            F.coalesce(before, "below").alias("below"), "want",
        )
        cuts = saved(cuts.filter(~is_open).unionByName(narrowed))
    return cuts


def _slots(rows: DataFrame, total: int) -> DataFrame:
    """Number the rows of each shard without gaps: counts of hash buckets give offsets, ranks the rest."""
    buckets = max(1, -(-total // (8 << 20)))
    kept = saved(rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", F.monotonically_increasing_id()), F.lit(buckets))))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        kept.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size"))
    numbered = kept.withColumn("rank", rank - 1).join(starts, ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("rank")).alias("slot"))
