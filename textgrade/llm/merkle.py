"""Merkle manifest of a dataset by time-forward processing.

Every row is a leaf; the leaves of a source, by id, are hashed together sixteen at a time, level by level,
to a subroot, and the subroots by source in the same way to the root. The tree is walked in the order of
node labels, a node's label being the last leaf below it and its level: children come before parents. A
node's digest is a message to its parent; messages wait in a priority queue ordered by label until the walk
gets there, so at most sixteen a level wait at any time. The reversed walk starts at the root: a node's
message to each child is the child's proof suffix, the siblings from there up to the root.

Over many machines, a walk covers ``BLOCK`` neighbouring leaves, which are three levels of the tree, and
the queue between walks is a table sorted by label: what a block's walk sends above its highest level are
the leaves of the next pass, each of which has a 4096th of the rows. The reversed passes go through the
same tables the other way round. No task holds more than the messages of one path.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textgrade.llm.common import literal_rows, saved

FAN = 16
LEVELS = 3  # of a pass
BLOCK = FAN**LEVELS
HEX = 64  # characters of a digest
PARTS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SUFFIX = "array<struct<pos:int,run:string>>"
ARROW = {
    "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(),
    SUFFIX: pa.list_(pa.struct([("pos", pa.int32()), ("run", pa.string())])),
}
NODE_COLUMNS = {"tree": "long", "n": "long", "block": "long", "last": "long", "level": "int", "first": "long", "run": "string", "head": "string"}
HEAD, NODE, LEAF = range(3)  # kinds of rows in the reversed walk


def leaf_digest(*values: Column) -> Column:
    """Digest of the fields of a row: ``-`` if null, else UTF-8 byte count, colon, value."""
    texts = [v.cast("string") for v in values]
    fields = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*fields), 256)


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z in lower case; other letters stay."""
    return F.when(text.rlike("[A-Z]"), F.translate(text, UPPER, LOWER)).otherwise(text)


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


@dataclass
class Pass:
    """One pass over some trees: its leaves, and the tree nodes between them and the heads of their blocks."""

    leaves: DataFrame  # tree, n, block, idx, digest
    nodes: DataFrame  # tree, n, block, last, level, first, run


def _blocks(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows of a block in one partition, in walking order."""
    return df.repartition("tree", "block").sortWithinPartitions("tree", "block", *order)


def _sweep_up(leaves: DataFrame) -> DataFrame:
    """Nodes above ``leaves (tree, n, block, idx, digest)``, by one walk through each block.

    Gives ``tree, n, block, last, level, first, run``: the digests of the children of a node end to end,
    the index of the first of them and the last leaf below. The head of a block is its highest node; its
    digest is in ``head``, which is null in other rows. A block of a tree of one leaf has no node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        queue: list[tuple] = []  # messages (last leaf, level, child's index, digest): labels of the parents first
        here, top = None, 0

        def deliver(until: tuple[int, int]) -> None:
            """Let the walk go on through all nodes whose label is less than ``until``."""
            while queue and queue[0][:2] < until:
                last, level = queue[0][:2]
                children = []
                while queue and queue[0][:2] == (last, level):
                    children.append(heapq.heappop(queue))
                digests = "".join(c[3] for c in children)
                digest = hashlib.sha256(digests.encode()).hexdigest()
                tree, n, block = here
                out.append((tree, n, block, last, level, children[0][2], digests, digest if level == top else None))
                if level < top:
                    send(level + 1, children[0][2] // FAN, digest)

        def send(level: int, index: int, digest: str) -> None:
            """A message from the node ``index`` of level ``level - 1`` to its parent."""
            end = (index // FAN + 1) * FAN**level - 1  # last leaf the parent could have
            heapq.heappush(queue, (min(end, here[1] - 1), level, index, digest))

        for batch in batches:
            for tree, n, block, idx, digest in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (tree, n, block) != here:
                    if here:
                        deliver((here[1], 0))
                    here, top = (tree, n, block), min(height(n), LEVELS)
                deliver((idx, 0))
                if top:
                    send(1, idx, digest)
            yield _nodes(out)
            out.clear()
        if here:
            deliver((here[1], 0))
        yield _nodes(out)

    chosen = _blocks(leaves.select("tree", "n", "block", "idx", "digest"), [F.col("idx")])
    return chosen.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in NODE_COLUMNS.items()))


def _nodes(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(NODE_COLUMNS)
    return pa.RecordBatch.from_arrays([pa.array(c, ARROW[t]) for c, t in zip(columns, NODE_COLUMNS.values())], list(NODE_COLUMNS))


def _block() -> Column:
    return F.floor(F.col("idx") / BLOCK).cast("long")


def grow(leaves: DataFrame) -> tuple[list[Pass], DataFrame]:
    """All trees over ``leaves (tree long, n long, idx long, digest string)`` at once.

    ``n`` is the number of leaves of the tree and ``idx`` runs from 0. Gives the passes from the leaves up
    and ``tree, root``; the root of a tree of one leaf is the leaf.
    """
    passes, roots = [], []
    left = leaves
    while True:
        left = saved(left.withColumn("block", _block()).select("tree", "n", "block", "idx", "digest"))
        nodes = saved(_sweep_up(left))
        passes.append(Pass(left, nodes))
        heads = nodes.filter("head IS NOT NULL")
        roots.append(left.filter("n = 1").select("tree", F.col("digest").alias("root")))
        roots.append(heads.filter(F.col("n") <= BLOCK).select("tree", F.col("head").alias("root")))
        left = heads.filter(F.col("n") > BLOCK).select(
            "tree", F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), F.col("block").alias("idx"), F.col("head").alias("digest")
        )
        if left.isEmpty():
            break
    found = roots[0]
    for more in roots[1:]:
        found = found.union(more)
    return passes, found


def _sweep_down(one: Pass, above: DataFrame, emit, names: str, held: DataFrame | None = None) -> DataFrame:
    """The reversed walk through the blocks of a pass.

    ``above (tree, block, suffix)`` is what the heads of blocks are sent. ``emit(row, suffix)`` makes the
    values of ``names`` (Spark types) for a leaf ``(doc_id, tree, n, idx, digest, tampered)`` and its
    suffix, a list of (position, run) pairs from the leaf up to the root, a run being the digests of a node
    and its siblings. ``held`` has the leaves with all these columns where the pass has only some.
    """
    leaves = one.leaves if held is None else held
    id_type = leaves.schema["doc_id"].dataType.simpleString() if "doc_id" in leaves.columns else "long"
    blank = {"doc_id": id_type, "n": "long", "last": "long", "level": "int", "first": "long", "run": "string", "suffix": SUFFIX, "digest": "string", "tampered": "string"}

    def rows(df: DataFrame, kind: int) -> DataFrame:
        given = [F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in blank.items()]
        return df.select("tree", "block", F.lit(kind).alias("kind"), *given)

    sent = above.select("tree", "block", F.lit(1 << 62).alias("last"), F.lit(LEVELS + 1).alias("level"), "suffix")
    ends = leaves.withColumns({"last": F.col("idx"), "level": F.lit(0)})
    walked = rows(sent, HEAD).union(rows(one.nodes.drop("head"), NODE)).union(rows(ends, LEAF))
    walked = _blocks(walked, [F.desc("last"), F.desc("level")])
    kinds = [c.strip().split(" ", 1) for c in names.split(";")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue: list[tuple] = []  # messages (-last leaf, -level, nth, suffix): labels in falling order
        here, head, nth = None, [], 0
        for batch in batches:
            out: list[tuple] = []
            types = [batch.schema.field("doc_id").type if c == "doc_id" else ARROW[t] for c, t in kinds]
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for tree, block, kind, doc_id, n, last, level, first, digests, suffix, digest, tampered in zip(*columns):
                if (tree, block) != here:
                    here, head = (tree, block), []
                    queue.clear()
                if kind == HEAD:
                    head = [(s["pos"], s["run"]) for s in suffix]
                    continue
                # the highest node of a block has no message in the queue: what it is sent came with the block
                own = heapq.heappop(queue)[3] if queue and queue[0][:2] == (-last, -level) else head
                if kind == LEAF:
                    out.append(emit((doc_id, tree, n, last, digest, tampered), own))
                    continue
                children = len(digests) // HEX
                for pos in range(children):
                    index = first + pos
                    reach = last if pos == children - 1 else (index + 1) * FAN ** (level - 1) - 1
                    nth += 1
                    heapq.heappush(queue, (-reach, -(level - 1), nth, [(pos, digests), *own]))
            values = list(zip(*out)) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], [c for c, _ in kinds])

    return walked.mapInArrow(run, ", ".join(f"{c} {id_type if c == 'doc_id' else t}" for c, t in kinds))


def _place(row: tuple, suffix: list) -> tuple:
    return row[1], row[3], [{"pos": p, "run": r} for p, r in suffix]


_PLACES = f"tree long; idx long; suffix {SUFFIX}"


def suffixes(passes: list[Pass], sent: DataFrame) -> DataFrame:
    """``tree, block, suffix`` for the blocks of the lowest pass; ``sent (tree, suffix)`` is for the roots."""
    above, higher = None, None
    for one in reversed(passes):
        ending = one.leaves.filter((F.col("n") <= BLOCK) & (F.col("idx") == 0)).select("tree", "block")
        heads = ending.join(sent, "tree").select("tree", "block", "suffix")
        if above is not None:
            lower = _sweep_down(higher, above, _place, _PLACES).select("tree", F.col("idx").alias("block"), "suffix")
            heads = heads.union(lower)
        above, higher = saved(heads), one
    return above


def fold(digest: str, suffix: list[tuple[int, str]]) -> str:
    """The root that a leaf and its proof give."""
    for pos, run in suffix:
        digest = hashlib.sha256(f"{run[: pos * HEX]}{digest}{run[(pos + 1) * HEX :]}".encode()).hexdigest()
    return digest


def siblings(suffix: list[tuple[int, str]]) -> str:
    """The digests of a proof end to end, from the leaf up, left to right."""
    return "".join(run[: pos * HEX] + run[(pos + 1) * HEX :] for pos, run in suffix)


@dataclass
class Manifest:
    """The trees over a dataset: ``rows`` (leaves with ``source``, ``tampered`` and place), subroots and root."""

    rows: DataFrame
    passes: list[Pass]
    subroots: DataFrame  # tree, source, subroot
    top: list[Pass]
    root: str | None

    def _sent(self) -> DataFrame:
        """What the root sends to the blocks of the lowest pass, by way of the sources."""
        to_root = literal_rows(self.rows.sparkSession, [(0,)], "tree long").withColumn("suffix", F.array().cast(SUFFIX))
        to_sources = _sweep_down(self.top[0], suffixes(self.top, to_root), _place, _PLACES)
        return suffixes(self.passes, saved(to_sources.select(F.col("idx").alias("tree"), "suffix")))

    def _leaves(self) -> DataFrame:
        return self.rows.withColumnRenamed("leaf", "digest").withColumn("block", _block())

    def proofs(self) -> DataFrame:
        """``doc_id, leaf, proof``: position and run of siblings with the node, from each leaf up to the root."""

        def emit(row: tuple, suffix: list) -> tuple:
            return row[0], row[4], [{"pos": p, "run": r} for p, r in suffix]

        return _sweep_down(self.passes[0], self._sent(), emit, f"doc_id id; leaf string; proof {SUFFIX}", self._leaves())

    def audit(self) -> DataFrame:
        """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

        Proofs stay inside the tasks. ``subroot`` and ``root`` are what the leaf folds to with its proof;
        ``folded_root`` folds ``tampered`` instead where there is one and is held against the root.
        """
        root = self.root

        def emit(row: tuple, suffix: list) -> tuple:
            doc_id, _, n, _, digest, tampered = row
            own = height(n)
            subroot = fold(digest, suffix[:own])
            whole = fold(subroot, suffix[own:])
            folded = whole if tampered is None or tampered == digest else fold(tampered, suffix)
            proof = hashlib.sha256(siblings(suffix).encode()).hexdigest()
            return doc_id, digest, subroot, whole, proof, folded, folded == root

        names = "doc_id id; leaf string; subroot string; root string; proof_sha256 string; folded_root string; verified boolean"
        return _sweep_down(self.passes[0], self._sent(), emit, names, self._leaves())


def manifest(docs: DataFrame, tampered: Column | None = None) -> Manifest:
    """The manifest of all rows of ``docs``, whose columns ``PARTS`` make a leaf; others are ignored.

    ``tampered`` is the digest of a changed row, null where nothing is changed; see :func:`leaf_digest`.
    Rows are leaves by source (null first, then by bytes), ``doc_id`` (null first) and digest; repeated
    rows are a leaf each, any field may be null and texts of any length are hashed whole. An empty table
    has no leaf and the root is null.
    """
    spark = docs.sparkSession
    changed = F.lit(None).cast("string") if tampered is None else tampered
    leaves = saved(docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), leaf_digest(*map(F.col, PARTS)).alias("leaf"),
        changed.alias("tampered"), F.monotonically_increasing_id().alias("row"),
    ))
    # places in each source: counts by range of the sorted table give where each range begins
    ranges = leaves.repartitionByRange("source", "doc_id", "leaf", "row").sortWithinPartitions("source", "doc_id", "leaf", "row")
    ordered = saved(ranges.select(
        "doc_id", "source", "leaf", "tampered", F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at"),
    ))
    counts = ordered.groupBy("source", "part").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    of_source = Window.partitionBy("source")
    counts = counts.select(
        "source", "part", (F.sum("rows").over(of_source.orderBy("part")) - F.col("rows") - F.col("first")).alias("shift"),
        F.sum("rows").over(of_source).alias("n"),
    )
    sources = _numbered(saved(counts.groupBy("source").agg(F.first("n").alias("n"))))
    counts = saved(counts.alias("c").join(sources.alias("s"), F.expr("c.source <=> s.source")).select("part", "c.source", "shift", "c.n", "tree"))
    same = F.expr("r.part = c.part AND r.source <=> c.source")
    rows = saved(ordered.alias("r").join(counts.alias("c"), same).select(
        "doc_id", "leaf", "tampered", "tree", "n", (F.col("at") + F.col("shift")).alias("idx")
    ))
    passes, subroots = grow(rows.withColumnRenamed("leaf", "digest").select("tree", "n", "idx", "digest"))
    subroots = saved(sources.join(subroots.withColumnRenamed("root", "subroot"), "tree").select("tree", "source", "subroot"))
    number = subroots.count()
    top, root = grow(subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(number).cast("long").alias("n"), F.col("tree").alias("idx"), F.col("subroot").alias("digest")))
    found = root.first()
    return Manifest(rows, passes, subroots, top, found["root"] if found else None)


def _numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with ``tree``: their place in order, counted by ranges as well."""
    ranges = sources.repartitionByRange("source").sortWithinPartitions("source")
    ordered = saved(ranges.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")))
    counts = ordered.groupBy("part").agg(F.count("*").alias("rows"))
    before = counts.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("begin"))
    return saved(ordered.join(before, "part").select("source", "n", (F.col("begin") + F.col("at")).alias("tree")))
