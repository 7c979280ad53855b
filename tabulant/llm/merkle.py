"""Merkle manifest of a dataset: aligned builders append nodes in postorder, and proofs find siblings by closed form."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabulant.llm.shared import prefix_sums, shipped
from tabulant.storage import stored

#: Rows of proofs that a task gives at a time.
ROWS = 512
HEX = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEPS = "array<struct<left: string, right: string>>"


def field(value: Column) -> Column:
    """A value as leaves hold it: ``-`` if null, else its length in bytes, a colon and itself."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    """The lowercase hex SHA-256 of fields, one after another."""
    return F.sha2(F.concat(*map(field, values)), 256)


def joined_hash(digests: str) -> str:
    """A parent's digest, from its children's in hex, joined."""
    return hashlib.sha256(digests.encode()).hexdigest()


@dataclass(frozen=True)
class Shape:
    """How trees branch: ``fan`` nodes to a parent, and builders of ``levels`` levels over ``chunk`` leaves."""

    fan: int = 16
    levels: int = 3

    @property
    def chunk(self) -> int:
        return self.fan**self.levels

    def height(self, size: int) -> int:
        """Levels above the leaves of a tree: none for a lone leaf."""
        levels = 0
        while size > 1:
            size, levels = -(-size // self.fan), levels + 1
        return levels

    def position(self, level: int, index: np.ndarray | int, size: int, levels: int) -> np.ndarray:
        """Where the node stands in the log of a tree of ``size`` leaves, counted from 0.

        A node is written when the last leaf below it has been. By then the log holds, of its own level and those below,
        every node that starts at or before that leaf, and of the levels above, those that were full before.
        """
        last = np.minimum((np.asarray(index, np.int64) + 1) * self.fan**level, size)
        below = sum(-(-last // self.fan**k) for k in range(level + 1))
        return below + sum((last - 1) // self.fan**k for k in range(level + 1, levels + 1)) - 1

    def log_of(self, leaves: list[str], levels: int) -> list[str]:
        """The log of one builder: every leaf is appended, then each node that it completes.

        ``open_`` holds, by level, the nodes of the run that is not full yet: at most ``fan`` of each. At the end
        what is open closes level by level, so that the log ends with the root.
        """
        log: list[str] = []
        open_: list[list[str]] = [[] for _ in range(levels + 1)]

        def append(level: int, digest: str) -> None:
            log.append(digest)
            open_[level].append(digest)
            if level < levels and len(open_[level]) == self.fan:
                close(level)

        def close(level: int) -> None:
            run = "".join(open_[level])
            open_[level].clear()
            append(level + 1, joined_hash(run))

        for leaf in leaves:
            append(0, leaf)
        for level in range(levels):
            if open_[level]:
                close(level)
        return log

    def steps_of(self, log: str, size: int, levels: int, places: np.ndarray) -> list[list[tuple[str, str]]]:
        """For each place of a leaf, its siblings to the left and to the right on each level, from a builder's log in hex."""
        out: list[list[tuple[str, str]]] = [[] for _ in places]
        count = size
        for level in range(levels):
            at = (self.position(level, np.arange(count), size, levels) * HEX).tolist()
            row = "".join([log[k : k + HEX] for k in at])
            for steps, own in zip(out, (places // self.fan**level).tolist()):
                run = own - own % self.fan
                steps.append((row[run * HEX : own * HEX], row[(own + 1) * HEX : (run + self.fan) * HEX]))
            count = -(-count // self.fan)
        return out


LOG = "tree string, chunk long, size long, leaves int, levels int, position long, nodes binary"


def builders(shape: Shape):
    """For mapInArrow over leaves sorted by tree, chunk and place: the log of each chunk, as one row.

    ``size`` is the tree's number of leaves on this tier. A tree of several chunks has all levels in each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, size, held = None, 0, []

        def close() -> pa.RecordBatch:
            levels = min(shape.levels, shape.height(size))
            nodes = bytes.fromhex("".join(shape.log_of(held, levels)))
            first = int(shape.position(0, now[1] * shape.chunk, size, shape.height(size)))
            row = {"tree": [now[0]], "chunk": [now[1]], "size": [size], "leaves": [len(held)], "levels": [levels], "position": [first]}
            columns = [pa.array(row["tree"], pa.string()), *[pa.array(row[c], pa.int64()) for c in ("chunk", "size")],
                       *[pa.array(row[c], pa.int32()) for c in ("leaves", "levels")], pa.array(row["position"], pa.int64()), pa.array([nodes], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, [*row, "nodes"])

        for batch in batches:
            for tree, at, total, digest in zip(*(batch.column(c).to_pylist() for c in ("tree", "at", "size", "digest"))):
                if now != (tree, at // shape.chunk):
                    if held:
                        yield close()
                    now, size, held = (tree, at // shape.chunk), total, []
                held.append(digest.hex())
        if held:
            yield close()

    return run


def chunked(df: DataFrame, *order: str) -> DataFrame:
    """Rows dealt out by tree and chunk and sorted within them."""
    return df.repartition("tree", "chunk").sortWithinPartitions("tree", "chunk", *order)


def grown(leaves: DataFrame, label: str, shape: Shape) -> list[DataFrame]:
    """The logs of trees, tier by tier, from ``tree, at, size, digest``: a place from 0, the tree's number of leaves, 32 bytes.

    A builder has at most ``chunk`` leaves, aligned to a multiple of that, so that a tree's builders work apart; their roots
    are the leaves of the next tier, until one is left of every tree. The number of tiers is the logarithm of
    the largest tree to the base ``chunk``.
    """
    logs = []
    most = leaves.agg(F.max("size")).first()[0]
    while most:
        dealt = chunked(leaves.withColumn("chunk", F.floor(F.col("at") / shape.chunk)), "at")
        log = stored(dealt.mapInArrow(builders(shape), LOG), label)
        logs.append(log)
        most = -(-most // shape.chunk) if most > shape.chunk else 0
        root = F.expr("substring(nodes, length(nodes) - 31, 32)")
        chunks = F.ceil(F.col("size") / shape.chunk)
        leaves = log.where(F.col("size") > shape.chunk).select("tree", F.col("chunk").alias("at"), chunks.alias("size"), root.alias("digest"))
    return logs


def roots(logs: list[DataFrame], shape: Shape) -> DataFrame:
    """``tree, tier, root``: the last node of each tree's last log."""
    root = F.lower(F.hex(F.expr("substring(nodes, length(nodes) - 31, 32)")))
    parts = [log.where(F.col("size") <= shape.chunk).select("tree", F.lit(k).alias("tier"), root.alias("root")) for k, log in enumerate(logs)]
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    return found


def with_proofs(members: DataFrame, log: DataFrame, above: DataFrame, shape: Shape) -> DataFrame:
    """Leaves of one tier (tree, at and any other columns) with ``steps`` to the root of all.

    ``above`` has ``tree, chunk, steps``: what follows above each builder's root. The log of a builder,
    what is above it and its leaves meet in one task, in this order, and pass through it as a stream.
    """
    carried = [c for c in members.columns if c not in ("tree", "at")]
    leaf = members.withColumns({"chunk": F.floor(F.col("at") / shape.chunk), "kind": F.lit(2)})
    built = log.select("tree", "chunk", "leaves", "levels", "nodes", F.lit(0).alias("kind"))
    upper = above.select("tree", "chunk", F.col("steps").alias("upper"), F.lit(1).alias("kind"))
    together = leaf.unionByName(built, allowMissingColumns=True).unionByName(upper, allowMissingColumns=True)
    step = T.StructType().add("left", "string").add("right", "string")
    out = T.StructType([*members.schema, T.StructField("steps", T.ArrayType(step))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, size, levels, rest = "", 0, 0, []
        for batch in batches:
            kind = batch.column("kind").to_numpy(zero_copy_only=False)
            for at in np.flatnonzero(kind < 2).tolist() + [batch.num_rows]:
                start = int(np.flatnonzero(kind[:at] < 2).max(initial=-1)) + 1
                for first in range(start, at, ROWS):
                    part = batch.slice(first, min(ROWS, at - first))
                    places = part.column("at").to_numpy() % shape.chunk
                    steps = [own + rest for own in shape.steps_of(nodes, size, levels, places)]
                    flat = [s for own in steps for s in own]
                    pairs = pa.StructArray.from_arrays([pa.array([s[k] for s in flat], pa.string()) for k in (0, 1)], ["left", "right"])
                    offsets = pa.array(np.concatenate(([0], np.cumsum([len(s) for s in steps]))).astype(np.int32))
                    lists = pa.ListArray.from_arrays(offsets, pairs)
                    yield pa.RecordBatch.from_arrays([*[part.column(c) for c in out.names[:-1]], lists], out.names)
                if at < batch.num_rows and kind[at] == 0:
                    nodes = batch.column("nodes")[at].as_py().hex()
                    size, levels = batch.column("leaves")[at].as_py(), batch.column("levels")[at].as_py()
                elif at < batch.num_rows:
                    rest = [(s["left"], s["right"]) for s in batch.column("upper")[at].as_py()]

    columns = ["tree", "chunk", "kind", "at", "leaves", "levels", "nodes", "upper", *carried]
    return chunked(together.select(*columns), "kind", "at").mapInArrow(run, out)


def proofs(members: DataFrame, logs: list[DataFrame], beyond: DataFrame, shape: Shape) -> DataFrame:
    """Leaves of trees with the steps to the root of all; ``beyond`` has ``tree, steps`` from each tree's root on.

    From the highest tier down, the roots of each tier's builders get their steps, which are what is above the leaves of the tier below.
    """
    above = None
    for tier in reversed(range(len(logs))):
        lone = logs[tier].where(F.col("size") <= shape.chunk).select("tree", "chunk")
        ends = lone.join(beyond, lone["tree"].eqNullSafe(beyond["tree"])).select(lone["tree"], "chunk", "steps")
        if above is not None:
            inner = with_proofs(logs[tier].where(F.col("size") > shape.chunk).select("tree", F.col("chunk").alias("at")), logs[tier + 1], above, shape)
            ends = ends.union(inner.select("tree", F.col("at").alias("chunk"), "steps"))
        above = stored(ends, "paths")
    return with_proofs(members, logs[0], above, shape)


class Manifest:
    """The logs of all sources' trees and of the tree of their roots, and the leaves in their places.

    ``leaves``: ``tree`` (the source), ``at``, ``size`` and ``digest`` in 32 bytes, with ``doc_id`` and what ``manifest`` was asked to carry.
    """

    def __init__(self, leaves: DataFrame, logs: list[DataFrame], subroots: DataFrame, top: list[DataFrame], root: str | None, shape: Shape) -> None:
        self.leaves, self.logs, self.subroots, self.top, self.root = leaves, logs, subroots, top, root
        self.shape = shape

    def nodes(self) -> DataFrame:
        """Every node of the sources' logs: ``tree, level, index, position, digest``; by position they are in postorder."""
        found = None
        for tier, log in enumerate(self.logs):
            part = log.select("tree", "chunk", "leaves", "levels", F.lit(tier).alias("tier"), "nodes")
            found = part if found is None else found.union(part)
        shape = self.shape
        sizes = self.leaves.groupBy("tree").agg(F.max("size").alias("size"))
        found = found.join(sizes, found["tree"].eqNullSafe(sizes["tree"])).select(found["*"], "size")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    data, whole = row["nodes"].hex(), shape.height(row["size"])
                    count = row["leaves"]
                    for level in range(row["levels"] + 1):
                        # A builder's leaves beyond the first tier are roots of the tier below, which has them.
                        if level or not row["tier"]:
                            own = shape.position(level, np.arange(count), row["leaves"], row["levels"]).tolist()
                            high = level + shape.levels * row["tier"]
                            index = np.arange(count) + row["chunk"] * shape.fan ** (shape.levels - level)
                            columns = [pa.array([row["tree"]] * count, pa.string()), pa.array([high] * count, pa.int32()), pa.array(index),
                                       pa.array(shape.position(high, index, row["size"], whole)), pa.array([data[k * HEX : (k + 1) * HEX] for k in own])]
                            yield pa.RecordBatch.from_arrays(columns, ["tree", "level", "index", "position", "digest"])
                        count = -(-count // shape.fan)

        return found.mapInArrow(run, "tree string, level int, index long, position long, digest string")

    def proofs(self) -> DataFrame:
        """The leaves with ``steps``, the siblings to the left and right on each level up to the root of all, and ``subroot``."""
        spark = self.leaves.sparkSession
        if self.root is None:
            return self.leaves.selectExpr("*", f"cast(null as {STEPS}) as steps", "cast(null as string) as subroot")
        end = spark.createDataFrame([("", [])], f"tree string, steps {STEPS}")
        sources = self.subroots.select(F.lit("").alias("tree"), "at", "source", "subroot")
        beyond = stored(proofs(sources, self.top, end, self.shape).select(F.col("source").alias("tree"), "steps"), "paths")
        subroots = self.subroots.select("source", "subroot")
        leaves = self.leaves.join(subroots, self.leaves["tree"].eqNullSafe(subroots["source"])).drop("source")
        return proofs(leaves, self.logs, beyond, self.shape)


def manifest(docs: DataFrame, leaf: Column, order: list[Column], shape: Shape = Shape(), **carried: Column) -> Manifest:
    """The Merkle trees of ``docs``: one for each ``source``, over ``leaf`` (hex) by ``doc_id``, and one over their roots by source.

    As many consecutive nodes as ``shape`` says become one, the last run as many as there are, until one node is left. Null ids and null
    sources come first; rows of one id follow in the order of their leaves, then ``order``, so that equal rows may change places, which changes nothing.
    ``carried`` are columns to keep with each leaf, by names other than ``tree, at, size, digest, doc_id``. Texts are read once; what is sorted and
    moved is a digest a row. An empty table has no root. Other columns are not read.
    """
    shipped(docs.sparkSession)
    rows = docs.select(F.col("source").alias("tree"), "doc_id", F.unhex(leaf).alias("digest"), *[c.alias(n) for n, c in carried.items()])
    rows = stored(rows, "leaves")
    by = [F.col("tree").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("digest"), *order]
    placed = stored(prefix_sums(rows, by, {"place": F.lit(1).cast("long")}, "placed"), "placed")
    sources = stored(placed.groupBy("tree").agg(F.min("place").alias("start"), F.count("*").alias("size")), "sources")
    joined = placed.join(sources, placed["tree"].eqNullSafe(sources["tree"]))
    leaves = joined.select(placed["tree"], (F.col("place") - F.col("start")).alias("at"), "size", "digest", "doc_id", *carried)
    logs = grown(leaves, "log", shape)
    if not logs:
        return Manifest(leaves, [], None, [], None, shape)
    found = roots(logs, shape).select(F.col("tree").alias("source"), F.col("root").alias("subroot"))
    subroots = stored(prefix_sums(found, [F.col("source").asc_nulls_first()], {"at": F.lit(1).cast("long")}, "subroots"), "subroots")
    count = subroots.count()
    top = grown(subroots.select(F.lit("").alias("tree"), "at", F.lit(count).cast("long").alias("size"), F.unhex("subroot").alias("digest")), "top", shape)
    return Manifest(leaves, logs, subroots, top, roots(top, shape).first().root, shape)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings on its way give."""
    return F.aggregate(steps, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def siblings(steps: Column) -> Column:
    """All digests of a proof, level by level and left to right, joined."""
    return F.array_join(F.transform(steps, lambda step: F.concat(step["left"], step["right"])), "")
