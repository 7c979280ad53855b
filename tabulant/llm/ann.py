"""Approximate nearest neighbours by cosine: windows on shifted Hilbert orderings of projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tabulant.llm.shared import prefix_sums, python_ready
from tabulant.llm.topk import usable
from tabulant.storage import stored

#: Orderings, dimensions each projects to, and the least candidates to a block; a query sees its block and some on both sides.
ORDERINGS, PROJECTED, BLOCK = 24, 8, 1024
#: Share of all candidates that a query sees at least in each ordering, so that recall doesn't fall as the table grows.
SHARE = 1 / 24
#: Numbers in the vectors of a block (unless ``BLOCK`` vectors have more), queries that meet it at a time, and scores held at a time.
HELD, QUERIES, SCORES = 1 << 20, 4096, 1 << 21


def matrix(values: pa.ListArray, width: int) -> np.ndarray:
    """Lists of numbers as rows of doubles, ended by zeros up to ``width``."""
    offsets, flat = values.offsets.to_numpy(), values.values.to_numpy(zero_copy_only=False).astype(float)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), width))
    at = np.arange(offsets[0], offsets[-1])
    out[np.repeat(np.arange(len(sizes)), sizes), at - np.repeat(offsets[:-1], sizes)] = flat[at]
    return out


def units(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; the largest component is divided out first, so that no square overflows."""
    scaled = vectors / np.maximum(np.abs(vectors).max(axis=1, initial=0, keepdims=True), np.finfo(float).tiny)
    return scaled / np.maximum(np.sqrt(np.einsum("nd,nd->n", scaled, scaled)), np.finfo(float).tiny)[:, None]


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of integer coordinates below ``2**bits``.

    The published transpose method: coordinates are turned and reflected bit by bit from the top
    into those of the curve's Gray code, and their bits interleaved.
    """
    axes = cells.T.astype(np.uint64).copy()
    one, low = np.uint64(1), np.uint64(0)
    for bit in range(bits - 1, 0, -1):
        below = np.uint64((1 << bit) - 1)
        for axis in range(len(axes)):
            far = (axes[axis] >> np.uint64(bit)) & one == one
            swap = np.where(far, low, (axes[0] ^ axes[axis]) & below)
            axes[0] ^= np.where(far, below, swap)
            if axis:
                axes[axis] ^= swap
    for axis in range(1, len(axes)):
        axes[axis] ^= axes[axis - 1]
    flip = np.zeros_like(axes[0])
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where((axes[-1] >> np.uint64(bit)) & one == one, np.uint64((1 << bit) - 1), low)
    axes ^= flip
    key = np.zeros(axes.shape[1], np.uint64)
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            key = key << one | (axis >> np.uint64(bit)) & one
    return key


class Orderings:
    """Random projections, each with a shift of its own, and the keys they give."""

    def __init__(self, width: int, count: int, projected: int, seed: int) -> None:
        draw = np.random.default_rng(seed)
        self.width, self.projected = width, max(1, min(projected, width))
        self.bits = min(16, 64 // self.projected)
        self.turns = [np.linalg.qr(draw.normal(size=(width, self.projected)))[0] for _ in range(count)]
        self.shifts = draw.random((count, self.projected)) / 2
        self.center = self.spread = None

    def project(self, vectors: np.ndarray) -> np.ndarray:
        return np.concatenate([units(vectors) @ turn for turn in self.turns], axis=1)

    def sums(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For mapInArrow: count, sums and sums of squares of each projected coordinate."""
        total = 0
        for batch in batches:
            found = self.project(matrix(batch.column("vector"), self.width))
            total = total + np.array([np.ones_like(found), found, found**2]).sum(axis=1)
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.shape[1])), *map(pa.array, total)], ["axis", "n", "one", "two"])

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """A key for each vector and ordering, as signed integers that sort like the curve."""
        # Most points fill half of each axis, so that a shift by up to the other half moves all borders.
        place = ((self.project(vectors) - self.center) / self.spread + 3.3) / 13.2 + self.shifts.reshape(-1)
        cells = np.clip(place * (1 << self.bits), 0, (1 << self.bits) - 1).astype(np.int64).reshape(len(vectors), -1, self.projected)
        found = [hilbert_keys(cells[:, o], self.bits) for o in range(cells.shape[1])]
        return (np.array(found).T ^ np.uint64(1 << 63)).view(np.int64) if len(vectors) else np.zeros((0, cells.shape[1]), np.int64)


def nearest_in_block(width: int, k: int):
    """For cogrouped applyInArrow: each query's ``k`` nearest of one block."""

    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        schema = pa.schema([("query_class", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not candidates.num_rows or not queries.num_rows:
            return schema.empty_table()
        held = units(matrix(candidates.column("vector").combine_chunks(), width))
        asked = units(matrix(queries.column("vector").combine_chunks(), width))
        ids, own = candidates.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
        some, step, parts = min(len(ids), 2 * k), max(1, SCORES // len(ids)), []
        for at in range(0, len(own), step):
            part = asked[at : at + step]
            pick = np.argpartition(-(part @ held.T), some - 1, axis=1)[:, :some]
            # Each pair by itself, so that its score is the same in whichever block it is met.
            score = np.einsum("qcd,qd->qc", held[pick], part)
            order = np.lexsort((ids[pick], -score))[:, :k]
            best, score = ids[np.take_along_axis(pick, order, 1)], np.take_along_axis(score, order, 1)
            parts.append(pa.table([np.repeat(own[at : at + step], best.shape[1]), best.reshape(-1), score.reshape(-1)], schema=schema))
        return pa.concat_tables(parts)

    return run


def nearest(
    vectors: DataFrame, queries: DataFrame, *, k: int = 5, orderings: int = ORDERINGS, projected: int = PROJECTED,
    block: int = BLOCK, share: float = SHARE, seed: int = 11,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: of each query the ``k`` nearest found, by cosine.

    Both inputs have ``vec_id`` and an array of numbers ``vector``; a query never finds rows of its own
    id. Every vector gets a key on each of several Hilbert curves, each through a random
    projection shifted at random. Spark range-sorts the keys; runs of at least ``block`` candidates form
    blocks, and a query is compared with its own and as many on both sides as hold ``share`` of all
    candidates, one at least. So the window grows with the table, while a task meets one block of
    bounded size and ``QUERIES`` queries at a time. The ``k`` best of all blocks and orderings are
    merged. Scores are cosines of the vectors themselves.

    Equal vectors are indexed by their ``k + 1`` smallest ids, since no query can want more of them, and
    equal queries are searched once; so copies fill no window. Ties go to the smaller id. Vectors
    that are null, zero, or hold null or non-finite components take no part, nor do null ids; of rows
    that share an id the greatest vector counts; a shorter vector counts as ending in zeros.
    Columns but the two are not read.
    """
    python_ready(vectors.sparkSession)

    def unique(df: DataFrame, label: str) -> DataFrame:
        known = df.select(F.col("vec_id").cast("long").alias("vec_id"), "vector").where("vec_id is not null")
        return stored(known.where(usable(F.col("vector"), nonzero=True)).groupBy("vec_id").agg(F.max("vector").alias("vector")), label)

    held, asked = unique(vectors, "vectors"), unique(queries, "queries")
    width = held.agg(F.max(F.size("vector"))).first()[0] or 1
    width = max(width, asked.agg(F.max(F.size("vector"))).first()[0] or 1)
    curves = Orderings(width, orderings, projected, seed)
    stats = held.select("vector").mapInArrow(curves.sums, "axis long, n double, one double, two double")
    stats = stats.groupBy("axis").agg(*[F.sum(c).alias(c) for c in ("n", "one", "two")]).orderBy("axis").toArrow()
    n, one, two = (stats.column(c).to_numpy() for c in ("n", "one", "two"))
    curves.center = one / n if len(n) else np.zeros(orderings * curves.projected)
    curves.spread = np.sqrt(np.maximum(two / n - curves.center**2, 1e-12)) if len(n) else np.ones(len(curves.center))

    def keyed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            keys = curves.keys(matrix(batch, width))
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * orderings, pa.int32()), pa.array(keys.reshape(-1)))

    same = Window.partitionBy(F.xxhash64("vector"), "vector").orderBy("vec_id")
    firsts = held.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1).select("vec_id", "vector")
    classes = asked.groupBy(F.xxhash64("vector").alias("hash"), "vector").agg(F.min("vec_id").alias("vec_id"))
    sides = stored(
        firsts.withColumn("asks", F.lit(False)).unionByName(classes.select("vec_id", "vector").withColumn("asks", F.lit(True))), "sides"
    )
    keys = F.arrow_udf(keyed, "array<long>")
    points = sides.select("vec_id", "asks", keys("vector").alias("keys"))
    points = stored(points.select("vec_id", "asks", F.posexplode("keys").alias("ordering", "key")), "points")
    order = [F.col("ordering"), F.col("key"), F.col("vec_id"), F.col("asks")]
    sums = {"before": F.when(F.col("asks"), 0).otherwise(1).cast("long"), "asked": F.col("asks").cast("long")}
    placed = prefix_sums(points, order, sums, "curves")
    # Every ordering holds all candidates, so places within it start from a multiple of their number.
    size = sides.where("not asks").count()
    window = math.ceil(share * size)
    wide = max(block, min(HELD // width, -(-window // 3)))
    reach, last = max(1, -(-(window - wide) // (2 * wide))), max(0, -(-size // wide) - 1)
    place = F.col("before") - F.col("ordering") * F.lit(size)
    tile = F.floor(F.col("asked") / QUERIES)
    placed = placed.select("vec_id", "asks", "ordering", F.floor(place / wide).alias("block"), tile.alias("tile"))
    # At the ends of a curve the window lies on one side.
    first = F.greatest(F.lit(0), F.least(F.col("block") - reach, F.lit(last - 2 * reach)))
    around = F.explode(F.sequence(first, F.least(first + 2 * reach, F.lit(last))))
    searching = placed.where("asks").select("vec_id", "ordering", "tile", around.alias("block"))
    # New names for the same columns, since both sides of the comparison come from one table.
    names = ["ordering", "block", "tile"]
    wanted = searching.select(*[F.col(c).alias(c) for c in names]).distinct()
    candidates = placed.where("not asks").select(*[F.col(c).alias(c) for c in ("vec_id", "ordering", "block")]).join(wanted, ["ordering", "block"])
    candidates = candidates.join(sides.where("not asks").select("vec_id", "vector"), "vec_id").select(*[F.col(c).alias(c) for c in (*names, "vec_id", "vector")])
    searching = searching.join(sides.where("asks").select("vec_id", "vector"), "vec_id").select(*[F.col(c).alias(c) for c in (*names, "vec_id", "vector")])
    found = candidates.groupBy(*names).cogroup(searching.groupBy(*names)).applyInArrow(
        nearest_in_block(width, k + 1), "query_class long, vec_id long, score double"
    )
    merged = stored(found.groupBy("query_class", "vec_id").agg(F.max("score").alias("score")), "found")
    # One more than asked for, since a query's own id may be among them.
    best = Window.partitionBy("query_class").orderBy(F.col("score").desc(), "vec_id")
    merged = merged.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    joined = asked.join(classes.withColumnRenamed("vec_id", "query_class"), "vector").select(F.col("vec_id").alias("query_id"), "query_class")
    pairs = joined.join(merged, "query_class").where("vec_id <> query_id")
    last = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
