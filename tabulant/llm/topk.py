"""Exact largest inner products from an index of postings ordered by impact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabulant.llm.shared import python_ready
from tabulant.storage import stored

#: Vectors to a shard of the index, queries that go to a shard together, and those it runs at a time.
SHARD, QUERIES, TOGETHER = 8192, 4096, 512
#: Levels into which each dimension's values are quantised, and rounds in which its segments are read.
LEVELS, ROUNDS = 8, 4
#: Share of a shard from which a query's possible members are scored exactly instead of reading on.
FEW = 0.01


def flat_vectors(table: pa.Table, column: str) -> np.ndarray:
    """A column of integer lists as a matrix; shorter lists end in zeros."""
    rows = table.column(column).combine_chunks()
    offsets, values = rows.offsets.to_numpy(), rows.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values[offsets[0] : offsets[-1]])) - np.repeat(offsets[:-1] - offsets[0], sizes)] = (
        values[offsets[0] : offsets[-1]]
    )
    return out


def widened(vectors: np.ndarray, width: int) -> np.ndarray:
    return np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))


class ImpactIndex:
    """Segments of postings: for each dimension and quantised level, the vectors with such a value.

    ``values[l]`` holds the values of level ``l`` by dimension and vector, zero elsewhere, and
    ``there[l]`` marks them, so that reading many segments for many queries is a matrix product.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, kind: type) -> None:
        self.ids, self.vectors, self.kind = ids, vectors, kind
        low, high = vectors.min(axis=0), vectors.max(axis=0)
        width = np.maximum(1, -(-(high - low + 1) // LEVELS))
        level = ((vectors - low) // width).T
        self.values = [np.where(level == at, vectors.T, 0).astype(kind) for at in range(LEVELS)]
        self.there = [(level == at).astype(kind) for at in range(LEVELS)]
        # The most and the least that is found in a segment; an empty one bounds nothing.
        some = [mask.any(axis=1) for mask in self.there]
        tops = [np.where(mask > 0, vectors.T, np.iinfo(np.int64).min).max(axis=1) for mask in self.there]
        lows = [np.where(mask > 0, vectors.T, np.iinfo(np.int64).max).min(axis=1) for mask in self.there]
        self.tops = np.array([np.where(s, t, 0) for s, t in zip(some, tops)])
        self.lows = np.array([np.where(s, t, 0) for s, t in zip(some, lows)])

    def search(self, own: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the query, row of the vector, score) of each query's ``k`` best, and maybe more.

        A segment's impact for a query is the most that one of its postings can add. Every vector
        starts with the sum of its segments' impacts as bound. Segments are read by descending impact,
        a share of them each round; reading turns their part of the bound into the exact value. The
        ``k``-th best exact score found so far is a floor: a vector whose bound is below it
        is out for good. A query stops when few possible members are left, or all is read; these
        are then scored exactly.
        """
        kind = self.kind
        impact = np.maximum(queries[:, None, :] * self.tops[None], queries[:, None, :] * self.lows[None])
        flat = impact.reshape(len(queries), -1)
        rank = np.argsort(np.argsort(-flat, axis=1, kind="stable"), axis=1).reshape(impact.shape)
        turn = rank * ROUNDS // flat.shape[1] if flat.shape[1] else rank
        bound = sum(impact[:, at].astype(kind) @ self.there[at] for at in range(LEVELS))
        bound[own[:, None] == self.ids[None]] = -np.inf
        n, going = len(self.ids), np.arange(len(queries))
        floor = np.full(len(queries), -np.inf)
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        for step in range(ROUNDS + 1):
            found = bound[going]
            # Exact scores of the most promising give the floor.
            some = min(n, 4 * k)
            likely = np.argpartition(-found, some - 1, axis=1)[:, :some]
            exact = np.einsum("qcd,qd->qc", self.vectors[likely], queries[going]).astype(float)
            exact[np.take_along_axis(found, likely, axis=1) == -np.inf] = -np.inf
            if some >= k:
                floor[going] = np.maximum(floor[going], np.partition(exact, some - k, axis=1)[:, some - k])
            alive = (found >= floor[going, None]) & (found > -np.inf)
            over = alive.sum(axis=1) <= max(4 * k, FEW * n) if step < ROUNDS else np.ones(len(going), bool)
            at, row = np.nonzero(alive & over[:, None])
            pairs.append((going[at], row))
            going = going[~over]
            if not len(going):
                break
            for level in range(LEVELS):
                read = turn[going, level] == step
                if read.any():
                    value = np.where(read, queries[going], 0).astype(kind) @ self.values[level]
                    bound[going] += value - np.where(read, impact[going, level], 0).astype(kind) @ self.there[level]
        query, row = (np.concatenate(x) for x in zip(*pairs))
        score = np.zeros(len(query), np.int64)
        for at in range(0, len(query), 1 << 16):
            part = slice(at, at + (1 << 16))
            score[part] = np.einsum("pd,pd->p", self.vectors[row[part]], queries[query[part]])
        return query, row, score


def search_shard(k: int):
    """For cogrouped applyInArrow: the best of one shard's vectors for one block of queries."""

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not vectors.num_rows or not queries.num_rows:
            return none
        held, asked = flat_vectors(vectors, "vector"), flat_vectors(queries, "vector")
        width = max(held.shape[1], asked.shape[1])
        held, asked = widened(held, width), widened(asked, width)
        own, ids = queries.column("vec_id").to_numpy(), vectors.column("vec_id").to_numpy()
        # Single precision holds these integers exactly while sums stay below 2^24.
        most = int(np.abs(held).max(initial=0)) * int(np.abs(asked).max(initial=0)) * max(width, 1) * 2
        index = ImpactIndex(ids, held, np.float32 if most < 1 << 24 else np.float64)
        out = []
        for at in range(0, len(own), TOGETHER):
            part = slice(at, at + TOGETHER)
            query, row, score = index.search(own[part], asked[part], k)
            order = np.lexsort((ids[row], -score, query))
            query, row, score = query[order], row[order], score[order]
            place = np.arange(len(query)) - np.searchsorted(query, query, "left")
            best = place < k
            out.append((own[part][query[best]], ids[row[best]], score[best]))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), (np.concatenate(x) for x in zip(*out)))), schema=none.schema)

    return run


def usable(vector: Column, *, nonzero: bool = False) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    infinite = F.lit(float("inf"))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    fine = vector.isNotNull() & F.coalesce(fine, F.lit(False))
    return fine & F.exists(vector, lambda x: x != 0) if nonzero else fine


def best_inner_products(vectors: DataFrame, queries: DataFrame, *, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` vectors of largest inner product.

    Both inputs have ``vec_id`` and an array of integers ``vector``. A query never finds rows of its
    own id. Ties go to the smaller id; with fewer than ``k`` candidates all are given. The result is
    exact as long as scores stay below 2^53.

    Vectors are dealt by a hash of their id into shards of about ``SHARD``, queries into blocks of
    ``QUERIES``, and each pair of them is one group with an index of its own; its ``k`` best per
    query are merged. Rows with null ids or vectors take no part; of rows that share an id the
    greatest vector counts; a shorter vector counts as ending in zeros. Columns but the two are not read.
    """
    python_ready(vectors.sparkSession)

    def unique(df: DataFrame) -> DataFrame:
        known = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<long>").alias("vector"))
        return known.where("vec_id is not null and vector is not null").groupBy("vec_id").agg(F.max("vector").alias("vector"))

    held, asked = stored(unique(vectors), "vectors"), stored(unique(queries), "queries")
    shards, blocks = max(1, -(-held.count() // SHARD)), max(1, -(-asked.count() // QUERIES))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = held.withColumn("shard", deal(shards)).withColumn("block", every(blocks))
    right = asked.withColumn("block", deal(blocks)).withColumn("shard", every(shards))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(
        search_shard(k), "query_id long, vec_id long, score long"
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
