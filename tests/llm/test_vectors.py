"""Vector searches against all pairs."""

import random

import numpy as np
import pytest
from conftest import SF_DIR

from tabulant.llm import ann, queries, topk


def brute(rows, asked, k, measure):
    out = {}
    for own, query in asked.items():
        scored = sorted((-measure(query, v), i) for i, v in rows.items() if i != own)
        out[own] = [(i, -s) for s, i in scored[:k]]
    return out


def by_query(found):
    out = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def given(spark):
    table = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()
    return {r.vec_id: np.array(r.embedding, float) for r in table}


def cosine(a, b):
    return float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))


def test_inner_products_of_given_vectors(spark):
    rows = {i: np.floor(256 * v).astype(int) for i, v in given(spark).items()}
    expected = brute(rows, {i: v for i, v in rows.items() if i % 50 == 0}, 5, lambda a, b: int(a @ b))
    assert by_query(queries.op2_exact_top_k(spark, SF_DIR).collect()) == expected


@pytest.mark.parametrize("size, dimensions, spread", [(900, 7, 3), (700, 40, 1000), (5, 3, 2), (600, 12, 10**6)])
def test_inner_products_with_ties_and_shards(spark, monkeypatch, size, dimensions, spread):
    monkeypatch.setattr(topk, "SHARD", 250)
    monkeypatch.setattr(topk, "QUERIES", 30)
    monkeypatch.setattr(topk, "TOGETHER", 8)
    draw = np.random.default_rng(size)
    rows = {i * 3: draw.integers(-spread, spread + 1, dimensions) for i in range(size)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], "vec_id long, vector array<long>")
    asked = {i: v for i, v in rows.items() if i % 9 == 0}
    found = topk.best_inner_products(df, df.where("vec_id % 9 = 0")).collect()
    assert by_query(found) == brute(rows, asked, 5, lambda a, b: int(a @ b))


def test_edges_of_inner_products(spark):
    rows = [(1, [1, 2]), (1, [1, 2]), (2, None), (3, []), (None, [5, 5]), (4, [-1]), (50, [2, 1, 7])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, vector array<int>, shard string, score int")
    assert by_query(topk.best_inner_products(df, df.where("vec_id = 50")).collect()) == {50: [(1, 4), (3, 0), (4, -2)]}
    assert topk.best_inner_products(df.limit(0), df).collect() == []
    assert topk.best_inner_products(df, df.limit(0)).collect() == []


def test_neighbours_of_given_vectors(spark):
    rows = given(spark)
    expected = brute(rows, {i: v for i, v in rows.items() if i % 50 == 0}, 5, cosine)
    found = by_query(queries.op1_nearest_neighbours(spark, SF_DIR).collect())
    assert {q: [i for i, _ in f] for q, f in found.items()} == {q: [i for i, _ in e] for q, e in expected.items()}
    assert all(abs(a - b) < 1e-12 for q in found for (_, a), (_, b) in zip(found[q], expected[q]))


def test_recall_over_many_blocks(spark):
    draw = np.random.default_rng(5)
    rows = {i: draw.normal(size=24) for i in range(3000)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], "vec_id long, vector array<double>")
    asked = {i: v for i, v in rows.items() if i % 50 == 0}
    expected = brute(rows, asked, 5, cosine)
    found = by_query(ann.nearest(df, df.where("vec_id % 50 = 0"), block=100).collect())
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in expected[q]}) for q in expected)
    assert set(found) == set(asked) and all(len(f) == 5 for f in found.values())
    assert hits >= 0.9 * 5 * len(expected)


def test_recall_where_blocks_are_small_against_the_table(spark, monkeypatch):
    monkeypatch.setattr(ann, "HELD", 64 * 30, raising=False)
    monkeypatch.setattr(ann, "QUERIES", 25, raising=False)
    monkeypatch.setattr(ann, "SCORES", 100, raising=False)
    draw = np.random.default_rng(6)
    rows = {i: draw.normal(size=64) for i in range(4000)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], "vec_id long, vector array<double>")
    asked = {i: v for i, v in rows.items() if i % 50 == 0}
    expected = brute(rows, asked, 5, cosine)
    found = by_query(ann.nearest(df, df.where("vec_id % 50 = 0"), block=12).collect())
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in expected[q]}) for q in expected)
    assert set(found) == set(asked) and all(len(f) == 5 for f in found.values())
    assert hits >= 0.9 * 5 * len(expected)


def test_edges_of_neighbours(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 1.0]) for i in range(100, 60, -1)] + [(1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]),
            (6, [-1.0]), (7, [1e200, 1e200]), (None, [1.0, 1.0]), (8, [])]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, vector array<double>, block int")
    found = by_query(ann.nearest(df, df.where("vec_id in (61, 90, 6, 2)")).collect())
    ids = {q: [i for i, _ in f] for q, f in found.items()}
    assert ids[61] == [7, 62, 63, 64, 65] and ids[90] == [7, 61, 62, 63, 64]
    assert set(ids) == {61, 90, 6} and abs(found[6][0][1] + 0.5**0.5) < 1e-12
    assert ann.nearest(df.limit(0), df).collect() == [] and ann.nearest(df, df.limit(0)).collect() == []


def test_curve_visits_neighbouring_cells():
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * axes)).reshape(axes, -1).T
        keys = ann.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()
