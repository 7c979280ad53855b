"""Ranked search against scores in Python's whole numbers."""

import math
import random
import re
from collections import Counter

import numpy as np
from conftest import SF_DIR

from tabulant.llm import queries, ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(text):
    return Counter(TERM.findall((text or "").translate(LOWER)))


def brute(docs, items, best=20):
    own = [(i, c) for i, c in ((i, counted(t)) for i, t in docs) if c]
    n, total = len(own), sum(c.total() for _, c in own)
    df = Counter(t for _, c in own for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * k + 1))) for t, k in df.items()}
    out = []
    for item, text in items:
        found = []
        for doc, c in own:
            m = 75 + 25 * c.total() * n // total
            score = sum(k * weight[t] * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, k in counted(text).items() if t in c)
            if score > 0:
                found.append((-score, doc is None, doc))
        found.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        out += [(item, k + 1, doc, -score) for k, (score, _, doc) in enumerate(found[:best])]
    return sorted(out, key=repr)


def rows(found):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in found.collect()), key=repr)


def tables(spark, docs, items):
    left = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], "doc_id long, text string, n int, terms string, item long").repartition(4)
    return left, spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, rank int")


def test_given_tables(spark):
    read = [[tuple(r) for r in spark.read.parquet(f"{SF_DIR}/{t}.parquet").select(i, "text").collect()] for t, i in (("documents", "doc_id"), ("benchmark", "item_id"))]
    assert rows(queries.op13_ranked_search(spark, SF_DIR)) == brute(*read)


def test_random_tables_in_small_tiles_and_blocks(spark, monkeypatch):
    draw = random.Random(4)
    words = ["a", "b", "C", "dé", "Ünder", "7", "7b", "日本", "x" * 30, "e", "f", "g"]
    text = lambda most: draw.choice([" ", "-", "\x00", "\n"]).join(draw.choices(words, k=draw.randint(0, most)))
    docs = [(draw.randint(1, 400), text(30)) for _ in range(700)] + [(None, "a b"), (None, "a b"), (5, None), (6, "")]
    items = [(k, text(9)) for k in range(40)] + [(None, "a a a"), (7, "a"), (7, "a"), (8, None), (9, "unseen")]
    monkeypatch.setattr(ranked, "DOCS", 37)
    monkeypatch.setattr(ranked, "PART", 16)
    expected = brute(docs, items)
    assert rows(ranked.search(*tables(spark, docs, items))) == expected
    monkeypatch.setattr(ranked, "BLOCK", 400)
    assert rows(ranked.search(*tables(spark, docs, items))) == expected


def test_tiles_are_exact_with_small_bounds(monkeypatch):
    draw = np.random.default_rng(2)
    weights = draw.integers(0, 20_000, 60).tolist()
    items = [dict(Counter(draw.integers(0, 60, draw.integers(1, 400)).tolist())) for _ in range(30)] + [{3: 20_000_000, 4: 1}, {}]
    dense = draw.random((50, 60)) < 0.3
    row, term = np.nonzero(dense)
    impact = np.array([draw.integers(0, weights[t] * ranked.MOST + 1) for t in term], np.int64)
    full = np.zeros((50, 60), object)
    full[row, term] = [int(x) for x in impact]
    expected = [[sum(int(full[d, t]) * c for t, c in own.items()) for own in items] for d in range(50)]
    monkeypatch.setattr(ranked, "ITEMS", 7)
    for terms in (4096, 5):
        monkeypatch.setattr(ranked, "TERMS", terms)
        tiles = ranked.Tiles(items, weights)
        for first, own, columns, owners, counts in tiles.tiles:
            assert len(own) <= terms
            for k in range(7):
                assert sum(int(c) * weights[own[at]] * ranked.MOST for at, c in zip(columns[owners == k], counts[owners == k])) < ranked.EXACT
        assert tiles.scores(row, term, impact, 50).tolist() == expected


def test_edges(spark):
    docs, items = [(2, "same"), (1, "same"), (1, "same"), (3, "other words " * 200_000)], [(1, "Same same"), (2, "words")]
    left, right = tables(spark, docs, items)
    assert rows(ranked.search(left, right)) == brute(docs, items)
    assert rows(ranked.search(left, right, best=2)) == brute(docs, items, 2)
    assert rows(ranked.search(left.limit(0), right)) == [] == rows(ranked.search(left, right.limit(0)))
    left, right = tables(spark, [(1, None), (2, " - ")], [(1, "a"), (2, None)])
    assert rows(ranked.search(left, right)) == []
