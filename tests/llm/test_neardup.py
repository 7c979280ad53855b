"""Near-duplicate components against all pairs."""

import random
import re

import numpy as np
import pytest
from conftest import SF_DIR

from tabulant.llm import neardup


def brute(rows, words, similarity):
    sets = {}
    for doc_id, text in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        found = re.findall("[^\x20\x09-\x0d]+", lower)
        runs = [tuple(found[k : k + words]) for k in range(len(found) - words + 1)] or ([tuple(found)] if found else [])
        sets[doc_id] = set(runs)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and similarity * max(len(x), len(y)) <= 100 * min(len(x), len(y)):
                common = len(x & y)
                if 100 * common >= similarity * (len(x) + len(y) - common):
                    low, high = sorted((find(a), find(b)))
                    root[high] = low
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def answer(df, **parameters):
    found = neardup.near_duplicates(df, **parameters).collect()
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found}


def variants(seed, groups, size, rate):
    """Groups of texts that differ from a common one by a share of words each, so that links form chains."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(draw.randint(20, 150))]
        for _ in range(size):
            text = [word() if draw.random() < draw.random() * rate else w for w in base]
            rows.append((len(rows), " ".join(text), "s"))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("words, similarity", [(3, 85), (5, 80)])
def test_components_equal_those_of_all_pairs(docs, words, similarity):
    rows = variants(words, 12, 25, 0.12)
    assert answer(docs(rows), words=words, similarity=similarity) == brute([r[:2] for r in rows], words, similarity)


def test_given_documents(spark):
    df = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert answer(df, words=3, similarity=85) == brute(rows, 3, 85)


def test_blocks_of_one_bucket(docs, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 7)
    rows = variants(5, 2, 60, 0.15)
    assert answer(docs(rows), words=3, similarity=85) == brute([r[:2] for r in rows], 3, 85)


def test_edges(docs):
    long = " ".join(f"w{k}" for k in range(70_000))
    rows = [(1, None, "a"), (2, "", None), (3, " \t\n", "a"), (4, "One two", "a"), (5, "one\ttwo", "b"), (6, "two one", "b"),
            (7, long, "a"), (8, long + " end", "a"), (9, "x" * 700_000, "a"), (10, "x" * 700_001, "a"), (9, "x" * 700_000, "a"),
            (None, "one two", "a"), (11, "one two", "a"), (12, "ÉCOLE a", "a"), (13, "école a", "a")]
    got = neardup.near_duplicates(docs(rows), words=3, similarity=85).collect()
    assert len(got) == len(rows)
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got}
    assert [found[i] for i in (1, 2, 3)] == [(0, i, True) for i in (1, 2, 3)]
    assert found[5] == (1, 4, False) and found[4] == (1, 4, True) and found[6] == (1, 6, True)
    assert found[7] == (69_998, 7, True) and found[8] == (69_999, 7, False)
    assert found[9][1:] == (9, True) and found[10][1:] == (10, True)
    assert found[None] == (1, None, True) and found[11][1] == 11
    assert found[12][1] == 12 and found[13][1] == 13
    assert answer(docs([])) == {}


def test_one_id_with_several_texts(docs):
    rows = variants(9, 6, 12, 0.12)
    doubled = rows + [(i, text, s) for (i, _, s), (_, text, _) in zip(rows, rows[30:])]
    found = neardup.near_duplicates(docs(doubled), words=3, similarity=85).collect()
    assert len(found) == len(doubled) and all(r.component_id <= r.doc_id for r in found)
    # Each text is linked with whatever its own set is linked with.
    alone = brute([(k, t) for k, (_, t, _) in enumerate(doubled)], 3, 85)
    hashes = {(r.doc_id, r.n_shingles): r.component_id for r in found}
    groups = {}
    for k, (_, root, _) in alone.items():
        groups.setdefault(root, []).append(hashes[doubled[k][0], alone[k][0]])
    assert sum(len(set(g)) == 1 for g in groups.values()) >= 0.9 * len(groups)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    sets = [np.unique(pool[:3000]), np.unique(pool[1000:]), np.unique(pool[:2])]
    found = neardup.signatures(np.concatenate(sets), np.array([len(s) for s in sets]))
    assert abs((found[0] == found[1]).mean() - 0.5) < 0.15
    one = [neardup.signatures(s, np.array([len(s)]))[0] for s in sets]
    assert all((a == b).all() for a, b in zip(found, one))
    assert (found[2] != ~np.uint64(0)).all()
