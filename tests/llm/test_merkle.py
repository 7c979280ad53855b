"""The Merkle manifest against a plain tree and an append log written one leaf after another."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tabulant.llm import merkle, queries


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(leaves, fan=16):
    """The root, and for each leaf its siblings, run by run."""
    ways, place, row = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(row) > 1:
        runs = [row[k : k + fan] for k in range(0, len(row), fan)]
        for k, at in enumerate(place):
            run = runs[at // fan]
            ways[k].append((run[: at % fan], run[at % fan + 1 :]))
            place[k] = at // fan
        row = [sha("".join(run)) for run in runs]
    return row[0], ways


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def brute(rows, fan=16):
    """What the query gives for rows of (doc_id, text, lang, source, n_chars)."""
    lower = str.maketrans(merkle.UPPER, merkle.LOWER)
    leaf = lambda r, text: sha("".join(map(field, (r[0], r[3], r[2], r[4], text))))
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    by_source = {s: sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for s in sources}
    trees = {s: plain([leaf(r, r[1]) for r in own], fan) for s, own in by_source.items()}
    root, tops = plain([trees[s][0] for s in sources], fan)
    out = []
    for s, top in zip(sources, tops):
        for r, way in zip(by_source[s], trees[s][1]):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            fold = leaf(r, r[1].translate(lower) if changed and r[1] is not None else r[1])
            for left, right in way + top:
                fold = sha("".join(left) + fold + "".join(right))
            proof = sha("".join("".join(left + right) for left, right in way + top))
            out.append((r[0], leaf(r, r[1]), trees[s][0], root, proof, fold, fold == root))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, at int, size string, digest int, steps int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, 3) for r in rows], SCHEMA).repartition(4)


def some(draw, count, sources):
    text = lambda: draw.choice([None, "", "Ab É", "no capitals", "WORD " * draw.randint(1, 30)])
    return [(k, text(), draw.choice(["en", None]), draw.choice(sources), draw.choice([None, 7])) for k in range(count)]


@pytest.mark.parametrize("count, sources", [(1, ["a"]), (16, ["a"]), (17, [None]), (300, ["b", None, "", "é", "a"]), (400, [f"s{k}" for k in range(60)])])
def test_proofs_of_small_trees(spark, count, sources):
    rows = some(random.Random(count), count, sources)
    assert found(queries.merkle_digests(table(spark, rows))) == brute(rows)


def test_several_tiers(spark, monkeypatch):
    shape = merkle.Shape(fan=3, levels=2)
    monkeypatch.setattr(merkle, "ROWS", 5)
    rows = some(random.Random(7), 420, ["hot"] * 40 + [f"s{k}" for k in range(30)])
    docs = table(spark, rows)
    assert found(queries.merkle_digests(docs, shape)) == brute(rows, 3)
    whole = merkle.manifest(docs, merkle.leaf_digest(F.col("doc_id")), [], shape)
    assert len(whole.logs) > 2 and len(whole.top) > 1
    nodes = {}
    for r in whole.nodes().collect():
        nodes.setdefault(r.tree, []).append((r.position, r.level, r.digest))
    for source in {r[3] for r in rows}:
        leaves = [sha(field(k)) for k in sorted(r[0] for r in rows if r[3] == source)]
        log = shape.log_of(leaves, shape.height(len(leaves)))
        assert [(p, d) for p, _, d in sorted(nodes[source])] == list(enumerate(log))


def test_positions_are_those_of_an_append_log():
    shape = merkle.Shape()
    for size in [*range(1, 40), 255, 256, 257, 272, 273, 4095, 4096, 4097, 5000]:
        levels = shape.height(size)
        log = shape.log_of([str(k) for k in range(size)], levels)
        count, row = size, [str(k) for k in range(size)]
        for level in range(levels + 1):
            at = [int(shape.position(level, k, size, levels)) for k in range(count)]
            assert [log[k] for k in at] == row
            row = [sha("".join(row[k : k + 16])) for k in range(0, count, 16)]
            count = -(-count // 16)
        assert len(log) == int(shape.position(levels, 0, size, levels)) + 1


def test_edges(spark):
    rows = [(None, "A", "en", None, 1), (None, None, None, None, None), (5, "Same", "en", "a", 4), (5, "Same", "en", "a", 4), (5, "Other", "en", "a", 4)]
    rows += [(6, "x" * 3_000_000, "en", "a", 4), (2**62, "", "", "", 0)]
    assert found(queries.merkle_digests(table(spark, rows))) == brute(rows)
    assert found(queries.merkle_digests(table(spark, rows).limit(0))) == []
