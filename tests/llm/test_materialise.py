"""Shards of tokens against the stream they must hold."""

import hashlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from conftest import SF_DIR
from tokenizers import Tokenizer

from tabulant.llm import materialise as m, queries


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation(size):
    order = m.Permutation(size, 9)
    slots = order.slots(np.arange(size))
    assert sorted(slots) == list(range(size)) and (order.sequences(slots) == np.arange(size)).all()
    if size >= 1000:
        assert (slots != m.Permutation(size, 10).slots(np.arange(size))).mean() > 0.9
        assert abs(np.corrcoef(slots, np.arange(size))[0, 1]) < 0.15




def test_shards_hold_the_stream_in_slot_order(spark, tmp_path):
    draw = np.random.default_rng(4)
    rows = [(i, draw.integers(0, 256, int(n)).astype(np.uint8).tobytes()) for i, n in enumerate(draw.integers(0, 300, 150) // 2 * 2)]
    rows += [(7, rows[7][1]), (7, rows[7][1]), (500, None), (501, b""), (502, bytes(range(256)) * 100), (None, b"abcd")]
    draw.shuffle(rows)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, tokens binary, piece string, slot int")
    options = {"sequence": 16, "per_shard": 20}
    manifest = m.materialise(df, f"file://{tmp_path}/a", key=5, **options)
    written = {r.shard: r for r in manifest.collect()}
    files = sorted(Path(tmp_path, "a").iterdir())
    data = b"".join(f.read_bytes() for f in files)
    assert [hashlib.sha256(f.read_bytes()).hexdigest() for f in files] == [written[k].sha256 for k in sorted(written)]
    total = sum(len(t or b"") for _, t in rows)
    n = -(-total // 32)
    assert len(data) == n * 32 and sum(r.sequences for r in written.values()) == n
    slots = m.Permutation(n, 5).slots(np.arange(n))
    stream = b"".join(data[s * 32 : s * 32 + 32] for s in slots)
    # Ids ascend; documents with one id may lie in any order.
    ordered = b"".join(t or b"" for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])) + b"abcd"
    assert stream[:total] == ordered and not any(stream[total:])
    back = m.read_back(spark, manifest, key=5, **options).collect()
    assert sorted(r.slot for r in back) == list(range(n))
    assert all(hashlib.sha256(data[r.slot * 32 : r.slot * 32 + 32]).hexdigest() == r.tokens_sha256 for r in back)
    assert all(slots[r.sequence] == r.slot and r.byte_offset == r.slot % 20 * 32 for r in back)


def test_query_holds_the_library_s_ids(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = sorted(spark.read.parquet(f"{SF_DIR}/documents.parquet").collect(), key=lambda r: r.doc_id)
    ids = [i for r in rows for i in [*library.encode(r.text or "", add_special_tokens=False).ids, library.token_to_id("<|endoftext|>")]]
    assert max(ids) < 1 << 16
    n = -(-len(ids) // m.SEQUENCE)
    stream = np.array(ids + [0] * (n * m.SEQUENCE - len(ids)), "<u2").reshape(n, m.SEQUENCE)
    found = {r.sequence: r.tokens_sha256 for r in queries.op7_training_order(spark, SF_DIR).collect()}
    assert found == {k: hashlib.sha256(s.tobytes()).hexdigest() for k, s in enumerate(stream)}


def test_edges(spark, tmp_path):
    none = spark.createDataFrame([(1, None)], "doc_id long, tokens binary")
    assert m.materialise(none, f"{tmp_path}/b").collect() == [] == m.materialise(none.limit(0), f"{tmp_path}/c").collect()
    assert m.read_back(spark, m.materialise(none, f"{tmp_path}/d")).collect() == []
    ids = spark.createDataFrame([([1, 2, 70],), (None,), ([],)], "ids array<int>")
    packed = [r[0] for r in ids.select(m.packed_ids(spark, 9)("ids")).collect()]
    assert [np.frombuffer(p, "<u2").tolist() for p in packed] == [[1, 2, 70, 9], [9], [9]]
