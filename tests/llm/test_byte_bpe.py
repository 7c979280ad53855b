"""Byte-level BPE against the library that defines it."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from conftest import SF_DIR
from hypothesis import given, settings, strategies as st

from tabulant.llm import byte_bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
CASES = [
    "", None, "Hello's they'll   I'd 'se 's \n 's\n's ''s !'s 5's 'r 're", "a  b", "a \n", "  ", "don't\t't", "'", "''", "'re've'", "x's's", " 　 x",
    "日本語 テスト 한국어 ไทย हिन्दी", "😀👩‍👩‍👧 🇩🇪", "½ ² ٣ Ⅷ", "՘'s ͸'s", "\x1c\x1d \x85x",
]


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.Ranks(PATH)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own(ranks):
    return byte_bpe.Encoder(ranks)


def same(own, library, texts):
    ids, sizes = own.encode(pa.array(texts, pa.string()))
    assert byte_bpe.id_lists(ids, sizes).to_pylist() == [library.encode_ordinary(t or "") for t in texts]
    assert byte_bpe.byte_strings(own.ranks, ids, sizes).to_pylist() == [(t or "").encode() for t in texts]


def test_cases(own, library):
    same(own, library, CASES)
    same(own, library, CASES[::-1] + CASES)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("abtheirnvl sdm'’ \t\n1é中!.", max_size=60)), max_size=5))
def test_random_texts(own, library, texts):
    same(own, library, texts)


def test_every_character_in_every_place(own, library):
    characters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(characters), 20_000):
        same(own, library, [f"the{c}the {c}1{c}!{c}{c}'s{c}" for c in characters[k : k + 20_000 : 7]])


def test_long_words_merge_alike(own, library):
    draw = np.random.default_rng(3)
    for letters in ("a", "ab", "the", "aehtinors", "abcdefghijklmnopqrstuvwxyz"):
        for size in (byte_bpe.LONG, byte_bpe.LONG + 1, 400, 2500):
            word = "".join(draw.choice(list(letters), size))
            same(own, library, [word, f"{word} {word}"])
            (row,) = own.ranks.rows([word.encode()])
            assert row.tolist() == own.ranks.long_row(word.encode()).tolist()


def test_merges_that_make_a_lower_pair(tmp_path):
    """A rank file in which merging ab makes a pair that comes before the next ab."""
    extra = [b"abx", b"xab", b"ab", b"xx", b"abab", b"xabx"]
    lines = [f"{base64.b64encode(t).decode()} {k}" for k, t in enumerate([bytes([b]) for b in range(256)] + extra)]
    path = tmp_path / "ranks"
    path.write_text("\n".join(lines))
    ranks = byte_bpe.Ranks(str(path))
    table = {t: k for k, t in enumerate([bytes([b]) for b in range(256)] + extra)}
    library = tiktoken.Encoding("odd", pat_str=r"\S+", mergeable_ranks=table, special_tokens={})
    draw = np.random.default_rng(1)
    for size in (3, 7, 40, 300):
        for _ in range(60):
            word = "".join(draw.choice(list("abx"), size))
            expected = library.encode_ordinary(word)
            if word.encode() not in table:
                assert ranks.long_row(word.encode()).tolist() == expected == ranks.rows([word.encode()])[0].tolist()


def test_texts_cut_into_parts(own, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "PART", 25)
    texts = ["one two  three\nfour " * 20, "x" * 200, "it's  a 'test' of\tblanks " * 9, None, ""]
    same(own, library, texts + CASES)
    assert len(byte_bpe.segments(texts[0])) > 5 and "".join(byte_bpe.segments(texts[2])) == texts[2]


def test_forgetting_changes_nothing(own, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 100)
    for text in CASES:
        same(own, library, [text, "again wholly unfamiliarr wordz"])


def test_query(spark, library):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    found = queries.op12_byte_bpe(spark, SF_DIR).collect()
    assert len(found) == len(rows)
    for r in found:
        ids = library.encode_ordinary(rows[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((rows[r.doc_id] or "").encode()).hexdigest()


def test_edges(spark, docs, ranks, library):
    rows = [(1, None, "a"), (2, "", "b"), (None, "x", None), (3, "Same", "a"), (3, "Same", "a"), (4, "word " * 300_000, "a")]
    found = sorted((r.doc_id or 0, r.n_tokens) for r in queries.byte_digests(docs(rows), ranks).collect())
    assert found == [(0, 1), (1, 0), (2, 0), (3, 1), (3, 1), (4, len(library.encode_ordinary("word " * 300_000)))]
    assert queries.byte_digests(docs([]), ranks).collect() == []
    ids = spark.createDataFrame([(None,), ([],), ([1, 49407, 60000, -5, None, 2],)], "ids array<int>")
    texts = [bytes(r[0]) for r in ids.select(byte_bpe.decoder(spark, ranks)("ids")).collect()]
    assert texts == [b"", b"", library.decode_bytes([1, 49407, 2])]
    encoded = docs(rows).select(byte_bpe.encoder(spark, ranks)("text").alias("ids")).where("get(ids, 0) = 87").collect()
    assert [r.ids for r in encoded] == [library.encode_ordinary("x")]
