"""BPE against the tokenizer's own library."""

import hashlib

import public_tokenizers
import pytest
from conftest import SF_DIR
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer as Library

from tabulant.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def own():
    return bpe.Memory(bpe.Tokenizer(PATH))


@pytest.fixture(scope="module")
def library():
    return Library.from_file(PATH)


CASES = [
    "", "Hello, World's they'll 123 I'D", "aaaaaaaaaaaaa aaaa", "ΑΣ ΣΑΣ ὈΔΥΣΣΕΎΣ", "İstanbul ſ ﬁ Å Å", "a\x1cb\x1dc d​e　f\x00\x85g h i",
    "<|endoftext|>x<|startoftext|><|endoftext|> <|endof <|ENDOFTEXT|>", "日本語 テスト 한국어 ไทย हिन्दी", "x" * 3000, "😀👩‍👩‍👧 🇩🇪", "\n\t ", "½ ² ٣ Ⅷ",
]


def same(own, library, texts):
    got = own.encode(texts).to_pylist()
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert got == expected


def test_cases(own, library):
    same(own, library, CASES)
    same(own, library, CASES[::-1] + CASES)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("abtheir nsSΣ'’<|>éß́\x1c\x85 1", max_size=60)), max_size=5))
def test_random_texts(own, library, texts):
    same(own, library, texts)


def test_every_character(own, library):
    characters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(characters), 50_000):
        same(own, library, [f"the{c}the {c}1{c}!{c}{c}'s{c}" for c in characters[k : k + 50_000 : 5]])


def test_forgetting_changes_nothing(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    for text in CASES:
        same(own, library, [text, "again"])


def test_ranks_are_looked_up_beside_merges_alone(own, monkeypatch):
    asked = []
    lookup = own.tokenizer.pair_ranks
    monkeypatch.setattr(own.tokenizer, "pair_ranks", lambda left, right: asked.append(len(left)) or lookup(left, right))
    words = [b"internationalization", b"the", b"aaaaaaaaaaaaa", b"xqzvjk"] * 50
    ids, sizes = own.tokenizer.encode_words(words)
    merges = sum(map(len, words)) - len(ids)
    assert sizes.sum() == len(ids) and 0 < sum(asked) <= 2 * merges


def test_query(spark, library):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    found = queries.op3_bpe(spark, SF_DIR).collect()
    assert len(found) == len(rows)
    for r in found:
        ids = library.encode(rows[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_edges(spark, docs, library):
    rows = [(1, None, "a"), (2, "", "b"), (None, "x", None), (3, "Same", "a"), (3, "Same", "a")]
    tokenizer = bpe.Tokenizer(PATH)
    found = sorted((r.doc_id or 0, r.n_tokens) for r in queries.token_digests(docs(rows), tokenizer).collect())
    assert found == [(0, 1), (1, 0), (2, 0), (3, 1), (3, 1)]
    assert queries.token_digests(docs([]), tokenizer).collect() == []
    ids = spark.createDataFrame([(None,), ([],), ([1, 49407, 60000, -5, None, 2],)], "ids array<int>")
    texts = [r[0] for r in ids.select(bpe.decoder(spark, tokenizer)("ids")).collect()]
    assert texts[:2] == ["", ""] and texts[2] == library.decode([1, 49407, 2], skip_special_tokens=False)
