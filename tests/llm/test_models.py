"""Language and quality: decoding against all labellings, accuracy on documents held out, edges."""

import itertools
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
from conftest import SF_DIR
from pyspark.sql import functions as F

from tabulant.llm import language, quality, queries


def test_viterbi_equals_the_best_of_all_labellings():
    draw = np.random.default_rng(1)
    per_doc = np.array([4, 0, 1, 6, 3])
    scores = draw.normal(size=(per_doc.sum(), 3)).astype(np.float32) * 2
    found, at = language.viterbi(scores, per_doc, 1.5), 0
    for n in per_doc:
        part, got = scores[at : at + n], found[at : at + n]
        value = lambda ls: sum(part[t, a] for t, a in enumerate(ls)) - 1.5 * sum(a != b for a, b in zip(ls, ls[1:]))
        best = max(map(value, itertools.product(range(3), repeat=int(n))))
        assert abs(value(got) - best) < 1e-4
        at += n


def test_marginals_equal_sums_over_all_labellings():
    draw = np.random.default_rng(2)
    per_doc = np.array([3, 1, 5])
    emission, move = draw.normal(size=9), draw.normal(size=(2, 2))
    chance, pairs = quality.marginals(emission, move, per_doc, expected=True)
    at, expected_pairs = 0, np.zeros((2, 2))
    for n in per_doc:
        total, ones, local = 0.0, np.zeros(n), np.zeros((2, 2))
        for ls in itertools.product((0, 1), repeat=int(n)):
            weight = np.exp(emission[at : at + n] @ np.array(ls) + sum(move[a, b] for a, b in zip(ls, ls[1:])))
            total += weight
            ones += weight * np.array(ls)
            for a, b in zip(ls, ls[1:]):
                local[a, b] += weight
        assert np.allclose(chance[at : at + n], ones / total)
        expected_pairs += local / total
        at += n
    assert np.allclose(pairs, expected_pairs)


def test_languages_of_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    found = queries.op5_language_id(spark, SF_DIR).collect()
    assert len(found) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in found)
    out = [r for r in found if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in out]) >= 0.97


def test_labeller_holds_bounded_bytes(spark):
    counts = np.random.default_rng(3).integers(0, 9, (2, language.TRIPLES + language.N_SCRIPTS))
    run = language.labeller(language.Model(["de", "en"], counts)).func
    batch = pa.array(["the cat and the dog are here with this " * 40] * 256)
    tracemalloc.start()
    try:
        found = sum(len(out) for out in run(batch for _ in range(50)))
        assert found == 50 * 256 and tracemalloc.get_traced_memory()[1] < 180 << 20
    finally:
        tracemalloc.stop()


def test_spans_of_mixed_text_and_edges(spark, docs):
    train = docs([(i, text, "s") for i, text in enumerate(["the cat and the dog are here with this", "der hund und die katze sind nicht hier"] * 20)])
    train = train.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de"))
    greek = docs([(99, "η γάτα και ο σκύλος είναι εδώ", "s")]).withColumn("lang", F.lit("el"))
    model = language.fit(train.unionByName(greek), F.lit(True))
    assert model.langs == ["de", "el", "en"]
    half = "the dog and the cat with this and the cat "
    rows = [(1, half + "και η γάτα και ο σκύλος " + "der hund und die katze sind nicht hier und die katze", "s"), (2, None, "s"), (3, "", "s"), (4, "12 !?", None),
            (5, "τhe", "s"), (None, "the cat", "s"), (6, "the " * 30_000, "s"), (6, "the " * 30_000, "s")]
    found = language.identify(docs(rows), model).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == len(rows) and [s.lang for s in by[1].spans] == ["en", "el", "de"]
    assert rows[0][1][by[1].spans[0].start : by[1].spans[0].stop] == half.strip()
    assert all((by[i].lang, by[i].score, by[i].spans) == ("und", 0.0, []) for i in (2, 3, 4))
    assert by[None].lang == "en" and by[6].lang == "en" and by[6].score == 1.0
    df = docs(rows)
    kept = language.accepted(df, model)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 5, 6, 6]
    assert language.identify(docs([]), model).collect() == [] and language.fit(docs([]), F.lit(True)) is None
    assert {r.lang for r in language.identify(df, None).collect()} == {"und"}


def test_quality_of_held_out_documents(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    found = queries.op8_line_quality(spark, SF_DIR).collect()
    assert len(found) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    out = [r for r in found if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) >= 0.9


def test_quality_learns_from_one_text_of_an_id(spark, docs):
    good, bad = "This is a fine sentence about things.\nAnd this one goes on.", "BUY!! NOW!! $$$ ### $$$\nBUY!! NOW!!"
    rows = [(i, good if i % 2 else bad, "s") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    one = quality.fit(docs(rows), labels, F.lit(True))
    many = quality.fit(docs(rows + [(3, f"{good}\nmore {k}", "s") for k in range(60)]), labels, F.lit(True))
    assert np.array_equal(one.weights, many.weights) and np.array_equal(one.transition, many.transition)


def test_quality_edges(spark, docs):
    good = "This is a fine sentence about things.\nAnd this one goes on a little."
    bad = "BUY!! NOW!! $$$ ### $$$\nBUY!! NOW!! BUY!! NOW!!"
    df = docs([(i, good if i % 2 else bad, "s") for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(df, labels, F.lit(True))
    rows = [(1, good, "s"), (2, bad, None), (3, None, "s"), (4, "", "s"), (None, good, "s"), (5, good * 3000, "s"), (6, "\n" * 3000, "s"), (1, good, "s")]
    found = quality.score(docs(rows), model).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == len(rows) and by[1].predicted == 1 and by[2].predicted == 0 and by[3].score == by[4].score
    assert by[None].score == by[1].score and by[5].predicted == 1 and all(0 <= r.score <= 1 for r in found)
    assert quality.score(docs([]), model).collect() == []
    assert quality.fit(df, labels.where("quality = 1"), F.lit(True)) is None
    assert {r.score for r in quality.score(df, None).collect()} == {0.5}


def test_texts_without_letters_have_no_language(spark, docs):
    """Marks, private use and the tags of a flag are no letters; marks inside a word leave it whole."""
    bare = ["❤️ 12", "\u0301", "\ue000\ue001", "\U0001f3f4\U000e0067\U000e0062\U000e007f", "\U00040000", "", None, " 1 ! "]
    words = ["cafe\u0301 the", "葛\U000e0100城", "\U00030001"]
    model = language.Model(["de", "en"], np.ones((2, language.TRIPLES + language.N_SCRIPTS)))
    rows = docs([(k, text, "a") for k, text in enumerate(bare + words)])
    found = {r.doc_id: r for r in language.identify(rows, model).collect()}
    assert [(found[k].lang, found[k].score, found[k].spans) for k in range(len(bare))] == [("und", 0.0, [])] * len(bare)
    assert all(found[len(bare) + k].lang != "und" for k in range(len(words)))
    assert language.Words(words).sizes.tolist() == [5, 3, 3, 1]


def test_label_values_other_than_two_are_none(spark, docs):
    rows = docs([(k, f"line {k}\nother", "a") for k in range(8)])
    labels = spark.createDataFrame([(k, v) for k, v in enumerate([0, 2, 0, 2, 7, None, 0, 2])], "doc_id long, quality int")
    assert quality.fit(rows, labels, F.lit(True)) is None
    labels = spark.createDataFrame([(k, v) for k, v in enumerate([0, 2, 1, 2, 7, None, 0, 1])], "doc_id long, quality int")
    assert quality.fit(rows, labels, F.lit(True)) is not None
