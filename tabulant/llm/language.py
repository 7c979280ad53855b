"""Language of documents by spans: scripts narrow the candidates, Viterbi labels the words."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabulant.llm.shared import parts_of, python_ready, released

#: Documents of each language that the model learns from, chosen by a hash of their id.
SAMPLE_DOCS = 2000
#: Entries of the table of letter triples.
TRIPLES = 1 << 15
#: Log-likelihood that a change of language between two words costs, and the most a word can count.
SWITCH, CLIP = 12.0, 10.0
#: Share of a language's letters that makes a script one of its own.
SCRIPT_SHARE = 0.01
#: Bytes that the words of texts may take until they are labelled, and what a word costs besides 9 for each language.
HELD, WORD_BYTES = 96 << 20, 64
#: Share of a document's letters that its main language must have for the document to be accepted.
MIN_SCORE = 0.5

#: Code-point ranges of scripts (first, last, number); letters elsewhere are script 1.
SCRIPTS = (
    (0x0041, 0x024F, 2), (0x1E00, 0x1EFF, 2), (0xFF21, 0xFF5A, 2),  # Latin
    (0x0370, 0x03FF, 3), (0x1F00, 0x1FFF, 3),  # Greek
    (0x0400, 0x052F, 4),  # Cyrillic
    (0x0530, 0x058F, 5),  # Armenian
    (0x0590, 0x05FF, 6),  # Hebrew
    (0x0600, 0x06FF, 7), (0x0750, 0x077F, 7), (0xFB50, 0xFDFF, 7), (0xFE70, 0xFEFF, 7),  # Arabic
    (0x0900, 0x097F, 8),  # Devanagari
    (0x0980, 0x09FF, 9),  # Bengali
    (0x0B80, 0x0BFF, 10),  # Tamil
    (0x0E00, 0x0E7F, 11),  # Thai
    (0x10A0, 0x10FF, 12),  # Georgian
    (0x1100, 0x11FF, 13), (0xAC00, 0xD7AF, 13),  # Hangul
    (0x3040, 0x30FF, 14),  # Kana
    (0x3400, 0x9FFF, 15), (0x20000, 0x323AF, 15),  # Han
)
N_SCRIPTS = 16
#: No character from here on is a letter; of marks, the selectors of variants are.
_KNOWN = 0x323B0
_SELECTORS = range(0xE0100, 0xE01F0)

SPANS = "array<struct<start: int, stop: int, lang: string>>"
LABELS = "lang string, score double, spans array<struct<start: int, stop: int, lang: string>>, known string"


@cache
def letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point the script, 0 if it is no letter or mark, the lower-case form, and whether it is a mark."""
    script, lower, mark = np.zeros(_KNOWN + 1, np.uint8), np.arange(_KNOWN + 1, dtype=np.uint32), np.zeros(_KNOWN + 1, bool)
    for code in range(_KNOWN):
        char = chr(code)
        if (kind := unicodedata.category(char)[0]) in "LM":
            script[code], mark[code] = 1, kind == "M"
            small = char.lower()
            lower[code] = ord(small) if len(small) == 1 else code
    for first, last, number in SCRIPTS:
        part = script[first : last + 1]
        part[part > 0] = number
    return script, lower, mark


class Words:
    """The words of some texts, flat: letters with the marks that follow them, each in a letter triple."""

    def __init__(self, texts: list[str | None]) -> None:
        script_of, lower_of, mark_of = letters()
        raw = [np.frombuffer((t or "").encode("utf-32-le", "replace"), np.uint32) for t in texts]
        gap = np.zeros(1, np.uint32)
        flat = np.concatenate([gap, *[piece for r in raw for piece in (r, gap)], gap])
        doc_start = 1 + np.cumsum([0, *[len(r) + 1 for r in raw]])
        clipped = np.minimum(flat, _KNOWN)
        script = script_of[clipped]
        marks = mark_of[clipped]
        if (high := (flat >= _SELECTORS.start) & (flat < _SELECTORS.stop)).any():
            marks, script = marks | high, np.where(high, 1, script)
        if marks.any():
            # A mark is of the word whose letter it follows, over other marks; without a letter it is of none.
            base = np.maximum.accumulate(np.where(marks, 0, np.arange(len(flat))))
            script = np.where(marks & (script[base] == 0), 0, script)
        clean = np.where(script > 0, lower_of[clipped], 0).astype(np.uint32)
        at = np.flatnonzero(script)
        mix = clean[at - 1] * np.uint32(0x9E3779B1) ^ clean[at] * np.uint32(0x85EBCA77) ^ clean[at + 1] * np.uint32(0xC2B2AE3D)
        mix ^= mix >> np.uint32(15)
        mix *= np.uint32(0x2C1B3C6D)
        self.triples = (mix >> np.uint32(17)).astype(np.int64)
        self.scripts = script[at]
        self.first = np.flatnonzero(script[at - 1] == 0) if len(at) else np.zeros(0, np.int64)
        self.sizes = np.diff(np.append(self.first, len(at)))
        place = at[self.first]
        self.docs = np.searchsorted(doc_start, place, "right") - 1
        self.starts = place - doc_start[self.docs]
        self.per_doc = np.bincount(self.docs, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)


def count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: how often each language has each letter triple and script."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        for lang in set(langs):
            total = counts.setdefault(lang, np.zeros(TRIPLES + N_SCRIPTS, np.int64))
            for part in parts_of([t for t, own in zip(texts, langs) if own == lang]):
                words = Words(part)
                total[:TRIPLES] += np.bincount(words.triples, minlength=TRIPLES)
                total[TRIPLES:] += np.bincount(words.scripts, minlength=N_SCRIPTS)
    for lang, total in counts.items():
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some), pa.array(total[some])], ["lang", "feature", "n"])


class Model:
    """Log-likelihoods of letter triples by language, and which languages a script allows."""

    def __init__(self, langs: list[str], counts: np.ndarray) -> None:
        self.langs = langs
        triples, scripts = counts[:, :TRIPLES] + 0.5, counts[:, TRIPLES:]
        self.likelihood = np.log(triples / triples.sum(axis=1, keepdims=True)).T.astype(np.float32).copy()
        share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        allowed = (share >= SCRIPT_SHARE).T
        self.known = allowed.any(axis=1)
        allowed[~self.known] = True
        self.allowed = allowed

    def word_scores(self, words: Words) -> np.ndarray:
        """For each word and language its log-likelihood below the best one's, by at most ``CLIP``."""
        if not len(words.first):
            return np.zeros((0, len(self.langs)), np.float32)
        total = np.add.reduceat(self.likelihood[words.triples], words.first)
        total[~self.allowed[words.scripts[words.first]]] = -np.inf
        return np.maximum(total - total.max(axis=1, keepdims=True), np.float32(-CLIP))


def viterbi(scores: np.ndarray, per_doc: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of every word: the sum of scores less ``switch`` for each change is greatest.

    ``scores`` holds the documents' words one after another; all documents step forward together,
    the longest last, and then back along what they kept.
    """
    starts = np.concatenate(([0], np.cumsum(per_doc)[:-1])).astype(np.int64)
    longest_first = np.argsort(-per_doc, kind="stable")
    starts, lengths = starts[longest_first], per_doc[longest_first]
    steps = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(steps), "left")  # documents longer than each step
    stay, top = np.zeros(scores.shape, bool), np.zeros(len(scores), np.int32)
    value = np.zeros((len(lengths), scores.shape[1]), np.float32)
    final = value
    for t in range(steps):
        n = active[t]
        value = value[:n]
        here = starts[:n] + t
        best = value.argmax(axis=1)
        floor = value[np.arange(n), best] - np.float32(switch if t else 0)
        kept = value >= floor[:, None]
        stay[here], top[here] = kept, best
        value = np.where(kept, value, floor[:, None]) + scores[here]
        value -= value.max(axis=1, keepdims=True)
        final[:n] = value
    labels = np.zeros(len(scores), np.int32)
    state = final.argmax(axis=1).astype(np.int32)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        here = starts[:n] + t
        labels[here] = state[:n]
        if t:
            keep = stay[here, state[:n]]
            state[:n] = np.where(keep, state[:n], top[here])
    return labels


def labeller(model: Model):
    """An Arrow UDF from texts to language, score, spans and the language known.

    The last is the one with most letters among words in scripts that a learned language uses, null without any.
    It reads several batches ahead, so that many documents share the steps of one Viterbi run.
    """

    def scored(texts: list[str | None]) -> tuple[np.ndarray, ...]:
        # Letters, by far the most of it, are needed for the scores alone and go with the words.
        words = Words(texts)
        known = model.known[words.scripts[words.first]]
        return words.per_doc, words.sizes.astype(np.int32), words.starts.astype(np.int32), known, model.word_scores(words)

    def flush(parts: list[tuple[np.ndarray, ...]]) -> pa.StructArray:
        per_doc, sizes, begin, known, scores = (np.concatenate(column) for column in zip(*parts))
        parts.clear()
        labels = viterbi(scores, per_doc)
        del scores
        docs, langs = len(per_doc), len(model.langs)
        owner = np.repeat(np.arange(docs), per_doc)
        place = owner * langs + labels
        held, sure = (np.bincount(place, n, docs * langs).reshape(docs, langs) for n in (sizes, sizes * known))
        whole = held.sum(axis=1)
        names = np.array([*model.langs, "und"], object)
        lang = names[np.where(whole > 0, held.argmax(axis=1), langs)]
        score = np.where(whole > 0, held.max(axis=1) / np.maximum(whole, 1), 0.0)
        main = np.array([*model.langs, None], object)[np.where(sure.any(axis=1), sure.argmax(axis=1), langs)]
        change = np.ones(len(labels), bool)
        change[1:] = (labels[1:] != labels[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(change)
        last = np.append(first[1:], len(labels))[: len(first)] - 1
        spans = pa.StructArray.from_arrays(
            [pa.array(begin[first], pa.int32()), pa.array(begin[last] + sizes[last], pa.int32()), pa.array(names[labels[first]], pa.string())],
            ["start", "stop", "lang"],
        )
        offsets = pa.array(np.searchsorted(owner[first], np.arange(docs + 1)), pa.int32())
        return pa.StructArray.from_arrays(
            [pa.array(lang, pa.string()), pa.array(score), pa.ListArray.from_arrays(offsets, spans), pa.array(main, pa.string())],
            ["lang", "score", "spans", "known"],
        )

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        parts, rows, held = [], [], 0

        def cut() -> Iterator[pa.Array]:
            whole, at = flush(parts), 0
            for n in rows:
                yield whole.slice(at, n)
                at += n

        for batch in batches:
            if not len(batch):
                parts.append(scored([]))
            for texts in parts_of(batch.to_pylist()):
                parts.append(scored(texts))
                held += len(parts[-1][1]) * (WORD_BYTES + 9 * len(model.langs))
            rows.append(len(batch))
            if held > HELD:
                yield from cut()
                parts, rows, held = [], [], 0
        if parts:
            yield from cut()
        del parts
        released()

    # A filter on the labels, pushed below a use of them, would have every text labelled again.
    return F.arrow_udf(run, LABELS).asNondeterministic()


def fit(docs: DataFrame, train: Column, *, sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """Learn from about ``sample_docs`` documents of each language among those where ``train`` holds.

    Which ones is decided by a hash of the id, at a rate that follows from the languages' counts; a
    language with fewer gives all. Texts are learned from whole. The model's size depends on the number
    of languages alone. None if there is nothing to learn from.
    """
    python_ready(docs.sparkSession)
    known = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    )
    # One number a language, so that texts stay where they are.
    found = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    rate = F.lit(0.0)
    for lang, n in found.items():
        rate = F.when(F.col("lang") == lang, F.lit(sample_docs / n)).otherwise(rate)
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = known.where(chance < rate).select("lang", "text")
    counts = sample.mapInArrow(count_rows, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    table = counts.toArrow()
    langs = sorted(set(table.column("lang").to_pylist()))
    if not langs:
        return None
    found = np.zeros((len(langs), TRIPLES + N_SCRIPTS), np.int64)
    row = np.searchsorted(np.array(langs, object), table.column("lang").to_numpy())
    found[row, table.column("feature").to_numpy()] = table.column("n").to_numpy()
    return Model(langs, found)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per document: ``doc_id, lang, score, spans``, from its text alone.

    Words are runs of letters, with marks after them. A word's script leaves the languages that use it (all, if
    none does); its letter triples, edges included, score these; the labels of all words together
    maximise the scores less a penalty for each change. ``spans`` are runs of words with one label,
    as character positions; ``lang`` has most letters, and ``score`` is its share of them.

    A text that is null or has no letter (Unicode category L; a mark is none) is ``und`` with score 0 and no spans, and so is every text
    if nothing was learned. Equal shares go to the language that sorts first. Rows repeated are
    repeated in the result; null ids stay null; other columns are not read.
    """
    judged = docs.select(docs["doc_id"], labels(docs, model).alias("judged"))
    return judged.select("doc_id", "judged.lang", "judged.score", "judged.spans")


def labels(docs: DataFrame, model: Model | None) -> Column:
    """Language, score and spans of each row's text, and the language known (see ``labeller``), as one struct."""
    python_ready(docs.sparkSession)
    if model is None:
        none = F.lit(None).cast("string").alias("known")
        return F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"), F.from_json(F.lit("[]"), SPANS).alias("spans"), none)
    return labeller(model)(docs["text"].cast("string"))


def held_out(doc_id: Column) -> Column:
    """Documents that no model may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def accepted(docs: DataFrame, model: Model | None, *, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` that have words of a learned language, ``min_score`` of their letters in one, with their ``lang``.

    A word in a script that no learned language uses is of none, whatever its label; a text of such words alone goes,
    unless its ``lang`` names a language that was not learned, which the model cannot judge. A ``lang`` that is given
    stays; a null one becomes the language that most letters of the other words are labelled with.

    The filter runs where the rows lie, without a shuffle, and other columns stay as they are, whatever
    their names. Null ids are no matter; rows repeated stay or go together.
    """
    rows = docs.select(F.struct("*").alias("row"), labels(docs, model).alias("judged"))
    given = F.col("row.lang")
    judged = (F.col("judged.lang") != "und") & (F.col("judged.score") >= min_score)
    known = F.col("judged.known").isNotNull() | ~given.cast("string").isin(model.langs if model else [])
    lang = F.coalesce(given, F.col("judged.known").cast(docs.select("lang").schema[0].dataType))
    return rows.where(judged & known).select(F.col("row").withField("lang", lang).alias("row")).select("row.*")
