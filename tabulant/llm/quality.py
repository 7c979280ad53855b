"""Quality of documents: a linear-chain conditional random field labels each line good or bad."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabulant.llm.language import letters
from tabulant.llm.shared import parts_of, python_ready

#: Labelled documents, about, that the model learns from, chosen by a hash of their id.
SAMPLE_DOCS = 3000
#: Steps of the fit, its step size and its pull to zero.
STEPS, RATE, DECAY = 150, 0.1, 1e-3
#: Lines that step through the chain together.
LINES = 20_000
#: Score from which a document is called good.
THRESHOLD = 0.7

#: What a line is described by; the same of the line before and the line after follow.
FEATURES = (
    "length", "letters", "upper", "digits", "marks", "bars", "bangs", "symbols", "repeats", "distinct",
    "word_length", "long_words", "ends_sentence", "starts_upper", "blank",
)

_SYMBOLS = np.zeros(128, bool)
_SYMBOLS[[ord(c) for c in "#$%&*+<=>@\\^_`{}~"]] = True
_SPACE = np.zeros(0x3001, bool)
_SPACE[[9, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line, its length in characters, and how many lines each text has."""
    script_of, lower_of, _ = letters()
    raw = [np.frombuffer((t + "\n").encode("utf-32-le", "replace"), np.uint32) for t in texts]
    flat = np.concatenate(raw)
    ends = np.flatnonzero(flat == 10)
    per_doc = np.diff(np.searchsorted(ends, np.concatenate(([0], np.cumsum([len(r) for r in raw])))))
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = ends - starts

    def summed(values: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
        return total[ends] - total[starts]

    clipped = np.minimum(flat, len(script_of) - 1)
    letter = script_of[clipped] > 0
    upper = letter & (lower_of[clipped] != clipped)
    ascii_ = np.minimum(flat, 127)
    space = _SPACE[np.minimum(flat, 0x3000)] & (flat <= 0x3000)
    break_ = space | (flat == 10)
    digit = (flat >= 48) & (flat <= 57)
    other = ~letter & ~digit & ~break_
    n_letters, n_chars = np.maximum(summed(letter), 1), np.maximum(size, 1)

    # Words: runs between breaks, each known by a hash, so that repeats can be told.
    begins = np.flatnonzero(~break_ & np.concatenate(([True], break_[:-1])))
    word_end = np.flatnonzero(~break_ & np.concatenate((break_[1:], [True]))) + 1
    line_of = np.searchsorted(ends, begins)
    mixed = (flat.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    offset = np.zeros(len(flat), np.int64)
    if len(begins):
        offset[begins[0] :] = np.arange(begins[0], len(flat)) - np.repeat(begins, np.diff(np.append(begins, len(flat))))
    mixed ^= (mixed >> np.uint64(29)) * (offset.astype(np.uint64) * np.uint64(2) + np.uint64(1))
    mixed[break_] = 0
    word = np.add.reduceat(mixed, begins) if len(begins) else np.zeros(0, np.uint64)
    length = (word_end - begins).astype(float)
    words = np.bincount(line_of, minlength=len(ends)).astype(float)
    same = np.zeros(len(word))
    same[1:] = (word[1:] == word[:-1]) & (line_of[1:] == line_of[:-1])
    order = np.lexsort((word, line_of))
    fresh = np.ones(len(word))
    fresh[1:] = (word[order][1:] != word[order][:-1]) | (line_of[order][1:] != line_of[order][:-1])
    per_word = lambda x, lines=line_of: np.bincount(lines, x, minlength=len(ends)) / np.maximum(words, 1)
    last = flat[np.maximum(ends - 1, 0)]
    head = flat[np.minimum(starts, len(flat) - 1)]
    columns = (
        np.log1p(size) / 5,
        summed(letter) / n_chars,
        summed(upper) / n_letters,
        summed(digit) / n_chars,
        summed(other) / np.maximum(words, 1),
        summed(ascii_ == ord("|")) / np.maximum(words, 1),
        summed(ascii_ == ord("!")) / np.maximum(words, 1),
        summed(_SYMBOLS[ascii_] & (flat < 128)) / np.maximum(words, 1),
        per_word(same),
        per_word(fresh, line_of[order]),
        per_word(length) / 10,
        per_word(length > 20),
        (size > 0) & np.isin(last, [ord(c) for c in ".!?…。"]),
        (size > 0) & upper[np.minimum(starts, len(flat) - 1)] & (head != 10),
        words == 0,
    )
    own = np.minimum(np.array(columns, np.float32).T, 3)
    # Neighbouring lines, zero beyond a document's ends.
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    edges = np.cumsum(per_doc)
    before[edges[:-1]] = 0
    before[:1] = 0
    after[edges - 1] = 0
    one = np.ones((len(own), 1), np.float32)
    return np.hstack([own, before, after, one]), size, per_doc


def marginals(emission: np.ndarray, transition: np.ndarray, per_doc: np.ndarray, *, expected: bool = False):
    """Forward-backward of a chain with two labels over many documents at once.

    ``emission`` scores label 1 against label 0 of every line, ``transition`` the four pairs of
    neighbouring labels. Gives the chance of label 1 for each line and, if ``expected``, how often
    each pair of labels is expected in all.
    """
    starts = np.concatenate(([0], np.cumsum(per_doc)[:-1])).astype(np.int64)
    order = np.argsort(-per_doc, kind="stable")
    starts, lengths = starts[order], per_doc[order]
    steps = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(steps), "left")
    score = np.stack([np.zeros_like(emission), emission], axis=1).astype(np.float64)
    peak = score.max(axis=1, keepdims=True)
    weight, move = np.exp(score - peak), np.exp(transition - transition.max())
    ahead, back = np.empty_like(weight), np.ones_like(weight)
    for t in range(steps):
        here = starts[: active[t]] + t
        value = weight[here] * (ahead[here - 1] @ move if t else 1.0)
        ahead[here] = value / value.sum(axis=1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        here = starts[: active[t + 1]] + t
        value = (weight[here + 1] * back[here + 1]) @ move.T
        back[here] = value / value.sum(axis=1, keepdims=True)
    both = ahead * back
    chance = both[:, 1] / both.sum(axis=1)
    if not expected:
        return chance
    inner = np.ones(len(emission), bool)
    inner[np.cumsum(per_doc) - 1] = False
    at = np.flatnonzero(inner)
    pair = ahead[at][:, :, None] * move[None] * (weight[at + 1] * back[at + 1])[:, None, :]
    return chance, (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def weighted(chance: np.ndarray, size: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
    """Each document's mean over its lines, weighted by length; blank lines count a little."""
    owner = np.repeat(np.arange(len(per_doc)), per_doc)
    weight = size + 0.01
    return np.bincount(owner, chance * weight, len(per_doc)) / np.bincount(owner, weight, len(per_doc))


class Field:
    """Weights of features and label pairs, and the curve from a document's mean to its score."""

    def __init__(self, weights: np.ndarray, transition: np.ndarray, slope: float, offset: float) -> None:
        self.weights, self.transition, self.slope, self.offset = weights, transition, slope, offset

    def line_chances(self, features: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
        return marginals(features @ self.weights, self.transition, per_doc)

    def scores(self, features: np.ndarray, size: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
        mean = weighted(self.line_chances(features, per_doc), size, per_doc)
        return 1 / (1 + np.exp(-(self.slope * log_odds(mean) + self.offset)))


def log_odds(chance: np.ndarray) -> np.ndarray:
    chance = np.clip(chance, 1e-4, 1 - 1e-4)
    return np.log(chance / (1 - chance))


def described(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``line_features`` of many texts, worked out for some at a time."""
    found = [line_features(part) for part in parts_of(texts)]
    return tuple(np.concatenate(x) for x in zip(*found))


def fitted(features: np.ndarray, size: np.ndarray, per_doc: np.ndarray, good: np.ndarray) -> Field:
    """Fit by gradient ascent on the likelihood of line labels, each line having its document's.

    Lines weigh alike; both labels weigh alike in sum, so that a rare one counts. The pairs' weights
    are learned with the rest. A logistic curve then maps means to the shares observed.
    """
    label = np.repeat(good, per_doc).astype(float)
    share = np.bincount(good.astype(int), minlength=2) / max(len(good), 1)
    doc_weight = np.where(good > 0, 0.5 / max(share[1], 1e-9), 0.5 / max(share[0], 1e-9))
    line_weight = np.repeat(doc_weight / np.maximum(per_doc, 1), per_doc)
    line_weight /= line_weight.sum()
    same = np.zeros((2, 2))
    for value in (0, 1):
        same[value, value] = np.maximum(per_doc[good == value] - 1, 0).sum()
    pairs = max(same.sum(), 1.0)
    weights, transition = np.zeros(features.shape[1]), np.zeros((2, 2))
    params = np.concatenate((weights, transition.ravel()))
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, STEPS + 1):
        weights, transition = params[:-4], params[-4:].reshape(2, 2)
        chance, found = marginals(features @ weights, transition, per_doc, expected=True)
        slope = np.concatenate((features.T @ ((label - chance) * line_weight), 0.1 * ((same - found) / pairs).ravel())) - DECAY * params
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        params = params + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    field = Field(params[:-4], params[-4:].reshape(2, 2), 1.0, 0.0)
    mean = log_odds(weighted(field.line_chances(features, per_doc), size, per_doc))
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Newton's method for two numbers, held back a little
        chance = 1 / (1 + np.exp(-(slope * mean + offset)))
        gap, curve = good - chance, np.maximum(chance * (1 - chance), 1e-6)
        hessian = np.array([[(curve * mean**2).sum() + 1, (curve * mean).sum()], [(curve * mean).sum(), curve.sum() + 0.1]])
        change = np.linalg.solve(hessian, [(gap * mean).sum() - (slope - 1), gap.sum() - 0.1 * offset])
        slope, offset = slope + change[0], offset + change[1]
        if np.abs(change).max() < 1e-9:
            break
    field.slope, field.offset = max(float(slope), 1e-3), float(offset)
    return field


def fit(docs: DataFrame, labels: DataFrame, train: Column, *, sample_docs: int = SAMPLE_DOCS) -> Field | None:
    """Learn from about ``sample_docs`` labelled documents among those where ``train`` holds.

    ``labels`` has ``doc_id`` and ``quality``; other values than 0 and 1 are no labels. The sample is chosen by a hash of the id at a rate that
    follows from the number of labels, evenly from both, and fitted in one task, whose size
    the parameter bounds: of rows that share an id the smallest text counts. None if both labels don't occur.
    """
    python_ready(docs.sparkSession)
    # One label to an id; where several disagree the document is bad.
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where(train)
    counts = {r.quality: r.n for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if set(counts) != {0, 1}:
        return None
    rate = F.lit(sample_docs / 2) / F.when(F.col("quality") == 1, counts[1]).otherwise(counts[0])
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = known.where(chance < rate)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
    # The sample's ids are as many as the parameter says, so they can go to every task; each gives one text.
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").cast("int").alias("quality"))
    # The order decides how sums round, so it is fixed.
    sample = sample.orderBy("doc_id").select("text", "quality")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [(described(b.column("text").to_pylist()), b.column("quality").to_numpy()) for b in batches if b.num_rows]
        if {0, 1} == {int(q) for _, good in known for q in good}:
            lines = [np.concatenate(x) for x in zip(*[d for d, _ in known])]
            field = fitted(*lines, np.concatenate([good for _, good in known]))
            flat = np.concatenate((field.weights, field.transition.ravel(), [field.slope, field.offset]))
            yield pa.RecordBatch.from_arrays([pa.array([flat.tolist()])], ["weights"])

    found = sample.coalesce(1).mapInArrow(learn, "weights array<double>").collect()
    if not found:
        return None
    flat = np.array(found[0].weights)
    return Field(flat[:-6], flat[-6:-2].reshape(2, 2), flat[-2], flat[-1])


def score(docs: DataFrame, model: Field | None, *, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id, score, predicted``, from its text alone.

    Lines end at line feeds. Each is described by shares of letters, capitals, marks, repeated
    words and the like, its own and its neighbours'; forward-backward over the chain gives the chance that
    it is good, and the mean of these, weighted by length, is mapped to a score from 0 to 1.
    ``predicted`` is 1 from ``threshold`` on.

    A null text counts as empty, which is one blank line. Without a model every score is 0.5. Null
    ids and repeated rows are scored as they come; other columns are not read.
    """
    python_ready(docs.sparkSession)
    if model is None:
        found = docs.select(docs["doc_id"], F.lit(0.5).alias("score"))
    else:
        found = docs.select(docs["doc_id"], scorer(model)(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("score"))
    return found.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def scorer(model: Field):
    """An Arrow UDF from texts to scores; it reads some batches ahead, so that texts share steps."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held, lines = [], 0

        def flush() -> Iterator[pa.Array]:
            found, at = model.scores(*[np.concatenate(x) for x in zip(*held)]), 0
            for _, _, per_doc in held:
                yield pa.array(found[at : at + len(per_doc)])
                at += len(per_doc)

        for batch in batches:
            if not len(batch):
                yield pa.array([], pa.float64())
                continue
            held.append(described(batch.to_pylist()))
            lines += len(held[-1][1])
            if lines > LINES:
                yield from flush()
                held, lines = [], 0
        if held:
            yield from flush()

    return F.arrow_udf(run, "double")
