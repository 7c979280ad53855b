"""Byte-pair encoding and decoding in batches: merge rounds over the symbols of many words at once."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession, functions as F

from tabulant.llm.shared import parts_of, python_ready, released

#: What the tokenizer's patterns call white space, and its pattern for words (lower ASCII letters first, which are quick to scan).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = "'s|'t|'re|'ve|'m|'ll|'d|[a-z]+[{letters}]*|[{letters}]+|[{digits}]|[^{space}{letters}{digits}]+"
#: Characters at which ``str.split`` cuts though they are no white space to the tokenizer.
ODD_BREAKS = regex.compile("[\x1c-\x1f]")
SPACES = regex.compile(f"[{SPACE}]+")
WORD_END = "</w>"
#: Bytes that the chunks which a task remembers may take, and what each costs besides its characters and ids.
REMEMBERED, OVERHEAD = 64 << 20, 200
NONE = np.iinfo(np.int32).max


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it prints, else one from 256 on, in order."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


def word_pattern() -> str:
    """The pattern for words, its properties spelled out as ranges.

    Editions of Unicode differ in what is a letter, so the library that defines the encoding is asked, once and on the driver.
    """
    from tokenizers import Regex, normalizers

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))

    def ranges(name: str) -> str:
        rest = normalizers.Replace(Regex(rf"\p{{{name}}}"), "").normalize_str(every)
        codes = np.setdiff1d(np.frombuffer(every.encode("utf-32-le"), np.uint32), np.frombuffer(rest.encode("utf-32-le"), np.uint32))
        runs = np.split(codes, np.flatnonzero(np.diff(codes) > 1) + 1)
        return "".join(f"\\U{run[0]:08x}-\\U{run[-1]:08x}" for run in runs)

    return WORD.format(letters=ranges("L"), digits=ranges("N"), space=SPACE)


def later_letters() -> dict[int, str]:
    """Letters that the defining library lowers and Python's edition of Unicode doesn't."""
    from tokenizers import normalizers

    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c) != "\n"]
    lowered = normalizers.Lowercase().normalize_str("\n".join(every)).split("\n")
    return {ord(c): small for c, small in zip(every, lowered) if small != c and c.lower() == c}


class Tokenizer:
    """The tables of a word-end BPE: symbols of bytes, merges by sorted pair keys, token strings."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            raw = file.read()
        spec = json.loads(raw)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.name = hashlib.sha256(raw.encode()).hexdigest()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = np.full(self.size, None, object)
        for table in (vocab, self.special):
            for token, at in table.items():
                self.tokens[at] = token
        self.word, self.lower = word_pattern(), later_letters()
        chars = byte_characters()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.final = np.array([vocab[c + WORD_END] for c in chars], np.int64)
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64)
        keys = pairs[:, 0] * self.size + pairs[:, 1]
        order = np.argsort(keys)
        self.keys, self.ranks, self.results = keys[order], order.astype(np.int32), pairs[:, 2]
        # Pairs of bytes are looked up in a table: those inside a word, and those whose second byte ends it.
        self.of_bytes = np.concatenate([self.pair_ranks(np.repeat(self.inner, 256), np.tile(second, 256)) for second in (self.inner, self.final)])

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols, ``NONE`` where they don't merge."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has.

        In each round every word merges, from the left, all pairs of its lowest rank; words whose
        pairs have no rank are done and leave. Later merges never outrank those that make their
        parts, so this equals merging one pair at a time. Ranks are looked up for pairs beside a merge alone.
        """
        lengths = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        last = np.zeros(len(data), bool)
        last[np.cumsum(lengths) - 1] = True
        symbols = np.where(last, self.final[data], self.inner[data])
        word = np.repeat(np.arange(len(words)), lengths)
        rank = np.full(len(data), NONE, np.int32)  # of each symbol and the next in its word
        inside = np.flatnonzero(~last)
        rank[inside] = self.of_bytes[data[inside].astype(np.int64) * 256 + data[inside + 1] + 65536 * last[inside + 1]]
        done_words, done_symbols = [], []
        while len(symbols):
            starts = np.flatnonzero(np.concatenate(([True], last[:-1])))
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(word))))
            over = best == NONE
            if over.any():
                done_words.append(word[over])
                done_symbols.append(symbols[over])
            merge = np.flatnonzero((rank == best) & ~over)
            if not len(merge):
                break
            # In a run like aaa pairs overlap: every second one counts, from the left.
            fresh = np.concatenate(([True], np.diff(merge) != 1))
            run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(merge)), 0))
            merge = merge[(np.arange(len(merge)) - run_start) % 2 == 0]
            symbols[merge] = self.results[rank[merge]]
            last[merge] = last[merge + 1]
            keep = ~over
            keep[merge + 1] = False
            at = np.cumsum(keep)[merge] - 1
            symbols, word, last, rank = symbols[keep], word[keep], last[keep], rank[keep]
            rank[at[last[at]]] = NONE
            before = at[at > 0] - 1
            beside = np.concatenate((at[~last[at]], before[~last[before]]))
            rank[beside] = self.pair_ranks(symbols[beside], symbols[beside + 1])
        if not done_words:
            return np.zeros(0, np.int64), lengths
        owner, ids = np.concatenate(done_words), np.concatenate(done_symbols)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(words))


class Memory:
    """Ids of chunks of text between white space that a task has met, in one growing array of bounded size."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.tokenizer = tokenizer
        self.words = re.compile("\n|" + tokenizer.word).findall  # of many chunks, a line each
        self.odd = frozenset(map(chr, tokenizer.lower))
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(tokenizer.special, key=len, reverse=True))) + ")")
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.ids, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def chunks(self, text: str | None) -> list[str]:
        """The text in chunks no token crosses; special tokens are chunks of their own."""
        if not text:
            return []
        if "<" in text and self.tokenizer.special:
            out = []
            for k, part in enumerate(self.specials.split(text)):
                out += [f"\n{part}"] if k % 2 else self.plain(part)
            return out
        return self.plain(text)

    @staticmethod
    def plain(text: str) -> list[str]:
        # Letters are lowered one by one, so that a final sigma is none.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if ODD_BREAKS.search(text):
            return [c for c in SPACES.split(text) if c]
        return text.split()

    def learn(self, chunks: list[str]) -> None:
        special = [self.tokenizer.special[c[1:]] for c in chunks if c[0] == "\n"]
        if special:  # a word of its own, of one id
            chunks = [*(c for c in chunks if c[0] != "\n"), *(c for c in chunks if c[0] == "\n")]
        plain = len(chunks) - len(special)
        text = "\n".join(chunks[:plain])  # no chunk has a line end in it
        if not self.odd.isdisjoint(text):
            text = text.translate(self.tokenizer.lower)
        found = self.words(text)
        words = [w for w in dict.fromkeys(found) if w != "\n"]
        number = dict(zip(words, range(len(words))), **{"\n": -1})
        place = np.fromiter(map(number.__getitem__, found), np.int64, len(found))
        ids, sizes = self.tokenizer.encode_words([w.encode() for w in words])
        inside = place >= 0
        owner, place = np.cumsum(~inside)[inside], place[inside]
        own, ends = sizes[place], np.cumsum(sizes)
        stops = np.cumsum(own)
        found = ids[np.repeat(ends[place] - stops, own) + np.arange(stops[-1] if len(stops) else 0)]
        found = np.concatenate((found, special)).astype(np.int32)
        lengths = np.bincount(owner, own, plain).astype(np.int64)
        lengths = np.concatenate((lengths, np.ones(len(special), np.int64)))
        self.start = np.concatenate((self.start, len(self.ids) + np.cumsum(lengths) - lengths))
        self.size = np.concatenate((self.size, lengths))
        self.ids = np.concatenate((self.ids, found))
        self.known.update(zip(chunks, range(len(self.known), len(self.known) + len(chunks))))
        self.held += sum(map(len, chunks)) + OVERHEAD * len(chunks) + 4 * int(lengths.sum())

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        cut = [self.chunks(t) for t in texts]
        if self.held > REMEMBERED:
            self.forget()
        per_text = np.cumsum([0, *map(len, cut)])
        number = defaultdict(count().__next__)  # of each chunk among these texts' own, so that the large table is asked once
        own = np.fromiter(map(number.__getitem__, chain.from_iterable(cut)), np.int64, per_text[-1])
        if new := [c for c in number if c not in self.known]:
            self.learn(new)
        place = np.fromiter(map(self.known.__getitem__, number), np.int64, len(number))[own]
        size = self.size[place]
        ends = np.cumsum(size)
        flat = self.ids[np.repeat(self.start[place] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        offsets = np.concatenate(([0], ends))[per_text].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encoded(memory: Memory, texts: list[str | None]) -> pa.ListArray:
    """The ids of texts, worked out some at a time."""
    return pa.concat_arrays([memory.encode(part) for part in parts_of(texts)] or [pa.array([], pa.list_(pa.int32()))])


def encoder(spark: SparkSession, tokenizer: Tokenizer):
    """A column function from texts to arrays of token ids.

    It gives what the tokenizer's own library gives without added tokens: texts in normal form C
    and lower case are cut into words, words into bytes, and bytes merged; names of special tokens
    in a text become their ids. Null and empty texts have no ids; one text is worked on whole, whatever its length. The
    tables travel with the function; workers only need this library, not the file. What a task remembers is bounded in bytes and ends with it.
    """
    python_ready(spark)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memory = Memory(tokenizer)
        for batch in batches:
            yield encoded(memory, batch.to_pylist())
        del memory
        released()

    return F.arrow_udf(run, "array<int>")


def decoded(tokenizer: Tokenizer, ids: pa.ListArray) -> pa.StringArray:
    """The texts of lists of ids: the tokens' strings, joined by spaces."""

    def text(own: np.ndarray) -> str:
        tokens = tokenizer.tokens[own[(own >= 0) & (own < tokenizer.size)]].tolist()
        return " ".join([t for t in tokens if t is not None] if None in tokens else tokens)

    offsets, flat = ids.offsets.to_numpy(), ids.values.fill_null(-1).to_numpy(zero_copy_only=False)
    valid = ids.is_valid().to_numpy(zero_copy_only=False)
    return pa.array([text(flat[offsets[k] : offsets[k + 1]]) if valid[k] else "" for k in range(len(ids))], pa.string())


def decoder(spark: SparkSession, tokenizer: Tokenizer):
    """A column function from arrays of token ids to text: the tokens' strings, joined by spaces.

    Special tokens are kept, ids that the vocabulary lacks are left out, and null gives an empty text.
    """
    python_ready(spark)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield decoded(tokenizer, batch)

    return F.arrow_udf(run, "string")


def round_trip(spark: SparkSession, tokenizer: Tokenizer):
    """A column function from texts to ``struct<ids: array<int>, decoded: string>``: ``encoder`` and ``decoder`` in one pass through Python.

    One function means one worker a task, and ids that don't travel back to be decoded.
    """
    python_ready(spark)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memory = Memory(tokenizer)
        for batch in batches:
            ids = encoded(memory, batch.to_pylist())
            yield pa.StructArray.from_arrays([ids, decoded(tokenizer, ids)], ["ids", "decoded"])
        del memory
        released()

    return F.arrow_udf(run, "struct<ids: array<int>, decoded: string>")


def ids_text(ids: Column) -> Column:
    """Token ids in decimal, joined by single spaces."""
    return F.array_join(ids.cast("array<string>"), " ")
