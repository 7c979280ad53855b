"""Byte-level BPE in length-bucketed matrices: every row merges its leftmost pair of lowest rank each round."""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession, functions as F

from tabulant.llm.shared import shipped

#: Classes of characters in the pattern that splits texts.
OTHER, LETTER, DIGIT, SPACE = range(4)
#: What may follow an apostrophe to make a piece of its own.
SINGLE, DOUBLE = "stmd", ("re", "ve", "ll")
NONE = np.iinfo(np.int32).max
EMPTY = -1
#: Characters cut at a time, cells of a matrix, bytes of a piece up to which it is a row of one, bytes of pieces remembered.
PART, CELLS, LONG, REMEMBERED = 1 << 20, 1 << 20, 128, 32 << 20
#: What a remembered piece costs besides its bytes.
OVERHEAD = 120
#: A place where every text may be cut: a blank between two other characters opens a piece.
CUT = re.compile(r"(?<=\S) (?=\S)")


def character_classes() -> np.ndarray:
    """The class of every code point, by the properties that the pattern names.

    Editions of Unicode differ in what is a letter, so the library that defines the encoding is asked, once and on
    the driver: an encoding of single bytes whose pattern is a property keeps the characters that have it.
    """
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    classes = np.zeros(0x110000, np.uint8)
    single = {bytes([b]): b for b in range(256)}
    for kind, pattern in ((LETTER, r"\p{L}"), (DIGIT, r"\p{N}"), (SPACE, r"\s")):
        probe = tiktoken.Encoding(f"class{kind}", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        classes[[ord(c) for c in bytes(probe.encode_ordinary(every)).decode()]] = kind
    return classes


class Ranks:
    """The tables of a rank file: tokens' bytes in order of rank, and a hash table of the pairs that merge.

    The file has a token in base64 and its rank on each line; ranks are ids. A pair merges if its
    bytes together are a token, so every token cut into two tokens gives an entry.
    """

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        if len(missing := [b for b in range(256) if bytes([b]) not in ranks]):
            raise ValueError(f"{path} lacks {len(missing)} of the 256 bytes")
        self.size = max(ranks.values()) + 1
        tokens = [b""] * self.size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int32)
        self.starts = np.cumsum(self.lengths, dtype=np.int64) - self.lengths
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        cuts = [(token[:k], token[k:], rank) for token, rank in ranks.items() for k in range(1, len(token))]
        pairs = [(ranks[a] << 32 | ranks[b], rank) for a, b, rank in cuts if a in ranks and b in ranks]
        self.hashed(np.array([p for p, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int32))
        self.classes = character_classes()

    def tokens(self) -> list[bytes]:
        data = self.data.tobytes()
        return [data[a : a + n] for a, n in zip(self.starts.tolist(), self.lengths.tolist())]

    def hashed(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing at less than half load: every round places what found a free slot."""
        self.bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.keys, self.values = np.full(1 << self.bits, EMPTY, np.int64), np.full(1 << self.bits, NONE, np.int32)
        slot = self.slots(keys)
        while len(keys):
            free = self.keys[slot] == EMPTY
            self.keys[slot[free]] = keys[free]  # of those that meet in a slot, the last stays
            placed = self.keys[slot] == keys
            self.values[slot[placed]] = values[placed]
            keys, values, slot = keys[~placed], values[~placed], (slot[~placed] + 1) & (len(self.keys) - 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs, which are the ids they merge to; ``NONE`` where they don't, and for ids below 0."""
        shape, left, right = left.shape, left.ravel(), right.ravel()
        out = np.full(len(left), NONE, np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        key = left[at].astype(np.int64) << 32 | right[at]
        slot = self.slots(key)
        while len(at):
            found = self.keys[slot]
            hit = found == key
            out[at[hit]] = self.values[slot[hit]]
            going = ~hit & (found != EMPTY)
            at, key, slot = at[going], key[going], (slot[going] + 1) & (len(self.keys) - 1)
        return out.reshape(shape)

    def rows(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words of about one length, as rows of a matrix padded with -1.

        In a round every row merges its leftmost pair of the lowest rank, and so loses one cell:
        what is left closes up to a matrix one column narrower. Rows without a pair leave.
        """
        lengths = np.array([len(w) for w in words])
        width = int(lengths.max())
        symbols = np.full((len(words), width), EMPTY, np.int32)
        symbols[np.arange(width) < lengths[:, None]] = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        ranks = self.merged(symbols[:, :-1], symbols[:, 1:])
        out: list[np.ndarray] = [None] * len(words)
        row = np.arange(len(words))
        while len(row):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(row), np.int64)
            best = ranks[np.arange(len(row)), at] if ranks.shape[1] else np.full(len(row), NONE)
            done = best == NONE
            if done.any():
                for k in np.flatnonzero(done):
                    out[row[k]] = symbols[k][symbols[k] >= 0]
                row, symbols, ranks, at, best = row[~done], symbols[~done], ranks[~done], at[~done], best[~done]
                if not len(row):
                    break
            here = np.arange(len(row))
            symbols[here, at] = best
            keep = np.ones(symbols.shape, bool)
            keep[here, at + 1] = False
            symbols = symbols[keep].reshape(len(row), -1)
            keep = np.ones(ranks.shape, bool)
            keep[here, at] = False
            ranks = ranks[keep].reshape(len(row), -1)
            for side in (at - 1, at):
                inside = (side >= 0) & (side < ranks.shape[1])
                k, s = here[inside], side[inside]
                ranks[k, s] = self.merged(symbols[k, s], symbols[k, s + 1])
        return out

    def long_row(self, word: bytes) -> np.ndarray:
        """Ids of one long word, by the same merges: all pairs of the lowest rank that are due one after another.

        Places of pairs wait by rank. Those of the lowest rank merge from the left, overlapping ones
        skipped, up to the first merge that makes a pair of no higher rank; that pair is next then.
        A round costs what it changes, so a word may have millions of bytes.
        """
        symbols = self.bytes[np.frombuffer(word, np.uint8)]
        size = len(symbols)
        after = np.append(np.arange(1, size), [EMPTY, EMPTY])  # of the last symbol, and of none
        before = np.append(np.arange(-1, size - 1), [size - 1, EMPTY])
        symbols = np.append(symbols, [EMPTY, EMPTY]).astype(np.int32)
        ranks = np.append(self.merged(symbols[: size - 1], symbols[1:size]), [NONE] * 3).astype(np.int32)
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def wait(places: np.ndarray) -> None:
            places = places[ranks[places] != NONE]
            order = places[np.argsort(ranks[places], kind="stable")]
            for group in np.split(order, np.flatnonzero(np.diff(ranks[order])) + 1) if len(order) else ():
                rank = int(ranks[group[0]])
                if rank not in waiting:
                    heapq.heappush(queue, rank)
                waiting.setdefault(rank, []).append(group)

        wait(np.arange(size - 1))
        while queue:
            rank = heapq.heappop(queue)
            places = np.unique(np.concatenate(waiting.pop(rank)))
            places = places[ranks[places] == rank]  # a place that merged, moved or changed is no more of this rank
            if not len(places):
                continue
            joined = np.append(False, after[places[:-1]] == places[1:])
            start = np.maximum.accumulate(np.where(joined, 0, np.arange(len(places))))
            merge = places[(np.arange(len(places)) - start) % 2 == 0]
            # As the merges come: to the left all is merged, to the right nothing yet.
            left, right = before[merge], after[after[merge]]
            beside = np.append(False, after[after[merge[:-1]]] == merge[1:])
            left_symbol = np.where(beside, rank, symbols[left])
            token = np.full(len(merge), rank)
            lower = (self.merged(left_symbol, token) <= rank) | (self.merged(token, symbols[right]) <= rank)
            if lower.any():
                merge = merge[: lower.argmax() + 1]
                left, right = left[: len(merge)], right[: len(merge)]
            gone = after[merge]
            symbols[merge], ranks[gone], ranks[merge] = rank, NONE, NONE
            after[merge] = right
            before[right[right >= 0]] = merge[right >= 0]
            changed = np.unique(np.concatenate((before[merge], merge)))
            changed = changed[changed >= 0]
            follows = after[changed]
            ranks[changed] = np.where(follows >= 0, self.merged(symbols[changed], symbols[follows]), NONE)
            wait(changed)
            if lower.any():
                wait(places)
        # Symbols that merged into the one before them are no longer what follows their predecessor.
        alive = np.append(True, after[before[1:size]] == np.arange(1, size))
        return symbols[:size][alive]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of tokens one after another, and how many each has; ids out of range have none."""
        known = (ids >= 0) & (ids < self.size)
        ids = np.where(known, ids, 0)
        sizes = np.where(known, self.lengths[ids], 0).astype(np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.data[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(total)], sizes


def segments(text: str) -> list[str]:
    """A text in parts of about ``PART`` characters that no piece crosses; without a blank it stays whole."""
    out, start = [], 0
    while len(text) - start > PART:
        found = CUT.search(text, start + PART - 1)
        if not found:
            break
        out.append(text[start : found.start()])
        start = found.start()
    return [*out, text[start:]]


def piece_starts(points: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Whether a piece of the pattern opens at each character of texts that open where ``first`` says.

    What the pattern does, seen from each place: a run of one class is a piece; a single blank
    before it belongs to it, and the last of several white-space characters stands alone unless it is
    such a blank, or the text ends; an apostrophe at the start of a piece, with certain letters, is one.
    """
    kind = classes[points]
    opens = first.copy()
    opens[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    follows = np.append(~first[1:], False)  # the next character is of the same text
    next_other = np.append(~space[1:], False) & follows
    last_space = space & next_other
    opens |= last_space
    blank = np.flatnonzero(last_space & (points == 32))
    opens[blank + 1] = False
    quote = np.flatnonzero((points == 39) & opens & follows)
    if len(quote):
        one = points[quote + 1]
        ends = np.where(np.isin(one, [ord(c) for c in SINGLE]), quote + 2, 0)
        more = quote[follows[quote + 1]]
        for a, b in DOUBLE:
            hit = more[(points[more + 1] == ord(a)) & (points[more + 2] == ord(b))]
            ends[np.searchsorted(quote, hit)] = hit + 3
        hit = ends > 0
        opens[quote[hit] + 1] = False
        opens[np.where(hit, ends - 1, 0)[hit & (ends - quote == 3)]] = False
        after = ends[hit]
        opens[after[after < len(points)]] = True
    return opens


class Encoder:
    """Encodes texts with tables, remembering pieces up to a bound in bytes."""

    def __init__(self, ranks: Ranks) -> None:
        self.ranks = ranks
        self.vocabulary = {t: k for k, t in enumerate(ranks.tokens()) if t}
        self.forget()

    def forget(self) -> None:
        """Only the tokens themselves are known: the id of each is its place."""
        self.known = dict(self.vocabulary)
        self.ids = [np.arange(self.ranks.size, dtype=np.int32)]
        self.sizes = [np.ones(self.ranks.size, np.int32)]
        self.held, self.count, self.starts = 0, self.ranks.size, np.arange(self.ranks.size)

    def learn(self, pieces: set[bytes]) -> None:
        words = sorted(pieces, key=len)
        lengths = np.array([len(w) for w in words])
        found: list[np.ndarray] = []
        start = 0
        while start < len(words):
            if lengths[start] > LONG:
                found.append(self.ranks.long_row(words[start]))
                start += 1
                continue
            # A bucket holds lengths within an eighth of each other, and a bounded number of cells.
            widest = min(LONG, int(lengths[start]) + int(lengths[start]) // 8)
            stop = min(int(np.searchsorted(lengths, widest, "right")), start + max(1, CELLS // widest))
            found += self.ranks.rows(words[start:stop])
            start = stop
        self.ids.append(np.concatenate(found))
        self.sizes.append(np.array([len(f) for f in found], np.int32))
        for word in words:
            self.known[word] = self.count
            self.count += 1
        self.held += int(lengths.sum()) + OVERHEAD * len(words)

    def part(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has."""
        data = b"".join(texts)
        if not data:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        widths = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        at = np.concatenate(([0], np.cumsum(widths)))  # the byte at which each character starts
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        first = np.zeros(len(points), bool)
        opening = bounds[:-1][np.diff(bounds) > 0]
        first[np.searchsorted(at, opening)] = True
        cuts = at[:-1][piece_starts(points, first, self.ranks.classes)]
        edges = [*cuts.tolist(), len(data)]
        pieces = [data[a:b] for a, b in zip(edges, edges[1:])]
        if new := set(pieces).difference(self.known):
            if self.held > REMEMBERED:
                self.forget()
                new = set(pieces).difference(self.known)
            self.learn(new)
        if len(self.ids) > 1:
            self.ids, self.sizes = [np.concatenate(self.ids)], [np.concatenate(self.sizes)]
            self.starts = np.cumsum(self.sizes[0], dtype=np.int64) - self.sizes[0]
        place = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        sizes = self.sizes[0][place].astype(np.int64)
        ends = np.cumsum(sizes)
        ids = self.ids[0][np.repeat(self.starts[place] - ends + sizes, sizes) + np.arange(ends[-1])]
        total = np.concatenate(([0], ends))[np.searchsorted(cuts, bounds)]
        return ids, np.diff(total)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of an Arrow array of texts, and how many each has; null has none."""
        ids, sizes = [], np.zeros(len(texts), np.int64)
        part: list[bytes] = []
        owners: list[int] = []
        held = 0

        def flush() -> None:
            nonlocal held
            if part:
                own, counts = self.part(part)
                ids.append(own)
                np.add.at(sizes, owners, counts)
            part.clear()
            owners.clear()
            held = 0

        for k, text in enumerate(texts):
            for piece in segments(text.as_py()) if text.is_valid else ():
                if held and held + len(piece) > PART:
                    flush()
                part.append(piece.encode())
                owners.append(k)
                held += len(piece)
        flush()
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), sizes


def offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes)))


def id_lists(ids: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets(sizes).astype(np.int32)), pa.array(ids))


def byte_strings(ranks: Ranks, ids: np.ndarray, sizes: np.ndarray) -> pa.BinaryArray:
    """The decoded bytes of lists of ids."""
    parts, lengths = [], np.zeros(len(sizes), np.int64)
    bounds = offsets(sizes)
    k = 0
    while k < len(sizes):  # in parts, as the work array has eight bytes a byte
        stop = max(k + 1, int(np.searchsorted(bounds, bounds[k] + PART, "right")) - 1)
        data, own = ranks.decode(ids[bounds[k] : bounds[stop]])
        parts.append(data)
        lengths[k:stop] = np.diff(offsets(own)[bounds[k : stop + 1] - bounds[k]])
        k = stop
    data = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    at = offsets(lengths).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(data)])


def encoder(spark: SparkSession, ranks: Ranks):
    """A column function from texts to arrays of token ids, as the rank file's own library gives without special tokens.

    Null and empty texts have no ids. A piece that is a token is that token; others start as bytes.
    Texts are cut at blanks into parts of about a million characters and every array is bounded by
    that, but for a run without a blank between other characters, which stays whole at some 50 bytes a character.
    The tables, bounded by the vocabulary, travel with the function; what a task remembers of pieces is bounded in bytes and
    ends with the task. Rows come one by one, so ties, repeated rows and other columns don't matter.
    """
    shipped(spark)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Encoder(ranks)
        for batch in batches:
            yield id_lists(*own.encode(batch))

    return F.arrow_udf(run, "array<int>")


def flat_ids(batch: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of lists one after another, -1 for null ones, and how many each list has; a null list has none."""
    return batch.flatten().fill_null(-1).to_numpy(zero_copy_only=False), batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)


def decoder(spark: SparkSession, ranks: Ranks):
    """A column function from arrays of token ids to bytes; null gives none, ids that aren't in the file give none."""
    shipped(spark)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield byte_strings(ranks, *flat_ids(batch))

    return F.arrow_udf(run, "binary")


def round_trip(spark: SparkSession, ranks: Ranks):
    """A column function from texts to ``struct<ids: array<int>, decoded: binary>``: both ways in one pass through Python."""
    shipped(spark)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Encoder(ranks)
        for batch in batches:
            found = id_lists(*own.encode(batch))
            yield pa.StructArray.from_arrays([found, byte_strings(ranks, *flat_ids(found))], ["ids", "decoded"])

    return F.arrow_udf(run, "struct<ids: array<int>, decoded: binary>")
