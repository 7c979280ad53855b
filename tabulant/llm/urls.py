"""Allow or block URLs by glob rules, all of them matched at once by a bit-parallel automaton."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabulant.llm.shared import python_ready

#: Characters of URLs that one step of the automaton takes at a time, over all URLs of a group.
GROUP = 4096


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains, and for paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        """A pattern over ``.host`` + path: one star for anything within the host, two for anything."""
        quote = lambda s: "".join(f"\\{c}" if c in "*?\\" else c for c in s)
        return f"*.{quote(self.host)}{quote(self.path)}**"


#: The rules the query is asked for.
RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)


class Automaton:
    """Shift-And masks of several globs, packed one after another into 64-bit words.

    Each plain character, or ``?``, has a bit. A star before it lets the bit before (or, at a pattern's
    start, the entry) stay alive over any characters: but for ``/`` with one star, any with two.
    """

    def __init__(self, globs: list[str]) -> None:
        accept, bits = [], 0
        parsed = [self.parse(g.encode()) for g in globs]
        total = sum(len(p) + 1 for p in parsed)
        words = max(1, -(-total // 64))
        self.step = np.zeros((256, words), np.uint64)
        self.stay = np.zeros((256, words), np.uint64)
        self.begin = np.zeros(words, np.uint64)
        self.accept = []

        def put(mask: np.ndarray, bit: int) -> None:
            mask[bit // 64] |= np.uint64(1 << bit % 64)

        for pattern in parsed:
            put(self.begin, bits)  # the entry bit: nothing read yet
            for char, loop in pattern:
                for c in range(256):
                    if loop == 2 or loop == 1 and c != ord("/"):
                        put(self.stay[c], bits)
                bits += 1
                for c in range(256) if char is None else [char] if char >= 0 else []:
                    put(self.step[c], bits)
            # After the last character a trailing star keeps the accepting bit alive.
            tail = pattern[-1] if pattern else (-1, 0)
            if tail[0] == -1:
                bits -= 1
            self.accept.append(bits)
            bits += 1

    @staticmethod
    def parse(glob: bytes) -> list[tuple[int | None, int]]:
        """(character, loop before it): None stands for any character, -1 for the end of the pattern."""
        out, loop, at = [], 0, 0
        while at < len(glob):
            c = glob[at]
            if c == ord("*"):
                double = glob[at : at + 2] == b"**"
                loop, at = max(loop, 2 if double else 1), at + 1 + double
                continue
            if c == ord("\\") and at + 1 < len(glob):
                at += 1
                out.append((glob[at], loop))
            else:
                out.append((None if c == ord("?") else c, loop))
            loop, at = 0, at + 1
        return [*out, (-1, loop)]

    def match(self, texts: list[bytes]) -> np.ndarray:
        """Which patterns fit each whole text, as a table of booleans."""
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        data = np.frombuffer(b"".join(texts), np.uint8)
        starts = (np.cumsum(lengths) - lengths)[order]
        active = np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0))), "left")
        state = np.tile(self.begin, (len(texts), 1))
        one, top = np.uint64(1), np.uint64(63)
        for t, n in enumerate(active):
            char = data[starts[:n] + t]
            now = state[:n]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:n] = moved & self.step[char] | now & self.stay[char]
        out = np.zeros((len(texts), len(self.accept)), bool)
        for k, bit in enumerate(self.accept):
            out[order, k] = state[:, bit // 64] >> np.uint64(bit % 64) & one > 0
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host with A-Z lowered and the path of a URL; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^(?s)([^/?#]*)", 1), letters, letters.lower())
    return host, F.regexp_extract(rest, r"^(?s)[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, *, default: str = "allow") -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``.

    Of the rules that fit, the one with the longest name (host and path) wins; of equally long ones
    the first given. URLs that no rule fits, null ones and those without ``://`` get ``default`` and a
    null rule. Very long URLs take as many steps as they have bytes; rows repeated are repeated.
    Further columns are not read.
    """
    python_ready(pages.sparkSession)
    ranked = sorted(rules, key=lambda r: -len(r.name))
    automaton = Automaton([r.glob for r in ranked])
    names = [*[r.name for r in ranked], None]

    def fitting(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = [t.encode() for t in batch.to_pylist()]
            found = []
            for at in range(0, len(texts), GROUP):
                fits = automaton.match(texts[at : at + GROUP])
                first = np.where(fits.any(axis=1), fits.argmax(axis=1), len(ranked)) if ranked else np.zeros(len(fits), int)
                found += [int(k) for k in first]
            yield pa.array([None if k == len(ranked) else k for k in found], pa.int32())

    which = F.arrow_udf(fitting, "int")
    host, path = host_and_path(pages["url"].cast("string"))
    parts = pages.select(pages["page_id"], host.alias("host"), path.alias("path"))
    known = parts.select("*", which(F.concat(F.lit("."), "host", "path")).alias("which"))
    named = F.get(F.array(*[F.lit(n) for n in names]).cast("array<string>"), F.col("which"))
    said = F.get(F.array(*[F.lit(r.verdict) for r in ranked], F.lit(default)), F.coalesce("which", F.lit(len(ranked))))
    return known.select("page_id", "host", "path", named.alias("rule"), said.alias("verdict"))
