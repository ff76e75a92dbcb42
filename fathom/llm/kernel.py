"""Vectorised text primitives shared by the operators of this subpackage.

Texts of an Arrow batch are joined into blocks of bounded size and turned into arrays of
code points; words, shingles and their 64-bit hashes come out of whole-array numpy steps,
so that no Python code runs per character or per word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache
from typing import NamedTuple

import numpy as np

ALNUM, SPACE, ALPHA, UPPER, KANA = 1, 2, 4, 8, 16
#: Characters of text that are processed at once; a longer single text makes a block of its own.
BLOCK_CHARS = 1 << 19
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93


@cache
def classes() -> np.ndarray:
    """Flags of every code point. Letters and digits exist in planes 0 to 3 only."""
    table = np.zeros(0x110000, np.uint8)
    for i in range(0x40000):
        c = chr(i)
        if c.isalnum():
            table[i] = ALNUM | (ALPHA if c.isalpha() else 0) | (UPPER if c.isupper() else 0)
        elif c.isspace():
            table[i] = SPACE
    table[0x3041:0x3097] |= KANA
    return table


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def span_hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end) of an array of code points, the same wherever a span stands."""
    n = len(cp)
    up, down = _powers(max(20, int(n).bit_length()))
    v = cp.astype(np.uint64)
    v += np.uint64(1)
    v *= _GOLD
    v ^= v >> np.uint64(29)
    v *= up[:n]
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(v, out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    h += (ends - starts).astype(np.uint64)
    return mix(h)


class Words(NamedTuple):
    """Words of a block of texts. ``doc`` counts texts from the block's first; offsets are code points of ``text``."""

    text: str
    cp: np.ndarray
    bounds: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def blocks(texts: Sequence[str | None], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts that together stay under the limit, or hold one longer text."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) + 1 if t else 1
        if size and size + n > limit:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def join(texts: Sequence[str | None]) -> tuple[str, np.ndarray]:
    """One text, each part ended by a NUL, and the offsets where the parts begin; a NUL inside a part becomes a blank."""
    parts = [("" if t is None else t.replace("\x00", " ") if "\x00" in t else t) for t in texts]
    bounds = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=bounds[1:])
    return "\x00".join(parts) + "\x00", bounds


def words(texts: Sequence[str | None], lower: bool = True) -> Words:
    """Longest runs of letters and digits (Unicode) of each text, in lower case."""
    parts = [("" if t is None else t.lower() if lower else t) for t in texts]
    text, bounds = join(parts)
    cp = codepoints(text)
    flags = np.zeros(len(cp) + 2, np.int8)
    flags[1:-1] = classes()[cp] & ALNUM
    edges = np.flatnonzero(np.diff(flags))
    start, end = edges[::2], edges[1::2]
    counts = np.diff(np.searchsorted(start, bounds))
    return Words(text, cp, bounds, np.repeat(np.arange(len(parts)), counts), start, end, span_hashes(cp, start, end))


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each run of ``size`` consecutive words of a text, and the index of the run's first word."""
    n = len(w.hash) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = w.hash[:n].copy()
    for k in range(1, size):
        h *= np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(32)
        h += w.hash[k : n + k]
    whole = np.flatnonzero(w.doc[:n] == w.doc[size - 1 :])
    return mix(h[whole]), whole


class HashSet:
    """Membership of 64-bit hashes: a bitmap answers for nearly all that are not in the set, a sorted array for the rest."""

    def __init__(self, members: np.ndarray) -> None:
        self.members = np.unique(members.astype(np.uint64))
        bits = min(26, max(12, int(len(self.members)).bit_length() + 4))
        self.shift = np.uint64(64 - bits)
        self.bitmap = np.zeros(1 << bits, bool)
        self.bitmap[self.members >> self.shift] = True

    def positions(self, hashes: np.ndarray) -> np.ndarray:
        """Indexes of the hashes that are in the set."""
        if not len(self.members):
            return np.empty(0, np.int64)
        maybe = np.flatnonzero(self.bitmap[hashes >> self.shift])
        h = hashes[maybe]
        at = np.searchsorted(self.members, h)
        at[at == len(self.members)] = 0
        return maybe[self.members[at] == h]


def signed(h: np.ndarray) -> np.ndarray:
    """The hashes as Spark's signed long."""
    return h.view(np.int64)
