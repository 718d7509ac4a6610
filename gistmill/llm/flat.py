"""Vectorised word and line kernels over the raw UTF-8 of many texts.

A block of texts is one byte array plus offsets. Words are maximal runs of word bytes (every class used here cuts only
at ASCII bytes, so bytes and code points agree). Every span gets a 64-bit hash from prefix sums of ``T[byte] * P**i``
modulo 2**64, so the hash of any substring, or of a line without one of its words, costs two subtractions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits (splitmix64)."""
    x = np.array(x, dtype=U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U) + U(seed << 20)) * U(0x9E3779B97F4A7C15))


TABLE = stream(1, 256)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


class _Powers:
    """Powers of an odd number modulo 2**64, grown on demand and kept for the worker."""

    def __init__(self, base: int):
        self.base, self.values = base, np.ones(1, dtype=U)

    def upto(self, n: int) -> np.ndarray:
        while len(self.values) < n:
            top = pow(self.base, len(self.values), 1 << 64)
            self.values = np.concatenate([self.values, self.values * U(top)])
        return self.values[:n]


POWERS, INVERSES = _Powers(BASE), _Powers(INVERSE)

SPACES = np.ones(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string array without nulls."""
    off = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=len(texts) + 1, offset=4 * texts.offset).astype(np.int64)
    data = texts.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return buf, off - off[0]


def runs(member: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal member runs that do not cross a text's end."""
    n = len(member)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = member[:-1]
    before[off[:-1][off[:-1] < n]] = False
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = member[1:]
    ends = off[1:]
    after[ends[ends > 0] - 1] = False
    return np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1


class Words:
    """Words of a block: byte ``start`` and ``end``, ``hash``, ``doc`` (row) and ``first`` (word offsets by row)."""

    def __init__(self, texts: pa.Array, member: np.ndarray, lower: bool = True):
        self.buf, self.off = raw(texts)
        if lower:
            self.buf = LOWER[self.buf]
        self.start, self.end = runs(member[self.buf], self.off)
        self.first = np.searchsorted(self.start, self.off)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self.sums = prefix_sums(self.buf)
        self.hash = mix(span_hash(self.sums, self.start, self.end))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each position and whether they lie in one text; shorter than the words by k - 1."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=U), np.zeros(0, dtype=bool)
        return gram_hash(self.hash, k), self.doc[:n] == self.doc[k - 1 :]


FACTORS = stream(2, 64) | U(1)


def gram_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hash of every run of k words (k at most 64)."""
    n = len(words) - k + 1
    total = np.zeros(max(n, 0), dtype=U)
    for j in range(k):
        total += words[j : j + n] * FACTORS[j]
    return mix(total + U(k))


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    out = np.zeros(len(buf) + 1, dtype=U)
    np.cumsum(TABLE[buf] * POWERS.upto(len(buf)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of byte spans, the same for equal bytes wherever they stand; not yet mixed."""
    return (sums[end] - sums[start]) * INVERSES.upto(len(sums))[start]
