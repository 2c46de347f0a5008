"""FM-index over a set of short texts, searched for many patterns at once.

The index holds the Burrows-Wheeler transform of all texts in a wavelet matrix of packed
bit vectors with word counts.  Backward search runs for whole arrays of patterns in numpy,
one symbol of every pattern per step.
"""

from __future__ import annotations

import numpy as np


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class FMIndex:
    """Index of ``texts``; suffixes are ordered by their first ``depth`` symbols, which patterns must not exceed."""

    def __init__(self, texts: list[str], depth: int):
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        raw = code_points("\0".join(texts) + "\0")
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64)
        # symbol 0 ends every text; all others are numbered from 1 in code point order
        ends = self.starts + lengths
        self.alphabet, dense = np.unique(raw, return_inverse=True)
        body = dense.astype(np.int64) + 1
        body[ends] = 0
        self.symbols = body
        self.sigma = int(body.max()) + 1
        self.suffixes = _sort_suffixes(body, self.sigma, depth)
        bwt = body[self.suffixes - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(body, minlength=self.sigma))]).astype(np.int64)
        self._build(bwt)

    def _build(self, bwt: np.ndarray) -> None:
        self.bits = max(1, int(self.sigma - 1).bit_length())
        self.words: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.zeros: list[int] = []
        level = bwt.astype(np.uint32)
        for b in range(self.bits - 1, -1, -1):
            bit = ((level >> b) & 1).astype(np.uint8)
            pad = np.zeros((-len(bit)) % 64 + 64, dtype=np.uint8)
            words = np.packbits(np.concatenate([bit, pad]), bitorder="little").view(np.uint64)
            ones = np.bitwise_count(words).astype(np.int64)
            self.words.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(ones)[:-1]]))
            self.zeros.append(int(len(bit) - ones.sum()))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        first = np.arange(self.sigma, dtype=np.int64)
        self.origin = self._descend(np.zeros(self.sigma, dtype=np.int64), first)

    def _descend(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Position in the bottom level that each prefix [0, at) maps to on its symbol's way down."""
        for lv in range(self.bits):
            word = at >> 6
            part = self.words[lv][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = self.counts[lv][word] + np.bitwise_count(part)
            high = (symbol >> (self.bits - 1 - lv)) & 1
            at = np.where(high == 1, self.zeros[lv] + ones, at - ones)
        return at

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of all texts joined, start of each); -1 where the index has no such character."""
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        raw = code_points("".join(texts))
        at = np.minimum(np.searchsorted(self.alphabet, raw), len(self.alphabet) - 1)
        symbols = np.where(self.alphabet[at] == raw, at.astype(np.int64) + 1, -1)
        return symbols, np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)

    def extend(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with ``symbol`` put in front; an unknown symbol (-1) empties them."""
        n = len(lo)
        known = np.maximum(symbol, 0)
        at = self._descend(np.concatenate([lo, hi]), np.concatenate([known, known]))
        base = self.before[known] - self.origin[known]
        lo, hi = base + at[:n], base + at[n:]
        return lo, np.where(symbol < 0, lo, hi)

    def search(self, patterns: np.ndarray, begin: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of ``patterns[b : b + length]`` for every b in ``begin``."""
        lo = np.zeros(len(begin), dtype=np.int64)
        hi = np.full(len(begin), len(self.symbols), dtype=np.int64)
        for i in range(length - 1, -1, -1):
            lo, hi = self.extend(lo, hi, patterns[begin + i])
        return lo, hi

    def owner(self, position: np.ndarray) -> np.ndarray:
        """Number of the text that holds each position."""
        return np.searchsorted(self.starts, position, side="right") - 1


def _sort_suffixes(body: np.ndarray, sigma: int, depth: int) -> np.ndarray:
    """The suffixes in order of their first ``depth`` symbols, by prefix doubling.

    Where key and place fit into one word (fewer than 2**21 symbols) the words are sorted themselves, which
    is many times faster than sorting places by keys.
    """
    n = len(body)
    bits = n.bit_length()
    packed = 3 * bits <= 63
    width = 8 if sigma <= 256 else 16 if sigma <= 65536 else 32
    have = max(1, ((63 - bits) if packed else 64) // width)
    padded = np.concatenate([body, np.zeros(have, dtype=np.int64)]).astype(np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    for i in range(have):
        key = (key << np.uint64(width)) | padded[i : i + n]
    order, rank = _ordered(key, bits, packed)
    while have < depth and rank.max() < n - 1:
        second = np.zeros(n, dtype=np.uint64)
        second[: max(0, n - have)] = rank[have:] + np.uint64(1)
        key = (rank << np.uint64(bits)) | second if packed else rank * np.uint64(n + 1) + second
        order, rank = _ordered(key, bits, packed)
        have *= 2
    return order


def _ordered(key: np.ndarray, bits: int, packed: bool) -> tuple[np.ndarray, np.ndarray]:
    """(places in order of their key, rank of each place); equal keys share a rank."""
    if packed:
        words = np.sort((key << np.uint64(bits)) | np.arange(len(key), dtype=np.uint64))
        order, ordered = (words & np.uint64((1 << bits) - 1)).astype(np.int64), words >> np.uint64(bits)
    else:
        order = np.argsort(key)
        ordered = key[order]
    rank = np.empty(len(key), dtype=np.uint64)
    rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])]).astype(np.uint64)
    return order, rank
