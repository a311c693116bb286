"""A compressed FM-index over integer symbols: packed wavelet matrix, backward search for many patterns at once."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector in 64-bit words with counts before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1])).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class FMIndex:
    """Index of ``text`` (integers from 0, dense) for patterns of exactly ``depth`` symbols (at most 64).

    The text must end with 0, which separates streams and is part of no pattern.

    Suffixes are sorted by their first 64 symbols, which is enough for patterns of up to 64. Besides the wavelet
    matrix of the Burrows-Wheeler transform it keeps, per row, the bounds of the rows that share depth - 1
    symbols: dropping a pattern's last symbol is then one lookup, as matching statistics need.
    """

    def __init__(self, text: np.ndarray, depth: int):
        if not 33 <= depth <= 64:
            raise ValueError("depth must be from 33 to 64")
        n = len(text)
        rank, half = text.astype(np.int64), None
        for step in (1, 2, 4, 8, 16, 32):
            if step == 32:
                half = rank
            later = np.zeros(n, np.int64)
            later[: max(0, n - step)] = rank[step:] + 1
            key = rank * (int(rank.max(initial=0)) + 2) + later
            if step < 32:
                rank = np.unique(key, return_inverse=True)[1]
        self.order = np.argsort(key, kind="stable")
        gap = depth - 1 - 32
        after = np.zeros(n, np.int64)
        after[: max(0, n - gap)] = half[gap:] + 1
        a, b = half[self.order], after[self.order]
        starts = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        sizes = np.diff(np.append(starts, n))
        self.low, self.high = np.repeat(starts, sizes).astype(np.int32), np.repeat(starts + sizes, sizes).astype(np.int32)
        bwt = text[self.order - 1]  # row of position 0 wraps to the last symbol
        symbols = int(text.max(initial=0)) + 1
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols)))).astype(np.int64)
        self.levels: list[tuple[int, Bits, int]] = []
        for bit in range(max(1, (symbols - 1).bit_length()) - 1, -1, -1):
            ones = (bwt >> bit) & 1
            self.levels.append((bit, Bits(ones.astype(np.uint8)), int(n - ones.sum())))
            bwt = np.concatenate((bwt[ones == 0], bwt[ones == 1]))
        self.base = self._down(np.arange(symbols), np.zeros(symbols, np.int64))
        self.size = n

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, bits, zeros in self.levels:
            ones = bits.rank(at).astype(np.int64)
            at = np.where((symbol >> bit) & 1, zeros + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of (symbol + pattern) from those of each pattern: one step of backward search."""
        n = len(low)
        both = self._down(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
        at = self.first[symbol] - self.base[symbol]
        return at + both[:n], at + both[n:]

    def shorten(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that share the first depth - 1 symbols with row ``low``."""
        return self.low[low].astype(np.int64), self.high[low].astype(np.int64)


def streamed_matches(index: FMIndex, text: np.ndarray, starts: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Row intervals of every window of ``depth`` symbols of the streams, last window first found.

    Stream j has ``counts[j]`` windows that start at text[starts[j]] and after. Streams advance together: each
    begins with ``depth`` backward steps, then moves left by dropping the last symbol and prepending one.
    Returns low and high, with one entry a window in the order of the streams.
    """
    offsets = np.concatenate(([0], np.cumsum(counts)))
    low_all, high_all = np.zeros(offsets[-1], np.int64), np.zeros(offsets[-1], np.int64)
    lanes = np.argsort(-counts, kind="stable")
    last = starts[lanes] + counts[lanes] - 1
    low, high = np.zeros(len(lanes), np.int64), np.full(len(lanes), index.size, np.int64)
    for j in range(depth - 1, -1, -1):
        low, high = index.extend(text[last + j], low, high)
    step = 0
    while len(lanes):
        where = offsets[lanes] + counts[lanes] - 1 - step
        low_all[where], high_all[where] = low, high
        step += 1
        n = int(np.searchsorted(-counts[lanes], -step, side="left"))  # lanes are in descending order of counts
        lanes, last, low = lanes[:n], last[:n], low[:n]
        if not n:
            break
        low, high = index.shorten(low)
        low, high = index.extend(text[last - step], low, high)
    return low_all, high_all
