"""A compressed FM-index over a sequence of numbers: backward search in a wavelet matrix, many patterns at once."""

from __future__ import annotations

import numpy as np


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes, ordered by their first ``depth`` symbols at least, by prefix doubling."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, step = len(text), 1
    order = np.argsort(rank, kind="stable")
    while step < depth:
        following = np.zeros(n, np.int64)
        following[: max(0, n - step)] = rank[step:] + 1
        key = rank * (n + 1) + following
        order = np.argsort(key, kind="stable")
        changed = np.r_[0, np.cumsum(key[order][1:] != key[order][:-1])]
        rank = np.empty(n, np.int64)
        rank[order] = changed
        step *= 2
        if n and changed[-1] == n - 1:
            break
    return order


class BitRank:
    """A bit vector in 64-bit words, with the count of ones before each word."""

    def __init__(self, bits: np.ndarray):
        octets = np.packbits(bits, bitorder="little")
        padded = np.zeros(8 * (len(bits) // 64 + 1), np.uint8)
        padded[: len(octets)] = octets
        self.words = padded.view(np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)].astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class FMIndex:
    """Counts the occurrences of patterns of up to ``depth`` symbols.

    ``text`` holds numbers from 0; only its Burrows-Wheeler transform is kept, as a wavelet matrix.
    """

    def __init__(self, text: np.ndarray, depth: int):
        self.size = len(text)
        symbols = int(text.max()) + 1 if len(text) else 1
        last = text[sorted_suffixes(text, depth) - 1]
        self.smaller = np.r_[0, np.cumsum(np.bincount(text, minlength=symbols))]
        self.shifts = list(range(max(1, symbols.bit_length()) - 1, -1, -1))
        self.levels, self.zeros = [], []
        for shift in self.shifts:
            bits = (last >> shift) & 1
            self.levels.append(BitRank(bits.astype(np.uint8)))
            self.zeros.append(int(len(bits) - bits.sum()))
            last = np.concatenate([last[bits == 0], last[bits == 1]])
        self.first = self._descend(np.arange(symbols), np.zeros(symbols, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, level, zeros in zip(self.shifts, self.levels, self.zeros):
            ones = level.ones(at)
            at = np.where((symbol >> shift) & 1, zeros + ones, at - ones)
        return at

    def whole(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the empty pattern, ``n`` times."""
        return np.zeros(n, np.int64), np.full(n, self.size, np.int64)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with ``symbol`` put before them."""
        n = len(symbol)
        ends = self._descend(np.r_[symbol, symbol], np.r_[low, high])
        base = self.smaller[symbol] - self.first[symbol]
        return base + ends[:n], base + ends[n:]

    def repeated(self, text: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
        """Whether the ``length`` symbols of ``text`` before each of ``ends`` occur at least twice."""
        alive = np.arange(len(ends))
        low, high = self.whole(len(ends))
        for back in range(1, length + 1):
            low, high = self.extend(text[ends[alive] - back], low, high)
            on = high - low >= 2
            alive, low, high = alive[on], low[on], high[on]
            if not len(alive):
                break
        found = np.zeros(len(ends), bool)
        found[alive] = True
        return found
