"""A compressed full-text index over sequences of words: suffix array, Burrows-Wheeler transform and wavelet matrix.

Only numpy, for use within tasks. Symbols are stored bit by bit in planes with counts for every 64 places.
"""

from __future__ import annotations

import numpy as np


def suffix_ranks(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array, and ranks of suffixes by their first ``depth`` symbols, by prefix doubling.

    Every sequence must end in a symbol of its own, so that suffixes differ.
    """
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    rank = rank.astype(np.int64)
    width, steps = 1, []
    while True:
        if 2 * width > depth and not steps:
            # The first ``depth`` symbols are two overlapping stretches of ``width``.
            far = np.minimum(np.arange(n) + depth - width, n)
            steps.append(np.unique(rank * (n + 1) + np.append(rank, -1)[far] + 1, return_inverse=True)[1])
        second = np.full(n, -1, np.int64)
        second[:n - width] = rank[width:] if width < n else rank[:0]
        key = rank * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]]))
        width *= 2
        if rank[order[-1]] == n - 1:
            return order, steps[0] if steps else rank


class WaveletMatrix:
    """Bit planes of ``symbols`` from the highest bit down, with counts of ones before every word of 64."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.size = len(symbols)
        self.levels = max(1, int(symbols.max(initial=0)).bit_length())
        self.planes, self.before, self.zeros = [], [], []
        current = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (current >> level & 1).astype(bool)
            padded = np.zeros((self.size + 63) // 64 * 64 + 64, np.uint8)
            padded[:self.size] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            self.planes.append(words)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]).astype(np.int32))
            self.zeros.append(self.size - int(bit.sum()))
            current = np.concatenate([current[~bit], current[bit]])
        # Where the places of each symbol begin on the lowest level.
        self.first = np.searchsorted(self._sorted_keys(current), self._reverse(np.arange(1 << self.levels))) if self.levels <= 24 else None

    def _reverse(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols as the lowest level orders them: by their bits read backwards."""
        out = np.zeros_like(symbols)
        for level in range(self.levels):
            out = out << 1 | (symbols >> level & 1)
        return out

    def _sorted_keys(self, lowest: np.ndarray) -> np.ndarray:
        return self._reverse(lowest)

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        start = self.first[symbol]
        for level in range(self.levels):
            word, bits = place >> 6, (place & 63).astype(np.uint64)
            inside = self.planes[level][word] & ((np.uint64(1) << bits) - np.uint64(1))
            ones = self.before[level][word] + np.bitwise_count(inside)
            set_ = (symbol >> (self.levels - 1 - level) & 1).astype(bool)
            place = np.where(set_, self.zeros[level] + ones, place - ones)
        return place - start


class Index:
    """FM-index over sequences of symbols 1, 2, ...; each carries a number, and places know the least number of a match."""

    def __init__(self, sequences: np.ndarray, starts: np.ndarray, lengths: np.ndarray, numbers: np.ndarray, window: int) -> None:
        self.window, count = window, len(starts)
        # Lay the sequences out, each with an end of its own below all symbols.
        total = int(lengths.sum()) + count
        ends = np.cumsum(lengths + 1) - 1
        place = np.ones(total, bool)
        place[ends] = False
        text = np.empty(total, np.int64)
        text[ends] = np.arange(count)
        text[place] = sequences + count - 1
        order, windows = suffix_ranks(text, window)
        before = np.where(order > 0, text[order - 1], 0) - count + 1
        self.matrix = WaveletMatrix(np.maximum(before, 0))  # ends are never searched for and share symbol 0
        symbols = np.bincount(sequences, minlength=2)
        self.less = np.concatenate([[0, count], count + np.cumsum(symbols[1:])])  # suffixes that begin with less
        same = windows[order]
        edge = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
        self.group = np.cumsum(np.concatenate([[False], same[1:] != same[:-1]]))  # suffixes that agree in a whole window
        self.group_start = np.append(edge, total)
        owner = np.repeat(np.arange(count), lengths + 1)
        self.least = np.minimum.reduceat(numbers[owner][order], edge)
        self.size = total

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes that begin with the symbol and go on as those from ``low`` to ``high``."""
        both = self.matrix.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        n = len(symbol)
        return self.less[symbol] + both[:n], self.less[symbol] + both[n:]

    def least_numbers(self, sequences: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """For every window of each sequence the least number of an indexed sequence that holds it, or the largest
        whole number if none does.

        All sequences are searched side by side, from their ends backwards. The match may be a window long at most:
        a longer one gives up its last symbol by widening its suffixes to all that agree in a window. One that
        breaks off begins anew.
        """
        n, none = len(starts), np.iinfo(np.int64).max
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        low, high, length = np.zeros(n, np.int64), np.full(n, self.size), np.zeros(n, np.int64)
        longest = int(lengths[0]) if n else 0
        active = np.searchsorted(-lengths, -np.arange(longest), "left")
        found = np.full(int(lengths.sum()), none)
        base = np.cumsum(lengths) - lengths
        for t in range(longest):
            m = active[t]
            symbol = sequences[starts[:m] + lengths[:m] - 1 - t]
            a, b = self.step(symbol, low[:m], high[:m])
            size = length[:m] + 1
            broken = np.flatnonzero(b <= a)
            if len(broken):
                a[broken], b[broken] = self.less[symbol[broken]], self.less[symbol[broken] + 1]
                size[broken] = 1
                lost = broken[b[broken] <= a[broken]]
                a[lost], b[lost], size[lost] = 0, self.size, 0
            whole = np.flatnonzero(size >= self.window)
            if len(whole):
                group = self.group[a[whole]]
                a[whole], b[whole], size[whole] = self.group_start[group], self.group_start[group + 1], self.window
                found[base[whole] + lengths[whole] - 1 - t] = self.least[group]
            low[:m], high[:m], length[:m] = a, b, size
        out: list = [None] * n
        for i, k in enumerate(order.tolist()):
            out[k] = found[base[i]:base[i] + max(0, int(lengths[i]) - self.window + 1)]
        return out
