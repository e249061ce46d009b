"""FM-index over numbers: wavelet matrix ranks, backward search, sampled suffix positions. Numpy only."""

import numpy as np


class Bits:
    """A bit vector that counts its ones before any position."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))
        self.ones = int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class Wavelet:
    """Rank and access over a sequence of numbers below ``size``, one bit vector per bit."""

    def __init__(self, values: np.ndarray, size: int):
        self.n = len(values)
        self.depth = max(1, int(size - 1).bit_length())
        self.levels: list[tuple[Bits, int]] = []
        for k in range(self.depth - 1, -1, -1):
            bit = (values >> k) & 1
            self.levels.append((Bits(bit.astype(np.uint8)), int(len(values) - bit.sum())))
            values = np.concatenate([values[bit == 0], values[bit == 1]])
        self.start = self._down(np.arange(size), np.zeros(size, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in zip(range(self.depth - 1, -1, -1), self.levels):
            ones = bits.rank(at)
            at = np.where((symbol >> k) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position."""
        return self._down(symbol, at) - self.start[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and how often it stands before."""
        symbol = np.zeros(len(at), np.int64)
        for bits, zeros in self.levels:
            bit = bits.get(at).astype(np.int64)
            ones = bits.rank(at)
            at = np.where(bit == 1, zeros + ones, at - ones)
            symbol = symbol << 1 | bit
        return symbol, at - self.start[symbol]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; the end of the text is smaller than any symbol."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    k = 1
    while True:
        second = np.zeros(n, np.int64)
        second[:n - k] = rank[k:]
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.concatenate(([1], (key[1:] != key[:-1]).astype(np.int64)))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        if rank[order[-1]] == n or k >= n:
            return order
        k *= 2


class FMIndex:
    """Finds all places of phrases in ``text`` (numbers from 1; 0 separates and is in no phrase)."""

    def __init__(self, text: np.ndarray, size: int, sample: int = 8):
        text = np.concatenate([text.astype(np.int64) + 1, [0]])  # 0 closes the text
        order = suffix_order(text)
        self.n = len(text)
        self.wavelet = Wavelet(text[order - 1], size + 1)
        counts = np.bincount(text, minlength=size + 1)
        self.before = np.concatenate(([0], np.cumsum(counts)))
        marked = order % sample == 0
        self.marked = Bits(marked.astype(np.uint8))
        self.places = order[marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range [low, high) of each row of ``phrases``, all of one length."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, j].astype(np.int64) + 1
            base = self.before[symbol]
            low[live] = base + self.wavelet.rank(symbol, low[live])
            high[live] = base + self.wavelet.rank(symbol, high[live])
            live = live[low[live] < high[live]]
        found = low < high
        return np.where(found, low, 0), np.where(found, high, 0)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back to the next sampled position."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.nonzero(self.marked.get(at) == 0)[0]
        while len(open_):
            symbol, before = self.wavelet.access(at[open_])
            at[open_] = self.before[symbol] + before
            steps[open_] += 1
            open_ = open_[self.marked.get(at[open_]) == 0]
        return self.places[self.marked.rank(at)] + steps
