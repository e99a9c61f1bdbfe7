"""A full-text index over integer symbols: wavelet ranks, backward search, sampled places."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of seq in sorted order (a shorter suffix first), by doubling."""
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    sorted_seq = seq[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], sorted_seq[1:] != sorted_seq[:-1]]))
    width = 1
    while n and rank[order[-1]] < n - 1 and width < n:
        second = np.zeros(n, np.int64)
        second[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]]))
        width *= 2
    return order


class BitRank:
    """Bits with a count before every 64th, so that ones before a place are found at once."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((_ONE << bit) - _ONE))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & _ONE


class WaveletTree:
    """One bit level per symbol bit, zeros sorted before ones at each level."""

    def __init__(self, seq: np.ndarray, n_bits: int):
        self.levels, self.zeros = [], []
        for b in range(n_bits - 1, -1, -1):
            bits = ((seq >> b) & 1).astype(np.uint8)
            self.levels.append(BitRank(bits))
            self.zeros.append(int(len(seq) - bits.sum()))
            seq = np.concatenate([seq[bits == 0], seq[bits == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        low, high = np.zeros_like(at), at.copy()
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbol >> (len(self.levels) - 1 - k)) & 1
            low1, high1 = level.ones(low), level.ones(high)
            low = np.where(one, zeros + low1, low - low1)
            high = np.where(one, zeros + high1, high - high1)
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for level, zeros in zip(self.levels, self.zeros, strict=True):
            bit, ones = level.get(at).astype(np.int64), level.ones(at)
            symbol = symbol * 2 + bit
            at = np.where(bit, zeros + ones, at - ones)
        return symbol


class FMIndex:
    """Index of a sequence of symbols below n_symbols, in which 0 stands once, at the end."""

    def __init__(self, seq: np.ndarray, n_symbols: int, every: int = 8):
        self.order = suffix_order(seq)
        last = seq[self.order - 1]
        self.tree = WaveletTree(last, max(1, int(n_symbols - 1).bit_length()))
        self.start = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=n_symbols))])
        sampled = self.order % every == 0
        self.has_sample = BitRank(sampled.astype(np.uint8))
        self.sample = self.order[sampled]
        self.n = len(seq)
        del self.order

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.start[symbol] + self.tree.rank(symbol, at)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of all patterns (padded on the right), from the last symbol to the first."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for k in range(int(lengths.max(initial=0))):
            now = np.flatnonzero((lengths > k) & (high > low))
            if not len(now):
                break
            symbol = patterns[now, lengths[now] - 1 - k]
            low[now], high[now] = self.step(symbol, low[now]), self.step(symbol, high[now])
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the sequence, by steps backwards to the next sampled suffix."""
        place, rows, steps = np.empty(len(rows), np.int64), rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            has = self.has_sample.get(rows[todo]).astype(bool)
            done = todo[has]
            place[done] = self.sample[self.has_sample.ones(rows[done])] + steps[done]
            todo = todo[~has]
            symbol = self.tree.access(rows[todo])
            rows[todo] = self.step(symbol, rows[todo])
            steps[todo] += 1
        return place % max(self.n, 1)
