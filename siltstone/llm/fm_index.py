"""FM-index of a sequence collection in numpy: suffix order, BWT, wavelet-matrix ranks, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_order(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions sorted by what follows them up to the end of their sequence, ties by position.

    codes: symbols >= 0; ends[i]: the end (exclusive) of the sequence that position i is in.
    Prefix doubling; only positions that are still tied are sorted again.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    sorted_codes = codes[order]
    fresh = np.concatenate([[True], sorted_codes[1:] != sorted_codes[:-1]]) if n else np.zeros(0, bool)
    heads = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = heads
    width = 1
    while True:
        # slots of the order whose group has more than one member
        alone = fresh & np.concatenate([fresh[1:], [True]]) if n else fresh
        slots = np.flatnonzero(~alone)
        if not len(slots):
            return order
        at = order[slots]
        ahead = at + width
        second = np.where(ahead < ends[at], rank[np.minimum(ahead, n - 1)] + 1, 0)
        if not second.any():
            return order
        first = rank[at]
        again = np.lexsort((at, second, first))
        order[slots] = at[again]
        first, second = first[again], second[again]
        new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        fresh[slots] = new
        rank[order[slots]] = np.maximum.accumulate(np.where(new, slots, 0))
        width *= 2


class WaveletMatrix:
    """Rank and access over symbols below 2**bits, one bit vector a level."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits = bits
        self.zeros, self.ones = [], []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            before = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit, out=before[1:])
            self.ones.append(before)
            self.zeros.append(len(symbols) - int(before[-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol occurs before i, elementwise."""
        start = np.zeros_like(i)
        for k in range(self.bits):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            a, b = self.ones[k][start], self.ones[k][i]
            start = np.where(one, self.zeros[k] + a, start - a)
            i = np.where(one, self.zeros[k] + b, i - b)
        return i - start

    def access(self, i: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(i)
        for k in range(self.bits):
            a = self.ones[k][i]
            one = self.ones[k][i + 1] - a
            symbol = symbol * 2 + one
            i = np.where(one == 1, self.zeros[k] + a, i - a)
        return symbol


class FMIndex:
    """Counts and positions of phrases in sequences of symbols 1 .. 2**bits - 1.

    ``codes`` is the concatenation of the sequences, ``starts`` their first positions. The
    symbol before and after a sequence is 0, which no phrase has. Positions are kept for every
    ``every``-th one and for the first of each sequence; the others are found by walking back.
    """

    def __init__(self, codes: np.ndarray, starts: np.ndarray, bits: int, every: int = 16):
        lengths = np.diff(np.append(starts, len(codes))) + 1
        self.n = n = len(codes) + len(starts)
        number = np.repeat(np.arange(len(starts)), lengths)
        first = np.zeros(n, bool)
        last = np.cumsum(lengths) - 1
        first[last - lengths + 1] = True
        ended = np.zeros(n, np.int64)  # each sequence with a 0 at its end
        ended[np.arange(len(codes)) + np.repeat(np.arange(len(starts)), lengths - 1)] = codes
        order = suffix_order(ended, np.repeat(last + 1, lengths))
        bwt = np.where(first[order], 0, ended[order - 1])
        self.wavelet = WaveletMatrix(bwt, bits)
        self.before = np.zeros(2**bits + 1, np.int64)
        np.cumsum(np.bincount(ended, minlength=2**bits), out=self.before[1:])
        kept = first[order] | (order % every == 0)
        self.kept_rank = np.zeros(n + 1, np.int64)
        np.cumsum(kept, out=self.kept_rank[1:])
        self.kept_at = (order - number[order])[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows lo:hi of the suffix order that begin with each phrase.

        phrases: (m, width) symbols, each phrase at the right end of its row.
        """
        m, width = phrases.shape
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        live = np.arange(m)
        for step in range(width):
            live = live[(lengths[live] > step) & (hi[live] > lo[live])]
            if not len(live):
                break
            symbol = phrases[live, width - 1 - step]
            lo[live] = self.before[symbol] + self.wavelet.rank(symbol, lo[live])
            hi[live] = self.before[symbol] + self.wavelet.rank(symbol, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix order."""
        rows, out, steps = rows.copy(), np.empty(len(rows), np.int64), 0
        live = np.arange(len(rows))
        while len(live):
            kept = self.kept_rank[rows[live] + 1] > self.kept_rank[rows[live]]
            done = live[kept]
            out[done] = self.kept_at[self.kept_rank[rows[done]]] + steps
            live = live[~kept]
            if len(live):
                symbol = self.wavelet.access(rows[live])
                rows[live] = self.before[symbol] + self.wavelet.rank(symbol, rows[live])
                steps += 1
        return out
