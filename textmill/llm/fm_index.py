"""An FM-index over word numbers: Burrows-Wheeler transform, wavelet-tree ranks, sampled suffix positions."""

from __future__ import annotations

import numpy as np

U = np.uint64


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of ``text`` in order. Prefix doubling; only suffixes that are still tied are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    sorted_text = text[order]
    head = np.concatenate([[True], sorted_text[1:] != sorted_text[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
    width = 1
    while True:
        group = np.flatnonzero(head)
        size = np.diff(np.concatenate([group, [n]]))
        tied = np.flatnonzero(np.repeat(size > 1, size))
        if not len(tied):
            return order
        who = order[tied]
        follow = who + width
        second = np.where(follow < n, rank[np.minimum(follow, n - 1)] + 1, 0)
        first = rank[who]
        moved = np.lexsort((second, first))
        order[tied] = who[moved]
        a, b = first[moved], second[moved]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        head[tied] = new
        rank[order[tied]] = tied[np.flatnonzero(new)[np.cumsum(new) - 1]]
        width *= 2


class Bits:
    """Bits with the number of ones before each place."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(U)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])

    def __getitem__(self, i):
        return (self.words[i >> 6] >> (i & 63).astype(U)) & U(1)

    def ones(self, i):
        mask = (U(1) << (i & 63).astype(U)) - U(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & mask)


class WaveletTree:
    """Symbols by their bits, highest first; each level is stably parted by its bit, zeros first."""

    def __init__(self, symbols: np.ndarray, n_bits: int):
        self.n_bits, self.levels, self.zeros = n_bits, [], []
        for k in reversed(range(n_bits)):
            bit = (symbols >> k) & 1
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first i."""
        low = np.zeros_like(i)
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = ((symbol >> (self.n_bits - 1 - k)) & 1).astype(bool)
            a, b = bits.ones(low), bits.ones(i)
            low, i = np.where(one, zeros + a, low - a), np.where(one, zeros + b, i - b)
        return i - low

    def access(self, i: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(i)
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            one = bits[i].astype(bool)
            ones = bits.ones(i)
            symbol, i = 2 * symbol + one, np.where(one, zeros + ones, i - ones)
        return symbol


class FMIndex:
    """Of a text of symbols from 1 up. Patterns are searched backwards, all at once."""

    SAMPLE = 16

    def __init__(self, text: np.ndarray):
        text = np.concatenate([text.astype(np.int64), [0]])  # 0 ends the text and is in no pattern
        sa = suffix_array(text)
        top = int(text.max())
        self.n = len(text)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.bwt = WaveletTree(text[sa - 1], max(1, top.bit_length()))
        sampled = sa % self.SAMPLE == 0
        self.marked, self.samples = Bits(sampled), sa[sampled]

    def search(self, patterns: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each pattern; ``patterns`` is padded at the right."""
        low, high = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.n, np.int64)
        for back in range(1, int(sizes.max(initial=0)) + 1):
            go = np.flatnonzero((sizes >= back) & (low < high))
            if not len(go):
                break
            symbol = patterns[go, sizes[go] - back]
            known = symbol < len(self.first) - 1
            high[go[~known]] = low[go[~known]]
            go, symbol = go[known], symbol[known]
            low[go], high[go] = self.first[symbol] + self.bwt.rank(symbol, low[go]), self.first[symbol] + self.bwt.rank(symbol, high[go])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes at ``rows``: back to the nearest sampled one, counting steps."""
        out, steps = np.empty(len(rows), np.int64), 0
        which, rows = np.arange(len(rows)), rows.copy()
        while len(which):
            there = self.marked[rows].astype(bool)
            out[which[there]] = self.samples[self.marked.ones(rows[there])] + steps
            which, rows = which[~there], rows[~there]
            symbol = self.bwt.access(rows)
            rows = self.first[symbol] + self.bwt.rank(symbol, rows)
            steps += 1
        return out
