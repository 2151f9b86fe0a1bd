"""Recompression of word sequences: rounds that name runs of one symbol, then pairs of symbols.

A round replaces every maximal run of one symbol by a symbol for (symbol,
length), and then every neighbouring pair whose left symbol tosses 0 and whose
right symbol tosses 1 by a symbol for the pair. What names the new symbols get
is decided elsewhere, for all documents alike (:mod:`.substring_dedup`); tosses
and the keys by which names are asked depend on nothing but names. So equal
substrings get equal symbols, but for those near their ends. How near is kept
exactly: each symbol carries its *context*, the stretch of words that decided
where it begins and ends and what it is. Wherever all of a context recurs, so
does the symbol.

Symbols named 0 have no name to share; they join nothing, and neither do
symbols between which words have been left out.
"""

from __future__ import annotations

import numpy as np

from .words import U, mix

_RUN, _PAIR = U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB)


class Parse:
    """Symbols of several documents in turn: names, documents, words [begin, end), context [low, high), and which are new in the last round."""

    def __init__(self, names, doc, begin, end, low, high, fresh=None):
        self.names, self.doc, self.begin, self.end, self.low, self.high = names, doc, begin, end, low, high
        self.fresh = np.zeros(len(names), bool) if fresh is None else fresh

    @classmethod
    def of_words(cls, names: np.ndarray, doc: np.ndarray) -> Parse:
        at = np.arange(len(names))
        return cls(names, doc, at, at + 1, at, at + 1)

    def take(self, keep: np.ndarray) -> Parse:
        return Parse(*(x[keep] for x in (self.names, self.doc, self.begin, self.end, self.low, self.high, self.fresh)))

    def near(self) -> np.ndarray:
        """Whether each symbol but the last is followed, without a gap, by the next of its document."""
        return (self.doc[1:] == self.doc[:-1]) & (self.end[:-1] == self.begin[1:])


def runs(p: Parse) -> Parse:
    """Every maximal run of one symbol becomes one; its neighbours must be seen to differ, so they are of its context."""
    n = len(p.names)
    if not n:
        return p
    near = p.near()
    first = np.concatenate([[True], ~near | (p.names[1:] != p.names[:-1]) | (p.names[1:] == 0)])
    begin = np.flatnonzero(first)
    size = np.diff(np.append(begin, n))
    last = begin + size - 1
    fresh = size > 1
    names = p.names[begin]
    names = np.where(fresh, mix(names * _RUN + size.astype(U)), names)
    # where no neighbour is there to see, the word beyond the edge stands for "unknown"
    left, right = np.concatenate([[False], near])[begin], np.concatenate([near, [False]])[last]
    low = np.minimum(np.minimum.reduceat(p.low, begin), np.where(left, p.low[np.maximum(begin - 1, 0)], p.begin[begin] - 1))
    high = np.maximum(np.maximum.reduceat(p.high, begin), np.where(right, p.high[np.minimum(last + 1, n - 1)], p.end[last] + 1))
    return Parse(names, p.doc[begin], p.begin[begin], p.end[last], low, high, fresh)


def pairs(p: Parse, turn: int) -> Parse:
    """Every two neighbours that toss 0 and 1 become one symbol."""
    n = len(p.names)
    if n < 2:
        return p
    toss = (mix(p.names + U(turn)) >> U(63)).astype(bool)
    near, named = p.near(), p.names != 0
    joins = near & ~toss[:-1] & toss[1:] & named[:-1] & named[1:]  # i with i + 1
    left, right = np.append(joins, False), np.concatenate([[False], joins])
    low, high = p.low.copy(), p.high.copy()
    # a symbol that stays alone saw its neighbour: a 1 the one before, a 0 the one after
    back = np.flatnonzero(~left & ~right & toss & named)
    there = np.concatenate([[False], near])[back]
    low[back] = np.minimum(p.low[back], np.where(there, p.low[np.maximum(back - 1, 0)], p.begin[back] - 1))
    high[back] = np.maximum(p.high[back], np.where(there, p.high[np.maximum(back - 1, 0)], 0))
    ahead = np.flatnonzero(~left & ~right & ~toss & named)
    there = np.append(near, False)[ahead]
    high[ahead] = np.maximum(p.high[ahead], np.where(there, p.high[np.minimum(ahead + 1, n - 1)], p.end[ahead] + 1))
    low[ahead] = np.minimum(p.low[ahead], np.where(there, p.low[np.minimum(ahead + 1, n - 1)], p.low[ahead]))
    at = np.flatnonzero(left)
    names, end, fresh = p.names.copy(), p.end.copy(), p.fresh.copy()
    names[at] = mix(p.names[at] * _PAIR + mix(p.names[at + 1]))
    end[at], fresh[at] = p.end[at + 1], True
    low[at], high[at] = np.minimum(p.low[at], p.low[at + 1]), np.maximum(p.high[at], p.high[at + 1])
    return Parse(names, p.doc, p.begin, end, low, high, fresh).take(~right)


def one_round(p: Parse, turn: int) -> Parse:
    """The parse after one more round; the names of new symbols are keys that have yet to be named."""
    return pairs(runs(p), turn)


def recompress(names: np.ndarray, doc: np.ndarray, rounds: int) -> Parse:
    """The parse after ``rounds`` rounds in which every key is its own name, as where all symbols are shared."""
    p = Parse.of_words(names, doc)
    for turn in range(1, rounds + 1):
        p = one_round(p, turn)
    return p
