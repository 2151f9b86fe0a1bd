"""The analyzer on whole Arrow batches: what :mod:`.analyzer` says of one text, numpy finds for many.

Texts become code points. A table gives each one's class; runs, cuts between an
identifier's parts and CJK pairs are comparisons of neighbours' classes. Only
tokens' places are numbers here, terms are made once for each different one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .analyzer import _FOLD

#: Bytes of text that are analysed at a time.
SLICE_BYTES = 1 << 20
_BREAK, _CJK, _LOWER, _UPPER, _OTHER, _DIGIT = range(6)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: the class of what it is folded to, and what that is in lower case."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every = "".join(points)
    kinds = np.zeros(0x110000, np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    for pattern, kind in ((r"\p{L}+", _OTHER), (r"\p{Ll}+", _LOWER), (r"\p{Lu}+", _UPPER), (r"\p{Nd}+", _DIGIT), (r"(?V1)[\p{L}&&[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]]+", _CJK)):
        for m in regex.finditer(pattern, every):
            kinds[ord(every[m.start()]) : ord(every[m.end() - 1]) + 1] = kind
    kinds[0xD800:0xE000] = _BREAK
    for m in regex.finditer(r"[\p{Lu}\p{Lt}\p{Lo}\p{Lm}\p{Ll}]", every):
        c = m.group()
        if (low := c.lower()[0]) != c:
            lower[ord(c)] = ord(low)
    for wide, narrow in _FOLD.items():
        to = narrow if isinstance(narrow, int) else ord(narrow)
        kinds[wide], lower[wide] = kinds[to], lower[to]
    return kinds, lower


@dataclass
class Tokens:
    """Tokens of some texts by text and position: number of the term in ``terms``, text, position."""

    terms: pa.Array
    code: np.ndarray
    row: np.ndarray
    pos: np.ndarray
    n_rows: int

    @property
    def lengths(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.n_rows)


def _code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points, and where each text begins (and the last ends)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
    points = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4")
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return points, before[at - at[0]]


def _gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The strings data[starts:ends]."""
    size = ends - starts
    stop = np.cumsum(size)
    flat = data[np.arange(int(size.sum())) + np.repeat(starts - (stop - size), size)]
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(np.concatenate([[0], stop]).astype(np.int64)), pa.py_buffer(flat)])


def _places(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Code points; and of tokens, in no order, where they start and end there, their text and their position."""
    kinds, _ = _tables()
    points, at = _code_points(texts)
    kind = kinds[points]
    group = np.minimum(kind, 2)  # break, CJK, word
    edge = np.zeros(len(points) + 1, bool)
    edge[at] = True
    differs = np.ones(len(points) + 1, bool)
    differs[1:-1] = (group[1:] != group[:-1]) | edge[1:-1]
    cut = np.flatnonzero(differs)
    starts, ends = cut[:-1], cut[1:]
    some = group[starts] > 0 if len(points) else np.zeros(0, bool)
    starts, ends = starts[some], ends[some]
    cjk = group[starts] == 1 if len(points) else np.zeros(0, bool)
    row = np.searchsorted(at, starts, "right") - 1
    # cuts between an identifier's parts
    inner = ~differs[:-1]
    cuts = np.zeros(len(points), bool)
    if len(points) > 1:
        upper = kind == _UPPER
        cuts[1:] = inner[1:] & upper[1:] & ((kind[:-1] == _LOWER) | (kind[:-1] == _DIGIT))
        cuts[1:-1] |= inner[1:-1] & upper[1:-1] & upper[:-2] & (kind[2:] == _LOWER) & inner[2:]
    parts = np.flatnonzero(cuts)
    of = np.searchsorted(starts, parts, "right") - 1  # the run of each cut
    advance = np.bincount(of, minlength=len(starts)) + 1
    advance[cjk] = np.maximum(ends[cjk] - starts[cjk] - 1, 1)
    total = np.concatenate([[0], np.cumsum(advance)])
    base = total[:-1] - total[np.searchsorted(starts, at[:-1], "left")][row] if len(starts) else total[:-1]
    words = np.flatnonzero(~cjk)
    token_start, token_end, token_row, token_pos = [starts[words]], [ends[words]], [row[words]], [base[words]]
    if len(parts):
        several = np.unique(of)
        s = np.sort(np.concatenate([starts[several], parts]))
        run = np.searchsorted(starts, s, "right") - 1
        last = np.append(run[1:] != run[:-1], True)
        e = np.where(last, ends[run], np.append(s[1:], 0))
        nth = np.arange(len(s)) - np.searchsorted(run, run, "left")
        token_start, token_end, token_row, token_pos = [*token_start, s], [*token_end, e], [*token_row, row[run]], [*token_pos, base[run] + nth]
    if cjk.any():
        runs = np.flatnonzero(cjk)
        n = advance[runs]
        nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        s = np.repeat(starts[runs], n) + nth
        e = np.minimum(s + 2, np.repeat(ends[runs], n))
        token_start, token_end, token_row, token_pos = [*token_start, s], [*token_end, e], [*token_row, np.repeat(row[runs], n)], [*token_pos, np.repeat(base[runs], n) + nth]
    return points, *(np.concatenate(x) for x in (token_start, token_end, token_row, token_pos))


def lengths(texts: pa.Array) -> np.ndarray:
    """The number of tokens of each text; no term is made for it."""
    return np.bincount(_places(texts)[3], minlength=len(texts))


def analyze(texts: pa.Array) -> Tokens:
    n_rows = len(texts)
    points, s, e, r, p = _places(texts)
    if len(r) and (r[1:] < r[:-1]).any():  # identifiers' parts and CJK pairs stand behind the words
        order = np.lexsort((p, r))
        s, e, r, p = s[order], e[order], r[order], p[order]
    low = _tables()[1][points]
    data = np.frombuffer(low.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
    byte = np.concatenate([[0], np.cumsum(1 + (low >= 0x80).astype(np.int64) + (low >= 0x800) + (low >= 0x10000))])
    terms = _gather(data, byte[s], byte[e]).dictionary_encode()
    return Tokens(terms.dictionary.cast(pa.string()), terms.indices.to_numpy().astype(np.int64), r, p, n_rows)


def slices(batches, columns: list[str]):
    """The rows of Arrow batches as batches of about SLICE_BYTES of text at most; a longer row is a slice of its own."""
    for x in batches:
        size = sum(pc.fill_null(pc.binary_length(x.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
        ends, done = np.cumsum(size), 0
        while done < x.num_rows:
            upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + SLICE_BYTES, "right")))
            yield x.slice(done, upto - done)
            done = upto
