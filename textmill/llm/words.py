"""Words of whole Arrow batches, found and hashed by numpy on the raw UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: 1 for the bytes of `[\x20\x09-\x0D]`.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: 1 for the bytes outside `[^\x00-\x2F\x3A-\x60\x7B-\x7F]`, after lower-casing A-Z.
IS_BREAK = np.ones(256, bool)
IS_BREAK[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

U = np.uint64
_LEFT = np.array([(1 << 8 * i) - 1 for i in range(9)], U)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each text begins (and the last ends); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def find_words(data: np.ndarray, at: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the index of each text's first word (and the number of words)."""
    inside = ~breaks[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def lanes(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place on, as little-endian numbers; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def mix(h: np.ndarray) -> np.ndarray:
    """Stir 64-bit numbers so that all bits depend on all bits."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same in every process."""
    view, left = lanes(data), ends - starts
    h = left.astype(U) * U(0x9E3779B97F4A7C15)
    which, place = np.arange(len(starts)), starts.copy()
    while len(which):
        part = view[place] & _LEFT[np.minimum(left, 8)]
        h[which] = mix(h[which] ^ part) + U(0x632BE59BD9B4E019)
        more = left > 8
        which, place, left = which[more], place[more] + 8, left[more] - 8
    return h


def equal_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: np.ndarray, other_starts: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether each word of ``data`` has the bytes of its counterpart in ``others``."""
    left = ends - starts
    same = left == other_ends - other_starts
    a, b = lanes(data), lanes(others)
    which = np.flatnonzero(same & (left > 0))
    done = 0
    while len(which):
        part = _LEFT[np.minimum(left[which] - done, 8)]
        differs = (a[starts[which] + done] ^ b[other_starts[which] + done]) & part != 0
        same[which[differs]] = False
        done += 8
        which = which[~differs & (left[which] > done)]
    return same


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with exactly one space after each: bytes, and each word's new start and end."""
    sizes = ends - starts
    new = np.concatenate([[0], np.cumsum(sizes + 1)])
    out = np.full(new[-1], 0x20, np.uint8)
    if (starts[1:] >= ends[:-1]).all():  # in order, as words are found: a byte of mask for each byte
        inside, word = np.zeros(len(data) + 1, np.int8), np.ones(len(out), bool)
        inside[starts] += 1
        inside[ends] -= 1
        word[new[1:] - 1] = False
        out[word] = data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
    else:
        for k in range(int(sizes.max(initial=0))):
            some = np.flatnonzero(sizes > k)
            out[new[some] + k] = data[starts[some] + k]
    return out, new[:-1], new[:-1] + sizes


_P1, _P2, _P3, _P4, _P5 = (U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x, r):
    return (x << U(r)) | (x >> U(64 - r))


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many byte ranges at once."""
    with np.errstate(over="ignore"):
        view, seed = lanes(data), U(seed)
        size = ends - starts
        place, left = starts.astype(np.int64), size.astype(np.int64)
        h = np.full(len(starts), seed + _P5, U)
        if len(big := np.flatnonzero(size >= 32)):
            acc = [np.full(len(big), s, U) for s in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
            go = np.arange(len(big))
            while len(go):
                for k in range(4):
                    acc[k][go] = _rotl(acc[k][go] + view[place[big[go]] + 8 * k] * _P2, 31) * _P1
                place[big[go]] += 32
                left[big[go]] -= 32
                go = go[left[big[go]] >= 32]
            v = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for k in range(4):
                v = (v ^ (_rotl(acc[k] * _P2, 31) * _P1)) * _P1 + _P4
            h[big] = v
        h += size.astype(U)
        go = np.flatnonzero(left >= 8)
        while len(go):
            h[go] = _rotl(h[go] ^ (_rotl(view[place[go]] * _P2, 31) * _P1), 27) * _P1 + _P4
            place[go] += 8
            left[go] -= 8
            go = go[left[go] >= 8]
        go = np.flatnonzero(left >= 4)
        h[go] = _rotl(h[go] ^ ((view[place[go]] & U(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
        place[go] += 4
        left[go] -= 4
        go = np.flatnonzero(left > 0)
        while len(go):
            h[go] = _rotl(h[go] ^ ((view[place[go]] & U(0xFF)) * _P5), 11) * _P1
            place[go] += 1
            left[go] -= 1
            go = go[left[go] > 0]
        h ^= h >> U(33)
        h *= _P2
        h ^= h >> U(29)
        h *= _P3
        return h ^ (h >> U(32))
