"""Best-fit packing of documents into training sequences by large-item matching (operator 7).

A document longer than a sequence is cut; everything else stays whole. Lengths
are at most the capacity, so the driver plans with one count for each length,
however many documents there are: lengths above a third of the capacity pair at
most twice a sequence, by greedy matching, and the shorter ones best-fit the
gaps that remain. Executors number the pieces of each length and look their
place up in the plan.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets, numbered, prepare, slices, trimmed
from .words import IS_SPACE, U, find_words, text_bytes, word_hashes

CAPACITY = 2048
#: Different words of which a Python worker keeps the ids, and ids that it keeps (some 40 MB in all); beyond, it starts anew.
CACHE_WORDS, CACHE_IDS = 1_200_000, 6_000_000
#: Words that the tokenizer takes at a time.
ENCODE_WORDS = 4_000
#: Bytes of text that are cut at a time; the cache is copied once for each.
SLICE = 1 << 20


class WordIds:
    """Token ids of texts, through a cache of the ids of white-space delimited words.

    The tokenizer's own splitting never crosses ASCII white space, so a text's
    ids are those of its words in turn.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self.known, self.at, self.size = np.zeros(0, U), np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        self.pool, self.used = np.zeros(0, np.uint32), 0

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Keep the ids of ``words``, whose hashes are in order."""
        sizes = np.empty(len(words), np.int64)
        for k in range(0, len(words), ENCODE_WORDS):
            ids = [x.ids for x in self.tokenizer.encode_batch_fast(words[k : k + ENCODE_WORDS], add_special_tokens=False)]
            sizes[k : k + len(ids)] = [len(x) for x in ids]
            flat = np.fromiter((i for x in ids for i in x), np.uint32)
            if self.used + len(flat) > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.used], np.empty(max(len(flat), self.used // 2), np.uint32)])
            self.pool[self.used : self.used + len(flat)] = flat
            self.used += len(flat)
        at = np.cumsum(sizes) - sizes + (self.used - int(sizes.sum()))
        place = np.searchsorted(self.known, hashes)
        self.at, self.size = np.insert(self.at, place, at), np.insert(self.size, place, sizes)
        self.known = np.insert(self.known, place, hashes)

    def _missing(self, hashes: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.known, hashes), max(len(self.known) - 1, 0))
        return self.known[place] != hashes if len(self.known) else np.ones(len(hashes), bool)

    def __call__(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, an id 0 after each text, and where each text begins (and the last ends)."""
        if len(at) != 2 or len(data) <= 2 * SLICE:
            return self._some(data, at)
        # one long text: stretch by stretch, each up to a space
        spaces = np.flatnonzero(IS_SPACE[data])
        ends = spaces[np.unique(np.minimum(np.searchsorted(spaces, np.arange(SLICE, len(data), SLICE)), len(spaces) - 1))] if len(spaces) else spaces
        cuts = np.unique(np.concatenate([at[:1], ends, at[1:]]))
        ids = [self._some(data[i:j], np.array([0, j - i]))[0] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        out = np.concatenate([*(x[:-1] for x in ids), np.zeros(1, np.uint32)])
        return out, np.array([0, len(out)])

    def _some(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, first = find_words(data, at, IS_SPACE)
        different, one, which = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        new = np.flatnonzero(self._missing(different))
        if len(new) and (len(self.known) + len(new) > CACHE_WORDS or self.used > CACHE_IDS):
            self._forget()
            new = np.arange(len(different))
        if len(new):
            raw = data.tobytes()
            self._learn(different[new], [raw[starts[k] : ends[k]].decode() for k in one[new]])
        place = np.searchsorted(self.known, different)
        size, begin = self.size[place][which].astype(np.int64), self.at[place][which].astype(np.int64)
        words = np.diff(first)
        # one id more after each text's last word: the id 0
        total = np.concatenate([[0], np.cumsum(size)])
        bounds = total[first] + np.arange(len(first))
        out = np.zeros(bounds[-1], np.uint32)
        to = np.repeat(total[:-1] - begin, size)
        flat = np.arange(total[-1])
        out[flat + np.repeat(np.arange(len(words)), np.diff(total[first]))] = self.pool[flat - to]
        return out, bounds


_TOKENIZERS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordIds(path)
    return _TOKENIZERS[path]


def _cut(path: str, capacity: int, with_ids: bool):
    def run(batches):
        for x in slices(batches, 1, SLICE):
            ids, at = word_ids(path)(*text_bytes(x.column(1)))
            pieces = np.maximum(1, -(-np.diff(at) // capacity))
            doc = np.repeat(np.arange(len(pieces)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(capacity, np.diff(at)[doc] - start)
            raw, begin = ids.astype("<u4").view(np.uint8), 4 * (at[doc] + start)
            crc = [zlib.crc32(raw[b : b + 4 * n]) for b, n in zip(begin.tolist(), length.tolist(), strict=True)]
            columns = {"doc_id": x.column(0).take(pa.array(doc)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64())}
            if with_ids:
                where = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                columns["ids"] = pa.ListArray.from_arrays(pa.array(where), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_pydict(columns)

    return trimmed(run)


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, path: str, capacity: int, id_col: str, text_col: str, with_ids: bool = False) -> DataFrame:
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(_cut(path, capacity, with_ids), PIECES + ", ids array<int>" * with_ids)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Where pieces go, given how many have each length: rows (length, first rank, how many, first sequence, offset).

    The pieces of a row go one each to consecutive sequences, at one offset.
    """
    left, rank, rows, opened = dict(counts), defaultdict(int), [], 0
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> runs (first sequence, how many)

    def put(length: int, n: int, base: int, offset: int) -> None:
        rows.append((length, rank[length], n, base, offset))
        rank[length] += n
        left[length] -= n

    large = sorted((s for s in counts if 3 * s > capacity), reverse=True)
    for a in large:
        for b in large:  # the largest partner that fits first
            if b > a or a + b > capacity or not left[b]:
                continue
            n = left[a] // 2 if a == b else min(left[a], left[b])
            if n:
                put(a, n, opened, 0)
                put(b, n, opened, a)
                gaps[capacity - a - b].append((opened, n))
                opened += n
            if not left[a]:
                break
        if n := left[a]:
            put(a, n, opened, 0)
            gaps[capacity - a].append((opened, n))
            opened += n
    for s in sorted((s for s in counts if 3 * s <= capacity), reverse=True):
        while n := left[s]:
            gap = next((g for g in range(s, capacity + 1) if gaps[g]), None)
            if gap is None:
                gap, run = capacity, (opened, -(-n // (capacity // s)))
                opened += run[1]
            else:
                run = gaps[gap].pop()
            base, many = run
            each = gap // s  # a sequence stays the tightest gap until it is full for s
            full = min(many, n // each)
            for k in range(each if full else 0):
                put(s, full, base, capacity - gap + k * s)
            if full:
                gaps[gap - each * s].append((base, full))
            if full < many:
                rest = left[s]
                for k in range(min(rest, each)):
                    put(s, 1, base + full, capacity - gap + k * s)
                gaps[gap - min(rest, each) * s].append((base + full, 1))
                if full + 1 < many:
                    gaps[gap].append((base + full + 1, many - full - 1))
    return rows


def _place(rows: list[tuple[int, int, int, int, int]]):
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    keys = (table[:, 0] << 40) + table[:, 1]

    def run(batches):
        for x in batches:
            length, rank = x.column("length").to_numpy(), x.column("rank").to_numpy()
            row = table[np.searchsorted(keys, (length << 40) + rank, "right") - 1]
            kept = [x.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its tokens and then id 0, so an empty or null text is one
    piece of length 1. Repeated rows are packed each on its own. Pieces of one
    length are interchangeable; which gets which place follows a hash of doc_id,
    then doc_id and piece. Other columns are not read; an empty table gives no
    rows.
    """
    prepare(docs.sparkSession)
    cut = pieces(docs, path, capacity, id_col, text_col).checkpoint()
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    ranked = numbered(cut, ["length"], ["doc_id", "piece"], buckets(sum(counts.values()), 1_000_000), "rank", "doc_id")
    return ranked.mapInArrow(_place(plan(counts, capacity)), PIECES + ", sequence_id bigint, offset bigint")


def sequences(docs: DataFrame, placed: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed sequences themselves: sequence_id, ids. A sequence's pieces, at most ``capacity`` ids, meet in one row."""
    key = ["doc_id", "piece", "ids_crc32"]
    ids = pieces(docs, path, capacity, id_col, text_col, with_ids=True).select(*key, "ids").dropDuplicates(key)
    parts = placed.join(ids, key).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
