"""Benchmark decontamination with an FM-index per training shard (operator 2).

A shard is what a task reads at a time. Its words that benchmark items have are
numbered; stretches of them as long as the shortest window or longer are
indexed, with a separator between, since no occurrence can lie elsewhere. All
windows are searched backwards through the wavelet tree's ranks, located by the
sampled suffix positions, and their places merged to removal spans.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lookup, prepare, slices, trimmed
from .fm_index import FMIndex
from .words import IS_BREAK, LOWER, equal_words, find_words, joined, text_bytes, word_hashes

WINDOW = 10
#: Bytes of benchmark text that are searched in one pass and sent to all tasks; more take further passes.
BLOCK_BYTES = 4 << 20
#: Indexed words, or bytes that are held, that end a shard.
SHARD_WORDS, SHARD_BYTES = 1 << 18, 16 << 20


class Windows:
    """The different windows of some benchmark items, as numbers of their vocabulary."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        data, at = text_bytes(pa.array([t for _, t in items], pa.string()))
        data = LOWER[data]
        starts, ends, first = find_words(data, at, IS_BREAK)
        hashes = word_hashes(data, starts, ends)
        self.vocabulary, numbers = np.unique(hashes, return_inverse=True)
        _, one = np.unique(numbers, return_index=True)
        # each different word once, to compare the documents' words with
        self.text, self.starts, self.ends = joined(data, starts[one], ends[one])
        if not equal_words(data, starts, ends, self.text, self.starts[numbers], self.ends[numbers]).all():
            raise ValueError("two benchmark words share a 64-bit hash")
        of: dict[tuple, set] = {}
        for k, (item, _) in enumerate(items):
            words = (numbers[first[k] : first[k + 1]] + 1).tolist()
            for i in range(max(len(words) - width + 1, min(len(words), 1))):
                of.setdefault(tuple(words[i : i + width]), set()).add(item)
        windows = sorted(of)
        self.items = [sorted(of[w]) for w in windows]
        self.sizes = np.array([len(w) for w in windows], np.int64)
        self.patterns = np.zeros((len(windows), width), np.int64)
        for k, w in enumerate(windows):
            self.patterns[k, : len(w)] = w

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Each word's number from 1, or 0 for words that no item has; hashes find the words, their bytes are compared."""
        if not len(self.vocabulary):
            return np.zeros(len(starts), np.int64)
        hashes = word_hashes(data, starts, ends)
        place = np.searchsorted(self.vocabulary, hashes)
        place[place == len(self.vocabulary)] = 0
        like = np.flatnonzero(self.vocabulary[place] == hashes)
        there = place[like]
        same = equal_words(data, starts[like], ends[like], self.text, self.starts[there], self.ends[there])
        out = np.zeros(len(starts), np.int64)
        out[like[same]] = there[same] + 1
        return out


def eligible(windows: Windows, numbers: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Places of the words in stretches of benchmark words, of one document, that are as long as the shortest window."""
    if not len(numbers) or not len(windows.sizes):
        return np.zeros(0, np.int64)
    begin = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | ((numbers[1:] == 0) != (numbers[:-1] == 0))]))
    size = np.diff(np.concatenate([begin, [len(numbers)]]))
    keep = (numbers[begin] > 0) & (size >= windows.sizes.min())
    return np.flatnonzero(np.repeat(keep, size))


def occurrences(windows: Windows, numbers: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows and the indexes of the words where they begin, among eligible words ``numbers`` at places ``at`` of documents ``doc``."""
    if not len(numbers):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)]))
    size = np.diff(np.concatenate([begin, [len(numbers)]]))
    where = np.repeat(begin - np.concatenate([[0], np.cumsum(size + 1)[:-1]]), size + 1) + np.arange(int((size + 1).sum()))
    text = numbers[np.minimum(where, len(numbers) - 1)] + 1
    text[np.cumsum(size + 1) - 1] = 1  # the separator; windows have symbols from 2
    index = FMIndex(text)
    low, high = index.search(windows.patterns + 1, windows.sizes)
    n = high - low
    rows = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return np.repeat(np.arange(len(n)), n), where[index.locate(rows)]


class Held:
    """A slice of a task's rows, and those stretches of benchmark words in it that a window can lie in."""

    def __init__(self, rows: pa.RecordBatch, windows: Windows):
        self.rows = rows
        data, at = text_bytes(rows.column(1))
        data = LOWER[data]
        starts, ends, self.first = find_words(data, at, IS_BREAK)
        numbers = windows.numbers(data, starts, ends)
        doc = np.repeat(np.arange(rows.num_rows), np.diff(self.first))
        self.where = eligible(windows, numbers, doc)
        self.numbers, self.doc = numbers[self.where], doc[self.where]
        self.size = len(data) + 24 * len(self.where) + 8 * len(self.first)


def _hits(windows: Windows, shard: list[Held]) -> list[tuple[list, list]]:
    """For each held slice, by row: removal spans in words of the text, and items."""
    numbers = np.concatenate([h.numbers for h in shard])
    # places are told apart by slice and row, words by their place in the slice
    base = np.cumsum([0] + [h.first[-1] for h in shard])
    rows = np.cumsum([0] + [h.rows.num_rows for h in shard])
    at = np.concatenate([h.where + b for h, b in zip(shard, base, strict=False)])
    doc = np.concatenate([h.doc + r for h, r in zip(shard, rows, strict=False)])
    which, place = occurrences(windows, numbers, doc, at)
    spans: list[list] = [[] for _ in range(rows[-1])]
    found: list[set] = [set() for _ in range(rows[-1])]
    begin = at[place]
    order = np.argsort(begin, kind="stable")
    begin, end, of = begin[order], (begin + windows.sizes[which])[order], doc[place][order]
    if len(begin):
        reach = np.maximum.accumulate(end)
        first = np.concatenate([[True], (begin[1:] > reach[:-1]) | (of[1:] != of[:-1])])  # spans that touch are one
        start = np.flatnonzero(first)
        firsts = np.concatenate([h.first[:-1] + b for h, b in zip(shard, base, strict=False)])
        for d, lo, hi in zip(of[start].tolist(), begin[start].tolist(), np.maximum.reduceat(end, start).tolist(), strict=True):
            spans[d].append((lo - int(firsts[d]), hi - int(firsts[d])))
        pairs = np.unique(doc[place] * len(windows.sizes) + which)
        for d, w in zip((pairs // len(windows.sizes)).tolist(), (pairs % len(windows.sizes)).tolist(), strict=True):
            found[d].update(windows.items[w])
    return [(spans[a:b], [sorted(x) for x in found[a:b]]) for a, b in zip(rows[:-1], rows[1:], strict=True)]


def _rows_found(h: Held, spans: list, items: list) -> pa.RecordBatch:
    """(row, n_words, spans, items)."""
    told = pa.array([[{"begin": a, "end": b} for a, b in x] for x in spans], _SPANS)
    return pa.RecordBatch.from_arrays([h.rows.column(0), pa.array(np.diff(h.first)), told, pa.array(items, pa.list_(pa.string()))], ["row", "n_words", "spans", "items"])


def _rows_stripped(h: Held, spans: list, items: list) -> pa.RecordBatch:
    """(row, text): the text without the spans' words."""
    return pa.RecordBatch.from_arrays([h.rows.column(0), _without(h.rows.column(1), spans)], ["row", "text"])


def _search(windows: Windows, tell):
    """Of (row, text) batches: ``tell(slice, spans, items)``. A slice that no window can lie in is told at once."""

    def run(batches):
        held, words, size = [], 0, 0
        for x in slices(batches, 1):
            h = Held(x, windows)
            if not len(h.where):
                yield tell(h, *_nothing(x.num_rows))
                continue
            held.append(h)
            words, size = words + len(h.where), size + h.size
            if words >= SHARD_WORDS or size >= SHARD_BYTES:
                for h, (spans, items) in zip(held, _hits(windows, held), strict=True):
                    yield tell(h, spans, items)
                held, words, size = [], 0, 0
        if held:
            for h, (spans, items) in zip(held, _hits(windows, held), strict=True):
                yield tell(h, spans, items)

    return trimmed(run)


def _nothing(n: int) -> tuple[list, list]:
    return [[]] * n, [[]] * n


_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
_FOUND = "n_words bigint, spans array<struct<begin: bigint, end: bigint>>, items array<string>"


def _blocks(benchmark: DataFrame, item_col: str, text_col: str):
    """Benchmark items in blocks of about BLOCK_BYTES."""
    block, size = [], 0
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull())
    for r in items.select(F.col(item_col).cast("string"), F.col(text_col), F.octet_length(text_col)).toLocalIterator():
        if block and size + r[2] > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += r[2]
    yield block


def _only_block(benchmark: DataFrame, width: int, item_col: str, item_text_col: str) -> Windows | None:
    """The windows of a benchmark that is one block; else none."""
    blocks = _blocks(benchmark, item_col, item_text_col)
    first = next(blocks)
    return Windows(first, width) if next(blocks, None) is None else None


def _locate(rows: DataFrame, benchmark: DataFrame, width: int, item_col: str, item_text_col: str) -> DataFrame:
    """``rows`` (row, text) with n_words, spans and items instead of the text."""
    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL(_FOUND).fields])
    if (windows := _only_block(benchmark, width, item_col, item_text_col)) is not None:
        return rows.mapInArrow(_search(windows, _rows_found), schema)
    # several passes over the different texts, then all rows look theirs up
    key = F.sha2(F.coalesce("text", F.lit("")), 256)
    texts = rows.groupBy(key.alias("row")).agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.count(F.lit(1)).alias("copies")).checkpoint()
    every = None
    for block in _blocks(benchmark, item_col, item_text_col):
        found = texts.select("row", "text").mapInArrow(_search(Windows(block, width), _rows_found), "row string, " + _FOUND)
        every = found if every is None else every.union(found)
    none = F.array().cast("array<struct<begin: bigint, end: bigint>>")

    def join(spans, s):
        last = F.element_at(spans, -1)
        longer = F.concat(F.slice(spans, 1, F.size(spans) - 1), F.array(F.struct(last["begin"].alias("begin"), F.greatest(last["end"], s["end"]).alias("end"))))
        touching = F.when(F.size(spans) > 0, s["begin"] <= last["end"]).otherwise(F.lit(False))
        return F.when(touching, longer).otherwise(F.concat(spans, F.array(s)))

    merged = every.groupBy("row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = merged.withColumn("spans", F.aggregate("spans", none, join)).join(texts.select("row", "copies"), "row").withColumnRenamed("row", "_key")
    out = lookup(rows.select("row", key.alias("_key")), merged, ["_key"], "copies", rows.count(), "_key")
    return out.select("row", "n_words", "spans", "items")


def removal_spans(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, spans [begin, end) of hit words, items.

    Words are maximal stretches of digits, letters a to z (A to Z lower-cased)
    and characters beyond ASCII. Null has no words, and neither has empty text.
    Items of fewer words than ``width`` are one window; items without words, or
    with a null id, match nothing. ``items`` are different item ids as strings,
    in order. A benchmark above BLOCK_BYTES is searched in several passes over
    the different texts. Repeated rows stay repeated; other columns are not
    read; empty tables give no rows or no hits.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.struct(F.col(id_col).cast("bigint").alias("doc_id")).alias("row"), F.col(text_col).alias("text"))
    return _locate(rows, benchmark, width, item_col, item_text_col).select("row.doc_id", "n_words", "spans", "items")


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs``, all its columns, without the words of the removal spans; a null text stays null."""
    prepare(docs.sparkSession)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType())])
    if (windows := _only_block(benchmark, width, item_col, item_text_col)) is not None:
        out = rows.mapInArrow(_search(windows, _rows_stripped), schema)
    else:
        found = _locate(rows, benchmark, width, item_col, item_text_col).select("row", F.col("row")[text_col].alias("text"), "spans")
        out = found.mapInArrow(_strip, schema)
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, **columns) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated. Rows as in :func:`removal_spans`."""
    found = removal_spans(docs, benchmark, width, **columns)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["begin"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def _strip(batches):
    for x in slices(batches, 1):
        spans = [[(p["begin"], p["end"]) for p in y] for y in x.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([x.column(0), _without(x.column(1), spans)], ["row", "text"])


def _without(texts: pa.Array, spans: list) -> pa.Array:
    """``texts`` without the words of their spans."""
    hit = [k for k, s in enumerate(spans) if s]
    if not hit:
        return texts
    new = texts.to_pylist()
    for k in hit:
        new[k] = removed(new[k], spans[k])
    return pa.array(new, texts.type)


def removed(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and what stands between them."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    starts, ends, _ = find_words(LOWER[data], np.array([0, len(data)]), IS_BREAK)
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*out, raw[at:]]).decode()

