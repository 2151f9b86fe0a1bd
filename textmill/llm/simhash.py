"""SimHash near-deduplication by anchor-point covering (operator 6).

Fingerprints of 64 bits link at 3 or fewer differing bits, so of two linked
fingerprints' 32-bit halves one half differs in at most 1 bit. The anchors of a
half are a covering code: the product of four Hamming [7,4] codes (covering
radius 1 each, perfect) and 4 free bits, 2^20 code words. Every fingerprint has
one home anchor a half, and is replicated to all anchors within the covering
radius plus the threshold of 1: the home, and, where one block is moved, the
anchors within 2 of that block. A linked pair therefore meets at the home of
either; comparing per anchor loses no link. Replication is 31 rows or fewer a
*different* fingerprint; copies were folded before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import buckets, lookup, prepare, saved, slices, trimmed
from .components import connected, label
from .words import IS_SPACE, LOWER, U, find_words, joined, text_bytes, xxh64

SHINGLE, THRESHOLD = 3, 3
#: Pairs of one anchor, or of a task, that are compared at once.
SMALL_RUN, CHUNK = 1 << 14, 1 << 21

#: Shingles that are hashed at once.
HASHED = 1 << 16

#: For each byte a number whose 8 bytes are its 8 bits: sums of up to 255 of them count the bits.
_SPREAD = np.array([sum(((b >> j) & 1) << 8 * j for j in range(8)) for b in range(256)], U)


def fingerprints(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The fingerprint of each text of a batch."""
    starts, ends, first = find_words(data := LOWER[data], at, IS_SPACE)
    words = np.diff(first)
    text, s, e = joined(data, starts, ends)
    n = np.where(words >= SHINGLE, words - SHINGLE + 1, np.minimum(words, 1))
    base = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    begin = np.arange(int(n.sum())) + base
    stop = np.minimum(begin + SHINGLE, np.repeat(first[1:], n)) - 1
    h = np.empty(len(begin), U)
    for k in range(0, len(h), HASHED):
        h[k : k + HASHED] = xxh64(text, s[begin[k : k + HASHED]], e[stop[k : k + HASHED]])
    out = np.zeros(len(words), U)
    if not len(h):
        return out
    full = np.flatnonzero(n)
    cuts = np.concatenate([np.arange(0, k, 255) + o for k, o in zip(n[full], np.concatenate([[0], np.cumsum(n)[:-1]])[full], strict=True)])
    per = -(-n[full] // 255)
    octets = h.view(np.uint8).reshape(-1, 8)
    ones = np.stack([np.add.reduceat(_SPREAD[octets[:, k]], cuts) for k in range(8)], 1)
    ones = np.add.reduceat(ones.view(np.uint8).reshape(len(cuts), 64).astype(np.int64), np.concatenate([[0], np.cumsum(per)[:-1]]), axis=0)
    bits = np.packbits(2 * ones > n[full][:, None], axis=1, bitorder="little")
    out[full] = np.ascontiguousarray(bits).view(U)[:, 0]
    return out


@trimmed
def _fingerprint(batches):
    for x in slices(batches, 1):
        yield pa.RecordBatch.from_arrays([x.column(0), pa.array(fingerprints(*text_bytes(x.column(1))).view(np.int64))], ["doc_id", "fp"])


@trimmed
def _fingerprint_rows(batches):
    for x in slices(batches, 1):
        yield pa.RecordBatch.from_arrays([*x.columns, pa.array(fingerprints(*text_bytes(x.column(1))).view(np.int64))], [*x.schema.names, "fp"])


def _hamming() -> tuple[np.ndarray, np.ndarray]:
    """For each 7-bit block: the nearest code word of the [7,4] code, and those at distance 2 that one changed bit can reach."""
    syndrome = np.zeros(128, int)
    for v in range(128):
        for i in range(7):
            if v >> i & 1:
                syndrome[v] ^= i + 1
    nearest = np.array([v ^ (1 << syndrome[v] - 1 if syndrome[v] else 0) for v in range(128)])
    moved = [sorted({int(nearest[v ^ (1 << i)]) for i in range(7)} - {int(nearest[v])}) for v in range(128)]
    return nearest.astype(U), np.array([m + [-1] * (3 - len(m)) for m in moved])


_NEAREST, _MOVED = _hamming()


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (anchor, fingerprint, is it the home) of the given fingerprints, for both halves."""
    found = []
    for half in range(2):
        v = (fp >> U(32 * half)) & U(0xFFFFFFFF)
        block = [((v >> U(7 * k)) & U(127)).astype(int) for k in range(4)]
        near = [_NEAREST[b] for b in block]
        home = (v >> U(28) << U(28)) | (U(half) << U(32))
        for k in range(4):
            home = home | (near[k] << U(7 * k))
        found.append((home, fp, np.ones(len(fp), bool)))
        for k in range(4):
            for j in range(3):
                other = _MOVED[block[k], j]
                ok = other >= 0
                moved = home[ok] ^ ((near[k][ok] ^ other[ok].astype(U)) << U(7 * k))
                found.append((moved, fp[ok], np.zeros(ok.sum(), bool)))
            found.append((home ^ (U(1) << U(28 + k)), fp, np.zeros(len(fp), bool)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _replicate(batches):
    for x in batches:
        a, fp, home = anchors(x.column(0).to_numpy().view(U))
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(home)], ["anchor", "fp", "home"])


def _grow(fp: np.ndarray) -> tuple[list, list]:
    """Links that span the components of many fingerprints at one anchor: each is linked once, when it is first reached."""
    left, a, b = np.unique(fp), [], []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            near = np.bitwise_count(left ^ (x := todo.pop())) <= THRESHOLD
            if near.any():
                b.append(got := left[near])
                a.append(np.full(len(got), x, U))
                todo.extend(got)
                left = left[~near]
    return a, b


def links_at(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) found at the given anchors, thinned to one for each fingerprint but the least of what they connect."""
    order = np.lexsort((fp, anchor))
    anchor, fp, home = anchor[order], fp[order], home[order]
    edge = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    size = np.diff(np.concatenate([edge, [len(anchor)]]))
    homes = np.add.reduceat(home.astype(np.int64), edge)
    big = homes * size > SMALL_RUN
    a, b = [], []
    for k in np.flatnonzero(big):
        x, y = _grow(fp[edge[k] : edge[k] + size[k]])
        a, b = a + x, b + y
    run = np.repeat(np.arange(len(edge)), size)
    rows = np.flatnonzero(home & ~big[run] & (size[run] > 1))
    pairs = np.cumsum(size[run[rows]])
    done = 0
    while done < len(rows):
        upto = max(done + 1, int(np.searchsorted(pairs, (pairs[done - 1] if done else 0) + CHUNK)))
        mine = rows[done:upto]
        n = size[run[mine]]
        left = np.repeat(mine, n)
        right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(edge[run[mine]], n)
        x, y = fp[left], fp[right]
        ok = (np.bitwise_count(x ^ y) <= THRESHOLD) & (x != y)
        a.append(x[ok])
        b.append(y[ok])
        done = upto
    if not a or not sum(map(len, a)):
        return np.zeros(0, U), np.zeros(0, U)
    nodes, roots = label(np.concatenate(a), np.concatenate(b))
    return nodes[nodes != roots], roots[nodes != roots]


def _compare(group: pa.Table) -> pa.Table:
    numbers = [group.column(k).to_numpy() for k in ("anchor", "fp", "home")]
    a, b = links_at(numbers[0].view(U), numbers[1].view(U), numbers[2].astype(bool))
    return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})


def _components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id, and root, a fingerprint that tells components with one component_id apart."""
    prepare(docs.sparkSession)
    total = docs.count()
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    prints = texts.mapInArrow(_fingerprint, "doc_id bigint, fp bigint").checkpoint()
    different = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")), total)
    n = different.count()
    spread = different.select("fp").mapInArrow(_replicate, "anchor bigint, fp bigint, home boolean")
    dealt = spread.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets(32 * n, 1_000_000))))
    links = dealt.groupBy("bucket").applyInArrow(_compare, "a bigint, b bigint")
    roots = connected(links, n)
    classes = saved(different.join(roots.toDF("fp", "_root"), "fp", "left").select("fp", "first", "rows", F.coalesce("_root", "fp").alias("root")), n)
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("prints"))
    known = lookup(classes, least, ["root"], "prints", n, "fp").select("fp", "rows", "component_id", "root")
    return lookup(prints, known, ["fp"], "rows", total, "doc_id")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Texts without words, empty or null, have fingerprint zero and link like any
    other; texts of one or two words are one shingle. ``component_id`` is the
    smallest doc_id reachable over links. Repeated rows stay repeated; other
    columns are not read; an empty table gives no rows.
    """
    return _components(docs, id_col, text_col).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, that stay: of each group one with the smallest doc_id. Rows without doc_id stay.

    Where rows repeat that doc_id, one of the least text (and the least of all
    columns, as JSON) among those in the group stays.
    """
    is_least = F.col("doc_id") == F.col("component_id")
    found = _components(docs, id_col, text_col).where(F.col("doc_id").isNotNull())
    ids = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max(is_least).alias("least"))
    kept = saved(ids.where("least").select(F.col("doc_id").alias("_kept"), "rows"), docs.count())
    once, again = kept.where("rows = 1"), kept.where("rows > 1")
    there = docs.join(once, F.col(id_col) == F.col("_kept"), "left_semi").unionByName(docs.where(F.col(id_col).isNull()))
    if again.isEmpty():
        return there
    texts = docs.join(again, F.col(id_col) == F.col("_kept"), "left_semi")
    several = texts.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.struct(*docs.columns).alias("row"))
    prints = several.mapInArrow(_fingerprint_rows, StructType([*several.schema.fields, StructField("fp", LongType())]))
    ordered = prints.select("doc_id", "fp", "row", F.struct("text", F.to_json("row")).alias("order"))
    # combined before they meet their groups, so an id that repeats often is no hot key
    first = ordered.groupBy("doc_id", "fp").agg(F.min_by("row", "order").alias("row"), F.min("order").alias("order"))
    groups = found.where(is_least).select("doc_id", "fp", "root").distinct()
    one = first.join(groups, ["doc_id", "fp"]).groupBy("root").agg(F.min_by("row", "order").alias("row"))
    return there.unionByName(one.select(*[F.col("row")[c].alias(c) for c in docs.columns]))
