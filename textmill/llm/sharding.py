"""Sharding by best-fit-decreasing bin packing (operator 9).

Documents with equal texts are one indivisible group. Groups of equal weight
are alike to the packing, so the driver packs *counts by weight*: there are at
most sqrt(2 x all bytes) different weights, far fewer in practice, and a count
stands for any number of groups. The plan says, for each weight, how many of
its groups go where; executors number the groups of a weight and follow it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets, identity, lookup, numbered, prepare


class GapTree:
    """A balanced search tree (treap) of (gap, bin), to find the tightest gap that holds a size."""

    def __init__(self):
        self.root, self._seed = None, 1

    def _priority(self) -> int:
        self._seed = (self._seed * 6364136223846793005 + 1442695040888963407) & (1 << 64) - 1
        return self._seed >> 20

    def add(self, key) -> None:
        low, high = self._split(self.root, key)
        self.root = self._merge(self._merge(low, [key, self._priority(), None, None]), high)

    def remove(self, key) -> None:
        low, rest = self._split(self.root, key)
        _, high = self._split(rest, (key[0], key[1] + 1))
        self.root = self._merge(low, high)

    def tightest(self, size: int):
        """The least (gap, bin) with gap >= size, or None."""
        node, best = self.root, None
        while node:
            if node[0][0] >= size:
                best, node = node[0], node[2]
            else:
                node = node[3]
        return best

    def _split(self, node, key):
        """The keys under ``key``, and the others."""
        if not node:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            return [node[0], node[1], node[2], low], high
        low, high = self._split(node[2], key)
        return low, [node[0], node[1], high, node[3]]

    def _merge(self, low, high):
        if not low or not high:
            return low or high
        if low[1] > high[1]:
            return [low[0], low[1], low[2], self._merge(low[3], high)]
        return [high[0], high[1], self._merge(low, high[2]), high[3]]


def best_fit_decreasing(counts: list[tuple[int, int]], capacity: int, most: int | None = None):
    """Pack ``counts`` (weight, how many) into bins of ``capacity``: a list of (weight, bin, how many), or None.

    Heaviest first, each item goes to the bin with the least gap that holds it
    and opens a bin where none does. Equal items keep going to one bin until it
    is full for them, so they are placed in one step. None: more than ``most``
    bins would be needed, or an item exceeds the capacity.
    """
    gaps, plan, opened = GapTree(), [], 0
    for weight, left in sorted(counts, reverse=True):
        if weight > capacity:
            return None
        while left:
            found = gaps.tightest(weight)
            if found is None:
                if most is not None and opened == most:
                    return None
                found = (capacity, opened)
                opened += 1
            else:
                gaps.remove(found)
            gap, k = found
            n = min(left, gap // weight) if weight else left
            plan.append((weight, k, n))
            left -= n
            gaps.add((gap - n * weight, k))
    return plan


def pack_evenly(counts: list[tuple[int, int]], n_shards: int):
    """(weight, shard, how many): the smallest capacity at which best-fit-decreasing needs ``n_shards`` shards.

    A group above the fair share gets a shard of its own first; nothing can
    make that shard smaller, and it must not loosen the capacity of the others.
    """
    counts, plan, used = sorted(([w, n] for w, n in counts if n), reverse=True), [], 0
    total = sum(w * n for w, n in counts)
    while counts and used < n_shards - 1 and counts[0][0] * (n_shards - used) > total:
        weight = counts[0][0]
        plan.append((weight, used, 1))
        used, total = used + 1, total - weight
        counts[0][1] -= 1
        if not counts[0][1]:
            counts.pop(0)
    if not counts:
        return plan
    rest = [(w, n) for w, n in counts]
    low = max(rest[0][0], -(-total // (n_shards - used)))
    high = low
    while (found := best_fit_decreasing(rest, high, n_shards - used)) is None:
        low, high = high + 1, high + max(1, high // 64)
    while low < high:
        mid = (low + high) // 2
        tried = best_fit_decreasing(rest, mid, n_shards - used)
        if tried is None:
            low = mid + 1
        else:
            found, high = tried, mid
    return plan + [(w, used + k, n) for w, k, n in found]


def shards(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes plus 1; null text has no bytes and the
    same group as empty text. All copies of a text share a shard. The law is
    ``bytes``, so ``grown_shard`` is null. ``slot`` counts from 0 in a shard, by
    a hash of doc_id and then doc_id; rows with equal doc_ids in any order. More
    shards than groups leave shards empty; an empty table gives no rows. Other
    columns of ``docs`` are not read.
    """
    spark = prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), *identity(text))
    key = ["_sha", "_xx", "_len"]
    total = docs.count()
    groups = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"), F.sum("size").alias("weight")).checkpoint()
    counts = [(r["weight"], r["n"]) for r in groups.groupBy("weight").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()]
    plan, at = [], {}
    for weight, shard, n in pack_evenly(counts, n_shards):
        plan.append((weight, at.get(weight, 0), at.get(weight, 0) + n, shard))
        at[weight] = at.get(weight, 0) + n
    plan = spark.createDataFrame(plan, "_weight long, _from long, _to long, shard int")
    ranked = numbered(groups, ["weight"], key, buckets(total, 1_000_000), "_rank", "_sha")
    placed = ranked.join(plan, (F.col("weight") == F.col("_weight")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))).select(*key, "copies", "shard")
    found = lookup(rows, placed, key, "copies", total, "doc_id")
    out = numbered(found, ["shard"], ["doc_id", "text_crc32"], buckets(total, 100_000), "slot", "doc_id")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
