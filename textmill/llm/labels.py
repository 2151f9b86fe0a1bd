"""Labelled documents, by which the two classifiers are fitted: all of them, or a bounded sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, trimmed
from .words import U, mix

#: Bits of the set of ids that texts are looked up in before they are shuffled.
ID_BITS = 24


def remainder(doc_id, mod: int):
    """crc32 of a document's id as text, modulo ``mod``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(mod))


def _labelled(labels: DataFrame, label_col: str, learn) -> DataFrame:
    """(doc_id, label) that may be learned from; ids whose labels disagree or are null are left out."""
    label = F.col(label_col).cast("int")
    ids = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), label.alias("label")).where(learn & F.col("label").isNotNull())
    return ids.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_top")).where(F.col("label") == F.col("_top")).drop("_top")


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str, learn, per_class: dict[int, int], id_col: str = "doc_id", text_col: str = "text") -> pa.Table:
    """(doc_id, text, label) of at most ``per_class[label]`` labelled documents each, on the driver.

    ``learn`` is a condition on doc_id that says which rows may be learned from.
    The documents are those with the least hashes of doc_id, so the sample is
    the same however the tables are split. Ids whose labels disagree or are
    null are left out, and repeated rows of a document count once.
    """
    one = _labelled(labels, label_col, learn)
    parts = [one.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in per_class.items()]
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.union(p)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    # sum(per_class) ids at most: small enough to broadcast by their own bound
    found = texts.join(F.broadcast(chosen.select("doc_id", "label")), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return found.select("doc_id", "text", "label").toArrow().sort_by("doc_id")


def _bit(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.view(U)) >> U(64 - ID_BITS)).astype(np.int64)


def _among(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose doc_id may be one of ``ids``: a set of fixed size leaves out most others before a join shuffles the texts."""

    def run(batches):
        held = np.zeros(1 << ID_BITS, bool)
        for x in batches:
            held[_bit(x.column(0).to_numpy())] = True
        held = np.packbits(held, bitorder="little").view(np.int64)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at])], ["at", "bits"])

    found = ids.select("doc_id").mapInArrow(trimmed(run), "at int, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    held = np.zeros(1 << ID_BITS - 6, np.int64)
    held[found["at"].to_numpy()] = found["bits"].to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(held.view(np.uint8))

    def keep(batches):
        for x in batches:
            at = _bit(x.column(0).to_numpy())
            yield x.filter(pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))

    return texts.mapInArrow(keep, texts.schema)


def thirds(docs: DataFrame, labels: DataFrame, label_col: str, learn, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, label, text) of all labelled documents of classes 0 and 1 that may be learned from: two thirds of each class, and the last.

    Of a class's documents in the order of doc_id every third is among the last;
    so the parts are the same however the tables are split. Ids whose labels
    disagree or are null are left out, and repeated rows of a document count once.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull() & learn)
    one = _labelled(labels, label_col, learn).where(F.col("label").isin(0, 1)).join(texts.select("doc_id").distinct(), "doc_id")
    # numbered by ranges of doc_id, of which only the counts are gathered
    ranged = one.repartitionByRange("doc_id").withColumn("_part", F.spark_partition_id()).checkpoint()
    before = Window.partitionBy("label").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("label", "_part").agg(F.count(F.lit(1)).alias("_n")).select("label", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = ranged.withColumn("_row", F.row_number().over(Window.partitionBy("label", "_part").orderBy("doc_id")) - 1)
    numbered = inner.join(F.broadcast(sums), ["label", "_part"]).select("doc_id", "label", ((F.col("_row") + F.col("_before")) % 3 < 2).alias("counted"))
    numbered = saved(numbered, ranged.count())
    parts = []
    for counted in (True, False):
        ids = numbered.where(F.col("counted") == counted).select("doc_id", "label")
        parts.append(_among(texts, ids).join(ids, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")))
    return parts[0], parts[1]
