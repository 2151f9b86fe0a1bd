"""Exact deduplication by skew-safe combining (operator 5).

1. *Locally*: every task folds its equal texts into one row before anything moves.
2. *Salted*: what the tasks kept meets in ``SALTS`` groups a text, by the task's number.
3. *Globally*: the at most ``SALTS`` winners of a text meet.

The whole normalised text is a grouping key of every stage, so texts are
compared in full each time; digests alone decide nothing. A text with a third
of all rows costs each task one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import identity, lookup, prepare

#: Groups in which the copies of one text meet before the last merge.
SALTS = 16
#: White space that counts: space and the ASCII controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def combine(texts: DataFrame) -> DataFrame:
    """(doc_id, norm) to one row for each different text: its names, keep_id, group_size."""
    names = ["_sha", "_xx", "_len"]
    rows = texts.select("doc_id", "norm", *identity(F.col("norm")), (F.spark_partition_id() % SALTS).alias("_salt"))
    local = rows.groupBy(*names, "norm", "_salt").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    texts = local.groupBy(*names, "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    one = texts.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    clash = F.raise_error(F.lit("two texts share SHA-256, XXH64 and length")).cast("bigint")
    return one.select(*names, F.when(F.col("n") > 1, clash).otherwise(F.col("keep_id")).alias("keep_id"), "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Of equal texts the row with the smallest doc_id
    is kept; rows that repeat that doc_id and text are the same document and
    are kept alike. A null doc_id comes after all others. Other columns of
    ``docs``, whatever their names, are not read. An empty table gives none.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    groups = combine(texts).checkpoint()
    rows = texts.select("doc_id", *identity(F.col("norm")))
    out = lookup(rows, groups, ["_sha", "_xx", "_len"], "group_size", docs.count(), "doc_id")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("_sha").alias("text_sha256"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col("_kept_id")), "left_semi")
