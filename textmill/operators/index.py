"""The inverted index as DataFrames: documents, postings, dictionary and statistics."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import analyze, lengths, slices
from ..functions.wanted import Wanted
from .rank import FIELD_NAMES, Stats

DOC_COLUMNS = ("path", "title", "body", "ext", "size", "mtime")
POSTINGS = "field tinyint, term string, path string, tf int, positions array<int>, len int"
LENGTHS = tuple(f"len_{f}" for f in FIELD_NAMES)


def _lengths(batches):
    for x in slices(batches, list(FIELD_NAMES)):
        counts = [pa.array(lengths(x.column(f)), pa.int32()) for f in FIELD_NAMES]
        yield pa.RecordBatch.from_arrays([*x.columns, *counts], [*x.schema.names, *LENGTHS])


def with_lengths(docs: DataFrame) -> DataFrame:
    """``docs`` with the number of tokens, subwords included, of each field; counted where the documents are."""
    docs = docs.drop(*LENGTHS)
    return docs.mapInArrow(_lengths, T.StructType([*docs.schema.fields, *(T.StructField(c, T.IntegerType()) for c in LENGTHS)]))


def _invert(batches, wanted: Wanted | None = None):
    """(path, title, body) to postings. A document is whole in a row, so its terms are grouped right here, in numpy."""
    for x in slices(batches, list(FIELD_NAMES)):
        for field, name in enumerate(FIELD_NAMES):
            if wanted is not None and field not in wanted.fields:
                continue
            tokens = analyze(x.column(name))
            row, code, pos, sizes = tokens.row, tokens.code, tokens.pos, tokens.lengths
            if wanted is not None:
                use = wanted.mask(tokens.terms)[code]
                row, code, pos = row[use], code[use], pos[use]
            order = np.argsort(row * max(len(tokens.terms), 1) + code, kind="stable")  # positions stay in order
            row, code, pos = row[order], code[order], pos[order]
            first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])])) if len(row) else np.zeros(0, np.int64)
            ends = np.append(first, len(row))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(first), field), pa.int8()), tokens.terms.take(pa.array(code[first])), x.column("path").take(pa.array(row[first])), pa.array(np.diff(ends), pa.int32()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pos, pa.int32())), pa.array(sizes[row[first]], pa.int32()),
                ],
                ["field", "term", "path", "tf", "positions", "len"],
            )


def postings_of(docs: DataFrame, wanted: Wanted | None = None) -> DataFrame:
    """(field, term, path, tf, positions, len): one row for each term of each field of each document.

    Tokens are made and grouped by document in the Arrow batch that holds it:
    no shuffle, and no row for each token. :mod:`..functions.analyzer` has the
    same analysis as column expressions. Given ``wanted``, other terms don't
    leave the batch; a few that are near to those that are wanted may.
    """
    return docs.select(*FIELD_NAMES).mapInArrow(partial(_invert, wanted=wanted), POSTINGS)


def dictionary_of(postings: DataFrame) -> DataFrame:
    """(field, term, df, total_tf)."""
    return postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total_tf"))


def _sums(batches):
    for x in slices(batches, list(FIELD_NAMES)):
        counts = [lengths(x.column(f)) for f in FIELD_NAMES]
        each = [len(counts[0]), *[int((n > 0).sum()) for n in counts], *[int(n.sum()) for n in counts]]
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()) for n in each], list(_SUMS))


_SUMS = ("n", *(f"docs_{f}" for f in FIELD_NAMES), *(f"total_{f}" for f in FIELD_NAMES))


def stats_of_texts(docs: DataFrame) -> Stats:
    """As :func:`stats_of`, of documents without lengths: only sums leave the batches."""
    row = docs.select(*FIELD_NAMES).mapInArrow(_sums, ", ".join(f"{c} bigint" for c in _SUMS)).agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in _SUMS]).first()
    return Stats(row[0], tuple(row[1:4]), tuple(row[4:7]))


def stats_of(docs: DataFrame) -> Stats:
    row = docs.agg(F.count(F.lit(1)), *[F.count(F.when(F.col(c) > 0, 1)) for c in LENGTHS], *[F.coalesce(F.sum(c), F.lit(0)) for c in LENGTHS]).first()
    return Stats(row[0], tuple(row[1:4]), tuple(row[4:7]))


@dataclass(frozen=True)
class Index:
    """``docs`` has the document columns, their lengths and ``live``; deleted documents count in the statistics only."""

    docs: DataFrame
    postings: DataFrame
    dictionary: DataFrame
    has_deletes: bool = False
    #: The documents, if all else is computed of them where it is read; then only what is wanted is computed.
    texts: DataFrame | None = None

    @classmethod
    def of(cls, docs: DataFrame) -> Index:
        """An index of ``docs`` (path, title, body, ext, size, mtime; live if there is one), computed where it is read."""
        has_live = "live" in docs.columns
        docs = docs if has_live else docs.withColumn("live", F.lit(True))
        postings = postings_of(docs)
        return cls(with_lengths(docs), postings, dictionary_of(postings), has_live, docs)

    @cached_property
    def stats(self) -> Stats:
        return stats_of(self.docs) if self.texts is None else stats_of_texts(self.texts)

    def find(self, wanted: Wanted) -> DataFrame:
        """The postings that are wanted."""
        return (self.postings if self.texts is None else postings_of(self.texts, wanted)).where(wanted.column())

    def entries(self, wanted: Wanted) -> DataFrame:
        """The dictionary's entries that are wanted."""
        return self.dictionary.where(wanted.column()) if self.texts is None else dictionary_of(self.find(wanted))

    @property
    def live(self) -> DataFrame:
        """The documents that can be found; without lengths, if these were yet to be computed."""
        docs = self.docs if self.texts is None else self.texts
        return docs.where("live") if self.has_deletes else docs

    def within(self, paths: DataFrame) -> Index:
        """The part of a few documents, with the statistics of all; documents are left out before they are analysed."""
        few = F.broadcast(paths.select("path"))
        parts = {k: getattr(self, k).join(few, "path", "left_semi") for k in ("docs", "postings", "texts") if getattr(self, k) is not None}
        out = replace(self, **parts)
        out.__dict__["stats"] = self.stats
        return out

    def cache(self) -> Index:
        return replace(self, docs=self.docs.persist(), postings=self.postings.persist(), dictionary=self.dictionary.persist(), texts=None)

    def summary(self) -> DataFrame:
        """One row: docs, deleted, terms, postings, tokens and mean length of each field."""
        s = self.stats
        terms = self.dictionary.agg(F.count(F.lit(1)).alias("terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings"))
        docs = (self.docs if self.texts is None else self.texts).agg(F.count(F.when(F.col("live"), 1)).alias("docs"), F.count(F.when(~F.col("live"), 1)).alias("deleted"))
        extra = [x for k, f in enumerate(FIELD_NAMES) for x in (F.lit(s.total_len[k]).cast("bigint").alias(f"tokens_{f}"), F.lit(float(s.average(k))).alias(f"avg_len_{f}"))]
        return docs.crossJoin(terms).select("docs", "deleted", "terms", "postings", *extra)  # one row each
