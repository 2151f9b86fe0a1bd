"""Which terms' postings a query wants: as a column expression, and for Arrow batches that make postings."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_FUZZY_WEIGHT = 0.05


def byte_string(text: Column) -> Column:
    """The text's UTF-8 bytes as a string of as many characters, so that edits are counted in bytes."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


@dataclass(frozen=True)
class Expansion:
    """The terms that begin with ``text`` (prefix), are a pair with it (pair), or are at most ``most`` edits from it (near)."""

    kind: str
    text: str
    most: int = 0

    def _distance(self) -> Column:
        return F.levenshtein(byte_string(F.col("term")), byte_string(F.lit(self.text)), self.most)

    def condition(self) -> Column:
        if self.kind == "pair":
            return (F.length("term") == 2) & F.col("term").contains(self.text)
        if self.kind == "prefix":
            return F.col("term").startswith(self.text)
        size = len(self.text.encode())
        return F.octet_length("term").between(size - self.most, size + self.most) & (self._distance() >= 0)

    def weight(self) -> Column:
        if self.kind != "near":
            return F.lit(1.0)
        return F.greatest(F.lit(LEAST_FUZZY_WEIGHT), 1.0 - self._distance() / float(len(self.text.encode())))

    def mask(self, terms: pa.Array) -> pa.Array:
        """True for all terms that meet the condition; for some others too, if edits would have to be counted."""
        if self.kind == "pair":
            return pc.match_substring(terms, self.text)
        if self.kind == "prefix":
            return pc.starts_with(terms, self.text)
        size, found = len(self.text.encode()), pc.binary_length(terms)
        return pc.and_(pc.greater_equal(found, size - self.most), pc.less_equal(found, size + self.most))


@dataclass(frozen=True)
class Wanted:
    """Postings in ``fields`` of ``terms`` and of those that an expansion stands for."""

    fields: tuple[int, ...]
    terms: tuple[str, ...] = ()
    expansions: tuple[Expansion, ...] = ()

    def column(self) -> Column:
        tests = [F.col("term").isin(sorted(self.terms))] if self.terms or not self.expansions else []
        return F.col("field").isin(sorted(self.fields)) & reduce(or_, [*tests, *(x.condition() for x in self.expansions)])

    def mask(self, terms: pa.Array) -> np.ndarray:
        masks = [pc.is_in(terms, value_set=pa.array(self.terms, pa.string())), *(x.mask(terms) for x in self.expansions)]
        return reduce(pc.or_, masks).to_numpy(zero_copy_only=False).astype(bool)
