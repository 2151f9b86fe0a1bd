"""Toxicity by class-conditional Kneser-Ney models (operator 8).

A model of toxic and one of ordinary documents are learned from all labelled
documents that may be learned from, each of words and of pairs of words. What is
counted is Kneser-Ney's number of different contexts that an expression occurs
in, a context being a document; so neither repetition in a text nor copies of a
text count. A count loses the discount of modified Kneser-Ney, which the counts
of counts give, and what is taken away goes to the backoff: a pair's to its
last word in the same class, a word's to one distribution that both classes
share, in how many documents of the whole corpus each word occurs.

A text is compared by the differences of the two classes' log-likelihoods, word
by word, of either order. A toxic text is toxic in few of its words, and topic
and language move all others a little; so what a difference exceeds a margin by
is summed, and the sum is divided by the root of the text's length, by which
sums of chance differences grow. The margin and a logistic function of both
orders' values are fitted on the third of the labelled documents that is not
counted.

All counts grow with the corpus and stay distributed tables. Tasks hold three
arrays of a fixed size, which bound every difference from above: only words
whose bound exceeds the margin, which alone can add to a sum, are sent to the
tables to be looked up. Bounds that are too high cost a look-up and change no
result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Dealt, forget, freeing, in_parts, lookup, packed, prepare, saved, slices, trimmed
from .labels import remainder, thirds, training_sample  # noqa: F401 (a bounded sample is what tests compare with)
from .words import IS_BREAK, LOWER, U, find_words, mix, text_bytes, word_hashes

#: Bound of a sample (training_sample) to compare with, toxic and ordinary; the models are learned from all labelled documents.
PER_CLASS = {1: 2000, 0: 4000}
THRESHOLD = 0.7
#: Margins, in units of log-likelihood, of which the labels choose one.
MARGINS = tuple(k / 2 for k in range(11))
#: Where counts of counts give no discount between 0 and the count: the share of the count.
USUAL = 0.75
#: Different words that a task combines before it sends their counts (16 bytes each).
COMBINED = 1 << 20
#: Slots of each array of bounds, as a power of two; a slot's byte says the highest level in it.
SLOT_BITS = 23
#: Pairs are looked up in rounds, of about ROUND_PAIRS each but ROUNDS at most, so that only a round's shuffles are on disk at a time.
ROUNDS, ROUND_PAIRS = 4, 1 << 20
#: Tables of pairs and contexts are dealt by context into a part for each of ROUNDS, so that a round reads its own parts alone; words, or documents, are another part.
PARTS, OTHERS = range(ROUNDS), ROUNDS
_CONTEXTS = "c bigint, sum_t bigint, rest_t double, sum_o bigint, rest_o double"
_COUNTS = "c bigint, w bigint, toxic bigint, ordinary bigint"
_START = U(0x9E3779B97F4A7C15)
#: The bounds that levels mean; differences above the last have the highest, below the first the lowest.
_LEVELS = np.append(-8 + np.arange(255) / 8, np.inf)


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the texts' words (A-Z lower-cased), of the words before them, and each text's first word (and the number of words)."""
    data = LOWER[data]
    starts, ends, first = find_words(data, at, IS_BREAK)
    h = word_hashes(data, starts, ends)
    before = np.concatenate([[_START], h[:-1]]) if len(h) else h
    before[first[:-1][np.diff(first) > 0]] = _START
    return h, before, first


def pair(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(before * U(0xD1342543DE82EF95) + h)


def discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney's discounts of counts 1, 2, and 3 or more, between 0 and the count, from the counts of counts."""
    return _discounts([(counts == k).sum() for k in range(1, 5)])


def _discounts(times) -> np.ndarray:
    """The same, of how many counts are 1, 2, 3 and 4."""
    n = [0, *times]
    out = USUAL * np.arange(1.0, 4.0)
    if n[1] and n[2]:
        y = n[1] / (n[1] + 2 * n[2])
        for k in (1, 2, 3):
            found = k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0
            if 0 < found < k:
                out[k - 1] = found
    return out


# counts of the classes

def _in_documents(keys: np.ndarray, doc: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys, where each is first, and in how many toxic and ordinary documents each occurs."""
    found, one, at = np.unique(keys, return_index=True, return_inverse=True)
    key, doc = np.divmod(np.unique(at.astype(np.int64) * max(len(y), 1) + doc), max(len(y), 1))
    return found, one, np.stack([np.bincount(key[y[doc] == k], minlength=len(found)) for k in (1, 0)], 1)


def _combined(parts: list) -> list:
    """Counts of equal expressions added; an expression is (is it a word, context, last word)."""
    kind, context, last, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((last, context, kind))
    kind, context, last, n = kind[order], context[order], last[order], n[order]
    new = np.ones(len(kind), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (context[1:] != context[:-1]) | (last[1:] != last[:-1])
    at = np.flatnonzero(new)
    return [(kind[at], context[at], last[at], np.add.reduceat(n, at) if len(at) else n)]


@trimmed
def _class_counts(batches):
    """Of (label, text): in how many documents of either class words (c null) and pairs (c, w) occur; combined while a task has at most COMBINED."""
    held, size = [], 0
    for x in slices(batches, 1):
        y = x.column(0).to_numpy()
        h, before, first = words_of(*text_bytes(x.column(1)))
        doc = np.repeat(np.arange(len(y)), np.diff(first))
        for kind, keys in ((True, h), (False, pair(before, h))):
            _, one, n = _in_documents(keys, doc, y)
            held.append((np.full(len(one), kind), np.zeros(len(one), U) if kind else before[one], h[one], n))
            size += len(one)
        if size > 2 * COMBINED:
            held = _combined(held)
            size = len(held[0][0])
            if size > COMBINED:
                yield _expressions(*held[0])
                held, size = [], 0
    if held:
        yield _expressions(*_combined(held)[0])


def _expressions(kind, context, last, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(context.view(np.int64), mask=kind), pa.array(last.view(np.int64)), pa.array(n[:, 0]), pa.array(n[:, 1])], ["c", "w", "toxic", "ordinary"])


@trimmed
def _document_counts(batches):
    """In how many of some documents each word occurs; a task's batches are combined while they have at most COMBINED words."""
    held, sums = np.zeros(0, U), np.zeros(0, np.int64)
    for x in slices(batches, 0, 1 << 20):
        h, _, first = words_of(*text_bytes(x.column(0)))
        found, at = np.unique(h, return_inverse=True)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        once = np.unique(doc * len(found) + at)
        n = np.bincount(once % max(len(found), 1), minlength=len(found))
        keys, at = np.unique(np.concatenate([held, found]), return_inverse=True)
        sums = np.bincount(at, weights=np.concatenate([sums, n]), minlength=len(keys)).astype(np.int64)
        held = keys
        if len(held) > COMBINED:
            yield _counted(held, sums)
            held, sums = held[:0], sums[:0]
    yield _counted(held, sums)


def _counted(words: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])


def document_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): in how many of ``docs`` each of all their words occurs; a word is its hash. The table grows with the corpus and stays distributed."""
    some = docs.select(F.col(text_col).alias("text")).mapInArrow(_document_counts, "word bigint, n bigint")
    return some.groupBy("word").agg(F.sum("n").alias("n"))


# bounds

def _slots(keys: np.ndarray) -> np.ndarray:
    return (keys >> U(64 - SLOT_BITS)).astype(np.int64)


def _level(values) -> np.ndarray:
    """The lowest level whose bound is not below the value."""
    return np.searchsorted(_LEVELS, np.asarray(values) + 1e-9).astype(np.uint8)


def _highest(rows: DataFrame, key, least: int) -> np.ndarray:
    """The highest level of ``rows``' last column in each slot, ``least`` at least; ``key`` makes keys of the columns before."""

    def run(batches):
        held = np.zeros(1 << SLOT_BITS, np.uint8)
        for x in batches:
            np.maximum.at(held, _slots(key(*(c.to_numpy().view(U) for c in x.columns[:-1]))), _level(x.column(x.num_columns - 1).to_numpy()))
        slot = np.flatnonzero(held > least)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(held[slot].astype(np.int16))], ["slot", "level"])

    found = rows.mapInArrow(trimmed(run), "slot int, level smallint").groupBy("slot").agg(F.max("level").alias("level")).toArrow()
    out = np.full(1 << SLOT_BITS, least, np.uint8)
    out[found["slot"].to_numpy()] = found["level"].to_numpy()
    return out


def _same(keys: np.ndarray) -> np.ndarray:
    return keys


class Bounds:
    """What differences of words, of the backoff after contexts, and of pairs that toxic documents have are at most, by slots of their hashes."""

    def __init__(self, words: np.ndarray, contexts: np.ndarray, pairs: np.ndarray):
        self.words, self.contexts, self.pairs = words, contexts, pairs

    def may_exceed(self, margin: float, before: np.ndarray, h: np.ndarray) -> np.ndarray:
        """False only where neither difference exceeds the margin. A pair that no toxic document has differs by its backoff's difference at most."""
        alone = _LEVELS[self.words[_slots(h)]]
        return (alone + np.maximum(_LEVELS[self.contexts[_slots(before)]], 0) > margin) | (_LEVELS[self.pairs[_slots(pair(before, h))]] > max(margin, _LEVELS[0]))


def _part(c):
    """The part of a context, a column or an array."""
    return c.view(np.int64) % len(PARTS) if isinstance(c, np.ndarray) else F.pmod(c, F.lit(len(PARTS)))


def _scan(bounds, margin: float):
    """Of rows whose last column is a text, dealt: (row, c, w, k), the different pairs of a row that may exceed the margin, each with its number; and as OTHERS the other columns, the number of words and row."""

    def run(batches):
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            docs, pairs = [], []
            for x in slices([batch], -1):
                h, before, first = words_of(*text_bytes(x.column(x.num_columns - 1)))
                at = np.flatnonzero(bounds.value.may_exceed(margin, before, h))
                doc = np.repeat(np.arange(row, row + x.num_rows), np.diff(first))[at]
                order = np.lexsort((h[at], before[at], doc))
                doc, c, w = doc[order], before[at][order], h[at][order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (c[1:] != c[:-1]) | (w[1:] != w[:-1])
                one = np.flatnonzero(new)
                docs.append((np.diff(first), np.arange(row, row + x.num_rows)))
                pairs.append((doc[one], c[one], w[one], np.diff(np.append(one, len(doc)))))
                row += x.num_rows
            if docs:
                n_words, rows = (pa.array(np.concatenate(v).astype(np.int64)) for v in zip(*docs, strict=True))
                doc, c, w, k = (np.concatenate(v) for v in zip(*pairs, strict=True))
                yield from in_parts(pa.RecordBatch.from_arrays([*batch.columns[:-1], n_words, rows], [*batch.schema.names[:-1], "n_words", "row"]), np.full(batch.num_rows, OTHERS))
                yield from in_parts(pa.RecordBatch.from_arrays([pa.array(doc), pa.array(c.view(np.int64)), pa.array(w.view(np.int64)), pa.array(k.astype(np.int32))], ["row", "c", "w", "k"]), _part(c))

    return trimmed(run)


class Models:
    """Both classes' models: tables of words, contexts and pairs, and what is fitted on the documents that were not counted.

    ``words`` has (w, toxic, ordinary): probabilities; ``contexts`` (c, and of either class the sum of counts and the
    backoff's share); ``counts`` (c, w, toxic, ordinary): of pairs, in how many documents, of which the discounts are taken.
    """

    def __init__(self, words: DataFrame, contexts: Dealt, counts: Dealt, taken: tuple, unknown: float):
        self.words, self.contexts, self.counts, self.taken, self.unknown = words, contexts, counts, taken, unknown
        self.margin, self.scale, self.weights, self.bounds = 0.0, np.ones(2), np.zeros(3), None

    def _differing(self, rows: DataFrame, parts=PARTS) -> DataFrame:
        """``rows`` with (c, w) and the pair's counts (null: unseen), with alone and after: the differences of w alone and after c. All c are of ``parts``."""
        words = self.words.select("w", F.col("toxic").alias("_pt"), F.col("ordinary").alias("_po"))
        found = rows.join(words, "w", "left").join(self.contexts.of(parts, _CONTEXTS), "c", "left")
        high = [(F.col(n) - _taken(n, self.taken[i])) / F.greatest(F.col(s), F.lit(1)) + F.col(b) * F.col(p) for i, (n, s, b, p) in enumerate((("toxic", "sum_t", "rest_t", "_pt"), ("ordinary", "sum_o", "rest_o", "_po")))]
        alone = F.coalesce(F.log(F.col("_pt") / F.col("_po")), F.lit(self.unknown))
        after = F.when(F.col("toxic").isNull(), alone + F.coalesce(F.log(F.col("rest_t") / F.col("rest_o")), F.lit(0.0))).otherwise(F.log(high[0] / high[1]))
        return found.select(*[c for c in rows.columns if c not in ("toxic", "ordinary")], alone.alias("alone"), after.alias("after"))

    def bound(self) -> None:
        """Make the bounds."""
        with freeing(self.words.sparkSession):
            toxic = self._differing(self.counts.of(PARTS, _COUNTS).where(F.col("toxic") > 0)).select("c", "w", "after")
            self.bounds = self.words.sparkSession.sparkContext.broadcast(Bounds(
                _highest(self.words.select("w", F.log(F.col("toxic") / F.col("ordinary")).alias("v")), _same, int(_level(self.unknown))),
                _highest(self.contexts.of(PARTS, _CONTEXTS).select("c", F.log(F.col("rest_t") / F.col("rest_o")).alias("v")), _same, int(_level(0.0))),
                _highest(toxic, pair, 0),
            ))

    def sums(self, scanned: Dealt, margins, total: int) -> DataFrame:
        """By row of the ``total`` pairs that :func:`_scan` found for the least of the ``margins``: the array of what both differences exceed each margin by, summed."""
        bounds, least = self.bounds, min(margins)

        def asked(batches):
            for x in batches:
                yield x.filter(pa.array(bounds.value.may_exceed(least, *(x.column(i).to_numpy().view(U) for i in (0, 1)))))

        beyond = [F.sum(F.col("k") * F.greatest(F.col(v) - m, F.lit(0.0))) for m in margins for v in ("alone", "after")]
        rounds, parts = min(ROUNDS, max(1, -(-total // ROUND_PAIRS))), []
        for r in range(rounds):
            mine = PARTS[r::rounds]
            each = scanned.of(mine, "row bigint, c bigint, w bigint, k int")
            pairs = self.counts.of(mine, _COUNTS).mapInArrow(asked, _COUNTS)
            different = each.groupBy("c", "w").agg(F.count(F.lit(1)).alias("n_rows"))
            values = packed(self._differing(different.join(pairs, ["c", "w"], "left"), mine).where(F.greatest("alone", "after") > least))
            found = lookup(each, values, ["c", "w"], "n_rows", max(total, 1), "row").where(F.col("alone").isNotNull())
            parts.append(packed(found.groupBy("row").agg(F.array(*beyond).alias("beyond"))))
            del values, found
            forget(self.words.sparkSession)
        if rounds == 1:
            return parts[0]
        return functools.reduce(DataFrame.unionAll, parts).groupBy("row").agg(F.array(*[F.sum(F.col("beyond")[i]) for i in range(2 * len(margins))]).alias("beyond"))

    def measured(self, rows: DataFrame, margins) -> tuple[DataFrame, int]:
        """``rows``, whose last column is a text, with x instead of it, and their number; x: for each margin the root of either order's sum over the root of the text's words."""
        names = rows.columns[:-1]
        scanned = Dealt(rows.mapInArrow(_scan(self.bounds, min(margins)), Dealt.SCHEMA))
        numbers = scanned.numbers()
        n_rows, total = numbers.get(OTHERS, 0), sum(numbers.get(p, 0) for p in PARTS)
        docs = scanned.of([OTHERS], ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "n_words bigint", "row bigint"]))
        none = F.array(*[F.lit(0.0)] * (2 * len(margins)))
        out = docs.join(self.sums(scanned, margins, total), "row", "left")
        return out.select(*names, F.transform(F.coalesce("beyond", none), lambda v: F.sqrt(v / F.sqrt(F.greatest(F.col("n_words"), F.lit(1))))).alias("x")), n_rows

    def fit(self, rows: DataFrame) -> None:
        """The margin and the logistic function under which the labels of ``rows`` (label, text) are likeliest, by Newton's steps with a ridge."""
        self.bound()
        x, n_rows = self.measured(rows, MARGINS)
        self.margin, self.scale, self.weights = _newton(saved(x, n_rows))

    def differences(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every word of some texts: log P(word | toxic) - log P(word | ordinary), alone and after the word before; and each text's first word."""
        h, before, first = words_of(data, at)
        asked = pa.table({"at": np.arange(len(h)), "c": before.view(np.int64), "w": h.view(np.int64)})
        rows = self.words.sparkSession.createDataFrame(asked)
        found = self._differing(rows.join(self.counts.of(PARTS, _COUNTS), ["c", "w"], "left")).select("at", "alone", "after").toArrow().sort_by("at")
        return found["alone"].to_numpy(), found["after"].to_numpy(), first

    @staticmethod
    def beyond(each: np.ndarray, first: np.ndarray, margin: float) -> np.ndarray:
        """By text: what the differences exceed the margin by, summed, over the root of the text's words; 0 for texts without words."""
        total = np.concatenate([[0], np.cumsum(np.maximum(each - margin, 0))])
        return (total[first[1:]] - total[first[:-1]]) / np.sqrt(np.maximum(np.diff(first), 1))

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Scores of some texts, which the driver holds; :func:`toxicity` scores tables."""
        alone, after, first = self.differences(data, at)
        x = np.sqrt(np.stack([self.beyond(alone, first, self.margin), self.beyond(after, first, self.margin)], 1)) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:2] + self.weights[2], -60, 60)))


def _taken(n: str, d: np.ndarray):
    """What the discounts take of a count."""
    return F.when(F.col(n) >= 3, float(d[2])).when(F.col(n) == 2, float(d[1])).when(F.col(n) == 1, float(d[0])).otherwise(0.0)


def _newton(rows: DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
    """The likeliest margin, its scale and weights for (label, x); of each step the sums over all rows are gathered, ten numbers a margin."""
    n_margins, ridge = len(MARGINS), np.diag([0.1, 0.1, 1e-3])
    none = 0.0, np.ones(2), np.zeros(3)

    def gathered(of, size):
        def run(batches):
            total = np.zeros(size)
            for b in batches:
                if b.num_rows:
                    total += of(b.column(0).to_numpy().astype(float), b.column(1).flatten().to_numpy().reshape(b.num_rows, n_margins, 2)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])

        return np.sum([np.array(r.v) for r in rows.select("label", "x").mapInArrow(run, "v array<double>").collect()] or [np.zeros(size)], 0)

    n, ones, *first = gathered(lambda y, x: np.concatenate([[len(y), y.sum()], x.sum(0).ravel()]), 2 + 2 * n_margins)
    if not 0 < ones < n:
        return none
    mean = np.array(first).reshape(n_margins, 2) / n
    scale = np.sqrt(gathered(lambda y, x: ((x - mean) ** 2).sum(0), 2 * n_margins).reshape(n_margins, 2) / n)
    scale = np.where(scale > 0, scale, 1.0)
    w, going = np.zeros((n_margins, 3)), np.ones(n_margins, bool)

    def sums(y, x):
        z = np.concatenate([x / scale, np.ones((len(y), n_margins, 1))], 2)
        p = 1 / (1 + np.exp(-np.clip((z * w).sum(2), -60, 60)))
        sure = np.clip(p, 1e-12, 1 - 1e-12)
        slope, bend = np.einsum("nmi,nm->mi", z, y[:, None] - p), np.einsum("nmi,nm,nmj->mij", z, p * (1 - p), z)
        likelihood = (y[:, None] * np.log(sure) + (1 - y[:, None]) * np.log(1 - sure)).sum(0)
        return np.concatenate([slope, bend.reshape(n_margins, 9), likelihood[:, None]], 1)

    for step in range(51):
        now = gathered(sums, 13 * n_margins).reshape(n_margins, 13)
        if step == 50 or not going.any():
            break
        for m in np.flatnonzero(going):
            move = np.linalg.solve(now[m, 3:12].reshape(3, 3) + ridge, now[m, :3] - ridge @ w[m])
            w[m] = w[m] + move
            going[m] = np.abs(move).max() >= 1e-9
    best = int(np.argmax(now[:, 12] - 0.5 * np.einsum("mi,ij,mj->m", w, ridge, w)))
    return MARGINS[best], scale[best], w[best]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Models:
    """Models from two thirds of the labelled documents, shared counts from all of ``docs``, the logistic function from the last third."""
    counted, rest = thirds(docs, labels, "toxic", remainder(F.col("doc_id"), 3) != 1, id_col, text_col)
    # a text that several documents of a class have is counted once
    counts = counted.select("label", "text").distinct().mapInArrow(_class_counts, _COUNTS).groupBy("c", "w").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    counts = Dealt.by(counts, F.coalesce(_part(F.col("c")), F.lit(OTHERS)))
    numbers = {}
    of = [F.coalesce(F.sum(x), F.lit(0)) for k in ("toxic", "ordinary") for x in (F.col(k), *((F.col(k) == i).cast("int") for i in range(1, 5)), (F.col(k) >= 3).cast("int"))]
    for r in counts.of([*PARTS, OTHERS], _COUNTS).groupBy(F.col("c").isNull()).agg(*of).collect():
        numbers[r[0]] = np.array(r[1:]).reshape(2, 6)
    words, pairs = (numbers.get(k, np.zeros((2, 6), int)) for k in (True, False))
    corpus = packed(document_counts(docs, text_col))
    n_words, n_all = corpus.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # a word that neither class has differs by the classes' backoffs, whatever its shared probability
    shared, of, left = (F.coalesce(F.col("n"), F.lit(0)) + 1) / F.lit(float(n_all + n_words + 1)), [], []
    for k, x in zip(("toxic", "ordinary"), words, strict=True):
        d, total = _discounts(x[1:5]), float(max(x[0], 1))
        left.append(float(d @ [x[1], x[2], x[5]]) / total if x[0] else 1.0)
        of.append(((F.col(k) - _taken(k, d)) / total + left[-1] * shared).alias(k))
    known = packed(counts.of([OTHERS], _COUNTS).join(corpus.withColumnRenamed("word", "w"), "w", "left").select("w", *of))
    taken = tuple(_discounts(x[1:5]) for x in pairs)
    sums = [F.sum(x).alias(f"{name}_{k[0]}") for k, d in zip(("toxic", "ordinary"), taken, strict=True) for name, x in (("sum", F.col(k)), ("taken", _taken(k, d)))]
    contexts = counts.of(PARTS, _COUNTS).groupBy("c").agg(*sums)
    contexts = Dealt.by(contexts.select("c", *[x for k in "to" for x in (F.col(f"sum_{k}"), F.when(F.col(f"sum_{k}") > 0, F.col(f"taken_{k}") / F.col(f"sum_{k}")).otherwise(1.0).alias(f"rest_{k}"))]), _part(F.col("c")))
    models = Models(known, contexts, counts, taken, float(np.log(left[0] / left[1])))
    models.fit(rest.select("label", "text"))
    forget(docs.sparkSession)
    return models


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Words are as for decontamination: letters, digits and what is beyond
    ASCII, A-Z lower-cased. Empty and null texts differ by 0 and have the
    logistic function's offset as score. Without labels of both classes all
    scores are 0.5. With few toxic examples few toxic words are known. Repeated rows stay repeated; other columns are not read; an
    empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    models = fit(docs, labels, id_col=id_col, text_col=text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), (remainder(F.col(id_col), 3) == 1).alias("held_out"), F.col(text_col).alias("text"))
    if models.weights.any():
        x, _ = models.measured(rows, [models.margin])
        z = sum((F.col("x")[i] * float(models.weights[i] / models.scale[i]) for i in (0, 1)), F.lit(float(models.weights[2])))
        out = x.select("doc_id", "held_out", (1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(60.0)), F.lit(-60.0))))).alias("score"))
    else:
        out = rows.select("doc_id", "held_out", F.lit(0.5).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
