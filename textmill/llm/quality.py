"""Document quality by a linear-chain conditional random field over lines (operator 10).

Every line is good or bad. A line's features, and those of the lines before and
after it, give its log-odds; neighbours of one label are favoured by a learned
weight. A document's score is the mean of its lines' forward-backward
probabilities of being good, weighted by length. The field is fitted on a
bounded sample of labelled documents whose lines take the document's label.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, slices, trimmed
from .labels import remainder, training_sample
from .words import IS_SPACE, LOWER, find_words, text_bytes, word_hashes

#: Labelled documents of each class that the field is fitted on, at most.
PER_CLASS = 2000
THRESHOLD = 0.3
STEPS, RATE, RIDGE = 400, 0.1, 1e-4

# Classes of bytes: other, upper-case, lower-case, digit, space, usual punctuation, unusual ASCII, bar
_OTHER, _UPPER, _LOWER_CASE, _DIGIT, _SPACE, _USUAL, _ODD, _BAR = range(8)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[0x21:0x7F] = _ODD
_CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x30:0x3A] = _UPPER, _LOWER_CASE, _DIGIT
_CLASS[IS_SPACE] = _SPACE
_CLASS[[ord(c) for c in ".,;:'\"-()?"]] = _USUAL
_CLASS[ord("|")] = _BAR
_CLASS[0x80:] = _LOWER_CASE
N_OWN = 11


def line_features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line with its neighbours', bytes of each line, and each text's first line (and the number of lines).

    Every text has a line; white space alone is a line without words.
    """
    n_docs = len(at) - 1
    ends = np.flatnonzero(data == 10)
    doc_of_end = np.searchsorted(at, ends, "right") - 1
    counts = np.bincount(doc_of_end, minlength=n_docs) + 1
    first = np.concatenate([[0], np.cumsum(counts)])
    starts = np.empty(first[-1], np.int64)
    is_first = np.zeros(first[-1], bool)
    is_first[first[:-1]] = True
    starts[first[:-1]] = at[:-1]
    starts[~is_first] = ends + 1
    stops = np.empty(first[-1], np.int64)
    is_last = np.zeros(first[-1], bool)
    is_last[first[1:] - 1] = True
    stops[first[1:] - 1] = at[1:]
    stops[~is_last] = ends
    n, size = len(starts), stops - starts
    kind = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.zeros(0, np.int64)
    kind[lead[(data[lead] >= 0x80) & (data[lead] <= 0x9E)]] = _UPPER  # Latin-1 capitals
    # class by class: a byte costs a byte or two here, not the eight of a number for each
    c = np.zeros((n, 8))
    filled = np.diff(starts_and_end(starts, at)) > 0
    for k in range(8 if filled.any() else 0):
        c[filled, k] = np.add.reduceat(kind == k, starts[filled], dtype=np.int64)
    w_start, w_end, w_first = find_words(data, starts_and_end(starts, at), IS_SPACE)
    words = np.diff(w_first)
    hashes = word_hashes(LOWER[data], w_start, w_end)
    line_of_word = np.repeat(np.arange(n), words)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (line_of_word[1:] == line_of_word[:-1])
    repeated = np.bincount(line_of_word[again], minlength=n)
    different = np.bincount(line_of_word[np.unique(np.stack([line_of_word.astype(np.uint64), hashes], 1).view("V16"), return_index=True)[1]], minlength=n) if len(hashes) else np.zeros(n)
    letters, some = np.maximum(c[:, _UPPER] + c[:, _LOWER_CASE], 1), np.maximum(words, 1)
    solid = np.maximum(size - c[:, _SPACE], 1)
    own = np.stack([
        np.ones(n), c[:, _UPPER] / letters, np.minimum(c[:, _ODD] / some, 5), c[:, _BAR] / some, c[:, _DIGIT] / solid, np.minimum(c[:, _USUAL] / some, 2),
        repeated / some, np.log1p(words) * (1 - different / some), np.minimum(solid / some, 30) / 10, np.log1p(words) / 5, (words == 0).astype(float),
    ], 1)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[is_first], after[is_last] = 0, 0
    return np.concatenate([own, before, after], 1), size, first


def starts_and_end(starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.concatenate([starts, at[-1:]])


def _turns(first: np.ndarray):
    """For t = 0, 1, ...: the lines that are number t of their text; texts in order of falling length."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    longest_first = first[:-1][order]
    active = np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), "left")
    return [longest_first[:k] + t for t, k in enumerate(active)]


def _soft(x, stick):
    """log of (e^(x+stick) + e^-stick) / (e^(x-stick) + e^stick): log-odds passed to a neighbour."""
    return np.logaddexp(x + stick, -stick) - np.logaddexp(x - stick, stick)


def marginals(odds: np.ndarray, stick: float, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each line: the probability of being good; and that of agreeing with the line before (0 for first lines)."""
    ahead, back = np.zeros(len(odds)), np.zeros(len(odds))
    turns = _turns(first)
    for now, then in zip(turns[1:], turns, strict=False):
        prev = then[: len(now)]
        ahead[now] = _soft(ahead[prev] + odds[prev], stick)
    for now, then in zip(turns[-2::-1], turns[:0:-1], strict=False):
        here = now[: len(then)]
        back[here] = _soft(back[then] + odds[then], stick)
    good = 1 / (1 + np.exp(-np.clip(ahead + odds + back, -60, 60)))
    agree = np.zeros(len(odds))
    if len(turns) > 1:
        now = np.concatenate(turns[1:])
        a, b = (ahead + odds)[now - 1], (back + odds)[now]
        same = np.logaddexp(0, a + b) + stick
        agree[now] = np.exp(same - np.logaddexp(same, np.logaddexp(a, b) - stick))
    return good, agree


class Field:
    """Weights of the features, and of two neighbours' agreement."""

    def __init__(self, weights: np.ndarray, stick: float):
        self.weights, self.stick = weights, stick

    @classmethod
    def fit(cls, data: np.ndarray, at: np.ndarray, labels: np.ndarray) -> Field:
        """Maximum likelihood with a ridge, by Adam from zero: no randomness, so one sample gives one field."""
        x, _, first = line_features(data, at)
        n = max(len(labels), 1)
        y = np.repeat(labels, np.diff(first))
        weight = np.repeat(1 / np.maximum(np.diff(first), 1), np.diff(first))  # a document counts once, however many lines it has
        theta, m, v = np.zeros(x.shape[1] + 1), 0.0, 0.0
        later = np.ones(len(y), bool)
        later[first[:-1]] = False
        for t in range(1, STEPS + 1):
            good, agree = marginals(x @ theta[:-1], theta[-1], first)
            grad = np.concatenate([x.T @ (weight * (y - good)), [(weight * (1 - agree))[later].sum()]]) / n - RIDGE * theta
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            theta = theta + RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        return cls(theta[:-1], float(theta[-1]))

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        x, size, first = line_features(data, at)
        good, _ = marginals(x @ self.weights, self.stick, first)
        share = np.maximum(size, 1)
        return np.clip(np.add.reduceat(good * share, first[:-1]) / np.add.reduceat(share, first[:-1]), 0, 1) if len(at) > 1 else np.zeros(0)


def _score(field: Field):
    def run(batches):
        for x in slices(batches):
            yield pa.RecordBatch.from_arrays([*x.columns[1:], pa.array(field.score(*text_bytes(x.column(0))))], [*x.schema.names[1:], "score"])

    return trimmed(run)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Field:
    sample = training_sample(docs, labels, "quality", remainder(F.col("doc_id"), 5) != 0, {0: per_class, 1: per_class})
    return Field.fit(*text_bytes(sample["text"]), sample["label"].to_numpy().astype(float))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Empty and null texts are one line without words, and have that line's
    score. Without labelled documents all weights are zero and all scores 0.5.
    Repeated rows stay repeated; other columns are not read; an empty table
    gives no rows.
    """
    prepare(docs.sparkSession)
    field = fit(docs, labels)
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("bigint").alias("doc_id"), (remainder(F.col(id_col), 5) == 0).alias("held_out"))
    out = rows.mapInArrow(_score(field), "doc_id bigint, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, whose quality reaches ``threshold``."""
    prepare(docs.sparkSession)
    field = fit(docs, labels)
    rows = docs.select(F.col(text_col).alias("_text"), F.struct(*docs.columns).alias("row"))
    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_score(field), schema).where(F.col("score") >= threshold).select("row.*")
