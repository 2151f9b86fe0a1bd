"""Snippets: the window of a text with most hits, and where they are in it."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.analyzer import CJK, SUB, Token, analyze
from ..plans import syntax as ast

#: Characters of a snippet.
WIDTH = 160


@dataclass
class Snippet:
    text: str
    start: int
    highlights: list[tuple[int, int]] = field(default_factory=list)  # UTF-8 bytes, from the snippet's start

    def utf16(self) -> list[tuple[int, int]]:
        """The highlights in UTF-16 units, as browsers count; those that don't fall between characters are left out."""
        raw, units, at = self.text.encode(), {0: 0}, 0
        for c in self.text:
            n = len(c.encode())
            units[at + n] = units[at] + (2 if ord(c) > 0xFFFF else 1)
            at += n
        assert at == len(raw)
        return [(units[a], units[b]) for a, b in self.highlights if a in units and b in units]


@dataclass
class Matcher:
    """Which tokens of a text a query would highlight: its words, and the first words of its prefixes; nothing under NOT, nothing fuzzy."""

    words: set[str]
    prefixes: tuple[str, ...]

    @classmethod
    def of(cls, node: ast.Node) -> Matcher:
        words, prefixes = set(), []

        def visit(n: ast.Node) -> None:
            match n:
                case ast.And(children) | ast.Or(children):
                    for c in children:
                        visit(c)
                case ast.Phrase(text):
                    words.update(t.text for t in analyze(text) if t.kind != SUB)
                case ast.Term(text, _, prefix, fuzzy):
                    tokens = [t for t in analyze(text) if t.kind != SUB]
                    if prefix:
                        prefixes.extend(t.text for t in tokens[:1])
                    elif fuzzy is None:
                        words.update(t.text for t in tokens)

        visit(node)
        return cls(words, tuple(prefixes))

    def __call__(self, token: Token) -> bool:
        single = token.kind == CJK and any(c in self.words for c in token.text)
        return token.text in self.words or single or bool(self.prefixes and token.text.startswith(self.prefixes))


def build(text: str, matcher: Matcher, width: int = WIDTH) -> Snippet:
    """The first of the densest windows: a third of ``width`` before a hit, and ``width`` after it; without hits, the text's head."""
    width = width if width > 0 else WIDTH
    at = [0]
    for c in text:
        at.append(at[-1] + len(c.encode("utf-8", "surrogatepass")))
    char = {b: k for k, b in enumerate(at)}
    hits = [(char[t.start], char[t.end]) for t in analyze(text) if matcher(t)]
    if not hits:
        return Snippet(text[:width], 0)
    starts, ends = sorted(h[0] for h in hits), [h[1] for h in hits]
    best, most = None, -1
    low = high = 0
    for s, e in hits:
        a, b = max(0, s - width // 3), min(len(text), e + width)
        # hits come in order, so the ones inside are a stretch of them
        while low < len(hits) and hits[low][0] < a:
            low += 1
        while high < len(hits) and starts[high] <= b:
            high += 1
        inside = sum(1 for k in range(low, high) if ends[k] <= b)
        if inside > most:
            best, most = (a, b), inside
    a, b = best
    if a > hits[0][0]:
        a = max(0, hits[0][0] - width // 4) if hits[0][0] >= b - 2 * width else a
    return Snippet(text[a:b], at[a], [(at[s] - at[a], at[e] - at[a]) for s, e in hits if s >= a and e <= b])


_TYPE = "struct<text: string, start: bigint, highlights: array<struct<begin: bigint, end: bigint>>>"


def snippet_column(text: Column, node: ast.Node, width: int = WIDTH, utf16: bool = False) -> Column:
    """For the few rows that are shown: Arrow batches in Python."""
    matcher = Matcher.of(node)

    @F.pandas_udf(_TYPE)
    def make(texts: pd.Series) -> pd.DataFrame:
        found = [build(t or "", matcher, width) for t in texts]
        marks = [[{"begin": a, "end": b} for a, b in (s.utf16() if utf16 else s.highlights)] for s in found]
        return pd.DataFrame({"text": [s.text for s in found], "start": [s.start for s in found], "highlights": marks})

    return make(text)


def with_snippets(hits: DataFrame, docs: DataFrame, node: ast.Node, width: int = WIDTH, utf16: bool = False) -> DataFrame:
    """The hits (path, title, score) with the snippet of their bodies; bodies are read for these alone."""
    bodies = docs.select("path", "body").join(F.broadcast(hits), "path")  # k hits
    return bodies.select("path", "title", "score", snippet_column(F.col("body"), node, width, utf16).alias("snippet")).orderBy(F.col("score").desc(), "path")
