"""From a query's tree to leaves that stand for sets of terms or phrases, with document frequencies."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import functions as F

from ..functions.analyzer import CJK, SUB, WORD, Token, analyze
from ..functions.wanted import Expansion, Wanted
from ..operators.index import Index
from ..operators.rank import FIELD_NAMES, idf
from . import syntax as ast

#: Terms that all the prefixes and fuzzy terms of one query may stand for, unless the searcher expands them whole.
EXPANSION_LIMIT = 1024
#: The edit distance for terms of up to so many characters; 2 for longer ones.
AUTO_FUZZY = ((2, 0), (5, 1))


@dataclass
class ScoredTerm:
    text: str
    weight: float
    df: int = 0
    idf: float = 0.0


@dataclass
class Leaf:
    """Matches a document that has any of ``terms`` in ``fields``, or any that ``expansion`` stands for; or, if there are ``groups``, all of these in one field."""

    number: int
    fields: tuple[int, ...]
    terms: list[ScoredTerm] = field(default_factory=list)
    groups: list[list[str]] = field(default_factory=list)
    slop: int = 0
    #: Of any number of terms, which the driver never lists.
    expansion: Expansion | None = None
    #: By term, the postings that it has in ``fields``; of what a leaf of terms matches, and for a phrase of its rarest term.
    postings: dict[str, int] = field(default_factory=dict)

    @property
    def scores(self) -> bool:
        return bool(self.terms) or self.expansion is not None

    @property
    def seeds(self) -> list[str]:
        """Terms of which a document that matches has one: all of them, or a phrase's rarest."""
        if self.groups:
            return [min((t for g in self.groups for t in g), key=lambda t: (self.postings[t], t))]
        return [t.text for t in self.terms]


@dataclass
class Bound:
    kind: str  # all none leaf and or not filter
    children: list[Bound] = field(default_factory=list)
    leaf: Leaf | None = None
    filter: ast.Filter | None = None


@dataclass
class Plan:
    root: Bound
    leaves: list[Leaf]
    truncated: bool


@dataclass
class _Part:
    """What a query word is made of: a word, or a stretch of CJK pairs."""

    terms: list[str]
    cjk: bool

    @property
    def text(self) -> str:
        if not self.cjk:
            return self.terms[0]
        return "".join(self.terms)


def _parts(tokens: list[Token]) -> list[_Part]:
    parts, last = [], None
    for t in tokens:
        if t.kind == CJK and last is not None and t.pos == last + 1:
            parts[-1].terms.append(t.text)
        elif t.kind in (CJK, WORD):
            parts.append(_Part([t.text], t.kind == CJK))
        last = t.pos if t.kind == CJK else None
    return parts


class _Binder:
    def __init__(self, index: Index, whole: bool = False):
        self.index, self.whole, self.leaves, self.left, self.truncated = index, whole, [], EXPANSION_LIMIT, False

    def leaf(self, fields, **kw) -> Bound:
        leaf = Leaf(len(self.leaves), fields, **kw)
        self.leaves.append(leaf)
        return Bound("leaf", leaf=leaf)

    def bind(self, node: ast.Node) -> Bound:
        match node:
            case ast.And(children):
                return Bound("and", [self.bind(c) for c in children])
            case ast.Or(children):
                return Bound("or", [self.bind(c) for c in children])
            case ast.Not(child):
                return Bound("not", [self.bind(child)])
            case ast.Filter():
                return Bound("filter", filter=node)
            case ast.Phrase(text, of, slop):
                return self.phrase(analyze(text), self.scope(of), slop or 0)
            case ast.Term(text, of, prefix, fuzzy):
                return self.term(analyze(text), self.scope(of), prefix, fuzzy)
        return Bound("all")

    @staticmethod
    def scope(of: str | None) -> tuple[int, ...]:
        return (0, 1, 2) if of is None else (FIELD_NAMES.index(of),)

    def term(self, tokens, fields, prefix: bool, fuzzy: int | None) -> Bound:
        bound = [self.part(p, fields, prefix, fuzzy) for p in _parts(tokens)]
        if not bound:
            return Bound("none")
        return bound[0] if len(bound) == 1 else Bound("and", bound)

    def part(self, part: _Part, fields, prefix: bool, fuzzy: int | None) -> Bound:
        plain = not prefix and fuzzy is None
        text = part.text
        if plain and part.cjk and len(part.terms) > 1:
            return self.leaf(fields, groups=[part.terms])
        if plain and part.cjk and len(text) == 1:
            # a single character stands for all pairs that have it
            return self.expand(fields, Expansion("pair", text))
        if prefix:
            return self.expand(fields, Expansion("prefix", text))
        if fuzzy is not None:
            most = fuzzy if fuzzy >= 0 else next((d for n, d in AUTO_FUZZY if len(text) <= n), 2)
            if most:
                return self.expand(fields, Expansion("near", text, most))
        return self.leaf(fields, terms=[ScoredTerm(text, 1.0)])

    def expand(self, fields, expansion: Expansion) -> Bound:
        """A leaf for the terms of the dictionary that ``expansion`` stands for: all, or the first by field and term that the limit leaves room for."""
        if self.whole:
            return self.leaf(fields, expansion=expansion)
        found = self.index.entries(Wanted(fields, expansions=(expansion,))).groupBy("term").agg(F.min("field").alias("f"))
        rows = found.select("term", "f", expansion.weight().alias("w")).orderBy("f", "term").limit(self.left + 1).collect()
        if len(rows) > self.left:
            self.truncated, rows = True, rows[: self.left]
        self.left -= len(rows)
        if not rows:
            return Bound("none")
        return self.leaf(fields, terms=[ScoredTerm(r["term"], r["w"]) for r in sorted(rows, key=lambda r: r["term"].encode())])

    def phrase(self, tokens, fields, slop: int) -> Bound:
        """Words at following positions are one group; where an identifier takes several, a new group begins after it."""
        groups, last = [], None
        for t in tokens:
            if t.kind == SUB:
                continue
            if last is not None and t.pos == last + 1:
                groups[-1].append(t.text)
            else:
                groups.append([t.text])
            last = t.pos
        return self.leaf(fields, groups=groups, slop=slop) if groups else Bound("none")


def frequencies(index: Index, leaves: list[Leaf]) -> None:
    """Look up the terms of all ``leaves``, at once. The df of a term is the largest of the fields in its scope."""
    wanted = sorted({t.text for leaf in leaves for t in leaf.terms} | {t for leaf in leaves for g in leaf.groups for t in g})
    if not wanted:
        return
    fields = tuple(sorted({f for leaf in leaves for f in leaf.fields}))
    rows = index.entries(Wanted(fields, tuple(wanted))).groupBy("term", "field").agg(F.sum("df").alias("df")).collect()
    df = {(r["term"], r["field"]): r["df"] for r in rows}
    for leaf in leaves:
        leaf.postings = {t: sum(df.get((t, f), 0) for f in leaf.fields) for t in [*(t.text for t in leaf.terms), *(t for g in leaf.groups for t in g)]}
        for t in leaf.terms:
            t.df = max(df.get((t.text, f), 0) for f in leaf.fields)
            t.idf = idf(index.stats.n, t.df)


def bind_all(nodes: list[ast.Node], index: Index, whole: bool = False) -> list[Plan]:
    """Plans of several queries; their terms are looked up in one job."""
    plans = []
    for node in nodes:
        binder = _Binder(index, whole)
        root = binder.bind(node)
        plans.append(Plan(root, binder.leaves, binder.truncated))
    frequencies(index, [leaf for p in plans for leaf in p.leaves])
    return plans


def bind(node: ast.Node, index: Index, whole: bool = False) -> Plan:
    return bind_all([node], index, whole)[0]
