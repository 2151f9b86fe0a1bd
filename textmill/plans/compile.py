"""From bound queries to columns: whether a document matches, and its score."""

from __future__ import annotations

from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import syntax as ast
from .bind import Bound, Leaf, Plan

_COMPARE = {">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__", "=": "__eq__"}


def matched(leaf: Leaf) -> str:
    return f"m{leaf.number}"


def scored(leaf: Leaf) -> str:
    return f"s{leaf.number}"


def filter_column(node: ast.Filter) -> Column:
    if node.field == "ext":
        return F.col("ext") == node.value.lower().removeprefix(".")  # whatever the operator
    if node.field == "size":
        return getattr(F.col("size"), _COMPARE[node.op])(ast.parse_size(node.value))
    start, end = ast.parse_time(node.value)
    mtime = F.col("mtime")
    if node.op == "=":
        return (mtime >= start) & (mtime < end)
    return getattr(mtime, _COMPARE[node.op])(start if ">" in node.op else end - 1)


def match_column(b: Bound) -> Column:
    match b.kind:
        case "leaf":
            return F.coalesce(F.col(matched(b.leaf)), F.lit(False))
        case "and":
            return reduce(and_, (match_column(c) for c in b.children))
        case "or":
            return reduce(or_, (match_column(c) for c in b.children))
        case "not":
            return ~match_column(b.children[0])
        case "filter":
            return F.coalesce(filter_column(b.filter), F.lit(False))
    return F.lit(b.kind == "all")


def score_column(b: Bound) -> Column:
    """AND adds its children, OR those that match; NOT, phrases and filters are worth nothing."""
    match b.kind:
        case "leaf" if b.leaf.scores:
            return F.coalesce(F.col(scored(b.leaf)), F.lit(0.0))
        case "and":
            return reduce(add, (score_column(c) for c in b.children))
        case "or":
            return reduce(add, (F.when(match_column(c), score_column(c)).otherwise(0.0) for c in b.children))
    return F.lit(0.0)


def counting(b: Bound, when: Column) -> list[tuple[Leaf, Column]]:
    """The leaves whose scores count, and when they do."""
    match b.kind:
        case "leaf":
            return [(b.leaf, when)] if b.leaf.scores else []
        case "and":
            return [x for c in b.children for x in counting(c, when)]
        case "or":
            return [x for c in b.children for x in counting(c, when & match_column(c))]
    return []


def needs_a_leaf(b: Bound) -> bool:
    """Whether only documents with some leaf can match; if not, all documents have to be looked at."""
    match b.kind:
        case "leaf" | "none":
            return True
        case "and":
            return any(needs_a_leaf(c) for c in b.children)
        case "or":
            return all(needs_a_leaf(c) for c in b.children)
    return False


def required(b: Bound) -> list[Leaf]:
    """Leaves that every document that matches has."""
    if b.kind == "leaf":
        return [b.leaf]
    return [x for c in b.children for x in required(c)] if b.kind == "and" else []


def has_filter(b: Bound) -> bool:
    return b.kind == "filter" or any(has_filter(c) for c in b.children)


def phrase_column(leaf: Leaf) -> Column:
    """Whether the groups are in one field, given ``at``: the positions there of each term."""

    def positions(term: str) -> Column:
        return F.coalesce(F.col("at")[term], F.array().cast("array<int>"))

    def group(terms: list[str]) -> Column:
        if len(terms) == 1:
            return F.size(positions(terms[0])) > 0
        if leaf.slop <= 0:
            return F.exists(positions(terms[0]), lambda p: reduce(and_, (F.array_contains(positions(t), p + k) for k, t in enumerate(terms) if k)))
        limit = leaf.slop + len(terms) - 1
        return F.exists(F.concat(*[positions(t) for t in terms]), lambda low: reduce(and_, (F.exists(positions(t), lambda p: p.between(low, low + limit)) for t in terms)))

    return F.col("field").isin(*leaf.fields) & reduce(and_, (group(g) for g in leaf.groups))


__all__ = ["Plan", "counting", "filter_column", "has_filter", "match_column", "matched", "needs_a_leaf", "phrase_column", "required", "score_column", "scored"]
