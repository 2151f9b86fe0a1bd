"""Search: match, score, rank, explain."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.wanted import Wanted
from ..plans import syntax as ast
from ..plans.bind import Leaf, Plan, bind_all
from ..plans.compile import counting, has_filter, match_column, matched, needs_a_leaf, phrase_column, required, score_column, scored
from .index import Index
from .rank import FIELD_NAMES, Params, Recency, field_weight

SCORE_DIGITS = 9
#: Paths that are broadcast at most, to leave out what cannot match before it is shuffled; and how much less than the rest they must be.
SEED_PATHS, SEED_GAIN = 200_000, 4


@dataclass
class Query:
    """A query bound to an index. All results are lazy DataFrames but for the dictionary's answers."""

    searcher: Searcher
    text: str
    node: ast.Node

    @cached_property
    def plan(self) -> Plan:
        return self.searcher.bind([self])[0]

    @property
    def truncated(self) -> bool:
        return self.plan.truncated

    def matches(self) -> DataFrame:
        """(path, score, ...) of all documents that match, without recency."""
        return self.searcher.scored([self]).where(match_column(self.plan.root)).withColumn("score", score_column(self.plan.root))

    def total(self) -> DataFrame:
        return self.matches().agg(F.count(F.lit(1)).alias("total"))

    def hits(self, k: int = 10, recency: Recency | None = None) -> DataFrame:
        """The best k: path, title, score; by falling score, then path. Titles are read for these alone."""
        found = self.matches()
        if recency and recency.on:
            if "mtime" not in found.columns:
                found = found.join(self.searcher.index.live.select("path", "mtime"), "path")
            found = found.withColumn("score", F.col("score") * recency.boost(F.col("mtime")))
        best = found.select("path", F.col("score")).orderBy(F.round("score", SCORE_DIGITS).desc(), F.col("path")).limit(k)
        titles = self.searcher.index.live.select("path", "title")
        out = titles.join(F.broadcast(best), "path")  # k rows
        return out.select("path", "title", "score").orderBy(F.round("score", SCORE_DIGITS).desc(), F.col("path"))

    def evaluate(self, path: str) -> DataFrame:
        """One row, (matches), for the document at ``path``; none if there is no such document."""
        found = self.matches().where(F.col("path") == path).select(F.lit(True).alias("yes"), "path")
        return self.searcher.index.live.where(F.col("path") == path).select("path").join(found, "path", "left").select(F.coalesce("yes", F.lit(False)).alias("matches"))

    def rank_of(self, path: str) -> DataFrame:
        """(rank, total): 1 and how many documents are better than the one at ``path``; no row if it doesn't match. Recency has no part."""
        found = self.matches().select("path", F.round("score", SCORE_DIGITS).alias("score"))
        mine = found.where(F.col("path") == path).select(F.col("score").alias("mine"))
        better = (F.col("score") > F.col("mine")) | ((F.col("score") == F.col("mine")) & (F.col("path") < path))
        out = found.crossJoin(F.broadcast(mine)).agg(F.count(F.when(better, 1)).alias("better"), F.count(F.lit(1)).alias("total"))  # mine is one row
        return out.where("total > 0").select((F.col("better") + 1).alias("rank"), "total")

    def explain(self, k: int = 10, recency: Recency | None = None) -> DataFrame:
        """The hits with n, boost, final score and, for each term that counts, weight, df, idf, contribution and fields."""
        s, plan = self.searcher, self.plan
        best = s.index.docs.sparkSession.createDataFrame([tuple(r) for r in self.hits(k, recency).select("path", "score").collect()], "path string, score double")  # k rows
        s = s.within(best)
        active = {leaf.number: when for leaf, when in counting(plan.root, match_column(plan.root))}
        rows = s.term_rows([self])
        if rows is None or not active:
            return best.select("path", F.col("score").alias("final"), F.lit(1.0).alias("boost"), F.lit(s.index.stats.n).cast("bigint").alias("n"), F.array().cast(_TERMS).alias("terms"))
        flags = s.scored([self]).where(match_column(plan.root)).join(F.broadcast(best.select("path", "score")), "path")
        flags = flags.select("path", "score", score_column(plan.root).alias("raw"), *[when.alias(f"a{k}") for k, when in active.items()])
        each = rows.join(F.broadcast(flags), "path")
        use = F.lit(False)
        for k, _ in active.items():
            use = use | ((F.col("leaf") == k) & F.col(f"a{k}"))
        info = F.broadcast(s.index.docs.sparkSession.createDataFrame([(leaf.number, t.text, t.weight, t.df, t.idf) for leaf in plan.leaves for t in leaf.terms], _INFO))  # the query's own terms
        for leaf in plan.leaves:
            if leaf.expansion is not None:
                info = info.union(s.expanded(leaf))
        fields = F.array_sort(F.collect_list(F.struct("field", "tf", "len")))
        per = each.where(use).groupBy("path", "leaf", "term", "score", "raw").agg(s.term_score().alias("contribution"), fields.alias("fields"))
        per = per.join(info, ["leaf", "term"])
        named = F.transform("fields", lambda x: F.struct(F.element_at(F.array(*map(F.lit, FIELD_NAMES)), x["field"].cast("int") + 1).alias("field"), x["tf"].alias("tf"), x["len"].alias("len")))
        per = per.withColumn("fields", named)
        terms = F.array_sort(F.collect_list(F.struct("leaf", "term", "weight", "df", "idf", "contribution", "fields")))
        found = per.groupBy("path").agg(terms.alias("terms"))
        out = flags.select("path", "score", "raw").join(found, "path", "left")
        boost = F.when(F.col("raw") != 0, F.col("score") / F.col("raw")).otherwise(1.0)
        return out.select("path", F.col("score").alias("final"), boost.alias("boost"), F.lit(s.index.stats.n).cast("bigint").alias("n"), F.coalesce("terms", F.array().cast(_TERMS)).alias("terms"))


_INFO = "leaf int, term string, weight double, df bigint, idf double"
_TERMS = "array<struct<leaf: int, term: string, weight: double, df: bigint, idf: double, contribution: double, fields: array<struct<field: string, tf: int, len: int>>>>"


class Searcher:
    """With ``whole``, prefixes and fuzzy terms stand for all terms that they fit, however many; else the binder's limit holds."""

    def __init__(self, index: Index, params: Params = Params(), whole: bool = False):
        self.index, self.params, self.whole = index, params, whole
        self.every = index

    def within(self, paths: DataFrame) -> Searcher:
        """A searcher of the few documents in ``paths`` alone, with terms and statistics of all."""
        out = Searcher(self.index.within(paths), self.params, self.whole)
        out.every = self.every
        return out

    def bind(self, queries: list[Query]) -> list[Plan]:
        return bind_all([x.node for x in queries], self.index, self.whole)

    def query(self, query: str | ast.Node) -> Query:
        node = ast.parse(query) if isinstance(query, str) else query
        return Query(self, ast.render(node) if not isinstance(query, str) else query, node)

    def search(self, query: str, k: int = 10, recency: Recency | None = None) -> DataFrame:
        return self.query(query).hits(k, recency)

    @staticmethod
    def leaves(queries: list[Query]) -> list[Leaf]:
        """The leaves of all queries, each once; leaves that are alike get one number and share their columns."""
        known: dict[tuple, int] = {}
        out = {}
        for x in queries:
            for leaf in x.plan.leaves:
                same = (leaf.fields, tuple((t.text, t.weight) for t in leaf.terms), tuple(map(tuple, leaf.groups)), leaf.slop, leaf.expansion)
                # a query that repeats a leaf keeps both: each is explained on its own
                if len(queries) > 1:
                    leaf.number = known.setdefault(same, len(known))
                out.setdefault(leaf.number, leaf)
        return list(out.values())

    def expanded(self, leaf: Leaf) -> DataFrame:
        """(leaf, term, weight, df, idf) of the terms that a leaf's expansion stands for."""
        terms = self.every.entries(Wanted(leaf.fields, expansions=(leaf.expansion,))).groupBy("term").agg(F.max("df").alias("df"))
        idf = F.log1p((F.lit(self.every.stats.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return terms.select(F.lit(leaf.number).alias("leaf"), "term", leaf.expansion.weight().alias("weight"), "df", idf.alias("idf"))

    def term_rows(self, queries: list[Query]) -> DataFrame | None:
        """Postings of the terms of all queries, with leaf, the leaf's factor w, and the share that the posting adds."""
        leaves, parts = self.leaves(queries), []
        table = [(leaf.number, t.text, f, t.weight * t.idf) for leaf in leaves for t in leaf.terms for f in leaf.fields]
        if table:
            # a row for each field of each term of a query: EXPANSION_LIMIT and the query's own length bound it
            listed = self.index.docs.sparkSession.createDataFrame(table, "leaf int, term string, field tinyint, w double")
            parts.append(self.postings_for(queries, {r[1] for r in table}, {r[2] for r in table}).join(F.broadcast(listed), ["field", "term"]))
        for leaf in leaves:
            if leaf.expansion is not None:
                terms = self.expanded(leaf).select("leaf", "term", (F.col("weight") * F.col("idf")).alias("w"))
                parts.append(self.spared(queries, self.index.find(Wanted(leaf.fields, expansions=(leaf.expansion,)))).join(terms, "term"))
        if not parts:
            return None
        found = reduce(DataFrame.unionByName, [p.select("path", "leaf", "term", "field", "tf", "len", "w") for p in parts])
        part = field_weight(self.params, self.index.stats, F.col("field"), F.col("tf"), F.col("len"))
        return found.select("path", "leaf", "term", "field", "tf", "len", "w", part.alias("part"))

    def seed(self, queries: list[Query]) -> Leaf | None:
        """Of the leaves that one query's matches must have, the rarest, if it leaves out most of the others' postings."""
        if len(queries) != 1:
            return None
        leaves, must = queries[0].plan.leaves, required(queries[0].plan.root)
        must = [leaf for leaf in must if leaf.expansion is None]  # how many postings these have was not looked up
        if not must:
            return None
        cost = lambda leaf: sum(leaf.postings[t] for t in set(leaf.seeds))
        best = min(must, key=lambda leaf: (cost(leaf), leaf.number))
        rest = sum(sum(leaf.postings.values()) for leaf in leaves) - cost(best)
        return best if cost(best) <= SEED_PATHS and cost(best) * SEED_GAIN <= rest else None

    def postings_for(self, queries: list[Query], terms: set[str], fields: set[int]) -> DataFrame:
        """The postings of ``terms`` in ``fields``; where a rare leaf is required, only those of documents that it may match, so no frequent term is shuffled whole."""
        return self.spared(queries, self.index.find(Wanted(tuple(sorted(fields)), tuple(sorted(terms)))))

    def spared(self, queries: list[Query], found: DataFrame) -> DataFrame:
        seed = self.seed(queries)
        if seed is None:
            return found
        paths = self.index.find(Wanted(seed.fields, tuple(sorted(seed.seeds)))).select("path")
        return found.join(F.broadcast(paths), "path", "left_semi")  # at most SEED_PATHS, by the dictionary's count

    def term_score(self):
        """Of one term and document, over its fields: saturation comes after their sum."""
        total = F.sum("part")
        return F.first("w") * total / (F.lit(self.params.k1) + total)

    def phrase_rows(self, queries: list[Query]) -> DataFrame | None:
        """(path, leaf) of the phrases that match in some field."""
        leaves = [leaf for leaf in self.leaves(queries) if leaf.groups]
        if not leaves:
            return None
        terms = sorted({t for leaf in leaves for g in leaf.groups for t in g})
        fields = sorted({f for leaf in leaves for f in leaf.fields})
        found = self.postings_for(queries, set(terms), set(fields)).select("path", "field", "term", "positions")
        places = found.groupBy("path", "field").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))
        yes = F.filter(F.array(*[F.when(phrase_column(leaf), F.lit(leaf.number)) for leaf in leaves]), lambda x: x.isNotNull())
        return places.select("path", F.explode(yes).alias("leaf")).distinct()

    def scored(self, queries: list[Query]) -> DataFrame:
        """A row for each document that may match, with a matched and a score column for each leaf.

        All postings of a document meet in one shuffle by path. Documents are
        read only for filters, deletes, or queries that a document without any
        of their terms can match.
        """
        roots = [x.plan.root for x in queries]
        columns, parts = [], []
        if (rows := self.term_rows(queries)) is not None:
            by_term = rows.repartition("path").groupBy("path", "leaf", "term").agg(self.term_score().alias("score"))
            parts.append(by_term.select("path", "leaf", "score"))
        if (rows := self.phrase_rows(queries)) is not None:
            parts.append(rows.select("path", "leaf", F.lit(0.0).alias("score")))
        for leaf in self.leaves(queries):
            mine = F.col("leaf") == leaf.number
            columns.append(F.coalesce(F.max(mine), F.lit(False)).alias(matched(leaf)))
            if leaf.scores:
                columns.append(F.sum(F.when(mine, F.col("score")).otherwise(0.0)).alias(scored(leaf)))
        found = None
        if parts:
            both = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
            found = both.groupBy("path").agg(*columns)
        docs = self.index.live.select("path", "ext", "size", "mtime")
        if found is None:
            return docs
        if not all(map(needs_a_leaf, roots)):
            return docs.join(found, "path", "left")
        if self.index.has_deletes or any(map(has_filter, roots)):
            return found.join(docs, "path")
        return found

    def search_many(self, queries: list[str], k: int = 10) -> DataFrame:
        """The best k of each query in one job: query, rank, path, score, total. One scan of the postings serves all."""
        bound = [self.query(q) for q in queries]
        for x, plan in zip(bound, self.bind(bound), strict=True):
            x.plan = plan
        found = self.scored(bound)
        each = F.filter(
            F.array(*[F.when(match_column(x.plan.root), F.struct(F.lit(q).alias("q"), score_column(x.plan.root).alias("score"))) for q, x in enumerate(bound)]),
            lambda x: x.isNotNull(),
        )
        rows = found.select("path", F.explode(each).alias("x")).select("path", "x.q", "x.score")
        totals = rows.groupBy("q").agg(F.count(F.lit(1)).alias("total"))
        order = Window.partitionBy("q").orderBy(F.round("score", SCORE_DIGITS).desc(), F.col("path"))
        best = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = self.index.docs.sparkSession.createDataFrame(list(enumerate(queries)), "q int, query string")
        return best.join(totals, "q").join(F.broadcast(names), "q").select("query", "rank", "path", "score", "total")
