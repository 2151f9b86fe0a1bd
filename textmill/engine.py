"""One object for an index folder: index, search, explain, diagnose, maintain."""

from __future__ import annotations

import json
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .operators.rank import Params, Recency
from .operators.search import Searcher
from .operators.snippet import WIDTH, with_snippets
from .operators.whynot import Report, WhyNot
from .sources.scan import MAX_SIZE, scan
from .sources.store import Store
from .streaming.watch import apply_changes, watch


class Engine:
    """``folder`` is the index; paths are relative to the folder that it is in, unless ``base`` names another."""

    def __init__(self, spark: SparkSession, folder: str | Path, base: str | Path | None = None, params: Params = Params(), max_size: int = MAX_SIZE):
        self.spark, self.store, self.params, self.max_size = spark, Store(spark, folder), params, max_size
        self.base = Path(base) if base is not None else Path(folder).absolute().parent
        self._searcher: tuple[int, Searcher] | None = None

    @property
    def searcher(self) -> Searcher:
        """For the newest generation; kept while that is the newest."""
        generation = self.store.refresh().manifest.generation
        if self._searcher is None or self._searcher[0] != generation:
            self._searcher = (generation, Searcher(self.store.index(), self.params))
        return self._searcher[1]

    def index(self, what: DataFrame | list[str | Path]) -> dict[str, int]:
        """Add documents of a DataFrame, or bring the index up to date with folders; what has changed, and what was skipped."""
        if isinstance(what, DataFrame):
            with self.store.lock():
                self.store.commit(what)
                self.store.maybe_merge()
            return {"generation": self.store.manifest.generation}
        found = scan(self.spark, what, self.base, self.max_size)
        try:
            counts = apply_changes(self.store, found)
            return counts | {f"skipped_{r['skip']}": r["files"] for r in found.skip_counts().collect()}
        finally:
            found.release()

    def delete(self, paths: DataFrame) -> None:
        with self.store.lock():
            self.store.commit(None, paths)

    def search(self, query: str, k: int = 10, recency: Recency | None = None) -> DataFrame:
        return self.searcher.search(query, k, recency)

    def search_with_snippets(self, query: str, k: int = 10, recency: Recency | None = None, width: int = WIDTH, utf16: bool = False) -> DataFrame:
        q = self.searcher.query(query)
        return with_snippets(q.hits(k, recency), self.searcher.index.live, q.node, width, utf16)

    def explain(self, query: str, k: int = 10, recency: Recency | None = None) -> DataFrame:
        return self.searcher.query(query).explain(k, recency)

    def results(self, query: str, k: int = 10, recency: Recency | None = None, explain: bool = False, utf16: bool = False) -> dict:
        """What the command line and the HTTP interface show: hits, total, truncated, query."""
        q = self.searcher.query(query)
        hits = [r.asDict(recursive=True) for r in self.search_with_snippets(query, k, recency, utf16=utf16).collect()]
        if explain:
            why = {r["path"]: r.asDict(recursive=True) for r in q.explain(k, recency).collect()}
            hits = [h | {"explain": why.get(h["path"])} for h in hits]
        return {"query": query, "total": q.total().first()["total"], "truncated": q.truncated, "hits": hits}

    def why_not(self, query: str, path: str) -> Report:
        return WhyNot(self.searcher, self.base, self.max_size).diagnose(query, path)

    def document(self, path: str) -> dict | None:
        rows = self.searcher.index.live.where(self.searcher.index.live["path"] == path).select("path", "title", "body", "ext", "size", "mtime").limit(1).collect()
        return rows[0].asDict() if rows else None

    def watch(self, roots: list[str | Path], interval_s: float = 2.0, **options):
        return watch(self.spark, self.store, roots, self.base, interval_s, self.max_size, **options)

    def stats(self) -> dict:
        return self.store.refresh().stats()

    def check(self) -> list[str]:
        return self.store.refresh().check()

    def compact(self) -> int:
        with self.store.lock():
            return self.store.compact()


def recency_of(rate: float, half_life_days: float, now: int | None = None) -> Recency | None:
    return Recency(rate, half_life_days, int(time.time()) if now is None else now) if rate > 0 else None


def to_json(value) -> str:
    return json.dumps(value, ensure_ascii=False, indent=1, default=str)
