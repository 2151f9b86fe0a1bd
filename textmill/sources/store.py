"""An index on disk: immutable generations of Parquet tables, and one manifest that names those that count.

A commit writes new segment folders and a new manifest beside the old, and
renames the manifest into place: the rename is the commit. Readers keep the
manifest that they opened. Folders that no manifest names are left-overs.
"""

from __future__ import annotations

import json
import math
import os
import re
import shutil
import socket
import threading
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.index import LENGTHS, POSTINGS, Index, dictionary_of, postings_of, with_lengths

#: Bodies above this many bytes are indexed but not stored.
STORED_BODY = 1 << 20
#: Segments that make a merge, in one tier of like size; tiers grow by this factor from TIER_BYTES on.
FAN_IN, TIER_BYTES = 8, 8 << 10
HEARTBEAT_S, STALE_S = 5, 30
#: Deleted paths that are broadcast at most; of more, Spark decides how they meet what they leave out.
GONE_PATHS = 1_000_000
_POSTING = ("field", "term", "path", "tf", "positions", "len")
DOCS = "path string, title string, body string, ext string, size bigint, mtime bigint, sha256 string, len_path int, len_title int, len_body int"


class Locked(RuntimeError):
    pass


@dataclass
class Manifest:
    generation: int = 0
    segments: list[str] = field(default_factory=list)
    deletes: list[str] = field(default_factory=list)


class Conflict(RuntimeError):
    """Another writer has committed, or taken the lock, since this one read the manifest."""


class WriterLock:
    """One writer at a time: a file made exclusively, kept fresh by a thread of its holder, taken over when stale."""

    def __init__(self, file: Path):
        self.file, self.token = file, f"{socket.gethostname()}:{os.getpid()}:{uuid.uuid4().hex}"
        self._ended = threading.Event()

    def __enter__(self):
        for _ in range(2):
            try:
                with open(self.file, "x") as f:
                    f.write(self.token)
            except FileExistsError:
                if not self._take_away():
                    break
                continue
            self._ended.clear()
            threading.Thread(target=self._keep_fresh, args=(self._ended,), daemon=True).start()
            return self
        raise Locked(f"another writer holds {self.file}")

    def _take_away(self) -> bool:
        """Remove the lock if it is stale; it is renamed first, so of several takers one gets it."""
        aside = self.file.with_name(f"{self.file.name}.{uuid.uuid4().hex}")
        try:
            token = self.file.read_text()
            if time.time() - self.file.stat().st_mtime <= STALE_S:
                return False
            os.rename(self.file, aside)
        except FileNotFoundError:
            return True
        taken = aside.read_text()
        if taken != token:  # not the stale one: another taker's, made meanwhile
            try:
                os.link(aside, self.file)
            except FileExistsError:
                pass
        aside.unlink()
        return taken == token

    def _keep_fresh(self, ended: threading.Event) -> None:
        while not ended.wait(HEARTBEAT_S) and self.held():
            self.beat()

    def held(self) -> bool:
        try:
            return self.file.read_text() == self.token
        except FileNotFoundError:
            return False

    def beat(self) -> None:
        if self.held():
            os.utime(self.file)

    def __exit__(self, *_):
        self._ended.set()
        if self.held():
            self.file.unlink(missing_ok=True)


class Store:
    def __init__(self, spark: SparkSession, folder: str | Path):
        self.spark, self.folder = spark, Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)
        self.manifest, self._lock = self._load(), None
        self._counted: tuple[list[str], dict[str, int]] = ([], {})

    def _load(self) -> Manifest:
        file = self.folder / "manifest.json"
        return Manifest(**json.loads(file.read_text())) if file.exists() else Manifest()

    def refresh(self) -> Store:
        self.manifest = self._load()
        return self

    def lock(self) -> WriterLock:
        self._lock = WriterLock(self.folder / "write.lock")
        return self._lock

    def _read(self, names: list[str], part: str, schema: str) -> DataFrame:
        paths = [f"file://{(self.folder / n / part).absolute()}" for n in names]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def _segments(self, part: str, schema: str) -> DataFrame:
        """The rows of all segments with the segment's name: one scan, however many segments there are."""
        if not self.manifest.segments:
            return self.spark.createDataFrame([], schema + ", segment string")
        return self._read(self.manifest.segments, part, schema).withColumn("segment", F.substring_index(F.substring_index("_metadata.file_path", "/", -3), "/", 1))

    def _deleted(self) -> DataFrame:
        return self._read(self.manifest.deletes, "", "path string, segment string")

    def _lost(self) -> dict[str, int]:
        """By segment, how many of its documents are deleted."""
        if self._counted[0] != self.manifest.deletes:
            rows = self._deleted().groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a segment
            self._counted = (list(self.manifest.deletes), {r["segment"]: r["n"] for r in rows})
        return self._counted[1]

    def _gone(self, segment: str | None = None) -> DataFrame:
        """(path, segment) of what is deleted, or the paths of one segment."""
        gone = self._deleted().distinct() if segment is None else self._deleted().where(F.col("segment") == segment).select("path").distinct()
        n = sum(self._lost().values()) if segment is None else self._lost()[segment]
        return F.broadcast(gone) if n <= GONE_PATHS else gone

    def _postings(self, names: list[str]) -> DataFrame:
        """Postings of live documents. Segments that have lost none are one scan; each other is one, and needs no name on its rows to leave out its own."""
        lost = self._lost() if self.manifest.deletes else {}
        whole = [n for n in names if n not in lost]
        parts = [self._read(whole, "postings", POSTINGS)] if whole or not names else []
        parts += [self._read([n], "postings", POSTINGS).join(self._gone(n), "path", "left_anti").select(*_POSTING) for n in names if n in lost]
        return reduce(DataFrame.unionByName, parts)

    def _docs(self) -> DataFrame:
        docs = self._segments("docs", DOCS)
        if not self.manifest.deletes:
            return docs.withColumn("live", F.lit(True))
        gone = self._gone().withColumn("gone", F.lit(True))
        return docs.join(gone, ["path", "segment"], "left").withColumn("live", F.col("gone").isNull()).drop("gone")

    def index(self) -> Index:
        """The generation that this store has open. A deleted document's postings count, but find nothing."""
        postings = self._postings(self.manifest.segments)  # a path can be in two segments, dead in the older
        docs = self._docs()
        dictionary = self._segments("dict", "field tinyint, term string, df bigint, total_tf bigint").groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("total_tf").alias("total_tf"))
        return Index(docs.drop("segment"), postings, dictionary, bool(self.manifest.deletes))

    def state(self) -> DataFrame:
        """(path, size, mtime, sha256) of live documents."""
        return self._docs().where("live").select("path", "size", "mtime", "sha256")

    def _write_segment(self, docs: DataFrame, postings: DataFrame | None = None) -> str:
        name = f"seg-{self.manifest.generation + 1:08d}-{uuid.uuid4().hex[:8]}"
        at = f"file://{(self.folder / name).absolute()}"
        stored = F.when(F.octet_length("body") <= STORED_BODY, F.col("body"))
        whole = with_lengths(docs) if postings is None else docs
        made = postings_of(docs) if postings is None else postings

        def write_docs() -> None:
            whole.withColumn("body", stored).select("path", "title", "body", "ext", "size", "mtime", "sha256", *LENGTHS).write.parquet(f"{at}/docs")

        def write_postings() -> None:
            # each file by term, so that a query's terms are found by the pages' least and greatest terms. Files follow the documents:
            # no posting is shuffled, and none is made a second time for ranges of terms
            made.sortWithinPartitions("field", "term").write.parquet(f"{at}/postings")
            kept = self._read([name], "postings", POSTINGS)
            dictionary_of(kept).sortWithinPartitions("field", "term").write.parquet(f"{at}/dict")

        with ThreadPoolExecutor(2) as both:  # neither waits for the other's last tasks
            for done in [both.submit(inheritable_thread_target(self.spark)(f)) for f in (write_docs, write_postings)]:
                done.result()
        return name

    def _commit(self, new: Manifest) -> None:
        new.generation = self.manifest.generation + 1
        temp = self.folder / f"manifest.{new.generation}.tmp"
        with open(temp, "w") as f:
            json.dump(new.__dict__, f)
            f.flush()
            os.fsync(f.fileno())
        if self._lock is not None and not self._lock._ended.is_set() and not self._lock.held():
            raise Conflict(f"another writer took over {self._lock.file}")
        if self._load().generation != self.manifest.generation:
            raise Conflict(f"generation {self.manifest.generation} is not the newest any more")
        os.replace(temp, self.folder / "manifest.json")
        self.manifest = new

    def recover(self) -> list[str]:
        """Remove what commits that never came to their rename have left: parts of generations beyond the manifest's.

        For the one writer. Segments that a merge replaced stay, as readers may
        have them open; :meth:`vacuum` removes these.
        """
        gone = []
        for name in self.refresh().orphans():
            at = re.match(r"(?:seg-|del-|manifest\.)(\d+)", name)
            if at and int(at[1]) > self.manifest.generation:
                p = self.folder / name
                shutil.rmtree(p) if p.is_dir() else p.unlink()
                gone.append(name)
        return gone

    @staticmethod
    def _last(docs: DataFrame) -> DataFrame:
        """One row a path: the last by ``seq``. Repeated paths without it are refused, as which row is the last would be chance."""
        again = docs.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if again.isEmpty():
            return docs.drop("seq")
        if "seq" not in docs.columns:
            raise ValueError("paths repeat; a column seq must say which row of a path is the last")
        order = Window.partitionBy("path").orderBy(F.col("seq").desc())
        return docs.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "seq")

    def commit(self, docs: DataFrame | None = None, deletes: DataFrame | None = None) -> int:
        """Add or replace ``docs`` (of rows with one path the last by ``seq`` counts) and delete paths, in one generation."""
        self.recover()
        segments, dead = list(self.manifest.segments), list(self.manifest.deletes)
        gone = deletes.select("path") if deletes is not None else None
        if docs is not None:
            docs = docs.where(F.col("path") != "")
            docs = self._last(docs)
            if "sha256" not in docs.columns:
                docs = docs.withColumn("sha256", F.sha2(F.coalesce("body", F.lit("")), 256))
            gone = docs.select("path") if gone is None else gone.union(docs.select("path"))
        if gone is not None and segments:
            name = f"del-{self.manifest.generation + 1:08d}-{uuid.uuid4().hex[:8]}"
            old = self._docs().where("live").select("path", "segment").join(gone.distinct(), "path", "left_semi")
            old.write.parquet(f"file://{(self.folder / name).absolute()}")
            if self._read([name], "", "path string, segment string").isEmpty():
                shutil.rmtree(self.folder / name)
            else:
                dead.append(name)
        if docs is not None:
            segments.append(self._write_segment(docs))
        self._commit(Manifest(segments=segments, deletes=dead))
        return self.manifest.generation

    def _merge(self, names: list[str]) -> None:
        """One segment of the live rows of ``names``: postings are copied, never made anew from stored bodies."""
        keep = [n for n in self.manifest.segments if n not in names]
        docs = self._docs().where("live").where(F.col("segment").isin(names))
        merged = self._write_segment(docs.drop("live", "segment"), self._postings(names))
        # deletes of merged segments have been carried out; those of others stay
        dead = self.manifest.deletes if keep else []
        self._commit(Manifest(segments=[*keep, merged], deletes=list(dead)))

    def compact(self) -> int:
        """All segments to one, without deleted documents; the statistics are then those of live documents."""
        self.recover()
        if self.manifest.segments:
            self._merge(list(self.manifest.segments))
        return self.manifest.generation

    def size_of(self, name: str) -> int:
        return sum(p.stat().st_size for p in (self.folder / name).rglob("*") if p.is_file())

    def merge_candidates(self) -> list[str]:
        """FAN_IN segments of the lowest tier that has so many; else, of FAN_IN segments or more, the smallest."""
        sizes = sorted((self.size_of(n), n) for n in self.manifest.segments)
        tiers: dict[int, list[str]] = {}
        for size, name in sizes:
            tiers.setdefault(max(0, int(math.log(max(size, 1) / TIER_BYTES, FAN_IN))) if size > TIER_BYTES else 0, []).append(name)
        for t in sorted(tiers):
            if len(tiers[t]) >= FAN_IN:
                return tiers[t][:FAN_IN]
        return [n for _, n in sizes[:FAN_IN]] if len(sizes) >= FAN_IN else []

    def maybe_merge(self) -> bool:
        self.recover()
        names = self.merge_candidates()
        if names:
            self._merge(names)
        return bool(names)

    def orphans(self) -> list[str]:
        named = {*self.manifest.segments, *self.manifest.deletes}
        return sorted(p.name for p in self.folder.iterdir() if p.name.startswith(("seg-", "del-", "manifest.")) and p.name != "manifest.json" and p.name not in named)

    def vacuum(self) -> list[str]:
        """Remove what no manifest names; only safe while no other writer is at work."""
        gone = self.refresh().orphans()
        for name in gone:
            p = self.folder / name
            shutil.rmtree(p) if p.is_dir() else p.unlink()
        return gone

    def stats(self) -> dict:
        row = self.index().summary().first().asDict()
        return row | {"generation": self.manifest.generation, "segments": len(self.manifest.segments), "bytes": sum(self.size_of(n) for n in self.manifest.segments)}

    def check(self) -> list[str]:
        """What is wrong with the open generation; nothing, if it is sound."""
        wrong = [f"segment {n} is missing" for n in [*self.manifest.segments, *self.manifest.deletes] if not (self.folder / n).exists()]
        if wrong:
            return wrong
        docs, postings = self._segments("docs", DOCS), self._segments("postings", POSTINGS)
        # a file has documents' postings together, so most of this sum is made before it is shuffled
        fields = postings.groupBy("path", "segment", "field").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("tf") != F.size("positions"), 1)).alias("odd"), F.sum("tf").alias("tf"), F.first("len").alias("len"))
        known = docs.select("path", "segment", F.lit(True).alias("known")).distinct()
        sums = fields.join(known, ["path", "segment"], "left").agg(
            F.sum(F.when(F.col("known").isNull(), F.col("n"))).alias("postings without a document"), F.sum("odd").alias("postings whose tf is not their number of positions"),
            F.count(F.when(F.col("tf") != F.col("len"), 1)).alias("fields whose tf do not add up to their length"),
        )
        wrong += [f"{n} {what}" for what, n in sums.first().asDict().items() if n]
        tests = {
            "paths that are live twice": self._docs().where("live").groupBy("path").count().where("count > 1"),
            "dictionary entries that differ from the postings": dictionary_of(postings).join(self._segments("dict", "field tinyint, term string, df bigint, total_tf bigint").groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("total_tf").alias("total_tf")), ["field", "term", "df", "total_tf"], "left_anti"),
        }
        for what, rows in tests.items():
            if n := rows.count():
                wrong.append(f"{n} {what}")
        return wrong + [f"left over: {n}" for n in self.orphans()]
