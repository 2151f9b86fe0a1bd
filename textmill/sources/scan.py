"""Folders to documents: the driver begins the listing, executors do the rest.

The driver walks names until there are enough folders to deal out, each with the
ignore rules above it; tasks walk what is below. Bytes are read, hashed, sniffed
and extracted in tasks, and the comparison with what is indexed already is a
join.
"""

from __future__ import annotations

import os
import pickle
import stat
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .extract import DOCX, docx_text, extension, extract, sniff
from .ignore import Levels, folder_rules, levels_of

MAX_SIZE = 2 << 20
SKIPS = ("ignored", "too_large", "binary", "non_utf8", "symlink", "read_error", "outside_root")
#: Folders, or files, that the driver lists before tasks go on.
FOLDERS, DRIVER_ROWS = 256, 10_000
#: Names of one folder that are looked at together; a folder that the driver opens and that has more is dealt out in parts.
PART_NAMES = 2_000
FILES = "path string, full string, size bigint, mtime bigint, skip string"
STATE = "path string, size bigint, mtime bigint, sha256 string"


class ScanError(OSError):
    """No root could be read; deleting everything that was under them would be wrong."""


@dataclass
class Scan:
    """Documents (path, title, body, ext, size, mtime, sha256), what was skipped (path, skip), and the roots that were read."""

    docs: DataFrame
    skipped: DataFrame
    roots: list[str] = field(default_factory=list)
    kept: tuple[DataFrame, ...] = ()
    #: Files that were not read, as size and time are those of a known state: path, mtime, sha256.
    same: DataFrame | None = None

    def release(self) -> None:
        """Forget the names and contents that the executors keep for the two results; read again, they are made again."""
        for rows in self.kept:
            rows.unpersist()

    def skip_counts(self) -> DataFrame:
        return self.skipped.groupBy("skip").agg(F.count(F.lit(1)).alias("files"))

    def diff(self, state: DataFrame) -> DataFrame:
        """(path, change) against an index's state: add, update, mtime, unchanged or delete.

        Paths that are gone are deleted only under roots that were read.
        """
        now = self.docs.select("path", "mtime", "sha256")
        now = (now if self.same is None else now.unionByName(self.same)).toDF("path", "m", "s")
        before = state.select("path", "mtime", "sha256")
        both = now.join(before, "path", "full_outer")
        change = (
            F.when(F.col("s").isNull(), F.lit("delete")).when(F.col("sha256").isNull(), F.lit("add"))
            .when(F.col("s") != F.col("sha256"), F.lit("update")).when(F.col("m") != F.col("mtime"), F.lit("mtime")).otherwise(F.lit("unchanged"))
        )
        under = F.lit(False)
        for r in self.roots:
            under = under | (F.lit(True) if r in ("", ".") else (F.col("path") == r) | F.col("path").startswith(r + "/"))
        return both.select("path", change.alias("change")).where((F.col("change") != "delete") | under)


def relative(path: Path, base: Path) -> str | None:
    """``path`` as seen from ``base``, with forward slashes; None outside of it."""
    try:
        return path.absolute().relative_to(base.absolute()).as_posix()
    except ValueError:
        return None


class Walk:
    """Goes through folders; ``rows`` are those of FILES that it has met. Links are not followed."""

    def __init__(self, base: str | Path, max_size: int = MAX_SIZE, parts: list | None = None):
        self.base, self.max_size, self.rows, self.parts = Path(base).absolute(), max_size, [], parts

    def visit(self, full: Path, path: str, levels: Levels) -> list[tuple[Path, str, Levels]]:
        """A row for what is no folder; a folder that is not left out is returned."""
        try:
            info = full.lstat()
        except OSError:
            self.rows.append((path, str(full), None, None, "read_error"))
            return []
        if levels.ignored(path):
            self.rows.append((path, str(full), None, None, "ignored"))
        elif stat.S_ISLNK(info.st_mode):
            self.rows.append((path, str(full), None, None, "symlink"))
        elif stat.S_ISDIR(info.st_mode):
            return [(full, path, levels)]
        elif stat.S_ISREG(info.st_mode):
            self.rows.append((path, str(full), info.st_size, int(info.st_mtime), "too_large" if info.st_size > self.max_size else None))
        return []

    def open(self, folder: Path, path: str, levels: Levels) -> list[tuple[Path, str, Levels]] | None:
        """The folders in a folder; None if it can't be read."""
        try:
            names = sorted(os.listdir(folder))
        except OSError:
            self.rows.append((path, str(folder), None, None, "read_error"))
            return None
        inner = levels.below(folder_rules(folder, self.base))
        if self.parts is not None and len(names) > PART_NAMES:
            self.parts += [(folder, path, inner, names[k : k + PART_NAMES]) for k in range(0, len(names), PART_NAMES)]
            return []
        return self.look(folder, path, inner, names)

    def look(self, folder: Path, path: str, inner: Levels, names: list[str]) -> list[tuple[Path, str, Levels]]:
        return [x for name in names for x in self.visit(folder / name, f"{path}/{name}" if path else name, inner)]

    def begin(self, roots: list[str | Path]) -> tuple[list, list[str]]:
        """The folders in ``roots``, and the roots that could be read."""
        folders, read = [], []
        for root in (Path(r).absolute() for r in roots):
            path = relative(root, self.base)
            if path is None:
                self.rows.append((root.as_posix(), str(root), None, None, "outside_root"))
                continue
            path = "" if path == "." else path
            above = levels_of(path, self.base) if path else Levels()
            if root.is_dir():
                inner = self.open(root, path, above)
                if inner is not None:
                    folders += inner
                    read.append(path)
            elif root.exists():
                self.visit(root, path, above)
                read.append(path)
            else:
                self.rows.append((path, str(root), None, None, "read_error"))
        return folders, read

    def on(self, folders: list, most_folders: float = float("inf"), most_rows: float = float("inf")) -> list:
        """Open folders, level by level, while there are few; those that are left."""
        while folders and len(folders) < most_folders and len(self.rows) < most_rows:
            folders = folders[1:] + (self.open(*folders[0]) or [])
        return folders


def listing(roots: list[str | Path], base: str | Path, max_size: int = MAX_SIZE) -> tuple[list[tuple], list[str]]:
    """Files under ``roots`` as rows of FILES, in order of path, and the roots that could be read; all by this process."""
    walk = Walk(base, max_size)
    folders, read = walk.begin(roots)
    walk.on(folders)
    return sorted({r[0]: r for r in walk.rows}.values()), read


def _walk_on(base: Path, max_size: int):
    def run(batches):
        for x in batches:
            for folder in x.column(0).to_pylist():
                walk, work = Walk(base, max_size), pickle.loads(folder)
                left = walk.look(*work) if len(work) == 4 else [work]
                while left or walk.rows:  # some rows at a time, as a folder can have any number below it
                    left = walk.on(left, most_rows=10_000)
                    columns = list(zip(*walk.rows, strict=True)) or [[]] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["path", "full", "size", "mtime", "skip"])
                    walk.rows.clear()

    return run


def files_under(spark: SparkSession, roots: list[str | Path], base: str | Path, max_size: int = MAX_SIZE) -> tuple[DataFrame, list[str]]:
    """As :func:`listing`, but the driver goes no further than FOLDERS folders or DRIVER_ROWS files; tasks walk what is below."""
    walk = Walk(base, max_size, parts=[])
    folders, read = walk.begin(roots)
    if roots and not read:
        raise ScanError("no root could be read: " + ", ".join(map(str, roots)))
    folders = walk.on(folders, FOLDERS, DRIVER_ROWS) + walk.parts
    files = spark.createDataFrame(walk.rows, FILES)
    if folders:
        rest = spark.createDataFrame([(pickle.dumps(f),) for f in folders], "folder binary").repartition(len(folders))
        files = files.unionByName(rest.mapInArrow(_walk_on(walk.base, max_size), FILES))
    return files.dropDuplicates(["path"]) if len(roots) > 1 else files, read


def _read(batches):
    import hashlib

    for x in batches:
        out = []
        for path, full, size, mtime, ext in zip(*(x.column(k).to_pylist() for k in ("path", "full", "size", "mtime", "ext")), strict=True):
            try:
                data = Path(full).read_bytes()
            except OSError:
                out.append((path, ext, size, mtime, None, None, "read_error"))
                continue
            kind, text = sniff(data)
            if ext in DOCX and kind != "binary":
                try:
                    text = docx_text(data)
                except Exception:  # a broken archive is not a document
                    kind = "binary"
            skip = {"binary": "binary", "nonutf8": "non_utf8"}.get(kind)
            out.append((path, ext, len(data), mtime, hashlib.sha256(data).hexdigest(), None if skip else text, skip))
        names = ["path", "ext", "size", "mtime", "sha256", "text", "skip"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)


def scan(spark: SparkSession, roots: list[str | Path], base: str | Path, max_size: int = MAX_SIZE, partitions: int | None = None, known: DataFrame | None = None) -> Scan:
    """Read the files under ``roots``; paths are relative to ``base``. The tasks must see the same files as the driver.

    All files are read and hashed, unless a ``known`` state (path, size, mtime,
    sha256) is given: what has its size and time is then taken to be unchanged
    and is not read, so a change that keeps both goes unseen.
    """
    files, read = files_under(spark, roots, base, max_size)
    files = files.persist()  # walked once, for what is read and for what is skipped
    wanted = files.where(F.col("skip").isNull()).withColumn("ext", extension(F.col("path")))
    same = None
    if known is not None:
        same = wanted.join(known.select("path", "size", "mtime", "sha256"), ["path", "size", "mtime"]).select("path", "mtime", "sha256")
        wanted = wanted.join(same.select("path"), "path", "left_anti")
    n = partitions or spark.sparkContext.defaultParallelism
    # content is read once and kept for the two results
    contents = wanted.repartition(n, "path").mapInArrow(_read, "path string, ext string, size bigint, mtime bigint, sha256 string, text string, skip string").persist()
    docs = extract(contents.where(F.col("skip").isNull()).drop("skip")).select("path", "title", "body", "ext", "size", "mtime", "sha256")
    skipped = files.where(F.col("skip").isNotNull()).select("path", "skip").unionByName(contents.where(F.col("skip").isNotNull()).select("path", "skip"))
    return Scan(docs, skipped, read, (files, contents), same)
