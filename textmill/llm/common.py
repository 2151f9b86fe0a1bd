"""Helpers that the training-data operators share.

Nothing here depends on the data's size: the values that reach the driver are
counts, and the only broadcast is the one in :func:`lookup`, whose number of
rows is bounded by arithmetic.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import os
import re
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch that holds whole texts; long texts make the bytes count.
BATCH_ROWS, BATCH_BYTES = 10_000, 2 << 20
#: Bytes of text that numpy works on at a time; its arrays take some ten times as much. A longer text is a slice of its own.
SLICE_BYTES = 256 << 10
#: Short rows of a checkpoint's file, and bytes of text tables that make an output's file, in about.
FILE_ROWS, FILE_BYTES = 1_000_000, 16 << 20
#: A key with this share of all rows, or more, is looked up by broadcast; so at most HOT_SHARE keys are.
HOT_SHARE = 1000


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches of ``spark`` and make sure that checkpoint() has a folder.

    The folder is the one that the cluster names in ``spark.checkpoint.dir``;
    only where none is named and the master is local, as in tests, a local one
    is set. Executors elsewhere could not read that one, so there it is an error.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "textmill-checkpoints"))
    return spark


def slices(batches, column: int = 0, size: int = SLICE_BYTES):
    """The rows of Arrow batches in their order, as batches of ``size`` bytes of text in ``column`` at most."""
    for x in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(x.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        done = 0
        while done < x.num_rows:
            upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + size, "right")))
            yield x.slice(done, upto - done)
            done = upto


def _trim() -> None:
    """Give freed memory back to the system: Spark reuses workers, and what one stage took would count in the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(run):
    """``run``, a function of a task's batches, which leaves no freed memory with the worker when the task ends."""

    @functools.wraps(run)
    def wrapper(batches):
        try:
            yield from run(batches)
        finally:
            _trim()

    return wrapper


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _tasks(spark: SparkSession, enough: int) -> int:
    return max(2 * spark.sparkContext.defaultParallelism, enough)


def saved(rows: DataFrame, at_most: int | None) -> DataFrame:
    """A checkpoint of short rows, ``at_most`` so many where that is known, in files by their number and not by the shuffle's partitions."""
    if at_most is None:
        return rows.checkpoint()
    return rows.coalesce(_tasks(rows.sparkSession, -(-at_most // FILE_ROWS))).checkpoint()


def _compressed(x: pa.RecordBatch) -> pa.Array:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, x.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(x)
    return pa.array([out.getvalue().to_pybytes()], pa.binary())


def _pack(batches):
    for x in batches:
        if x.num_rows:
            yield pa.RecordBatch.from_arrays([_compressed(x)], ["batch"])


def _unpack(batches):
    for x in batches:
        for blob in x.column(0):
            yield from pa.ipc.open_stream(blob.as_buffer())


def packed(rows: DataFrame) -> DataFrame:
    """A checkpoint of short rows in compressed Arrow batches, a third or less of a plain one's bytes."""
    with freeing(rows.sparkSession):
        return rows.mapInArrow(trimmed(_pack), "batch binary").checkpoint().mapInArrow(_unpack, rows.schema)


def in_parts(x: pa.RecordBatch, part: np.ndarray):
    """The rows of ``x`` by part, as :class:`Dealt` takes them."""
    for p in np.unique(part):
        mine = x.filter(pa.array(part == p))
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([mine.num_rows], pa.int64()), _compressed(mine)], ["part", "n", "batch"])


class Dealt:
    """A checkpoint like that of :func:`packed`, of rows in parts, which may differ in their columns; parts that are not asked for are not unpacked."""

    SCHEMA = "part int, n bigint, batch binary"

    def __init__(self, batches: DataFrame):
        with freeing(batches.sparkSession):
            self._batches = batches.checkpoint()

    @classmethod
    def by(cls, rows: DataFrame, part) -> Dealt:
        """``rows`` by the integer column ``part``, which is not kept."""

        def run(batches):
            for x in batches:
                yield from in_parts(x.select(x.schema.names[:-1]), x.column(x.num_columns - 1).to_numpy())

        return cls(rows.withColumn("_part", part.cast("int")).mapInArrow(trimmed(run), cls.SCHEMA))

    def of(self, parts, schema) -> DataFrame:
        return self._batches.where(F.col("part").isin(*parts)).select("batch").mapInArrow(_unpack, schema)

    def numbers(self) -> dict[int, int]:
        """How many rows each part has that has any."""
        return dict(self._batches.groupBy("part").agg(F.sum("n")).collect())


def forget(spark: SparkSession) -> None:
    """Let Spark's cleaner see which tables nobody holds any longer: it deletes shuffles, and checkpoints where it may, only after a collection on the driver."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def freeing(spark: SparkSession):
    """What is made and run within gives its shuffles' files back when it ends; not for tables that are read twice."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def compact(rows: DataFrame, source: DataFrame) -> DataFrame:
    """``rows``, made of ``source``, in partitions of about FILE_BYTES of it, so that many small ones don't leave as many small files."""
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # of files, by their length; else an upper bound
    return rows.coalesce(min(_tasks(rows.sparkSession, -(-size // FILE_BYTES)), 1 << 30))


def buckets(n_rows: int, per_bucket: int, least: int = 64) -> int:
    """How many buckets hold ``n_rows`` at about ``per_bucket`` each; the work is dealt by bucket."""
    return max(least, -(-n_rows // per_bucket))


def identity(text) -> list:
    """Columns that name a text: SHA-256, XXH64 and length together."""
    return [F.sha2(text, 256).alias("_sha"), F.xxhash64(text).alias("_xx"), F.octet_length(text).alias("_len")]


def lookup(rows: DataFrame, found: DataFrame, key: list[str], weight: str, total: int, spread: str) -> DataFrame:
    """``rows`` left-joined to ``found`` on ``key``, whatever share of the rows one key has.

    ``found`` has one row for each key, and ``weight`` says how many of the
    ``total`` rows have that key. Keys with a ``HOT_SHARE``-th of the rows or
    more are joined by broadcast: the weights add up to ``total``, so there are
    at most ``HOT_SHARE`` of them. All other rows meet by shuffle; the rows that
    are done already get a key of their own from ``spread`` and so scatter.
    """
    values = [c for c in found.columns if c not in key]
    is_hot = F.col(weight) * HOT_SHARE >= F.lit(total)
    hot = found.where(is_hot).select(*key, F.struct(*values).alias("_hot"))
    rest = found.where(~is_hot).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], F.lit("").alias("_scatter_to"), F.struct(*values).alias("_rest"))
    out = rows.join(F.broadcast(hot), key, "left")
    out = out.withColumn("_scatter", F.when(F.col("_hot").isNull(), F.lit("")).otherwise(F.concat(F.lit("#"), F.coalesce(F.col(spread).cast("string"), F.lit("")))))
    on = (F.col("_scatter") == F.col("_scatter_to"))
    for i, c in enumerate(key):
        on = on & (F.col(c) == F.col(f"_k{i}"))
    out = out.join(rest, on, "left")
    both = F.coalesce(F.col("_hot"), F.col("_rest"))
    return out.select(*rows.columns, *[both[c].alias(c) for c in values])


def numbered(rows: DataFrame, within: list[str], order: list[str], n_buckets: int, name: str, spread: str) -> DataFrame:
    """``rows`` with ``name``: 0, 1, 2... within each value of ``within``, in no more than one shuffle of the rows.

    A value with a third of all rows is no trouble: its rows are split into
    ``n_buckets`` buckets by a hash of ``spread``, numbered in each, and moved by
    the sum of the counts before. Only those counts are gathered by value.
    """
    from pyspark.sql import Window

    dealt = rows.withColumn("_b", F.pmod(F.xxhash64(F.col(spread)), F.lit(n_buckets)).cast("int"))
    by = [*within, "_b"]
    before = Window.partitionBy(*within).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).select(*by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = dealt.withColumn("_row", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    return inner.join(sums, by).withColumn(name, F.col("_row") + F.col("_before")).drop("_row", "_before", "_b")
