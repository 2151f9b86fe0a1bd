"""Keeping an index up to date: a Structured Streaming query whose every trigger scans and commits the differences."""

from __future__ import annotations

import logging
import shutil
import threading
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.scan import MAX_SIZE, Scan, ScanError, scan
from ..sources.store import Conflict, Locked, Store

INTERVAL_S = 2.0
#: How long a stop waits for the batch in hand, and then for the query.
STOP_S = 60


def apply_changes(store: Store, found: Scan) -> dict[str, int]:
    """Commit what a scan says has changed, as one generation; nothing is committed if nothing has."""
    changes = found.diff(store.refresh().state()).persist()
    counts = {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}
    if set(counts) - {"unchanged"}:
        new = found.docs.join(changes.where("change in ('add', 'update', 'mtime')").select("path"), "path", "left_semi")
        has_new = any(counts.get(c) for c in ("add", "update", "mtime"))
        with store.lock():
            store.commit(new if has_new else None, changes.where("change = 'delete'") if counts.get("delete") else None)
            store.maybe_merge()
    changes.unpersist()
    return counts


class Watch:
    """A running watch. ``stop`` waits for the batch in hand, so that no commit is cut short."""

    def __init__(self):
        self.stopping, self.busy = threading.Event(), threading.Lock()
        self.query: StreamingQuery | None = None
        self.failures: list[str] = []
        self._state: Path | None = None

    def stop(self, timeout: float = STOP_S) -> None:
        """Batches that begin from now on do nothing; the lock is only passed through, as the query waits for its batch and a batch for the lock."""
        self.stopping.set()
        if self.busy.acquire(timeout=timeout):
            self.busy.release()
        self.query.stop()
        if self._state is not None:
            shutil.rmtree(self._state, ignore_errors=True)

    def awaitTermination(self, timeout: float | None = None) -> bool | None:
        return self.query.awaitTermination(timeout) if timeout is not None else self.query.awaitTermination()


def watch(spark: SparkSession, store: Store, roots: list[str | Path], base: str | Path, interval_s: float = INTERVAL_S, max_size: int = MAX_SIZE, debounce: bool = True, on_commit=None, trust_times: bool = False) -> Watch:
    """Start watching.

    File sources don't see deletions, so a clock drives the batches and each
    compares the folders with the index. With ``debounce``, changes wait until a
    scan finds the same as the one before; what is committed is the latest. With
    ``trust_times``, files of known size and time are not read again. A
    scan that can read no root, or a lock that another writer holds, is kept in
    ``failures`` and tried again at the next trigger.
    """
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    last: list[tuple] = []
    running = Watch()
    # the clock's offsets; beside the index, where all machines of a cluster see them
    running._state = store.folder / f"watch-{uuid.uuid4().hex}"

    def batch(_: DataFrame, number: int) -> None:
        with running.busy:
            if running.stopping.is_set():
                return
            try:
                step()
            except (ScanError, Locked, Conflict) as e:
                last.clear()
                running.failures.append(str(e))
                logging.getLogger(__name__).warning("nothing committed, to be tried again: %s", e)

    def step() -> None:
        found = scan(spark, roots, base, max_size, known=store.refresh().state() if trust_times else None)
        try:
            if debounce:
                changes = found.diff(store.refresh().state()).where("change <> 'unchanged'")
                # of the names and hashes of what has changed since the last commit, their number and two sums stand for them
                each = changes.join(found.docs.select("path", "sha256"), "path", "left")
                sums = [F.coalesce(F.sum(F.xxhash64("path", "change", F.coalesce("sha256", F.lit("")), F.lit(k)).cast("decimal(20,0)")), F.lit(0)) for k in range(2)]
                now = tuple(each.agg(F.count(F.lit(1)), *sums).first())
                settled = bool(last) and last[0] == now
                last[:] = [now]
                if not now[0] or not settled:
                    return
            counts = apply_changes(store, found)
        finally:
            found.release()
        if on_commit:
            on_commit(counts)

    before = spark.conf.get("spark.sql.streaming.stopTimeout", None)
    spark.conf.set("spark.sql.streaming.stopTimeout", f"{STOP_S}s")  # a query reads it when it starts
    try:
        running.query = clock.writeStream.foreachBatch(batch).option("checkpointLocation", f"file://{running._state.absolute()}").trigger(processingTime=f"{interval_s} seconds").start()
    finally:
        spark.conf.unset("spark.sql.streaming.stopTimeout") if before is None else spark.conf.set("spark.sql.streaming.stopTimeout", before)
    return running
