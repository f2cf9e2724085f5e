"""The store: puts and deletes, point and range reads, flush, compaction, recovery.

Small writes go through a synced log into a table in memory. A full table is frozen, with its log, and a thread makes a
run of it while writes go on into a new one; DataFrames of any size become runs, too, and one thread at a time merges
runs. Spark jobs hold no lock: their results are published under one, and reads take what is published. The manifest
names the runs, and replacing it is the only commit. Data may lie at any Hadoop path; the control files (manifest, log,
lock) lie in a folder of the driver's file system, by default the store's own.
"""

from __future__ import annotations

import logging
import os
import threading
import time
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import reads
from tidemark.operators.measures import ENTRY_OVERHEAD
from tidemark.operators.resolve import merge, resolve
from tidemark.plans import manifest as manifests
from tidemark.plans.lock import DirectoryLock
from tidemark.plans.manifest import Manifest, Run
from tidemark.plans.policy import pick
from tidemark.schema import LIVE, OPS
from tidemark.sources import oplog
from tidemark.sources.runs import delete, listing, read_runs, union, write_options, write_run


@dataclass(frozen=True)
class Options:
    """memtable_bytes: when the table in memory is sealed. block_bytes: size of Parquet pages; row_group_bytes of row groups.

    bloom_bits_per_key: filters on keys, 0 for none. sync_writes: writes are on disk before they return. group_commit: one sync serves the
    writers that wait together. auto_compaction and compaction_min_runs: merge neighbours in age as soon as so many
    are alike in size. keep_replaced_s: for so many seconds a run that was merged stays, for frames made before the merge.
    """

    memtable_bytes: int = 64 << 20
    block_bytes: int = 64 << 10
    row_group_bytes: int = 32 << 20
    bloom_bits_per_key: int = 10
    sync_writes: bool = True
    group_commit: bool = True
    auto_compaction: bool = True
    compaction_min_runs: int = 4
    keep_replaced_s: float = 0.0

    def __post_init__(self):
        if self.compaction_min_runs < 2:
            raise ValueError("compaction_min_runs must be at least 2")
        if min(self.memtable_bytes, self.block_bytes, self.row_group_bytes) < 1:
            raise ValueError("sizes must be positive")


class StoreFailed(OSError):
    """A write or commit failed before; the store only serves reads until it is opened again."""


class Scan:
    """Rows of a range, in key order, fetched partition by partition; its runs stay until it is closed or has come to its end."""

    def __init__(self, store: Store, rows: DataFrame, lease: int):
        self._store, self._lease = store, lease
        self._rows: Iterator | None = rows.toLocalIterator()

    def __iter__(self) -> Scan:
        return self

    def __next__(self) -> tuple[bytes, bytes]:
        row = None if self._rows is None else next(self._rows, None)
        if row is None:
            self.close()
            raise StopIteration
        return bytes(row["key"]), bytes(row["value"])

    def close(self) -> None:
        """No further partition is computed."""
        if self._rows is not None:
            self._rows = None
            self._store.release(self._lease)

    def __enter__(self) -> Scan:
        return self

    def __exit__(self, *_) -> None:
        self.close()


class Snapshot:
    """The store as it is now, for any number of frames; its runs stay until it is closed."""

    def __init__(self, store: Store):
        self._store = store
        with store._lock:
            self._lease = store.lease()
            self._view = store._view()

    def ops(self, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        return self._store._frame(self._view, low, high)

    def read(self) -> DataFrame:
        return resolve(self.ops())

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return reads.multi_get(self.ops(), keys)

    def scan(self, low: bytes | None = None, high: bytes | None = None, limit: int | None = None) -> DataFrame:
        return reads.scan(self.ops(low, high), low, high, limit)

    def close(self) -> None:
        self._store.release(self._lease)

    def __enter__(self) -> Snapshot:
        return self

    def __exit__(self, *_) -> None:
        self.close()


#: Between the sequence numbers of a bulk write and those before it: what is flushed while its job runs is older than it.
_BULK_GAP = 1 << 32
_COUNTS = ("writes", "gets", "bloom_negatives", "run_reads", "log_syncs", "flushes", "compactions", "write_stalls", "runs_skipped")
_log = logging.getLogger(__name__)
Memory = dict[bytes, bytes | None]


class Store:
    """One writing process at a time, with any number of threads; readers see what was committed when their DataFrame was made."""

    def __init__(self, spark: SparkSession, path: str, options: Options | None = None, control: str | None = None):
        self.spark, self.path, self.options = spark, path.rstrip("/"), options or Options()
        self.control = control or self.path.removeprefix("file://")
        os.makedirs(self.control, exist_ok=True)
        #: Guards all fields, and is never held during a Spark job. Waits on it: for a flush, a merge, the store's end.
        self._lock = threading.Condition(threading.RLock())
        #: One bulk write at a time.
        self._bulk = threading.Lock()
        self._counts = dict.fromkeys(_COUNTS, 0)
        self._leases: dict[int, frozenset[str]] = {}
        self._replaced_at: dict[str, float] = {}
        self._next_lease, self._failed, self._closed = 0, None, False
        self._memory: Memory = {}
        self._memory_bytes = 0
        self._frozen: Memory | None = None
        self._merging = False
        self._owner = DirectoryLock(self.control)
        try:
            self._recover()
        except BaseException:
            self._owner.release()
            raise

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: Options | None = None, control: str | None = None) -> Store:
        store = cls(spark, path, options, control)
        store._schedule_merge()
        return store

    # recovery

    def _log_path(self, log_id: int) -> str:
        return os.path.join(self.control, f"{log_id:06d}{oplog.SUFFIX}")

    def _run_path(self, run_id: int) -> str:
        return f"{self.path}/runs/{run_id:06d}"

    def _recover(self) -> None:
        """Drop what no commit names, replay the logs, oldest first, into one run, and start a new log."""
        found = manifests.load(self.control) or Manifest()
        live = {r.path for r in found.runs}
        runs, logs = listing(self.spark, f"{self.path}/runs"), []
        highest = max([found.next_id - 1, *(int(n) for n in runs if n.isdigit())])
        for name in runs:
            if f"{self.path}/runs/{name}" not in live:
                delete(self.spark, f"{self.path}/runs/{name}")
        for name in sorted(os.listdir(self.control)):
            stem = name.removesuffix(oplog.SUFFIX)
            if name.endswith(oplog.SUFFIX) and stem.isdigit():
                highest = max(highest, int(stem))
                if int(stem) < found.log_id:
                    os.remove(os.path.join(self.control, name))
                else:
                    logs.append(name)
            elif name.endswith(".tmp"):
                os.remove(os.path.join(self.control, name))
        self._manifest = replace(found, next_id=highest + 1, obsolete=())
        for name in logs:
            with open(os.path.join(self.control, name), "rb") as f:
                for _, key, value in oplog.records(f):
                    self._remember(key, value)
        log_id = self._take_id()
        self._log = oplog.LogWriter(self._log_path(log_id), self.options.group_commit)
        run = self._write_memory(self._memory) if self._memory else None
        changed = replace(self._manifest, log_id=log_id, next_seq=self._manifest.next_seq + 1)
        self._commit(changed.prepended(run) if run else changed)
        self._memory, self._memory_bytes = {}, 0
        for name in logs:
            os.remove(os.path.join(self.control, name))

    def _take_id(self) -> int:
        got = self._manifest.next_id
        self._manifest = replace(self._manifest, next_id=got + 1)
        return got

    # writes

    def _check_usable(self) -> None:
        if self._closed:
            raise RuntimeError("the store is closed")
        if self._failed:
            raise StoreFailed("the store failed before") from self._failed

    def _remember(self, key: bytes, value: bytes | None) -> None:
        before = self._memory.pop(key, ...)
        self._memory_bytes += len(value or b"") - (len(before or b"") if before is not ... else -len(key) - ENTRY_OVERHEAD)
        self._memory[key] = value

    def _write(self, key: bytes, value: bytes | None) -> None:
        with self._lock:
            self._check_usable()
            self._make_room()
            log = self._log
            try:
                offset = log.append(key, value)
                if self.options.sync_writes and not self.options.group_commit:
                    log.sync(offset)
            except OSError as e:
                self._fail(e)
                raise
            self._remember(key, value)
            self._counts["writes"] += 1
        if self.options.sync_writes and self.options.group_commit:
            try:
                log.sync(offset)
            except OSError as e:
                self._fail(e)
                raise

    def _make_room(self) -> None:
        """Freeze a full table; while the one before it is still being written, wait."""
        while self._memory_bytes >= self.options.memtable_bytes:
            if self._frozen is None:
                self._rotate()
                return
            self._counts["write_stalls"] += 1
            self._lock.wait()
            self._check_usable()

    def _rotate(self) -> None:
        """The table in memory and its log are frozen, and a thread makes a run of them; a new log begins."""
        log_id = self._take_id()
        try:
            log = oplog.LogWriter(self._log_path(log_id), self.options.group_commit)
        except OSError as e:
            self._fail(e)
            raise
        old, self._log = self._log, log
        self._frozen, self._memory, self._memory_bytes = self._memory, {}, 0
        threading.Thread(target=self._flush_frozen, args=(old, log_id), name="tidemark-flush", daemon=True).start()

    def _flush_frozen(self, old: oplog.LogWriter, log_id: int) -> None:
        try:
            old.close()
            run = self._write_memory(self._frozen)
            with self._lock:
                changed = replace(self._manifest, log_id=log_id, next_seq=self._manifest.next_seq + 1)
                self._commit(changed.prepended(run) if run else changed)
                self._frozen = None
                self._counts["flushes"] += 1
                self._counts["log_syncs"] += old.syncs
                self._schedule_merge()
                self._lock.notify_all()
            os.remove(old.path)
        except Exception as e:
            _log.exception("flush failed")
            self._fail(e)

    def _fail(self, e: Exception) -> None:
        """From now on the store serves reads only."""
        with self._lock:
            self._failed = self._failed or e
            self._lock.notify_all()

    def put(self, key: bytes, value: bytes) -> None:
        """Durable when it returns, if sync_writes is on. Keys and values are any bytes, also empty ones."""
        self._write(reads.check_key(key), reads.check_key(value, "value"))

    def delete(self, key: bytes) -> None:
        """A key need not be there."""
        self._write(reads.check_key(key), None)

    def write(self, ops: DataFrame, order_by: str | None = None, stream: tuple[str, int] | None = None) -> Run | None:
        """Commit a DataFrame of any size as one run: key, value and, if there is such a column, is_delete.

        order_by is the column that says which operation on a key is newer; without it a key that comes twice fails
        the write, as do nulls in key, order or is_delete, a put without a value, and two different newest operations
        on a key. stream names a query and batch, which is committed once however often it comes. Puts that return
        while the job runs are older than the write.
        """
        with self._bulk:
            with self._lock:
                self._check_usable()
                if stream and self._manifest.streams.get(stream[0], -1) >= stream[1]:
                    return None
                seq, run_id = self._manifest.next_seq + _BULK_GAP, self._take_id()
            run = write_run(_run_rows(ops, order_by, seq), self._run_path(run_id), run_id, self._parquet(), self.options.sync_writes)
            with self._lock:
                self._check_usable()
                while self._memory or self._frozen is not None:
                    if self._frozen is None:
                        self._rotate()
                    self._lock.wait()
                    self._check_usable()
                changed = replace(self._manifest, next_seq=seq + 1)
                if stream:
                    changed = replace(changed, streams=changed.streams | {stream[0]: stream[1]})
                self._commit(changed.prepended(run) if run else changed)
                self._counts["writes"] += run.rows if run else 0
                self._schedule_merge()
                return run

    def _parquet(self, keys: int | None = None) -> dict[str, str]:
        return write_options(self.options.row_group_bytes, self.options.block_bytes, self.options.bloom_bits_per_key, keys)

    def _commit(self, changed: Manifest) -> None:
        try:
            manifests.save(self.control, changed)
        except OSError as e:
            self._fail(e)
            raise
        self._manifest = changed

    # flush and compaction

    def _memory_frame(self, memory: Memory, seq: int, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        items = [(k, v) for k, v in memory.items() if (low is None or k >= low) and (high is None or k < high)]
        keys, values = [k for k, _ in items], [v for _, v in items]
        made = pa.table({"key": pa.array(keys, pa.binary()), "value": pa.array(values, pa.binary()), "is_delete": pa.array([v is None for v in values], pa.bool_()), "seq": pa.array([seq] * len(items), pa.int64())})
        return self.spark.createDataFrame(made, OPS)

    def _write_memory(self, memory: Memory) -> Run | None:
        with self._lock:
            run_id, seq = self._take_id(), self._manifest.next_seq
        return write_run(self._memory_frame(memory, seq).coalesce(1).sortWithinPartitions("key"), self._run_path(run_id), run_id, self._parquet(len(memory)), self.options.sync_writes)

    def flush(self) -> None:
        """Seal what is in memory and wait for it; nothing happens if that is nothing."""
        with self._lock:
            self._check_usable()
            wanted = self._memory
            while wanted and self._memory is wanted and self._frozen is not None:
                self._lock.wait()
                self._check_usable()
            if wanted and self._memory is wanted:
                self._rotate()
            while self._frozen is not None:
                self._lock.wait()
                self._check_usable()

    def _compact(self, group: list[Run]) -> None:
        """Deletes may go only if the oldest run is merged, too: else they still hide values in older runs. The caller is the one that merges."""
        with self._lock:
            keep = group[-1] is not self._manifest.runs[-1]
            run_id = self._take_id()
        merged = merge([read_runs(self.spark, group)], keep_tombstones=keep)
        run = write_run(merged, self._run_path(run_id), run_id, self._parquet(), self.options.sync_writes)
        with self._lock:
            self._commit(self._manifest.spliced(group, run))
            self._replaced_at |= {r.path: time.monotonic() for r in group}
            self._counts["compactions"] += 1

    def _due(self) -> list[Run] | None:
        """What to merge next, if anything and if the store is to do so."""
        if self._closed or self._failed or not self.options.auto_compaction:
            return None
        found = pick([r.bytes for r in self._manifest.runs], self.options.compaction_min_runs)
        return list(self._manifest.runs[found[0] : found[1]]) if found else None

    def _schedule_merge(self) -> None:
        with self._lock:
            if not self._merging and self._due():
                self._merging = True
                threading.Thread(target=self._merge_while_due, name="tidemark-merge", daemon=True).start()
            else:
                self._drop_obsolete()

    def _merge_while_due(self) -> None:
        try:
            while True:
                with self._lock:
                    group = self._due()
                    if not group:
                        self._merging = False
                        self._drop_obsolete()
                        self._lock.notify_all()
                        return
                self._compact(group)
        except Exception as e:
            _log.exception("merge failed")
            with self._lock:
                self._merging = False
                self._fail(e)

    def await_compactions(self) -> None:
        """Until nothing is being flushed or merged and no merge is due."""
        with self._lock:
            while self._merging or (self._frozen is not None and not self._failed):
                self._lock.wait()

    def compact_all(self) -> None:
        """All runs become one, also a single one; what is in memory stays there. A failure is the caller's alone."""
        with self._lock:
            self._check_usable()
            while self._merging:
                self._lock.wait()
                self._check_usable()
            group = list(self._manifest.runs)
            self._merging = bool(group)
        try:
            if group:
                self._compact(group)
        finally:
            with self._lock:
                self._merging = False
                self._drop_obsolete()
                self._lock.notify_all()

    def _drop_obsolete(self) -> None:
        """Replaced runs go once no scan or snapshot holds them and they were kept as long as the options say."""
        held = frozenset().union(*self._leases.values()) if self._leases else frozenset()
        old = time.monotonic() - self.options.keep_replaced_s
        gone = [p for p in self._manifest.obsolete if p not in held and self._replaced_at.get(p, 0.0) <= old]
        if gone and not self._failed:
            self._commit(replace(self._manifest, obsolete=tuple(p for p in self._manifest.obsolete if p not in gone)))
            for p in gone:
                self._replaced_at.pop(p, None)
                delete(self.spark, p)

    # reads

    def lease(self) -> int:
        """Keep the runs of this moment until release(lease)."""
        with self._lock:
            self._next_lease += 1
            self._leases[self._next_lease] = frozenset(r.path for r in self._manifest.runs)
            return self._next_lease

    def release(self, lease: int) -> None:
        with self._lock:
            if self._leases.pop(lease, None) is not None and not self._closed:
                self._drop_obsolete()

    def _view(self) -> tuple[tuple[Run, ...], tuple[tuple[Memory, int], ...]]:
        """Runs, and the tables in memory with their sequence numbers, as of now."""
        with self._lock:
            if self._closed:
                raise RuntimeError("the store is closed")
            seq = self._manifest.next_seq
            tables = [(m, s) for m, s in ((self._frozen, seq), (self._memory, seq + 1)) if m]
            return self._manifest.runs, tuple((dict(m) if m is self._memory else m, s) for m, s in tables)

    def _frame(self, view, low: bytes | None, high: bytes | None) -> DataFrame:
        runs, tables = view
        meet = [r for r in runs if r.meets(low, high)]
        with self._lock:
            self._counts["runs_skipped"] += len(runs) - len(meet)
        frames = [self._memory_frame(m, s, low, high) for m, s in tables]
        return union([read_runs(self.spark, meet), *frames])

    def ops(self, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        """Every version that is stored, of runs that can hold keys of the range, and what is in memory."""
        return self._frame(self._view(), low, high)

    def snapshot(self) -> Snapshot:
        return Snapshot(self)

    def read(self) -> DataFrame:
        """key, value of all live rows, in no order."""
        return resolve(self.ops())

    def get(self, key: bytes) -> bytes | None:
        """None if the key is absent or deleted. What is in memory is newer than any run, and is looked at first."""
        key = reads.check_key(key)
        with self._lock:
            if self._closed:
                raise RuntimeError("the store is closed")
            self._counts["gets"] += 1
            for memory in (self._memory, self._frozen or {}):
                if key in memory:
                    return memory[key]
            meet = [r for r in self._manifest.runs if r.meets(key, key + b"\x00")]
            self._counts["runs_skipped"] += len(self._manifest.runs) - len(meet)
            if not meet:
                return None
            held = self.lease()
        try:
            found = read_runs(self.spark, meet).where(F.col("key") == F.lit(key)).collect()
            with self._lock:
                self._counts["run_reads"] += len(found)
                self._counts["bloom_negatives"] += len(meet) - len(found)
            row = max(found, key=lambda r: r["seq"], default=None)
            return None if row is None or row["is_delete"] else bytes(row["value"])
        finally:
            self.release(held)

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return reads.multi_get(self.ops(), keys)

    def scan(self, low: bytes | None = None, high: bytes | None = None, limit: int | None = None) -> Scan:
        reads.in_range(low, high)
        with self._lock:
            held, view = self.lease(), self._view()
        return Scan(self, reads.scan(self._frame(view, low, high), low, high, limit), held)

    def scan_frame(self, low: bytes | None = None, high: bytes | None = None, limit: int | None = None) -> DataFrame:
        return reads.scan(self.ops(low, high), low, high, limit)

    def stats(self) -> dict[str, int]:
        """Counters since the opening, and gauges of the runs. run_reads: versions that gets found in runs; bloom_negatives: runs that a get's key could be in by their bounds but was not, nearly all of which filters and page bounds tell without reading rows."""
        with self._lock:
            runs = self._manifest.runs
            syncs = self._counts["log_syncs"] + (self._log.syncs if self._log else 0)
            return self._counts | {"log_syncs": syncs, "runs": len(runs), "run_bytes": sum(r.bytes for r in runs), "run_rows": sum(r.rows for r in runs)}

    @property
    def runs(self) -> tuple[Run, ...]:
        """Newest first."""
        return self._manifest.runs

    # end

    def close(self) -> None:
        """What is in memory stays in the synced log, from which the next open takes it. Waits for flushes and merges; closing twice does nothing."""
        with self._lock:
            if self._closed:
                return
            self._closed = True
            self._lock.notify_all()
            while self._merging or (self._frozen is not None and not self._failed):
                self._lock.wait()
            try:
                self._log.close()
            finally:
                self._owner.release()

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def _run_rows(ops: DataFrame, order_by: str | None, seq: int) -> DataFrame:
    """The newest operation on each key, ranged and sorted by key; what may not be written fails the job.

    Without an order keys come once, so rows are ranged first and checked where they land: one shuffle. With one, keys
    may be of any frequency, so the newest are found first, combined before their shuffle.
    """
    bad = lambda what, kind: F.raise_error(F.lit(what)).cast(kind)
    gone = F.col("is_delete") if "is_delete" in ops.columns else F.lit(False)
    gone = F.when(gone.isNull(), bad("null is_delete", "boolean")).otherwise(gone)
    key = F.when(F.col("key").isNull() | (F.col("value").isNull() & ~gone), bad("null key, or null value of a put", "binary")).otherwise(F.col("key"))
    value = F.when(~gone, F.col("value"))
    each = ops.select(key.alias("key"), value.alias("value"), gone.alias("is_delete"), *([F.col(order_by).alias("rank")] if order_by else []))
    if not order_by:
        won = each.repartitionByRange("key").groupBy("key").agg(F.max_by(F.struct("value", "is_delete"), "is_delete").alias("w"), F.count("*").alias("n"))
        whole = F.when(F.col("n") > 1, bad("a key comes twice and no column orders its operations", "struct<value: binary, is_delete: boolean>")).otherwise(F.col("w"))
    else:
        if order_by in ("key", "value", "is_delete"):
            each = each.withColumn("rank", F.col(order_by))
        rank = F.when(F.col("rank").isNull(), bad(f"null {order_by}", each.schema["rank"].dataType)).otherwise(F.col("rank"))
        each = each.withColumn("rank", rank).withColumn("h", F.xxhash64("value", "is_delete"))
        low = F.max(F.struct("rank", F.bitwise_not("h").alias("h")))
        won = each.groupBy("key").agg(F.max(F.struct("rank", "h", "value", "is_delete")).alias("w"), low.alias("low"))
        whole = F.when(F.col("w.h") != F.bitwise_not("low.h"), bad("two newest operations on a key differ", won.schema["w"].dataType)).otherwise(F.col("w"))
        won = won.withColumn("w", whole).repartitionByRange("key")
        whole = F.col("w")
    rows = won.withColumn("w", whole).select("key", F.col("w.value").alias("value"), F.col("w.is_delete").alias("is_delete"), F.lit(seq).cast("long").alias("seq"))
    return rows.sortWithinPartitions("key")


__all__ = ["LIVE", "OPS", "Options", "Scan", "Snapshot", "Store", "StoreFailed"]
