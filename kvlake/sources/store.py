"""A store: a mutation log on disk under versioned manifests, with a buffer of new mutations in front.

Single mutations go to the buffer (and its write-ahead log) and are flushed as a sorted Parquet file once the buffer
reaches its threshold; DataFrames of mutations are committed as files at once. Readers see files and buffer as one log.
Files are never changed; compaction writes merged files and commits a manifest that lists them instead. Nothing is
deleted but by ``vacuum``.

Any number of processes may append DataFrames and compact: each commit builds on the newest manifest and is tried again
if another came first. Sequence numbers in files count from a base that is set in the commit itself, so a later commit is
newer, however the writers overlap. One process at a time writes single mutations; its buffer is newer than all commits
until it is flushed, and has its place among them then. Where no write-ahead log can be had (a path that isn't on a
mounted file system), each write is committed at once, unless ``wal_sync`` is ``none``; ``close`` flushes what is left.
"""

from __future__ import annotations

import glob
import json
import threading
import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.operators import mutate, view
from kvlake.operators.mutate import WriteBatch
from kvlake.schema import LOG, PUT, Options
from kvlake.sources.manifest import ConcurrentCommit, DataFile, Manifest, ManifestLog, _local, qualified
from kvlake.sources.wal import Wal

TRIES, DAY_MS = 20, 86_400_000
DRIVER_FOOTERS = 64  # files whose footers the driver reads itself


class TransactionConflict(Exception):
    """A key that the transaction has read holds another value by now."""


class Stale(Exception):
    """The store has another version than the one a commit was made for."""


@dataclass(frozen=True)
class Stats:
    """Figures of a store at one moment; -1 where there is nothing to count."""

    memtable_bytes: int
    memtable_entries: int
    level_count: int
    files_per_level: list[int]
    bytes_per_level: list[int]
    file_count: int
    file_bytes: int
    block_cache_bytes: int
    block_cache_max_bytes: int
    wal_bytes: int


def _now() -> int:
    return time.time_ns() // 1_000_000


class Reader:
    """Reads of a fixed log: a manifest and the buffered rows beside it."""

    def __init__(self, store: Store, manifest: Manifest, rows: list[tuple]):
        self.store, self.manifest, self.rows = store, manifest, rows
        self._closed = False

    def log(self, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        """The mutations, without files whose keys lie outside [low, high]."""
        if self._closed:
            raise RuntimeError("it is closed")
        spark = self.store.spark
        parts = self.store._read([f for f in self.manifest.files if f.overlaps(low, high)])
        rows = [r for r in self.rows if (low is None or r[0] >= low) and (high is None or r[0] <= high)]
        if rows or not parts:
            # the buffer's numbers, after those of all files
            up = self.manifest.next_seq - self.rows[0][3] if self.rows else 0
            parts.append(mutate.to_log(spark, [(k, v, op, n + up, batch + up, expiry) for k, v, op, n, batch, expiry in rows]))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def _shown(self, now_ms: int | None) -> dict:
        o = self.store.options
        return {"now_ms": (_now() if now_ms is None else now_ms) if o.enable_ttl else None, "keep": o.keep}

    def scan(self, low: bytes | None = None, high: bytes | None = None, descending: bool = False, limit: int | None = None, now_ms: int | None = None) -> DataFrame:
        return view.scan(self.log(low, high), low, high, descending, limit, **self._shown(now_ms))

    def scan_descending(self, low: bytes | None = None, high: bytes | None = None, **kw) -> DataFrame:
        return self.scan(low, high, descending=True, **kw)

    def scan_prefix(self, prefix: bytes, now_ms: int | None = None) -> DataFrame:
        from kvlake.functions.keys import successor

        return view.scan_prefix(self.log(prefix or None, successor(prefix)), prefix, **self._shown(now_ms))

    def multi_get(self, wanted: DataFrame, now_ms: int | None = None) -> DataFrame:
        return view.multi_get(self.log(), wanted, **self._shown(now_ms))

    def get(self, key: bytes, now_ms: int | None = None) -> bytes | None:
        """The visible value, or None."""
        found = view.get(self.log(key, key), key, **self._shown(now_ms)).collect()
        return bytes(found[0].value) if found else None

    def exists(self, key: bytes, now_ms: int | None = None) -> bool:
        return self.get(key, now_ms) is not None

    def count(self, low: bytes | None = None, high: bytes | None = None, now_ms: int | None = None) -> int:
        return view.count(self.log(low, high), low, high, **self._shown(now_ms)).first().n

    def approximate_count(self, low: bytes | None = None, high: bytes | None = None) -> int:
        """Buffered puts in the range, and the rows of row groups that overlap it: an upper bound from metadata alone.

        Expiry, filter and older versions aren't looked at.
        """
        newest = {}
        for row in self.rows:
            newest[row[0]] = row
        inside = sum(op == PUT and (low is None or k >= low) and (high is None or k <= high) for k, _, op, *_ in newest.values())
        return inside + sum(f.rows_in(low, high) for f in self.manifest.files)

    def close(self) -> None:
        self._closed = True

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


class Transaction:
    """Reads of a snapshot, buffered writes, and a commit that fails if a key it has read holds another value by then."""

    def __init__(self, store: Store):
        self.store, self.snapshot = store, store.snapshot()
        self.writes: dict[bytes, bytes | None] = {}
        self.reads: dict[bytes, bytes | None] = {}
        self.open = True

    def _check(self) -> None:
        if not self.open:
            raise RuntimeError("the transaction has ended")

    def get(self, key: bytes) -> bytes | None:
        self._check()
        if key in self.writes:
            return self.writes[key]
        if key not in self.reads:
            self.reads[key] = self.snapshot.get(key)
        return self.reads[key]

    def put(self, key: bytes, value: bytes) -> None:
        self._check()
        self.writes[key] = value

    def delete(self, key: bytes) -> None:
        self._check()
        self.writes[key] = None

    def commit(self) -> None:
        self._check()
        self.open = False
        try:
            batch = WriteBatch()
            for k, v in self.writes.items():
                batch.delete(k) if v is None else batch.put(k, v)
            self.store._checked(self._conflicts, batch)
        finally:
            self.snapshot.close()

    def _conflicts(self, now: Reader) -> None:
        """Raise if a key that was read holds another value now."""
        if not self.reads:
            return
        wanted = self.store.spark.createDataFrame([(bytearray(k),) for k in self.reads], "key binary")
        found = {bytes(r.key): None if r.value is None else bytes(r.value) for r in now.multi_get(wanted).collect()}
        if found != self.reads:
            raise TransactionConflict(", ".join(sorted(k.hex() for k in found if found[k] != self.reads[k])))

    def rollback(self) -> None:
        """Forget the writes; nothing happens if it has ended."""
        self.open = False
        self.snapshot.close()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.rollback()


class Store:
    def __init__(self, spark: SparkSession, path: str | None = None, options: Options | None = None):
        options = options or Options(in_memory=path is None)
        if (path is None) != options.in_memory:
            raise ValueError("a store in memory has no path, and in_memory set")
        self.spark, self.path, self.options = spark, qualified(spark, path).rstrip("/") if path else None, options
        self._lock = threading.RLock()
        self._rows: list[tuple] = []
        self._bytes = 0
        self._manifests = ManifestLog(spark, self.path) if self.path else None
        here = _local(self.path) if self.path else None
        self._wal = Wal(f"{here}/wal/log", options.wal_sync, options.wal_sync_interval_ms) if here else None
        done = self._manifest().flushed
        if self._wal:
            self._rows = [r for r in self._wal.rows if r[3] > done]
            self._bytes = sum(len(k) + len(v or b"") for k, v, *_ in self._rows)
        self._next = max([done, *(r[3] for r in self._rows[-1:])]) + 1
        self._pool: ThreadPoolExecutor | None = None

    @staticmethod
    def in_memory(spark: SparkSession, options: Options | None = None) -> Store:
        return Store(spark, None, options)

    def _manifest(self, version: int | None = None) -> Manifest:
        return self._manifests.read(version) if self._manifests else Manifest()

    # reads

    def reader(self) -> Reader:
        """The store as it is now."""
        with self._lock:
            return Reader(self, self._manifest(), list(self._rows))

    def snapshot(self) -> Reader:
        """The store as it is now, to be read later. Expiry is told by the time of reading."""
        return self.reader()

    def at_version(self, version: int) -> Reader:
        """The files of an earlier manifest version, without the buffer."""
        return Reader(self, self._manifest(version), [])

    def __getattr__(self, name: str):
        # get, exists, scan, scan_descending, scan_prefix, multi_get, count, approximate_count read the store as it is
        if name in ("get", "exists", "scan", "scan_descending", "scan_prefix", "multi_get", "count", "approximate_count", "log"):
            return getattr(self.reader(), name)
        if name.endswith("_async") and not name.startswith("_"):
            return lambda *a, **k: self._submit(getattr(self, name.removesuffix("_async")), *a, **k)
        raise AttributeError(name)

    def _submit(self, fn, *a, **k) -> Future:
        """Any method as ``<name>_async``: it runs in a thread, and DataFrames are collected there."""
        if self._pool is None:
            self._pool = ThreadPoolExecutor(4)

        def run():
            out = fn(*a, **k)
            return out.collect() if isinstance(out, DataFrame) else out

        return self._pool.submit(run)

    # writes

    def put(self, key: bytes, value: bytes, ttl_ms: int | None = None) -> None:
        self.write(WriteBatch().put(key, value, ttl_ms))

    def delete(self, key: bytes) -> None:
        self.write(WriteBatch().delete(key))

    def write(self, batch: WriteBatch) -> None:
        """All of a batch or nothing of it."""
        if not len(batch):
            return
        with self._lock:
            rows = mutate.batch_rows(batch, self._next, self._next, _now(), self.options.enable_ttl)
            if self._wal:
                self._wal.append(rows)
            self._next += len(rows)
            self._rows += rows
            self._bytes += sum(len(k) + len(v or b"") for k, v, *_ in rows)
            if self.path and (self._bytes >= self.options.memtable_size_threshold or not (self._wal or self.options.wal_sync == "none")):
                self.flush()

    def _checked(self, check: Callable[[Reader], None], batch: WriteBatch) -> None:
        """Write ``batch`` if ``check`` lets the store as it is then pass. In a shared store both hold for one version."""
        with self._lock:
            if not (self.options.shared and self.path):
                check(self.reader())
                self.write(batch)
                return
            for _ in range(TRIES):
                self.flush()
                now = self.reader()
                check(now)
                if not len(batch):
                    return
                rows = mutate.batch_rows(batch, 0, 0, _now(), self.options.enable_ttl)
                files, _ = self._write_files(view.newest(mutate.to_log(self.spark, rows)), 0, 1)
                try:
                    self._commit(lambda m: m.adding(files, len(rows)), now.manifest.version)
                    return
                except Stale:
                    continue
            raise ConcurrentCommit(f"after {TRIES} tries")

    def flush(self) -> None:
        """Commit the buffer as a file of level 0."""
        with self._lock:
            if not self._rows or not self.path:
                return
            first, last = self._rows[0][3], self._rows[-1][3]
            rows = [(k, v, op, n - first, batch - first, expiry) for k, v, op, n, batch, expiry in self._rows]
            files, _ = self._write_files(view.newest(mutate.to_log(self.spark, rows)), 0, self._bytes)
            self._commit(lambda m: m.adding(files, last - first + 1, flushed=last))
            # only now may the buffer go
            self._rows, self._bytes = [], 0
            if self._wal:
                self._wal.clear()
        self.compact_if_needed()

    def append(self, rows: DataFrame, order: str | None = None, stream: tuple[str, int] | None = None) -> bool:
        """Commit a DataFrame of mutations (key; optional value, op, expiry_ms) in one version, newer than all before it.

        ``order``: a column of non-negative whole numbers that orders mutations of the same key; without it each key must
        occur once. ``stream``: a stream's name and the number of its micro-batch; one that the store holds already, or
        that comes before one that it holds, is passed over. Returns whether the rows were committed.
        """
        if not self.path:
            raise ValueError("a store in memory takes single mutations and batches")

        def done(m: Manifest) -> bool:
            return stream is not None and m.streams.get(stream[0], -1) >= stream[1]

        with self._lock:
            self.flush()
            has = set(rows.columns)
            if "expiry_ms" in has and not self.options.enable_ttl:
                raise RuntimeError("TTL is not enabled")
            if done(self._manifest()):
                return False
            null = lambda t: F.lit(None).cast(t)
            log = rows.select(
                "key",
                F.col("value") if "value" in has else null("binary").alias("value"),
                F.col("op") if "op" in has else F.lit(PUT).alias("op"),
                (F.col(order).cast("long") if order else F.lit(0).cast("long")).alias("seq"),
                F.lit(0).cast("long").alias("batch_id"),
                F.col("expiry_ms").cast("long") if "expiry_ms" in has else null("long").alias("expiry_ms"),
            )
            files, top = self._write_files(view.newest(log), 0)

            def change(m: Manifest) -> Manifest:
                if done(m):
                    raise Stale(stream)
                return m.adding(files, top + 1, **({"streams": {**m.streams, stream[0]: stream[1]}} if stream else {}))

            try:
                self._commit(change)
            except Stale:
                return False
        self.compact_if_needed()
        return True

    def delete_range(self, low: bytes | None = None, high: bytes | None = None) -> None:
        """Delete the visible keys in [low, high] at once."""
        with self._lock:
            now = self.reader()
            found = view.live(view.in_range(now.log(low, high), low, high), **now._shown(None)).select("key")
            if self.path:
                self.append(found.select("key", F.lit("delete").alias("op")))
            else:  # as many keys as the driver's memory holds anyway
                batch = WriteBatch()
                for r in found.collect():
                    batch.delete(bytes(r.key))
                self.write(batch)

    def compare_and_swap(self, key: bytes, expected: bytes | None, value: bytes) -> bool:
        """Put ``value`` if the visible value is ``expected`` (None: none). The new value has no expiry."""

        def check(now: Reader) -> None:
            if now.get(key) != expected:
                raise TransactionConflict(key.hex())

        try:
            self._checked(check, WriteBatch().put(key, value))
            return True
        except TransactionConflict:
            return False

    def begin(self) -> Transaction:
        return Transaction(self)

    # files

    def _read(self, files: list[DataFile]) -> list[DataFrame]:
        """The files' mutations, a DataFrame for each base. Compacted files have base 0, so there are few."""
        by_base: dict[int, list[str]] = {}
        for f in files:
            by_base.setdefault(f.base, []).append(f"{self.path}/{f.path}")
        out = []
        for base, paths in sorted(by_base.items()):
            x = self.spark.read.schema(LOG).parquet(*paths)
            out.append(x.withColumn("seq", F.col("seq") + base).withColumn("batch_id", F.col("batch_id") + base) if base else x)
        return out

    def _write_files(self, log: DataFrame, level: int, size: int | None = None) -> tuple[tuple[DataFile, ...], int]:
        """Sorted Parquet files of ``log`` and their greatest sequence number. Nothing lists them yet.

        ``size``: about how many bytes they will have; without it Spark's own partitions of the range shuffle decide.
        """
        name = f"data/{uuid.uuid4().hex}"
        o = self.options
        parts = None if size is None else -(-size // o.target_file_bytes)
        out = log.repartitionByRange("key") if parts is None else log.repartitionByRange(parts, "key") if parts > 1 else log.coalesce(1)
        writer = out.sortWithinPartitions("key").write.option("compression", o.compression).option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.fpp#key", str(o.bloom_false_positive_rate))
        writer.parquet(f"{self.path}/{name}")
        found = self._described(name)
        return tuple(DataFile(f"{name}/{file}", level, rows, size, low, high, groups) for file, rows, size, low, high, groups, _ in found), max([0, *(x[-1] for x in found)])

    def _described(self, name: str) -> list[tuple]:
        """(file, rows, bytes, least key, greatest key, row groups, greatest seq) of the files of a folder, by key: from their footers.

        A file system that isn't mounted, or keys too long for Parquet's statistics, take a scan of the two columns.
        """
        here = _local(self.path)
        if here is not None:
            paths = sorted(glob.glob(f"{here}/{name}/*.parquet"))
            if len(paths) <= DRIVER_FOOTERS:
                found = [_footer(p) for p in paths]
            else:
                rows = self.spark.createDataFrame([(p,) for p in paths], "path string").repartition(min(len(paths) // 16, 2000))
                read = _footer

                def footers(batches):
                    for b in batches:
                        yield pa.RecordBatch.from_pydict({"raw": [json.dumps(read(p)) for p in b.column(0).to_pylist()]}, pa.schema([("raw", pa.string())]))

                found = [json.loads(r.raw) for r in rows.mapInArrow(footers, "raw string").collect()]
            if all(x is not None for x in found):
                return sorted(((*x[:5], tuple(tuple(g) for g in x[5]), x[6]) for x in found if x[1]), key=lambda x: x[3])
        stored = self.spark.read.schema(LOG).parquet(f"{self.path}/{name}")
        meta = stored.groupBy(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"), F.min("key").alias("low"), F.max("key").alias("high"), F.max("seq").alias("top")).orderBy("low")
        return [(r.file, r.rows, r.bytes, bytes(r.low).hex(), bytes(r.high).hex(), (), r.top) for r in meta.collect()]

    def _commit(self, change: Callable[[Manifest], Manifest], expected: int | None = None) -> Manifest:
        """Apply ``change`` to the newest manifest as the next version; again if another writer was first. ``expected``: the only version to build on."""
        for k in range(TRIES):
            m = self._manifest()
            if expected is not None and m.version != expected:
                raise Stale(m.version)
            new = change(m)
            new = replace(new, version=max([m.version, *self._manifests.versions()[-1:]]) + 1)
            try:
                self._manifests.commit(new)
                return new
            except ConcurrentCommit:
                time.sleep(0.01 * (k + 1))
        raise ConcurrentCommit(f"after {TRIES} tries")

    def compact_if_needed(self) -> int:
        """Merge the oldest runs of each level that is full into the next one, until none is; the last level never is. A run is what one commit wrote."""
        done = 0
        while self.path:
            m, o = self._manifest(), self.options
            level = next((n for n in range(o.level_count - 1) if len(m.runs(n)) >= o.level_limit(n)), None)
            if level is None:
                return done
            self.compact(level)
            done += 1
        return done

    def compact(self, level: int | None = None) -> None:
        """Merge the oldest runs of a level into the next, or all files of the store into the last one (``level`` None).

        Hidden newest versions become tombstones; in a merge of all files they go (the buffer holds newer mutations alone).
        """
        m, o = self._manifest(), self.options
        old = list(m.files) if level is None else [f for run in m.runs(level)[: o.level_limit(level)] for f in run]
        if not old:
            return
        to = o.level_count - 1 if level is None else min(level + 1, o.level_count - 1)
        whole = len(old) == len(m.files)
        log, *rest = self._read(old)
        for x in rest:
            log = log.unionByName(x)
        merged = view.compacted(log, _now() if o.enable_ttl else None, o.keep, whole)
        files, _ = self._write_files(merged, to, sum(f.bytes for f in old))
        gone = {f.path for f in old}

        def change(now: Manifest) -> Manifest:
            if not gone <= {f.path for f in now.files}:
                raise ConcurrentCommit("its files were compacted by another")
            return replace(now, files=tuple(f for f in now.files if f.path not in gone) + files)

        self._commit(change)

    def vacuum(self, keep_versions: int = 1) -> int:
        """Delete the data files of earlier manifests that none of the last ``keep_versions`` lists, and those manifests; open snapshots may need them.

        Files that no manifest has listed go once they are a day old, as a commit may be about to list them. Returns how many data files went.
        """
        versions = self._manifests.versions()
        kept, earlier = versions[-keep_versions:], versions[:-keep_versions]
        known = {f.path for v in kept for f in self._manifest(v).files}
        gone = {f.path for v in earlier for f in self._manifest(v).files} - known
        p, fs = self._manifests._hadoop(f"{self.path}/data")
        n = 0
        for folder in fs.listStatus(p) if fs.exists(p) else []:
            for f in fs.listStatus(folder.getPath()):
                name = f"data/{folder.getPath().getName()}/{f.getPath().getName()}"
                if name.endswith(".parquet") and (name in gone or (name not in known and f.getModificationTime() < _now() - DAY_MS)):
                    fs.delete(f.getPath(), False)
                    n += 1
        if kept:
            self._manifests.forget(kept)
        return n

    def stats(self) -> Stats:
        with self._lock:
            m, o = self._manifest(), self.options
            levels = range(max([0, *(f.level + 1 for f in m.files)]))
            sizes = [sum(f.bytes for f in m.level(n)) for n in levels]
            return Stats(self._bytes, len({r[0] for r in self._rows}), len(levels), [len(m.level(n)) for n in levels], sizes, len(m.files), sum(sizes), -1, -1, self._wal.size() if self._wal else -1)

    def stats_frame(self) -> DataFrame:
        """``stats`` as one row."""
        s = self.stats()
        return self.spark.createDataFrame([tuple(vars(s).values())], "memtable_bytes long, memtable_entries long, level_count long, files_per_level array<long>, bytes_per_level array<long>, file_count long, file_bytes long, block_cache_bytes long, block_cache_max_bytes long, wal_bytes long")

    def close(self) -> None:
        """The buffer stays in the write-ahead log, or is flushed where there is none."""
        if self._pool:
            self._pool.shutdown()
        if self._wal:
            self._wal.close()
        else:
            self.flush()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


def _footer(path: str) -> tuple | None:
    """What the footer says of a log file: see ``_described``. None without statistics of keys."""
    import os

    import pyarrow.parquet as pq

    meta = pq.read_metadata(path)
    groups, top = [], 0
    for k in range(meta.num_row_groups):
        g = meta.row_group(k)
        column = {g.column(j).path_in_schema: g.column(j).statistics for j in range(g.num_columns)}
        key, seq = column["key"], column["seq"]
        if key is None or not key.has_min_max or seq is None or not seq.has_min_max:
            return None
        low, high = (x.encode() if isinstance(x, str) else bytes(x) for x in (key.min, key.max))
        groups.append((g.num_rows, low.hex(), high.hex()))
        top = max(top, seq.max)
    ends = (min(g[1] for g in groups), max(g[2] for g in groups)) if groups else ("", "")
    return os.path.basename(path), meta.num_rows, os.path.getsize(path), *ends, groups, top


def write_json_batch(store: Store, ops: Iterable[dict]) -> None:
    """Apply operations {op: put or delete, key: text, value: base64} as one batch; an unknown op raises before anything is done."""
    import base64

    batch = WriteBatch()
    for x in ops:
        key = x["key"].encode()
        if x["op"] == "put":
            batch.put(key, base64.b64decode(x.get("value") or ""))
        elif x["op"] == "delete":
            batch.delete(key)
        else:
            raise ValueError(f"unknown op {x['op']!r}")
    store.write(batch)
