"""Named queries that go through a store on disk: each builds one of ``events`` in the shared folder and reads it back.

The stores lie below ``spark.checkpoint.dir`` (a test folder where it is unset) and go when the driver ends.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.operators.mutate import WriteBatch
from kvlake.plans import catalog
from kvlake.schema import Options
from kvlake.sources.manifest import _local
from kvlake.sources.store import Store, TransactionConflict
from kvlake.streaming.ingest import ingest

SMALL = Options(level_zero_file_limit=2, level_size_multiplier=2)


def _path(spark: SparkSession) -> str:
    return catalog.own_folder(spark, "kvlake-store")


def _mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.event_log(spark, sf_dir).select("key", "value", "op", F.col("seq").alias("n"))


def _store(spark: SparkSession, sf_dir: str, parts: int = 1) -> Store:
    """A store with all events, appended in ``parts`` versions that follow each other."""
    store = Store(spark, _path(spark), SMALL)
    log = _mutations(spark, sf_dir)
    cuts = log.agg(F.min("n"), F.max("n")).first()
    low, step = cuts[0] or 0, ((cuts[1] or 0) - (cuts[0] or 0)) // parts + 1
    for k in range(parts):
        store.append(log.where(F.col("n").between(low + k * step, low + (k + 1) * step - 1)), order="n")
    return store


def _scan_levels(s: SparkSession, d: str) -> DataFrame:
    return catalog.text(_store(s, d, 5).scan(catalog.LOW, catalog.HIGH))


def _compacted(s: SparkSession, d: str) -> DataFrame:
    store = _store(s, d, 3)
    store.compact()
    store.vacuum()
    return catalog.text(store.log().select("key", "value"))


def _snapshot(s: SparkSession, d: str) -> DataFrame:
    store = Store(s, _path(s), SMALL)
    log = _mutations(s, d)
    store.append(log.where(F.col("n") <= catalog.AS_OF), order="n")
    kept = store.snapshot()
    store.append(log.where(F.col("n") > catalog.AS_OF), order="n")
    return catalog.text(kept.scan(catalog.LOW, catalog.HIGH))


def _old_version(s: SparkSession, d: str) -> DataFrame:
    store = Store(s, _path(s), Options())
    log = _mutations(s, d)
    store.append(log.where(F.col("n") <= catalog.AS_OF), order="n")
    store.append(log.where(F.col("n") > catalog.AS_OF), order="n")
    return catalog.text(store.at_version(1).scan(catalog.LOW, catalog.HIGH))


def _batch(s: SparkSession, d: str) -> DataFrame:
    store = _store(s, d)
    store.write(catalog.mutations(s))
    return catalog.text(store.scan())


def _recovered(s: SparkSession, d: str) -> DataFrame:
    """The same after the process has gone: the batch comes back from the write-ahead log."""
    store = _store(s, d)
    store.write(catalog.mutations(s))
    store.close()
    return catalog.text(Store(s, store.path, SMALL).scan())


def _delete_range(s: SparkSession, d: str) -> DataFrame:
    store = _store(s, d)
    store.delete_range(catalog.LOW, catalog.HIGH)
    return catalog.text(store.scan())


def _transactions(s: SparkSession, d: str) -> DataFrame:
    """One that commits, one whose read key has changed meanwhile, one that is rolled back: what each saw, and what holds then."""
    store = _store(s, d)
    store.put(b"t:a", b"1")
    out = []
    first = store.begin()
    first.put(b"t:a", (first.get(b"t:a") or b"") + b"2")
    first.delete(b"t:none")
    out.append(("own_write", (first.get(b"t:a") or b"").decode()))
    out.append(("before_commit", (store.get(b"t:a") or b"").decode()))
    first.commit()
    out.append(("after_commit", (store.get(b"t:a") or b"").decode()))
    second = store.begin()
    second.get(b"t:a")
    store.put(b"t:a", b"other")
    second.put(b"t:a", b"lost")
    try:
        second.commit()
        out.append(("conflict", "no"))
    except TransactionConflict:
        out.append(("conflict", "yes"))
    third = store.begin()
    third.put(b"t:a", b"never")
    third.rollback()
    out.append(("at_last", (store.get(b"t:a") or b"").decode()))
    return s.createDataFrame(out, "step string, value string")


def _swaps(s: SparkSession, d: str) -> DataFrame:
    store = _store(s, d)
    tries = [(b"c:a", None, b"1"), (b"c:a", None, b"2"), (b"c:a", b"1", b"3"), (b"c:a", b"1", b"4")]
    done = [store.compare_and_swap(*t) for t in tries]
    return s.createDataFrame([(k, ok, (store.get(b"c:a") or b"").decode()) for k, ok in enumerate(done)], "try int, swapped boolean, at_last string")


def _stats(s: SparkSession, d: str) -> DataFrame:
    store = _store(s, d)
    store.write(WriteBatch().put(b"a", b"12").put(b"a", b"34").delete(b"b"))
    x = store.stats_frame()
    return x.select("memtable_bytes", "memtable_entries", (F.col("level_count") >= 1).alias("has_levels"), (F.col("file_count") >= 1).alias("has_files"), (F.col("file_bytes") > 0).alias("has_bytes"), (F.col("wal_bytes") > 0).alias("has_wal"), "block_cache_bytes")


def _streamed(s: SparkSession, d: str) -> DataFrame:
    store = Store(s, _path(s), SMALL)
    schema = s.read.parquet(f"{d}/events.parquet").schema
    events = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    mutations = events.select(
        F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 6, "0")).cast("binary").alias("key"),
        F.concat_ws("#", "event_type", F.col("event_id").cast("string")).cast("binary").alias("value"),
        F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"),
        F.col("event_id").alias("n"),
    )
    ingest(mutations, store, _path(s), order="n").awaitTermination()
    return catalog.text(store.scan())


def _steps(s: SparkSession, out: list[tuple[str, object]]) -> DataFrame:
    """Steps and what each gave, as text."""
    shown = [(k, v.decode() if isinstance(v, bytes) else "none" if v is None else str(v).lower()) for k, v in out]
    return s.createDataFrame(shown, "step string, value string")


def _values(rows: list[tuple[str, object]]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in rows) + ") t(step, value)"


def _ttl(s: SparkSession, d: str) -> DataFrame:
    """Events with their expiry, appended in two versions and compacted to the last level, where what has expired goes for good."""
    store = Store(s, _path(s), Options(level_zero_file_limit=2, level_size_multiplier=2, enable_ttl=True))
    log = catalog.event_log(s, d).select("key", "value", "op", F.col("seq").alias("n"), "expiry_ms")
    for part in (log.where(F.col("n") <= catalog.AS_OF), log.where(F.col("n") > catalog.AS_OF)):
        store.append(part, order="n")
    store.compact()
    return catalog.text(store.log().select("key", "value"))


def _ttl_puts(s: SparkSession, d: str) -> DataFrame:
    store = Store(s, _path(s), Options(enable_ttl=True))
    store.put(b"a", b"1")
    store.put(b"b", b"2", ttl_ms=3_600_000)
    store.put(b"a", b"3", ttl_ms=-1)  # has expired, and hides the put before it
    snap, later = store.snapshot(), time.time_ns() // 1_000_000 + 7_200_000
    out = [("a", store.get(b"a")), ("b", store.get(b"b")), ("b_later", store.get(b"b", now_ms=later)), ("snapshot", snap.get(b"b")), ("snapshot_later", snap.get(b"b", now_ms=later))]
    store.flush()
    out += [("a_flushed", store.get(b"a")), ("b_flushed", store.get(b"b")), ("swap", store.compare_and_swap(b"a", None, b"4")), ("a_swapped", store.get(b"a", now_ms=later))]
    return _steps(s, out)


def _get_snapshot(s: SparkSession, d: str) -> DataFrame:
    store = _store(s, d)
    key = b"user:000042"
    before = store.get(key)
    with store.snapshot() as kept:
        store.put(key, b"new")
        store.put(b"only:new", b"x")
        out = [("same", kept.get(key) == before), ("new", store.get(key)), ("not_there_yet", kept.get(b"only:new")), ("exists", kept.exists(b"only:new")), ("now", store.exists(b"only:new"))]
    try:
        kept.get(key)
    except RuntimeError:
        out.append(("closed", "raises"))
    return _steps(s, out)


def _in_memory(s: SparkSession, d: str) -> DataFrame:
    store = Store.in_memory(s)
    batch = WriteBatch()
    for k in range(200):
        batch.put(b"k%03d" % k, b"v%d" % (k * k))
    store.write(batch)
    store.delete_range(b"k050", b"k149")
    store.put(b"k060", b"again")
    return catalog.text(store.scan_descending(limit=60))


def _damaged_wal(s: SparkSession, d: str) -> DataFrame:
    """Four batches, of which the third is damaged on disk: what comes before it is there, and new writes follow."""
    store = Store(s, _path(s), SMALL)
    for k in range(4):
        store.write(WriteBatch().put(b"k%d" % k, b"%d" % k).put(b"all", b"%d" % k))
    store.close()
    log = f"{_local(store.path)}/wal/log"
    with open(log, "r+b") as f:
        lines = f.readlines()
        f.seek(len(lines[0]) + len(lines[1]) + 12)
        f.write(b"#")
    again = Store(s, store.path, SMALL)
    again.put(b"k9", b"9")
    again.close()
    return catalog.text(Store(s, store.path, SMALL).scan())


def _flush(s: SparkSession, d: str) -> DataFrame:
    """Puts beyond the buffer's threshold become files on their own, with nothing lost."""
    store = Store(s, _path(s), Options(memtable_size_threshold=8 << 10))
    for k in range(40):
        store.write(WriteBatch().put(b"key-%05d" % k, b"x" * 1000).put(b"last", b"%d" % k))
    x = store.stats()
    out = store.scan().agg(F.count("*").alias("keys"), F.max(F.when(F.decode("key", "UTF-8") == "last", F.decode("value", "UTF-8"))).alias("last"))
    return out.select("keys", "last", F.lit(x.file_count >= 1).alias("has_files"), F.lit(x.memtable_bytes < 8 << 10).alias("buffer_is_small"))


def _async(s: SparkSession, d: str) -> DataFrame:
    with _store(s, d) as store:
        puts = [store.put_async(b"async:%d" % k, b"%d" % k) for k in range(8)]
        for p in puts:
            p.result()
        scan, count, get = store.scan_prefix_async(b"async:"), store.count_async(b"async:", b"async:~"), store.get_async(b"async:3")
        swap = store.compare_and_swap_async(b"async:3", b"3", b"swapped")
        out = [("scan", len(scan.result())), ("count", count.result()), ("get_or_swapped", get.result() in (b"3", b"swapped")), ("swap", swap.result()), ("after", store.get(b"async:3"))]
    return _steps(s, out)


def _two_writers(s: SparkSession, d: str) -> DataFrame:
    """Two stores of one path; the later half is written before the older half commits, and is still the newer one."""
    path = _path(s)
    a, b = Store(s, path, Options()), Store(s, path, Options())
    log = _mutations(s, d)
    commit = b._commit

    def late(*args):
        a.append(log.where(F.col("n") <= catalog.AS_OF), order="n")
        return commit(*args)

    b._commit = late
    b.append(log.where(F.col("n") > catalog.AS_OF), order="n")
    return catalog.text(a.scan())


def _replay(s: SparkSession, d: str) -> DataFrame:
    """The older half comes a second time as the same micro-batch, after the newer half: nothing changes."""
    store = Store(s, _path(s), Options())
    log = _mutations(s, d)
    old, new = log.where(F.col("n") <= catalog.AS_OF), log.where(F.col("n") > catalog.AS_OF)
    for number, part in ((0, old), (1, new), (0, old)):
        store.append(part, order="n", stream=("events", number))
    return catalog.text(store.scan())


def _approx_count(s: SparkSession, d: str) -> DataFrame:
    """Counts from metadata: versions by ranges of users, so that each range's files hold its keys and no others, and buffered puts."""
    store = Store(s, _path(s), Options())
    log = _mutations(s, d)
    user = F.decode("key", "UTF-8")
    for low, high in (("user:000000", "user:000019"), ("user:000020", "user:000039"), ("user:000040", "user:999999")):
        store.append(log.where(user.between(low, high)), order="n")
    store.write(WriteBatch().put(b"user:000020", b"x").put(b"user:000020x", b"y").delete(b"user:000021").put(b"zone", b"z"))
    ranges = [("all", None, None), ("second", b"user:000020", b"user:000039~"), ("first_two", None, b"user:000039~"), ("buffer", b"zone", None), ("none", b"zzz", None)]
    return s.createDataFrame([(name, store.approximate_count(low, high)) for name, low, high in ranges], "range string, n long")


QUERIES = {
    "store_scan_levels": _scan_levels,
    "store_compacted": _compacted,
    "store_snapshot": _snapshot,
    "store_old_version": _old_version,
    "store_batch": _batch,
    "store_recovered": _recovered,
    "store_delete_range": _delete_range,
    "store_transactions": _transactions,
    "store_swaps": _swaps,
    "store_stats": _stats,
    "store_streamed": _streamed,
    "store_ttl": _ttl,
    "store_ttl_puts": _ttl_puts,
    "store_get_snapshot": _get_snapshot,
    "store_in_memory": _in_memory,
    "store_damaged_wal": _damaged_wal,
    "store_flush": _flush,
    "store_async": _async,
    "store_two_writers": _two_writers,
    "store_replay": _replay,
    "approx_count_store": _approx_count,
}

ORACLES = {
    "store_scan_levels": catalog.ORACLES["scan_range"],
    "store_compacted": catalog.ORACLES["live_scan_full"],
    "store_snapshot": catalog.ORACLES["snapshot_as_of"],
    "store_old_version": catalog.ORACLES["snapshot_as_of"],
    "store_batch": catalog.ORACLES["batch_apply"],
    "store_recovered": catalog.ORACLES["batch_apply"],
    "store_delete_range": catalog.ORACLES["delete_range_view"],
    "store_transactions": "SELECT * FROM (VALUES ('own_write', '12'), ('before_commit', '1'), ('after_commit', '12'), ('conflict', 'yes'), ('at_last', 'other')) t(step, value)",
    "store_swaps": "SELECT k::INTEGER AS try, s AS swapped, '3' AS at_last FROM (VALUES (0, true), (1, false), (2, true), (3, false)) t(k, s)",
    "store_stats": "SELECT 7::BIGINT AS memtable_bytes, 2::BIGINT AS memtable_entries, true AS has_levels, true AS has_files, true AS has_bytes, true AS has_wal, -1::BIGINT AS block_cache_bytes",
    "store_streamed": catalog.ORACLES["live_scan_full"],
    "store_ttl": f"{catalog._T} SELECT key, value FROM t WHERE op = 'put' AND expiry_ms IS NULL",  # all others have expired by now
    "store_ttl_puts": _values([("a", "none"), ("b", "2"), ("b_later", "none"), ("snapshot", "2"), ("snapshot_later", "none"), ("a_flushed", "none"), ("b_flushed", "2"), ("swap", "true"), ("a_swapped", "4")]),
    "store_get_snapshot": _values([("same", "true"), ("new", "new"), ("not_there_yet", "none"), ("exists", "false"), ("now", "true"), ("closed", "raises")]),
    "store_in_memory": "SELECT key, value FROM (SELECT 'k' || lpad(k::VARCHAR, 3, '0') AS key, CASE WHEN k = 60 THEN 'again' ELSE 'v' || (k * k) END AS value FROM range(0, 200) r(k) WHERE k NOT BETWEEN 50 AND 149 OR k = 60) ORDER BY key DESC LIMIT 60",
    "store_damaged_wal": "SELECT * FROM (VALUES ('all', '1'), ('k0', '0'), ('k1', '1'), ('k9', '9')) t(key, value)",
    "store_flush": "SELECT 41::BIGINT AS keys, '39' AS last, true AS has_files, true AS buffer_is_small",
    "store_async": _values([("scan", "8"), ("count", "8"), ("get_or_swapped", "true"), ("swap", "true"), ("after", "swapped")]),
    "store_two_writers": catalog.ORACLES["live_scan_full"],
    "store_replay": catalog.ORACLES["live_scan_full"],
    "approx_count_store": """WITH k AS (SELECT DISTINCT 'user:' || lpad(user_id::VARCHAR, 6, '0') AS key FROM events),
c AS (SELECT count(*) AS a, count(*) FILTER (key BETWEEN 'user:000020' AND 'user:000039') AS b, count(*) FILTER (key <= 'user:000039') AS f FROM k)
SELECT 'all' AS range, a + 3 AS n FROM c UNION ALL SELECT 'second', b + 2 FROM c UNION ALL SELECT 'first_two', f + 2 FROM c UNION ALL SELECT 'buffer', 1 UNION ALL SELECT 'none', 0""",
}
