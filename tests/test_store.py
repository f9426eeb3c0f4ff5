import base64
import glob
import json
import os
import threading
import time
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from kvlake import shell
from kvlake.operators.mutate import WriteBatch
from kvlake.schema import Options
from kvlake.sources.manifest import ConcurrentCommit, DataFile, Manifest, ManifestLog
from kvlake.sources import http
from kvlake.sources import store as store_module
from kvlake.sources.store import Store, TransactionConflict, write_json_batch
from kvlake.sources.wal import Wal
from kvlake.streaming.ingest import ingest


def pairs(df):
    return [(bytes(r.key), bytes(r.value)) for r in df.collect()]


def test_buffer_flush_and_reopen(spark, tmp_path):
    path = str(tmp_path / "db")
    s = Store(spark, path, Options(memtable_size_threshold=64))
    s.put(b"a", b"1")
    s.put(b"b", b"x" * 80)  # flushes
    s.delete(b"a")
    s.put(b"c", b"3")
    assert s.stats().file_count == 1 and s.stats().memtable_entries == 2 and s.stats().wal_bytes > 0
    want = [(b"b", b"x" * 80), (b"c", b"3")]
    assert pairs(s.scan()) == want
    s.close()
    s = Store(spark, path, Options(memtable_size_threshold=64))
    assert pairs(s.scan()) == want and s.get(b"a") is None and s.exists(b"c")
    s.flush()
    assert s.stats().memtable_entries == 0 and pairs(s.scan_descending()) == want[::-1]
    assert s.count(b"b", b"b") == 1 and s.approximate_count(b"b", b"zz") >= 2
    assert s.get_async(b"c").result() == b"3"
    assert len(s.scan_async().result()) == 2
    s.close()


def test_damaged_wal_tail(spark, tmp_path):
    path = str(tmp_path / "db")
    s = Store(spark, path)
    s.put(b"a", b"1")
    s.put(b"b", b"2")
    s.close()
    with open(f"{path}/wal/log", "r+b") as f:
        f.seek(-3, os.SEEK_END)
        f.write(b"?")
    s = Store(spark, path)
    assert pairs(s.scan()) == [(b"a", b"1")]
    s.put(b"c", b"3")
    s.close()
    assert pairs(Store(spark, path).scan()) == [(b"a", b"1"), (b"c", b"3")]


def test_damaged_manifest_falls_back(spark, tmp_path):
    path = str(tmp_path / "db")
    s = Store(spark, path)
    s.append(spark.createDataFrame([(bytearray(b"a"), bytearray(b"1"))], "key binary, value binary"))
    s.append(spark.createDataFrame([(bytearray(b"b"), bytearray(b"2"))], "key binary, value binary"))
    newest = sorted(glob.glob(f"{path}/manifest/v*.json"))[-1]
    with open(newest, "r+b") as f:
        f.seek(30)
        f.write(b"#")
    s = Store(spark, path)
    assert pairs(s.scan()) == [(b"a", b"1")]
    s.append(spark.createDataFrame([(bytearray(b"c"), bytearray(b"3"))], "key binary, value binary"))
    assert pairs(s.scan()) == [(b"a", b"1"), (b"c", b"3")]


def test_snapshot_transaction_and_swap(spark):
    s = Store.in_memory(spark)
    s.put(b"a", b"1")
    snap = s.snapshot()
    s.put(b"a", b"2")
    assert snap.get(b"a") == b"1" and s.get(b"a") == b"2"
    snap.close()
    with pytest.raises(RuntimeError):
        snap.get(b"a")
    t = s.begin()
    assert t.get(b"a") == b"2" and t.get(b"no") is None
    t.put(b"a", b"3")
    assert t.get(b"a") == b"3" and s.get(b"a") == b"2"
    t.commit()
    assert s.get(b"a") == b"3"
    t = s.begin()
    t.get(b"a")
    t.delete(b"a")
    s.put(b"a", b"other")
    with pytest.raises(TransactionConflict):
        t.commit()
    with pytest.raises(RuntimeError):
        t.put(b"a", b"x")
    t.rollback()
    assert s.get(b"a") == b"other"
    assert not s.compare_and_swap(b"a", None, b"x") and s.compare_and_swap(b"a", b"other", b"x") and s.compare_and_swap(b"n", None, b"y")
    assert s.get(b"a") == b"x" and s.get(b"n") == b"y"
    s.delete_range(b"a", b"m")
    assert pairs(s.scan()) == [(b"n", b"y")]
    with pytest.raises(ValueError):
        Store(spark, None, Options(in_memory=False))


def test_ttl(spark):
    s = Store.in_memory(spark, Options(in_memory=True, enable_ttl=True))
    s.put(b"a", b"1")
    s.put(b"a", b"2", ttl_ms=-1)
    s.put(b"b", b"3", ttl_ms=3600_000)
    assert s.get(b"a") is None and s.get(b"b") == b"3"
    assert s.compare_and_swap(b"a", None, b"4") and s.get(b"a") == b"4"
    with pytest.raises(RuntimeError):
        Store.in_memory(spark).put(b"a", b"1", ttl_ms=5)


def test_compaction(spark, tmp_path):
    o = Options(level_zero_file_limit=2, level_size_multiplier=2, keep=lambda k, v: v != F.lit(bytearray(b"drop")))
    s = Store(spark, str(tmp_path / "db"), o)
    frame = lambda rows: spark.createDataFrame([(bytearray(k), None if v is None else bytearray(v), "put" if v is not None else "delete") for k, v in rows], "key binary, value binary, op string")
    want = {}
    for n in range(5):
        rows = [(b"k%d" % i, b"v%d-%d" % (n, i)) for i in range(n, n + 4)] + [(b"x", b"drop" if n == 3 else b"keep%d" % n)] + ([(b"k1", None)] if n == 2 else [])
        rows = list(dict(rows).items())
        s.append(frame(rows))
        want |= dict(rows)
    shown = sorted((k, v) for k, v in want.items() if v is not None and v != b"drop")
    assert s.stats().files_per_level[0] < 2 and sum(s.stats().files_per_level[1:]) >= 1
    assert pairs(s.scan()) == shown
    s.append(frame([(b"x", b"drop")]))
    s.compact()
    assert pairs(s.scan()) == [p for p in shown if p[0] != b"x"] and s.stats().file_count == 1
    assert s.log().where("op = 'delete'").count() == 0
    before = len(glob.glob(f"{tmp_path}/db/data/*/*.parquet"))
    assert s.vacuum() == before - 1 and len(pairs(s.scan())) == len(shown) - 1


def test_append_orders_and_deletes_ranges(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db"))
    rows = [(bytearray(b"a"), bytearray(b"%d" % i), i) for i in range(5)] + [(bytearray(b"b"), bytearray(b"z"), 0)]
    s.append(spark.createDataFrame(rows, "key binary, value binary, n long"), order="n")
    assert pairs(s.scan()) == [(b"a", b"4"), (b"b", b"z")]
    s.put(b"a", b"later")
    assert s.get(b"a") == b"later"
    s.delete_range(b"b")
    assert pairs(s.scan()) == [(b"a", b"later")]
    assert s.stats_frame().first().file_count >= 2
    write_json_batch(s, [{"op": "put", "key": "j", "value": "aGk="}, {"op": "delete", "key": "a"}])
    assert pairs(s.scan()) == [(b"j", b"hi")]
    with pytest.raises(ValueError):
        write_json_batch(s, [{"op": "put", "key": "q"}, {"op": "twist", "key": "j"}])
    assert s.get(b"q") is None


def test_two_writers(spark, tmp_path):
    log = ManifestLog(spark, str(tmp_path / "db"))
    log.commit(Manifest(version=1))
    with pytest.raises(ConcurrentCommit):
        log.commit(Manifest(version=1, next_seq=9))
    assert log.read().next_seq == 1
    path = str(tmp_path / "two")
    a, b = Store(spark, path), Store(spark, path)
    a.append(spark.createDataFrame([(bytearray(b"a"), bytearray(b"1"))], "key binary, value binary"))
    b.append(spark.createDataFrame([(bytearray(b"b"), bytearray(b"2"))], "key binary, value binary"))
    assert pairs(a.scan()) == [(b"a", b"1"), (b"b", b"2")] and a.at_version(1).count() == 1


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(bytearray(b"k%d" % (i % 3)), bytearray(b"v%d" % i), i) for i in range(9)], "key binary, value binary, n long").coalesce(1).write.parquet(src)
    s = Store(spark, str(tmp_path / "db"))
    stream = spark.readStream.schema("key binary, value binary, n long").parquet(src)
    ingest(stream, s, str(tmp_path / "cp"), order="n").awaitTermination(60)
    assert pairs(s.scan()) == [(b"k0", b"v6"), (b"k1", b"v7"), (b"k2", b"v8")]


def test_shell(spark):
    s = Store.in_memory(spark)
    assert [shell.execute(s, x) for x in ("put a 1", "get a", "del a", "get a", "scan", "put a 1 5", "what", "", "exit")][:5] == ["ok", "1", "ok", "(none)", "(none)"]
    assert shell.execute(s, "put a 1 5").startswith("error") and shell.execute(s, "quit") is None


def test_batch_is_whole_or_nothing(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db"))
    with pytest.raises(RuntimeError):
        s.write(WriteBatch().put(b"a", b"1").put(b"b", b"2", ttl_ms=1))
    assert s.count() == 0
    s.write(WriteBatch())
    assert s.stats().memtable_entries == 0


def frame(spark, *rows):
    return spark.createDataFrame([(bytearray(k), bytearray(v)) for k, v in rows], "key binary, value binary")


def test_appends_that_overlap_are_ordered_by_their_commits(spark, tmp_path):
    """Both are written before either commits; the one that commits later is newer."""
    path = str(tmp_path / "db")
    a, b = Store(spark, path), Store(spark, path)
    commit = a._commit

    def late(*args):
        b.append(frame(spark, (b"k", b"first")))
        return commit(*args)

    a._commit = late
    a.append(frame(spark, (b"k", b"second")))
    assert a.get(b"k") == b.get(b"k") == b"second"
    seqs = [r.seq for r in a.log().collect()]
    assert len(seqs) == len(set(seqs)) == 2
    a._commit = commit
    # a buffered put is newer than what others commit, before its flush and after
    a.put(b"k", b"buffered")
    b.append(frame(spark, (b"k", b"other")))
    assert a.get(b"k") == b"buffered" and b.get(b"k") == b"other"
    a.flush()
    assert a.get(b"k") == b.get(b"k") == b"buffered"


def test_shared_store_checks_the_version_it_commits_to(spark, tmp_path):
    path = str(tmp_path / "db")
    a, b = Store(spark, path, Options(shared=True)), Store(spark, path)
    assert a.compare_and_swap(b"k", None, b"1") and not a.compare_and_swap(b"k", None, b"2") and a.stats().memtable_entries == 0
    t = a.begin()
    assert t.get(b"k") == b"1"
    t.put(b"k", b"mine")
    write = a._write_files
    a._write_files = lambda *x: (b.append(frame(spark, (b"k", b"theirs"))), write(*x))[1]  # between check and commit
    with pytest.raises(TransactionConflict):
        t.commit()
    a._write_files = write
    assert a.get(b"k") == b"theirs"
    t = a.begin()
    t.put(b"n", b"1")
    t.commit()
    assert b.get(b"n") == b"1"


def test_replayed_micro_batch_is_passed_over(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db"))
    old = frame(spark, (b"k", b"old"))
    assert s.append(old, stream=("q", 3))
    s.append(frame(spark, (b"k", b"new")))
    assert not s.append(old, stream=("q", 3)) and not s.append(old, stream=("q", 2)) and s.get(b"k") == b"new"
    assert s.append(old, stream=("other", 3)) and s.append(frame(spark, (b"k", b"next")), stream=("q", 4)) and s.get(b"k") == b"next"


def test_stream_is_known_by_its_query(spark, tmp_path):
    src = str(tmp_path / "in")
    frame(spark, (b"k", b"1")).coalesce(1).write.parquet(src)
    s = Store(spark, str(tmp_path / "db"))
    query = ingest(spark.readStream.schema("key binary, value binary").parquet(src), s, str(tmp_path / "cp"))
    query.awaitTermination(60)
    assert list(s._manifest().streams) == [str(query.id)]


def test_relative_path_and_path_without_a_log(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    at = spark.sparkContext._jvm.java.lang.System.getProperty("user.dir")
    name = os.path.relpath(str(tmp_path / "reldb"), at)
    with Store(spark, name) as s:
        s.put(b"a", b"1")
    assert os.path.isdir(tmp_path / "reldb" / "wal")
    assert Store(spark, name).get(b"a") == Store(spark, str(tmp_path / "reldb")).get(b"a") == b"1"
    # a file system that isn't mounted: each write is committed, or with wal_sync none at the end
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    (tmp_path / "far").mkdir()
    conf.set("fs.viewfs.mounttable.far.link./db", f"file://{tmp_path}/far")
    with Store(spark, "viewfs://far/db") as s:
        s.put(b"a", b"1")
        assert s.stats().file_count == 1 and s.stats().wal_bytes == -1
        s.append(frame(spark, (b"b", b"2")))
    assert pairs(Store(spark, "viewfs://far/db").scan()) == [(b"a", b"1"), (b"b", b"2")]
    with Store(spark, "viewfs://far/db", Options(wal_sync="none")) as s:
        s.put(b"c", b"3")
        assert s.stats().file_count == 2
    assert Store(spark, "viewfs://far/db").get(b"c") == b"3"


def test_recovery_after_a_flush_that_left_its_log(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db"))
    s.put(b"a", b"1")
    s._wal.clear = lambda: None  # gone between commit and clearing the log
    s.flush()
    s.append(frame(spark, (b"a", b"2")))
    s.close()
    s = Store(spark, str(tmp_path / "db"))
    assert s.stats().memtable_entries == 0 and s.get(b"a") == b"2"
    s.put(b"a", b"3")
    s.close()
    assert Store(spark, str(tmp_path / "db")).get(b"a") == b"3"


def test_periodic_sync(tmp_path):
    w = Wal(str(tmp_path / "log"), "periodic", 20)
    w.append([(b"k", b"v", "put", 1, 1, None)])
    for _ in range(200):
        if w.synced():
            break
        time.sleep(0.02)
    assert w.synced()
    w.close()
    assert len(Wal(str(tmp_path / "log")).rows) == 1


def test_files_are_described_by_their_footers(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db"), Options(target_file_bytes=1000))
    rows = [(b"k%05d" % k, b"v%d" % (k * 7919 % 1009)) for k in range(3000)]
    s.append(frame(spark, *rows))
    described = s._described(s._manifest().files[0].path.rpartition("/")[0])
    s.compact()
    m = s._manifest()
    assert len(m.files) > 3 and sum(f.rows for f in m.files) == 3000 and all(f.base == 0 for f in m.files)
    assert [bytes.fromhex(f.low) for f in m.files] == sorted(bytes.fromhex(f.low) for f in m.files)
    assert s.approximate_count() == 3000 and 10 <= s.approximate_count(b"k00010", b"k00019") < 3000 and s.approximate_count(b"z") == 0
    s.put(b"k00011", b"x")
    s.delete(b"k00012")
    inside = s._manifest().files[0]
    assert s.approximate_count(b"k00010", b"k00019") == 1 + sum(f.rows_in(b"k00010", b"k00019") for f in s._manifest().files) and inside.rows_in(None, None) == inside.rows
    # the scan tells the same
    here, store_module._local = store_module._local, lambda path: None
    try:
        scanned = s._described(m.files[0].path.rpartition("/")[0])
    finally:
        store_module._local = here
    assert [(f, n, size, a, z) for f, n, size, a, z, *_ in scanned] == [(f, n, size, a, z) for f, n, size, a, z, *_ in s._described(m.files[0].path.rpartition("/")[0])]
    assert described[0][6] == 0


def test_many_files_are_described_in_tasks(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path / "db"), Options(target_file_bytes=1000))
    s.append(frame(spark, *[(b"k%05d" % k, b"v%d" % (k * 7919 % 1009)) for k in range(3000)]))
    s.compact()
    name = s._manifest().files[0].path.rpartition("/")[0]
    alone = s._described(name)
    monkeypatch.setattr(store_module, "DRIVER_FOOTERS", 0)
    assert s._described(name) == alone


def test_http_shapes(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db"))
    run = http.server(s)
    threading.Thread(target=run.serve_forever, daemon=True).start()

    def ask(method, path, body=None):
        r = urllib.request.Request(f"http://127.0.0.1:{run.server_port}/v1/{path}", data=body, method=method)
        try:
            with urllib.request.urlopen(r, timeout=60) as x:
                return x.status, x.read()
        except urllib.error.HTTPError as e:
            return e.code, e.read()

    assert ask("GET", "keys/users/1") == (404, b"")
    assert ask("PUT", "keys/users/1", b"\x00one") == (204, b"") and ask("GET", "keys/users/1") == (200, b"\x00one")
    ops = [{"op": "put", "key": "users/2", "value": "dHdv"}, {"op": "put", "key": "x"}, {"op": "delete", "key": "no"}]
    assert ask("POST", "batch", json.dumps(ops).encode()) == (204, b"")
    pair = lambda k, v: {"key": k, "value": base64.b64encode(v).decode()}
    assert json.loads(ask("GET", "scan?prefix=users/&from=zzz")[1]) == [pair("users/1", b"\x00one"), pair("users/2", b"two")]
    assert json.loads(ask("GET", "scan?from=users/2")[1]) == [pair("users/2", b"two"), pair("x", b"")]
    assert json.loads(ask("GET", "scan?to=users/1")[1]) == [pair("users/1", b"\x00one")]
    assert ask("DELETE", "keys/x") == (204, b"") and ask("GET", "keys/x")[0] == 404
    stats = json.loads(ask("GET", "stats")[1])
    assert set(stats) == set(http.STATS.values()) and stats["memTableEntryCount"] == 4
    assert ask("POST", "batch", b"{")[0] == ask("POST", "batch", b'[{"op": "twist", "key": "a"}]')[0] == 400 and ask("GET", "else")[0] == 404
    run.shutdown()


def test_manifest_in_segments(spark, tmp_path):
    log = ManifestLog(spark, str(tmp_path / "db"))
    files = tuple(DataFile(f"data/x/{k:05d}.parquet", 0, 1, 1, "00", "ff", ((1, "00", "ff"),)) for k in range(5000))
    log.commit(Manifest(version=1, files=files))
    written = set(glob.glob(f"{tmp_path}/db/manifest/s*.json"))
    assert 5 < len(written) < 60
    changed = files[:2000] + files[2001:] + (DataFile("data/y/new.parquet", 1, 1, 1, "00", "ff"),)
    log.commit(Manifest(version=2, files=changed))
    assert len(set(glob.glob(f"{tmp_path}/db/manifest/s*.json")) - written) <= 3
    again = ManifestLog(spark, str(tmp_path / "db"))
    assert again.read().files == changed and again.read(1).files == files
    # a damaged segment of the newest version makes the one before it count
    new = (set(glob.glob(f"{tmp_path}/db/manifest/s*.json")) - written).pop()
    with open(new, "r+b") as f:
        f.seek(40)
        f.write(b"#")
    assert ManifestLog(spark, str(tmp_path / "db")).read().version == 1


def test_vacuum_forgets_old_versions(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db"))
    for k in range(3):
        s.append(frame(spark, (b"k", b"%d" % k)))
    s.compact()
    files, _ = s._write_files(s.log(), 0)  # about to be listed
    s.vacuum(2)
    assert os.path.exists(f"{tmp_path}/db/{files[0].path}")
    assert s._manifests.versions() == [3, 4] and s.get(b"k") == b"2" and s.at_version(3).get(b"k") == b"2"
