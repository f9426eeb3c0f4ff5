import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from kvlake.functions import codec, keys
from kvlake.operators import mutate, view
from kvlake.schema import Options


def log(spark, rows):
    """rows: (key, value or None for a delete, seq, expiry)."""
    return mutate.to_log(spark, [(k, v, "delete" if v is None else "put", s, 0, e) for k, v, s, e in rows])


def pairs(df):
    return [(bytes(r.key), bytes(r.value)) for r in df.collect()]


def brute(rows, now=None, as_of=None, keep=None):
    newest = {}
    for k, v, s, e in sorted(rows, key=lambda r: r[2]):
        if as_of is None or s <= as_of:
            newest[k] = (v, e)
    return sorted((k, v) for k, (v, e) in newest.items() if v is not None and (now is None or e is None or now < e) and (keep is None or keep(k, v)))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    return [(bytes(r.choice([0, 1, 0x7F, 0x80, 0xFF]) for _ in range(r.randint(0, 3))), None if r.random() < 0.2 else bytes([r.randrange(256)] * r.randint(0, 2)), s, r.choice([None, None, 50, 150])) for s in range(1, 400)]


def test_newest_version_decides_before_it_is_hidden(spark, rows):
    l = log(spark, rows).cache()
    for now, as_of in ((None, None), (100, None), (100, 120), (50, 300), (None, 0)):
        assert pairs(view.scan(l, now_ms=now, as_of_seq=as_of)) == brute(rows, now, as_of)
    keep = lambda k, v: v != keys.lit(b"\x42")
    assert pairs(view.scan(l, keep=keep)) == brute(rows, keep=lambda k, v: v != b"\x42")


def test_bounds_are_inclusive_and_open(spark, rows):
    l, all_ = log(spark, rows).cache(), brute(rows)
    for low, high in ((b"\x01", b"\x80"), (b"\x01", b"\x01"), (None, b"\x7f"), (b"\x80", None), (b"\x80", b"\x01"), (b"", b"")):
        want = [(k, v) for k, v in all_ if (low is None or k >= low) and (high is None or k <= high)]
        assert pairs(view.scan(l, low, high)) == want
        assert pairs(view.scan(l, low, high, descending=True)) == want[::-1]
        assert view.count(l, low, high).first().n == len(want)
    assert pairs(view.scan(l, limit=3)) == all_[:3]
    assert pairs(view.scan(l, descending=True, limit=3)) == all_[::-1][:3]


def test_prefixes(spark, rows):
    l, all_ = log(spark, rows).cache(), brute(rows)
    for p in (b"", b"\x01", b"\x01\xff", b"\xff", b"\xff\xff", b"\x00"):
        assert pairs(view.scan_prefix(l, p)) == [(k, v) for k, v in all_ if k.startswith(p)]


def test_get_and_multi_get(spark, rows):
    l, all_ = log(spark, rows).cache(), dict(brute(rows))
    some = sorted({r[0] for r in rows})[::9]
    wanted = spark.createDataFrame([(bytearray(k),) for k in [*some, *some[:2], b"nobody"]], "key binary")
    got = view.multi_get(l, wanted).collect()
    assert len(got) == len(some) + 3
    assert all((None if r.value is None else bytes(r.value)) == all_.get(bytes(r.key)) for r in got)
    for k in some[:3]:
        assert pairs(view.get(l, k)) == ([(k, all_[k])] if k in all_ else [])
        assert view.exists(l, k).first().found == (k in all_)


def test_range_reaches_the_scan(spark, rows, tmp_path):
    log(spark, rows).write.parquet(str(tmp_path / "log"))
    stored = spark.read.parquet(str(tmp_path / "log"))
    for df in (view.scan(stored, b"\x01", b"\x80"), view.scan_prefix(stored, b"\x01"), view.get(stored, b"\x01")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        pushed = plan[plan.index("PushedFilters") :].split("]")[0]
        assert "key" in pushed and ("GreaterThanOrEqual" in pushed or "EqualTo" in pushed)


def test_empty_log(spark):
    l = log(spark, [])
    assert pairs(view.scan(l)) == [] and view.count(l).first().n == 0 and not view.exists(l, b"a").first().found
    assert view.compacted(l).count() == 0


def test_compaction_keeps_what_is_hidden_hidden(spark):
    old = [(b"a", b"old", 1, None)]
    new = [(b"a", b"new", 2, 10), (b"b", b"x", 3, None), (b"c", None, 4, None)]
    merged = view.compacted(log(spark, new), now_ms=20)
    assert pairs(view.scan(log(spark, old).unionByName(merged), now_ms=20)) == [(b"b", b"x")]
    whole = view.compacted(log(spark, old + new), now_ms=20, whole_history=True)
    assert [bytes(r.key) for r in whole.collect()] == [b"b"]


def test_mutations(spark):
    base = [(b"k%d" % i, b"v%d" % i, i + 1, None) for i in range(6)]
    l = log(spark, base)
    gone = view.scan(l.unionByName(mutate.delete_range(l, b"k1", b"k3", 50, 1)))
    assert [k for k, _ in pairs(gone)] == [b"k0", b"k4", b"k5"]
    wanted = spark.createDataFrame([(bytearray(b"k0"), bytearray(b"v0"), bytearray(b"n0")), (bytearray(b"k1"), None, bytearray(b"n1")), (bytearray(b"zz"), None, bytearray(b"nz")), (bytearray(b"k2"), bytearray(b"other"), bytearray(b"n2"))], "key binary, expected binary, value binary")
    after = dict(pairs(view.scan(l.unionByName(mutate.compare_and_swap(l, wanted, 50, 1)))))
    assert (after[b"k0"], after[b"k1"], after[b"k2"], after[b"zz"]) == (b"n0", b"v1", b"v2", b"nz")
    b = mutate.WriteBatch().put(b"a", b"1").put(b"a", b"2").delete(b"b")
    assert pairs(view.scan(mutate.to_log(spark, mutate.batch_rows(b, 1, 1, 0)))) == [(b"a", b"2")]
    with pytest.raises(RuntimeError):
        mutate.batch_rows(mutate.WriteBatch().put(b"a", b"1").put(b"b", b"1", ttl_ms=5), 1, 1, 0)
    with pytest.raises(ValueError):
        mutate.WriteBatch().put(None, b"1")
    diff = {bytes(r.key): (r.before and bytes(r.before), r.after and bytes(r.after)) for r in view.changed(l, 3, 5).collect()}
    assert diff == {b"k3": (None, b"v3"), b"k4": (None, b"v4")}


@settings(max_examples=200, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.binary(max_size=5), st.binary(max_size=6))
def test_successor(prefix, key):
    end = keys.successor(prefix)
    assert key.startswith(prefix) == (key >= prefix and (end is None or key < end)) or (not prefix)
    assert (end is None) == (not prefix.strip(b"\xff"))


@given(st.one_of(st.none(), st.binary(max_size=3)), st.one_of(st.none(), st.binary(max_size=3)))
def test_compare(a, b):
    want = (a is not None) - (b is not None) if a is None or b is None else (a > b) - (a < b)
    assert keys.compare(a, b) == want == -keys.compare(b, a)


def test_codec(spark):
    from pyspark.sql import functions as F

    cases = [(b"", None), (b"x", None), (b"x", 0), (b"long value", 1706659200000), (b"", 99)]
    assert [codec.decode(codec.encode(v, e), 100) for v, e in cases] == [(v, e is not None and e <= 100) for v, e in cases]
    assert codec.decode(b"", 1) == (b"", False) and codec.decode(b"\x01abc", 1) == (b"", True) and codec.decode(b"\x07ab", 1) == (b"ab", False)
    raws = [codec.encode(v, e) for v, e in cases] + [b"", b"\x01abc", b"\x07ab"]
    df = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(raws)], "i int, raw binary")
    got = df.select("i", codec.value_column(F.col("raw")).alias("v"), codec.expiry_column(F.col("raw")).alias("e"), codec.visible_column(F.col("raw"), 100).alias("s")).orderBy("i").collect()
    assert [(bytes(r.v), r.e) for r in got[: len(cases)]] == cases
    assert [r.s for r in got] == [not codec.decode(r, 100)[1] for r in raws]
    src = spark.createDataFrame([(bytearray(v), e) for v, e in cases], "v binary, e long")
    assert [bytes(r[0]) for r in src.select(codec.encode_column(F.col("v"), F.col("e"))).collect()] == [codec.encode(v, e) for v, e in cases]


def test_options():
    assert Options().level_limit(2) == 1000
    for bad in ({"memtable_size_threshold": 0}, {"bloom_false_positive_rate": 1.0}, {"level_count": 0}, {"level_zero_file_limit": 0}, {"level_size_multiplier": 1}, {"block_cache_bytes": -1}, {"wal_sync": "periodic", "wal_sync_interval_ms": 0}):
        with pytest.raises(ValueError):
            Options(**bad)
