"""Named queries over the driver's tables, each with the same result in SQL.

``events`` serves as a mutation log: a user's events are the versions of the user's key, ``error`` events delete it and
``signup`` events expire an hour later. Keys and values come back as text.
"""

from __future__ import annotations

import atexit
import re
import shutil
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.functions import codec, keys
from kvlake.operators import mutate, view
from kvlake.schema import DELETE, LOG, PUT
from kvlake.sources.manifest import _local

NOW_MS = 1706659200000  # 2024-01-31 00:00 UTC
HOUR_MS = 3600000
AS_OF = 5000
LOW, HIGH = b"user:000010", b"user:000040"


_logs: dict[tuple[str, str, str], str] = {}


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mutation log made of ``events``, written once a session in order of its keys, so that ranges of keys reach the Parquet scan."""
    return _written(spark, sf_dir, "events", _events)


def _written(spark: SparkSession, sf_dir: str, name: str, make: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """A log as Parquet in the shared folder."""
    at = (spark.sparkContext.applicationId, sf_dir, name)
    if at not in _logs:
        path = own_folder(spark, "kvlake-log")
        make(spark, sf_dir).repartitionByRange("key").sortWithinPartitions("key").write.parquet(path)
        _logs[at] = path
    return spark.read.schema(LOG).parquet(_logs[at])


def own_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder (``spark.checkpoint.dir``; a test folder on a local master without it) that goes when the driver ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = "/tmp/checkpoints"
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if (here := _local(path)) is not None:
        atexit.register(shutil.rmtree, here, ignore_errors=True)
    return path


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ms = F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")) / 1000)
    return e.select(
        F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 6, "0")).cast("binary").alias("key"),
        F.concat_ws("#", "event_type", F.col("event_id").cast("string")).cast("binary").alias("value"),
        F.when(F.col("event_type") == "error", DELETE).otherwise(PUT).alias("op"),
        F.col("event_id").alias("seq"),
        F.lit(0).cast("long").alias("batch_id"),
        F.when(F.col("event_type") == "signup", ms + HOUR_MS).alias("expiry_ms"),
    )


def text(df: DataFrame) -> DataFrame:
    """BINARY columns as UTF-8 text."""
    return df.select(*[F.decode(c, "UTF-8").alias(c) if t == "binary" else F.col(c) for c, t in df.dtypes])


def mutations(spark: SparkSession) -> mutate.WriteBatch:
    """A fixed batch: two puts on one key, a delete, a key never seen before, and a delete of a key never seen."""
    b = mutate.WriteBatch()
    return b.put(b"user:000001", b"first").put(b"user:000001", b"second").delete(b"user:000002").put(b"zone:1", b"new").delete(b"zone:2")


def wanted_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third user id up to 600, also ids that never occur."""
    return spark.range(0, 600, 3).select(F.concat(F.lit("user:"), F.lpad(F.col("id").cast("string"), 6, "0")).cast("binary").alias("key"))


def odd_value(key: Column, value: Column) -> Column:
    """A visibility filter: values whose number is odd."""
    return F.substring_index(F.decode(value, "UTF-8"), "#", -1).cast("long") % 2 == 1


def swaps(log: DataFrame) -> DataFrame:
    """Swap requests for users 0 to 99: even ones expect what is there at ``AS_OF``, odd ones expect nothing."""
    ids = log.sparkSession.range(100).select("id", F.concat(F.lit("user:"), F.lpad(F.col("id").cast("string"), 6, "0")).cast("binary").alias("key"))
    before = view.live(log, as_of_seq=AS_OF).withColumnRenamed("value", "before")
    return ids.join(before, "key", "left").select("key", F.when(F.col("id") % 2 == 0, F.col("before")).alias("expected"), F.lit("swapped").cast("binary").alias("value"))


def with_rows(log: DataFrame, more: DataFrame) -> DataFrame:
    return log.unionByName(more.select(log.columns))


TOP = 1 << 40


def _batch_applied(s: SparkSession, d: str) -> DataFrame:
    rows = mutate.batch_rows(mutations(s), TOP, 1, NOW_MS)
    return with_rows(event_log(s, d), mutate.to_log(s, rows))


def _cas_applied(s: SparkSession, d: str) -> DataFrame:
    log = event_log(s, d)
    return with_rows(log, mutate.compare_and_swap(log, swaps(log), TOP, 1))


def _range_deleted(s: SparkSession, d: str) -> DataFrame:
    log = event_log(s, d)
    return with_rows(log, mutate.delete_range(log, LOW, HIGH, TOP, 1))


def _compacted(s: SparkSession, d: str) -> DataFrame:
    """The older half compacted without its tombstones dropped, then read with the newer half."""
    log = event_log(s, d)
    old, new = log.where(F.col("seq") <= AS_OF), log.where(F.col("seq") > AS_OF)
    return with_rows(view.compacted(old, NOW_MS), new)


def _lineitems(s: SparkSession, d: str) -> DataFrame:
    """One version a line: key of order and line number; later ship dates are newer, ties by part, supplier and quantity."""
    li = s.read.parquet(f"{d}/lineitem.parquet")
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    seq = ((day * 10000000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")) * 100 + F.col("l_quantity").cast("long")
    key = F.concat(F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.lit("/"), F.lpad(F.col("l_linenumber").cast("string"), 3, "0"))
    value = F.concat_ws("#", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_returnflag"))
    return li.select(key.cast("binary").alias("key"), value.cast("binary").alias("value"), F.when(F.col("l_returnflag") == "R", DELETE).otherwise(PUT).alias("op"), seq.alias("seq"), F.lit(0).cast("long").alias("batch_id"), F.lit(None).cast("long").alias("expiry_ms"))


def _codec(s: SparkSession, d: str) -> DataFrame:
    """Values written with their expiry header and read back, with the pair's JSON form."""
    log = event_log(s, d).where(F.col("op") == PUT)
    raw = log.select("key", "value", "expiry_ms", codec.encode_column(F.col("value"), F.col("expiry_ms")).alias("raw"))
    back = raw.select("key", codec.value_column(F.col("raw")).alias("value"), codec.expiry_column(F.col("raw")).alias("expiry_ms"), F.octet_length("raw").cast("long").alias("stored_bytes"), codec.visible_column(F.col("raw"), NOW_MS).alias("shown"))
    name, base = codec.json_columns(F.col("key"), F.col("value"))
    return back.select(name, F.decode("value", "UTF-8").alias("text"), base.alias("base64"), "expiry_ms", "stored_bytes", "shown")

def _approx(s: SparkSession, d: str) -> DataFrame:
    """Whether the sketch of a range's keys comes within a tenth of their exact number, and that number."""
    log = event_log(s, d)
    n = view.approx_count(log, LOW, HIGH).first().n
    return view.in_range(log, LOW, HIGH).agg(F.count_distinct("key").alias("keys")).select("keys", (F.abs(F.lit(n) - F.col("keys")) <= 0.1 * F.col("keys")).alias("near"))


QUERIES = {
    "live_scan_full": lambda s, d: text(view.live(event_log(s, d))),
    "scan_range": lambda s, d: text(view.scan(event_log(s, d), LOW, HIGH)),
    "scan_open_from": lambda s, d: text(view.scan(event_log(s, d), low=b"user:000100")),
    "scan_open_to": lambda s, d: text(view.scan(event_log(s, d), high=b"user:000033")),
    "scan_empty_range": lambda s, d: text(view.scan(event_log(s, d), HIGH, LOW)),
    "scan_desc": lambda s, d: text(view.scan(event_log(s, d), LOW, HIGH, descending=True)),
    "scan_desc_topk": lambda s, d: text(view.scan(event_log(s, d), descending=True, limit=10)),
    "scan_prefix": lambda s, d: text(view.scan_prefix(event_log(s, d), b"user:0000")),
    "point_get": lambda s, d: text(view.get(event_log(s, d), b"user:000042")),
    "multi_get": lambda s, d: text(view.multi_get(event_log(s, d), wanted_keys(s, d))),
    "key_exists": lambda s, d: view.exists(event_log(s, d), b"user:000042"),
    "exact_count_range": lambda s, d: view.count(event_log(s, d), LOW, HIGH),
    "approx_count_range": _approx,
    "changed_with_filter": lambda s, d: text(view.changed(event_log(s, d), AS_OF, 2 * AS_OF, NOW_MS, odd_value)),
    "ttl_live": lambda s, d: text(view.live(event_log(s, d), NOW_MS)),
    "filter_live": lambda s, d: text(view.live(event_log(s, d), keep=odd_value)),
    "snapshot_as_of": lambda s, d: text(view.scan(event_log(s, d), LOW, HIGH, as_of_seq=AS_OF)),
    "snapshot_diff": lambda s, d: text(view.changed(event_log(s, d), AS_OF)),
    "delete_range_view": lambda s, d: text(view.live(_range_deleted(s, d))),
    "batch_apply": lambda s, d: text(view.live(_batch_applied(s, d))),
    "cas_apply": lambda s, d: text(view.live(_cas_applied(s, d))),
    "compact_equiv": lambda s, d: text(view.live(_compacted(s, d), NOW_MS)),
    "compact_whole": lambda s, d: text(view.compacted(event_log(s, d), NOW_MS, whole_history=True).select("key", "value", "seq")),
    "codec_roundtrip": _codec,
    "prefix_successor": lambda s, d: s.createDataFrame([(p.hex(), n.hex() if (n := keys.successor(p)) is not None else None) for p in (b"a", b"a\xff", b"\x01\xff\xff", b"\xff\xff", b"", b"\x00")], "prefix string, next string"),
    "lineitem_latest": lambda s, d: text(view.live(_written(s, d, "lineitem", _lineitems))),
}

_L = """l AS (SELECT 'user:' || lpad(user_id::VARCHAR, 6, '0') AS key, event_type || '#' || event_id AS value, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op,
  event_id AS seq, CASE WHEN event_type = 'signup' THEN epoch_us(ts) // 1000 + 3600000 END AS expiry_ms FROM events)"""
_NEWEST = "SELECT * FROM {0} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1"
_T = f"WITH {_L}, t AS ({_NEWEST.format('l')}), v AS (SELECT key, value FROM t WHERE op = 'put')"


def _more(rows: str, also: str = "") -> str:
    """The live view of the log with more rows (key, value, op, seq, expiry_ms)."""
    return f"WITH {_L}, b AS ({_NEWEST.format('l')}), {also} m AS (SELECT * FROM l UNION ALL {rows}), t AS ({_NEWEST.format('m')}) SELECT key, value FROM t WHERE op = 'put'"


ORACLES = {
    "live_scan_full": f"{_T} SELECT key, value FROM v",
    "scan_range": f"{_T} SELECT key, value FROM v WHERE key BETWEEN 'user:000010' AND 'user:000040'",
    "scan_open_from": f"{_T} SELECT key, value FROM v WHERE key >= 'user:000100'",
    "scan_open_to": f"{_T} SELECT key, value FROM v WHERE key <= 'user:000033'",
    "scan_empty_range": f"{_T} SELECT key, value FROM v WHERE key >= 'user:000040' AND key <= 'user:000010'",
    "scan_desc": f"{_T} SELECT key, value FROM v WHERE key BETWEEN 'user:000010' AND 'user:000040' ORDER BY key DESC",
    "scan_desc_topk": f"{_T} SELECT key, value FROM v ORDER BY key DESC LIMIT 10",
    "scan_prefix": f"{_T} SELECT key, value FROM v WHERE starts_with(key, 'user:0000')",
    "point_get": f"{_T} SELECT key, value FROM v WHERE key = 'user:000042'",
    "multi_get": f"{_T} SELECT w.key, v.value FROM (SELECT 'user:' || lpad(i::VARCHAR, 6, '0') AS key FROM range(0, 600, 3) r(i)) w LEFT JOIN v ON w.key = v.key",
    "key_exists": f"{_T} SELECT count(*) > 0 AS found FROM v WHERE key = 'user:000042'",
    "exact_count_range": f"{_T} SELECT count(*) AS n FROM v WHERE key BETWEEN 'user:000010' AND 'user:000040'",
    "approx_count_range": f"WITH {_L} SELECT count(DISTINCT key) AS keys, true AS near FROM l WHERE key BETWEEN 'user:000010' AND 'user:000040'",
    "changed_with_filter": f"""WITH {_L}, {", ".join(f"{x} AS (SELECT key, value FROM ({_NEWEST.format('(SELECT * FROM l WHERE seq <= ' + str(n) + ') q')}) z WHERE op = 'put' AND (expiry_ms IS NULL OR expiry_ms > {NOW_MS}) AND split_part(value, '#', 2)::BIGINT % 2 = 1)" for x, n in (("a", AS_OF), ("b", 2 * AS_OF)))}
SELECT coalesce(a.key, b.key) AS key, a.value AS before, b.value AS after FROM a FULL JOIN b ON a.key = b.key WHERE a.value IS DISTINCT FROM b.value""",
    "ttl_live": f"{_T} SELECT key, value FROM t WHERE op = 'put' AND (expiry_ms IS NULL OR expiry_ms > {NOW_MS})",
    "filter_live": f"{_T} SELECT key, value FROM v WHERE split_part(value, '#', 2)::BIGINT % 2 = 1",
    "snapshot_as_of": f"WITH {_L}, s AS (SELECT * FROM l WHERE seq <= {AS_OF}), t AS ({_NEWEST.format('s')}) SELECT key, value FROM t WHERE op = 'put' AND key BETWEEN 'user:000010' AND 'user:000040'",
    "snapshot_diff": f"""{_T}, s AS (SELECT * FROM l WHERE seq <= {AS_OF}), u AS ({_NEWEST.format('s')}), a AS (SELECT key, value FROM u WHERE op = 'put')
SELECT coalesce(a.key, v.key) AS key, a.value AS before, v.value AS after FROM a FULL JOIN v ON a.key = v.key WHERE a.value IS DISTINCT FROM v.value""",
    "delete_range_view": _more("SELECT key, NULL, 'delete', 1099511627776, NULL FROM b WHERE op = 'put' AND key BETWEEN 'user:000010' AND 'user:000040'"),
    "batch_apply": _more("SELECT * FROM (VALUES ('user:000001', 'first', 'put', 1099511627776, NULL), ('user:000001', 'second', 'put', 1099511627777, NULL), ('user:000002', NULL, 'delete', 1099511627778, NULL), ('zone:1', 'new', 'put', 1099511627779, NULL), ('zone:2', NULL, 'delete', 1099511627780, NULL)) x"),
    "cas_apply": _more(
        "SELECT w.key, 'swapped', 'put', 1099511627776, NULL FROM w LEFT JOIN (SELECT key, value FROM b WHERE op = 'put') c ON w.key = c.key WHERE c.value IS NOT DISTINCT FROM w.expected",
        f"o AS ({_NEWEST.format('(SELECT * FROM l WHERE seq <= ' + str(AS_OF) + ') q')}), w AS (SELECT 'user:' || lpad(i::VARCHAR, 6, '0') AS key, CASE WHEN i % 2 = 0 THEN o.value END AS expected FROM range(0, 100) r(i) LEFT JOIN (SELECT * FROM o WHERE op = 'put') o ON o.key = 'user:' || lpad(i::VARCHAR, 6, '0')),",
    ),
    "compact_equiv": f"{_T} SELECT key, value FROM t WHERE op = 'put' AND (expiry_ms IS NULL OR expiry_ms > {NOW_MS})",
    "compact_whole": f"{_T} SELECT key, value, seq FROM t WHERE op = 'put' AND (expiry_ms IS NULL OR expiry_ms > {NOW_MS})",
    "codec_roundtrip": f"WITH {_L} SELECT key, value AS text, base64(value::BLOB) AS base64, expiry_ms, (strlen(value) + CASE WHEN expiry_ms IS NULL THEN 1 ELSE 9 END)::BIGINT AS stored_bytes, coalesce(expiry_ms > {NOW_MS}, true) AS shown FROM l WHERE op = 'put'",
    "prefix_successor": "SELECT * FROM (VALUES ('61', '62'), ('61ff', '62'), ('01ffff', '02'), ('ffff', NULL), ('', NULL), ('00', '01')) t(prefix, next)",
    "lineitem_latest": f"""WITH l AS (SELECT lpad(l_orderkey::VARCHAR, 12, '0') || '/' || lpad(l_linenumber::VARCHAR, 3, '0') AS key, l_partkey || '#' || l_suppkey || '#' || l_returnflag AS value, l_returnflag,
  ((datediff('day', DATE '1970-01-01', l_shipdate::DATE)::BIGINT * 10000000 + l_partkey) * 10000 + l_suppkey) * 100 + l_quantity::BIGINT AS seq FROM lineitem), t AS ({_NEWEST.format('l')})
SELECT key, value FROM t WHERE l_returnflag <> 'R'""",
}
