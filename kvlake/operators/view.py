"""The live view of a mutation log, and reads of it.

Of each key the newest mutation decides, and only then do tombstones, expiry and the visibility filter hide it: a hidden
newest version never lets an older one through. All functions take and return DataFrames and run nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvlake.functions import keys
from kvlake.schema import DELETE, PUT, Filter


def newest(log: DataFrame, as_of_seq: int | None = None) -> DataFrame:
    """The newest mutation of each key, tombstones included. A rank of 1 keeps one row a key and task before the shuffle."""
    if as_of_seq is not None:
        log = log.where(F.col("seq") <= as_of_seq)
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.col("seq").desc()))
    return log.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def visible(now_ms: int | Column | None = None, keep: Filter | None = None) -> Column:
    """What of the newest versions is shown. Without ``now_ms`` expiries are not looked at."""
    shown = F.col("op") == PUT
    if now_ms is not None:
        shown = shown & (F.col("expiry_ms").isNull() | (F.col("expiry_ms") > now_ms))
    return shown if keep is None else shown & F.coalesce(keep(F.col("key"), F.col("value")), F.lit(False))


def live(log: DataFrame, now_ms: int | Column | None = None, keep: Filter | None = None, as_of_seq: int | None = None) -> DataFrame:
    """key, value of every visible pair."""
    return newest(log, as_of_seq).where(visible(now_ms, keep)).select("key", "value")


def in_range(log: DataFrame, low: bytes | None, high: bytes | None) -> DataFrame:
    """The mutations of keys in [low, high]."""
    inside = keys.between(F.col("key"), low, high)
    return log if inside is None else log.where(inside)


def scan(log: DataFrame, low: bytes | None = None, high: bytes | None = None, descending: bool = False, limit: int | None = None, **view) -> DataFrame:
    """Pairs with keys in [low, high] in key order. Bounds filter the log itself; a limit becomes a top-k without a full sort."""
    key = F.col("key")
    out = live(in_range(log, low, high), **view).orderBy(key.desc() if descending else key.asc())
    return out if limit is None else out.limit(limit)


def scan_prefix(log: DataFrame, prefix: bytes, **view) -> DataFrame:
    """Pairs whose key starts with ``prefix``, in key order."""
    inside = keys.starts_with(F.col("key"), prefix)
    return live(log if inside is None else log.where(inside), **view).orderBy("key")


def get(log: DataFrame, key: bytes, **view) -> DataFrame:
    """The pair of one key: one row or none."""
    return live(log.where(F.col("key") == keys.lit(key)), **view)


def exists(log: DataFrame, key: bytes, **view) -> DataFrame:
    """One row with a boolean ``found``."""
    return get(log, key, **view).agg((F.count("*") > 0).alias("found"))


def multi_get(log: DataFrame, wanted: DataFrame, **view) -> DataFrame:
    """Every row of ``wanted`` (a column ``key``) with its value, null where there is none. The log is cut down to the wanted keys before versions are compared."""
    few = wanted.select("key").distinct()
    return wanted.join(live(log.join(few, "key", "left_semi"), **view), "key", "left")


def count(log: DataFrame, low: bytes | None = None, high: bytes | None = None, **view) -> DataFrame:
    """One row: the exact number ``n`` of visible keys in a range."""
    return live(in_range(log, low, high), **view).agg(F.count("*").alias("n"))


def approx_count(log: DataFrame, low: bytes | None = None, high: bytes | None = None, error: float = 0.02) -> DataFrame:
    """One row: about how many keys ``n`` a range of the log mentions, by a sketch; ignores deletes, expiry and filter."""
    return in_range(log, low, high).agg(F.approx_count_distinct("key", error).alias("n"))


def changed(log: DataFrame, since_seq: int, until_seq: int | None = None, now_ms: int | None = None, keep: Filter | None = None) -> DataFrame:
    """key, before, after: keys whose visible value differs between two points of the log; null where there is none. One aggregate finds both versions."""
    row = F.struct("op", "value", "expiry_ms")
    at = lambda seq: F.max_by(row, F.col("seq") if seq is None else F.when(F.col("seq") <= seq, F.col("seq")))
    both = log.groupBy("key").agg(at(since_seq).alias("a"), at(until_seq).alias("b"))
    for side, name in (("a", "before"), ("b", "after")):
        both = both.select("*", f"{side}.*").withColumn(name, F.when(visible(now_ms, keep), F.col("value"))).drop("op", "value", "expiry_ms")
    return both.select("key", "before", "after").where(~F.col("before").eqNullSafe(F.col("after")))


def compacted(log: DataFrame, now_ms: int | None = None, keep: Filter | None = None, whole_history: bool = False) -> DataFrame:
    """The log's newest mutations alone. A hidden newest version turns into a tombstone, so that older versions outside
    of ``log`` stay hidden; with the whole history at hand, tombstones go."""
    out = newest(log)
    shown = visible(now_ms, keep)
    if whole_history:
        return out.where(shown)
    hide = lambda c, kind: F.when(shown, F.col(c)).otherwise(F.lit(None).cast(kind)).alias(c)
    return out.select("key", hide("value", "binary"), F.when(shown, F.lit(PUT)).otherwise(F.lit(DELETE)).alias("op"), "seq", "batch_id", hide("expiry_ms", "long"))
