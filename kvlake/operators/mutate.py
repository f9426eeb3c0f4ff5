"""Mutations as rows to append to a log."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.operators import view
from kvlake.schema import DELETE, LOG, PUT, Filter


@dataclass
class WriteBatch:
    """Operations that are applied together, in order: the last on a key wins."""

    ops: list[tuple[str, bytes, bytes | None, int | None]] = field(default_factory=list)

    def put(self, key: bytes, value: bytes, ttl_ms: int | None = None) -> WriteBatch:
        if key is None or value is None:
            raise ValueError("a key and a value are needed")
        self.ops.append((PUT, bytes(key), bytes(value), ttl_ms))
        return self

    def delete(self, key: bytes) -> WriteBatch:
        if key is None:
            raise ValueError("a key is needed")
        self.ops.append((DELETE, bytes(key), None, None))
        return self

    def __len__(self) -> int:
        return len(self.ops)


def batch_rows(batch: WriteBatch, base_seq: int, batch_id: int, now_ms: int, enable_ttl: bool = False) -> list[tuple]:
    """A batch's log rows; a TTL without ``enable_ttl`` raises before anything is made. Expiry is fixed here."""
    if not enable_ttl and any(ttl is not None for *_, ttl in batch.ops):
        raise RuntimeError("TTL is not enabled")
    return [(key, value, op, base_seq + k, batch_id, None if ttl is None else now_ms + ttl) for k, (op, key, value, ttl) in enumerate(batch.ops)]


def to_log(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(bytearray(k), None if v is None else bytearray(v), *rest) for k, v, *rest in rows], LOG)


def delete_range(log: DataFrame, low: bytes | None, high: bytes | None, seq: int, batch_id: int, **shown) -> DataFrame:
    """Tombstones for the visible keys in [low, high]; all share ``seq``, as each key occurs once."""
    found = view.live(view.in_range(log, low, high), **shown).select("key")
    return found.select("key", F.lit(None).cast("binary").alias("value"), F.lit(DELETE).alias("op"), F.lit(seq).cast("long").alias("seq"), F.lit(batch_id).cast("long").alias("batch_id"), F.lit(None).cast("long").alias("expiry_ms"))


def compare_and_swap(log: DataFrame, wanted: DataFrame, seq: int, batch_id: int, now_ms: int | None = None, keep: Filter | None = None) -> DataFrame:
    """Puts for those rows of ``wanted`` (key, expected, value; each key once) whose visible value is ``expected`` (null: none). A swapped value has no expiry."""
    now = view.multi_get(log, wanted.select("key"), now_ms=now_ms, keep=keep).withColumnRenamed("value", "current")
    hit = wanted.join(now, "key").where(F.col("current").eqNullSafe(F.col("expected")))
    return hit.select("key", "value", F.lit(PUT).alias("op"), F.lit(seq).cast("long").alias("seq"), F.lit(batch_id).cast("long").alias("batch_id"), F.lit(None).cast("long").alias("expiry_ms"))
