"""The mutation log's schema and the engine's options."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import types as T

PUT, DELETE = "put", "delete"

#: One row a mutation. ``seq`` orders all mutations; the newest of a key decides.
LOG = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("value", T.BinaryType()),
        T.StructField("op", T.StringType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("batch_id", T.LongType(), False),
        T.StructField("expiry_ms", T.LongType()),
    ]
)

#: A native predicate of (key, value): True keeps the pair visible.
Filter = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Options:
    """Settings of a store; out-of-range values raise ValueError.

    The block cache has no counterpart that Spark leaves to us: pages are cached by the operating system. Its settings are
    kept so that they carry over. ``shared``: other processes append to the store as well; transactions and swaps are then
    committed as files, at the very version that they were checked against.
    """

    memtable_size_threshold: int = 4 << 20
    bloom_false_positive_rate: float = 0.01
    level_count: int = 7
    level_zero_file_limit: int = 10
    level_size_multiplier: int = 10
    block_cache_bytes: int = 8 << 20
    block_cache_kind: str = "lru"
    compression: str = "zstd"
    enable_ttl: bool = False
    keep: Filter | None = None
    wal_sync: str = "full"
    wal_sync_interval_ms: int = 200
    in_memory: bool = False
    target_file_bytes: int = 128 << 20
    shared: bool = False

    def __post_init__(self):
        def need(ok: bool, name: str, rule: str) -> None:
            if not ok:
                raise ValueError(f"{name} must be {rule}")

        need(self.memtable_size_threshold > 0, "memtable_size_threshold", "above 0")
        need(0 < self.bloom_false_positive_rate < 1, "bloom_false_positive_rate", "between 0 and 1, both excluded")
        need(self.level_count >= 1, "level_count", "1 at least")
        need(self.level_zero_file_limit >= 1, "level_zero_file_limit", "1 at least")
        need(self.level_size_multiplier >= 2, "level_size_multiplier", "2 at least")
        need(self.block_cache_bytes >= 0, "block_cache_bytes", "0 at least")
        need(self.block_cache_kind in ("lru", "s3fifo"), "block_cache_kind", "lru or s3fifo")
        need(self.compression in ("none", "zstd"), "compression", "none or zstd")
        need(self.wal_sync in ("full", "periodic", "none"), "wal_sync", "full, periodic or none")
        need(self.wal_sync != "periodic" or self.wal_sync_interval_ms > 0, "wal_sync_interval_ms", "above 0")
        need(self.target_file_bytes > 0, "target_file_bytes", "above 0")

    def level_limit(self, level: int) -> int:
        """How many files a level holds before its oldest are merged into the next."""
        return self.level_zero_file_limit * self.level_size_multiplier**level
