"""Byte keys: order, prefixes and literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def compare(a: bytes | None, b: bytes | None) -> int:
    """Unsigned byte order, a prefix before what it starts, None before all: -1, 0 or 1. Spark's BINARY sorts alike."""
    if a is None or b is None:
        return (a is not None) - (b is not None)
    return (a > b) - (a < b)


def successor(prefix: bytes) -> bytes | None:
    """The least key above all keys that start with ``prefix``; None if there is none (empty, or 0xFF bytes alone)."""
    head = prefix.rstrip(b"\xff")
    return head[:-1] + bytes([head[-1] + 1]) if head else None


def lit(key: bytes) -> Column:
    return F.lit(bytearray(key))


def between(column: Column, low: bytes | None = None, high: bytes | None = None) -> Column | None:
    """Both bounds inclusive, None open; None if both are open. Plain comparisons, so that they reach the Parquet scan."""
    parts = [column >= lit(low)] if low is not None else []
    parts += [column <= lit(high)] if high is not None else []
    return parts[0] & parts[1] if len(parts) == 2 else parts[0] if parts else None


def starts_with(column: Column, prefix: bytes) -> Column | None:
    """A prefix test as a range, which is pushed down where ``startswith`` on bytes isn't; None for the empty prefix."""
    if not prefix:
        return None
    end = successor(prefix)
    return (column >= lit(prefix)) & (column < lit(end)) if end is not None else column >= lit(prefix)
