"""Values with an expiry header, and the JSON shape of pairs.

A stored value is a flag byte and the value, or flag 1, the expiry as a little-endian 64-bit count of milliseconds, and the
value. The log keeps expiries in a column of their own; these functions read and write the byte form for exchange.
"""

from __future__ import annotations

import base64
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode(value: bytes, expiry_ms: int | None = None) -> bytes:
    return b"\0" + value if expiry_ms is None else b"\1" + struct.pack("<q", expiry_ms) + value


def decode(raw: bytes, now_ms: int) -> tuple[bytes, bool]:
    """The value and whether it has expired. Empty stays empty; a cut header counts as expired; an unknown flag is one byte."""
    if not raw:
        return b"", False
    if raw[0] != 1:
        return raw[1:], False
    if len(raw) < 9:
        return b"", True
    return raw[9:], now_ms >= struct.unpack_from("<q", raw, 1)[0]


def encode_column(value: Column, expiry_ms: Column | None = None) -> Column:
    """``encode`` for a BINARY column; rows with a null expiry have none."""
    plain = F.concat(F.lit(bytearray(b"\0")), value)
    if expiry_ms is None:
        return plain
    digits = F.lpad(F.hex(expiry_ms), 16, "0")
    little = F.concat(*[F.substring(digits, 15 - 2 * k, 2) for k in range(8)])
    return F.when(expiry_ms.isNull(), plain).otherwise(F.concat(F.lit(bytearray(b"\1")), F.unhex(little), value))


def expiry_column(raw: Column) -> Column:
    """The expiry in milliseconds of stored values, null without one (or with a cut header). Times from 1970 on."""
    digits = F.hex(raw)
    big = F.concat(*[F.substring(digits, 17 - 2 * k, 2) for k in range(8)])
    return F.when((F.substring(digits, 1, 2) == "01") & (F.length(digits) >= 18), F.conv(big, 16, 10).cast("decimal(20,0)").cast("long"))


def value_column(raw: Column) -> Column:
    """The value part of stored values; null where the header is cut."""
    digits = F.hex(raw)
    timed = F.substring(digits, 1, 2) == "01"
    return F.when(F.length(digits) == 0, raw).when(timed & (F.length(digits) >= 18), F.unhex(F.substring(digits, 19, 1 << 30))).when(~timed, F.unhex(F.substring(digits, 3, 1 << 30)))


def visible_column(raw: Column, now_ms: int) -> Column:
    """Whether stored values are there at ``now_ms``: not expired, and no cut header."""
    timed = F.substring(F.hex(raw), 1, 2) == "01"
    return F.when(timed, F.coalesce(expiry_column(raw) > now_ms, F.lit(False))).otherwise(F.lit(True))


def to_json(key: bytes, value: bytes) -> dict:
    return {"key": key.decode("utf-8", "replace"), "value": base64.b64encode(value).decode()}


def json_columns(key: Column, value: Column) -> list[Column]:
    """Pairs as text: the key as UTF-8, the value in base64 (one line)."""
    return [F.decode(key, "UTF-8").alias("key"), F.regexp_replace(F.base64(value), "\r?\n", "").alias("value")]
