"""Vectorised words and hashes over an Arrow string column, without a Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from kvlake.llm.common import offsets

#: Byte -> byte with A-Z lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of `[^\x20\x09-\x0D]+`.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing: digits, a-z and every byte of a character beyond ASCII.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(a * _M1 + mix(b + np.uint64(0x632BE59BD9B4E019)))


def raw_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The rows' UTF-8 bytes, one after the other, and their offsets from 0. A null row has no bytes."""
    at = offsets(array)
    if len(array) == 0 or array.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    if array.null_count:
        array = array.fill_null("" if not pa.types.is_binary(array.type) else b"")
        at = offsets(array)
    if array.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(array.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]


def spans(buf: np.ndarray, at: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``keep`` bytes inside each row, and each row's first run (with the total at the end)."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(at), np.int64)
    m = keep[buf]
    head = np.empty(n, bool)
    head[0] = True
    np.logical_not(m[:-1], out=head[1:])
    rows = at[:-1][at[:-1] < n]
    head[rows] = True
    head &= m
    tail = np.empty(n, bool)
    tail[-1] = True
    np.logical_not(m[1:], out=tail[:-1])
    tail[at[1:][at[1:] > 0] - 1] = True
    tail &= m
    starts = np.flatnonzero(head)
    return starts, np.flatnonzero(tail) + 1, np.searchsorted(starts, at)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of ``buf[start:end]``, eight bytes a step."""
    size = ends - starts
    h = mix(size.astype(np.uint64) + np.uint64(seed) * _M1)
    if not len(starts):
        return h
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    live, k = np.arange(len(starts)), 0
    while len(live):
        left = size[live] - k
        w = eight[starts[live] + k] & _LOW[np.minimum(left, 8)]
        x = (h[live] ^ w) * _M1
        h[live] = x ^ (x >> np.uint64(29))
        k += 8
        live = live[left > 8]
    return mix(h)


def words(array: pa.Array, keep: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased (A-Z) bytes, word starts, word ends, each row's first word (with the total at the end), word hashes."""
    buf, at = raw_bytes(array)
    buf = LOWER[buf]
    starts, ends, first = spans(buf, at, keep)
    return buf, starts, ends, first, hashes(buf, starts, ends, seed)


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` by row; rows without values get 0. Sums of floats are made row by row, so they don't depend on the batch."""
    out = np.zeros((len(first) - 1, *values.shape[1:]), values.dtype if values.dtype.kind in "fu" else np.int64)
    has = np.flatnonzero(np.diff(first) > 0)
    if len(has):
        out[has] = np.add.reduceat(values, first[has], axis=0)
    return out
