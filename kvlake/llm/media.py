"""ISO base media files: nested boxes, sample tables, and columns of codec, duration and keyframe byte ranges.

``read_tracks`` walks the boxes of a file and decodes the sample tables (stts, stsc, stsz or stz2, stco or co64,
stss) to byte ranges; payloads are never decoded. ``wrap`` stores bytes losslessly as frames of a raw 8-bit
video track, so that any text can be put into a container and read back through its sample tables.

Defined results: null content has no tracks; content that is no ISO media file, or a box that ends beyond its
parent, gives the tracks found before it; a track without samples has no ranges; 32-bit, 64-bit and open-ended
box sizes are read. Fragmented files (moof) give the samples of their moov alone. Boxes may nest to any depth; counts
that a damaged table claims are cut to what its box and the other tables hold, and byte ranges to the file's end.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kvlake.llm import textnum
from kvlake.llm.common import arrow_map, table

FRAME, FRAMES_A_CHUNK, KEY_EVERY, RATE = 64, 32, 12, 25
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
_FTYP = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
_ENTRY = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", 8, 8, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">HH", 8, 0xFFFF))
_FIXED = full(b"vmhd", bytes(8), flags=1) + box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))


def wrap(payload: bytes) -> bytes:
    """A file whose one track holds ``payload`` (a positive multiple of 64 bytes) as 8 x 8 frames of 8-bit samples."""
    n = len(payload) // FRAME
    chunks = -(-n // FRAMES_A_CHUNK)
    last = n - (chunks - 1) * FRAMES_A_CHUNK
    runs = [(1, FRAMES_A_CHUNK if chunks > 1 else last, 1)] + ([(chunks, last, 1)] if chunks > 1 and last != FRAMES_A_CHUNK else [])
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")

    def moov(start: int) -> bytes:
        offsets = (start + np.arange(chunks, dtype=np.int64) * (FRAME * FRAMES_A_CHUNK)).astype(">u4")
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), _ENTRY),
            full(b"stts", struct.pack(">III", 1, n, 1)),
            full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]),
            full(b"stsz", struct.pack(">II", FRAME, n)),
            full(b"stco", struct.pack(">I", chunks), offsets.tobytes()),
        )
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)), full(b"hdlr", bytes(4), b"vide", bytes(12), b"\0"), box(b"minf", _FIXED, stbl))
        tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(8), bytes(8), _MATRIX, struct.pack(">II", 8 << 16, 8 << 16), flags=3)
        mvhd = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, n, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    start = len(_FTYP) + len(moov(0)) + 8
    return b"".join([_FTYP, moov(start), struct.pack(">I4s", 8 + len(payload), b"mdat"), payload])


def walk(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Type, body start and body end of the boxes between two places; stops at a box that doesn't fit."""
    at = start
    while at + 8 <= end:
        size, kind, head = int.from_bytes(data[at : at + 4], "big"), bytes(data[at + 4 : at + 8]), 8
        if size == 1 and at + 16 <= end:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            return
        yield kind, at + head, at + size
        at += size


def _table(data: memoryview, at: int, end: int, width: int, skip: int = 4) -> np.ndarray:
    """The big-endian 32-bit rows of a table with its count at ``at + skip``, as int64; rows beyond the box are left out."""
    if at + skip + 4 > end:
        return np.zeros((0, width), np.int64)
    n = int.from_bytes(data[at + skip : at + skip + 4], "big")
    n = min(n, (end - at - skip - 4) // (4 * width))
    return np.frombuffer(data, ">u4", n * width, at + skip + 4).astype(np.int64).reshape(n, width)


def _stbl(data: memoryview, start: int, end: int) -> dict:
    """Codec, sample offsets, sizes, total ticks and sync flags of a sample table."""
    b = {k: (s, e) for k, s, e in walk(data, start, end)}
    codec = next((k.decode("latin-1") for k, _, _ in walk(data, b[b"stsd"][0] + 8, b[b"stsd"][1])), "") if b"stsd" in b else ""
    times = _table(data, *b[b"stts"], 2) if b"stts" in b else np.zeros((0, 2), np.int64)
    sizes = np.zeros(0, np.int64)
    if b"stsz" in b and b[b"stsz"][0] + 12 <= b[b"stsz"][1]:
        s, e = b[b"stsz"]
        each, n = struct.unpack_from(">II", data, s + 4)
        # no more samples than start inside the file
        sizes = np.full(min(n, len(data) // each + 1), each, np.int64) if each else _table(data, s, e, 1, 8).ravel()
    elif b"stz2" in b and b[b"stz2"][0] + 12 <= b[b"stz2"][1]:
        s, e = b[b"stz2"]
        bits, n = data[s + 7], int.from_bytes(data[s + 8 : s + 12], "big")
        raw = np.frombuffer(data, np.uint8, e - s - 12, s + 12)
        if bits == 4:
            sizes = np.stack([raw >> 4, raw & 15], 1).ravel()[:n].astype(np.int64)
        elif bits == 8:
            sizes = raw[:n].astype(np.int64)
        else:
            sizes = raw[: len(raw) // 2 * 2].view(">u2")[:n].astype(np.int64)
    if b"stco" in b:
        chunks = _table(data, *b[b"stco"], 1).ravel()
    elif b"co64" in b and b[b"co64"][0] + 8 <= b[b"co64"][1]:
        s, e = b[b"co64"]
        n = min(int.from_bytes(data[s + 4 : s + 8], "big"), (e - s - 8) // 8)
        chunks = np.minimum(np.frombuffer(data, ">u8", n, s + 8), 1 << 62).astype(np.int64)
    else:
        chunks = np.zeros(0, np.int64)
    runs = _table(data, *b[b"stsc"], 3) if b"stsc" in b else np.zeros((0, 3), np.int64)
    per = np.zeros(len(chunks), np.int64)
    if len(runs) and len(chunks):
        per = runs[np.clip(np.searchsorted(runs[:, 0], np.arange(1, len(chunks) + 1), "right") - 1, 0, None), 1]
    # samples a chunk, cut where the sizes end
    upto = np.minimum(np.cumsum(np.minimum(per, len(sizes))), len(sizes))
    per = np.diff(upto, prepend=0)
    chunk = np.repeat(np.arange(len(chunks)), per)
    sizes = sizes[: len(chunk)]
    run = np.cumsum(sizes) - sizes
    first = np.searchsorted(chunk, chunk)
    offsets = chunks[chunk] + run - run[first] if len(chunk) else np.zeros(0, np.int64)
    offsets = np.minimum(offsets, len(data))
    sizes = np.minimum(sizes, len(data) - offsets)
    sync = np.ones(len(sizes), bool)
    if b"stss" in b:
        sync[:] = False
        k = _table(data, *b[b"stss"], 1).ravel() - 1
        sync[k[(k >= 0) & (k < len(sync))]] = True
    # two 16-bit halves, so that no product overflows
    ticks = int((times[:, 0] * (times[:, 1] >> 16)).sum()) * (1 << 16) + int((times[:, 0] * (times[:, 1] & 0xFFFF)).sum())
    return {"codec": codec, "offsets": offsets, "sizes": sizes, "ticks": ticks, "sync": sync}


def read_tracks(content: bytes | None) -> list[dict]:
    """codec, handler, timescale, duration (s), offsets, sizes and sync of each track of a file."""
    tracks: list[dict] = []
    if not content:
        return tracks
    data = memoryview(content)

    nested: list[tuple[Iterator[tuple[bytes, int, int]], dict | None]] = [(walk(data, 0, len(data)), None)]
    while nested:
        boxes, track = nested[-1]
        found = next(boxes, None)
        if found is None:
            nested.pop()
            continue
        kind, s, e = found
        if kind == b"trak":
            track = {"codec": "", "handler": "", "timescale": 0, "offsets": np.zeros(0, np.int64), "sizes": np.zeros(0, np.int64), "ticks": 0, "sync": np.zeros(0, bool)}
            tracks.append(track)
            nested.append((walk(data, s, e), track))
        elif track is not None and kind == b"mdhd" and e - s >= (24 if data[s : s + 1] == b"\1" else 20):
            track["timescale"] = int.from_bytes(data[s + 20 : s + 24] if data[s] else data[s + 12 : s + 16], "big")
        elif track is not None and kind == b"hdlr" and e - s >= 12:
            track["handler"] = bytes(data[s + 8 : s + 12]).decode("latin-1")
        elif track is not None and kind == b"stbl":
            track |= _stbl(data, s, e)
        elif kind in CONTAINERS:
            nested.append((walk(data, s, e), track))
    for track in tracks:
        track["duration"] = track["ticks"] / track["timescale"] if track["timescale"] else 0.0
    return tracks


def read_samples(content: bytes, track: dict) -> bytes:
    """A track's samples in order, read by their byte ranges; ranges that adjoin are read at once."""
    o, n = track["offsets"], track["sizes"]
    if not len(o):
        return b""
    cut = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1] + n[:-1]]))
    ends = np.append(cut[1:], len(o)) - 1
    return b"".join(content[a:b] for a, b in zip(o[cut].tolist(), (o[ends] + n[ends]).tolist(), strict=True))


MEDIA_TYPE = "array<struct<codec:string,handler:string,duration:double,samples:bigint,keyframes:array<struct<start:bigint,bytes:bigint>>>>"


def media_columns(files: DataFrame, content_col: str = "content", name: str = "media") -> DataFrame:
    """``files`` with a column ``name`` of its tracks (``MEDIA_TYPE``); binary content in, one row a file."""
    at = files.columns.index(content_col)

    def decode(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for content in batch.column(at).to_pylist():
            rows.append([{"codec": t["codec"], "handler": t["handler"], "duration": t["duration"], "samples": len(t["sizes"]), "keyframes": [{"start": a, "bytes": b} for a, b in zip(t["offsets"][t["sync"]].tolist(), t["sizes"][t["sync"]].tolist(), strict=True)]} for t in read_tracks(content)])
        kind = pa.list_(pa.struct([("codec", pa.string()), ("handler", pa.string()), ("duration", pa.float64()), ("samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("bytes", pa.int64())])))]))
        keep = [(c, batch.column(i)) for i, c in enumerate(batch.schema.names) if c != name]
        return pa.RecordBatch.from_arrays([x for _, x in keep] + [pa.array(rows, kind)], [c for c, _ in keep] + [name])

    schema = ", ".join([f"`{c}` {t}" for c, t in files.dtypes if c != name] + [f"`{name}` {MEDIA_TYPE}"])
    return arrow_map(files, decode, schema, at)


def feature(track: dict) -> str:
    """A track in one line: codec, frames, duration, and its keyframes' count, first and last byte range."""
    at = np.flatnonzero(track["sync"])
    o, n = track["offsets"][at], track["sizes"][at]
    ends = f"{o[0]}+{n[0]}|{o[-1]}+{n[-1]}" if len(at) else "-"
    return f"{track['codec'].strip()}|{track['handler']}|{len(track['sizes'])}|{track['duration']:.2f}|{len(at)}|{ends}"


def _digest(batch: pa.RecordBatch) -> pa.RecordBatch:
    buf, at = textnum.raw_bytes(batch.column(1))
    raw = buf.tobytes()
    out: list[list] = [[] for _ in range(7)]
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        n = b - a
        payload = raw[a:b] + bytes(-n % FRAME if n else FRAME)
        stored = wrap(payload)
        track = read_tracks(stored)[0]
        back = read_samples(stored, track)
        row = (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-FRAME:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(track))
        for column, value in zip(out, row, strict=True):
            column.append(value)
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], ["doc_id", *names])


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return arrow_map(docs, _digest, schema, 1)


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op8_media_columns`` that SQL can tell: what was stored and read back."""
    return op8_media_columns(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


PAYLOADS_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
p AS (SELECT *, greatest((n + 63) // 64 * 64, 64)::BIGINT AS m FROM d)
SELECT doc_id, n AS n_bytes, m AS payload_bytes, sha256(t || repeat(chr(0), (m - n)::INTEGER)) AS payload_sha256 FROM p
"""
