import hashlib
import random
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kvlake.llm import media


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 200), st.integers(0, 255))
def test_round_trip(frames, seed):
    payload = bytes((seed + k * k) % 256 for k in range(frames * media.FRAME))
    stored = media.wrap(payload)
    (track,) = media.read_tracks(stored)
    assert media.read_samples(stored, track) == payload
    assert (track["codec"], track["handler"], track["duration"]) == ("raw ", "vide", frames / media.RATE)
    keys = [(o, n) for o, n, s in zip(track["offsets"], track["sizes"], track["sync"], strict=True) if s]
    assert len(keys) == -(-frames // media.KEY_EVERY)
    assert all(stored[o : o + n] == payload[k * media.KEY_EVERY * 64 :][:64] for k, (o, n) in enumerate(keys))


def track_of(stbl_boxes, timescale=10):
    stbl = media.box(b"stbl", *stbl_boxes)
    mdia = media.box(b"mdia", media.full(b"mdhd", struct.pack(">QQIQHH", 0, 0, timescale, 0, 0, 0), version=1), media.full(b"hdlr", bytes(4), b"soun", bytes(13)), media.box(b"minf", stbl))
    return media.box(b"moov", media.box(b"trak", mdia))


def test_other_tables():
    sizes = [3, 5, 7, 2]
    boxes = [
        media.full(b"stsd", struct.pack(">I", 1), media.box(b"mp4a", bytes(28))),
        media.full(b"stts", struct.pack(">IIIII", 2, 3, 10, 1, 5)),
        media.full(b"stsc", struct.pack(">IIIIIII", 2, 1, 1, 1, 2, 3, 1)),
        media.full(b"stsz", struct.pack(">II4I", 0, 4, *sizes)),
        media.full(b"co64", struct.pack(">IQQ", 2, 100, 200)),
    ]
    (t,) = media.read_tracks(media.box(b"ftyp", b"isom") + track_of(boxes))
    assert t["codec"] == "mp4a" and t["duration"] == 3.5 and t["offsets"].tolist() == [100, 200, 205, 212] and t["sizes"].tolist() == sizes and t["sync"].all()
    for bits, raw in ((4, bytes([0x35, 0x72])), (8, bytes(sizes)), (16, struct.pack(">4H", *sizes))):
        boxes[3] = media.full(b"stz2", struct.pack(">II", bits, 4), raw)
        assert media.read_tracks(track_of(boxes))[0]["sizes"].tolist() == sizes


@pytest.mark.parametrize("content", [None, b"", b"no media", b"\0\0\0\x08moov", struct.pack(">I4s", 900, b"moov"), struct.pack(">I4sQ", 1, b"moov", 16), struct.pack(">I4s", 0, b"mdat") + b"xyz"])
def test_no_tracks(content):
    assert media.read_tracks(content) == []


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2000), st.integers(0, 255))
def test_damage_never_crashes(at, value):
    raw = bytearray(media.wrap(bytes(640)))
    raw[at % (len(raw) - 640)] = value
    media.read_tracks(bytes(raw))


def test_columns_and_digest(spark, tmp_path):
    df = spark.createDataFrame([(1, bytearray(media.wrap(bytes(128))), "x"), (2, None, "y")], "id int, content binary, media string")
    got = {r.id: r.media for r in media.media_columns(df).collect()}
    assert got[2] == [] and got[1][0].codec == "raw " and got[1][0].samples == 2 and got[1][0].keyframes[0].bytes == 64
    docs = [(1, "abc"), (2, None), (3, ""), (4, "é" * 5000), (5, "abc")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in media.op8_media_columns(spark, str(tmp_path)).collect()}
    for i, t in docs:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = out[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert tuple(out[1])[1:] == tuple(out[5])[1:]


def nest(kind, depth, inner=b""):
    for _ in range(depth):
        inner = media.box(kind, inner)
    return inner


def test_nesting_and_absurd_counts():
    assert media.read_tracks(nest(b"moov", 30000)) == []
    good = media.wrap(bytes(range(64)) * 3)
    track = good[good.index(b"trak") - 4 :]
    track = track[: struct.unpack(">I", track[:4])[0]]
    assert len(media.read_tracks(nest(b"moov", 3000, track))) == 1
    # as many samples a chunk as fit into the count, sizes without end, offsets beyond all files
    for at, bad in ((b"stsc", struct.pack(">IIIII", 0, 1, 1, 0xFFFFFFFF, 1)), (b"stsz", struct.pack(">III", 0, 1, 0xFFFFFFFF)), (b"stts", struct.pack(">IIII", 0, 1, 0xFFFFFFFF, 0xFFFFFFFF)), (b"stco", struct.pack(">III", 0, 0xFFFFFFFF, 0xFFFFFFFF))):
        k = good.index(at) + 4
        broken = good[:k] + bad + good[k + len(bad) :]
        for t in media.read_tracks(broken):
            assert len(t["sizes"]) <= len(broken) and (t["sizes"] >= 0).all() and (t["offsets"] + t["sizes"] <= len(broken)).all()
            assert t["ticks"] >= 0 and len(media.read_samples(broken, t)) <= len(broken) * max(len(t["sizes"]), 1)


def test_any_bytes_are_read():
    r = random.Random(5)
    kinds = [b"moov", b"trak", b"mdia", b"minf", b"stbl", b"stsd", b"stts", b"stsc", b"stsz", b"stz2", b"stco", b"co64", b"stss", b"mdhd", b"hdlr", b"free"]

    def some(depth):
        body = b"".join(some(depth - 1) for _ in range(r.randint(0, 4))) if depth and r.random() < 0.8 else bytes(r.choice([0, 0, 1, 255, r.randrange(256)]) for _ in range(r.randint(0, 40)))
        size = r.choice([8 + len(body)] * 8 + [0, 1, 7, 0xFFFFFFFF])
        return struct.pack(">I", size) + r.choice(kinds) + body

    for _ in range(3000):
        data = some(6)
        for t in media.read_tracks(data):
            assert len(t["offsets"]) == len(t["sizes"]) == len(t["sync"]) and t["duration"] >= 0
            media.read_samples(data, t)
            media.feature(t)
