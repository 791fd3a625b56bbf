import hashlib
import random
import struct
import zlib

import pytest

from tessera.llm.media import FRAME, Malformed, _box, boxes, carried, features, inspect, stored, tracks


def payload(frames):
    return random.Random(frames).randbytes(frames * FRAME)


@pytest.mark.parametrize("frames", [1, 2, 15, 16, 17, 32, 33, 700])
def test_samples_hold_the_payload(frames):
    data = payload(frames)
    (t,) = tracks(stored(data))
    media = stored(data)
    assert b"".join(media[o : o + s] for o, s in zip(t.offsets, t.sizes, strict=True)) == data
    assert (t.codec, t.handler, t.timescale, t.duration, t.track_id) == ("raw ", "vide", 25, frames, 1)
    assert t.keys.tolist() == list(range(0, frames, 8))


def test_box_sizes_of_each_kind():
    inner = _box(b"free", b"xy")
    long = struct.pack(">I4sQ", 1, b"moov", 16 + len(inner)) + inner
    rest = struct.pack(">I4s", 0, b"mdat") + b"12345"
    data = memoryview(long + rest)
    assert [(p[-1], bytes(data[a:b])) for p, a, b in boxes(data)] == [(b"moov", inner), (b"free", b"xy"), (b"mdat", b"12345")]


def test_other_sample_tables():
    sizes = [3, 5, 2, 7]
    stz2 = _box(b"stz2", struct.pack(">I3xBI", 0, 4, 4), bytes([3 << 4 | 5, 2 << 4 | 7]))
    body = b"".join(bytes([i]) * n for i, n in enumerate(sizes))

    def whole(at):
        stbl = _box(b"stbl", _box(b"stsd", struct.pack(">II", 0, 1), _box(b"avc1", bytes(78))), _box(b"stsc", struct.pack(">II6I", 0, 2, 1, 1, 1, 2, 3, 1)), stz2, _box(b"co64", struct.pack(">IIQQ", 0, 2, at, at + 10)))
        mdhd = _box(b"mdhd", struct.pack(">IQQIQI", 1 << 24, 0, 0, 1000, 1 << 33, 0))
        return _box(b"moov", _box(b"trak", _box(b"mdia", mdhd, _box(b"minf", stbl))))

    at = len(whole(0)) + 8
    media = whole(at) + _box(b"mdat", body[:3] + bytes(7) + body[3:])
    (t,) = tracks(media)
    assert t.offsets.tolist() == [at, at + 10, at + 15, at + 17] and t.duration == 1 << 33 and t.codec == "avc1"
    assert t.keys.tolist() == [0, 1, 2, 3]


def test_damaged_containers_raise_nothing_else():
    media, r = stored(payload(40)), random.Random(3)
    for _ in range(400):
        bad = bytearray(media[: r.choice([len(media), r.randrange(len(media))])])
        for _ in range(3):
            if bad:
                bad[r.randrange(min(len(bad), 800))] = r.randrange(256)
        try:
            tracks(bytes(bad))
        except Malformed:
            pass


def test_on_spark(spark):
    texts = [None, "", " ", "x" * 191, "é" * 96, "é" * 97, "word " * 20000, "a", "a"]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(None, "b", "c")], "doc_id long, text string, content string")
    media = carried(df)
    got = {r.doc_id: r for r in features(media).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert r.media_bytes == len(stored(padded)) and r.media_sha256 == hashlib.sha256(stored(padded)).hexdigest()
    assert got[7][2:] == got[8][2:] and None in got
    broken = spark.createDataFrame([(1, None), (2, b""), (3, b"nonsense"), (4, stored(payload(20)))], "id long, content binary")
    seen = {r.id: r for r in inspect(broken).collect()}
    assert all(seen[i].tracks == [] and seen[i].error for i in (1, 2, 3))
    assert seen[4].error is None and [k.size for k in seen[4].tracks[0].keyframes] == [192] * 3
    assert features(media.limit(0)).count() == 0
