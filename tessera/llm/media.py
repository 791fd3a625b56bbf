"""ISO media containers: nested boxes, sample tables, and a lossless carrier for bytes.

`inspect` walks a container's boxes and decodes its sample tables into codec, duration and the
byte ranges of keyframes, without decoding a payload. `stored` puts bytes into such
a container: one track of uncompressed pictures of 8 by 8 pixels, three 8-bit samples each, so that 192
bytes make a frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME = 192
FRAMES_PER_CHUNK = 16
KEY_EVERY = 8
TIMESCALE = 25
#: Boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
_UNITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


class Malformed(ValueError):
    """The bytes aren't a container that can be read."""


def boxes(data: memoryview, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path of box types, start and end of its content) of each box, outer boxes first."""
    at, end = start, len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                raise Malformed("a box's long size is cut off")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise Malformed(f"box {kind!r} at {at} ends at {at + size} of {end}")
        own = (*path, kind)
        yield own, at + head, at + size
        if kind in CONTAINERS and len(own) < 32:
            yield from boxes(data, at + head, at + size, own)
        at += size
    if at != end:
        raise Malformed(f"{end - at} bytes after the last box")


def _table(data: memoryview, at: int, end: int, kind: str, columns: int = 1) -> np.ndarray:
    """The rows of a table whose number of rows precedes it."""
    n = struct.unpack_from(">I", data, at + 4)[0]
    if at + 8 + n * columns * np.dtype(kind).itemsize > end:
        raise Malformed("a table is longer than its box")
    return np.frombuffer(data, kind, n * columns, at + 8).astype(np.int64).reshape(n, columns)


def _header(data: memoryview, at: int, fields: str) -> tuple[int, ...]:
    """Fields after two times, which are long in version 1 of a box."""
    long = data[at] == 1
    return struct.unpack_from(fields.replace("T", "Q" if long else "I"), data, at + 4 + (16 if long else 8))


class Track:
    """One track's header and sample tables."""

    def __init__(self):
        self.track_id, self.handler, self.codec, self.timescale, self.duration = 0, "", "", 0, 0
        self.sizes = self.offsets = self.keys = np.zeros(0, np.int64)


def _sizes(data: memoryview, kind: bytes, at: int, end: int) -> np.ndarray:
    if kind == b"stsz":
        size, n = struct.unpack_from(">II", data, at + 4)
        if size:
            if size * n > len(data):
                raise Malformed("samples are larger than the file")
            return np.full(n, size, np.int64)
        if at + 12 + 4 * n > end:
            raise Malformed("a table is longer than its box")
        return np.frombuffer(data, ">u4", n, at + 12).astype(np.int64)
    field, n = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
    if field not in (4, 8, 16) or at + 12 + (n * field + 7) // 8 > end:
        raise Malformed("a compact size table can't be read")
    if field == 4:
        packed = np.frombuffer(data, np.uint8, (n + 1) // 2, at + 12)
        return np.stack([packed >> 4, packed & 15], 1).reshape(-1)[:n].astype(np.int64)
    return np.frombuffer(data, ">u2" if field == 16 else np.uint8, n, at + 12).astype(np.int64)


def _offsets(sizes: np.ndarray, chunks: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Where each sample begins; runs: (first chunk, samples in a chunk, description)."""
    if not len(sizes):
        return sizes
    if not len(runs) or not len(chunks) or runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any() or runs[-1, 0] > len(chunks):
        raise Malformed("samples can't be placed in chunks")
    per = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1)))
    if per.sum() < len(sizes):
        raise Malformed("chunks hold too few samples")
    chunk = np.searchsorted(np.cumsum(per), np.arange(len(sizes)), side="right")
    ends = np.cumsum(sizes)
    first = np.cumsum(per) - per  # of each chunk
    before = (ends - sizes)[np.minimum(first[chunk], len(sizes) - 1)]
    return chunks[chunk] + ends - sizes - before


def tracks(content: bytes) -> list[Track]:
    """The tracks of a container; raises Malformed."""
    data, out = memoryview(content), []
    chunks = runs = None

    def close() -> None:
        if out:
            t = out[-1]
            t.offsets = _offsets(t.sizes, chunks if chunks is not None else np.zeros(0, np.int64), runs if runs is not None else np.zeros((0, 3), np.int64))
            if len(t.sizes) and ((t.offsets + t.sizes).max() > len(data) or t.offsets.min() < 0):
                raise Malformed("samples lie outside the file")
            t.keys = np.arange(len(t.sizes)) if t.keys is None else t.keys
            if len(t.keys) and (t.keys.min() < 0 or t.keys.max() >= len(t.sizes)):
                raise Malformed("a keyframe is no sample")

    try:
        for path, at, end in boxes(data):
            kind = path[-1]
            if kind == b"trak":
                close()
                out.append(Track())
                out[-1].keys = chunks = runs = None
            elif b"trak" in path:
                t = out[-1]
                if kind == b"tkhd":
                    t.track_id = _header(data, at, ">I")[0]
                elif kind == b"mdhd":
                    t.timescale, t.duration = _header(data, at, ">IT")
                elif kind == b"hdlr":
                    t.handler = bytes(data[at + 8 : at + 12]).decode("latin-1")
                elif kind == b"stsd":
                    t.codec = bytes(data[at + 12 : at + 16]).decode("latin-1")
                elif kind in (b"stsz", b"stz2"):
                    t.sizes = _sizes(data, kind, at, end)
                elif kind == b"stsc":
                    runs = _table(data, at, end, ">u4", 3)
                elif kind in (b"stco", b"co64"):
                    chunks = _table(data, at, end, ">u4" if kind == b"stco" else ">u8")[:, 0]
                elif kind == b"stss":
                    t.keys = _table(data, at, end, ">u4")[:, 0] - 1
        close()
    except (struct.error, IndexError) as e:
        raise Malformed(str(e)) from e
    return out


def _box(kind: bytes, *content: bytes) -> bytes:
    body = b"".join(content)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def stored(payload: bytes) -> bytes:
    """A container with the payload, whose length is a multiple of FRAME, as uncompressed frames."""
    n, left = divmod(len(payload), FRAME)
    if left or not n:
        raise ValueError("a payload is one frame or more")
    n_chunks, last = -(-n // FRAMES_PER_CHUNK), (n - 1) % FRAMES_PER_CHUNK + 1
    runs = [(1, FRAMES_PER_CHUNK if n_chunks > 1 else last, 1)]
    if n_chunks > 1 and last != FRAMES_PER_CHUNK:
        runs.append((n_chunks, last, 1))
    keys = range(1, n + 1, KEY_EVERY)
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", 8, 8, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 24, -1))
    file_type = _box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomqt  ")
    long = len(payload) > (1 << 32) - (1 << 24)

    def movie(first: int) -> bytes:
        places = [first + i * FRAMES_PER_CHUNK * FRAME for i in range(n_chunks)]
        table = _box(
            b"stbl",
            _box(b"stsd", struct.pack(">II", 0, 1), entry),
            _box(b"stts", struct.pack(">IIII", 0, 1, n, 1)),
            _box(b"stss", struct.pack(f">II{len(keys)}I", 0, len(keys), *keys)),
            _box(b"stsc", struct.pack(">II", 0, len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _box(b"stsz", struct.pack(">III", 0, FRAME, n)),
            _box(b"co64" if long else b"stco", struct.pack(f">II{n_chunks}{'Q' if long else 'I'}", 0, n_chunks, *places)),
        )
        information = _box(b"minf", _box(b"vmhd", struct.pack(">I8x", 1)), _box(b"dinf", _box(b"dref", struct.pack(">II", 0, 1), _box(b"url ", struct.pack(">I", 1)))), table)
        media = _box(b"mdia", _box(b"mdhd", struct.pack(">IIIIIHH", 0, 0, 0, TIMESCALE, n, 0x55C4, 0)), _box(b"hdlr", struct.pack(">II4s12x", 0, 0, b"vide"), b"bytes\0"), information)
        track = _box(b"trak", _box(b"tkhd", struct.pack(">IIIIII8xHHHH", 7, 0, 0, 1, 0, n, 0, 0, 0, 0), _UNITY, struct.pack(">II", 8 << 16, 8 << 16)), media)
        return _box(b"moov", _box(b"mvhd", struct.pack(">IIIIIIH10x", 0, 0, 0, TIMESCALE, n, 0x10000, 0x100), _UNITY, bytes(24), struct.pack(">I", 2)), track)

    head = 16 if long else 8
    whole = movie(len(file_type) + len(movie(0)) + head)
    start = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if long else struct.pack(">I4s", len(payload) + 8, b"mdat")
    return b"".join((file_type, whole, start, payload))


_TRACK = "track_id long, handler string, codec string, timescale long, duration long, samples long, keyframes array<struct<offset:long,size:long>>"


def _inspected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = []
        for content in rows.content:
            try:
                found = [(t.track_id, t.handler, t.codec, t.timescale, t.duration, len(t.sizes), [{"offset": int(t.offsets[k]), "size": int(t.sizes[k])} for k in t.keys]) for t in tracks(content or b"")]
                out.append((found, None if found else "no track"))
            except Malformed as e:
                out.append(([], str(e)))
        names = [c.split()[0] for c in _TRACK.split(", ")]
        yield pd.DataFrame({"id": rows.id, "tracks": [[dict(zip(names, t, strict=True)) for t in f] for f, _ in out], "error": [e for _, e in out]})


def inspect(media: DataFrame, id_column: str = "id", content: str = "content") -> DataFrame:
    """id, tracks, error of each row: per track its codec, duration and keyframe byte ranges.

    Null or empty contents and contents that aren't a container have no tracks and an error; rows
    that repeat give the same result. Containers in fragments list the samples of their first part.
    """
    plain = media.select(F.col(id_column).cast("long").alias("id"), F.col(content).cast("binary").alias("content"))
    return plain.mapInPandas(_inspected, "id long, tracks array<struct<" + _TRACK.replace(" ", ":").replace(",:", ",") + ">>, error string")


def carried(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, content of each row: its text's bytes, padded by blanks to whole frames, in a container."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for lo in range(0, len(rows), 500):
                some = rows.iloc[lo : lo + 500]
                texts = [(t or "").encode() for t in some.text]
                media = [stored(t.ljust(max(1, -(-len(t) // FRAME)) * FRAME)) for t in texts]
                yield pd.DataFrame({"doc_id": some.doc_id, "n_bytes": [len(t) for t in texts], "content": media})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, n_bytes long, content binary")


def _read_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = []
        for doc_id, n_bytes, content in zip(rows.doc_id, rows.n_bytes, rows.content, strict=True):
            (t,) = tracks(content)
            # Samples that follow each other in the file are read as one range.
            jumps = np.flatnonzero(np.diff(t.offsets) != t.sizes[:-1]) + 1
            starts, ends = np.append(0, jumps), np.append(jumps, len(t.sizes)) - 1
            payload = b"".join(content[t.offsets[a] : t.offsets[b] + t.sizes[b]] for a, b in zip(starts, ends, strict=True))
            ranges = ",".join(f"{t.offsets[k]}+{t.sizes[k]}" for k in t.keys)
            feature = f"codec={t.codec.strip()};handler={t.handler};duration={t.duration}/{t.timescale};samples={len(t.sizes)};keyframes={ranges}"
            out.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(content), hashlib.sha256(content).hexdigest(), feature))
        yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]).astype({"doc_id": "Int64"})


def features(media: DataFrame) -> DataFrame:
    """Of each row of `carried`: digests of the payload read back through the sample tables, and what the container says of itself."""
    return media.mapInPandas(_read_back, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
