"""Archives as tables: an index of members read from headers, its faults, and members dealt to tasks by their byte ranges.

Only a zip's directory, or a tar's headers, are read for the index. A member is read by whichever
task it is dealt to, from its own range of bytes, within its declared size. A compressed tar has no ranges: one task reads it, member by member.
"""

from __future__ import annotations

import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import BLOCK, local, refusals
from .shared import tasks, written

#: The kinds of Unix files in a zip entry's mode; sizes from which compression ratios count.
LINK, REGULAR, RATIO_FROM = 0xA, (0x0, 0x8), 1 << 20
#: Rows that a task gives at once, at most, and bytes of contents from which it gives them earlier.
ROWS, HELD = 10_000, 8 << 20
_INDEX = "archive string, bytes long, n long, entry string, kind string, encrypted boolean, offset long, packed long, size long, method int, crc32 long, error string"
_COLUMNS = [c.split()[0] for c in _INDEX.split(", ")]


def _zip(f) -> Iterator[tuple]:
    for n, i in enumerate(zipfile.ZipFile(f).infolist()):
        mode = i.external_attr >> 28
        kind = "symlink" if mode == LINK else "directory" if i.is_dir() else "file" if mode in REGULAR else "special"
        yield n, i.filename, kind, bool(i.flag_bits & 1), i.header_offset, i.compress_size, i.file_size, i.compress_type, i.CRC


def _tar(f) -> Iterator[tuple]:
    with tarfile.open(fileobj=f) as archive:
        plain = archive.fileobj is f
        for n, i in enumerate(archive):
            kind = "directory" if i.isdir() else "file" if i.isreg() else "symlink" if i.issym() else "special"
            yield n, i.name, kind, False, i.offset_data if plain else None, i.size, i.size, 0, None


def index(archives: DataFrame) -> DataFrame:
    """archive, bytes (its own), n, entry, kind, encrypted, offset, packed, size, method, crc32 of each entry of archives (path); of an unreadable one a row with its error.

    Repeated paths give their entries again; null paths give none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for rows in batches:
            for path in rows.path.dropna():
                size = None
                try:
                    with open(local(path), "rb") as f:
                        size = f.seek(0, 2)
                        f.seek(0)
                        magic = f.read(2)
                        f.seek(0)
                        for row in _zip(f) if magic == b"PK" else _tar(f):
                            out.append((path, size, *row, None))
                            if len(out) == ROWS:
                                yield _frame(out)
                                out = []
                except (OSError, EOFError, ValueError, NotImplementedError, zlib.error, tarfile.TarError, zipfile.BadZipFile, struct.error) as e:
                    out.append((path, size, *[None] * 9, f"{type(e).__name__}: {e}"))
        yield _frame(out)

    return archives.select("path").repartition(tasks(archives.sparkSession), "path").mapInPandas(run, _INDEX)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS).astype(dict.fromkeys(("bytes", "n", "offset", "packed", "size", "method", "crc32"), "Int64") | {"encrypted": "boolean"})


def relative(entries: DataFrame) -> DataFrame:
    """entries with root (an entry's first part) and path (what is below it; null for the root itself)."""
    parts = F.split(F.regexp_replace("entry", "/+$", ""), "/")
    return entries.withColumn("root", parts[0]).withColumn("path", F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 2, 1 << 20), "/")))


def faults(entries: DataFrame, most_files: int = 50_000, most_bytes: int = 1 << 30, most_file_bytes: int = 1 << 30, most_ratio: float = 100.0, one_root: bool = False) -> DataFrame:
    """archive, reason, path of what refuses an archive as a whole, from the index alone; links are listed and refuse nothing.

    one_root: entries must lie below one folder, which is no part of their paths.
    """
    rows = relative(entries) if one_root else entries.withColumn("root", F.lit("")).withColumn("path", F.regexp_replace("entry", "/+$", ""))
    why = (
        F.when(F.col("error").isNotNull(), "unreadable")
        .when(F.col("encrypted"), "encrypted entry")
        .when(F.col("entry").rlike(r"^/|^[A-Za-z]:|\\|\x00|(^|/)\.\.?(/|$)|//") | (F.col("entry") == ""), "unsafe name")
        .when(F.col("kind") == "special", "special entry")
        .when(F.col("path").isNull() & (F.col("kind") != "directory"), "root isn't a folder")
        .when(F.col("size") > most_file_bytes, "oversized file")
        .when((F.col("kind") == "file") & (F.col("size") > RATIO_FROM) & (F.col("size") > most_ratio * F.greatest(F.col("packed"), F.lit(1))), "compression ratio")
    )
    own = rows.select("archive", why.alias("reason"), F.col("entry").alias("path")).where("reason IS NOT NULL")
    sums = rows.groupBy("archive").agg(F.max("bytes").alias("bytes"), F.sum("size").alias("size"), F.count_distinct("root").alias("roots"))
    none = F.lit(None).cast("string")
    dense = sums.where((F.col("size") > RATIO_FROM) & (F.col("size") > most_ratio * F.col("bytes"))).select("archive", F.lit("compression ratio"), none)
    roots = sums.where("roots > 1").select("archive", F.lit("several roots"), none)
    listed = rows.where("path IS NOT NULL").select("archive", "path", F.when(F.col("kind") == "directory", "directory").otherwise("file").alias("kind"), F.when(F.col("kind") == "file", F.col("size")).otherwise(0).alias("size"))
    twice = listed.where("kind = 'file'").groupBy("archive", "path").count().where("count > 1").select("archive", F.lit("repeated path"), "path")
    return own.union(dense).union(roots).union(twice).union(refusals(listed, most_files, most_bytes, ["archive"]))


def _unpacked(path: str, offset: int, packed: int, size: int, method: int) -> Iterator[bytes]:
    """The blocks of a member, from its own bytes alone; never more than a block beyond its declared size."""
    with open(local(path), "rb") as f:
        f.seek(offset)
        if method >= 0:  # a zip's own header is as long as it says
            head = f.read(30)
            f.seek(offset + 30 + sum(struct.unpack("<HH", head[26:30])))
        if method not in (-1, 0, 8):
            raise NotImplementedError(f"method {method}")
        inflate, left = zlib.decompressobj(-15) if method == 8 else None, packed
        while left > 0 and (data := f.read(min(BLOCK, left))):
            left -= len(data)
            while data:
                out = inflate.decompress(data, BLOCK) if inflate else data
                data = inflate.unconsumed_tail if inflate else b""
                if out:
                    yield out
        if inflate and (out := inflate.flush()):
            yield out



def _member(row, hold: bool) -> tuple:
    """(content or None, CRC-32, error) of one member with a range of its own."""
    parts, crc, n = [], 0, 0
    try:
        for data in _unpacked(row.archive, row.offset, row.packed, row.size, row.method):
            crc, n = zlib.crc32(data, crc), n + len(data)
            if n > row.size:
                return None, None, "longer than declared"
            if hold:
                parts.append(data)
    except (OSError, EOFError, ValueError, NotImplementedError, zlib.error, struct.error) as e:
        return None, None, f"{type(e).__name__}: {e}"
    if n < row.size:
        return None, None, "truncated"
    if not pd.isna(row.crc32) and crc != row.crc32:
        return None, crc, "checksum differs"
    return b"".join(parts) if hold else None, crc, None


_MEMBER = "archive string, entry string, size long, content binary, crc32 long, error string"


def members(entries: DataFrame, hold: bool = True) -> DataFrame:
    """archive, entry, size, content, crc32, error of each regular file of an index; a corrupt member has an error and no content, and costs no other.

    hold: whether contents are wanted; without, members are only checked, block by block. Members go to tasks by archive and place, not by archive.
    """
    files = entries.where("kind = 'file'").select("archive", "n", "entry", "offset", "packed", "size", F.when(F.col("crc32").isNull(), -1).otherwise(F.col("method")).alias("method"), "crc32")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, held = [], 0
        for rows in batches:
            for row in rows.itertuples(index=False):
                content, crc, error = _member(row, hold)
                out.append((row.archive, row.entry, row.size, content, crc, error))
                held += len(content or b"")
                if len(out) == ROWS or held >= HELD:
                    yield frame(out)
                    out, held = [], 0
        yield frame(out)

    def frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[c.split()[0] for c in _MEMBER.split(", ")]).astype({"size": "Int64", "crc32": "Int64"})

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path in rows.archive:
                yield from _streamed(path, hold)

    dealt = files.where("offset IS NOT NULL").repartition(tasks(entries.sparkSession), "archive", "n").mapInPandas(run, _MEMBER)
    return dealt.union(files.where("offset IS NULL").select("archive").distinct().mapInPandas(whole, _MEMBER))


def _streamed(path: str, hold: bool) -> Iterator[pd.DataFrame]:
    """The files of a compressed tar, one frame each; after a fault in its stream, one row with the error."""
    names = [c.split()[0] for c in _MEMBER.split(", ")]
    at = None
    try:
        with tarfile.open(local(path)) as archive:
            for i in archive:
                if i.isreg():
                    at, crc, parts = i, 0, []
                    source = archive.extractfile(i)
                    while data := source.read(BLOCK):
                        crc = zlib.crc32(data, crc)
                        if hold:
                            parts.append(data)
                    yield pd.DataFrame([(path, i.name, i.size, b"".join(parts) if hold else None, crc, None)], columns=names)
    except (OSError, EOFError, ValueError, zlib.error, tarfile.TarError) as e:
        yield pd.DataFrame([(path, at.name if at else None, at.size if at else None, None, None, f"{type(e).__name__}: {e}")], columns=names).astype({"size": "Int64", "crc32": "Int64"})


def validity(archives: DataFrame, manifest: str = "manifest.json", required: tuple[str, ...] = ("format", "includes"), dependencies: DataFrame | None = None) -> DataFrame:
    """archive, kind, name, problem: what makes backups invalid; a valid one has no row.

    Faults of the index, members whose checksums don't fit, a manifest that is missing, no JSON object or without a required field, parts that the manifest's
    `includes` names and no entry lies below, and rows of dependencies (archive, entry, size) that no member meets.
    """
    entries = written(index(archives), "entries")  # read many times: archives are opened once
    bad_index = faults(entries).select("archive", F.lit("index"), F.col("path").alias("name"), F.col("reason").alias("problem"))
    sound = entries.where("error IS NULL")
    bad_member = members(sound, hold=False).where("error IS NOT NULL").select("archive", F.lit("member"), "entry", "error")
    told = members(sound.where(F.col("entry") == manifest)).select("archive", F.col("content").cast("string").alias("text"))
    shape = sound.select("archive").distinct().join(told, "archive", "left")
    fields = F.map_keys(F.from_json("text", "map<string,string>"))
    lacking = F.filter(F.array(*map(F.lit, required)), lambda x: ~F.array_contains(F.coalesce(fields, F.array().cast("array<string>")), x))
    bad_shape = shape.select("archive", F.lit("manifest"), F.when(F.col("text").isNull(), F.lit(manifest)).otherwise(F.array_join(lacking, ",")).alias("name"), F.when(F.col("text").isNull(), "missing").when(F.size(lacking) > 0, "fields missing").alias("problem")).where("problem IS NOT NULL")
    parts = told.select("archive", F.explode(F.from_json(F.get_json_object("text", "$.includes"), "array<string>")).alias("part"))
    below = sound.select("archive", F.split("entry", "/")[0].alias("part")).distinct()
    bad_part = parts.join(below, ["archive", "part"], "left_anti").select("archive", F.lit("part"), "part", F.lit("nothing below it"))
    out = bad_index.union(bad_member).union(bad_shape).union(bad_part)
    if dependencies is not None:
        there = sound.where("kind = 'file'").select("archive", "entry", F.col("size").alias("found"))
        unmet = dependencies.join(there, ["archive", "entry"], "left").where("found IS NULL OR found <> size")
        out = out.union(unmet.select("archive", F.lit("dependency"), "entry", F.when(F.col("found").isNull(), "missing").otherwise("other size")))
    return out.toDF("archive", "kind", "name", "problem")
