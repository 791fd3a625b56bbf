"""Trees of files as rows, digested in blocks, and documents written back as files, whole or not at all.

Both are data sources: their readers and writers run in tasks, on folders that driver and executors share.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import os
import shutil
import stat
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .checksums import combined
from .shared import tasks

#: Bytes that are read, or held, at once, and bytes of a file that one task digests.
BLOCK, SHARE = 1 << 20, 64 << 20
#: In the folder of a job, the list of its tasks' folders.
COMMITTED = "committed"
_TREE = "path string, kind string, size long, modified long"


def local(path: str) -> str:
    """A path without the scheme of shared folders."""
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


class _Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class TreeReader(DataSourceReader):
    def __init__(self, root: str, spread: int):
        self.root, self.spread = root, spread

    def partitions(self) -> list[InputPartition]:
        """Folders near the root, until there are enough of them; each deep one is a task's own, with all below it."""
        deep, shallow = [self.root], []
        while deep and len(deep) < self.spread:
            below = [os.path.join(x, e.name) for x in deep for e in os.scandir(x) if e.is_dir(follow_symlinks=False)]
            shallow += deep
            if not below:
                deep = []
                break
            deep = below
        return [_Folder(x, True) for x in deep] + [_Folder(x, False) for x in shallow]

    def read(self, part: _Folder) -> Iterator[tuple]:
        todo, kinds = [part.path], {stat.S_IFDIR: "directory", stat.S_IFREG: "file", stat.S_IFLNK: "symlink"}
        while todo:
            folder = todo.pop()
            below = os.path.relpath(folder, self.root)
            prefix = "" if below == "." else below + os.sep
            for entry in os.scandir(folder):
                facts = entry.stat(follow_symlinks=False)
                kind = kinds.get(stat.S_IFMT(facts.st_mode), "special")
                yield prefix + entry.name, kind, facts.st_size if kind == "file" else 0, facts.st_mtime_ns
                if kind == "directory" and part.deep:
                    todo.append(entry.path)


class TreeSource(DataSource):
    """format("tessera_tree").load(root): path (below root), kind (file, directory, symlink, special), size, modified (ns) of all below root. Links aren't followed."""

    @classmethod
    def name(cls) -> str:
        return "tessera_tree"

    def schema(self) -> str:
        return _TREE

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(local(self.options["path"]), int(self.options.get("spread", "64")))


def tree(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(TreeSource)
    return spark.read.format("tessera_tree").load(local(root))


def refusals(found: DataFrame, most_files: int = 50_000, most_bytes: int = 1 << 30, by: list[str] | None = None) -> DataFrame:
    """by, reason, path: why a listing (by, path, kind, size) isn't taken; none if it is.

    Links and special files, paths that are equal but for case or are a file here and a folder there, and what exceeds the ceilings, which hold for all of a listing, whatever tasks it came from.
    """
    by = by or []
    odd = found.where("kind NOT IN ('file', 'directory')").select(*by, F.concat("kind", F.lit(" entry")).alias("reason"), "path")
    named = found.select(*by, "path", F.col("kind").alias("own"))
    folders = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda n: F.array_join(F.slice(F.split("path", "/"), 1, n), "/"))
    above = found.where("path LIKE '%/%'").select(*by, F.explode(folders).alias("path"), F.lit("directory").alias("own"))
    each = named.union(above).groupBy(*by, F.lower("path").alias("folded")).agg(F.count_distinct("path").alias("spellings"), F.count_distinct("own").alias("kinds"), F.min("path").alias("path"))
    clashing = each.where("spellings > 1 OR kinds > 1").select(*by, F.lit("colliding paths").alias("reason"), "path")
    sums = found.groupBy(*by).agg(F.count_if(F.col("kind") != "directory").alias("n"), F.sum("size").alias("bytes"))
    none = F.lit(None).cast("string").alias("path")
    many = sums.where(F.col("n") > most_files).select(*by, F.lit("too many files").alias("reason"), none)
    large = sums.where(F.col("bytes") > most_bytes).select(*by, F.lit("too many bytes").alias("reason"), none)
    return odd.union(clashing).union(many).union(large)


def _blocks(path: str, offset: int, size: int) -> Iterator[bytes]:
    with open(path, "rb") as f:
        f.seek(offset)
        while size > 0 and (data := f.read(min(BLOCK, size))):
            size -= len(data)
            yield data


def checksums(found: DataFrame, root: str) -> DataFrame:
    """path, crc32, size of the files of a listing; a large file's parts are summed by different tasks and combined."""
    root = local(root)
    parts = found.where("kind = 'file'").select("path", F.col("size").alias("total"), F.explode(F.expr(f"sequence(0, greatest(size - 1, 0) div {SHARE})")).alias("part"))
    parts = parts.select("path", "total", (F.col("part") * SHARE).alias("offset")).withColumn("size", F.least(F.lit(SHARE), F.col("total") - F.col("offset")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            sums = []
            for path, offset, size in zip(rows.path, rows.offset, rows["size"], strict=True):
                crc = 0
                for data in _blocks(os.path.join(root, path), offset, size):
                    crc = zlib.crc32(data, crc)
                sums.append(crc)
            yield rows.assign(crc32=sums)

    dealt = parts.repartition(tasks(found.sparkSession), "path", "offset")
    return combined(dealt.mapInPandas(run, "path string, total long, offset long, size long, crc32 long"), ["path"])


def digests(found: DataFrame, root: str) -> DataFrame:
    """path, size, sha256 of the files of a listing, read in blocks of 1 MiB, never whole. A file that has changed its size since gets a null digest."""
    root = local(root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for path, size in zip(rows.path, rows["size"], strict=True):
                state, n = hashlib.sha256(), 0
                for data in _blocks(os.path.join(root, path), 0, size + 1):
                    state.update(data)
                    n += len(data)
                out.append(state.hexdigest() if n == size else None)
            yield rows.assign(sha256=pd.Series(out, dtype=object, index=rows.index))

    return found.where("kind = 'file'").select("path", "size").repartition(tasks(found.sparkSession), "path").mapInPandas(run, "path string, size long, sha256 string")


def _publish(folder: str, root: str, history: bool, stamp: str) -> int:
    """Files staged in folder take their places below root, each at once; what they replace is kept. A call that is made again moves what is left."""
    moved, made = 0, set()

    def above(path: str) -> None:
        if (parent := os.path.dirname(path)) not in made:
            os.makedirs(parent, exist_ok=True)
            made.add(parent)

    for at, _, names in os.walk(folder):
        below = os.path.relpath(at, folder)
        for name in names:
            path = os.path.normpath(os.path.join(below, name))
            staged, target = os.path.join(at, name), os.path.join(root, path)
            above(target)
            try:  # a new file is linked: file systems rename across folders one file at a time
                os.link(staged, target)
            except FileNotFoundError:
                if not os.path.exists(target):
                    raise
                continue  # another attempt of this task was faster
            except OSError:
                if os.path.lexists(target) and os.path.samefile(staged, target):
                    continue
                if history and os.path.exists(target):
                    old = os.path.join(root, ".history", f"{path}.{stamp}")
                    above(old)
                    with contextlib.suppress(FileExistsError):
                        os.link(target, old)
                os.replace(staged, target)
            moved += 1
    shutil.rmtree(folder, ignore_errors=True)
    return moved


def _synced(folder: str) -> None:
    """All that is written to this folder's file system is on its disk, or an error: one call for a task's files, as a call for each costs a wait for the disk for each."""
    syncfs = getattr(ctypes.CDLL(None, use_errno=True), "syncfs", None)
    f = os.open(folder, os.O_RDONLY)
    try:
        if syncfs is None:
            os.sync()
        elif syncfs(f):
            raise OSError(ctypes.get_errno(), "files can't be synced", folder)
    finally:
        os.close(f)


class _Staged(WriterCommitMessage):
    def __init__(self, folder: str):
        self.folder = folder


class DocumentWriter(DataSourceWriter):
    """Tasks write into a folder of the job beside the library. Once all have ended, their files are moved into place: by tasks of save's, or, without it, by the driver."""

    def __init__(self, root: str, history: bool, staging: str | None = None):
        self.root, self.history, self.published = root, history, staging is None
        self.staging = staging or _staging(root)
        os.makedirs(self.staging, exist_ok=True)

    def write(self, rows: Iterator) -> WriterCommitMessage:
        folder = os.path.join(self.staging, uuid.uuid4().hex)  # a task that is tried again has another one
        os.mkdir(folder)
        made = {folder}

        def make(path: str) -> None:
            """Folders below the task's: the job's own isn't made again, should the job have ended."""
            if path not in made:
                make(os.path.dirname(path))
                os.mkdir(path)
                made.add(path)

        for row in rows:
            path = os.path.normpath(row.path)
            if os.path.isabs(path) or any(p.startswith(".") for p in path.split(os.sep)):
                raise ValueError(f"a document can't be written to {row.path!r}")
            place = os.path.join(folder, path)
            make(os.path.dirname(place))
            with open(place, "xb") as f:
                f.write((row.content or "").encode())
        _synced(folder)
        return _Staged(folder)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        folders = [m.folder for m in messages if m]
        if self.published:
            stamp = str(os.stat(self.staging).st_mtime_ns)
            for folder in folders:
                _publish(folder, self.root, self.history, stamp)
            shutil.rmtree(self.staging, ignore_errors=True)
        else:
            with open(os.path.join(self.staging, COMMITTED), "w") as f:
                f.write("\n".join(folders))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        _dropped(self.staging)


def _staging(root: str) -> str:
    return os.path.join(root, f".staging-{uuid.uuid4().hex}")


def _dropped(staging: str) -> None:
    """A job's folder is removed under another name, under which tasks that haven't ended yet don't find it."""
    gone = f"{staging}-dropped"
    with contextlib.suppress(FileNotFoundError):
        os.rename(staging, gone)
    shutil.rmtree(gone, ignore_errors=True)


class DocumentSink(DataSource):
    """format("tessera_documents").save(root) of rows (path below root, content)."""

    @classmethod
    def name(cls) -> str:
        return "tessera_documents"

    def schema(self) -> str:
        return "path string, content string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return DocumentWriter(local(self.options["path"]), self.options.get("history", "true") == "true", self.options.get("staging"))


def save(documents: DataFrame, root: str, history: bool = True) -> None:
    """Rows (path, content) as files below root. If any task fails, no file of the library has changed; what is replaced is kept under .history. Paths are unique.

    Once all files are staged, those of each task that wrote them are moved by a task.
    """
    spark, root = documents.sparkSession, local(root)
    spark.dataSource.register(DocumentSink)
    staging = _staging(root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"moved": [_publish(x, root, history, stamp) for x in rows.folder]})

    try:
        documents.select("path", "content").write.format("tessera_documents").option("staging", staging).mode("append").save(root)
        with open(os.path.join(staging, COMMITTED)) as f:
            folders = f.read().splitlines()
        stamp = str(os.stat(staging).st_mtime_ns)
        if folders:
            dealt = spark.createDataFrame([(x,) for x in folders], "folder string").repartition(len(folders))
            dealt.mapInPandas(run, "moved long").agg(F.sum("moved")).collect()
    finally:
        _dropped(staging)
