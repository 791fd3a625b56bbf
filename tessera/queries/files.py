"""Documents as files and archives in the shared folder, and what is found there: trees, digests, checksums, members, faults."""

from __future__ import annotations

import io
import itertools
import os
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from ..sources import archives, files
from ..sources.shared import place, tasks, written
from .registry import query

#: Documents that share an archive, by number.
PER_ARCHIVE = 40
_NAME = "source || '/' || lang || '/' || doc_id || '.md'"


def _path():
    return F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))


def _library(t) -> str:
    root = place(t.spark, "library")
    files.save(t.documents.select(_path().alias("path"), F.col("text").alias("content")), root)
    return root


@query(f"SELECT {_NAME} AS path, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS sha256 FROM documents")
def saved_library(t):
    """Documents written as files, listed and digested in blocks."""
    root = _library(t)
    return files.digests(files.tree(t.spark, root), root)


@query(f"""WITH a AS (SELECT {_NAME} AS path, 'file' AS kind FROM documents), d AS (SELECT DISTINCT source AS path, 'directory' AS kind FROM documents UNION SELECT DISTINCT source || '/' || lang, 'directory' FROM documents)
SELECT * FROM a UNION ALL SELECT * FROM d""")
def listed_library(t):
    return files.tree(t.spark, _library(t)).select("path", "kind")


@query(f"SELECT {_NAME} AS path, sha256(CASE WHEN lang = 'de' THEN text || '!' ELSE text END) AS sha256, lang = 'de' AS replaced FROM documents")
def replaced_library(t):
    """German documents are written again; what they replace is kept beside the library."""
    root = _library(t)
    files.save(t.documents.where("lang = 'de'").select(_path().alias("path"), F.concat("text", F.lit("!")).alias("content")), root)
    found = files.tree(t.spark, root)
    now = files.digests(found.where("path NOT LIKE '.history/%'"), root).select("path", "sha256")
    old = found.where("path LIKE '.history/%' AND kind = 'file'").select(F.regexp_replace("path", r"^\.history/|\.\d+$", "").alias("path"), F.lit(True).alias("replaced"))
    return now.join(old, "path", "left").select("path", "sha256", F.coalesce("replaced", F.lit(False)).alias("replaced"))


def _archives(t, damaged: bool = False):
    """A zip for each source and run of document numbers, with a manifest; of damaged ones a byte of the first document is flipped where the number of the run is even."""
    folder = files.local(place(t.spark, "archives"))
    os.makedirs(folder)

    def pack(key: tuple, rows: list[tuple]) -> str:
        path, out = f"{folder}/{key[0]}-{key[1]}.zip", io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("manifest.json", '{"format": 1, "includes": ["documents"]}')
            for _, _, doc_id, text in rows:
                z.writestr(zipfile.ZipInfo(f"documents/{doc_id}.md"), text.encode(), zipfile.ZIP_STORED if damaged else zipfile.ZIP_DEFLATED)
        data = bytearray(out.getvalue())
        if damaged and key[1] % 2 == 0:
            at = zipfile.ZipFile(io.BytesIO(data)).infolist()[1].header_offset
            data[at + 30 + len(f"documents/{rows[0][2]}.md") + 1] ^= 1
        with open(f"{path}.{os.getpid()}", "wb") as f:
            f.write(data)
        os.replace(f"{path}.{os.getpid()}", path)
        return path

    def packs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """An archive after the other, of rows in order: a task holds one at a time."""
        rows = (row for batch in batches for row in batch.itertuples(index=False, name=None))
        paths = (pack(key, list(own)) for key, own in itertools.groupby(rows, lambda row: row[:2]))
        while some := list(itertools.islice(paths, 1000)):
            yield pd.DataFrame({"path": some})

    runs = t.documents.select("source", F.expr(f"doc_id div {PER_ARCHIVE}").alias("run"), "doc_id", "text")
    dealt = runs.repartition(tasks(t.spark), "source", "run").sortWithinPartitions("source", "run", "doc_id")
    return written(dealt.mapInPandas(packs, "path string"), "packed")


def _short(c: str = "archive"):
    return F.regexp_replace(c, r"^.*/|\.zip$", "").alias("archive")


@query(f"SELECT source || '-' || doc_id // {PER_ARCHIVE} AS archive, 'documents/' || doc_id || '.md' AS entry, sha256(text) AS sha256 FROM documents")
def archived_members(t):
    """Members read by their byte ranges."""
    found = archives.members(archives.index(_archives(t)).where("entry LIKE 'documents/%'"))
    return found.select(_short(), "entry", F.sha2("content", 256).alias("sha256"))


@query(f"SELECT source || '-' || doc_id // {PER_ARCHIVE} AS archive, count(*) + 1 AS entries, CAST(sum(strlen(text)) + 40 AS BIGINT) AS size FROM documents GROUP BY ALL")
def archive_inventory(t):
    """Entries and unpacked sizes of archives, from their directories alone."""
    return archives.index(_archives(t)).groupBy(_short()).agg(F.count("*").alias("entries"), F.sum("size").alias("size"))


@query(f"SELECT source || '-' || doc_id // {PER_ARCHIVE} AS archive, 'member' AS kind, 'documents/' || min(doc_id) || '.md' AS name, 'checksum differs' AS problem FROM documents GROUP BY source, doc_id // {PER_ARCHIVE} HAVING (doc_id // {PER_ARCHIVE}) % 2 = 0")
def invalid_archives(t):
    """Backups of which a byte has changed: a row for each damaged member, and no failure."""
    return archives.validity(_archives(t, damaged=True)).select(_short(), "kind", "name", "problem")
