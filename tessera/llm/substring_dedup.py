"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark; repeated windows merge into removal intervals.

Each task hashes every window of its documents and deals the hashes out by a second,
independent hash into buckets of bounded size: one row for a bucket holds many windows as
packed bytes, about nine a window. A window that repeats inside a task's own block is dealt out once, so
that a passage that most documents hold arrives once a block and no bucket grows hot. The rows of a block
are at most FAN however many buckets there are: beyond, buckets share rows, and a second exchange deals them apart. A
task for each bucket finds the hashes that several blocks share; their positions go back to
the block's list of documents, where covered words merge into maximal intervals. Texts
move once, for the join that applies the intervals.

Two windows count as equal if the 64-bit hash and the bucket agree. The number of
buckets grows with the corpus, so that the chance that a window is taken for a copy by mistake
stays below window_target / 2**64 (6e-14) at any size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, ROLL_A, ROLL_B, WordHashes, rolling, shuffle_partitions

WINDOW = 35
#: Windows in a bucket, about: 9 MB of hashes and positions.
WINDOW_TARGET = 1_000_000
#: Words in a block, about; a longer document is a block of its own.
BLOCK_WORDS = 1_500_000

#: Rows that a block is dealt into, at most. Where there are more buckets, a row holds the windows of several, which a second exchange deals apart.
FAN = 8192
#: Windows that a task of the second exchange gathers before it deals them on.
GATHERED = 4_000_000

#: kind: w, windows of a block in a bucket (or of several blocks: names joined by commas, numbers in lengths; subs: which of a row's buckets); d, a block's list of documents.
_RECORD = "bucket long, block string, kind string, hashes binary, positions binary, subs binary, lengths binary, doc_ids array<long>, text_keys array<long>, n_words array<long>"


def _pack(positions: np.ndarray) -> bytes:
    """Positions, mostly ascending, as compressed gaps modulo 2**32."""
    gaps = np.diff(positions, prepend=0).astype(np.uint32)
    return len(gaps).to_bytes(4, "little") + pa.compress(gaps.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    return np.cumsum(np.frombuffer(pa.decompress(data[4:], 4 * n, codec="zstd"), np.uint32), dtype=np.uint32).astype(np.int64)


def _per_row(n_buckets: int, fan: int = FAN) -> int:
    """Buckets that share a row of the first exchange."""
    return -(-n_buckets // fan)


def _block_rows(block: str, docs: list[tuple], words: np.ndarray, window: int, n_buckets: int, fan: int = FAN) -> Iterator[dict]:
    """The packed rows of one block of documents; docs: (doc_id, text key, number of words)."""
    counts = np.array([d[2] for d in docs], np.int64)
    repeated = np.zeros(0, np.int64)
    if len(words) >= window:
        left = np.repeat(np.cumsum(counts), counts) - np.arange(len(words))
        at = np.flatnonzero(left >= window)  # windows don't cross from one document to the next
        keys = rolling(words, window, ROLL_A)[at]
        buckets = (rolling(words, window, ROLL_B)[at] % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        same &= buckets[order][1:] == buckets[order][:-1]
        again, several = np.zeros(len(at), bool), np.zeros(len(at), bool)
        again[order[1:]] = same
        several[order[1:]] |= same
        several[order[:-1]] |= same
        repeated = at[several]
        at, keys, buckets = at[~again], keys[~again], buckets[~again]
        order = np.argsort(buckets.astype(np.uint16) if n_buckets <= 1 << 16 else buckets, kind="stable")
        at, keys, buckets = at[order], keys[order], buckets[order]
        per = _per_row(n_buckets, fan)
        rows = buckets // per
        starts = np.flatnonzero(np.diff(rows, prepend=-1)) if len(at) else []
        for lo, hi in zip(starts, [*starts[1:], len(buckets)], strict=False):
            subs = None if per == 1 else _pack(buckets[lo:hi] % per)
            yield {"bucket": int(rows[lo]), "block": block, "kind": "w", "hashes": keys[lo:hi].tobytes(), "positions": _pack(at[lo:hi]), "subs": subs}
    own = n_buckets + int.from_bytes(hashlib.blake2b(block.encode(), digest_size=4).digest(), "little")
    yield {"bucket": own, "block": block, "kind": "d", "positions": _pack(repeated), "doc_ids": [d[0] for d in docs], "text_keys": [d[1] for d in docs], "n_words": [d[2] for d in docs]}


_KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
_SCHEMA = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in _RECORD.split(", ")])


def _hashed(window: int, n_buckets: int, block_words: int, fan: int):

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, n = WordHashes(), TaskContext.get().partitionId(), 0
        docs: list[tuple] = []
        words: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = list(_block_rows(f"{part}-{n}", docs, np.concatenate(words) if words else np.zeros(0, np.uint64), window, n_buckets, fan))
            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

        for batch in batches:
            for doc_id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                split = (text.as_py() or b"").split()
                docs.append((doc_id, key, len(split)))
                words.append(known.of(split))
                held += len(split) + 1
                if held >= block_words:
                    yield from flush()
                    docs, words, held, n = [], [], 0, n + 1
        if docs:
            yield from flush()

    return run


def _redealt(per: int, gathered: int):
    """The rows of the first exchange as rows of single buckets, each of many blocks."""

    def dealt(rows: list[dict]) -> pa.RecordBatch:
        counts = np.array([len(r["hashes"]) // 8 for r in rows])
        keys = np.frombuffer(b"".join(r["hashes"] for r in rows), np.uint64)
        positions = np.concatenate([_unpack(r["positions"]) for r in rows])
        buckets = np.concatenate([_unpack(r["subs"]) for r in rows]) + np.repeat([r["bucket"] * per for r in rows], counts)
        order = np.argsort(buckets, kind="stable")
        keys, positions, buckets, block = keys[order], positions[order], buckets[order], np.repeat(np.arange(len(rows)), counts)[order]
        starts = np.flatnonzero(np.diff(buckets, prepend=-1))
        out = []
        for lo, hi in zip(starts, [*starts[1:], len(buckets)], strict=True):
            edges = np.flatnonzero(np.diff(block[lo:hi], prepend=-1))
            names, lengths = [rows[k]["block"] for k in block[lo + edges]], np.diff(edges, append=hi - lo).astype(np.uint32)
            out.append({"bucket": int(buckets[lo]), "block": ",".join(names), "kind": "w", "hashes": keys[lo:hi].tobytes(), "positions": _pack(positions[lo:hi]), "lengths": lengths.tobytes()})
        return pa.RecordBatch.from_pylist(out, _SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        held = 0
        for batch in batches:
            lists = pc.equal(batch.column("kind"), "d")
            yield batch.filter(lists)
            for row in batch.filter(pc.invert(lists)).to_pylist():
                rows.append(row)
                held += len(row["hashes"]) // 8
                if held >= gathered:
                    yield dealt(rows)
                    rows, held = [], 0
        if rows:
            yield dealt(rows)

    return run


def _shared(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: for each block the positions of windows that other blocks hold too; a block's list of documents passes through."""
    windows = rows[rows.kind == "w"]
    out = [rows[rows.kind == "d"]]
    if len(windows):
        parts = [np.frombuffer(x, np.uint64) for x in windows.hashes]
        keys = np.concatenate(parts)
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        several = np.zeros(len(keys), bool)
        several[order[1:]] |= same
        several[order[:-1]] |= same
        names = [n for blocks in windows.block for n in blocks.split(",")]
        sizes = np.concatenate([[len(p)] if x is None else np.frombuffer(x, np.uint32) for x, p in zip(windows.lengths, parts, strict=True)])
        ends = np.cumsum(sizes)
        positions = np.concatenate([_unpack(x) for x in windows.positions])
        found = []
        for block, lo, hi in zip(names, [0, *ends[:-1]], ends, strict=True):
            if (hit := several[lo:hi]).any():
                found.append((block, "p", _pack(positions[lo:hi][hit])))
        out.append(pd.DataFrame(found, columns=["block", "kind", "positions"]))
    return pd.concat(out)[["block", "kind", "positions", "doc_ids", "text_keys", "n_words"]].replace({np.nan: None})


def _covered(window: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        docs = rows[rows.kind == "d"].iloc[0]
        counts = np.asarray(docs.n_words, np.int64)
        edges = np.zeros(counts.sum() + 1, np.int64)
        for data in rows.positions:
            if len(at := _unpack(data)):
                edges[at] = 1
        edges = np.concatenate([edges, np.zeros(window, np.int64)])
        covered = np.cumsum(edges - np.concatenate([np.zeros(window, np.int64), edges[:-window]])) > 0
        out, lo = [], 0
        for doc_id, key, n in zip(docs.doc_ids, docs.text_keys, counts, strict=True):
            flips = np.flatnonzero(np.diff(np.concatenate([[False], covered[lo : lo + n], [False]]).astype(np.int8)))
            out.append((doc_id, key, n, int((flips[1::2] - flips[::2]).sum()), flips[::2], flips[1::2]))
            lo += n
        return pd.DataFrame(out, columns=["doc_id", "text_key", "n_words", "n_removed", "starts", "ends"])

    return run


def repeated_intervals(docs: DataFrame, window: int = WINDOW, window_target: int = WINDOW_TARGET, block_words: int = BLOCK_WORDS, gathered: int = GATHERED, fan: int = FAN) -> DataFrame:
    """For each different (doc_id, text): n_words, n_removed and the maximal intervals of words to remove (starts, ends; ends exclusive).

    docs: doc_id, text; other columns are ignored. A null text has no words; a null
    doc_id is a value like any other; rows that repeat are repeats of each other. Texts shorter than the window lose
    nothing. A long text is a block of its own and takes memory in proportion to its words. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(shuffle_partitions(spark), chars // (6 * window_target) + 1)
    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")
    # Sorted, a partition that is computed again after a lost executor is dealt into the same blocks, whatever order its rows come in.
    packed = plain.sortWithinPartitions("doc_id", "text_key").mapInArrow(_hashed(window, n_buckets, block_words, fan), _RECORD)
    if (per := _per_row(n_buckets, fan)) > 1:
        packed = packed.repartition("bucket").mapInArrow(_redealt(per, gathered), _RECORD)
    back = packed.groupBy("bucket").applyInPandas(_shared, "block string, kind string, positions binary, doc_ids array<long>, text_keys array<long>, n_words array<long>")
    found = back.groupBy("block").applyInPandas(_covered(window), "doc_id long, text_key long, n_words long, n_removed long, starts array<int>, ends array<int>")
    return found.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def _kept_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        digests = []
        for text, starts, ends in zip(rows.text, rows.starts, rows.ends, strict=True):
            words = (text or "").encode().split()
            for lo, hi in zip(reversed(starts), reversed(ends), strict=True):
                del words[lo:hi]
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield rows.drop(columns="text").assign(kept_sha256=digests)


def _without(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        kept = []
        for text, starts, ends in zip(rows.text, rows.starts, rows.ends, strict=True):
            words = (text or "").encode().split()
            for lo, hi in zip(reversed(starts), reversed(ends), strict=True):
                del words[lo:hi]
            kept.append(b" ".join(words).decode())
        yield rows.drop(columns=["starts", "ends"]).assign(text=kept)


def _with_intervals(docs: DataFrame, **params) -> DataFrame:
    """Each row of docs (doc_id, text) with its intervals; rows that repeat stay as they are."""
    found = repeated_intervals(docs, **params).withColumnRenamed("doc_id", "found_id").dropDuplicates(["found_id", "text_key"])
    plain = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    return plain.join(found, (plain.key == found.text_key) & plain.doc_id.eqNullSafe(found.found_id)).drop("key", "text_key", "found_id")


def kept_digests(docs: DataFrame, **params) -> DataFrame:
    """doc_id, n_words, n_removed, starts, ends, kept_sha256 of each row; see repeated_intervals for nulls and repeats."""
    rows = _with_intervals(docs, **params)
    return rows.mapInPandas(_kept_digests, "doc_id long, n_words long, n_removed long, starts array<int>, ends array<int>, kept_sha256 string")


def remove_repeats(docs: DataFrame, **params) -> DataFrame:
    """doc_id, text (kept words joined by one space), n_words, n_removed of each row."""
    rows = _with_intervals(docs, **params)
    return rows.mapInPandas(_without, "doc_id long, text string, n_words long, n_removed long")
