"""Packing: mixture-controlled windows of tokens, filled by deficit round-robin over source queues.

The queue of a source is its documents' tokens one after another. Sources share the slots of
all windows in the proportions of the targets: a scheduler between two queues adds
c1 / (c1 + c2) to the first queue's deficit counter for each slot, and serves it when the counter reaches one; the second
queue gets the other slots, and is itself such a scheduler over the sources that remain.
After y slots the first queue has been served floor(y * c1 / (c1 + c2)) tokens, so that
the counters at the start of any window, in any partition, are known without running the windows before it:
deficits carry over windows and partitions exactly, and every partition cuts its own documents.
When a source runs out, a new phase shares its part among the others.

Jobs: tokenize once into a table in the shared folder, with each document's place in its
partition's queue; sum tokens by partition and source; cut each document where its
windows end. Only totals by queue reach the driver. Every window but the last is full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch
from .tokens import encoder

SEQUENCE = 2048
END_ID = 1
#: Queues of single sources, and queues that all other sources share: so many totals reach the driver and every task.
QUEUES, SHARED = 192, 64

_QUEUED = "part int, doc_id long, source string, before long, n long, ids binary"


def _queued(path: str, end_id: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, part = encoder(path), TaskContext.get().partitionId()
        before: dict[str, int] = {}
        for rows in batches:
            for lo in range(0, len(rows), 256):
                some = rows.iloc[lo : lo + 256]
                ids = [np.append(x, np.uint32(end_id)) for x in coder.encode(some.text.tolist())]
                starts = []
                for source, x in zip(some.source, ids, strict=True):
                    starts.append(before.get(source, 0))
                    before[source] = starts[-1] + len(x)
                packed = [pa.compress(x.astype("<u4").tobytes(), codec="zstd", asbytes=True) for x in ids]
                yield pd.DataFrame({"part": part, "doc_id": some.doc_id, "source": some.source, "before": starts, "n": [len(x) for x in ids], "ids": packed})

    return run


def phases(totals: list[int], targets: list[Fraction]) -> list[list[int]]:
    """Tokens that each source gets in each phase; a phase ends when a source runs out."""
    left, out = list(totals), []
    while any(left):
        active = [i for i, n in enumerate(left) if n]
        rounds = min(left[i] / targets[i] for i in active)
        part = [min(left[i], int(rounds * targets[i])) if i in active else 0 for i in range(len(left))]
        for i in active:
            if left[i] / targets[i] == rounds:
                part[i] = left[i]
        left = [a - b for a, b in zip(left, part, strict=True)]
        out.append(part)
    return out


def share(slots: np.ndarray, c: int, rest: int) -> np.ndarray:
    """slots * c // rest, exactly, for 0 <= slots, c <= rest < 2 ** 50, whose products need not fit 64 bits.

    The quotient in floating point is off by one at most. What it leaves of the product is smaller than 2 * rest, so that it is
    known from the product modulo 2 ** 64, and tells by how much the quotient is off.
    """
    guess = (slots * (c / rest)).astype(np.int64)
    left = (slots.astype(np.uint64) * np.uint64(c) - guess.astype(np.uint64) * np.uint64(rest)).view(np.int64)
    return guess + left // rest


class Schedule:
    """How many tokens the sources have been served after any number of slots."""

    def __init__(self, parts: list[list[int]]):
        self.parts = parts
        lengths = [sum(p) for p in parts]
        self.starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        self.total = int(self.starts[-1])

    def _phase(self, slots: np.ndarray, s: int, part: list[int], length: int) -> tuple[np.ndarray, np.ndarray]:
        """Slots of this phase left over by the sources before s, and tokens of s served in them."""
        left, rest = slots, length
        for c in part[:s]:
            if c:
                left, rest = left - share(left, c, rest), rest - c
        return left, (share(left, part[s], rest) if part[s] else left * 0)

    def served(self, slots: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
        """(slots that went to sources before s, tokens of s served), both after so many slots."""
        earlier, own = np.zeros(len(slots), np.int64), np.zeros(len(slots), np.int64)
        for part, lo, hi in zip(self.parts, self.starts, self.starts[1:], strict=False):
            inside = np.clip(slots, lo, hi) - lo
            left, got = self._phase(inside, s, part, int(hi - lo))
            earlier += (inside - left).astype(np.int64)
            own += got.astype(np.int64)
        return earlier, own

    def first_window(self, tokens: np.ndarray, s: int, window: int) -> np.ndarray:
        """The window in which each token (by its place in the queue of s) is served."""
        lo, hi = np.zeros(len(tokens), np.int64), np.full(len(tokens), self.total // window, np.int64)
        while (lo < hi).any():
            mid = (lo + hi) // 2
            done = self.served(np.minimum((mid + 1) * window, self.total), s)[1] > tokens
            lo, hi = np.where(done, lo, mid + 1), np.where(done, mid, hi)
        return lo


def _cut(queues: list[int], parts: list[list[int]], window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        schedule, rank = Schedule(parts), {q: i for i, q in enumerate(queues)}
        for rows in batches:
            for queue, own in rows.groupby("queue", sort=False):
                s = rank[queue]
                begin = (own.before + own.offset).to_numpy(np.int64)
                n = own.n.to_numpy(np.int64)
                first = schedule.first_window(begin, s, window)
                last = schedule.first_window(begin + n - 1, s, window)
                count = last - first + 1
                doc = np.repeat(np.arange(len(own)), count)
                seq = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[doc]
                skipped0, served0 = schedule.served(np.minimum(seq * window, schedule.total), s)
                skipped1, served1 = schedule.served(np.minimum((seq + 1) * window, schedule.total), s)
                lo, hi = np.maximum(served0, begin[doc]), np.minimum(served1, (begin + n)[doc])
                full = hi > lo  # a source with few tokens has windows without any
                doc, seq, lo, hi, served0, room = (x[full] for x in (doc, seq, lo, hi, served0, skipped1 - skipped0))
                start = lo - begin[doc]
                ids = [pa.decompress(x, 4 * k, codec="zstd", asbytes=True) for x, k in zip(own.ids, n, strict=True)]
                crc = [zlib.crc32(memoryview(ids[d])[4 * a : 4 * b]) for d, a, b in zip(doc, start, start + hi - lo, strict=True)]
                yield pd.DataFrame({"doc_id": own.doc_id.to_numpy()[doc], "start": start, "length": hi - lo, "ids_crc32": crc, "doc_tokens": n[doc], "sequence_id": seq, "offset": room + lo - served0, "source": own.source.to_numpy()[doc]})

    return run


def packed(docs: DataFrame, tokenizer_path: str, targets: dict[str, float] | None = None, window: int = SEQUENCE, end_id: int = END_ID, most_queues: int = QUEUES) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source of each piece of each document.

    docs: doc_id, text, source; other columns are ignored. A null text is empty and
    holds only the end id; a null source is the source ''. Rows that repeat are packed
    as often as they occur. targets: token proportions by source (default: the sources' own shares of tokens); a source without a target
    gets the smallest one given. The most_queues largest sources and those with targets have queues of their own; the others,
    of which there may be any number, share SHARED queues by a hash of their names, each of which counts as one source.
    A text of any length is encoded whole by one task. An empty table gives an empty result.
    """
    plain = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
    queued = scratch(plain.mapInPandas(_queued(tokenizer_path, end_id), _QUEUED), "queued")
    sizes = queued.groupBy("source", "part").agg(F.sum("n").alias("tokens"))
    largest = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens")).orderBy(F.desc("tokens"), "source").limit(most_queues)
    named = sorted({r.source for r in largest.collect()} | set(targets or {}))
    own = docs.sparkSession.createDataFrame(list(enumerate(named)), "own int, source string")
    shared = F.pmod(F.xxhash64("source"), F.lit(SHARED)).cast("int") + len(named)
    by_part = scratch(sizes.join(F.broadcast(own), "source", "left").withColumn("queue", F.coalesce("own", shared)).drop("own"), "sizes")
    before = Window.partitionBy("queue").orderBy("part", "source").rowsBetween(Window.unboundedPreceding, -1)
    offsets = scratch(by_part.select("source", "part", "queue", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("offset")), "offsets")
    totals = {r.queue: r.tokens for r in by_part.groupBy("queue").agg(F.sum("tokens").alias("tokens")).collect()}
    queues = sorted(totals)
    least = min(targets.values()) if targets else 1
    aims = [Fraction(targets.get(named[q], least) if q < len(named) else least) if targets else Fraction(totals[q]) for q in queues]
    parts = phases([totals[q] for q in queues], aims)
    return queued.join(offsets, ["source", "part"]).mapInPandas(_cut(queues, parts, window), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")
