"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a linked list of byte pieces. Every pair of neighbours that has a merge
rank stands in that rank's bucket, by the position of its left piece. A bitmap of two
levels says which buckets hold entries: find-first-set on the top level, then on one
word, gives the least rank; the bucket gives its leftmost position. Entries whose pair
has changed since are stale and get skipped. Each merge touches two pairs, so a
pre-token of n bytes takes O(n log n) steps.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ONE = [1 << i for i in range(256)]


class RankQueue:
    """Positions by rank; pop gives the least rank and, of its positions, the leftmost."""

    def __init__(self, n_ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.words = [0] * ((n_ranks >> 8) + 1)
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            self.words[rank >> 8] |= _ONE[rank & 255]
            self.top |= 1 << (rank >> 8)
        else:
            heappush(bucket, position)

    def pop(self) -> tuple[int, int]:
        word = (self.top & -self.top).bit_length() - 1
        bits = self.words[word]
        rank = word << 8 | ((bits & -bits).bit_length() - 1)
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.words[word] = bits = bits & (bits - 1)
            if not bits:
                self.top &= self.top - 1
        return rank, position


class ByteBPE:
    """Ranks of byte strings, as encoder and decoder; pattern splits a text into pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = 500_000):
        import regex

        self.ranks, self.most = ranks, most
        self.vocabulary = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            self.vocabulary[rank] = piece
        self.numbers = list(range(len(self.vocabulary)))  # one object for each id, shared by all that is remembered
        self.split = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.queue = RankQueue(len(self.vocabulary))
        self.pairs = [[ranks.get(bytes((a, b)), -1) for b in range(256)] for a in range(256)]

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one pre-token."""
        ranks, numbers = self.ranks, self.numbers
        if (whole := ranks.get(piece)) is not None:
            return (numbers[whole],)
        # The queue's push and pop are written out here, as this is the innermost loop.
        n, get, queue = len(piece), ranks.get, self.queue
        buckets, words, top = queue.buckets, queue.words, 0
        after = list(range(1, n + 2))  # where each piece ends, which is where the next begins
        before = list(range(-1, n))
        # The rank of each piece's pair with the next piece, -1 for none.
        wanted = [row[b] for row, b in zip(map(self.pairs.__getitem__, piece), piece[1:], strict=False)]
        wanted.append(-1)
        for i, rank in enumerate(wanted):
            if rank >= 0:
                if rank in buckets:
                    buckets[rank].append(i)  # ascending, so a heap
                else:
                    buckets[rank] = [i]
                    words[rank >> 8] |= _ONE[rank & 255]
                    top |= 1 << (rank >> 8)
        while top:
            word = (top & -top).bit_length() - 1
            bits = words[word]
            rank = word << 8 | ((bits & -bits).bit_length() - 1)
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                words[word] = bits = bits & (bits - 1)
                if not bits:
                    top &= top - 1
            if wanted[i] != rank:
                continue  # stale
            middle = after[i]
            after[i] = end = after[middle]
            wanted[middle] = wanted[i] = -1
            if end < n:
                before[end] = i
                new = get(piece[i : after[end]])
                if new is not None:
                    wanted[i] = new
                    if new in buckets:
                        heappush(buckets[new], i)
                    else:
                        buckets[new] = [i]
                        words[new >> 8] |= _ONE[new & 255]
                        top |= 1 << (new >> 8)
            left = before[i]
            if left >= 0:
                new = get(piece[left:end])
                if new is None:
                    wanted[left] = -1
                elif new != wanted[left]:
                    wanted[left] = new
                    if new in buckets:
                        heappush(buckets[new], left)
                    else:
                        buckets[new] = [left]
                        words[new >> 8] |= _ONE[new & 255]
                        top |= 1 << (new >> 8)
        out, i = [], 0
        while i < n:
            out.append(numbers[ranks[piece[i : after[i]]]])
            i = after[i]
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        if len(self.known) > self.most:
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        ids: list[int] = []
        for word in self.split(text):
            own = known.get(word)
            if own is None:
                own = old.get(word) or self.merged(word.encode())
                if len(word) <= 64:
                    known[word] = own
            ids += own
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


_coders: dict[tuple[str, str], ByteBPE] = {}


def coder(path: str, pattern: str) -> ByteBPE:
    """The coder of a rank file, built once a Python worker and used by all its tasks."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = ByteBPE.from_file(path, pattern)
    return _coders[path, pattern]


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids of each row. Null texts and empty texts have no ids; other columns are ignored."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = coder(path, pattern)
        for rows in batches:
            yield pd.DataFrame({"doc_id": rows.doc_id, "ids": [bpe.encode(t or "") for t in rows.text]})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, bytes of each row of (doc_id, ids); null ids decode to no bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = coder(path, pattern)
        for rows in batches:
            yield pd.DataFrame({"doc_id": rows.doc_id, "bytes": [bpe.decode(x if x is not None else []) for x in rows.ids]})

    return tokens.select("doc_id", "ids").mapInPandas(run, "doc_id long, bytes binary")


def round_trips(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row: encoded, then decoded from the ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = coder(path, pattern)
        spelled = [str(i) for i in bpe.numbers]
        for rows in batches:
            out = []
            for doc_id, text in zip(rows.doc_id, rows.text, strict=True):
                ids = bpe.encode(text or "")
                listed = ",".join(map(spelled.__getitem__, ids))
                out.append((doc_id, len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
