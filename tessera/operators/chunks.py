"""Overlapping and lossless chunks of long texts; a text's chunks are an ordered fold, so each is cut in one task."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame

_ANCHOR = re.compile(r"\[\d{2}:\d{2}:\d{2}\]")


def overlapping(text: str, size: int, overlap: int) -> list[str]:
    """Chunks of whole lines of about `size` characters; each begins with the end of the one before, stripped."""
    out, held = [], ""
    for line in text.splitlines(keepends=True):
        if held and len(held) + len(line) > size:
            out.append(held.strip())
            held = out[-1][-overlap:] if overlap else ""
        held += line
    return [*out, held.strip()] if held.strip() else out


def with_trailing_lines(text: str, size: int, overlap: int) -> list[str]:
    """Chunks of whole lines of at most `size` characters (a longer line is a chunk's last); each repeats the whole lines, of at most `overlap` characters together, that ended the one before."""
    if len(text) <= size:
        return [text]
    lines = text.splitlines(keepends=True)
    ends = [0, *accumulate(map(len, lines))]
    out, first, new = [], 0, 0  # a chunk's first line, and the first of its lines that is new
    while new < len(lines):
        stop = max(new + 1, bisect_right(ends, ends[first] + size) - 1)
        out.append(text[ends[first] : ends[stop]])
        first, new = max(first, bisect_left(ends, ends[stop] - overlap)), stop
    return out


def lossless(text: str, size: int) -> list[str]:
    """Pieces of at most `size` characters that join to the text: cut at a blank line, line end or blank in a window's second half, else at its end."""
    out, at = [], 0
    while len(text) - at > size:
        window = text[at : at + size]
        cut = next((k + len(mark) for mark in ("\n\n", "\n", " ") if (k := window.rfind(mark)) >= size // 2), size)
        out.append(window[:cut])
        at += cut
    return [*out, text[at:]]


def _each(docs: DataFrame, key: str, text: str, cut) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(k, i, (m[0] if (m := _ANCHOR.search(c)) else None), c) for k, t in zip(rows[key], rows[text], strict=True) for i, c in enumerate(cut(t or ""))]
            yield pd.DataFrame(out, columns=[key, "chunk_index", "anchor", "body"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInPandas(run, f"{key} {kind}, chunk_index int, anchor string, body string")


def overlapping_chunks(docs: DataFrame, key: str, text: str, size: int = 1800, overlap: int = 200) -> DataFrame:
    """key, chunk_index, anchor (the first clock in the chunk), body."""
    return _each(docs, key, text, lambda t: overlapping(t, size, overlap))


def lossless_chunks(docs: DataFrame, key: str, text: str, size: int = 12_000) -> DataFrame:
    """key, chunk_index, anchor, body; a text's bodies join to the text."""
    return _each(docs, key, text, lambda t: lossless(t, size))


def trailing_line_chunks(docs: DataFrame, key: str, text: str, size: int = 24_000, overlap: int = 500) -> DataFrame:
    """key, chunk_index, anchor, body; see with_trailing_lines."""
    return _each(docs, key, text, lambda t: with_trailing_lines(t, size, overlap))
