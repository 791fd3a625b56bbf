"""Functions that live outside, called from tasks: with attempts, waits between them, and a record of each call."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


class Transient(Exception):
    """A failure that may pass: worth another attempt."""


def completed(rows: DataFrame, key: str, text: str, client: Callable[[], Callable[[str], str]], attempts: int = 3, wait: float = 0.5) -> DataFrame:
    """key, output, status, attempts, input_chars, output_chars of the client's answer to each text.

    client makes the function once a task. A transient failure and an empty answer get another attempt, after waits that double up to 8 seconds;
    any other failure is final. What failed has no output and says so: the call counts as usage anyway.
    """

    def called(f: Callable[[str], str], value: str) -> tuple[str | None, str, int]:
        for n in range(1, attempts + 1):
            try:
                if answer := f(value):
                    return answer, "ok", n
            except Transient:
                pass
            except Exception:
                return None, "error", n
            if n < attempts:
                time.sleep(min(8.0, wait * 2 ** (n - 1)))
        return None, "exhausted", attempts

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = client()
        for batch in batches:
            done = [called(f, t or "") for t in batch[text]]
            frame = pd.DataFrame({key: batch[key], "output": pd.Series([d[0] for d in done], dtype=object, index=batch.index), "status": [d[1] for d in done], "attempts": [d[2] for d in done]})
            yield frame.assign(input_chars=batch[text].fillna("").str.len(), output_chars=[len(d[0] or "") for d in done])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, output string, status string, attempts int, input_chars long, output_chars long")


def embedded(rows: DataFrame, key: str, text: str, client: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 32) -> DataFrame:
    """key, vector of each text, asked for in batches; a reply with another number of vectors than texts, or with vectors of different lengths, is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = client()
        for frame in batches:
            for lo in range(0, len(frame), batch):
                some = frame.iloc[lo : lo + batch]
                vectors = f(some[text].fillna("").tolist())
                if len(vectors) != len(some) or len({len(v) for v in vectors}) != 1 or not vectors[0]:
                    raise ValueError("the reply's vectors don't fit the texts")
                yield pd.DataFrame({key: some[key].to_numpy(), "vector": vectors})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, vector array<float>")


def parsed(rows: DataFrame, key: str, content: str, parser: Callable[[str], list[tuple[str, str]]], most: int) -> DataFrame:
    """key, status, place, kind, text: what a parser finds in each content, in order.

    parser: any function from a content to (kind, text) pairs. A content with more than `most` blocks, or one that the parser fails on,
    gives one row without a block that says so; never a part of its blocks.
    """

    def blocks(value: str) -> list[tuple]:
        try:
            found = parser(value)
        except Exception:
            return [("failed", None, None, None)]
        if len(found) > most:
            return [("refused", None, None, None)]
        return [("ok", i, kind, text) for i, (kind, text) in enumerate(found)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 500):
                out = [(k, *b) for k, v in zip(batch[key].iloc[lo : lo + 500], batch[content].iloc[lo : lo + 500], strict=True) for b in blocks(v or "")]
                frame = pd.DataFrame(out, columns=[key, "status", "place", "kind", "text"])
                yield frame.astype({"place": "Int64", "kind": object, "text": object})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, content).mapInPandas(run, f"{key} {kind}, status string, place long, kind string, text string")
