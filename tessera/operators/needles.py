"""Many search strings in many texts in one pass: a matching automaton of each shard of strings, run over lines."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strings in one automaton: about 30 MB at 40 characters each.
SHARD = 20_000


def shards(needles: DataFrame, needle: str, size: int = SHARD) -> DataFrame:
    """shard, needles (sorted): distinct, non-empty strings in runs of about `size`."""
    each = needles.select(F.col(needle).alias("needle")).where("needle <> ''").distinct()
    n = max(1, -(-each.count() // size))
    return each.groupBy(F.pmod(F.xxhash64("needle"), F.lit(n)).alias("shard")).agg(F.sort_array(F.collect_list("needle")).alias("needles"))


def found(lines: DataFrame, key: list[str], text: str, parts: DataFrame) -> DataFrame:
    """key, needle, first, times: where in its text each needle of parts (from `shards`) occurs first (from 0, in characters) and how often, overlaps included.

    lines: any rows with the key's columns and a text; null texts hold nothing. Each text passes each shard's automaton once, whatever number of strings that holds; needles are found
    inside words as well. Shards have a bounded size and pass through the driver one by one, as parts of the plan; each task builds one automaton.
    """
    kinds = {f.name: f.dataType.simpleString() for f in lines.schema}

    texts = lines.where(F.col(text).isNotNull()).select(*key, F.col(text).alias("text"))
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in key), "needle string", "first long", "times long"])
    whole = lines.sparkSession.createDataFrame([], schema)
    for part in parts.select("needles").toLocalIterator():
        whole = whole.unionByName(texts.mapInPandas(_scanner(key, part.needles), schema))
    return whole


def _scanner(key: list[str], words: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = ahocorasick.Automaton()
        for word in words:
            machine.add_word(word, word)
        machine.make_automaton()
        for rows in batches:
            out = []
            for own in rows.itertuples(index=False):
                seen: dict[str, list[int]] = {}
                for end, needle in machine.iter(own[-1]):
                    at = seen.setdefault(needle, [end - len(needle) + 1, 0])
                    at[1] += 1
                out += [(*own[:-1], needle, first, times) for needle, (first, times) in seen.items()]
            yield pd.DataFrame(out, columns=[*key, "needle", "first", "times"])

    return run
