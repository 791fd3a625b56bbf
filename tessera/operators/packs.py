"""Ordered folds: admission under budgets, sequential packing, line chunks, and split points."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def folded(df: DataFrame, by: list[str], order: str, size: str, schema: str, start: Callable[[], list], step: Callable[[list, int], object]) -> DataFrame:
    """by, order and step's value for each row, as a fold over a group's rows in order. step: changes the group's state and gives the row's value, or None to leave it out.

    Groups are dealt by key and sorted by Spark, which may spill; a task holds one batch of rows and one state, however large a group is.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    names = [*by, order]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, state = None, start()
        for rows in batches:
            keys = list(zip(*(rows[c] for c in by), strict=True))
            values = []
            for key, s in zip(keys, rows["__size"].tolist(), strict=True):
                if key != group:
                    group, state = key, start()
                values.append(step(state, s))
            kept = [v is not None for v in values]
            yield rows.loc[kept, names].assign(value=[v for v in values if v is not None])

    sorted_ = df.select(*names, F.col(size).cast("long").alias("__size")).repartition(*by).sortWithinPartitions(*by, order)
    return sorted_.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in names) + f", value {schema}")


def admitted(df: DataFrame, by: list[str], order: str, size: str, most_items: int, most_size: int) -> DataFrame:
    """by, order of items admitted in order under both budgets; what doesn't fit is skipped, and later smaller items may still be admitted."""

    def step(state: list, s: int) -> int | None:
        if state[0] < most_items and state[1] + s <= most_size:
            state[0], state[1] = state[0] + 1, state[1] + s
            return 1
        return None

    return folded(df, by, order, size, "int", lambda: [0, 0], step).drop("value")


def batched(df: DataFrame, by: list[str], order: str, size: str, most: int, refuse: bool = False) -> DataFrame:
    """by, order, batch: items packed in order into batches of at most `most`; a larger item has its own batch, or is an error if refused."""

    def step(state: list, s: int) -> int:
        if refuse and s > most:
            raise ValueError(f"an item of {s} doesn't fit into a batch of {most}")
        if state[1] and state[1] + s > most:
            state[0], state[1] = state[0] + 1, 0
        state[1] += s
        return state[0]

    return folded(df, by, order, size, "int", lambda: [0, 0], step).withColumnRenamed("value", "batch")


def halves(df: DataFrame, by: list[str], order: str, size: str) -> DataFrame:
    """by, split: the first place (from 1) at which an ordered group's sizes reach half, but for the last item; by running sums."""
    w = Window.partitionBy(*by)
    so_far = w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.select(*by, order, F.col(size).cast("long").alias("__s")).withColumns({"__total": F.sum("__s").over(w), "__n": F.count("*").over(w), "__used": F.sum("__s").over(so_far), "__at": F.row_number().over(w.orderBy(order))})
    at = F.min(F.when(F.col("__used") * 2 >= F.col("__total"), F.col("__at")))
    first = rows.where("__n > 1").groupBy(*by).agg(at.alias("__first"), F.max("__n").alias("__n"))
    return first.select(*by, F.greatest(F.lit(1), F.least(F.col("__first"), F.col("__n") - 1)).cast("int").alias("split"))


def _chunked(text: str, lines: int, chars: int) -> Iterator[tuple[int, int, str]]:
    """(first line, last line, body) of each chunk of one text."""
    held, size, first, last = [], 0, 0, 0
    for number, line in enumerate(text.split("\n"), 1):
        for lo in range(0, max(1, len(line)), chars):
            part = line[lo : lo + chars]
            if held and (len(held) == lines or size + 1 + len(part) > chars):
                yield first, last, "\n".join(held)
                held = []
            if held:
                size += 1 + len(part)
            else:
                first, size = number, len(part)
            held.append(part)
            last = number
    if held:
        yield first, last, "\n".join(held)


def line_chunks(docs: DataFrame, key: str, text: str, lines: int, chars: int) -> DataFrame:
    """key, chunk_index, start_line, end_line, body: at most so many lines and characters to a chunk; a longer line is cut.

    Lines are numbered from 1 and end at line feeds; a null text is one empty line. Each text is cut in one pass.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for lo in range(0, len(rows), 500):
                some = rows.iloc[lo : lo + 500]
                out = [(k, i, *c) for k, t in zip(some[key], some[text], strict=True) for i, c in enumerate(_chunked(t or "", lines, chars))]
                yield pd.DataFrame(out, columns=[key, "chunk_index", "start_line", "end_line", "body"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInPandas(run, f"{key} {kind}, chunk_index int, start_line int, end_line int, body string")


def halved(rows: DataFrame, by: str, place: str, running: str, most: int, depth: int) -> DataFrame:
    """by, lo, hi: ranges of places (from 1) whose sizes are at most `most` together, from halving whole groups as often as needed, `depth` times at most.

    running: the sum of sizes up to a place, so that a range's size is a difference of two rows; each round looks only at ranges that are too large.
    """
    runs = written(rows.select(by, F.col(place).alias("__at"), F.col(running).alias("__run")), "runs")
    now = runs.groupBy(by).agg(F.lit(1).cast("long").alias("lo"), F.max("__at").alias("hi"))
    done = None
    for k in range(depth + 1):
        upper = now.join(runs.select(by, F.col("__at").alias("hi"), F.col("__run").alias("__high")), [by, "hi"])
        sized = upper.join(runs.select(by, (F.col("__at") + 1).alias("lo"), F.col("__run").alias("__low")), [by, "lo"], "left").withColumn("__size", F.col("__high") - F.coalesce("__low", F.lit(0)))
        sized = written(sized.select(by, "lo", "hi", "__size"), "ranges")
        large = (F.col("__size") > most) & (F.col("hi") > F.col("lo")) & F.lit(k < depth)
        fits = sized.where(~large).select(by, "lo", "hi")
        done = fits if done is None else done.union(fits)
        if sized.where(large).isEmpty():
            break
        mid = F.floor((F.col("lo") + F.col("hi")) / 2)
        parts = F.explode(F.array(F.struct(F.col("lo").alias("a"), mid.alias("b")), F.struct((mid + 1).alias("a"), F.col("hi").alias("b"))))
        now = sized.where(large).select(by, parts.alias("p")).select(by, F.col("p.a").alias("lo"), F.col("p.b").alias("hi"))
    return done
