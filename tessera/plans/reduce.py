"""Hierarchical reduction: items are packed into batches and batches reduced, level by level, until each group is one record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.packs import batched
from ..sources.shared import written


def reduced(items: DataFrame, by: str, order: str, size: str, most: int, shrink: int, levels: int = 12) -> DataFrame:
    """by, ids (sorted), size, levels: one record for each group, which holds the ids of all its items.

    A batch of items of at most `most` together becomes one item whose size is their sum divided by `shrink`. A level that
    makes no group smaller, or more levels than allowed, is an error.
    """
    now = items.select(by, F.col(order).cast("long").alias("place"), F.col(size).cast("long").alias("size"), F.array(F.col(order).cast("long")).alias("ids"))
    before, level = None, 0
    while True:
        counts = now.groupBy(by).agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
        if (counts.most or 0) <= 1:
            return now.select(by, F.array_sort("ids").alias("ids"), "size", F.lit(level).alias("levels"))
        if level >= levels or before == counts["all"]:
            raise ValueError("the reduction doesn't come to an end")
        before, level = counts["all"], level + 1
        batches = batched(now, [by], "place", "size", most)
        grouped = now.join(batches, [by, "place"]).groupBy(by, "batch")
        now = grouped.agg(F.min("place").alias("place"), F.greatest(F.lit(1), F.floor(F.sum("size") / shrink)).cast("long").alias("size"), F.flatten(F.collect_list("ids")).alias("ids")).drop("batch")
        now = written(now, "level")  # else every level would be computed again by those after it
