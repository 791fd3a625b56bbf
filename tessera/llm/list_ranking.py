"""Prefix sums along a linked list that is too long for one task.

The list is contracted: in each round every arc whose random priority is lower than its
neighbours' leaves it, so that about a third go and no two of them are neighbours; the next arc takes over a leaver's weights.
What remains after enough rounds has a proven bound and is walked in one task. Then the rounds are undone, last first: an arc
that left in a round follows an arc that is known by then. All rounds together move a few times the list.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch

#: Arcs that one task may walk.
WALKED = 1 << 14


def _walked(arcs: DataFrame, weights: list[str]) -> DataFrame:
    """Of lists of at most WALKED arcs in all: the sums, walked from their heads."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = {r[0]: r[1:] for frame in batches for r in frame.itertuples(index=False)}
        out, heads = [], [arc for arc, r in rows.items() if r[0] is None]
        for arc in heads:
            total = [0] * len(weights)
            while arc is not None:
                _, after, *own = rows[arc]
                total = [a + b for a, b in zip(total, own, strict=True)]
                out.append((arc, *total))
                arc = after
        yield pd.DataFrame(out, columns=["arc", *weights])

    return arcs.select("arc", "prev", "next", *weights).repartition(1).mapInPandas(run, ", ".join(["arc string", *(f"{w} long" for w in weights)]))


def prefix_sums(arcs: DataFrame, weights: list[str], walked: int = WALKED) -> DataFrame:
    """arc and, for each weight, its sum over the arc itself and all before it.

    arcs: arc (unique string), prev, next (null at the list's ends), weights (longs, no nulls): one list. No arcs give no rows.
    walked: arcs that may be walked in one task (fewer only to test the contraction).
    """
    rest, left, n = arcs.select("arc", "prev", "next", *weights), [], arcs.count()
    while n > walked:
        seed = len(left)
        own, before, after = (F.xxhash64(F.lit(seed), c) for c in ("arc", "prev", "next"))
        goes = F.col("prev").isNotNull() & (own < before) & (F.col("next").isNull() | (own < after))
        rest = scratch(rest.withColumn("goes", goes), "list")
        gone = rest.where("goes")
        left.append(gone)
        none = F.lit(None).cast("string")
        zero = [F.lit(0).cast("long").alias(w) for w in weights]
        told = (
            rest.where("NOT goes")
            .select("arc", "prev", "next", none.alias("now_prev"), none.alias("now_next"), *weights)
            .union(gone.where("next IS NOT NULL").select("next", none, none, "prev", none, *weights))
            .union(gone.where("next IS NOT NULL").select("prev", none, none, none, "next", *zero))
            # the end of the list has left: its neighbour is the end now
            .union(gone.where("next IS NULL").select("prev", none, none, none, F.lit(""), *zero))
        )
        merged = told.groupBy("arc").agg(*(F.max(c).alias(c) for c in ("prev", "next", "now_prev", "now_next")), *(F.sum(w).alias(w) for w in weights))
        rest = scratch(
            merged.select("arc", F.coalesce("now_prev", "prev").alias("prev"), F.nullif(F.coalesce("now_next", "next"), F.lit("")).alias("next"), *weights),
            "list",
        )
        n = rest.count()
    known = scratch(_walked(rest, weights), "sums")
    for gone in reversed(left):
        before = known.select(F.col("arc").alias("prev"), *(F.col(w).alias(f"before_{w}") for w in weights))
        back = gone.join(before, "prev").select("arc", *((F.col(w) + F.col(f"before_{w}")).alias(w) for w in weights))
        known = scratch(known.union(back), "sums")
    return known
