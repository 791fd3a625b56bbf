"""Intervals: complements, merges, and points in ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def complement(spans: DataFrame, by: str, total: str = "total", least: float = 0.2) -> DataFrame:
    """by, start, end of what the spans of each group leave of [0, total]; pieces of `least` or less are dropped.

    spans: by, start, end, total. Spans that end before they begin are left out, the others clipped.
    """
    own = spans.where("start < end").withColumn("start", F.greatest("start", F.lit(0.0))).withColumn("end", F.least("end", total)).where("start < end")
    ahead = Window.partitionBy(by).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    gaps = own.select(by, F.coalesce(F.max("end").over(ahead), F.lit(0.0)).alias("from"), F.col("start").alias("to"))
    ends = own.groupBy(by).agg(F.max("end").alias("last"))
    tails = spans.groupBy(by).agg(F.max(total).alias("to")).join(ends, by, "left").select(by, F.coalesce("last", F.lit(0.0)).alias("from"), "to")
    return gaps.unionByName(tails).where(F.col("to") - F.col("from") > least).select(by, F.col("from").alias("start"), F.col("to").alias("end"))


def containing(points: DataFrame, ranges: DataFrame, by: str, at: str, width: int) -> DataFrame:
    """Points with the ranges (low, high, at most `width` wide) of the same group that hold them: an equi-join on cells of that width."""
    cells = ranges.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))))
    own = points.withColumn("__cell", F.floor(F.col(at) / width))
    return own.join(cells, [by, "__cell"]).where(F.col(at).between(F.col("low"), F.col("high"))).drop("__cell")
