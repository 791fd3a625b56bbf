"""Orphans, duplicates, differences and conservation checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphans(checks: list[tuple[str, DataFrame, str, str, DataFrame, str]]) -> DataFrame:
    """kind, id of child rows whose parent is missing; checks: (kind, child, its id, its reference, parent, parent's id)."""
    found = []
    for kind, child, own, ref, parent, key in checks:
        keys = parent.select(F.col(key).alias("__key"))
        lost = child.where(F.col(ref).isNotNull()).join(keys, F.col(ref) == F.col("__key"), "left_anti")
        found.append(lost.select(F.lit(kind).alias("kind"), F.col(own).cast("string").alias("id")))
    return reduce(DataFrame.unionByName, found)


def repeated(df: DataFrame, by: list[str]) -> DataFrame:
    """by, n of values that occur more than once."""
    return df.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")


def differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, side of keys that only one side has."""
    a = left.select(key).distinct().withColumn("l", F.lit(1))
    b = right.select(key).distinct().withColumn("r", F.lit(1))
    both = a.join(b, key, "full_outer")
    return both.where("l IS NULL OR r IS NULL").select(key, F.when(F.col("r").isNull(), "left").otherwise("right").alias("side"))


def covered_once(assigned: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """key, n of known keys that aren't assigned exactly once."""
    n = assigned.groupBy(key).agg(F.count("*").alias("n"))
    return known.select(key).distinct().join(n, key, "left").fillna(0, ["n"]).where("n <> 1")
