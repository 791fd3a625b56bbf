"""Coverage of evidence by plans: what is mapped, assigned, omitted, or missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def percentages(rows: DataFrame, by: list[str], covered: str, critical: str) -> DataFrame:
    """by, total, covered, critical, percent: critical rows covered, of all critical rows; 100 if there are none."""
    held = F.count_if(F.col(critical) & F.col(covered))
    n = F.count_if(F.col(critical))
    return rows.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.col(covered)).alias("covered"), n.alias("critical"), F.when(n == 0, 100).otherwise(F.round(100.0 * held / n)).cast("long").alias("percent"))


def backfilled(evidence: DataFrame, key: str, place: str, assigned: DataFrame, parts: int) -> DataFrame:
    """key, part of evidence that no part holds yet: min(parts - 1, place * parts div total)."""
    total = evidence.agg(F.count("*").alias("total"))
    free = evidence.join(assigned.select(key), key, "left_anti").crossJoin(F.broadcast(total))
    return free.select(key, F.least(F.lit(parts - 1), F.floor(F.col(place) * parts / F.col("total"))).cast("long").alias("part"))


def missing(required: DataFrame, assigned: DataFrame, demoted: DataFrame, key: str) -> DataFrame:
    """Required keys that are neither assigned nor demoted."""
    return required.select(key).join(assigned.select(key), key, "left_anti").join(demoted.select(key), key, "left_anti").distinct()
