"""Records: defaults and overrides, versions, identities, unique names, cumulative state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slug


def unique_ids(nodes: DataFrame, label: str, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """nodes with id: the label's slug, with a number from the second node of that slug on."""
    w = Window.partitionBy(*(by or []), "__slug").orderBy(*order)
    rows = nodes.withColumn("__slug", slug(F.col(label))).withColumn("__n", F.row_number().over(w))
    return rows.withColumn("id", F.when(F.col("__n") == 1, F.col("__slug")).otherwise(F.concat_ws("-", "__slug", "__n"))).drop("__slug", "__n")


def item_id(field: Column, text: Column, ids: Column) -> Column:
    """A stable id of a field, a text and a set of ids."""
    return F.concat(F.lit("I-"), F.substring(F.sha2(F.concat_ws("\x1f", field, text, F.array_join(F.array_sort(F.array_distinct(ids)), ",")), 256), 1, 20))


def cumulative(events: DataFrame, by: list[str], order: list[str], value: str, most: int) -> DataFrame:
    """events with state: the first `most` different values so far, in order of first appearance.

    A group is reduced to its first `most` values and when they first came, which a row then cuts at its own time.
    """
    first = events.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.min(F.struct(*order)).alias("__first"))
    ranked = first.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy("__first", value))).where(F.col("__n") <= most)
    lists = ranked.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__first", F.col(value).alias("__value")))).alias("__list"))
    so_far = F.filter("__list", lambda x: x["__first"] <= F.struct(*order))
    return events.join(lists, by, "left").withColumn("state", F.coalesce(F.transform(so_far, lambda x: x["__value"]), F.array())).drop("__list")


def as_of(times: DataFrame, versions: DataFrame, key: str, at: str, stamp: str, value: str) -> DataFrame:
    """key, at, value: of each time the newest version not after it; null if there is none.

    Times and versions are put in one order by key, and the last version is carried forward: one shuffle, no pairs.
    """
    kind = versions.schema[value].dataType
    a = times.select(key, F.col(at).alias("__t"), F.lit(1).alias("__asks"), F.lit(None).cast(kind).alias("__v"))
    b = versions.select(key, F.col(stamp).alias("__t"), F.lit(0).alias("__asks"), F.col(value).alias("__v"))
    w = Window.partitionBy(key).orderBy("__t", "__asks", "__v").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("__v", F.last("__v", ignorenulls=True).over(w))
    return both.where("__asks = 1").select(key, F.col("__t").alias(at), F.col("__v").alias(value))


def finite(x: Column) -> Column:
    """The number, or null for NaN and infinities."""
    return F.when(~(F.isnan(x) | (F.abs(x) == float("inf"))), x)


def queue(jobs: DataFrame, active: Column, updated: str, key: str, newest: int = 25) -> DataFrame:
    """key, part: all active jobs, and the newest of the others (the limit is what the report shows)."""
    ended = jobs.where(~active).orderBy(F.desc(updated), F.desc(key)).limit(newest)
    return jobs.where(active).select(key, F.lit("active").alias("part")).unionByName(ended.select(key, F.lit("ended").alias("part")))
