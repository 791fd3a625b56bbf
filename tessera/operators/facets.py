"""Faceted filtering, counting and paging over a collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flags(labels: DataFrame, columns: list[str], key: str = "doc_id") -> DataFrame:
    """key, tag: the names of the columns that are set."""
    names = F.array(*(F.when(F.col(c) == 1, F.lit(c)) for c in columns))
    return labels.select(key, F.explode(F.array_compact(names)).alias("tag"))


def filtered(docs: DataFrame, links: DataFrame, title: Column, contains: str | None = None, types: tuple[str, ...] = (), sources: tuple[str, ...] = (), any_tag: tuple[str, ...] = (), key: str = "doc_id") -> DataFrame:
    """Rows that meet every condition given; any_tag keeps a row once, however many of the tags it has."""
    out = docs
    if contains:
        escaped = contains.lower()
        out = out.where(F.lower(title).like(f"%{escaped}%"))
    if types:
        out = out.where(F.col("lang").isin(*types))
    if sources:
        out = out.where(F.col("source").isin(*sources))
    if any_tag:
        out = out.join(links.where(F.col("tag").isin(*any_tag)), key, "left_semi")
    return out


def counts(docs: DataFrame, links: DataFrame, facets: list[str], key: str = "doc_id") -> DataFrame:
    """facet, value, n over the whole filtered set, in one aggregation by grouping sets, and over its tags."""
    which = F.coalesce(*(F.when(F.grouping(f) == 0, F.lit(f)) for f in facets))
    value = F.coalesce(*(F.when(F.grouping(f) == 0, F.col(f)) for f in facets))
    by = docs.groupingSets([[f] for f in facets], *facets).agg(F.count("*").alias("n"), which.alias("facet"), value.alias("value"))
    tags = links.join(docs.select(key), key, "left_semi").groupBy("tag").agg(F.count("*").alias("n"))
    return by.select("facet", "value", "n").unionByName(tags.select(F.lit("tag").alias("facet"), F.col("tag").alias("value"), "n"))


def paged(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page in the order given: offset at least 0, limit 1 to 100."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(1, min(100, limit)))
