"""Upserts, replacement by key, cascading deletes and schema evolution, as whole-table rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upserted(existing: DataFrame, incoming: DataFrame, keys: list[str], sticky: list[str]) -> DataFrame:
    """existing with incoming's values where keys agree; flags in `sticky`, once set, stay set; new keys are added.

    Both have the same columns and unique keys. A null in incoming keeps the old value.
    """
    values = [c for c in existing.columns if c not in keys]
    old = existing.select(*keys, *(F.col(c).alias(f"__{c}") for c in values))
    both = old.join(incoming, keys, "full_outer")
    merged = [(F.coalesce(F.col(c), F.lit(False)) | F.coalesce(F.col(f"__{c}"), F.lit(False)) if c in sticky else F.coalesce(F.col(c), F.col(f"__{c}"))).alias(c) for c in values]
    return both.select(*keys, *merged)


def replaced(rows: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """All rows of a key that occurs in fresh give way to fresh's rows."""
    return rows.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def without(rows: DataFrame, gone: DataFrame, key: str, reference: str | None = None) -> DataFrame:
    """Rows whose reference isn't among the deleted keys."""
    keys = gone.select(F.col(key).alias("__gone")).distinct()
    return rows.join(keys, F.col(reference or key) == F.col("__gone"), "left_anti")


def cascade(tables: dict[str, DataFrame], links: list[tuple[str, str, str, str]], roots: tuple[str, str, DataFrame], fences: list[tuple[str, str, str]]) -> dict[str, DataFrame]:
    """name -> key columns to delete, of a root's rows and all that refers to them, unless a fence holds the root back.

    links: (child, its reference, parent, the parent's key), in dependency order, along any number of paths. roots: (name, key, rows of keys wanted). fences: (reason, name, reference): rows
    of these tables (live leases, running jobs, transitions) that refer to a root refuse its deletion. The entry 'refused' has key and reason of those roots.
    """
    name, key, wanted = roots
    wanted = wanted.select(key).distinct()
    held = [tables[table].select(F.col(reference).alias(key), F.lit(reason).alias("reason")) for reason, table, reference in fences]
    refused = None
    for h in held:
        own = wanted.join(h, key).groupBy(key).agg(F.min("reason").alias("reason"))
        refused = own if refused is None else refused.unionByName(own)
    gone = {name: wanted if refused is None else wanted.join(refused, key, "left_anti")}
    for child, reference, parent, parent_key in links:
        hit = tables[child].join(gone[parent].select(F.col(parent_key).alias(reference)).distinct(), reference, "left_semi")
        gone[child] = hit if child not in gone else gone[child].unionByName(hit).distinct()
    return gone | ({"refused": refused} if refused is not None else {})


def inserted_if_absent(cache: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """cache, and fresh's rows of keys that it lacks; a row that is there stays as it is."""
    return cache.unionByName(fresh.join(cache.select(*keys), keys, "left_anti"))


def evolved(rows: DataFrame, defaults: dict) -> DataFrame:
    """rows with each column of `defaults` added if it is missing, and its nulls filled."""
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in rows.columns else F.lit(v) for c, v in defaults.items()})
