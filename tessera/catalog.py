"""The registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .queries import activity, contracts, evidence, files, indexes, journeys, library, maintenance, pipelines, planning, records, reports, retrieval, scan, shapes, streams, tables, texts, views  # noqa: F401  each registers its queries
from .queries.registry import QUERIES, SQL

FLAGSHIP = "ranked_search"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
