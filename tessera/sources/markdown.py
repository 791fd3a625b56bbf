"""Markdown documents with front matter, as files and as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FRONT = r"(?s)^---\n(.*?)\n---\n(.*)$"


def library(spark: SparkSession, root: str) -> DataFrame:
    """path, content of every .md file below root that isn't in a .history or .trash folder."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return rows.where(~F.col("path").rlike(r"/\.(history|trash)/"))


def parsed(df: DataFrame, content: str) -> DataFrame:
    """df with meta (map of the front matter's 'key: value' lines) and body; without front matter the map is empty and the body is all."""
    text = F.col(content)
    front = F.regexp_extract(text, _FRONT, 1)
    lines = F.filter(F.split(front, "\n"), lambda x: x.rlike(r"^[A-Za-z_][A-Za-z0-9_]*:"))
    entries = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^([^:]+):", 1).alias("key"), F.trim(F.regexp_extract(x, r"^[^:]+:(.*)$", 1)).alias("value")))
    return df.withColumn("meta", F.map_from_entries(entries)).withColumn("body", F.when(text.rlike(_FRONT), F.regexp_extract(text, _FRONT, 2)).otherwise(text))


def assembled(meta: dict[str, Column], body: Column) -> Column:
    """Front matter of the values that aren't null, then the body."""
    lines = F.array_compact(F.array(*(F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v.cast("string"))) for k, v in meta.items())))
    return F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n"), body)


def locator_root(path: Column) -> Column:
    """Which root a locator is relative to."""
    return F.when(path.startswith("media:"), "media").otherwise("library")
