"""Caption cues and dialogue scripts as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CUE = r"^(\d{2}:\d{2}:\d{2})\.\d{3} -->"


def numbered(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_number from 1, line."""
    return df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("n", "line")).select(key, (F.col("n") + 1).alias("line_number"), "line")


def cue_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_number, line as '[HH:MM:SS] text': tags and headers removed, the cue's time carried on, repeats of the line before dropped."""
    rows = numbered(df, key, text)
    w = Window.partitionBy(key).orderBy("line_number")
    cue = F.regexp_extract("line", _CUE, 1)
    rows = rows.withColumn("time", F.last(F.when(cue != "", cue), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    said = F.trim(F.regexp_replace("line", r"<[^>]+>", ""))
    rows = rows.withColumn("said", said).where((cue == "") & (F.col("said") != "") & F.col("time").isNotNull() & ~F.col("said").rlike(r"^(WEBVTT|NOTE|STYLE|\d+$)"))
    rows = rows.withColumn("was", F.lag("said").over(w)).where(~F.col("was").eqNullSafe(F.col("said")))
    return rows.select(key, "line_number", F.concat(F.lit("["), "time", F.lit("] "), "said").alias("line"))


def speaker_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_number, speaker, said of lines 'NAME: words'."""
    rows = numbered(df, key, text)
    pattern = r"^\s*\**([A-Z][A-Za-z0-9 ]{0,30})\**:\s*(.+)$"
    return rows.where(F.col("line").rlike(pattern)).select(key, "line_number", F.regexp_extract("line", pattern, 1).alias("speaker"), F.regexp_extract("line", pattern, 2).alias("said"))


def line_range(df: DataFrame, key: str, text: str, low: Column, high: Column) -> DataFrame:
    """Lines low to high (from 1, inclusive) of each text."""
    lines = F.split(F.col(text), "\n")
    return df.select(key, F.array_join(F.slice(lines, F.greatest(low, F.lit(1)), F.greatest(F.lit(0), high - F.greatest(low, F.lit(1)) + 1)), "\n").alias("body"))
