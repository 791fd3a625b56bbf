"""Plans that assign evidence to the parts of a series: normalised, checked, signed and replaced under a version check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A plan has so many parts, and an id so many bridges, at most.
PARTS, BRIDGES = 5, 2


def cleaned(proposed: DataFrame, known: DataFrame, order: list[str]) -> DataFrame:
    """series, id, position, role: complete and unique primary assignments, and bridges within bounds.

    proposed: series, id, position, role (primary or bridge) and the columns of order; known: id. Unknown ids go, positions are clamped to 1 to PARTS; of several primary
    places the first counts; an id bridges at most BRIDGES parts, the earliest, and never its own.
    """
    rows = proposed.join(known.select("id"), "id", "left_semi").withColumn("position", F.greatest(F.lit(1), F.least(F.lit(PARTS), F.col("position"))))
    primary = rows.where("role = 'primary'").groupBy("series", "id").agg(F.min_by("position", F.struct("position", *order)).alias("position"))
    bridges = rows.where("role = 'bridge'").select("series", "id", "position").distinct().join(primary, ["series", "id", "position"], "left_anti")
    w = Window.partitionBy("series", "id").orderBy("position")
    bridges = bridges.withColumn("n", F.row_number().over(w)).where(F.col("n") <= BRIDGES).drop("n")
    return primary.withColumn("role", F.lit("primary")).unionByName(bridges.withColumn("role", F.lit("bridge")))


def omissions(offered: DataFrame, known: DataFrame, assigned: DataFrame) -> DataFrame:
    """series, id, reason of offered omissions that have a reason and whose id is known, supporting and not assigned; the first reason counts."""
    fit = known.where("importance = 'supporting'").select("id")
    rows = offered.where("trim(coalesce(reason, '')) <> ''").join(fit, "id", "left_semi").join(assigned.select("series", "id"), ["series", "id"], "left_anti")
    return rows.groupBy("series", "id").agg(F.min("reason").alias("reason"))


def violations(plan: DataFrame, known: DataFrame) -> DataFrame:
    """series and how it breaks the rules: parts, gaps in positions, unknown ids, ids with several primary places, ids with too many bridges."""
    ids = known.select("id", F.lit(1).alias("known"))
    each = plan.join(ids, "id", "left").groupBy("series", "id").agg(F.max("known").alias("known"), F.count_if(F.col("role") == "primary").alias("primary"), F.count_if(F.col("role") == "bridge").alias("bridges"))
    of_ids = each.groupBy("series").agg(F.count_if(F.col("known").isNull()).alias("unknown"), F.count_if(F.col("primary") > 1).alias("doubled"), F.count_if(F.col("bridges") > BRIDGES).alias("overbridged"))
    places = plan.groupBy("series").agg(F.max("position").alias("parts"), F.countDistinct("position").alias("used"), F.min("position").alias("first"))
    gaps = (F.col("first") != 1) | (F.col("parts") != F.col("used"))
    return places.join(of_ids, "series").select("series", "parts", gaps.alias("gaps"), "unknown", "doubled", "overbridged")


def signatures(plan: DataFrame) -> DataFrame:
    """series, position, signature: a digest of a part's sorted assignments."""
    rows = F.array_sort(F.collect_list(F.struct("id", "role")))
    spelled = F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["id"].cast("string"), x["role"])), ",")
    return plan.groupBy("series", "position").agg(F.sha2(spelled, 256).alias("signature"))


def gate(plan: DataFrame, required: DataFrame, topics: DataFrame, poor: DataFrame) -> DataFrame:
    """series, missing, empty, gaps, approved: critical ids that a plan leaves out, parts without a primary id, and topics that rest on poor ids alone."""
    has = plan.select("series", "id").distinct()
    series = plan.select("series").distinct()
    missing = required.select("series", "id").distinct().join(has, ["series", "id"], "left_anti").groupBy("series").agg(F.count("*").alias("missing"))
    parts = plan.groupBy("series", "position").agg(F.count_if(F.col("role") == "primary").alias("n")).groupBy("series").agg(F.count_if(F.col("n") == 0).alias("empty"))
    weak = topics.join(poor.select("id", F.lit(1).alias("poor")), "id", "left").groupBy("series", "topic").agg(F.bool_and(F.col("poor").isNotNull()).alias("weak"))
    weak = weak.groupBy("series").agg(F.count_if("weak").alias("gaps"))
    out = series.join(missing, "series", "left").join(parts, "series", "left").join(weak, "series", "left").fillna(0, ["missing", "empty", "gaps"])
    return out.withColumn("approved", (F.col("missing") == 0) & (F.col("empty") == 0) & (F.col("gaps") == 0))


def replaced(saved: DataFrame, offered: DataFrame, force: Column) -> DataFrame:
    """series, version, body: an offer replaces a saved plan if its expected version is the saved one and the plan is empty or forced; a series without a plan takes it."""
    new = offered.select("series", F.col("expected").alias("__expected"), F.col("body").alias("__body"), force.alias("__force"))
    rows = saved.join(new, "series", "full_outer")
    first = F.col("version").isNull()
    takes = first | ((F.col("version") == F.col("__expected")) & (F.col("__force") | (F.coalesce("body", F.lit("")) == "")))
    takes = F.coalesce(takes & F.col("__body").isNotNull(), F.lit(False))
    return rows.select("series", F.when(takes, F.coalesce(F.col("version") + 1, F.lit(1))).otherwise(F.col("version")).alias("version"), F.when(takes, F.col("__body")).otherwise(F.col("body")).alias("body"))
