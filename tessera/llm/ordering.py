"""Places of rows in the order of their group, and groups' sizes and best rows beside each row, whatever share of all rows a group has."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, shuffle_partitions


def positions(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """df with `position`: 1, 2, ... within the rows of a group, in order, nulls first; rows equal in all these columns in any order.

    Rows are dealt over partitions by ranges of (group, order), so that a large group spans many. They are
    numbered within a partition; a group that comes from earlier partitions goes on after its rows there. At most one
    group comes into a partition from the one before, so there are fewer such offsets than partitions, and they are broadcast.
    df has no columns named tie, part, place, before or position. name: of the scratch table.
    """
    spark = df.sparkSession
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order)] + [F.col("tie")]
    dealt = df.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(shuffle_partitions(spark), *keys)
    dealt = scratch(dealt.withColumn("part", F.spark_partition_id()), name)
    numbered = dealt.withColumn("place", F.row_number().over(Window.partitionBy("part", *group).orderBy(*keys[len(group) :])))
    counts = dealt.groupBy("part", *group).agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("before", earlier).where("before > 0").select(F.col("part").alias("of_part"), *(F.col(c).alias(f"of_{c}") for c in group), "before")
    same = F.col("part") == F.col("of_part")
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"of_{c}"))
    placed = numbered.join(F.broadcast(offsets), same, "left")
    return placed.select(*df.columns, (F.col("place") + F.coalesce("before", F.lit(0))).alias("position"))


def with_group(df: DataFrame, group: list[str], best: list[str], name: str) -> DataFrame:
    """df with `group_size` and `best` (the largest struct of the columns named) of each row's group; nulls are equal to each other.

    Rows are dealt by ranges of the group's hash, so that a group spans partitions if it is large; each
    partition knows its own part of it. Groups that go on from one partition into the next are summed up: fewer than partitions, but for those that share a
    hash with one, and broadcast. No task has more than a partition of a group.
    df has no columns named hash, tie, part, own_size, own_best, group_size or best. name: of the scratch table.
    """
    top = F.struct(*best)
    hashed = df.withColumn("hash", F.xxhash64(*group)).withColumn("tie", F.monotonically_increasing_id())
    dealt = hashed.repartitionByRange(shuffle_partitions(df.sparkSession), "hash", *group, "tie").withColumn("part", F.spark_partition_id())
    dealt = scratch(dealt.drop("tie"), name)
    inside = Window.partitionBy("part", "hash", *group)
    told = dealt.withColumns({"own_size": F.count("*").over(inside), "own_best": F.max(top).over(inside)})
    ends = dealt.groupBy("part").agg(F.min("hash").alias("low"), F.max("hash").alias("high"))
    edges = ends.select(F.explode(F.array("low", "high")).alias("hash")).groupBy("hash").count().where("count > 1").select("hash")
    crossing = dealt.join(F.broadcast(edges), "hash", "left_semi").groupBy("part", *group).agg(F.count("*").alias("n"), F.max(top).alias("top"))
    whole = crossing.groupBy(*group).agg(F.sum("n").alias("group_size"), F.max("top").alias("best"), F.count("*").alias("parts")).where("parts > 1")
    whole = whole.select(*(F.col(c).alias(f"of_{c}") for c in group), "group_size", "best")
    same = F.lit(True)
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"of_{c}"))
    joined = told.join(F.broadcast(whole), same, "left")
    return joined.select(*df.columns, F.coalesce("group_size", "own_size").alias("group_size"), F.coalesce("best", "own_best").alias("best"))
