"""Connected components of a graph as a Spark job: least labels with pointer jumping, cut by tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch


def components(edges: DataFrame) -> DataFrame:
    """node, label of each node of edges (u, v): the label is the least node of its component. Repeated edges and loops do no harm."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u IS NOT NULL AND v IS NOT NULL").distinct()
    both = scratch(both, "edges")
    labels = scratch(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least")).select("node", F.least("node", "least").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("least"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "least").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("to"))
        moved = scratch(lower.join(jump, "via").select("node", "was", F.least("via", "to").alias("label")), "labels")
        labels = moved.select("node", "label")
        if moved.where("label <> was").isEmpty():
            return labels
