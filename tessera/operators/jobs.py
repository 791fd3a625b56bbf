"""Job logs: latest states, progress, queues, leases, staleness and dependency closure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Which status of several a project shows.
PRECEDENCE = ["running", "canceled", "failed", "complete", "partial", "new"]


def latest(events: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """by, columns of the last row of each group; a hash aggregation, without sorting groups."""
    last = F.max_by(F.struct(*columns), F.struct(*order))
    return events.groupBy(*by).agg(last.alias("last")).select(*by, *(F.col("last")[c].alias(c) for c in columns))


def usage(calls: DataFrame, by: list[str], order: list[Column], newest: int, failed: Column, amount: Column) -> DataFrame:
    """by, calls, errors, amount over the newest calls only: the limit comes before the grouping."""
    recent = calls.orderBy(*order).limit(max(1, min(5000, newest)))
    return recent.groupBy(*by).agg(F.count("*").alias("calls"), F.count_if(failed).alias("errors"), F.sum(amount).alias("amount"))


def carried(events: DataFrame, by: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """events with the last value that isn't null so far, within each group."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn(name, F.last(value, ignorenulls=True).over(w))


def changed(events: DataFrame, by: list[str], order: list[Column], value: str) -> DataFrame:
    """Rows whose value differs from the row before in their group, the first included."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = events.withColumn("__was", F.lag(value).over(w)).withColumn("__n", F.row_number().over(w))
    return rows.where(~F.col("__was").eqNullSafe(F.col(value)) | (F.col("__n") == 1)).drop("__was", "__n")


#: Rounds of a closure whose tables are read apart, until they become one.
ROUNDS = 8


def closure(edges: DataFrame, seeds: DataFrame, include: bool) -> DataFrame:
    """node: what is reachable from the seeds along edges (src, dst), with or without the seeds.

    Each round joins the newest nodes alone with the edges and keeps those not reached yet, so that it ends on cycles too, after as many rounds as
    the longest of the shortest paths has steps.
    """
    edges = edges.select("src", "dst")
    reached = newest = written(seeds.select("node", F.lit(True).alias("seed")).distinct(), "reached")
    parts = 1
    while True:
        next_ = newest.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        newest = written(next_.join(reached, "node", "left_anti").withColumn("seed", F.lit(False)), "newest")
        if newest.isEmpty():
            return (reached if include else reached.where("NOT seed")).select("node")
        reached, parts = reached.unionByName(newest), parts + 1
        if parts == ROUNDS:  # a plan reads a bounded number of tables, however many rounds there are
            reached, parts = written(reached, "reached"), 1


def transitions(jobs: DataFrame, wanted: DataFrame, allowed: dict[str, list[str]], key: str = "id") -> DataFrame:
    """jobs with status and moved: compare and set. wanted: key, expected, target; a job moves if its status is the expected one and may become the target."""
    legal = F.lit(False)
    for state, targets in allowed.items():
        legal = legal | ((F.col("status") == state) & F.col("target").isin(targets))
    joined = jobs.join(wanted, key, "left").withColumn("moved", F.coalesce((F.col("status") == F.col("expected")) & legal, F.lit(False)))
    return joined.withColumn("status", F.when(F.col("moved"), F.col("target")).otherwise(F.col("status"))).drop("expected", "target")


def scheduled(steps: DataFrame, edges: DataFrame, failing: DataFrame, most_rounds: int) -> DataFrame:
    """step, state, round: a run of the step graph in rounds. In each, what is ready runs and is done, or fails if it is among failing; what needs a failed
    step fails in the next round with it. edges: (step, needs). Steps that nothing allows to run stay pending.
    """
    failing = failing.select(F.col("step").alias("fails"))
    now = written(steps.select("step", "state", F.lit(0).alias("round")), "steps")
    for k in range(1, most_rounds + 1):
        states = ready(now, edges).withColumnRenamed("state", "turn").where("turn <> 'waiting'")
        if states.isEmpty():
            break
        moved = now.join(states, "step", "left").join(failing, F.col("step") == F.col("fails"), "left")
        state = F.when(F.col("turn") == "blocked", "failed").when((F.col("turn") == "ready") & F.col("fails").isNotNull(), "failed").when(F.col("turn") == "ready", "done").otherwise(F.col("state"))
        now = written(moved.select("step", state.alias("state"), F.when(F.col("turn").isNotNull(), k).otherwise(F.col("round")).alias("round")), "steps")
    return now


def ready(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """step, state of pending steps: 'ready' if all they need is done, 'blocked' if something failed, else 'waiting'; edges: (step, needs)."""
    needs = edges.join(steps.select(F.col("step").alias("needs"), F.col("state").alias("needed")), "needs", "left")
    each = needs.groupBy("step").agg(F.bool_or(F.col("needed") == "failed").alias("failed"), F.bool_and(F.coalesce(F.col("needed") == "done", F.lit(True))).alias("done"))
    pending = steps.where("state = 'pending'").select("step").join(each, "step", "left")
    return pending.select("step", F.when(F.col("failed"), "blocked").when(F.coalesce("done", F.lit(True)), "ready").otherwise("waiting").alias("state"))


def claims(jobs: DataFrame, by: list[str], order: list[str], key: str) -> DataFrame:
    """by, key of the oldest queued job of each group in which none is running."""
    own = jobs.groupBy(*by).agg(F.count_if(F.col("status") == "running").alias("running"), F.min_by(F.when(F.col("status") == "queued", F.col(key)), F.when(F.col("status") == "queued", F.struct(*order))).alias(key))
    return own.where((F.col("running") == 0) & F.col(key).isNotNull()).select(*by, key)
