"""Job logs as streams: current states, counts by event time, and a fence against late results."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

from ..sources.shared import place


def stream(spark: SparkSession, path: str, schema: StructType, most_files: int = 8) -> DataFrame:
    """Rows of Parquet files as they arrive, so many files at once, with ts as an instant."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def current_states(events: DataFrame) -> DataFrame:
    """user_id, event_type, n: the last event of each project so far, and how many there were."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.count("*").alias("n"))


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """start, event_type, n by hour of event time; rows later than the watermark are left out."""
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), "event_type", "n")


def sampled(events: DataFrame, value: str, every: str = "2 seconds") -> DataFrame:
    """start, n, peak of each interval of event time."""
    counts = events.groupBy(F.window("ts", every)).agg(F.count("*").alias("n"), F.max(value).alias("peak"))
    return counts.select(F.col("window.start").alias("start"), "n", "peak")


def fenced(results: DataFrame, running: DataFrame) -> DataFrame:
    """Results of jobs that still run; results of others are rejected."""
    return results.join(running.select("user_id"), "user_id", "left_semi")


def drained(rows: DataFrame, mode: str) -> DataFrame:
    """What a stream gives once all that is there now has been read: its last complete rows, or all that it appended or updated.

    Batches are written to the shared folder, with the stream's checkpoint beside them; nothing passes through the driver.
    """
    spark, path = rows.sparkSession, place(rows.sparkSession, "drained")
    last = [-1]

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        last[0] = max(last[0], number)

    run = rows.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}-checkpoint").outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination()
    if last[0] < 0:
        return spark.createDataFrame([], rows.schema)
    return spark.read.schema(rows.schema).parquet(f"{path}/batch={last[0]}" if mode == "complete" else f"{path}/batch=*")


def fixed_states(events: DataFrame, terminal: list[str]) -> DataFrame:
    """user_id, status, rejected: a project's state never leaves a terminal one; later events are counted as rejected.

    One small state a project (its status, and the count); events of one batch are taken in the order of their time.
    """

    def advance(key, frames, state):
        status, rejected = state.get if state.exists else ("", 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for event in rows.event_type:
            if status in terminal:
                rejected += 1
            else:
                status = event
        state.update((status, rejected))
        yield pd.DataFrame({"user_id": [key[0]], "status": [status], "rejected": [rejected]})

    out = "user_id long, status string, rejected long"
    return events.groupBy("user_id").applyInPandasWithState(advance, out, "status string, rejected long", "update", GroupStateTimeout.NoTimeout)
