"""Streams with keyed state that outlives a batch: leases with timers, a fence against late results, snapshots that are sent when they change."""

from __future__ import annotations

import contextlib
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: A lease's minutes if none are given; terminal jobs that a snapshot shows; batches without a change after which it is sent nevertheless.
MINUTES, NEWEST, IDLE = 240, 25, 15
#: Groups that objects are dealt to, whose leases are kept together; that of events without an object.
SHARES, _NAMELESS = 1024, -1
#: Before all times.
_BEFORE = np.iinfo(np.int64).min


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that are started within have the state store that timers need."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class Leases(StatefulProcessor):
    """Of a share of the objects: their owners' leases, as one value that is read and written once a batch, and a timer for the first end. Ends are told when event time has passed them, whether or not the object has another event."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "objects array<long>, owners array<string>, ends array<long>, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        objects, owners, ends, timer = self._live()
        new = pd.concat(list(rows))
        acquires = new["acquires"].to_numpy(bool)
        # A lease that was there before stands first among its owner's rows, as an event that isn't told.
        objects, owners = np.r_[objects, new["object_id"].to_numpy(np.int64)], np.r_[owners, new["owner"].to_numpy(object)]
        ms = np.r_[np.full(len(ends), _BEFORE), new["ms"].to_numpy(np.int64)]
        minutes, release = (np.r_[np.zeros(len(ends), int), x] for x in (new["minutes"].to_numpy(np.int64), ~acquires))
        ends = np.r_[ends, np.where(acquires, new["ms"] + new["minutes"] * 60_000, _BEFORE)]
        owner = pd.factorize(owners)[0]
        order = np.lexsort((minutes, release, ms, owner, objects))
        objects, owners, owner, ms, ends, release = (x[order] for x in (objects, owners, owner, ms, ends, release))
        last = np.r_[(objects[1:] != objects[:-1]) | (owner[1:] != owner[:-1]), True]
        held = np.r_[False, ~last[:-1] & (ends[:-1] > ms[1:])]
        told = (ms != _BEFORE) & (held | (release == 0))
        over = (ends != _BEFORE) & np.r_[~last[:-1] & (ends[:-1] <= ms[1:]), False]
        state = np.where(release == 1, "released", np.where(held, "renewed", "granted"))
        parts = [(objects[over], owners[over], np.full(over.sum(), "expired"), ends[over]), (objects[told], owners[told], state[told], ms[told])]
        live = last & (ends != _BEFORE)
        self._keep(objects[live], owners[live], ends[live], timer)
        yield self._frame(key, *map(np.concatenate, zip(*parts, strict=True)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        objects, owners, ends, _ = self._live()
        over = ends < timerValues.getCurrentWatermarkInMs()
        self._keep(objects[~over], owners[~over], ends[~over], None)  # Spark takes away the timer that has fired
        yield self._frame(key, objects[over], owners[over], np.full(over.sum(), "expired"), ends[over])

    def _live(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int | None]:
        objects, owners, ends, timer = self.state.get() or ([], [], [], None)
        return np.array(objects, np.int64), np.array(owners, object), np.array(ends, np.int64), timer

    def _keep(self, objects: np.ndarray, owners: np.ndarray, ends: np.ndarray, timer: int | None) -> None:
        first = int(ends.min()) if len(ends) else None
        if first != timer and timer is not None:
            self.handle.deleteTimer(timer)
        if first != timer and first is not None:
            self.handle.registerTimer(first)
        if first is None:
            self.state.clear()
        else:
            self.state.update((objects.tolist(), owners.tolist(), ends.tolist(), first))

    def _frame(self, key, objects: np.ndarray, owners: np.ndarray, states: np.ndarray, ms: np.ndarray) -> pd.DataFrame:
        order = np.lexsort((ms, objects))
        return pd.DataFrame({"object_id": objects[order] if key[0] != _NAMELESS else None, "owner": owners[order], "state": states[order], "ms": ms[order]})

    def close(self) -> None:
        pass


def leases(events: DataFrame, late: str = "0 seconds", shares: int = SHARES) -> DataFrame:
    """object_id, owner, state (granted, renewed, released, expired), ms of a stream of (object_id, owner, action, minutes, ts).

    action: acquire (for `minutes`, 240 if null, 1 at least) or release. Of one millisecond's events, those that acquire come first, shorter leases before longer ones. A lease ends when event time, less `late`, has passed its end: by a
    timer, so that no further event of its object is needed. Objects are dealt to `shares`, whose live leases are one value of state each and have one timer: calls of Python and of the state grow with
    shares and batches, not with objects or events. A stream that goes on from a checkpoint keeps its number of shares.
    """
    share = F.when(F.col("object_id").isNull(), _NAMELESS).otherwise(F.pmod(F.xxhash64("object_id"), F.lit(shares))).cast("int").alias("share")
    minutes = F.greatest(F.lit(1), F.coalesce("minutes", F.lit(MINUTES))).cast("long").alias("minutes")
    own = [F.coalesce("object_id", F.lit(0)).cast("long").alias("object_id"), F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce(F.col("action") == "acquire", F.lit(False)).alias("acquires")]
    rows = events.withWatermark("ts", late).select(share, *own, minutes, F.unix_millis("ts").alias("ms"), "ts")
    return rows.groupBy("share").transformWithStateInPandas(Leases(), "object_id long, owner string, state string, ms long", "append", "EventTime")


def fence(results: DataFrame, cancellations: DataFrame, late: str = "0 seconds", within: str = "1 day") -> DataFrame:
    """result_id, job_id, ts, rejected of a stream of results (result_id, job_id, ts), against one of cancellations (job_id, ts).

    A result is rejected if its job was canceled up to `within` before it, whichever of the two arrives first; the others are accepted once the
    watermark of both streams says that no earlier cancellation can come. State is bounded by `within` and `late`.
    """
    own = results.select("result_id", "job_id", "ts").withWatermark("ts", late)
    ended = cancellations.select(F.col("job_id").alias("canceled_job"), F.col("ts").alias("canceled_ts")).withWatermark("canceled_ts", late)
    inside = (F.col("job_id") == F.col("canceled_job")) & (F.col("canceled_ts") <= F.col("ts")) & (F.col("canceled_ts") >= F.col("ts") - F.expr(f"INTERVAL {within}"))
    return own.join(ended, inside, "left_outer").select("result_id", "job_id", "ts", F.col("canceled_job").isNotNull().alias("rejected"))


def published(fenced: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The accepted and the rejected results, each once, of what a fence gave in all its batches."""
    each = fenced.groupBy("result_id", "job_id", "ts").agg(F.bool_or("rejected").alias("rejected"))
    return each.where("NOT rejected").drop("rejected"), each.where("rejected").drop("rejected")


class Snapshots(StatefulProcessor):
    """Of one project: its active jobs and its newest terminal ones, what was sent last, and for how many batches nothing was. All of it is one value, read and written once a batch."""

    def __init__(self, terminal: tuple[str, ...], newest: int, idle: int):
        self.terminal, self.newest, self.idle = terminal, newest, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "jobs array<struct<job_id:long,status:string,ms:long>>, digest string, batches long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        kept, before, quiet = self.state.get() or ([], None, 0)
        jobs = {job[0]: (job[1], job[2]) for job in kept}
        for row in sorted(rows, key=lambda r: (r.ms is None, r.ms or 0, r.job_id is None, r.job_id or 0)):
            if row.job_id not in jobs or jobs[row.job_id][1] <= row.ms:
                jobs[row.job_id] = (row.status, row.ms)
        now = [(job, *value) for job, value in jobs.items()]
        ended = sorted((x for x in now if x[1] in self.terminal), key=lambda x: (-x[2], -x[0]))[: self.newest]
        active = sorted(x for x in now if x[1] not in self.terminal)
        text = json.dumps([[x[0], x[1]] for x in active + ended], separators=(",", ":"))
        digest = hashlib.sha256(text.encode()).hexdigest()
        due = digest != before or quiet + 1 >= self.idle
        self.state.update((active + ended, digest, 0 if due else quiet + 1))
        if due:
            yield Row(project_id=key[0], active=len(active), ended=len(ended), jobs=text, heartbeat=digest == before)

    def close(self) -> None:
        pass


def snapshots(changes: DataFrame, terminal: tuple[str, ...], newest: int = NEWEST, idle: int = IDLE) -> DataFrame:
    """project_id, active, ended, jobs (JSON: active ones by number, then the newest ended ones), heartbeat of a stream of (project_id, job_id, status, ts).

    A project that a batch looks at gives a row if its snapshot differs from the one before, else nothing, until `idle` batches have found it unchanged: then the
    same again, as a heartbeat. A job that has left the newest ended ones is forgotten.
    """
    rows = changes.select("project_id", "job_id", "status", F.unix_millis("ts").alias("ms"))
    out = "project_id long, active long, ended long, jobs string, heartbeat boolean"
    return rows.groupBy("project_id").transformWithState(Snapshots(terminal, newest, idle), out, "append", "None")
