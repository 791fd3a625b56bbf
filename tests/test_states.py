import datetime
import json

import pandas as pd
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.sources.shared import place
from tessera.streaming import states

DAY = datetime.datetime(2024, 1, 1)


def at(minute):
    return DAY + datetime.timedelta(minutes=minute)


class Feed:
    """A folder that a stream reads, a file a batch, and what the stream gives in each batch; stopping and starting goes on from the checkpoint."""

    def __init__(self, spark, tmp_path, name, schema):
        self.spark, self.folder, self.schema, self.n = spark, tmp_path / name, schema, 0
        self.folder.mkdir()

    def add(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(str(self.folder / f"{self.n:04d}"))

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/*")


def run(spark, df, checkpoint):
    """Rows by batch of a stream run until all that is there has been read."""
    got = []
    with states.state_store(spark):
        q = df.writeStream.foreachBatch(lambda b, i: got.append((i, sorted(map(tuple, b.collect()))))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    return [x for x in sorted(got) if x[1]]


LEASE = "object_id long, owner string, action string, minutes int, ts timestamp"


def test_a_lease_ends_without_a_further_event_of_its_object_and_a_restart_keeps_it(spark, tmp_path):
    feed, checkpoint = Feed(spark, tmp_path, "in", LEASE), place(spark, "checkpoint")
    ms = lambda m: int((at(m) - datetime.datetime(1970, 1, 1)).total_seconds() * 1000)
    feed.add([(1, "x", "acquire", 30, at(0)), (2, "y", "acquire", None, at(1)), (3, "z", "acquire", 0, at(1))])
    first = run(spark, states.leases(feed.stream()), checkpoint)
    assert sorted(r for _, b in first for r in b) == [(1, "x", "granted", ms(0)), (2, "y", "granted", ms(1)), (3, "z", "granted", ms(1))]
    feed.add([(2, "w", "acquire", 5, at(20))])  # object 3 ended at 2
    second = run(spark, states.leases(feed.stream()), checkpoint)
    assert sorted(r for _, b in second for r in b) == [(2, "w", "granted", ms(20)), (3, "z", "expired", ms(2))]
    feed.add([(9, "q", "acquire", 1, at(100)), (2, "y", "acquire", 10, at(100)), (2, "w", "release", None, at(100))])
    third = run(spark, states.leases(feed.stream()), checkpoint)
    assert sorted(r for _, b in third for r in b) == sorted([(1, "x", "expired", ms(30)), (2, "w", "expired", ms(25)), (2, "y", "renewed", ms(100)), (9, "q", "granted", ms(100))])
    feed.add([(1, "x", "acquire", 10, at(1000))])
    last = run(spark, states.leases(feed.stream()), checkpoint)
    assert sorted(r for _, b in last for r in b) == sorted([(1, "x", "granted", ms(1000)), (2, "y", "expired", ms(110)), (9, "q", "expired", ms(101))])


def test_a_result_after_its_job_s_cancellation_is_rejected_across_batches(spark, tmp_path):
    results = Feed(spark, tmp_path, "results", "result_id long, job_id long, ts timestamp")
    ended = Feed(spark, tmp_path, "ended", "job_id long, ts timestamp")
    checkpoint = place(spark, "checkpoint")
    fenced = lambda: states.fence(results.stream(), ended.stream(), "10 minutes")
    results.add([(1, 7, at(0)), (2, 8, at(5))])
    ended.add([(7, at(3))])
    got = run(spark, fenced(), checkpoint)
    results.add([(3, 7, at(8)), (4, 8, at(9))])  # job 7 was canceled in the batch before
    ended.add([(8, at(6))])
    got += run(spark, fenced(), checkpoint)
    ended.add([(8, at(8)), (99, at(500))])  # told late, but before the watermark: result 4 is rejected though it came first
    results.add([(5, 1, at(500))])
    got += run(spark, fenced(), checkpoint)
    results.add([(6, 1, at(600))])
    ended.add([(99, at(600))])
    got += run(spark, fenced(), checkpoint)
    schema = "result_id long, job_id long, ts timestamp, rejected boolean"
    accepted, rejected = states.published(spark.createDataFrame([r for _, b in got for r in b], schema))
    assert sorted(r.result_id for r in rejected.collect()) == [3, 4]
    assert sorted(r.result_id for r in accepted.collect()) == [1, 2, 5]


CHANGE = "project_id long, job_id long, status string, ts timestamp"


def test_snapshots_are_sent_on_change_and_after_idle_batches(spark, tmp_path):
    feed, checkpoint = Feed(spark, tmp_path, "in", CHANGE), place(spark, "checkpoint")
    snap = lambda: states.snapshots(feed.stream(), ("done", "error"), newest=3)
    feed.add([(1, i, "done", at(i)) for i in range(6)] + [(1, 50, "running", at(9)), (1, 40, "queued", at(9)), (2, 1, "queued", at(0))])
    (batch,) = run(spark, snap(), checkpoint)
    rows = {r[0]: r for r in batch[1]}
    assert rows[1][1:3] == (2, 3) and json.loads(rows[1][3]) == [[40, "queued"], [50, "running"], [5, "done"], [4, "done"], [3, "done"]] and not rows[1][4]
    feed.add([(1, 50, "running", at(9))])  # looked at, unchanged
    assert run(spark, snap(), checkpoint) == []
    feed.add([(1, 50, "queued", at(8))])  # older than what is known
    assert run(spark, snap(), checkpoint) == []
    feed.add([(1, 50, "done", at(10))])
    (batch,) = run(spark, snap(), checkpoint)
    assert json.loads(batch[1][0][3]) == [[40, "queued"], [50, "done"], [5, "done"], [4, "done"]] and len(batch[1]) == 1
    for _ in range(16):
        feed.add([(1, 40, "queued", at(9))])
    got = run(spark, snap(), checkpoint)
    assert len(got) == 1 and len(got[0][1]) == 1 and got[0][1][0][4]  # once, at the 15th
    before = {i for i, _ in got}
    assert max(before) == 4 + 14


def test_store_is_put_back(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    with states.state_store(spark):
        assert "RocksDB" in spark.conf.get(key)
    assert spark.conf.get(key) == before and F is not None


def test_a_projects_snapshot_asks_the_state_once():
    asked = []

    class Value:
        now = None

        def get(self):
            asked.append("get")
            return self.now

        def update(self, value):
            asked.append("update")
            self.now = value

    class Handle:
        getValueState = staticmethod(lambda name, schema: Value())  # noqa: N815

    of = states.Snapshots(("done",), 2, 15)
    of.init(Handle())
    (first,) = of.handleInputRows((7,), iter([Row(job_id=i, status="done" if i % 2 else "queued", ms=i) for i in range(100)]), None)
    assert (first.active, first.ended, asked) == (50, 2, ["get", "update"])
    assert list(of.handleInputRows((7,), iter([Row(job_id=4, status="queued", ms=4)]), None)) == []
    (third,) = of.handleInputRows((7,), iter([Row(job_id=4, status="done", ms=200)]), None)
    assert (third.active, json.loads(third.jobs)[-2:]) == (49, [[4, "done"], [99, "done"]]) and len(asked) == 6


def test_leases_of_many_objects_ask_the_state_once_and_have_one_timer():
    asked = []

    class Value:
        now = None

        def get(self):
            asked.append("get")
            return self.now

        def update(self, value):
            asked.append("update")
            self.now = value

        def clear(self):
            asked.append("clear")
            self.now = None

    class Handle:
        getValueState = staticmethod(lambda name, schema: Value())  # noqa: N815
        registerTimer = staticmethod(lambda ms: asked.append(ms))  # noqa: N815
        deleteTimer = staticmethod(lambda ms: asked.append(-ms))  # noqa: N815

    class Times:
        getCurrentWatermarkInMs = staticmethod(lambda: 120_030)  # noqa: N815

    of = states.Leases()
    of.init(Handle())
    rows = [(i, "x", True, 2, i) for i in range(100)] + [(i, "x", False, 1, 200_000) for i in range(0, 100, 2)]
    frame = lambda rows: pd.DataFrame(rows, columns=["object_id", "owner", "acquires", "minutes", "ms"])
    (first,) = of.handleInputRows((3,), iter([frame(rows[:70]), frame(rows[70:])]), None)
    assert first.state.value_counts().to_dict() == {"granted": 100, "expired": 50} and asked == ["get", 120_001, "update"]
    (second,) = of.handleExpiredTimer((3,), Times, None)
    assert second.ms.tolist() == list(range(120_001, 120_030, 2)) and asked[3:] == ["get", 120_031, "update"]
    (third,) = of.handleInputRows((3,), iter([frame([(31, "x", True, 1, 120_030), (33, "x", False, 1, 120_032), (35, "y", False, 1, 0)])]), None)
    assert third.state.tolist() == ["renewed", "released"] and asked[6:] == ["get", -120_031, 120_035, "update"]
