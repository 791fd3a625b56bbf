import datetime

from pyspark.sql import functions as F

from tessera.operators import jobs as logs
from tessera.operators import records
from tessera.plans import coverage, reduce
from tessera.streaming import jobs

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string"


def events(spark, rows):
    day = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, day + datetime.timedelta(minutes=m), u, e) for i, m, u, e in rows], SCHEMA)


def test_states_over_two_batches(spark, tmp_path):
    first = events(spark, [(1, 0, 1, "click"), (2, 5, 1, "purchase"), (3, 1, 2, "view")])
    second = events(spark, [(4, 9, 1, "click"), (5, 90, 2, "click")])
    first.coalesce(1).write.parquet(f"{tmp_path}/a")
    second.coalesce(1).write.parquet(f"{tmp_path}/b")
    rows = jobs.stream(spark, f"{tmp_path}/*/", first.schema)
    assert sorted(map(tuple, jobs.drained(jobs.current_states(rows), "complete").collect())) == [(1, "click", 3), (2, "click", 2)]
    final = jobs.drained(jobs.fixed_states(rows, ["purchase", "error"]), "update").groupBy("user_id").agg(F.max(F.struct("rejected", "status")).alias("x"))
    assert sorted((r.user_id, r.x.status, r.x.rejected) for r in final.collect()) == [(1, "purchase", 1), (2, "click", 0)]
    hours = jobs.drained(jobs.hourly(rows), "complete").collect()
    assert sorted((r.start.hour, r.event_type, r.n) for r in hours) == [(0, "click", 2), (0, "purchase", 1), (0, "view", 1), (1, "click", 1)]


def test_fence_and_claims(spark):
    log = events(spark, [(1, 0, 1, "x"), (2, 1, 2, "y")])
    running = spark.createDataFrame([(1,)], "user_id long")
    assert [r.event_id for r in jobs.fenced(log, running).collect()] == [1]
    queue = spark.createDataFrame([(1, "a", "queued", 5), (2, "a", "queued", 3), (3, "b", "running", 1), (4, "b", "queued", 0), (5, "c", "done", 0)], "id long, q string, status string, at int")
    assert [tuple(r) for r in logs.claims(queue, ["q"], ["at"], "id").collect()] == [("a", 2)]


def test_steps(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert sorted(r.node for r in logs.closure(edges, seeds, include=False).collect()) == ["b", "c"]
    loop = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("c", "d")], "src string, dst string")
    assert sorted(r.node for r in logs.closure(loop, seeds, include=True).collect()) == ["a", "b", "c", "d"]
    steps = spark.createDataFrame([("a", "done"), ("b", "pending"), ("c", "pending"), ("d", "failed"), ("e", "pending"), ("f", "pending")], "step string, state string")
    needs = spark.createDataFrame([("b", "a"), ("c", "b"), ("e", "d"), ("e", "a")], "step string, needs string")
    assert dict(map(tuple, logs.ready(steps, needs).collect())) == {"b": "ready", "c": "waiting", "e": "blocked", "f": "ready"}


def test_reduction_keeps_every_id(spark):
    items = spark.createDataFrame([(g, i, 10 + i % 7) for g in (1, 2) for i in range(50 * g)] + [(3, 1, 5)], "g int, i int, size int")
    out = {r.g: r for r in reduce.reduced(items, "g", "i", "size", 40, 4).collect()}
    assert all(out[g].ids == list(range(50 * g)) for g in (1, 2)) and out[3].ids == [1]


def test_as_of_and_coverage(spark):
    times = spark.createDataFrame([("k", 5), ("k", 1), ("z", 9)], "k string, t int")
    versions = spark.createDataFrame([("k", 2, "a"), ("k", 5, "b"), ("k", 7, "c")], "k string, s int, v string")
    assert sorted(map(str, map(tuple, records.as_of(times, versions, "k", "t", "s", "v").collect()))) == ["('k', 1, None)", "('k', 5, 'b')", "('z', 9, None)"]
    rows = spark.createDataFrame([("p", True, True), ("p", False, True), ("q", False, False)], "g string, covered boolean, critical boolean")
    assert sorted(map(tuple, coverage.percentages(rows, ["g"], "covered", "critical").collect())) == [("p", 2, 1, 2, 50), ("q", 1, 0, 0, 100)]
