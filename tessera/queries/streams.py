"""Streams with timers, joins of streams, and snapshots that are sent when they change."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import jobs as streams
from ..streaming import states
from .registry import query

#: The last event time of the table, less what may come late: ends and results before it are settled.
_LATE = "10 minutes"


def _events(t):
    """The table's files aren't in the order of time: in several batches, rows of later ones would count as late."""
    return streams.stream(t.spark, f"{t.folder}/event*.parquet", t.events.schema, 1 << 30)


@query("""WITH a AS (SELECT user_id, event_type, (epoch_us(ts) // 1000) AS ms, 1 + event_id % 500 AS minutes FROM events WHERE event_type IN ('purchase', 'error', 'signup')),
k AS (SELECT user_id AS object_id, CASE WHEN event_type = 'signup' THEN 'b' ELSE 'a' END AS owner, event_type, ms, minutes, CASE WHEN event_type <> 'error' THEN ms + 60000 * minutes END AS until FROM a),
n AS (SELECT *, lead(ms) OVER w AS next, lag(until) OVER w AS held FROM k WINDOW w AS (PARTITION BY object_id, owner ORDER BY ms, event_type = 'error', minutes)),
o AS (SELECT object_id, owner, CASE WHEN event_type = 'error' THEN 'released' WHEN held > ms THEN 'renewed' ELSE 'granted' END AS state, ms FROM n WHERE event_type <> 'error' OR held > ms
UNION ALL SELECT object_id, owner, 'expired', until FROM n WHERE until IS NOT NULL AND until <= coalesce(next, 9e18) AND until < (SELECT (epoch_us(max(ts)) // 1000) - 600000 FROM events WHERE event_type IN ('purchase', 'error', 'signup')))
SELECT * FROM o""")
def streamed_leases(t):
    """Purchases lease their user's object for one owner, signups for another; errors release the first's. Leases end by timers."""
    kind = F.col("event_type")
    own = _events(t).where("event_type IN ('purchase', 'error', 'signup')").select(
        F.col("user_id").alias("object_id"),
        F.when(kind == "signup", "b").otherwise("a").alias("owner"),
        F.when(kind == "error", "release").otherwise("acquire").alias("action"),
        (1 + F.col("event_id") % 500).alias("minutes"),
        "ts",
    )
    with states.state_store(t.spark):
        return streams.drained(states.leases(own, _LATE), "append")


@query("""WITH r AS (SELECT event_id AS result_id, user_id AS job_id, ts FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, ts AS ended FROM events WHERE event_type = 'error'),
x AS (SELECT r.*, EXISTS (SELECT 1 FROM c WHERE user_id = job_id AND ended <= ts AND ended >= ts - INTERVAL 1 DAY) AS rejected FROM r)
SELECT result_id, job_id, rejected FROM x WHERE rejected OR (epoch_us(ts) // 1000) < least((SELECT (epoch_us(max(ts)) // 1000) FROM r), (SELECT (epoch_us(max(ended)) // 1000) FROM c)) - 600000""")
def fenced_results(t):
    """Purchases are results, errors cancel their user's jobs for a day: two streams, joined within the day."""
    results = _events(t).where("event_type = 'purchase'").select(F.col("event_id").alias("result_id"), F.col("user_id").alias("job_id"), "ts")
    ended = _events(t).where("event_type = 'error'").select(F.col("user_id").alias("job_id"), "ts")
    accepted, rejected = states.published(streams.drained(states.fence(results, ended, _LATE), "append"))
    return accepted.withColumn("rejected", F.lit(False)).union(rejected.withColumn("rejected", F.lit(True))).drop("ts")


@query("""WITH o AS (SELECT o_custkey AS project_id, o_orderkey AS job_id, o_orderstatus AS status, row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'F' ORDER BY (epoch_us(o_orderdate) // 1000) DESC, o_orderkey DESC) AS n FROM orders),
k AS (SELECT * FROM o WHERE status <> 'F' OR n <= 25)
SELECT project_id, count(*) FILTER (WHERE status <> 'F') AS active, count(*) FILTER (WHERE status = 'F') AS ended,
sha256('[' || string_agg('[' || job_id || ',"' || status || '"]', ',' ORDER BY status = 'F', CASE WHEN status = 'F' THEN n ELSE job_id END) || ']') AS jobs FROM k GROUP BY project_id""")
def job_snapshots(t):
    """Orders are a customer's jobs: all that aren't filled, and the 25 newest that are."""
    rows = t.spark.readStream.schema(t.orders.schema).parquet(f"{t.folder}/order*.parquet")
    changes = rows.select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    with states.state_store(t.spark):
        sent = streams.drained(states.snapshots(changes, ("F",)), "append")
    return sent.select("project_id", "active", "ended", F.sha2("jobs", 256).alias("jobs"))
