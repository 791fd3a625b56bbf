"""Job logs and usage over events; revisions, budgets and rankings over orders and line items."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import jobs, packs, spans
from ..operators.search import first_per
from .registry import query

_STATUS = "CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'queued' WHEN 'purchase' THEN 'complete' ELSE 'failed' END"


def _jobs(t):
    e = F.col("event_type")
    status = F.when(e == "click", "running").when(e == "view", "queued").when(e == "purchase", "complete").otherwise("failed")
    return t.events.withColumn("status", status)


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_job_of_each_task(t):
    return jobs.latest(t.events, ["user_id", "event_type"], ["ts", "event_id"], ["event_id"])


@query(f"""WITH j AS (SELECT *, {_STATUS} AS status FROM events), l AS (SELECT user_id, status AS last_status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM j) WHERE n = 1)
SELECT user_id, count(*) AS total, count(*) FILTER (status = 'complete') AS done, max(last_status) AS last_status,
CASE WHEN bool_or(status = 'running') THEN 'running' WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_and(status = 'complete') THEN 'complete' ELSE 'partial' END AS shown
FROM j JOIN l USING (user_id) GROUP BY user_id""")
def progress_of_projects(t):
    has = lambda s: F.bool_or(F.col("status") == s)
    shown = F.when(has("running"), "running").when(has("failed"), "failed").when(F.bool_and(F.col("status") == "complete"), "complete").otherwise("partial")
    return _jobs(t).groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "complete").alias("done"), F.max_by("status", F.struct("ts", "event_id")).alias("last_status"), shown.alias("shown"))


@query("""SELECT event_type, count(*) AS calls, count(*) FILTER (value < 10) AS errors, CAST(sum(floor(value)) AS BIGINT) AS amount
FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 2000) GROUP BY event_type""")
def usage_of_newest_calls(t):
    return jobs.usage(t.events, ["event_type"], [F.desc("ts"), F.desc("event_id")], 2000, F.col("value") < 10, F.floor("value").cast("long"))


@query("""SELECT event_id, user_id, carried FROM (SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS)
OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried FROM events)""")
def last_purchase_so_far(t):
    mark = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return jobs.carried(t.events, ["user_id"], [F.asc("ts"), F.asc("event_id")], mark, "carried").select("event_id", "user_id", "carried")


@query("""SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) WHERE was IS NULL OR was <> event_type""")
def changes_of_state(t):
    return jobs.changed(t.events, ["user_id"], [F.asc("ts"), F.asc("event_id")], "event_type").select("event_id", "user_id", "event_type")


@query("""WITH j AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderdate, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'done' END AS status FROM orders)
SELECT o_custkey, o_orderpriority, (SELECT o_orderkey FROM j b WHERE b.o_custkey = a.o_custkey AND b.o_orderpriority = a.o_orderpriority AND b.status = 'queued' ORDER BY o_orderdate, o_orderkey LIMIT 1) AS o_orderkey FROM j a
GROUP BY o_custkey, o_orderpriority HAVING NOT bool_or(status = 'running') AND bool_or(status = 'queued')""")
def oldest_queued_where_none_runs(t):
    """Orders by their own status as jobs of a customer's queue: open ones wait, partly filled ones run."""
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("done")
    return jobs.claims(t.orders.withColumn("status", status), ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"], "o_orderkey")


@query("""SELECT user_id, count(*) AS active FROM events WHERE event_type = 'click' AND CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0 GROUP BY user_id HAVING count(*) > 1""")
def more_than_one_active(t):
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.where((F.col("event_type") == "click") & (k % 2 == 0)).groupBy("user_id").agg(F.count("*").alias("active")).where("active > 1")


@query("""SELECT event_id, CASE WHEN s = 'running' AND value < 50 THEN 'error' WHEN s = 'queued' AND user_id % 2 = 0 THEN 'error' ELSE s END AS recovered FROM
(SELECT *, CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'queued' WHEN 'purchase' THEN 'complete' ELSE 'failed' END AS s FROM events)""")
def states_after_recovery(t):
    s = F.col("status")
    after = F.when((s == "running") & (F.col("value") < 50), "error").when((s == "queued") & (F.col("user_id") % 2 == 0), "error").otherwise(s)
    return _jobs(t).select("event_id", after.alias("recovered"))


@query("""SELECT event_id, ts + INTERVAL 240 MINUTE AS expires, ts + INTERVAL 240 MINUTE > (SELECT max(ts) FROM events) AS live FROM events WHERE event_type = 'view'""")
def leases(t):
    newest = t.events.agg(F.max("ts").alias("now"))
    own = t.events.where("event_type = 'view'").crossJoin(F.broadcast(newest))
    expires = F.col("ts") + F.expr("INTERVAL 240 MINUTES")
    return own.select("event_id", expires.alias("expires"), (expires > F.col("now")).alias("live"))


@query("""SELECT user_id, date_diff('second', max(ts), (SELECT max(ts) FROM events)) AS idle, date_diff('second', max(ts), (SELECT max(ts) FROM events)) >= 3600 AND NOT bool_or(event_type = 'click') AS due FROM events GROUP BY user_id""")
def due_schedules(t):
    newest = t.events.agg(F.max("ts").alias("now"))
    own = t.events.groupBy("user_id").agg(F.max("ts").alias("last"), F.bool_or(F.col("event_type") == "click").alias("active")).crossJoin(F.broadcast(newest))
    idle = F.unix_timestamp(F.col("now").cast("timestamp")) - F.unix_timestamp(F.col("last").cast("timestamp"))
    return own.select("user_id", idle.alias("idle"), ((idle >= 3600) & ~F.col("active")).alias("due"))


@query("""SELECT event_id, strftime(ts, '%Y%m%dT%H%M%S%fZ') AS stamp FROM events""")
def compact_stamps(t):
    return t.events.select("event_id", F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd'T'HHmmssSSSSSS'Z'").alias("stamp"))


_EDGES = "edges AS (SELECT DISTINCT s.n_nationkey AS src, d.n_nationkey AS dst FROM nation s JOIN nation d ON d.n_nationkey IN (s.n_nationkey * 2 + 1, s.n_nationkey * 2 + 2))"


def _edges(t):
    both = t.nation.select(F.col("n_nationkey").alias("src"), F.explode(F.array(F.col("n_nationkey") * 2 + 1, F.col("n_nationkey") * 2 + 2)).alias("dst"))
    return both.join(t.nation.select(F.col("n_nationkey").alias("dst")), "dst").distinct().select("src", "dst")


@query(f"WITH RECURSIVE {_EDGES}, r AS (SELECT n_nationkey AS node FROM nation WHERE n_nationkey IN (1, 4) UNION SELECT dst FROM r JOIN edges ON src = node) SELECT node FROM r WHERE node NOT IN (1, 4)")
def downstream_steps(t):
    seeds = t.nation.where("n_nationkey IN (1, 4)").select(F.col("n_nationkey").alias("node"))
    return jobs.closure(_edges(t), seeds, include=False)


@query(f"WITH RECURSIVE {_EDGES}, r AS (SELECT n_nationkey AS node FROM nation WHERE n_nationkey IN (17, 22) UNION SELECT src FROM r JOIN edges ON dst = node) SELECT node FROM r")
def prerequisites_of_steps(t):
    seeds = t.nation.where("n_nationkey IN (17, 22)").select(F.col("n_nationkey").alias("node"))
    return jobs.closure(_edges(t).select(F.col("dst").alias("src"), F.col("src").alias("dst")), seeds, include=True)


@query(f"""WITH {_EDGES}, s AS (SELECT n_nationkey AS step, CASE WHEN n_nationkey < 5 THEN 'done' WHEN n_nationkey = 6 THEN 'failed' ELSE 'pending' END AS state FROM nation),
n AS (SELECT e.dst AS step, bool_or(s.state = 'failed') AS f, bool_and(coalesce(s.state = 'done', TRUE)) AS d FROM edges e LEFT JOIN s ON s.step = e.src GROUP BY e.dst)
SELECT s.step, CASE WHEN f THEN 'blocked' WHEN coalesce(d, TRUE) THEN 'ready' ELSE 'waiting' END AS state FROM s LEFT JOIN n USING (step) WHERE s.state = 'pending'""")
def ready_steps(t):
    key = F.col("n_nationkey")
    steps = t.nation.select(key.alias("step"), F.when(key < 5, "done").when(key == 6, "failed").otherwise("pending").alias("state"))
    return jobs.ready(steps, _edges(t).select(F.col("dst").alias("step"), F.col("src").alias("needs")))


@query("""SELECT o_orderkey, bool_or(l_shipdate > o_orderdate + INTERVAL 90 DAY) AS stale FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def stale_outputs(t):
    joined = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderkey").agg(F.bool_or(F.col("l_shipdate") > F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS")).alias("stale"))


@query("""SELECT o_custkey, o_orderkey AS latest, n AS revision FROM (SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def latest_revisions(t):
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"), F.count("*").alias("revision"))


@query("""SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent FROM orders""")
def parents_of_revisions(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_custkey", "o_orderkey", F.lag("o_orderkey").over(w).alias("parent"))


@query("""SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n <= 2""")
def at_most_two_uses(t):
    w = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber")
    return t.lineitem.withColumn("n", F.row_number().over(w)).where("n <= 2").select("l_orderkey", "l_linenumber")


@query("""SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY band DESC, n, l_returnflag, l_linenumber) AS place FROM
(SELECT *, CAST(floor(l_quantity / 10) AS BIGINT) AS band, row_number() OVER (PARTITION BY l_orderkey, floor(l_quantity / 10), l_returnflag ORDER BY l_linenumber) AS n FROM lineitem)""")
def round_robin_within_bands(t):
    band = F.floor(F.col("l_quantity") / 10)
    rows = t.lineitem.withColumn("band", band)
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey", "band", "l_returnflag").orderBy("l_linenumber")))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("band"), "n", "l_returnflag", "l_linenumber"))
    return rows.select("l_orderkey", "l_linenumber", place.alias("place"))


_ITEMS = "items AS (SELECT o_custkey, o_orderkey, CAST(floor(o_totalprice / 1000) AS BIGINT) AS q, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)"


def _items(t):
    return t.orders.select("o_custkey", "o_orderkey", F.floor(F.col("o_totalprice") / 1000).alias("q"))


@query(f"""WITH RECURSIVE {_ITEMS},
f AS (SELECT o_custkey, 0::BIGINT AS r, 0::BIGINT AS used, 0 AS kept, -1::BIGINT AS o_orderkey, FALSE AS hit FROM (SELECT DISTINCT o_custkey FROM items)
UNION ALL SELECT i.o_custkey, i.r, CASE WHEN kept < 5 AND used + q <= 900 THEN used + q ELSE used END, CASE WHEN kept < 5 AND used + q <= 900 THEN kept + 1 ELSE kept END, i.o_orderkey, kept < 5 AND used + q <= 900
FROM f JOIN items i ON i.o_custkey = f.o_custkey AND i.r = f.r + 1) SELECT o_custkey, o_orderkey FROM f WHERE hit""")
def admitted_under_budgets(t):
    return packs.admitted(_items(t), ["o_custkey"], "o_orderkey", "q", 5, 900)


@query(f"""WITH RECURSIVE {_ITEMS},
f AS (SELECT o_custkey, r, q AS used, 0 AS batch, o_orderkey FROM items WHERE r = 1
UNION ALL SELECT i.o_custkey, i.r, CASE WHEN used + q > 600 THEN q ELSE used + q END, CASE WHEN used + q > 600 THEN batch + 1 ELSE batch END, i.o_orderkey
FROM f JOIN items i ON i.o_custkey = f.o_custkey AND i.r = f.r + 1) SELECT o_custkey, o_orderkey, batch FROM f""")
def batches_by_size(t):
    return packs.batched(_items(t), ["o_custkey"], "o_orderkey", "q", 600)


@query(f"""WITH {_ITEMS}, l AS (SELECT o_custkey, r, count(*) OVER (PARTITION BY o_custkey) AS n, sum(q) OVER (PARTITION BY o_custkey ORDER BY r) AS run, sum(q) OVER (PARTITION BY o_custkey) AS total FROM items)
SELECT o_custkey, greatest(1, least(min(r) FILTER (run * 2 >= total), max(n) - 1)) AS split FROM l WHERE n > 1 GROUP BY o_custkey""")
def midpoints(t):
    return packs.halves(_items(t), ["o_custkey"], "o_orderkey", "q")


_SPANS = "SELECT l_orderkey, l_discount * 1000 AS a, l_discount * 1000 + l_quantity - 5 AS b FROM lineitem"


@query(f"""WITH s AS (SELECT l_orderkey, greatest(a, 0) AS a, least(b, 110) AS b FROM ({_SPANS}) WHERE a < b), v AS (SELECT * FROM s WHERE a < b),
g AS (SELECT l_orderkey, coalesce(max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f, a AS e FROM v
UNION ALL SELECT o.l_orderkey, coalesce(max(v.b), 0), 110 FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN v USING (l_orderkey) GROUP BY o.l_orderkey)
SELECT l_orderkey, CAST(round(f * 10) AS BIGINT) AS from_tenths, CAST(round(e * 10) AS BIGINT) AS to_tenths FROM g WHERE e - f > 0.2""")
def kept_spans(t):
    a = F.col("l_discount") * 1000
    own = t.lineitem.select("l_orderkey", a.alias("start"), (a + F.col("l_quantity") - 5).alias("end"), F.lit(110.0).alias("total"))
    out = spans.complement(own, "l_orderkey")
    return out.select("l_orderkey", F.round(F.col("start") * 10).cast("long").alias("from_tenths"), F.round(F.col("end") * 10).cast("long").alias("to_tenths"))


@query("""SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND floor(c_acctbal) BETWEEN floor(s_acctbal) AND floor(s_acctbal) + 100""")
def points_in_ranges(t):
    points = t.customer.select("c_custkey", F.col("c_nationkey").alias("nation"), F.floor("c_acctbal").alias("at"))
    ranges = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("nation"), F.floor("s_acctbal").alias("low"), (F.floor("s_acctbal") + 100).alias("high"))
    return spans.containing(points, ranges, "nation", "at", 100).select("s_suppkey", "c_custkey")


@query("""SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_type LIKE '%BRASS' THEN 0 ELSE 1 END, p_size, p_partkey) - 1 AS position FROM part""")
def renumbered_parts(t):
    first = F.when(F.col("p_type").endswith("BRASS"), 0).otherwise(1)
    w = Window.partitionBy("p_brand").orderBy(first, "p_size", "p_partkey")
    return t.part.select("p_partkey", (F.row_number().over(w) - 1).cast("long").alias("position"))


@query("""SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY CASE p_type WHEN 'PROMO BRASS' THEN 0 WHEN 'STANDARD TIN' THEN 1 ELSE 2 END, p_partkey) AS n FROM part) WHERE n = 1""")
def richest_choice(t):
    rank = F.when(F.col("p_type") == "PROMO BRASS", 0).when(F.col("p_type") == "STANDARD TIN", 1).otherwise(2)
    return first_per(t.part, ["p_brand"], [rank, F.asc("p_partkey")]).select("p_brand", "p_partkey")


@query("""SELECT l_returnflag AS state, count(*) AS objects, CAST(sum(l_quantity) AS BIGINT) AS bytes, count(*) FILTER (l_linestatus = 'O') AS verified, CAST(coalesce(sum(l_quantity) FILTER (l_linestatus = 'O'), 0) AS BIGINT) AS verified_bytes,
CAST(round(100.0 * count(*) FILTER (l_linestatus = 'O') / count(*)) AS BIGINT) AS percent FROM lineitem GROUP BY l_returnflag""")
def storage_measures(t):
    verified = F.col("l_linestatus") == "O"
    return t.lineitem.groupBy(F.col("l_returnflag").alias("state")).agg(
        F.count("*").alias("objects"),
        F.sum("l_quantity").cast("long").alias("bytes"),
        F.count_if(verified).alias("verified"),
        F.coalesce(F.sum(F.when(verified, F.col("l_quantity"))), F.lit(0)).cast("long").alias("verified_bytes"),
        F.round(100.0 * F.count_if(verified) / F.count("*")).cast("long").alias("percent"),
    )


@query("""SELECT o_orderkey, string_agg(l_partkey || ':' || l_suppkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS upstream FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def upstream_lists(t):
    joined = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x"))
    return joined.select("o_orderkey", F.array_join(F.transform("x", lambda x: F.concat_ws(":", x["l_partkey"], x["l_suppkey"])), ",").alias("upstream"))


@query("""SELECT l_partkey, count(*) AS refs, count(*) = 1 AS removable FROM lineitem GROUP BY l_partkey""")
def shared_keys(t):
    return t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("refs"), (F.count("*") == 1).alias("removable"))
