"""Plans of series over evidence, and reductions with their conservation rules; line items propose what parts hold."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import packs
from ..plans import planning
from .registry import query

# A supplier is a series, a part of the catalogue an id of evidence; line numbers are positions, returned items bridges.
_KNOWN = "known AS (SELECT p_partkey AS id, CASE WHEN p_size > 40 THEN 'critical' WHEN p_size > 20 THEN 'major' ELSE 'supporting' END AS importance FROM part WHERE p_size <= 45)"
_PROPOSED = "proposed AS (SELECT l_suppkey AS series, l_partkey AS id, l_linenumber - 1 AS position, CASE WHEN l_returnflag = 'R' THEN 'bridge' ELSE 'primary' END AS role, l_orderkey FROM lineitem)"
_PLAN = f"""{_KNOWN}, {_PROPOSED}, fit AS (SELECT series, id, greatest(1, least(5, position)) AS position, role, l_orderkey FROM proposed SEMI JOIN known USING (id)),
prim AS (SELECT series, id, min(position) AS position FROM fit WHERE role = 'primary' GROUP BY ALL), bri AS (SELECT DISTINCT series, id, position FROM fit ANTI JOIN prim USING (series, id, position) WHERE role = 'bridge'),
plan AS (SELECT series, id, position, 'primary' AS role FROM prim UNION ALL SELECT series, id, position, 'bridge' FROM bri QUALIFY row_number() OVER (PARTITION BY series, id ORDER BY position) <= 2)"""


def _known(t):
    importance = F.when(F.col("p_size") > 40, "critical").when(F.col("p_size") > 20, "major").otherwise("supporting")
    return t.part.where("p_size <= 45").select(F.col("p_partkey").alias("id"), importance.alias("importance"))


def _proposed(t):
    role = F.when(F.col("l_returnflag") == "R", "bridge").otherwise("primary")
    return t.lineitem.select(F.col("l_suppkey").alias("series"), F.col("l_partkey").alias("id"), (F.col("l_linenumber") - 1).alias("position"), role.alias("role"), "l_orderkey")


def _plan(t):
    return planning.cleaned(_proposed(t), _known(t), ["l_orderkey"])


@query(f"WITH {_PLAN} SELECT series, id, position, role FROM plan")
def cleaned_plans(t):
    return _plan(t).select("series", "id", "position", "role")


@query(f"""WITH {_PLAN}, o AS (SELECT l_suppkey AS series, l_partkey + 1 AS id, CASE WHEN l_tax > 0.04 THEN 'because ' || l_linenumber ELSE ' ' END AS reason FROM lineitem WHERE l_discount > 0.08)
SELECT series, id, min(reason) AS reason FROM o SEMI JOIN (SELECT id FROM known WHERE importance = 'supporting') k USING (id) ANTI JOIN plan USING (series, id) WHERE trim(reason) <> '' GROUP BY ALL""")
def plan_omissions(t):
    reason = F.when(F.col("l_tax") > 0.04, F.concat(F.lit("because "), "l_linenumber")).otherwise(" ")
    offered = t.lineitem.where("l_discount > 0.08").select(F.col("l_suppkey").alias("series"), (F.col("l_partkey") + 1).alias("id"), reason.alias("reason"))
    return planning.omissions(offered, _known(t), _plan(t))


@query(f"""WITH {_KNOWN}, {_PROPOSED}, e AS (SELECT series, id, bool_or(k.id IS NOT NULL) AS known, count(*) FILTER (role = 'primary') AS p, count(*) FILTER (role = 'bridge') AS b FROM (SELECT series, proposed.id, role, k.id AS kid FROM proposed LEFT JOIN known k ON k.id = proposed.id) x(series, id, role, kid), LATERAL (SELECT kid AS id) k GROUP BY ALL)
SELECT series, max(parts) AS parts, bool_or(gaps) AS gaps, count(*) FILTER (NOT known) AS unknown, count(*) FILTER (p > 1) AS doubled, count(*) FILTER (b > 2) AS overbridged FROM e JOIN (SELECT series, max(position) AS parts, min(position) <> 1 OR max(position) <> count(DISTINCT position) AS gaps FROM proposed GROUP BY series) USING (series) GROUP BY series""".replace(", e AS (SELECT series, id, bool_or(k.id IS NOT NULL) AS known, count(*) FILTER (role = 'primary') AS p, count(*) FILTER (role = 'bridge') AS b FROM (SELECT series, proposed.id, role, k.id AS kid FROM proposed LEFT JOIN known k ON k.id = proposed.id) x(series, id, role, kid), LATERAL (SELECT kid AS id) k GROUP BY ALL)",
", e AS (SELECT series, id, bool_or(id IN (SELECT id FROM known)) AS known, count(*) FILTER (role = 'primary') AS p, count(*) FILTER (role = 'bridge') AS b FROM proposed GROUP BY series, id)"))
def plan_violations(t):
    return planning.violations(_proposed(t), _known(t))


@query(f"WITH {_PLAN} SELECT series, position, sha256(string_agg(id || ':' || role, ',' ORDER BY id, role)) AS signature FROM plan GROUP BY ALL")
def plan_signatures(t):
    return planning.signatures(_plan(t))


_GATE = """need AS (SELECT DISTINCT l_suppkey AS series, l_partkey AS id FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 40 AND l_quantity > 48), topics AS (SELECT l_suppkey AS series, l_orderkey % 3 AS topic, l_partkey AS id FROM lineitem WHERE l_quantity > 47), poor AS (SELECT p_partkey AS id FROM part WHERE p_size % 3 <> 0)"""


@query(f"""WITH {_PLAN}, {_GATE}, a AS (SELECT series, count(*) AS n FROM need ANTI JOIN plan USING (series, id) GROUP BY series), b AS (SELECT series, count(*) FILTER (n = 0) AS n FROM (SELECT series, position, count(*) FILTER (role = 'primary') AS n FROM plan GROUP BY ALL) GROUP BY series),
c AS (SELECT series, count(*) FILTER (weak) AS n FROM (SELECT series, topic, bool_and(id IN (SELECT id FROM poor)) AS weak FROM topics GROUP BY ALL) GROUP BY series)
SELECT s.series, coalesce(a.n, 0) AS missing, coalesce(b.n, 0) AS empty, coalesce(c.n, 0) AS gaps, coalesce(a.n, 0) = 0 AND coalesce(b.n, 0) = 0 AND coalesce(c.n, 0) = 0 AS approved FROM (SELECT DISTINCT series FROM plan) s LEFT JOIN a USING (series) LEFT JOIN b USING (series) LEFT JOIN c USING (series)""")
def approval_gate(t):
    """Critical ids left out, parts without a primary id, and topics that only poor ids support."""
    line = t.lineitem.select(F.col("l_suppkey").alias("series"), F.col("l_partkey").alias("id"), "l_quantity", (F.col("l_orderkey") % 3).alias("topic"))
    critical = t.part.where("p_size > 40").select(F.col("p_partkey").alias("id"))
    need = line.where("l_quantity > 48").join(critical, "id", "left_semi").select("series", "id")
    poor = t.part.where("p_size % 3 <> 0").select(F.col("p_partkey").alias("id"))
    return planning.gate(_plan(t), need, line.where("l_quantity > 47").select("series", "topic", "id"), poor)


@query(f"""WITH {_PLAN} SELECT series, position, count(*) AS ids, count(*) FILTER (id % 5 <> 0) AS mapped, bool_and(id % 5 <> 0) AS complete FROM plan WHERE role = 'primary' GROUP BY ALL""")
def part_contexts(t):
    """All primary ids of a part must be mapped before it is written."""
    mapped = t.part.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("id"), F.lit(1).alias("map"))
    rows = _plan(t).where("role = 'primary'").join(mapped, "id", "left")
    return rows.groupBy("series", "position").agg(F.count("*").alias("ids"), F.count("map").alias("mapped"), F.bool_and(F.col("map").isNotNull()).alias("complete"))


@query("""WITH s AS (SELECT c_custkey AS series, c_nationkey AS version, CASE WHEN c_acctbal > 0 THEN 'saved' ELSE '' END AS body FROM customer WHERE c_custkey % 3 <> 0), o AS (SELECT c_custkey AS series, c_custkey % 25 AS expected, 'offer ' || c_custkey AS body FROM customer WHERE c_custkey % 2 = 0)
SELECT series, CASE WHEN s.series IS NULL THEN 1 WHEN version = expected AND (series % 4 = 0 OR s.body = '') THEN version + 1 ELSE version END AS version, CASE WHEN s.series IS NULL OR (version = expected AND (series % 4 = 0 OR s.body = '')) THEN o.body ELSE s.body END AS body FROM s FULL JOIN o USING (series)""")
def replaced_plans(t):
    """A saved plan stays unless the offer is forced or the plan is empty, and only if the expected version is the saved one."""
    saved = t.customer.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("series"), F.col("c_nationkey").alias("version"), F.when(F.col("c_acctbal") > 0, "saved").otherwise("").alias("body"))
    offered = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("series"), (F.col("c_custkey") % 25).cast("int").alias("expected"), F.concat(F.lit("offer "), "c_custkey").alias("body"))
    return planning.replaced(saved, offered, F.col("series") % 4 == 0)


@query("""WITH p AS (SELECT c_custkey, c_nationkey AS series, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS position, c_mktsegment FROM customer), e AS (SELECT series, min(position) AS edited FROM p WHERE c_custkey % 11 = 0 AND c_mktsegment <> 'BUILDING' GROUP BY series)
SELECT c_custkey, position >= edited AND c_mktsegment IN ('MACHINERY', 'FURNITURE', 'AUTOMOBILE') AS stale FROM p JOIN e USING (series)""")
def stale_after_an_edit(t):
    """An edit of an unlocked part makes it and all later parts stale that have begun."""
    rows = t.customer.select("c_custkey", F.col("c_nationkey").alias("series"), "c_mktsegment").withColumn("position", F.row_number().over(Window.partitionBy("series").orderBy("c_custkey")))
    edits = rows.where("c_custkey % 11 = 0 AND c_mktsegment <> 'BUILDING'").groupBy("series").agg(F.min("position").alias("edited"))
    return rows.join(edits, "series").select("c_custkey", ((F.col("position") >= F.col("edited")) & F.col("c_mktsegment").isin("MACHINERY", "FURNITURE", "AUTOMOBILE")).alias("stale"))


# Reductions: an order is a group, its line items are records, line items of the same part hold the same evidence.


@query("""SELECT user_id, event_type, max_by(event_id, event_id) AS row_id, count(*) AS versions FROM (SELECT *, user_id % 5 || ':' || event_type AS config FROM events WHERE event_type <> 'error') WHERE value > 50 GROUP BY user_id, event_type""")
def newest_cache_rows(t):
    rows = t.events.where("event_type <> 'error' AND value > 50")
    return rows.groupBy("user_id", "event_type").agg(F.max("event_id").alias("row_id"), F.count("*").alias("versions"))


@query("""WITH w AS (SELECT o_orderkey, sha256(string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey, l_linenumber)) AS input, list_sort(list_distinct(list(l_partkey))) AS ledger FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
c AS (SELECT l_orderkey AS cached, sha256(string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey, l_linenumber)) AS input, list_sort(list_distinct(list(l_partkey) FILTER (l_orderkey % 4 <> 0 OR l_linenumber > 1))) AS ledger FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY 1)
SELECT o_orderkey, min(cached) AS cached FROM w JOIN c ON w.input = c.input AND w.ledger = c.ledger GROUP BY 1""")
def cached_reductions(t):
    """A cached reduction is found by its input's digest and taken only if its ledger is the input's."""
    digest = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_partkey", "l_linenumber"))), lambda x: x["l_partkey"].cast("string")), ","), 256)
    want = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(digest.alias("input"), F.array_sort(F.collect_set("l_partkey")).alias("ledger"))
    kept = F.when((F.col("l_orderkey") % 4 != 0) | (F.col("l_linenumber") > 1), F.col("l_partkey"))
    have = t.lineitem.where("l_orderkey % 3 = 0").groupBy(F.col("l_orderkey").alias("cached")).agg(digest.alias("input"), F.array_sort(F.collect_set(kept)).alias("ledger"))
    return want.join(have, ["input", "ledger"]).groupBy("o_orderkey").agg(F.min("cached").alias("cached"))


@query("""WITH r AS (SELECT l_orderkey, list_sort(list_distinct(list(l_partkey))) AS before, list_sort(list_distinct(coalesce(list(l_partkey) FILTER (NOT (l_linenumber = 3 AND l_orderkey % 5 = 0)), []))) AS after, list_sort(list_distinct(list(l_suppkey))) AS lineage, list_sort(list_distinct(coalesce(list(l_suppkey) FILTER (l_quantity > 5 OR l_orderkey % 2 = 0), []))) AS kept FROM lineitem GROUP BY 1)
SELECT l_orderkey, before = after AS ids_kept, len(list_filter(after, lambda x: NOT list_contains(before, x))) = 0 AS none_invented, len(list_filter(lineage, lambda x: NOT list_contains(kept, x))) AS lineage_lost FROM r""")
def conserved_reductions(t):
    """Whether a reduction keeps all ids, invents none, and how much lineage it lost."""
    some = lambda c, when: F.array_sort(F.collect_set(F.when(when, F.col(c))))
    kept = ~((F.col("l_linenumber") == 3) & (F.col("l_orderkey") % 5 == 0))
    rows = t.lineitem.groupBy("l_orderkey").agg(some("l_partkey", F.lit(True)).alias("before"), some("l_partkey", kept).alias("after"), some("l_suppkey", F.lit(True)).alias("lineage"), some("l_suppkey", (F.col("l_quantity") > 5) | (F.col("l_orderkey") % 2 == 0)).alias("kept"))
    return rows.select("l_orderkey", (F.col("before") == F.col("after")).alias("ids_kept"), (F.size(F.array_except("after", "before")) == 0).alias("none_invented"), F.size(F.array_except("lineage", "kept")).cast("long").alias("lineage_lost"))


@query("""WITH l AS (SELECT l_orderkey, l_partkey, max(l_quantity) AS importance, bool_or(l_linenumber % 3 <> 0) AS kept FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, l_partkey, importance, NOT kept AS carried FROM l WHERE kept OR importance > 25""")
def repaired_reductions(t):
    """What a reduction lost is carried forward if it matters; importance is the highest of all its sources."""
    rows = t.lineitem.groupBy("l_orderkey", "l_partkey").agg(F.max("l_quantity").alias("importance"), F.bool_or(F.col("l_linenumber") % 3 != 0).alias("kept"))
    return rows.where("kept OR importance > 25").select("l_orderkey", "l_partkey", "importance", (~F.col("kept")).alias("carried"))


@query("""SELECT l_orderkey, min(l_partkey) AS id FROM lineitem GROUP BY 1 HAVING count(*) = 1 AND sum(l_quantity) <= 30""")
def passed_through_unchanged(t):
    own = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("size"), F.min("l_partkey").alias("id"))
    return own.where("n = 1 AND size <= 30").select("l_orderkey", "id")


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 7 = o_custkey % 7) WHERE n = 1""")
def newest_matching_bundle(t):
    """The newest bundle whose source and configuration are the current ones; malformed rows are passed over."""
    rows = t.orders.where("o_orderstatus <> 'P' AND o_orderkey % 7 = o_custkey % 7")
    return rows.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))


@query("""WITH e AS (SELECT l_suppkey AS source, l_partkey, max(CASE WHEN l_quantity > 45 THEN 3 WHEN l_quantity > 25 THEN 2 ELSE 1 END) AS rank FROM lineitem GROUP BY ALL)
SELECT source, count(*) AS evidence, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey) FILTER (rank = 3) AS critical, count(*) FILTER (rank = 2) AS major, CAST(round_even(100.0 * count(*) FILTER (rank > 1) / count(*), 0) AS BIGINT) AS percent FROM e GROUP BY source""")
def analysis_bundles(t):
    """Importance, critical ids and coverage of each source in one record; percentages round half to even."""
    rank = F.when(F.col("l_quantity") > 45, 3).when(F.col("l_quantity") > 25, 2).otherwise(1)
    each = t.lineitem.groupBy(F.col("l_suppkey").alias("source"), "l_partkey").agg(F.max(rank).alias("rank"))
    critical = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") == 3, F.col("l_partkey")))), lambda x: x.cast("string")), ",")
    out = each.groupBy("source").agg(F.count("*").alias("evidence"), critical.alias("critical"), F.count_if(F.col("rank") == 2).alias("major"), F.bround(100.0 * F.count_if(F.col("rank") > 1) / F.count("*"), 0).cast("long").alias("percent"))
    return out.withColumn("critical", F.when(F.col("critical") != "", F.col("critical")))


@query("""WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey % 4 = 0 AS cached, row_number() OVER (PARTITION BY l_orderkey, l_partkey % 4 = 0 ORDER BY l_linenumber) AS n FROM lineitem)
SELECT l_orderkey, count(*) AS selected, count(*) FILTER (cached) AS reused, count(*) FILTER (NOT cached AND n <= 3) AS called, count(*) FILTER (NOT cached AND n > 3) AS skipped FROM e GROUP BY 1""")
def mapped_within_a_call_budget(t):
    """Records in the cache cost no call; the others are called in order up to the budget; the rest is counted as skipped."""
    cached = F.col("l_partkey") % 4 == 0
    n = F.row_number().over(Window.partitionBy("l_orderkey", cached).orderBy("l_linenumber"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").withColumn("n", n).withColumn("cached", cached)
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("selected"), F.count_if("cached").alias("reused"), F.count_if(~F.col("cached") & (F.col("n") <= 3)).alias("called"), F.count_if(~F.col("cached") & (F.col("n") > 3)).alias("skipped"))


@query("""WITH RECURSIVE i AS (SELECT o_custkey, CAST(o_totalprice / 1000 AS BIGINT) AS q, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders), s AS (SELECT o_custkey, min(r) AS lo, max(r) AS hi, 0 AS depth FROM i GROUP BY 1
UNION ALL SELECT s.o_custkey, CASE k WHEN 0 THEN lo ELSE (lo + hi) // 2 + 1 END, CASE k WHEN 0 THEN (lo + hi) // 2 ELSE hi END, depth + 1 FROM s, range(0, 2) t(k) WHERE hi > lo AND depth < 8 AND (SELECT sum(q) FROM i WHERE i.o_custkey = s.o_custkey AND r BETWEEN lo AND hi) > 800)
SELECT o_custkey, lo, hi FROM s WHERE hi = lo OR depth = 8 OR (SELECT sum(q) FROM i WHERE i.o_custkey = s.o_custkey AND r BETWEEN lo AND hi) <= 800""")
def halved_batches(t):
    """Batches over the limit are halved until they fit or are single records, to a depth of eight. Sizes are thousands, halves to the even one."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = t.orders.withColumn("q", F.bround(F.col("o_totalprice") / 1000).cast("long")).select("o_custkey", F.row_number().over(w).cast("long").alias("r"), F.sum("q").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    return packs.halved(rows, "o_custkey", "r", "run", 800, 8)


@query("""SELECT l_orderkey, string_agg(f, ',' ORDER BY n) AS admitted FROM (SELECT l_orderkey, f, n, sum(len) OVER (PARTITION BY l_orderkey ORDER BY n ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT l_orderkey, (l_linenumber, l_partkey, l_suppkey) AS n, 'fact' || l_partkey AS f, length('fact' || l_partkey) + 3 AS len FROM lineitem)) WHERE run <= 30 GROUP BY 1""")
def facts_within_a_size(t):
    """Facts are admitted in their order of priority until the record reaches its size."""
    fact = F.concat(F.lit("fact"), "l_partkey")
    run = F.sum(F.length(fact) + 3).over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, 0))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", fact.alias("f"), run.alias("run")).where("run <= 30")
    facts = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "f"))), lambda x: x["f"])
    return rows.groupBy("l_orderkey").agg(F.array_join(facts, ",").alias("admitted"))
