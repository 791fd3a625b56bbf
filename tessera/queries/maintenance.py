"""Upserts, replacement, cascades and caches over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import maintenance
from .registry import query


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'good' END, d.source) AS source, coalesce(l.toxic = 1, FALSE) OR coalesce(d.n_chars > 5000, FALSE) AS restricted
FROM documents d FULL JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id""")
def upserted_documents(t):
    existing = t.documents.select("doc_id", "source", (F.col("n_chars") > 5000).alias("restricted"))
    labels = t.labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    incoming = labels.select("doc_id", F.when(F.col("quality") == 1, "good").alias("source"), (F.col("toxic") == 1).alias("restricted"))
    return maintenance.upserted(existing, incoming, ["doc_id"], ["restricted"])


@query("""SELECT conv_id, turn, FALSE AS fresh FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')
UNION ALL SELECT conv_id, turn, TRUE FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system') AND role <> 'system'""")
def replaced_chunks(t):
    rows = t.conversations.select("conv_id", "turn", F.lit(False).alias("fresh"))
    renewed = t.conversations.where("role = 'system'").select("conv_id").distinct()
    fresh = t.conversations.join(renewed, "conv_id", "left_semi").where("role <> 'system'").select("conv_id", "turn", F.lit(True).alias("fresh"))
    stale = rows.join(renewed, "conv_id", "left_anti")
    return maintenance.replaced(stale, fresh, "conv_id")


@query("""WITH w AS (SELECT c_custkey FROM customer WHERE c_acctbal < 2000), f AS (SELECT o_custkey AS c_custkey, 'running job' AS reason FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 300 UNION ALL SELECT user_id, 'live lease' FROM events WHERE event_type = 'signup' AND value > 30),
r AS (SELECT c_custkey, min(reason) AS reason FROM w JOIN f USING (c_custkey) GROUP BY c_custkey), g AS (SELECT c_custkey FROM w ANTI JOIN r USING (c_custkey)), o AS (SELECT o_orderkey, o_custkey FROM orders SEMI JOIN g ON c_custkey = o_custkey)
SELECT 'customer' AS kind, CAST(count(*) AS BIGINT) AS n FROM g UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'lineitem', count(*) FROM lineitem SEMI JOIN o ON o_orderkey = l_orderkey UNION ALL SELECT 'events', count(*) FROM events SEMI JOIN g ON c_custkey = user_id
UNION ALL SELECT 'refused: ' || reason, count(*) FROM r GROUP BY reason""")
def left_after_cascade(t):
    """Customers go with their orders, those orders' lines, and their events, unless a running job or a live lease holds them."""
    tables = {"customer": t.customer, "orders": t.orders.select("o_orderkey", "o_custkey"), "lineitem": t.lineitem.select("l_orderkey", "l_linenumber"), "events": t.events.select("event_id", "user_id")}
    tables |= {"running": t.orders.where("o_orderstatus = 'P' AND o_totalprice > 300"), "leases": t.events.where("event_type = 'signup' AND value > 30")}
    links = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("events", "user_id", "customer", "c_custkey")]
    gone = maintenance.cascade(tables, links, ("customer", "c_custkey", t.customer.where("c_acctbal < 2000")), [("running job", "running", "o_custkey"), ("live lease", "leases", "user_id")])
    counts = [gone[name].agg(F.lit(name).alias("kind"), F.count("*").alias("n")) for name in ("customer", "orders", "lineitem", "events")]
    held = gone["refused"].groupBy("c_custkey").agg(F.min("reason").alias("reason")).groupBy(F.concat(F.lit("refused: "), "reason").alias("kind")).agg(F.count("*").alias("n"))
    out = held
    for c in counts:
        out = out.unionByName(c)
    return out


@query("""SELECT text_hash, min(first_id) AS first_id FROM (SELECT sha256(text) AS text_hash, min(doc_id) AS first_id, 0 AS w FROM documents WHERE lang = 'en' GROUP BY text
UNION ALL SELECT sha256(text), min(doc_id), 1 FROM documents WHERE lang <> 'en' AND text NOT IN (SELECT text FROM documents WHERE lang = 'en') GROUP BY text) GROUP BY text_hash""")
def cache_after_insert(t):
    hashed = t.documents.withColumn("text_hash", F.sha2("text", 256))
    of = lambda rows: rows.groupBy("text_hash").agg(F.min("doc_id").alias("first_id"))
    return maintenance.inserted_if_absent(of(hashed.where("lang = 'en'")), of(hashed.where("lang <> 'en'")), ["text_hash"])


@query("""SELECT doc_id, coalesce(lang, 'und') AS lang, 'none' AS provider, 0 AS version FROM documents""")
def evolved_documents(t):
    return maintenance.evolved(t.documents.select("doc_id", "lang"), {"lang": "und", "provider": "none", "version": 0})
