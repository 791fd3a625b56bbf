"""Whole journeys: a snapshot from its files to its index, a reduction to a writer's envelope, steps that a run selects, hosts that are admitted."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hosts
from ..operators import classify, jobs
from ..plans import reduce
from ..sources import captions
from ..sources.shared import written
from .planning import _PLAN, _known, _plan
from .registry import query
from .scan import _BUDGET, _LADDER, _laddered


@query(f"""WITH RECURSIVE {_LADDER}, n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY path) AS r FROM ladder),
g AS (SELECT doc_id, source, path, r, CASE WHEN reason IS NOT NULL THEN reason WHEN size > {_BUDGET} THEN 'index_budget' END AS reason, CASE WHEN reason IS NULL AND size <= {_BUDGET} THEN size ELSE 0 END AS used FROM n WHERE r = 1
UNION ALL SELECT n.doc_id, n.source, n.path, n.r, CASE WHEN n.reason IS NOT NULL THEN n.reason WHEN used + size > {_BUDGET} THEN 'index_budget' END, CASE WHEN n.reason IS NULL AND used + size <= {_BUDGET} THEN used + size ELSE used END FROM g JOIN n ON n.source = g.source AND n.r = g.r + 1),
k AS (SELECT g.source, g.reason, g.path, len(string_split(text, chr(10))) AS lines FROM g JOIN documents USING (doc_id))
SELECT source, count(*) AS files, count(*) FILTER (reason IS NULL) AS indexed, count(*) FILTER (reason = 'index_budget') AS beyond_budget, coalesce(CAST(sum((lines + 19) // 20) FILTER (reason IS NULL) AS BIGINT), 0) AS chunks, sha256(string_agg(path || ':' || coalesce(reason, ''), chr(10) ORDER BY path)) AS manifest FROM k GROUP BY source""")
def scanned_snapshots(t):
    """Files are classified, left out for the first reason that holds or for the budget, redacted, and cut into chunks of twenty lines; coverage and manifest are published with them."""
    rows = _laddered(t).select("doc_id", "source", "path", "size", "reason")
    decided = written(classify.within_budget(rows, ["source"], "path", "size", "size", _BUDGET), "decided")
    kept = decided.where("reason IS NULL").select("doc_id", "source").join(t.documents.select("doc_id", classify.redacted(F.col("text")).alias("text")), "doc_id")
    lines = captions.numbered(kept, "doc_id", "text").join(kept.select("doc_id", "source"), "doc_id")
    chunks = lines.select("source", "doc_id", F.floor((F.col("line_number") - 1) / 20).alias("chunk")).distinct().groupBy("source").agg(F.count("*").alias("chunks"))
    manifest = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", F.concat_ws(":", "path", F.coalesce("reason", F.lit(""))).alias("entry")))), lambda x: x["entry"]), "\n")
    counts = decided.groupBy("source").agg(F.count("*").alias("files"), F.count_if(F.col("reason").isNull()).alias("indexed"), F.count_if(F.coalesce(F.col("reason") == "index_budget", F.lit(False))).alias("beyond_budget"), F.sha2(manifest, 256).alias("manifest"))
    return counts.join(chunks, "source", "left").select("source", "files", "indexed", "beyond_budget", F.coalesce("chunks", F.lit(0)).alias("chunks"), "manifest")


@query("""SELECT conv_id, count(*) AS turns, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS ids, sha256('title: ' || conv_id || chr(10) || 'turns: ' || count(*) || chr(10) || string_agg(turn::VARCHAR, ',' ORDER BY turn)) AS prefix FROM conversations GROUP BY conv_id""")
def writer_envelopes(t):
    """Records are reduced level by level until each conversation fits its writer's budget; no id is lost, and the prompt's prefix is exact."""
    items = t.conversations.select("conv_id", "turn", F.greatest(F.lit(1), F.ceil(F.length("text") / 4)).alias("size"))
    out = reduce.reduced(items, "conv_id", "turn", "size", 6000, 4, 20)
    ids = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    rows = out.select("conv_id", F.size("ids").cast("long").alias("turns"), ids.alias("ids"))
    prefix = F.concat(F.lit("title: "), "conv_id", F.lit("\nturns: "), "turns", F.lit("\n"), "ids")
    return rows.withColumn("prefix", F.sha2(prefix, 256))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'n' || c_nationkey AS step, 'n' || c_nationkey // 2 AS needs FROM customer WHERE c_nationkey > 0), s AS (SELECT DISTINCT 'n' || s_nationkey AS step FROM supplier WHERE s_acctbal > 8000 UNION SELECT e.needs FROM s JOIN e USING (step))
SELECT step FROM s WHERE step IN (SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey <> 2)""")
def selected_steps(t):
    """Explicit steps, closed over what they need, as far as they apply."""
    edges = t.customer.where("c_nationkey > 0").select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("n"), F.floor(F.col("c_nationkey") / 2).cast("string")).alias("dst")).distinct()
    seeds = t.supplier.where("s_acctbal > 8000").select(F.concat(F.lit("n"), "s_nationkey").alias("node"))
    applicable = t.nation.where("n_regionkey <> 2").select(F.concat(F.lit("n"), "n_nationkey").alias("step"))
    return jobs.closure(edges, seeds, include=True).select(F.col("node").alias("step")).join(applicable, "step", "left_semi")


@query(f"""WITH {_PLAN} SELECT series, count(DISTINCT id) AS assigned, count(*) FILTER (role = 'bridge') AS bridges, count(DISTINCT id) FILTER (importance = 'critical') AS critical, (SELECT count(*) FROM known) - count(DISTINCT id) AS omitted FROM plan JOIN known USING (id) GROUP BY series""")
def plan_coverage(t):
    known = _known(t)
    total = known.agg(F.count("*").alias("total"))
    rows = _plan(t).join(known, "id").groupBy("series").agg(F.countDistinct("id").alias("assigned"), F.count_if(F.col("role") == "bridge").alias("bridges"), F.countDistinct(F.when(F.col("importance") == "critical", F.col("id"))).alias("critical"))
    return rows.crossJoin(F.broadcast(total)).select("series", "assigned", "bridges", "critical", (F.col("total") - F.col("assigned")).alias("omitted"))  # total: one row


_H = "sha256(url)"
_O = [f"('0x' || substr({_H}, {i}, 2))::INT" for i in (1, 3, 5, 7)]
_G = [f"substr({_H}, {i}, 4)" for i in range(2, 30, 4)]


@query(f"""WITH p AS (SELECT page_id, url, {', '.join(f'{x} AS o{i}' for i, x in enumerate(_O))} FROM pages),
n AS (SELECT page_id, 'name' AS kind, CASE WHEN url LIKE '%://%' THEN lower(regexp_extract(url, '^[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]*)', 1)) END AS host FROM pages),
v AS (SELECT page_id, 'four' AS kind, CASE WHEN NOT (o0 IN (0, 10, 127) OR o0 >= 224 OR (o0 = 100 AND o1 BETWEEN 64 AND 127) OR (o0 = 168 AND o1 = 63 AND o2 = 129 AND o3 = 16) OR (o0 = 169 AND o1 = 254) OR (o0 = 172 AND o1 BETWEEN 16 AND 31)
OR (o0 = 192 AND ((o1 = 0 AND o2 IN (0, 2)) OR o1 = 168)) OR (o0 = 198 AND (o1 IN (18, 19) OR (o1 = 51 AND o2 = 100))) OR (o0 = 203 AND o1 = 0 AND o2 = 113)) THEN o0 || '.' || o1 || '.' || o2 || '.' || o3 END AS host FROM p),
s AS (SELECT page_id, 'six' AS kind, '2' || substr({_H}, 1, 3) AS first, {" || ':' || ".join(f"regexp_replace({g}, '^0{{1,3}}', '')" for g in _G)} AS rest FROM pages)
SELECT page_id, kind, CASE WHEN regexp_matches(host, '^([a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?[.])+[a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?$') AND NOT regexp_matches(host, '[.](local|localhost|internal|home[.]arpa)$') AND NOT regexp_matches(host, '^[0-9.]+$') THEN host END AS host FROM n
UNION ALL SELECT * FROM v UNION ALL SELECT page_id, kind, CASE WHEN first <> '2002' AND NOT (first = '2001' AND (rest < '2' OR rest LIKE '_:%' OR rest LIKE '__:%' OR rest LIKE 'db8:%')) THEN first || ':' || rest END FROM s""")
def admitted_hosts(t):
    """Pages' hosts, and addresses of both kinds drawn from their URLs' digests."""
    digest = F.sha2("url", 256)
    byte = lambda i: F.conv(F.substring(digest, i, 2), 16, 10)
    six = F.concat_ws(":", F.concat(F.lit("2"), F.substring(digest, 1, 3)), *(F.substring(digest, i, 4) for i in range(2, 30, 4)))
    name = F.concat(F.upper(F.regexp_extract("url", r"^[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]*)", 1)), F.lit("."))
    given = {"name": name, "four": F.concat_ws(".", *map(byte, (1, 3, 5, 7))), "six": six}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("given")) for k, v in given.items()))).alias("x")
    return hosts.normalised(t.pages.select("page_id", each).select("page_id", "x.kind", F.col("x.given").alias("host")), "host")
