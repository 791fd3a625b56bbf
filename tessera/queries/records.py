"""Records, versions, identities and configuration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import classify, records
from .registry import query


@query("""SELECT p_partkey, CASE WHEN n = 1 THEN s ELSE s || '-' || n END AS id FROM (SELECT p_partkey, s, row_number() OVER (PARTITION BY s ORDER BY p_partkey) AS n FROM (SELECT p_partkey, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM part))""")
def unique_node_ids(t):
    return records.unique_ids(t.part, "p_type", [F.asc("p_partkey")]).select("p_partkey", "id")


@query("""SELECT o_custkey, 'I-' || substr(sha256('orders' || chr(31) || CAST(count(*) AS VARCHAR) || chr(31) || array_to_string(list_sort(list_distinct(list(CAST(o_orderkey AS VARCHAR)))), ',')), 1, 20) AS item FROM orders GROUP BY o_custkey""")
def stable_item_ids(t):
    rows = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.collect_list(F.col("o_orderkey").cast("string")).alias("ids"))
    return rows.select("o_custkey", records.item_id(F.lit("orders"), F.col("n").cast("string"), F.col("ids")).alias("item"))


@query("""SELECT o_custkey, o_orderkey, (SELECT string_agg(p, ',' ORDER BY k) FROM (SELECT b.o_orderpriority AS p, min(b.o_orderkey) AS k FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderkey <= a.o_orderkey GROUP BY 1 ORDER BY k LIMIT 3)) AS state FROM orders a""")
def cumulative_memory(t):
    rows = records.cumulative(t.orders, ["o_custkey"], ["o_orderkey"], "o_orderpriority", 3)
    return rows.select("o_custkey", "o_orderkey", F.array_join("state", ",").alias("state"))


@query("""SELECT e.user_id, e.event_id, v.event_id AS version FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) v ON e.user_id = v.user_id AND v.ts <= e.ts""")
def versions_as_of(t):
    asks = t.events.where("event_type = 'click'").select("user_id", "event_id", "ts")
    versions = t.events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("version"))
    found = records.as_of(asks.select("user_id", "ts").distinct(), versions, "user_id", "ts", "ts", "version")
    return asks.join(found, ["user_id", "ts"]).select("user_id", "event_id", "version")


@query("""SELECT event_id, CASE WHEN value > 90 THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS clean FROM events""")
def finite_values(t):
    raw = F.when(F.col("value") > 95, F.lit(float("nan"))).when(F.col("value") > 90, F.lit(float("inf"))).otherwise(F.floor("value").cast("double"))
    return t.events.select("event_id", records.finite(raw).cast("long").alias("clean"))


@query("""SELECT event_id, 'active' AS part FROM events WHERE event_type = 'click'
UNION ALL SELECT * FROM (SELECT event_id, 'ended' FROM events WHERE event_type <> 'click' ORDER BY ts DESC, event_id DESC LIMIT 25)""")
def job_queue(t):
    return records.queue(t.events, F.col("event_type") == "click", "ts", "event_id")


@query("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, n_name) AS provider, coalesce(CASE WHEN c_custkey % 5 = 0 THEN 7 END, n_regionkey, 0) AS retries FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""")
def settings_with_overrides(t):
    overrides = t.customer.select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("own"), F.when(F.col("c_custkey") % 5 == 0, 7).alias("own_retries"))
    rows = overrides.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return rows.select("c_custkey", F.coalesce("own", "n_name").alias("provider"), F.coalesce("own_retries", "n_regionkey", F.lit(0)).alias("retries"))


@query("""SELECT coalesce(o_orderkey, k) AS id, CASE WHEN k IS NULL THEN 'missing' WHEN o_orderkey IS NULL THEN 'extra' ELSE 'changed' END AS difference FROM
(SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) % 7 AS size FROM orders) FULL JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON k = o_orderkey WHERE k IS NULL OR o_orderkey IS NULL OR size <> n""")
def fingerprint_differences(t):
    before = t.orders.select("o_orderkey", (F.floor("o_totalprice") % 7).alias("size"))
    after = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    both = before.join(after, F.col("k") == F.col("o_orderkey"), "full_outer").where("k IS NULL OR o_orderkey IS NULL OR size <> n")
    return both.select(F.coalesce("o_orderkey", "k").alias("id"), F.when(F.col("k").isNull(), "missing").when(F.col("o_orderkey").isNull(), "extra").otherwise("changed").alias("difference"))


@query("""SELECT p_partkey, CASE WHEN p_size > 45 THEN 'restricted' WHEN p_size % 7 = 0 THEN 'excluded' WHEN p_type LIKE '%TIN' THEN 'binary' ELSE 'visible' END AS visibility,
CASE split_part(lower(p_type), ' ', -1) WHEN 'brass' THEN 'text/plain' WHEN 'tin' THEN 'application/octet-stream' WHEN 'steel' THEN 'application/json' ELSE 'text/html' END AS mime FROM part""")
def visibility_and_types(t):
    last = F.lower(F.element_at(F.split("p_type", " "), -1))
    visibility = F.when(F.col("p_size") > 45, "restricted").when(F.col("p_size") % 7 == 0, "excluded").when(F.col("p_type").endswith("TIN"), "binary").otherwise("visible")
    types = {"brass": "text/plain", "tin": "application/octet-stream", "steel": "application/json"}
    return t.part.select("p_partkey", visibility.alias("visibility"), classify.looked_up(last, types, "text/html").alias("mime"))


@query("""SELECT doc_id, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1) OR EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id AND label = 9) OR EXISTS (SELECT 1 FROM pages p WHERE p.page_id = d.doc_id AND url LIKE 'http://%') AS restricted FROM documents d""")
def restricted_by_any_table(t):
    keys = t.labels.where("toxic = 1").select("doc_id")
    keys = keys.unionByName(t.embeddings.where("label = 9").select(F.col("vec_id").alias("doc_id"))).unionByName(t.pages.where("url LIKE 'http://%'").select(F.col("page_id").alias("doc_id"))).distinct()
    return t.documents.select("doc_id").join(keys.withColumn("hit", F.lit(True)), "doc_id", "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("restricted"))


@query(r"""SELECT page_id, len(list_filter(string_split(lower(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)), '/'), lambda x: x IN ('en', 'login', 'signin', 'home', 'index'))) > 0 AS landing FROM pages""")
def landing_pages(t):
    path = F.lower(F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1))
    return t.pages.select("page_id", F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, ["en", "login", "signin", "home", "index"]))).alias("landing"))


@query("""SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'Speaker ' || conv_id % 7 ELSE 'Host' END AS speaker, upper(substr(trim(text), 1, 1)) || lower(substr(trim(text), 2, 60)) AS opening FROM conversations""")
def sentence_cased_openings(t):
    said = F.trim("text")
    speaker = F.when(F.col("role") == "user", F.concat(F.lit("Speaker "), F.col("conv_id") % 7)).otherwise("Host")
    return t.conversations.select("conv_id", "turn", speaker.alias("speaker"), F.concat(F.upper(F.substring(said, 1, 1)), F.lower(F.substring(said, 2, 60))).alias("opening"))


@query("""SELECT source, CAST(sum(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))) AS BIGINT) AS lines, CAST(max(len(string_split(text, chr(10)))) AS BIGINT) AS most FROM documents GROUP BY source""")
def line_counts(t):
    lines = F.split("text", "\n")
    return t.documents.groupBy("source").agg(F.sum(F.size(F.filter(lines, lambda x: F.trim(x) != ""))).alias("lines"), F.max(F.size(lines)).cast("long").alias("most"))


@query("""WITH d AS (SELECT doc_id, text || ' ' || to_base64(unhex(sha256(text))) || ' ' || sha256(text) AS body FROM documents), w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(body, '[A-Za-z0-9_+/=-]{32,200}'))) AS token FROM d),
c AS (SELECT doc_id, token, unnest(string_split(token, '')) AS c FROM w), n AS (SELECT doc_id, token, count(*) AS k, sum(count(*)) OVER (PARTITION BY doc_id, token) AS total FROM c GROUP BY doc_id, token, c), e AS (SELECT doc_id, token, CAST(round(-sum(k / total * log2(k / total)) * 1000) AS BIGINT) AS millibits FROM n GROUP BY ALL)
SELECT doc_id, max(millibits) AS millibits, count(*) AS tokens FROM e WHERE millibits >= 4300 GROUP BY doc_id""")
def entropies_of_tokens(t):
    """The most surprising long token of each document, by the entropy of its characters; bodies end with two digests."""
    digest = F.sha2("text", 256)
    body = F.concat_ws(" ", "text", F.base64(F.unhex(digest)), digest)
    words = t.documents.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(body, F.lit("[A-Za-z0-9_+/=-]{32,200}"), F.lit(0)))).alias("token"))
    return words.withColumn("millibits", F.round(fn.entropy(F.col("token")) * 1000).cast("long")).where("millibits >= 4300").groupBy("doc_id").agg(F.max("millibits").alias("millibits"), F.count("*").alias("tokens"))
