"""Views of a library: projects with their policies, documents, references, jobs and files joined, filtered and counted."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.search import clamped, first_per
from .registry import query
from .scan import FILES, files

#: Sources are projects; their numbers decide what a policy table would hold.
PROJECTS = "projects AS (SELECT source, k, k % 9 = 4 AS deleting, k % 6 = 1 AS restricted, k % 5 = 0 AS repository, k % 2 = 0 AS cloud FROM (SELECT DISTINCT source, CAST(substr(source, 4) AS INTEGER) AS k FROM documents))"


def projects(t):
    k = F.col("k")
    rows = t.documents.select("source").distinct().withColumn("k", F.substring("source", 4, 9).cast("int"))
    return rows.select("source", "k", (k % 9 == 4).alias("deleting"), (k % 6 == 1).alias("restricted"), (k % 5 == 0).alias("repository"), (k % 2 == 0).alias("cloud"))


@query("""WITH r AS (SELECT item_id, coalesce(CASE WHEN item_id % 3 = 0 THEN 'src' || item_id % 7 END, 'src' || item_id % 25) AS source FROM benchmark)
SELECT item_id, count(doc_id) AS documents, count(DISTINCT lang) AS langs FROM r LEFT JOIN documents USING (source) GROUP BY item_id""")
def documents_of_named_projects(t):
    """A project's id wins over its slug; an unknown slug gives an empty result with empty facets."""
    by_id = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("src"), (F.col("item_id") % 7).cast("string")))
    asked = t.benchmark.select("item_id", F.coalesce(by_id, F.concat(F.lit("src"), (F.col("item_id") % 25).cast("string"))).alias("source"))
    own = t.documents.groupBy("source").agg(F.count("*").alias("documents"), F.countDistinct("lang").alias("langs"))
    return asked.join(own, "source", "left").select("item_id", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("langs", F.lit(0)).alias("langs"))


@query("SELECT doc_id, substr(text, 1, 20) AS title FROM documents WHERE contains(lower(text), 'the') AND lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 200")
def documents_by_length(t):
    rows = t.documents.where(F.contains(F.lower("text"), F.lit("the")) & (F.col("lang") == "en"))
    return rows.orderBy(F.desc("n_chars"), "doc_id").limit(clamped(200, 1, 500)).select("doc_id", F.substring("text", 1, 20).alias("title"))


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL AND toxic IS NULL AND lang = 'en'")
def documents_without_a_scope(t):
    return t.documents.where("lang = 'en'").select("doc_id").join(t.labels.where("quality IS NOT NULL OR toxic IS NOT NULL"), "doc_id", "left_anti")


@query(f"""WITH {PROJECTS} SELECT doc_id, coalesce(toxic = 1, false) OR deleting OR restricted OR repository AS excluded, coalesce(toxic = 1, false) OR repository AS derived,
n_chars > 0 AND lang IN ('en', 'de') AND cloud AS cloud_primary, lang IN ('en', 'de') AND cloud AND NOT (coalesce(toxic = 1, false) OR deleting OR restricted) AS eligible FROM documents JOIN projects USING (source) LEFT JOIN labels USING (doc_id)""")
def cloud_flags(t):
    flag, kind = F.coalesce(F.col("toxic") == 1, F.lit(False)), F.col("lang").isin("en", "de")
    rows = t.documents.select("doc_id", "source", "lang", "n_chars").join(projects(t), "source").join(t.labels.select("doc_id", "toxic"), "doc_id", "left")
    return rows.select(
        "doc_id",
        (flag | F.col("deleting") | F.col("restricted") | F.col("repository")).alias("excluded"),
        (flag | F.col("repository")).alias("derived"),
        ((F.col("n_chars") > 0) & kind & F.col("cloud")).alias("cloud_primary"),
        (kind & F.col("cloud") & ~(flag | F.col("deleting") | F.col("restricted"))).alias("eligible"),
    )


@query("SELECT conv_id, turn, length(text) AS chars FROM conversations WHERE role = 'user' AND turn < 4 ORDER BY conv_id, turn")
def evidence_of_a_kind(t):
    return t.conversations.where("role = 'user' AND turn < 4").select("conv_id", "turn", F.length("text").cast("long").alias("chars")).orderBy("conv_id", "turn")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'signup' AND user_id % 2 = 0 ORDER BY ts DESC, event_id DESC LIMIT 1000")
def newest_jobs(t):
    rows = t.events.where("event_type <> 'signup' AND user_id % 2 = 0")
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(clamped(5000, 1, 1000)).select("event_id", "user_id", "event_type")


@query("""WITH s AS (SELECT lower(p_brand) || '.' || p_partkey AS key, '{"v": ' || p_size || '}' AS value FROM part) SELECT key, coalesce(CAST(json_extract_string(value, '$.v') AS INTEGER), 0) AS v FROM s WHERE NOT (key IN ('brand#2.0', 'brand#17.1') OR key LIKE 'brand#1.%') AND key NOT LIKE 'brand#3.%'""")
def settings_without_secrets(t):
    """Keys that are secret, by name or by prefix, and keys of a deleted prefix don't show; values are parsed, with a default."""
    rows = t.part.select(F.concat(F.lower("p_brand"), F.lit("."), "p_partkey").alias("key"), F.concat(F.lit('{"v": '), "p_size", F.lit("}")).alias("value"))
    secret = F.col("key").isin("brand#2.0", "brand#17.1") | F.col("key").startswith("brand#1.")
    return rows.where(~secret & ~F.col("key").startswith("brand#3.")).select("key", F.coalesce(F.get_json_object("value", "$.v").cast("int"), F.lit(0)).alias("v"))


_POOR = "poor AS (SELECT doc_id FROM labels WHERE quality = 0 UNION SELECT doc_id FROM documents WHERE n_chars < 60)"


@query(f"""WITH {_POOR}, ack AS (SELECT doc_id FROM documents WHERE lang = 'en'), left_ AS (SELECT doc_id FROM poor EXCEPT SELECT doc_id FROM ack),
n AS (SELECT source, count(*) FILTER (doc_id IN (SELECT doc_id FROM left_)) AS pages FROM documents GROUP BY source)
SELECT source, pages, CASE WHEN pages > 0 THEN 'pages' WHEN CAST(substr(source, 4) AS INTEGER) % 4 = 0 THEN 'document' END AS blocker FROM n""")
def quality_blockers(t):
    """Poor pages that nobody acknowledged block; where none is left, a document-level finding does."""
    poor = t.labels.where("quality = 0").select("doc_id").union(t.documents.where("n_chars < 60").select("doc_id")).distinct()
    left = poor.join(t.documents.where("lang = 'en'"), "doc_id", "left_anti").withColumn("open", F.lit(1))
    n = t.documents.select("doc_id", "source").join(left, "doc_id", "left").groupBy("source").agg(F.count("open").alias("pages"))
    return n.select("source", "pages", F.when(F.col("pages") > 0, "pages").when(F.substring("source", 4, 9).cast("int") % 4 == 0, "document").alias("blocker"))


@query("""WITH f AS (SELECT event_id, unnest(['["x", "' || replace(event_type, 'error', 'critical') || '"]', '{"critical": ' || (value > 20) || '}', '{"critical": "' || event_type || '"}', props, event_type]) AS j, generate_subscripts([1, 2, 3, 4, 5], 1) AS form FROM events)
SELECT event_id, form FROM f WHERE json_valid(j) AND CASE json_type(j) WHEN 'ARRAY' THEN list_contains(j::VARCHAR[], 'critical') WHEN 'OBJECT' THEN json_extract_string(j, '$.critical') = 'true' ELSE false END""")
def critical_flags(t):
    """Flags are a JSON array of names or an object of booleans; what is neither is no flag."""
    kind, quoted = F.replace("event_type", F.lit("error"), F.lit("critical")), lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    forms = [F.concat(F.lit('["x", '), quoted(kind), F.lit("]")), F.concat(F.lit('{"critical": '), (F.col("value") > 20).cast("string"), F.lit("}")), F.concat(F.lit('{"critical": '), quoted(F.col("event_type")), F.lit("}")), F.col("props"), F.col("event_type")]
    rows = t.events.select("event_id", F.posexplode(F.array(*forms)).alias("form", "flags"))
    named = F.array_contains(F.from_json("flags", "array<string>"), "critical")
    held = F.coalesce(named, F.lit(False)) | F.coalesce(F.get_json_object("flags", "$.critical") == "true", F.lit(False))
    return rows.where(held).select("event_id", (F.col("form") + 1).cast("long").alias("form"))


@query(f"WITH {FILES} SELECT doc_id, path FROM files WHERE sfx <> '.png' AND size < 6000 ORDER BY path")
def current_files(t):
    rows = files(t).where(~F.lower("path").endswith(".png") & (F.col("size") < 6000))
    return rows.select("doc_id", "path").orderBy("path")


@query("SELECT page_id FROM pages WHERE regexp_matches(url, '^https://([^/]*[.])?example[.]com/en(/|$)')")
def recordings(t):
    """Host suffix and path prefix."""
    host, path = F.parse_url("url", F.lit("HOST")), F.parse_url("url", F.lit("PATH"))
    below = (host == "example.com") | host.endswith(".example.com")
    return t.pages.where(F.col("url").startswith("https://") & below & ((path == "/en") | path.startswith("/en/"))).select("page_id")


@query(r"""WITH s AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1) AS h, sha256(url) AS d FROM pages),
u AS (SELECT page_id, unnest([url, replace(url, 'https:', 'http:'), replace(url, 'https:', 'gopher:'), replace(url, '://', '://' || page_id || ':pw@'), replace(url, h, h || ':' || page_id % 9000), replace(url, h, 'localhost'), replace(url, h, split_part(h, '.', 1)), replace(url, h, split_part(h, '.', 1) || '.local'),
replace(url, h, ('0x' || substr(d, 1, 2))::INT || '.' || ('0x' || substr(d, 3, 2))::INT || '.0.7'), replace(url, h, '172.' || ('0x' || substr(d, 5, 2))::INT || '.1.1')]) AS u FROM s), p AS (SELECT *, regexp_extract(u, '^[a-z]+://(?:[^/@]*@)?([^/:?#]*)', 1) AS host FROM u)
SELECT page_id, u, CASE WHEN NOT regexp_matches(u, '^https?://') THEN 'scheme' WHEN regexp_matches(u, '^[a-z]+://[^/]*@') THEN 'credentials' WHEN regexp_matches(u, '^[a-z]+://[^/]*:[0-9]+') THEN 'port' WHEN host = 'localhost' OR host LIKE '%.local' THEN 'reserved'
WHEN host LIKE '0.%' OR host LIKE '10.%' OR host LIKE '127.%' OR host LIKE '192.168.%' OR host LIKE '169.254.%' OR regexp_matches(host, '^172[.](1[6-9]|2[0-9]|3[01])[.]') THEN 'private' WHEN host NOT LIKE '%.%' THEN 'single_label' END AS reason FROM p""")
def admitted_urls(t):
    """The first reason to refuse a source's address, or null: of each page's URL as it is, and with another scheme, with credentials, a port, or another host drawn from it."""
    host, digest = F.regexp_extract("url", "^[a-z]+://([^/:?#]*)", 1), F.sha2("url", 256)
    byte = lambda i: F.conv(F.substring(digest, i, 2), 16, 10)
    first = F.split_part(host, F.lit("."), F.lit(1))
    at = lambda new: F.replace("url", host, new)
    to = lambda old, new: F.replace("url", F.lit(old), new if not isinstance(new, str) else F.lit(new))
    forms = [F.col("url"), to("https:", "http:"), to("https:", "gopher:"), to("://", F.concat(F.lit("://"), "page_id", F.lit(":pw@"))), at(F.concat(host, F.lit(":"), F.col("page_id") % 9000)), at(F.lit("localhost")), at(first), at(F.concat(first, F.lit(".local")))]
    forms += [at(F.concat(byte(1), F.lit("."), byte(3), F.lit(".0.7"))), at(F.concat(F.lit("172."), byte(5), F.lit(".1.1")))]
    rows = t.pages.select("page_id", F.explode(F.array(*forms)).alias("u")).withColumn("host", F.regexp_extract("u", r"^[a-z]+://(?:[^/@]*@)?([^/:?#]*)", 1))
    u, host = F.col("u"), F.col("host")
    private = host.rlike(r"^(?:10|127)\.|^192\.168\.|^169\.254\.|^172\.(?:1[6-9]|2[0-9]|3[01])\.|^0\.")
    reason = F.when(~u.rlike("^https?://"), "scheme").when(u.rlike("^[a-z]+://[^/]*@"), "credentials").when(u.rlike("^[a-z]+://[^/]*:[0-9]+"), "port").when((host == "localhost") | host.endswith(".local"), "reserved")
    return rows.select("page_id", "u", reason.when(private, "private").when(~F.contains(host, F.lit(".")), "single_label").alias("reason"))


@query(f"""WITH {PROJECTS}, steps AS (SELECT unnest(['ingest', 'download', 'transcribe', 'snapshot', 'write']) AS step), done AS (SELECT DISTINCT 'src' || user_id % 20 AS source, event_type FROM events WHERE value > 90)
SELECT source, step, CASE step WHEN 'ingest' THEN k % 2 = 0 OR EXISTS (SELECT 1 FROM documents d WHERE d.source = p.source AND n_chars > 9000) WHEN 'snapshot' THEN repository AND EXISTS (SELECT 1 FROM done WHERE done.source = p.source AND event_type = 'view')
WHEN 'write' THEN EXISTS (SELECT 1 FROM documents d WHERE d.source = p.source AND lang = 'es' AND n_chars > 4000) ELSE EXISTS (SELECT 1 FROM done WHERE done.source = p.source AND event_type = 'click') END AS done FROM projects p, steps WHERE NOT (step = 'download' AND k % 3 = 0)""")
def steps_done(t):
    """Applicable steps of each project (no download where nothing is to be fetched) and whether each is done: some by special rules, others by their output."""
    output = t.documents.groupBy("source").agg(F.bool_or(F.col("n_chars") > 9000).alias("long"), F.bool_or((F.col("lang") == "es") & (F.col("n_chars") > 4000)).alias("written"))
    ran = t.events.where("value > 90").groupBy(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source")).agg(F.bool_or(F.col("event_type") == "view").alias("viewed"), F.bool_or(F.col("event_type") == "click").alias("clicked"))
    steps = F.explode(F.array(*map(F.lit, ["ingest", "download", "transcribe", "snapshot", "write"])))
    rows = projects(t).join(output, "source").join(ran, "source", "left").withColumn("step", steps).where(~((F.col("step") == "download") & (F.col("k") % 3 == 0)))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    done = F.when(F.col("step") == "ingest", (F.col("k") % 2 == 0) | F.col("long")).when(F.col("step") == "snapshot", F.col("repository") & yes("viewed")).when(F.col("step") == "write", F.col("written")).otherwise(yes("clicked"))
    return rows.select("source", "step", done.alias("done"))


@query("SELECT p_partkey FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_size = 50) OR p_brand || p_type IN (SELECT p_brand || p_type FROM part WHERE p_size = 49)")
def forbidden_paths(t):
    """A path is forbidden if an excluded document has it as its own or as its media's; one equi-join on either key."""
    banned = t.part.where("p_size = 50").select(F.col("p_name").alias("key")).union(t.part.where("p_size = 49").select(F.concat("p_brand", "p_type").alias("key"))).distinct()
    keys = t.part.select("p_partkey", F.explode(F.array("p_name", F.concat("p_brand", "p_type"))).alias("key"))
    return keys.join(banned, "key", "left_semi").select("p_partkey").distinct()


@query("SELECT p_brand, array_to_string(list_sort(list_distinct(list(lower(split_part(p_name, ' ', 2))))), ',') AS frameworks FROM part WHERE lower(split_part(p_name, ' ', 2)) IN ('ring', 'bolt', 'gear') GROUP BY p_brand")
def known_frameworks(t):
    name = F.lower(F.split_part("p_name", F.lit(" "), F.lit(2)))
    return t.part.where(name.isin("ring", "bolt", "gear")).groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set(name)), ",").alias("frameworks"))


@query("SELECT o_orderkey, l_linenumber, length(p_name) AS chars FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus = 'F' AND l_quantity > 45")
def chunks_of_snapshots(t):
    lines = t.lineitem.where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    rows = lines.join(t.orders.where("o_orderstatus = 'F'").select("o_orderkey"), "o_orderkey").join(t.part.select("p_partkey", F.length("p_name").cast("long").alias("chars")), "p_partkey")
    return rows.select("o_orderkey", "l_linenumber", "chars")


@query("""SELECT l_partkey, o_orderkey, l_linenumber FROM (SELECT l_partkey, o_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY o_orderdate DESC, o_orderkey DESC, l_linenumber DESC) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND l_returnflag <> 'N') WHERE n = 1""")
def reusable_summaries(t):
    """The newest row of each content, by one aggregation."""
    customers = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    lines = t.lineitem.where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    rows = lines.join(t.orders.select("o_orderkey", "o_custkey", "o_orderdate").join(customers, "o_custkey", "left_semi"), "o_orderkey")
    return rows.groupBy("l_partkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "l_linenumber")).alias("x")).select("l_partkey", "x.o_orderkey", "x.l_linenumber")


@query("""WITH c AS (SELECT doc_id, unnest([doc_id, doc_id + 1, doc_id + 900]) AS cited, doc_id % 9 AS lo, n_chars % 40 AS hi FROM documents)
SELECT c.doc_id, cited, CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN lo < 1 OR lo > hi OR hi > d.n_chars THEN 'range' END AS problem FROM c LEFT JOIN documents d ON d.doc_id = cited WHERE d.doc_id IS NULL OR lo < 1 OR lo > hi OR hi > d.n_chars""")
def invalid_citations(t):
    cited = t.documents.select("doc_id", F.explode(F.array("doc_id", F.col("doc_id") + 1, F.col("doc_id") + 900)).alias("cited"), (F.col("doc_id") % 9).alias("lo"), (F.col("n_chars") % 40).alias("hi"))
    rows = cited.join(t.documents.select(F.col("doc_id").alias("cited"), F.col("n_chars").alias("lines")), "cited", "left")
    problem = F.when(F.col("lines").isNull(), "missing").when((F.col("lo") < 1) | (F.col("lo") > F.col("hi")) | (F.col("hi") > F.col("lines")), "range")
    return rows.withColumn("problem", problem).where("problem IS NOT NULL").select("doc_id", "cited", "problem")


@query("""SELECT doc_id FROM documents WHERE source = 'src3' UNION SELECT doc_id FROM labels JOIN documents USING (doc_id) WHERE quality = 1 AND lang = 'fr'""")
def documents_of_a_project_and_its_references(t):
    own = t.documents.where("source = 'src3'").select("doc_id")
    linked = t.documents.where("lang = 'fr'").select("doc_id").join(t.labels.where("quality = 1"), "doc_id", "left_semi")
    return own.union(linked).dropDuplicates(["doc_id"])


@query("""SELECT p_brand, count(DISTINCT s_name) AS contributors, bool_or(coalesce(s_acctbal < 0, true)) AS restricted FROM part LEFT JOIN supplier ON s_suppkey = p_partkey % 130 GROUP BY p_brand""")
def references_with_contributors(t):
    """A reference whose document is missing counts as restricted."""
    own = t.part.select("p_brand", (F.col("p_partkey") % 130).alias("s_suppkey")).join(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), "s_suppkey", "left")
    return own.groupBy("p_brand").agg(F.countDistinct("s_name").alias("contributors"), F.bool_or(F.coalesce(F.col("s_acctbal") < 0, F.lit(True))).alias("restricted"))


@query(f"WITH {PROJECTS} SELECT source FROM projects WHERE cloud UNION SELECT source FROM projects WHERE deleting ORDER BY source")
def cloud_projects(t):
    rows = projects(t)
    return rows.where("cloud").select("source").union(rows.where("deleting").select("source")).distinct().orderBy("source")


@query("""WITH l AS (SELECT event_id, user_id, ts + INTERVAL 240 MINUTE AS expires FROM events WHERE event_type = 'signup'), n AS (SELECT max(ts) - INTERVAL 1 DAY AS now FROM events)
SELECT user_id, count(*) FILTER (expires > now) AS live, count(*) FILTER (expires <= now) AS expired FROM l, n GROUP BY user_id HAVING count(*) FILTER (expires > now) > 0""")
def projects_with_live_leases(t):
    now = t.events.agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("now"))
    leases = t.events.where("event_type = 'signup'").select("user_id", (F.col("ts") + F.expr("INTERVAL 240 MINUTES")).alias("expires")).crossJoin(F.broadcast(now))
    counted = leases.groupBy("user_id").agg(F.count_if(F.col("expires") > F.col("now")).alias("live"), F.count_if(F.col("expires") <= F.col("now")).alias("expired"))
    return counted.where("live > 0")


@query("""SELECT DISTINCT o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' AND l_linestatus = 'F' AND l_discount = 0.1""")
def verified_remote_sources(t):
    lines = t.lineitem.where("l_linestatus = 'F' AND l_discount = 0.1").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.where("o_orderstatus = 'O'").select("o_orderkey").join(lines, "o_orderkey", "left_semi")


@query("""WITH topics AS (SELECT o_orderkey AS topic, list_distinct(list(l_partkey)) AS ids FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' GROUP BY 1), parts AS (SELECT p_size AS position, list(p_partkey) AS ids FROM part WHERE p_size < 12 GROUP BY 1)
SELECT topic, min(position) AS position FROM topics LEFT JOIN parts ON list_has_any(topics.ids, parts.ids) GROUP BY topic""")
def parts_of_topics(t):
    """A topic's first part, by position, that shares evidence with it; overlap is an equi-join on evidence ids."""
    topics = t.lineitem.join(t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").select(F.col("l_orderkey").alias("topic"), F.col("l_partkey").alias("p_partkey"))
    parts = t.part.where("p_size < 12").select("p_partkey", F.col("p_size").alias("position"))
    return topics.join(parts, "p_partkey", "left").groupBy("topic").agg(F.min("position").alias("position"))


@query("""WITH steps AS (SELECT unnest(['click', 'view', 'purchase', 'error']) AS step, unnest([NULL, 'click', 'view', 'purchase']) AS needs), latest AS (SELECT user_id, event_type, max_by(event_id, (ts, event_id)) AS job, max(value) AS output FROM events GROUP BY ALL),
u AS (SELECT DISTINCT user_id FROM events) SELECT u.user_id, step, l.job, l.output > 95 AS has_output, needs IS NOT NULL AND coalesce(d.output <= 95, true) AS missing FROM u CROSS JOIN steps LEFT JOIN latest l ON l.user_id = u.user_id AND l.event_type = step LEFT JOIN latest d ON d.user_id = u.user_id AND d.event_type = needs""")
def step_view_of_projects(t):
    """For each step its latest job, whether it has output, and whether what it needs is missing: one aggregation, no lookups by row."""
    latest = t.events.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("job"), F.max("value").alias("output"))
    order = ["click", "view", "purchase", "error"]
    each = latest.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", F.struct("job", "output")))).alias("m"))
    steps = F.explode(F.array(*(F.struct(F.lit(s).alias("step"), F.lit(n).cast("string").alias("needs")) for s, n in zip(order, [None, *order], strict=False))))
    rows = each.select("user_id", "m", steps.alias("s")).select("user_id", "s.step", "s.needs", F.col("m")[F.col("s.step")].alias("own"), F.when(F.col("s.needs").isNotNull(), F.col("m")[F.coalesce("s.needs", F.lit(""))]).alias("dep"))
    missing = F.col("needs").isNotNull() & F.coalesce(F.col("dep.output") <= 95, F.lit(True))
    return rows.select("user_id", "step", "own.job", (F.col("own.output") > 95).alias("has_output"), missing.alias("missing"))


@query("""SELECT p_size, role, string_agg(p_partkey::VARCHAR, ',' ORDER BY page, p_partkey) AS chunks FROM (SELECT p_size, CASE WHEN p_partkey % 4 = 0 THEN 'bridge' ELSE 'primary' END AS role, p_partkey, p_partkey % 7 AS page FROM part) GROUP BY ALL""")
def assigned_chunks(t):
    role = F.when(F.col("p_partkey") % 4 == 0, "bridge").otherwise("primary")
    chunks = F.array_sort(F.collect_list(F.struct((F.col("p_partkey") % 7).alias("page"), "p_partkey")))
    return t.part.groupBy("p_size", role.alias("role")).agg(F.array_join(F.transform(chunks, lambda x: x["p_partkey"].cast("string")), ",").alias("chunks"))


@query("""SELECT l_orderkey, l_linenumber, o_orderpriority, s_name FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus <> 'F' LEFT JOIN supplier ON s_suppkey = l_suppkey WHERE l_linestatus = 'O' AND NOT (l_returnflag = 'N' AND l_tax < 0.05 AND l_quantity < 40) AND l_quantity > 30""")
def unverified_remote_media(t):
    kept = t.lineitem.where("l_linestatus = 'O' AND NOT (l_returnflag = 'N' AND l_tax < 0.05 AND l_quantity < 40) AND l_quantity > 30").select("l_orderkey", "l_linenumber", "l_suppkey")
    orders = t.orders.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return kept.join(orders, "l_orderkey", "left").join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey", "left").select("l_orderkey", "l_linenumber", "o_orderpriority", "s_name")


@query("""SELECT c_custkey, p_partkey FROM customer LEFT JOIN (SELECT p_name AS slug, min(p_partkey) AS p_partkey FROM part WHERE p_size > 5 GROUP BY 1) ON slug = (['red', 'blue', 'hot', 'small'])[c_custkey % 4 + 1] || ' ' || (['ring', 'bolt', 'gear'])[c_custkey % 3 + 1]""")
def labels_to_references(t):
    """A node's label, as a slug, finds a reference that isn't restricted, or none."""
    pick = lambda names, k: F.get(F.array(*map(F.lit, names)), (F.col("c_custkey") % k).cast("int"))
    nodes = t.customer.select("c_custkey", F.concat_ws(" ", pick(["red", "blue", "hot", "small"], 4), pick(["ring", "bolt", "gear"], 3)).alias("slug"))
    refs = t.part.where("p_size > 5").groupBy(F.col("p_name").alias("slug")).agg(F.min("p_partkey").alias("p_partkey"))
    return nodes.join(refs, "slug", "left").select("c_custkey", "p_partkey")


@query("""SELECT source, coalesce(max(doc_id) FILTER (lang = 'en' AND n_chars > 3000), max(doc_id) FILTER (lang = 'de'), -1) AS best FROM documents GROUP BY source""")
def corrected_else_raw(t):
    some = lambda c: F.max(F.when(c, F.col("doc_id")))
    return t.documents.groupBy("source").agg(F.coalesce(some((F.col("lang") == "en") & (F.col("n_chars") > 3000)), some(F.col("lang") == "de"), F.lit(-1)).alias("best"))


@query("""WITH i AS (SELECT source, lang, max(doc_id) AS doc_id, max(n_chars) AS richest FROM documents WHERE n_chars > 1000 GROUP BY ALL) SELECT source, lang, doc_id FROM i WHERE NOT (lang = 'de' AND EXISTS (SELECT 1 FROM i x WHERE x.source = i.source AND x.lang = 'en'))""")
def resolved_inputs(t):
    """Inputs by type; of a corrected and a raw one (en and de) the richer alone."""
    rows = t.documents.where("n_chars > 1000").groupBy("source", "lang").agg(F.max("doc_id").alias("doc_id"))
    w = Window.partitionBy("source")
    return rows.withColumn("corrected", F.bool_or(F.col("lang") == "en").over(w)).where("NOT (lang = 'de' AND corrected)").select("source", "lang", "doc_id")


@query("""SELECT u.user_id, jobs, documents FROM (SELECT user_id, count(*) AS jobs FROM events GROUP BY user_id) u LEFT JOIN (SELECT CAST(substr(source, 4) AS BIGINT) AS user_id, count(*) AS documents FROM documents GROUP BY 1) d USING (user_id)""")
def project_list(t):
    jobs = t.events.groupBy("user_id").agg(F.count("*").alias("jobs"))
    docs = t.documents.groupBy(F.substring("source", 4, 9).cast("long").alias("user_id")).agg(F.count("*").alias("documents"))
    return jobs.join(docs, "user_id", "left").select("user_id", "jobs", "documents")


@query(f"""WITH {PROJECTS} SELECT doc_id, lang FROM documents JOIN projects USING (source) WHERE NOT restricted AND NOT deleting AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def public_references(t):
    public = projects(t).where("NOT restricted AND NOT deleting").select("source")
    return t.documents.select("doc_id", "lang", "source").join(public, "source", "left_semi").join(t.labels.where("toxic = 1"), "doc_id", "left_anti").select("doc_id", "lang")


@query("""WITH b AS (SELECT doc_id, text || ' [[src' || doc_id % 30 || ']] and [[src' || (doc_id + 7) % 40 || '|name]]' AS body FROM documents), l AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(body, '\\[\\[([^\\]|]+)', 1)) AS slug FROM b),
p AS (SELECT DISTINCT source AS slug FROM documents), had AS (SELECT doc_id, source AS slug FROM documents) SELECT doc_id, slug FROM l SEMI JOIN p USING (slug) ANTI JOIN had USING (doc_id, slug)""")
def wikilinks_added(t):
    """Links that bodies name, to projects that exist, where there is no such link yet."""
    tail = F.format_string(" [[src%d]] and [[src%d|name]]", F.col("doc_id") % 30, (F.col("doc_id") + 7) % 40)
    found = t.documents.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.concat("text", tail), F.lit(r"\[\[([^\]|]+)"), F.lit(1)))).alias("slug"))
    known = t.documents.select(F.col("source").alias("slug")).distinct()
    return found.join(known, "slug", "left_semi").join(t.documents.select("doc_id", F.col("source").alias("slug")), ["doc_id", "slug"], "left_anti").select("doc_id", "slug")


@query(f"""WITH {PROJECTS} SELECT DISTINCT p_brand FROM part JOIN documents ON doc_id = p_partkey SEMI JOIN (SELECT source FROM projects WHERE restricted) USING (source)""")
def references_of_restricted_contributors(t):
    docs = t.documents.select("doc_id", "source").join(projects(t).where("restricted").select("source"), "source", "left_semi").select(F.col("doc_id").alias("p_partkey"))
    return t.part.join(docs, "p_partkey", "left_semi").select("p_brand").distinct()


@query("""SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY CASE lang WHEN 'es' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END, doc_id) AS n FROM documents WHERE lang IN ('es', 'fr', 'de') AND n_chars > 200) WHERE n = 1""")
def media_of_projects(t):
    rank = F.when(F.col("lang") == "es", 0).when(F.col("lang") == "fr", 1).otherwise(2)
    return first_per(t.documents.where("lang IN ('es', 'fr', 'de') AND n_chars > 200"), ["source"], [rank, F.asc("doc_id")]).select("source", "doc_id")


_MODELS = {"click": ["local:a", "cloud:b"], "view": ["local:c"], "error": ["cloud:d"], "purchase": ["local:a", "local:e"]}


@query(f"""WITH m AS (SELECT unnest({list(_MODELS)}) AS event_type, unnest({list(_MODELS.values())}) AS models), e AS (SELECT event_id, event_type, unnest(models) AS model FROM events JOIN m USING (event_type) WHERE value > 80)
SELECT substr(model, 7) AS model, count(*) AS jobs, max(event_id) AS newest FROM e WHERE model LIKE 'local:%' GROUP BY 1""")
def active_local_jobs(t):
    table = F.create_map(*(F.lit(x) for k, v in _MODELS.items() for x in (k, v)))
    rows = t.events.where("value > 80").select("event_id", F.explode(table[F.col("event_type")]).alias("model")).where(F.col("model").startswith("local:"))
    return rows.groupBy(F.substring("model", 7, 99).alias("model")).agg(F.count("*").alias("jobs"), F.max("event_id").alias("newest"))
