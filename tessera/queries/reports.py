"""Reports: counts and coverage, sets of pairs, states of runs and steps, index maintenance, manifests, configuration."""

from __future__ import annotations

import hashlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import clean_tag
from ..operators import external, facts, jobs, packs, search
from ..sources import captions
from .registry import query
from .retrieval import _TOKENS

# Counts and coverage.


@query("""SELECT source, page, count(*) AS rows, CAST(sum(n_chars) AS BIGINT) AS chars, count(*) FILTER (n_chars >= 400) AS nontrivial, count(*) FILTER (lang = 'en') AS english, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (n_chars < 200) AS poor
FROM (SELECT *, doc_id % 5 AS page FROM documents) GROUP BY ALL""")
def page_statistics(t):
    poor = F.array_sort(F.collect_list(F.when(F.col("n_chars") < 200, F.col("doc_id"))))
    rows = t.documents.groupBy("source", (F.col("doc_id") % 5).alias("page")).agg(F.count("*").alias("rows"), F.sum("n_chars").alias("chars"), F.count_if(F.col("n_chars") >= 400).alias("nontrivial"), F.count_if(F.col("lang") == "en").alias("english"), poor.alias("p"))
    return rows.withColumn("poor", F.when(F.size("p") > 0, F.array_join(F.transform("p", lambda x: x.cast("string")), ","))).drop("p")


@query("""SELECT s_nationkey, coalesce(max(version), 0) AS version FROM supplier LEFT JOIN (SELECT c_nationkey, max(c_custkey % 9) AS version FROM customer WHERE c_acctbal > 9000 GROUP BY 1) ON c_nationkey = s_nationkey GROUP BY 1""")
def schema_versions(t):
    versions = t.customer.where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.max(F.col("c_custkey") % 9).alias("v"))
    return t.supplier.select("s_nationkey").distinct().join(versions, "s_nationkey", "left").select("s_nationkey", F.coalesce("v", F.lit(0)).alias("version"))


@query("""SELECT l_suppkey, count(*) AS selected, count(DISTINCT l_partkey) AS files, CAST(sum(l_quantity) AS BIGINT) AS chars, max(l_linenumber) AS last_page, count(*) FILTER (l_returnflag = 'N') AS skipped, count(*) FILTER (l_returnflag = 'A') AS fallbacks, count(*) FILTER (l_returnflag = 'R' AND l_tax > 0.04) AS reused FROM lineitem GROUP BY 1""")
def mapping_coverage(t):
    flag = F.col("l_returnflag")
    return t.lineitem.groupBy("l_suppkey").agg(
        F.count("*").alias("selected"), F.countDistinct("l_partkey").alias("files"), F.sum("l_quantity").cast("long").alias("chars"), F.max("l_linenumber").alias("last_page"),
        F.count_if(flag == "N").alias("skipped"), F.count_if(flag == "A").alias("fallbacks"), F.count_if((flag == "R") & (F.col("l_tax") > 0.04)).alias("reused"),
    )


@query("SELECT p_type, lower(p_name) AS slug, min(p_partkey) AS p_partkey, first(p_brand ORDER BY p_partkey) AS p_brand FROM part GROUP BY p_type, lower(p_name)")
def distinct_entities(t):
    """The first arrival of each kind and slug."""
    return t.part.groupBy("p_type", F.lower("p_name").alias("slug")).agg(F.min("p_partkey").alias("p_partkey"), F.min_by("p_brand", "p_partkey").alias("p_brand"))


@query("SELECT tag, count(*) AS n FROM (SELECT doc_id, unnest([lang, source, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END]) AS tag FROM documents) GROUP BY tag")
def tag_histogram(t):
    tags = F.array("lang", "source", F.when(F.col("n_chars") > 2000, "long").otherwise("short"))
    return t.documents.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT user_id, event_type, max_by(value, (ts, event_id)) AS value FROM events GROUP BY ALL) SELECT user_id, bool_or(value > 80) AS running, count(*) FILTER (value <= 20) AS queued, count(*) FILTER (value > 20 AND value <= 80) AS done, count(*) AS steps FROM l GROUP BY user_id""")
def run_counters(t):
    last = t.events.groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    return last.groupBy("user_id").agg(F.bool_or(F.col("value") > 80).alias("running"), F.count_if(F.col("value") <= 20).alias("queued"), F.count_if((F.col("value") > 20) & (F.col("value") <= 80)).alias("done"), F.count("*").alias("steps"))


@query("""SELECT s_suppkey, coalesce(json_extract_string(j, '$.files')::BIGINT, 0) AS files, coalesce(json_extract_string(j, '$.status'), 'unknown') AS status FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '{"files": ' || s_nationkey || '}' WHEN s_suppkey % 3 = 1 THEN '{"status": "ready"}' END AS j FROM supplier)""")
def coverage_records(t):
    text = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit('{"files": '), "s_nationkey", F.lit("}"))).when(F.col("s_suppkey") % 3 == 1, '{"status": "ready"}')
    rows = t.supplier.select("s_suppkey", F.from_json(text, "files long, status string").alias("j"))
    return rows.select("s_suppkey", F.coalesce("j.files", F.lit(0)).alias("files"), F.coalesce("j.status", F.lit("unknown")).alias("status"))


@query("""SELECT s_nationkey, CAST(sum(ram) AS BIGINT) AS ram, CAST(sum(least(vram, ram)) AS BIGINT) AS vram, array_to_string(list_sort(list_distinct(list(name))), ',') AS names FROM (SELECT s_nationkey, s_suppkey * 10 AS ram, s_suppkey % 7 * 100 AS vram, 'm' || s_suppkey % 4 AS name FROM supplier) GROUP BY 1""")
def resident_models(t):
    rows = t.supplier.select("s_nationkey", (F.col("s_suppkey") * 10).alias("ram"), (F.col("s_suppkey") % 7 * 100).alias("vram"), F.concat(F.lit("m"), F.col("s_suppkey") % 4).alias("name"))
    return rows.groupBy("s_nationkey").agg(F.sum("ram").alias("ram"), F.sum(F.least("vram", "ram")).alias("vram"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


_BLOCKS = "b AS (SELECT page_id, unnest(regexp_extract_all(html, '<(h[1-6]|p)>', 1)) AS tag, generate_subscripts(regexp_extract_all(html, '<(h[1-6]|p)>', 1), 1) AS place FROM pages), l AS (SELECT *, CASE WHEN tag = 'p' THEN 9 ELSE CAST(substr(tag, 2) AS INTEGER) END AS level FROM b)"


@query(f"""WITH {_BLOCKS} SELECT b.page_id, b.place, coalesce(string_agg(h.tag || '@' || h.place, '/' ORDER BY h.place), '') AS path FROM l b LEFT JOIN l h ON h.page_id = b.page_id AND h.level < b.level AND h.place < b.place AND h.tag <> 'p'
AND NOT EXISTS (SELECT 1 FROM l x WHERE x.page_id = b.page_id AND x.tag <> 'p' AND x.place > h.place AND x.place < b.place AND x.level <= h.level) GROUP BY b.page_id, b.place""")
def section_paths(t):
    """The headings that are open at each block: for each level its last one, unless a higher one came after it; running maxima, no fold."""
    blocks = t.pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<(h[1-6]|p)>"), F.lit(1))).alias("n", "tag"))
    blocks = blocks.withColumn("place", (F.col("n") + 1).cast("long")).withColumn("level", F.when(F.col("tag") == "p", 9).otherwise(F.substring("tag", 2, 1).cast("int")))
    before = Window.partitionBy("page_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("level") == k, F.col("place"))).over(before).alias(f"l{k}") for k in range(1, 7)]
    rows = blocks.select("page_id", "place", "level", *last)
    higher = lambda k: F.greatest(*(F.coalesce(f"l{j}", F.lit(-1)) for j in range(1, k)), F.lit(-1)) if k > 1 else F.lit(-1)
    parts = [F.when((F.col(f"l{k}") > higher(k)) & (F.col("level") > k), F.concat(F.lit(f"h{k}@"), f"l{k}")) for k in range(1, 7)]
    return rows.select("page_id", "place", F.concat_ws("/", *parts).alias("path"))


@query("""WITH RECURSIVE i AS (SELECT conv_id, turn, CAST(ceil(length(text) / 4.0) AS BIGINT) AS q, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations), f AS (SELECT conv_id, r, q AS used, 0 AS batch, turn FROM i WHERE r = 1
UNION ALL SELECT i.conv_id, i.r, CASE WHEN used > 0 AND used + q > 9000 THEN q ELSE used + q END, CASE WHEN used > 0 AND used + q > 9000 THEN batch + 1 ELSE batch END, i.turn FROM f JOIN i ON i.conv_id = f.conv_id AND i.r = f.r + 1) SELECT conv_id, turn, batch FROM f""")
def prompts_within_tokens(t):
    """Sequential packing by estimated tokens; a single turn that is too long is an error."""
    rows = t.conversations.select("conv_id", "turn", F.ceil(F.length("text") / 4).cast("long").alias("q"))
    return packs.batched(rows, ["conv_id"], "turn", "q", 9000, refuse=True)


@query("""SELECT doc_id, row_number() OVER (ORDER BY CASE lang WHEN 'en' THEN 3 WHEN 'de' THEN 2 ELSE 1 END DESC, source, lower(substr(text, 1, 30)), doc_id) AS place FROM documents WHERE n_chars > 3000 AND contains(lower(source || ' ' || substr(text, 1, 200)), 'the') QUALIFY place <= 100""")
def topics_in_order(t):
    """Importance, kind and folded title decide; the first hundred are shown."""
    rank = F.when(F.col("lang") == "en", 3).when(F.col("lang") == "de", 2).otherwise(1)
    rows = t.documents.where((F.col("n_chars") > 3000) & F.contains(F.lower(F.concat_ws(" ", "source", F.substring("text", 1, 200))), F.lit("the")))
    top = rows.orderBy(F.desc(rank), "source", F.lower(F.substring("text", 1, 30)), "doc_id").limit(100)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc(rank), "source", F.lower(F.substring("text", 1, 30)), "doc_id"))).select("doc_id", F.col("place").cast("long").alias("place"))  # after a limit of 100


@query("""SELECT p_brand, p_type, count(DISTINCT p_size) AS sources FROM part WHERE p_type IN ('ECONOMY', 'SMALL') AND (p_size < 10 OR contains(p_name, 'ring')) GROUP BY ALL""")
def filtered_references(t):
    rows = t.part.where(F.col("p_type").isin("ECONOMY", "SMALL") & ((F.col("p_size") < 10) | F.contains("p_name", F.lit("ring"))))
    return rows.groupBy("p_brand", "p_type").agg(F.countDistinct("p_size").alias("sources")).orderBy(F.desc("sources"), "p_type", "p_brand")


# Sets.


@query("""SELECT DISTINCT l_returnflag || l_linestatus AS field, l_partkey, 'item' AS kind FROM lineitem WHERE l_quantity > 30 UNION ALL SELECT DISTINCT l_returnflag || l_linestatus, l_suppkey, 'source' FROM lineitem WHERE l_quantity > 30""")
def field_pairs(t):
    """Different pairs of a field with an id, and with a source item."""
    rows = t.lineitem.where("l_quantity > 30").select(F.concat("l_returnflag", "l_linestatus").alias("field"), F.explode(F.array(F.struct(F.col("l_partkey").alias("id"), F.lit("item").alias("kind")), F.struct(F.col("l_suppkey").alias("id"), F.lit("source").alias("kind")))).alias("x"))
    return rows.select("field", F.col("x.id").alias("l_partkey"), "x.kind").distinct()


@query("""WITH s AS (SELECT l_orderkey, list_distinct(list(l_partkey % 9)) AS said, list_distinct(list(l_suppkey % 9)) AS allowed FROM lineitem GROUP BY 1) SELECT l_orderkey, len(list_filter(said, lambda x: NOT list_contains(allowed, x))) AS unknown, len(list_filter(allowed, lambda x: NOT list_contains(said, x))) AS missing FROM s""")
def unknown_and_missing_ids(t):
    rows = t.lineitem.groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") % 9).alias("said"), F.collect_set(F.col("l_suppkey") % 9).alias("allowed"))
    return rows.select("l_orderkey", F.size(F.array_except("said", "allowed")).cast("long").alias("unknown"), F.size(F.array_except("allowed", "said")).cast("long").alias("missing"))


@query("""SELECT doc_id, CASE WHEN lang = 'es' THEN 'es,en' WHEN lang = 'en' THEN 'en' ELSE lang || ',en' END AS langs, lang NOT IN ('en', 'de', 'fr') AS rejected FROM documents""")
def ordered_languages(t):
    """Languages in their order, once each; whether one of them is unknown."""
    langs = F.array_distinct(F.transform(F.array("lang", F.lit(" EN "), F.upper("lang"), F.lit("")), lambda x: F.lower(F.trim(x))))
    langs = F.filter(langs, lambda x: x != "")
    return t.documents.select("doc_id", F.array_join(langs, ",").alias("langs"), (F.size(F.array_except(langs, F.array(*map(F.lit, ["en", "de", "fr"])))) > 0).alias("rejected"))


@query("""SELECT DISTINCT path FROM (SELECT unnest([source || '/' || doc_id, 'history/' || source, CASE WHEN doc_id % 2 = 0 THEN 'media/' || lang END]) AS path FROM documents SEMI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) USING (doc_id)) WHERE path IS NOT NULL""")
def restricted_paths(t):
    rows = t.documents.join(t.labels.where("toxic = 1"), "doc_id", "left_semi")
    paths = F.array(F.concat_ws("/", "source", "doc_id"), F.concat(F.lit("history/"), "source"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("media/"), "lang")))
    return rows.select(F.explode(paths).alias("path")).where("path IS NOT NULL").distinct()


@query("""WITH p AS (SELECT l_orderkey, bool_and(l_returnflag = 'N') AS weak, count(DISTINCT l_partkey) AS ids FROM lineitem GROUP BY 1) SELECT l_orderkey, ids FROM p WHERE weak""")
def topics_on_poor_pages_alone(t):
    rows = t.lineitem.groupBy("l_orderkey").agg(F.bool_and(F.col("l_returnflag") == "N").alias("weak"), F.countDistinct("l_partkey").alias("ids"))
    return rows.where("weak").select("l_orderkey", "ids")


@query("""WITH links AS (SELECT doc_id, unnest([lang, source]) AS tag FROM documents), m AS (SELECT DISTINCT doc_id, CASE tag WHEN 'de' THEN 'en' ELSE tag END AS tag FROM links) SELECT tag, count(*) AS links, bool_or(coalesce(toxic, 0) = 1) AS restricted FROM m LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id) GROUP BY tag""")
def merged_tags(t):
    """One tag takes another's links, each once; what was restricted stays so."""
    links = t.documents.select("doc_id", F.explode(F.array("lang", "source")).alias("tag")).withColumn("tag", F.when(F.col("tag") == "de", "en").otherwise(F.col("tag"))).dropDuplicates()
    flags = t.labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return links.join(flags, "doc_id", "left").groupBy("tag").agg(F.count("*").alias("links"), F.bool_or(F.coalesce("toxic", F.lit(0)) == 1).alias("restricted"))


@query("""SELECT doc_id, array_to_string(CASE WHEN doc_id % 3 = 0 THEN [lang] ELSE [lang, source] END, ',') AS tags, coalesce(toxic, 0) = 1 AS restricted FROM documents LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id)""")
def replaced_tags(t):
    """A document's tags are cleaned, taken once each in their order, and replace its links; the restriction stays."""
    names = F.array(F.upper("lang"), F.concat(F.lit(" "), "lang"), F.when(F.col("doc_id") % 3 != 0, F.col("source")))
    tags = F.array_distinct(F.filter(F.transform(names, lambda x: clean_tag(x)), lambda x: x.isNotNull()))
    flags = t.labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = t.documents.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.slice(tags, 1, 1)).otherwise(tags).alias("tags")).join(flags, "doc_id", "left")
    return rows.select("doc_id", F.array_join("tags", ",").alias("tags"), (F.coalesce("toxic", F.lit(0)) == 1).alias("restricted"))


# States.

_CHAIN = ["click", "view", "purchase", "error"]
_STEPS = f"s AS (SELECT user_id, list_position({_CHAIN}, event_type) AS pos, max(value) AS value FROM events WHERE event_type <> 'signup' GROUP BY ALL)"


def _chain(t):
    """Each project's steps in a chain, numbered; (step, needs) edges."""
    pos = F.array_position(F.array(*map(F.lit, _CHAIN)), F.col("event_type"))
    rows = t.events.where("event_type <> 'signup'").groupBy("user_id", pos.alias("pos")).agg(F.max("value").alias("value"))
    step = lambda d: F.concat_ws(":", "user_id", (F.col("pos") + d).cast("string"))
    return rows.withColumn("step", step(0)), rows.where("pos > 1").select(step(0).alias("step"), step(-1).alias("needs"))


@query(f"""WITH {_STEPS}, f AS (SELECT user_id, min(pos) FILTER (value < 98) AS stop FROM s GROUP BY 1) SELECT user_id || ':' || pos AS step, CASE WHEN pos < coalesce(stop, 9) THEN 'done' ELSE 'failed' END AS state, CAST(pos AS INTEGER) AS round FROM s JOIN f USING (user_id)""")
def scheduled_runs(t):
    """What is ready runs in each round; a failure goes on to what needs it."""
    steps, edges = _chain(t)
    return jobs.scheduled(steps.select("step", F.lit("pending").alias("state")), edges, steps.where("value < 98").select("step"), 6)


@query(f"""WITH {_STEPS}, f AS (SELECT user_id, min(pos) AS stop FROM s WHERE value < 98 GROUP BY 1) SELECT user_id || ':' || pos AS step, CASE WHEN value < 98 THEN 'stale' ELSE 'upstream' END AS reason FROM s JOIN f USING (user_id) WHERE pos >= stop""")
def stale_and_downstream(t):
    """Stale steps, and all that lies downstream of one, with the reason."""
    steps, edges = _chain(t)
    seeds = steps.where("value < 98").select(F.col("step").alias("node"))
    reached = jobs.closure(edges.select(F.col("needs").alias("src"), F.col("step").alias("dst")), seeds, include=True)
    return reached.join(seeds.withColumn("own", F.lit(1)), "node", "left").select(F.col("node").alias("step"), F.when(F.col("own") == 1, "stale").otherwise("upstream").alias("reason"))


@query("""WITH j AS (SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'queued' WHEN 'purchase' THEN 'complete' ELSE 'failed' END AS status, user_id FROM events), w AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'queued' ELSE 'running' END AS expected, CASE WHEN id % 3 = 0 THEN 'running' ELSE 'complete' END AS target FROM j WHERE id % 5 <> 0)
SELECT id, CASE WHEN m THEN target ELSE status END AS status, m AS moved FROM (SELECT j.id, status, target, coalesce(status = expected AND ((status = 'queued' AND target = 'running') OR (status = 'running' AND target = 'complete')), false) AS m FROM j LEFT JOIN w USING (id))""")
def compared_and_set(t):
    """A state changes only from the expected one, and only as the machine allows."""
    e = F.col("event_type")
    status = F.when(e == "click", "running").when(e == "view", "queued").when(e == "purchase", "complete").otherwise("failed")
    rows = t.events.select(F.col("event_id").alias("id"), status.alias("status"))
    wanted = rows.where("id % 5 <> 0").select("id", F.when(F.col("id") % 2 == 0, "queued").otherwise("running").alias("expected"), F.when(F.col("id") % 3 == 0, "running").otherwise("complete").alias("target"))
    return jobs.transitions(rows, wanted, {"queued": ["running", "canceled"], "running": ["complete", "failed", "canceled"]}).select("id", "status", "moved")


@query("""SELECT event_id, CASE WHEN user_id % 4 = 0 AND event_type IN ('click', 'view') THEN 'canceled' WHEN user_id % 10 = 3 AND event_type = 'click' THEN 'error' WHEN user_id % 10 = 3 AND event_type = 'view' THEN 'verified' ELSE event_type END AS state, greatest(1, CAST(value AS BIGINT) - 50) AS minutes FROM events""")
def canceled_and_recovered(t):
    """Children of canceled runs that haven't ended are canceled; interrupted transfers are verified or end in error, unless a live job owns them. Leases last a minute at least."""
    e, user = F.col("event_type"), F.col("user_id")
    state = F.when((user % 4 == 0) & e.isin("click", "view"), "canceled").when((user % 10 == 3) & (e == "click"), "error").when((user % 10 == 3) & (e == "view"), "verified").otherwise(e)
    return t.events.select("event_id", state.alias("state"), F.greatest(F.lit(1), F.rint("value").cast("long") - 50).alias("minutes"))


@query("""WITH e AS (SELECT *, min(ts) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id) AS stop FROM events) SELECT user_id, count(*) FILTER (stop IS NULL OR ts <= stop) AS progress, count(*) FILTER (ts > stop) AS rejected FROM e GROUP BY user_id""")
def late_progress(t):
    """Progress of a run that has ended is rejected, and counted."""
    stop = F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(Window.partitionBy("user_id"))
    rows = t.events.select("user_id", "ts", stop.alias("stop"))
    return rows.groupBy("user_id").agg(F.count_if(F.col("stop").isNull() | (F.col("ts") <= F.col("stop"))).alias("progress"), F.count_if(F.coalesce(F.col("ts") > F.col("stop"), F.lit(False))).alias("rejected"))


@query("""WITH p AS (SELECT conv_id, turn, role, min(turn) FILTER (length(text) < 60) OVER (PARTITION BY conv_id) AS broken FROM conversations) SELECT conv_id, turn, CASE WHEN turn = broken THEN 'error' WHEN turn > broken AND role <> 'user' THEN 'stale' ELSE 'kept' END AS state FROM p""")
def reconciled_parts(t):
    """An interrupted part is in error; what was made after it is stale."""
    broken = F.min(F.when(F.length("text") < 60, F.col("turn"))).over(Window.partitionBy("conv_id"))
    rows = t.conversations.select("conv_id", "turn", "role", broken.alias("broken"))
    return rows.select("conv_id", "turn", F.when(F.col("turn") == F.col("broken"), "error").when((F.col("turn") > F.col("broken")) & (F.col("role") != "user"), "stale").otherwise("kept").alias("state"))


@query("""SELECT doc_id, CASE WHEN lang = 'es' OR n_chars < 200 THEN 'own' ELSE (SELECT max(lang) FROM documents x WHERE x.source = d.source AND n_chars > 6000) END AS tag FROM documents d""")
def propagated_tags(t):
    """A project's tag goes to all its documents but curated ones and references."""
    tags = t.documents.where("n_chars > 6000").groupBy("source").agg(F.max("lang").alias("tag"))
    rows = t.documents.join(tags, "source", "left")
    return rows.select("doc_id", F.when((F.col("lang") == "es") | (F.col("n_chars") < 200), "own").otherwise(F.col("tag")).alias("tag"))


# Index maintenance.


@query(f"""WITH c AS (SELECT conv_id * 1000 + turn AS chunk, text FROM conversations JOIN documents d ON d.doc_id = conv_id SEMI JOIN (SELECT doc_id FROM labels) USING (doc_id)) SELECT term, count(DISTINCT chunk) AS df FROM (SELECT chunk, unnest({_TOKENS}) AS term FROM (SELECT chunk, text FROM c)) GROUP BY term""".replace("SELECT conv_id * 1000 + turn AS chunk, text FROM conversations", "SELECT conv_id * 1000 + turn AS chunk, c.text FROM conversations c"))
def rebuilt_chunk_index(t):
    """An index over chunks whose file, snapshot and source all exist."""
    files_ = t.documents.select(F.col("doc_id").alias("conv_id")).join(t.labels.select(F.col("doc_id").alias("conv_id")), "conv_id", "left_semi")
    chunks = t.conversations.join(files_, "conv_id", "left_semi").select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk"), "text")
    return search.postings(chunks, "chunk").groupBy("term").agg(F.count("*").alias("df"))


@query(f"""WITH l AS (SELECT doc_id, (generate_subscripts(l, 1) - 1) // 5 AS chunk_index, generate_subscripts(l, 1) AS n, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)), c AS (SELECT doc_id, chunk_index, string_agg(line, chr(10) ORDER BY n) AS text FROM l GROUP BY ALL)
SELECT doc_id, count(*) AS chunks, CAST(sum(len({_TOKENS})) AS BIGINT) AS tokens FROM c GROUP BY doc_id""")
def rechunked_library(t):
    lines = captions.numbered(t.documents, "doc_id", "text").withColumn("chunk_index", F.floor((F.col("line_number") - 1) / 5))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_number", "line"))), lambda x: x["line"]), "\n")
    chunks = lines.groupBy("doc_id", "chunk_index").agg(body.alias("text"))
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.size(search.tokens(F.col("text")))).alias("tokens"))


def _embedder():
    """A stand-in for an embedding server: vectors from digests."""
    return lambda texts: [[b / 255 for b in hashlib.blake2b(x.encode(), digest_size=8).digest()] for x in texts]


@query("SELECT d.doc_id, 8 AS dimensions FROM documents d LEFT JOIN (SELECT vec_id AS doc_id, label FROM embeddings) e USING (doc_id) WHERE label IS NULL OR label = 3")
def newly_embedded(t):
    """Only documents without a vector, or whose vector is out of date, are sent, in batches of 32."""
    have = t.embeddings.where("label <> 3").select(F.col("vec_id").alias("doc_id"))
    out = external.embedded(t.documents.select("doc_id", "text").join(have, "doc_id", "left_anti"), "doc_id", "text", _embedder)
    return out.select("doc_id", F.size("vector").alias("dimensions"))


def _flaky():
    """A stand-in for a text function: fails once for some texts, always for others, and says nothing at first for some."""
    seen: dict[str, int] = {}

    def f(text: str) -> str:
        seen[text] = seen.get(text, 0) + 1
        kind = int(text.rsplit(" ", 1)[1]) % 5
        if kind == 1 and seen[text] == 1:
            raise external.Transient()
        if kind == 2 and seen[text] < 3:
            return ""
        if kind == 3:
            raise external.Transient()
        if kind == 4:
            raise ValueError(text)
        return text.upper()

    return f


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 < 3 THEN upper(p_name) || ' ' || p_partkey END AS output, (['ok', 'ok', 'ok', 'exhausted', 'error'])[p_partkey % 5 + 1] AS status, ([1, 2, 3, 3, 1])[p_partkey % 5 + 1] AS attempts, length(p_name || ' ' || p_partkey) AS input_chars FROM part""")
def external_calls(t):
    rows = t.part.select("p_partkey", F.concat_ws(" ", "p_name", "p_partkey").alias("text"))
    return external.completed(rows, "p_partkey", "text", _flaky, wait=0.0).select("p_partkey", "output", "status", "attempts", "input_chars")


# Manifests.


#: A part's files are made of its name's words and of its other columns.
_P = "w AS (SELECT DISTINCT p_partkey, p_size, unnest(string_split(p_name, ' ')) AS word FROM part)"


def _each_word(pattern: str, *more: str):
    """A line for each of a part's different words."""
    return F.array_join(F.transform(F.array_distinct(F.split("p_name", " ")), lambda w: F.format_string(pattern, w, *map(F.col, more))), "\n")


@query(f"""WITH {_P} SELECT p_partkey, 'example.com/' || word AS name, 'v1.' || p_size || '.0' AS version FROM w UNION ALL SELECT p_partkey, 'go', '1.' || p_size FROM part UNION ALL SELECT p_partkey, 'example.com/' || lower(p_type), 'v2.0.0' FROM part""")
def module_facts(t):
    block = _each_word("\texample.com/%s v1.%d.0 // indirect", "p_size")
    text = F.concat(F.lit("module x\n\ngo 1."), "p_size", F.lit("\n\nrequire (\n"), block, F.lit("\n)\nrequire example.com/"), F.lower("p_type"), F.lit(" v2.0.0\nreplace (\n"), _each_word("\tno.example/%s v1.0.0"), F.lit("\n)\n"))
    return facts.module_requirements(t.part.select("p_partkey", text.alias("text")), "p_partkey", "text")


@query(f"""WITH {_P} SELECT p_partkey, 'runtime' AS section, 'p/' || word AS name FROM w UNION ALL SELECT p_partkey, 'development', 'q/' || lower(p_type) FROM part""")
def composer_facts(t):
    words = F.map_from_entries(F.transform(F.array_distinct(F.split("p_name", " ")), lambda w: F.struct(F.concat(F.lit("p/"), w).alias("k"), F.col("p_size").cast("string").alias("v"))))
    text = F.to_json(F.struct(words.alias("require"), F.create_map(F.concat(F.lit("q/"), F.lower("p_type")), F.lit("*")).alias("require-dev"), F.col("p_brand").alias("name")))
    rows = t.part.select("p_partkey", text.alias("text"))
    return facts.json_sections(rows, "p_partkey", "text", {"require": "runtime", "require-dev": "development"}).select("p_partkey", "section", "name")


@query(f"""WITH {_P} SELECT DISTINCT p_partkey, name FROM (SELECT p_partkey, unnest(['KEY_' || upper(word), 'HOME_' || upper(word), 'PATH_' || p_size]) AS name FROM w)""")
def environment_variables(t):
    """Variables that code refers to in three ways; names in lower case are none."""
    code = F.upper(_each_word("%s"))
    lines = lambda pattern: F.array_join(F.transform(F.split(code, "\n"), lambda w: F.format_string(pattern, w)), "\n")
    text = F.concat(lines("x = process.env.KEY_%s + process.env.lower"), F.lit("\n"), lines("y = os.environ['HOME_%s']"), F.lit("\n"), lines("os.environ.get('HOME_%s')"), F.lit('\ngetenv("PATH_'), "p_size", F.lit('")'))
    return facts.variables(t.part.select("p_partkey", text.alias("text")), "p_partkey", "text")


@query("""WITH p AS (SELECT p_partkey, lower(p_type) AS kind, CASE WHEN string_split(p_name, ' ')[1] = string_split(p_name, ' ')[2] THEN [string_split(p_name, ' ')[1]] ELSE string_split(p_name, ' ') END AS l FROM part),
o AS (SELECT p_partkey, CASE WHEN list_contains(l, kind) THEN l ELSE list_append(l, kind) END AS l FROM p) SELECT p_partkey, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS place, 'libs/' || unnest(l) AS path FROM o""")
def declared_submodules(t):
    """Paths in their order, each once, though they are declared twice."""
    entry = _each_word('[submodule "x"]\n\tpath = libs/%s\n\turl = https://forge.example/x')
    text = F.concat(entry, F.lit("\n"), entry, F.lit("\n\tpath = libs/"), F.lower("p_type"), F.lit("\nother = path"))
    return facts.submodules(t.part.select("p_partkey", text.alias("text")), "p_partkey", "text").select("p_partkey", F.col("place").cast("long").alias("place"), "path")


@query("""SELECT p_partkey, CAST(3 * n - 1 AS BIGINT) AS line, 'hub/' || word AS image FROM (SELECT p_partkey, unnest(l) AS word, generate_subscripts(l, 1) AS n FROM (SELECT p_partkey, list_append(CASE WHEN string_split(p_name, ' ')[1] = string_split(p_name, ' ')[2] THEN [string_split(p_name, ' ')[1]] ELSE string_split(p_name, ' ') END, lower(p_type)) AS l FROM part))""")
def compose_images(t):
    entry = "svc:\n  image: 'hub/%s'\n  ports: [80]"
    text = F.concat(_each_word(entry), F.lit("\n"), F.format_string(entry, F.lower("p_type")), F.lit("\n# image none"))
    lines = captions.numbered(t.part.select("p_partkey", text.alias("text")), "p_partkey", "text")
    pattern = r"^\s*image:\s*['\"]?([^'\"\s]+)"
    return lines.where(F.col("line").rlike(pattern)).select("p_partkey", F.col("line_number").cast("long").alias("line"), F.regexp_extract("line", pattern, 1).alias("image"))


@query("""SELECT p_partkey, unnest(list_filter([p_name, p_brand, p_type, CASE WHEN p_size < 10 THEN p_size::VARCHAR END], lambda x: length(x) BETWEEN 2 AND 1000)) AS needle FROM part WHERE lower(p_brand) = 'brand#7'""")
def needles_of_a_path(t):
    """Search terms of the facts that belong to one path."""
    own = F.array("p_name", "p_brand", "p_type", F.when(F.col("p_size") < 10, F.col("p_size").cast("string")))
    return t.part.where(F.lower("p_brand") == "brand#7").select("p_partkey", F.explode(F.filter(own, lambda x: F.length(x).between(2, 1000))).alias("needle"))


# Configuration and history.

_BUILTIN = {"quick": ["ingest", "write"], "full": ["ingest", "map", "reduce", "write"]}


@query("""WITH c AS (SELECT DISTINCT 'n' || s_nationkey AS key, CASE WHEN s_nationkey % 3 = 0 THEN 'ingest,write' ELSE 'ingest,map' END AS steps FROM supplier) SELECT key, steps, false AS builtin FROM c UNION ALL SELECT 'quick', 'ingest,write', true UNION ALL SELECT 'full', 'ingest,map,reduce,write', true""")
def pipeline_profiles(t):
    """Built-in profiles are protected; custom ones keep known steps, once each, in order."""
    known = F.array(*map(F.lit, ["ingest", "map", "reduce", "write"]))
    raw = F.when(F.col("s_nationkey") % 3 == 0, F.array(F.lit("ingest"), F.lit("bogus"), F.lit("write"), F.lit("ingest"))).otherwise(F.array(F.lit("ingest"), F.lit("map"), F.lit("dance")))
    key = F.when(F.col("s_nationkey") == -1, "quick").otherwise(F.concat(F.lit("n"), "s_nationkey"))
    custom = t.supplier.select(key.alias("key"), F.filter(F.array_distinct(raw), lambda s: F.array_contains(known, s)).alias("s")).distinct()
    custom = custom.where(~F.col("key").isin(list(_BUILTIN))).select("key", F.array_join("s", ",").alias("steps"), F.lit(False).alias("builtin"))
    return custom.unionByName(t.spark.createDataFrame([(k, ",".join(v), True) for k, v in _BUILTIN.items()], "key string, steps string, builtin boolean"))


@query("""SELECT s_suppkey, CASE WHEN s_acctbal > 5000 THEN 'custom ' || s_nationkey ELSE 'default ' || s_nationkey % 3 END AS prompt, s_nationkey % 3 <> 0 AND s_acctbal > 5000 AS valid FROM supplier""")
def prompts_and_categories(t):
    """A stored prompt overrides the built-in one; a category needs its parts and an unused key."""
    custom = t.supplier.where("s_acctbal > 5000").select("s_suppkey", F.concat(F.lit("custom "), "s_nationkey").alias("custom"))
    rows = t.supplier.join(custom, "s_suppkey", "left")
    return rows.select("s_suppkey", F.coalesce("custom", F.concat(F.lit("default "), (F.col("s_nationkey") % 3).cast("string"))).alias("prompt"), (F.col("custom").isNotNull() & (F.col("s_nationkey") % 3 != 0)).alias("valid"))


@query("""WITH h AS (SELECT user_id, event_id, strftime(ts, '%Y%m%dT%H%M%S') AS stamp, ts FROM events WHERE event_type = 'view'), r AS (SELECT user_id, max(ts) AS now FROM events WHERE event_type = 'error' GROUP BY 1) SELECT user_id, max_by(event_id, (h.ts, event_id)) AS restored, max_by(stamp, (h.ts, event_id)) AS stamp, count(*) + 1 AS versions FROM h JOIN r USING (user_id) WHERE h.ts < now GROUP BY 1""")
def reverted_documents(t):
    """The newest version before the moment is restored, after the current one has joined the history."""
    history = t.events.where("event_type = 'view'").select("user_id", "event_id", "ts", F.date_format("ts", "yyyyMMdd'T'HHmmss").alias("stamp"))
    now = t.events.where("event_type = 'error'").groupBy("user_id").agg(F.max("ts").alias("now"))
    rows = history.join(now, "user_id").where("ts < now")
    last = F.max(F.struct("ts", "event_id", "stamp"))
    return rows.groupBy("user_id").agg(last.alias("x"), (F.count("*") + 1).alias("versions")).select("user_id", F.col("x.event_id").alias("restored"), "x.stamp", "versions")


@query("""WITH d AS (SELECT doc_id, source, lang, coalesce(toxic, 0) = 1 AS restricted FROM documents LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id)), p AS (SELECT source, bool_or(restricted) AS any_ FROM d GROUP BY 1)
SELECT lang AS tag, count(*) AS links, count(*) FILTER (restricted OR any_) AS restricted, count(*) FILTER (doc_id % 7 = 0) AS pruned FROM d JOIN p USING (source) GROUP BY 1""")
def reingested_library(t):
    """Documents become rows, tags and links again; what a restricted document's project holds is restricted; rows whose file is gone are pruned."""
    flags = t.labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = t.documents.select("doc_id", "source", "lang").join(flags, "doc_id", "left").withColumn("own", F.coalesce("toxic", F.lit(0)) == 1)
    projects = rows.groupBy("source").agg(F.bool_or("own").alias("any"))
    whole = rows.join(projects, "source")
    return whole.groupBy(F.col("lang").alias("tag")).agg(F.count("*").alias("links"), F.count_if(F.col("own") | F.col("any")).alias("restricted"), F.count_if(F.col("doc_id") % 7 == 0).alias("pruned"))


@query("""SELECT doc_id, source || '/' || doc_id || '.md' AS path FROM documents ANTI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) USING (doc_id) WHERE lang <> 'es' UNION ALL SELECT doc_id, 'history/' || source || '/' || doc_id || '.1.md' FROM documents ANTI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) USING (doc_id) WHERE lang <> 'es' AND doc_id % 4 = 0""")
def publishable_paths(t):
    """Public documents and those of their earlier versions; nothing else is staged."""
    public = t.documents.where("lang <> 'es'").join(t.labels.where("toxic = 1"), "doc_id", "left_anti")
    own = public.select("doc_id", F.concat(F.concat_ws("/", "source", "doc_id"), F.lit(".md")).alias("path"))
    old = public.where("doc_id % 4 = 0").select("doc_id", F.concat(F.lit("history/"), F.concat_ws("/", "source", "doc_id"), F.lit(".1.md")).alias("path"))
    return own.unionByName(old)
