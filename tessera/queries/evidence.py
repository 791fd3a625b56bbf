"""Evidence, scopes, entities, identities and small scalar contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify, evidence
from ..operators.search import first_per
from .registry import query
from .scan import FILES, files


@query("SELECT DISTINCT o_custkey AS id, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS known FROM orders")
def requested_ids(t):
    return evidence.checked(t.orders.select(F.col("o_custkey").alias("id")), t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("id")), "id")


@query("""SELECT doc_id FROM labels WHERE quality = 0 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en' AND trim(source) <> '')""")
def blockers_left(t):
    notes = t.documents.where("lang = 'en'").select("doc_id", F.col("source").alias("note"))
    return evidence.blockers(t.labels.where("quality = 0").select("doc_id"), notes, "doc_id")


_IMPORTANCE = "CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 ELSE 1 END"


@query(f"SELECT o_custkey, (['supporting', 'major', 'critical'])[max({_IMPORTANCE})] AS importance FROM orders GROUP BY o_custkey")
def highest_importance(t):
    label = F.when(F.col("o_orderpriority") == "1-URGENT", "critical").when(F.col("o_orderpriority") == "2-HIGH", "major").otherwise("supporting")
    return evidence.importance(t.orders.withColumn("label", label), ["o_custkey"], "label")


@query("""SELECT lower(substr(p_name, 1, 6)) AS topic, first(p_name ORDER BY p_partkey) AS title, array_to_string(list_sort(list_distinct(list(p_size))), ',') AS ids FROM part GROUP BY 1""")
def merged_topics(t):
    rows = t.part.select(F.lower(F.substring("p_name", 1, 6)).alias("topic"), F.col("p_name").alias("title"), "p_partkey", F.col("p_size").alias("ids"))
    out = evidence.merged(rows, ["topic"], "p_partkey", ["title"], "ids")
    return out.select("topic", "title", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@query("""WITH n AS (SELECT DISTINCT p_partkey, lower(split_part(p_name, ' ', 1)) AS slug, p_size % 3 AS kind FROM part), g AS (SELECT p_partkey AS target, lower(split_part(p_name, ' ', 1)) AS slug, p_size % 4 AS kind FROM part WHERE p_size < 20)
SELECT p_partkey, coalesce((SELECT min(target) FROM g WHERE g.slug = n.slug AND g.kind = n.kind), (SELECT min(target) FROM g WHERE g.slug = n.slug)) AS target FROM n WHERE slug IN (SELECT slug FROM g)""")
def resolved_entities(t):
    slug = F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("slug")
    names = t.part.select("p_partkey", slug, (F.col("p_size") % 3).alias("kind"))
    targets = t.part.where("p_size < 20").select(F.col("p_partkey").alias("target"), slug, (F.col("p_size") % 4).alias("kind"))
    return evidence.resolved(names, targets, "p_partkey", "kind", "slug", "target")


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, bool_and(o_orderstatus <> 'P') OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS good FROM orders) WHERE good""")
def unbroken_chains(t):
    return evidence.unbroken(t.orders, ["o_custkey"], "o_orderkey", F.col("o_orderstatus") != "P").select("o_custkey", "o_orderkey")


@query("""SELECT user_id, event_id, n AS of_all FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE r <= 3""")
def newest_three_of_each(t):
    return evidence.capped(t.events, ["user_id"], [F.desc("ts"), F.asc("event_id")], 3).select("user_id", "event_id", F.col("of").alias("of_all"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) - 1 AS nth FROM documents")
def occurrences_of_texts(t):
    return evidence.occurrences(t.documents, ["text"], [F.asc("doc_id")]).select("doc_id", "nth")


@query("""WITH p AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE lower(p_type) END AS x FROM part), e AS (SELECT DISTINCT array_to_string(list_slice(string_split(x, ' '), 1, n), '/') AS p FROM (SELECT x, unnest(range(1, len(string_split(x, ' ')) + 1)) AS n FROM p))
SELECT lower(p) AS folded, count(*) AS spellings FROM e GROUP BY lower(p) HAVING count(*) > 1""")
def path_collisions(t):
    path = F.translate(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_type")).otherwise(F.lower("p_type")), " ", "/")
    return evidence.collisions(t.part.select(path.alias("path")), "path")


_HOST = "regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)"


@query(f"""WITH d AS (SELECT DISTINCT regexp_extract({_HOST}, '([^.]+[.][^.]+)$', 1) AS domain FROM pages)
SELECT page_id, domain FROM pages JOIN d ON {_HOST} = domain OR {_HOST} LIKE '%.' || domain""")
def hosts_below_domains(t):
    host = F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)
    hosts = t.pages.select("page_id", host.alias("host"))
    domains = t.pages.select(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain")).distinct()
    return evidence.host_matches(domains, hosts, "domain", "host").select("page_id", "domain")


@query("""SELECT lang, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, count(*) AS files, CAST(max(length(text)) AS BIGINT) AS longest FROM documents GROUP BY lang""")
def bytes_by_language(t):
    return t.documents.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("files"), F.max(F.length("text")).cast("long").alias("longest"))


@query("""SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM embeddings WHERE label = 0) AS of_model, (SELECT count(*) FROM pages) AS pages, (SELECT count(DISTINCT conv_id) FROM conversations) AS conversations""")
def index_status(t):
    one = lambda df, c, n: df.agg(c.alias(n))
    out = one(t.documents, F.count("*"), "documents").crossJoin(t.embeddings.agg(F.count("*").alias("vectors"), F.count_if(F.col("label") == 0).alias("of_model")))
    return out.crossJoin(one(t.pages, F.count("*"), "pages")).crossJoin(one(t.conversations, F.countDistinct("conv_id"), "conversations"))


@query("""SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END, n_chars DESC, doc_id) AS n FROM documents) WHERE n = 1""")
def preferred_source(t):
    rank = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).otherwise(2)
    return first_per(t.documents, ["source"], [rank, F.desc("n_chars"), F.asc("doc_id")]).select("source", "doc_id")


@query("""SELECT DISTINCT c_custkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'O' AND c_mktsegment IN ('BUILDING', 'MACHINERY')""")
def blocked_by_active_work(t):
    return t.customer.where("c_mktsegment IN ('BUILDING', 'MACHINERY')").join(t.orders.where("o_orderstatus = 'O'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("""SELECT o_orderkey, l_linenumber, p_name, s_name FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'R' AND o_orderpriority = '1-URGENT'""")
def hydrated_hits(t):
    hits = t.lineitem.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    out = hits.join(t.orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    out = out.join(t.part.select("p_partkey", "p_name"), F.col("p_partkey") == F.col("l_partkey")).join(t.supplier.select("s_suppkey", "s_name"), F.col("s_suppkey") == F.col("l_suppkey"))
    return out.select("o_orderkey", "l_linenumber", "p_name", "s_name")


@query("""SELECT o_orderkey, len(list_intersect(a, b)) = 0 AS disjoint, len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 AS covered FROM
(SELECT l_orderkey AS o_orderkey, list_distinct(list(l_partkey % 10)) AS a, list_distinct(coalesce(list(l_suppkey % 10) FILTER (l_quantity > 40), [])) AS b FROM lineitem GROUP BY l_orderkey)""")
def topic_coverage(t):
    a, b = F.collect_set(F.col("l_partkey") % 10), F.collect_set(F.when(F.col("l_quantity") > 40, F.col("l_suppkey") % 10))
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(a.alias("a"), b.alias("b"))
    return rows.select("o_orderkey", (~F.arrays_overlap("a", "b")).alias("disjoint"), (F.size(F.array_except("b", "a")) == 0).alias("covered"))


@query(f"""WITH {FILES} SELECT doc_id, CASE WHEN name LIKE 'readme%' OR name LIKE 'security%' THEN 1000 ELSE 0 END + CASE WHEN name IN ('package.json', 'makefile') OR name LIKE 'requirements%' THEN 700 ELSE 0 END + CASE WHEN list_has_any(dirs, ['docs', 'tests']) THEN 500 ELSE 0 END + CASE WHEN name LIKE 'main.%' THEN 450 ELSE 0 END AS score FROM files""")
def path_scores(t):
    """Sums of what names, kinds and folders of files are worth."""
    name = classify.base_name(F.col("path"))
    worth = lambda test, n: F.when(test, n).otherwise(0)
    role = classify.role(F.col("path"))
    score = worth(name.rlike("^(readme|security)"), 1000) + worth(role == "manifest", 700) + worth(classify.below(F.col("path"), ["docs", "tests"]), 500) + worth(name.startswith("main."), 450)
    return files(t).select("doc_id", score.alias("score"))


@query(r"""SELECT p_partkey, owner || '/' || name AS repository, regexp_matches(ref, '^[0-9a-f]{40}$') AS pinned FROM (SELECT p_partkey, regexp_extract(u, '^https://forge\.example/([A-Za-z0-9-]+)/([A-Za-z0-9._-]+?)(\.git)?/?$', 1) AS owner,
regexp_extract(u, '^https://forge\.example/([A-Za-z0-9-]+)/([A-Za-z0-9._-]+?)(\.git)?/?$', 2) AS name, ref FROM (SELECT p_partkey, 'https://forge.example/' || lower(split_part(p_type, ' ', 1)) || '/part' || p_partkey || CASE WHEN p_size % 2 = 0 THEN '.git' ELSE '/' END AS u, substr(sha256(p_name), 1, CASE WHEN p_size % 3 = 0 THEN 40 ELSE 12 END) AS ref FROM part))""")
def repositories(t):
    url = F.concat(F.lit("https://forge.example/"), F.lower(F.split_part("p_type", F.lit(" "), F.lit(1))), F.lit("/part"), "p_partkey", F.when(F.col("p_size") % 2 == 0, ".git").otherwise("/"))
    ref = F.substring(F.sha2("p_name", 256), F.lit(1), F.when(F.col("p_size") % 3 == 0, 40).otherwise(12))
    pattern = r"^https://forge\.example/([A-Za-z0-9-]+)/([A-Za-z0-9._-]+?)(\.git)?/?$"
    return t.part.select("p_partkey", F.concat_ws("/", F.regexp_extract(url, pattern, 1), F.regexp_extract(url, pattern, 2)).alias("repository"), ref.rlike("^[0-9a-f]{40}$").alias("pinned"))


@query("""SELECT vec_id, len(embedding) AS dimensions, len(embedding) = (SELECT max(len(embedding)) FROM embeddings) AS fits, list_position(embedding, list_max(embedding)) AS peak FROM embeddings""")
def vector_shapes(t):
    most = t.embeddings.agg(F.max(F.size("embedding")).alias("most"))
    return t.embeddings.crossJoin(F.broadcast(most)).select("vec_id", F.size("embedding").alias("dimensions"), (F.size("embedding") == F.col("most")).alias("fits"), F.array_position("embedding", F.array_max("embedding")).alias("peak"))


@query("""SELECT user_id, event_type, count(*) AS n, max(event_id) AS newest FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'signup') GROUP BY user_id, event_type""")
def results_inside_the_fence(t):
    alive = t.events.where("event_type = 'signup'").select("user_id")
    return t.events.join(alive, "user_id", "left_semi").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("newest"))


@query("""SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4""")
def last_lines(t):
    return evidence.capped(t.conversations, ["conv_id"], [F.desc("turn")], 4).select("conv_id", "turn")


@query("""SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")
def documents_that_hold_passages(t):
    return evidence.holders(t.documents, t.benchmark, "doc_id", "item_id", "text")
