"""Scalar functions, classification, chunking, captions and facts, over documents, pages, parts and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import packs
from ..sources import captions
from ..sources.shared import tasks
from .registry import query

_FOLD = f"translate(lower({{}}), '{fn.MARKED}', '{fn.PLAIN}')"
_SLUG = "regexp_replace(regexp_replace(" + _FOLD + ", '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


def _slug(x: str) -> str:
    return f"coalesce(nullif(regexp_replace(substr({_SLUG.format(x)}, 1, 80), '-+$', ''), ''), 'untitled')"


@query(f"SELECT doc_id, {_slug('substr(text, 1, 100)')} AS slug FROM documents")
def slugs(t):
    return t.documents.select("doc_id", fn.slug(F.substring("text", 1, 100)).alias("slug"))


@query("""WITH n AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' ' || p_name WHEN 2 THEN 'The ' || upper(p_name) || '! ' || split_part(p_name, ' ', 2) WHEN 3 THEN 'one two three four five' ELSE ' ' END AS name FROM part)
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN replace(p_name, ' ', '-') WHEN 1 THEN replace(p_name, ' ', '-') WHEN 2 THEN 'the-' || replace(p_name, ' ', '-') END AS tag FROM part""")
def cleaned_tags(t):
    """Names as they are, said twice, with marks and a repeated last word, with too many words, and empty."""
    n = F.col("p_name")
    names = [n, F.concat(n, F.lit(" "), n), F.concat(F.lit("The "), F.upper(n), F.lit("! "), F.split_part(n, F.lit(" "), F.lit(2))), F.lit("one two three four five"), F.lit(" ")]
    return t.part.select("p_partkey", "p_name").repartition(tasks(t.spark), "p_partkey").select("p_partkey", fn.clean_tag(F.get(F.array(*names), (F.col("p_partkey") % 5).cast("int"))).alias("tag"))


@query("SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/:?#]+(:[0-9]+)', 1) AS origin FROM pages")
def origins(t):
    return t.pages.select("page_id", fn.origin(F.col("url")).alias("origin"))


@query(r"SELECT page_id, regexp_replace(url || ' and ' || url, '(https?://)([^/\s?#@]*@)?([^/\s?#]+)[^\s]*', '\1\3', 'g') AS clean FROM pages")
def urls_without_paths(t):
    return t.pages.select("page_id", fn.without_urls(F.concat("url", F.lit(" and "), "url")).alias("clean"))


@query(r"SELECT doc_id, substr(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')), 1, 500) AS short FROM documents")
def squeezed_texts(t):
    return t.documents.select("doc_id", fn.squeezed(F.col("text")).alias("short"))


@query(r"SELECT doc_id, substr(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), 1, 300) AS topic FROM documents")
def topic_keys(t):
    return t.documents.select("doc_id", fn.topic_key(F.col("text")).alias("topic"))


@query("SELECT doc_id, CAST(greatest(1, ceil(length(text) / 4.0)) AS BIGINT) AS up, CAST(greatest(1, length(text) // 4) AS BIGINT) AS down, CAST(greatest(1, ceil(octet_length(encode(text)) * 2 / 5.0), ceil(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) * 135 / 100.0)) AS BIGINT) AS dense FROM documents".replace("\\\\", "\\"))
def token_estimates(t):
    down = F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("long")
    return t.documents.select("doc_id", fn.estimated_tokens(F.col("text")).alias("up"), down.alias("down"), fn.dense_tokens(F.col("text")).alias("dense"))


@query("SELECT doc_id, printf('%02d:%02d:%02d', n_chars // 3600, n_chars % 3600 // 60, n_chars % 60) AS clock, CAST(n_chars AS BIGINT) AS back FROM documents")
def clocks(t):
    clock = fn.clock(F.col("n_chars"))
    return t.documents.select("doc_id", clock.alias("clock"), fn.seconds(clock).cast("long").alias("back"))


@query("""WITH c AS (SELECT p_partkey, unnest(string_split(p_name, '')) AS c FROM part), n AS (SELECT p_partkey, c, count(*) AS k, sum(count(*)) OVER (PARTITION BY p_partkey) AS total FROM c GROUP BY p_partkey, c)
SELECT p_partkey, CAST(round(-sum(k / total * log2(k / total)) * 1000) AS BIGINT) AS millibits FROM n GROUP BY p_partkey""")
def entropies(t):
    return t.part.select("p_partkey", F.round(fn.entropy(F.col("p_name")) * 1000).cast("long").alias("millibits"))


@query("SELECT doc_id, upper(substr(sha256('src' || chr(31) || source || chr(31) || text), 1, 16)) AS evidence, 'P' || printf('%04d', doc_id % 10000) || upper(substr(sha256(text), 1, 20)) AS page FROM documents")
def evidence_ids(t):
    sep = F.lit("\x1f")
    evidence = F.upper(F.substring(F.sha2(F.concat(F.lit("src"), sep, "source", sep, "text"), 256), 1, 16))
    page = F.concat(F.format_string("P%04d", F.col("doc_id") % 10000), F.upper(F.substring(F.sha2("text", 256), 1, 20)))
    return t.documents.select("doc_id", evidence.alias("evidence"), page.alias("page"))


@query("""SELECT doc_id, sha256('{"chars":' || n_chars || ',"lang":"' || lang || '","source":"' || source || '"}') AS digest FROM documents""")
def canonical_digests(t):
    record = F.to_json(F.struct(F.col("n_chars").alias("chars"), "lang", "source"))
    return t.documents.select("doc_id", F.sha2(record, 256).alias("digest"))


@query("""SELECT doc_id, (generate_subscripts(l, 1) - 1) // 5 AS chunk_index, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""")
def lines_in_chunks_of_five(t):
    rows = captions.numbered(t.documents, "doc_id", "text")
    return rows.select("doc_id", F.floor((F.col("line_number") - 1) / 5).cast("long").alias("chunk_index"), "line")


@query("""WITH RECURSIVE p AS (SELECT doc_id, i AS line, substr(l, k * 1000 + 1, 1000) AS part, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) AS r FROM
(SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), range(0, 200) t(k) WHERE k = 0 OR k * 1000 < length(l)),
f AS (SELECT doc_id, r, 0 AS c, 1 AS n, line AS first, length(part) AS size, line FROM p WHERE r = 1
UNION ALL SELECT p.doc_id, p.r, CASE WHEN n < 20 AND size + 1 + length(part) <= 1000 THEN c ELSE c + 1 END, CASE WHEN n < 20 AND size + 1 + length(part) <= 1000 THEN n + 1 ELSE 1 END,
CASE WHEN n < 20 AND size + 1 + length(part) <= 1000 THEN first ELSE p.line END, CASE WHEN n < 20 AND size + 1 + length(part) <= 1000 THEN size + 1 + length(part) ELSE length(part) END, p.line
FROM f JOIN p ON p.doc_id = f.doc_id AND p.r = f.r + 1)
SELECT doc_id, c AS chunk_index, CAST(min(line) AS BIGINT) AS start_line, CAST(max(line) AS BIGINT) AS end_line, CAST(max(size) AS BIGINT) AS chars FROM f GROUP BY doc_id, c""")
def line_chunks(t):
    chunks = packs.line_chunks(t.documents, "doc_id", "text", 20, 1000)
    return chunks.select("doc_id", "chunk_index", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.length("body").cast("long").alias("chars"))


@query("""SELECT conv_id, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END)::BIGINT AS asked, max(turn) AS last_turn, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id""")
def dialogue_shapes(t):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    rows = t.conversations.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("asked"), F.max("turn").alias("last_turn"), turns.alias("x"))
    return rows.select("conv_id", "asked", "last_turn", F.array_join(F.transform("x", lambda x: x["role"]), ">").alias("roles"))


@query(r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<a ')) AS BIGINT) AS links, CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS paragraphs FROM pages")
def page_facts(t):
    count = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return t.pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), count("<a ").alias("links"), count("<p>").alias("paragraphs"))


@query(r"SELECT page_id, unnest(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1)) AS target FROM pages")
def page_links(t):
    return t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))).alias("target"))


@query("""SELECT e.event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, sha256(props) AS props_hash FROM events e""")
def json_options(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.sha2("props", 256).alias("props_hash"))


@query("SELECT doc_id, greatest(40, least(60, n_chars % 90)) AS clamped, CASE WHEN n_chars % 90 BETWEEN 40 AND 60 THEN n_chars % 90 ELSE 45 END AS minutes, (SELECT min(b) FROM (VALUES (2048), (4096), (8192), (16384), (32768)) v(b) WHERE b >= least(32768, n_chars)) AS bucket FROM documents")
def clamps_and_buckets(t):
    n = F.col("n_chars") % 90
    buckets = F.array(*(F.lit(2048 << k) for k in range(5)))
    bucket = F.array_min(F.filter(buckets, lambda b: b >= F.least(F.lit(32768), F.col("n_chars"))))
    return t.documents.select("doc_id", F.greatest(F.lit(40), F.least(F.lit(60), n)).alias("clamped"), F.when(n.between(40, 60), n).otherwise(45).alias("minutes"), bucket.alias("bucket"))


@query("""WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS term FROM documents)
SELECT term, count(*) AS df, min(doc_id) AS first_doc FROM w GROUP BY term HAVING count(*) > 1""")
def document_frequencies(t):
    words = t.documents.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("df"), F.min("doc_id").alias("first_doc")).where("df > 1")


@query("""SELECT p_mfgr, title, n FROM (SELECT split_part(p_type, ' ', 1) AS p_mfgr, lower(p_name) AS title, count(*) AS n, row_number() OVER (PARTITION BY split_part(p_type, ' ', 1) ORDER BY count(*) DESC, lower(p_name)) AS r FROM part GROUP BY 1, 2) WHERE r <= 20""")
def top_names_of_each_kind(t):
    names = t.part.groupBy(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("p_mfgr"), F.lower("p_name").alias("title")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("p_mfgr").orderBy(F.desc("n"), "title")
    return names.withColumn("r", F.row_number().over(w)).where("r <= 20").drop("r")
