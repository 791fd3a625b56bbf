"""Strings, times, numbers, arrays, JSON records and digests, over columns of the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import shapes
from ..operators import chunks, classify
from .registry import query
from .scan import FILES, files


def _pick(values: list[str], key: str):
    return F.get(F.array(*map(F.lit, values)), (F.col(key) % len(values)).cast("int"))


@query(r"""WITH v AS (SELECT page_id, unnest([url, ' ' || url || '  ', replace(url, '://', '://me:' || page_id || '@'), url || '?sig=' || page_id, url || '#' || page_id, 'api_key = ' || sha256(url), 'see ' || regexp_extract(url, '^[a-z]+://([^/]*)', 1), repeat(url, 40)]) AS v FROM pages),
c AS (SELECT page_id, v, CASE WHEN trim(v) LIKE 'api_key = %' THEN 'api_key = [REDACTED]' ELSE substr(trim(v), 1, 1000) END AS c FROM v)
SELECT page_id, v, CASE WHEN contains(c, '://') AND (regexp_matches(c, '^[^/?#]*://[^/?#]*@') OR regexp_matches(c, '://[^?#]*[?][^#]')) THEN '[REDACTED URL]' ELSE c END AS fact FROM c""")
def safe_facts(t):
    """Pages' URLs and what is made of them: with credentials, with a query, as a key's value, within words, beyond the length."""
    url = F.col("url")
    forms = [url, F.concat(F.lit(" "), url, F.lit("  ")), F.replace(url, F.lit("://"), F.concat(F.lit("://me:"), "page_id", F.lit("@"))), F.concat(url, F.lit("?sig="), "page_id"), F.concat(url, F.lit("#"), "page_id")]
    forms += [F.concat(F.lit("api_key = "), F.sha2(url, 256)), F.concat(F.lit("see "), F.regexp_extract(url, "^[a-z]+://([^/]*)", 1)), F.repeat(url, 40)]
    return t.pages.select("page_id", F.explode(F.array(*forms)).alias("v")).select("page_id", "v", classify.safe_fact(F.col("v")).alias("fact"))


@query(f"WITH {FILES} SELECT doc_id, '[[' || regexp_replace(path, '[.]md$', '') || ']]' AS link, CASE WHEN lang IS NULL THEN NULL WHEN doc_id % 3 = 0 THEN name ELSE lang || ' - ' || name END AS title FROM files JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)")
def links_and_titles(t):
    rows = files(t).join(t.documents.select("doc_id", "lang"), "doc_id")
    name = classify.base_name(F.col("path"))
    title = F.concat_ws(" - ", F.when(F.col("doc_id") % 3 != 0, F.col("lang")), name)
    return rows.select("doc_id", F.concat(F.lit("[["), F.regexp_replace("path", r"\.md$", ""), F.lit("]]")).alias("link"), title.alias("title"))


@query(f"""WITH {FILES}, m AS (SELECT path AS name FROM files UNION ALL SELECT name || '/' || path || '/' FROM files UNION ALL SELECT replace(path, '/', chr(92)) FROM files UNION ALL SELECT source || '/../' || name FROM files UNION ALL SELECT url FROM pages UNION ALL SELECT regexp_extract(url, '^[a-z]+://[^/]*(.*)$', 1) FROM pages UNION ALL SELECT regexp_extract(url, '^[a-z]+://(.*)$', 1) FROM pages),
s AS (SELECT name, string_split(rtrim(name, '/'), '/') AS parts FROM m), k AS (SELECT name, parts, NOT (name = '' OR contains(name, chr(92)) OR name LIKE '/%' OR list_has_any(parts, ['', '.', '..']) OR regexp_matches(name, '^[A-Za-z]:')) AS safe FROM s)
SELECT name, CASE WHEN safe THEN parts[1] END AS root, CASE WHEN safe AND len(parts) > 1 THEN array_to_string(parts[2:], '/') END AS path FROM k""")
def archive_names(t):
    """Paths of files and pages as names in archives: as they are, below a folder and with a slash at the end, with other separators, leading out, as URLs."""
    rows, source = files(t), t.documents.select("doc_id", F.col("source").alias("s"))
    own = rows.join(source, "doc_id")
    base, url = classify.base_name(F.col("path")), F.col("url")
    forms = F.array("path", F.concat(base, F.lit("/"), "path", F.lit("/")), F.translate("path", "/", "\\"), F.concat("s", F.lit("/../"), base))
    names = own.select(F.explode(forms).alias("name")).union(t.pages.select(F.explode(F.array(url, F.regexp_extract(url, "^[a-z]+://[^/]*(.*)$", 1), F.regexp_extract(url, "^[a-z]+://(.*)$", 1)))))
    return names.select("name", shapes.archive_name(F.col("name")).alias("x")).select("name", "x.root", "x.path")


@query("""WITH b AS (SELECT doc_id, '[E:' || doc_id || '] and [E:' || (doc_id * 3) || ']' AS body FROM documents), k AS (SELECT doc_id, source FROM documents), c AS (SELECT doc_id, CAST(unnest(regexp_extract_all(body, 'E:([0-9]+)', 1)) AS BIGINT) AS cited FROM b)
SELECT c.doc_id, count(*) AS citations, count(*) FILTER (k.doc_id IS NULL) AS unknown, string_agg('https://forge.example/' || source || '#' || cited, ' ' ORDER BY cited) AS links FROM c LEFT JOIN k ON k.doc_id = cited GROUP BY 1""")
def rendered_citations(t):
    """Evidence tokens of a body become pinned links; unknown ids are counted."""
    body = F.format_string("[E:%d] and [E:%d]", "doc_id", F.col("doc_id") * 3)
    cited = t.documents.select("doc_id", F.explode(F.regexp_extract_all(body, F.lit("E:([0-9]+)"), F.lit(1))).alias("c")).select("doc_id", F.col("c").cast("long").alias("cited"))
    known = t.documents.select(F.col("doc_id").alias("cited"), "source")
    link = F.when(F.col("source").isNotNull(), F.struct("cited", F.concat(F.lit("https://forge.example/"), "source", F.lit("#"), "cited").alias("link")))
    out = cited.join(known, "cited", "left").groupBy("doc_id").agg(F.count("*").alias("citations"), F.count_if(F.col("source").isNull()).alias("unknown"), F.array_sort(F.collect_list(link)).alias("x"))
    return out.select("doc_id", "citations", "unknown", F.array_join(F.transform("x", lambda x: x["link"]), " ").alias("links"))


@query("""SELECT p_size, string_agg(line, chr(10) ORDER BY first) AS body FROM (SELECT p_size, min(p_partkey) AS first, p_brand || chr(9) || p_type || chr(9) || first(replace(p_name, ' ', '') ORDER BY p_partkey) AS line FROM part GROUP BY p_size, p_brand, p_type) GROUP BY p_size""")
def cookie_files(t):
    """The first cookie of each domain, path and name, tab-separated, without tabs and line ends inside."""
    clean = lambda c: F.translate(c, "\t\r\n", "")
    first = t.part.groupBy("p_size", "p_brand", "p_type").agg(F.min("p_partkey").alias("first"), F.min_by(F.translate("p_name", " ", ""), "p_partkey").alias("value"))
    line = F.concat_ws("\t", clean("p_brand"), clean("p_type"), clean("value"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("first", line.alias("line")))), lambda x: x["line"])
    return first.groupBy("p_size").agg(F.array_join(lines, "\n").alias("body"))


@query("""SELECT source, 'Coverage: ' || count(*) || ' files, ' || count(*) FILTER (n_chars > 2000) || ' mapped (' || CAST(round_even(100.0 * count(*) FILTER (n_chars > 2000) / count(*), 0) AS BIGINT) || '%).' AS line FROM documents GROUP BY source""")
def coverage_lines(t):
    mapped = F.count_if(F.col("n_chars") > 2000)
    return t.documents.groupBy("source").agg(F.format_string("Coverage: %d files, %d mapped (%d%%).", F.count("*"), mapped, F.bround(100.0 * mapped / F.count("*"), 0).cast("long")).alias("line"))


_LABELS = ["section_header", "table", "formula", "caption", "picture", "footnote", "text", "list_item", "reference", "Data-Table"]


@query(f"""WITH l AS (SELECT doc_id, lower(replace(({_LABELS})[doc_id % {len(_LABELS)} + 1], '-', '_')) AS label, doc_id % 7 = 0 AS refs, doc_id % 4 = 0 AS defines FROM documents)
SELECT doc_id, CASE label WHEN 'section_header' THEN 'heading' WHEN 'table' THEN 'table' WHEN 'data_table' THEN 'table' WHEN 'formula' THEN 'equation' WHEN 'caption' THEN 'caption' WHEN 'picture' THEN 'visual' WHEN 'footnote' THEN 'footnote' WHEN 'reference' THEN 'reference'
ELSE CASE WHEN refs THEN 'reference' WHEN defines THEN 'definition' ELSE 'prose' END END AS kind, (['GOOD', 'UNKNOWN', 'POOR', 'UNKNOWN'])[doc_id % 4 + 1] AS grade, (['critical', 'supporting', 'major', 'supporting'])[doc_id % 4 + 1] AS importance,
(['concepts', 'people', 'gadgets', 'gizmos'])[doc_id % 4 + 1] AS directory FROM l""")
def evidence_kinds(t):
    """Kinds of layout labels, grades of any spelling, aliases of importance, and directories of kinds."""
    body = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Entropy is defined as "), "text")).otherwise("lower case words")
    heading = F.when(F.col("doc_id") % 7 == 0, " References ").otherwise("Methods")
    given = _pick(["Grade.good", "fine", "poor", ""], "doc_id")
    importance = classify.looked_up(F.lower(_pick(["High", "whatever", "medium", "minor"], "doc_id")), classify.IMPORTANCE, "supporting")
    directory = classify.looked_up(_pick(["concept", "person", "gadget", "gizmo"], "doc_id"), {"concept": "concepts", "person": "people"}, None)
    return t.documents.select(
        "doc_id",
        shapes.known_kind(_pick(_LABELS, "doc_id"), body, heading).alias("kind"),
        shapes.grade(given).alias("grade"),
        importance.alias("importance"),
        F.coalesce(directory, F.concat(_pick(["concept", "person", "gadget", "gizmo"], "doc_id"), F.lit("s"))).alias("directory"),
    )


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), w AS (SELECT doc_id, n, unnest(regexp_extract_all(line, '[A-Za-z0-9_@./:+~<>=!-]{1,300}')) AS token FROM l)
SELECT doc_id, token, CAST(min(n) AS BIGINT) AS line FROM w GROUP BY ALL""")
def first_lines_of_tokens(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    words = lines.select("doc_id", (F.col("n") + 1).cast("long").alias("n"), F.explode(F.regexp_extract_all("line", F.lit("[A-Za-z0-9_@./:+~<>=!-]{1,300}"), F.lit(0))).alias("token"))
    return words.groupBy("doc_id", "token").agg(F.min("n").alias("line"))


@query("""WITH w AS (SELECT doc_id, string_split(text, chr(10)) AS l, regexp_extract_all(text, '[A-Za-z0-9_@./:+~<>=!-]+') AS w FROM documents), n AS (SELECT doc_id, l, w[len(w) // 2 + 1] AS a, coalesce(w[len(w) // 2 + 2], '') AS b FROM w),
i AS (SELECT doc_id, a, b, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM n)
SELECT doc_id, CAST(coalesce(min(n) FILTER (contains(line, a || ' ' || b)), min(n) FILTER (list_contains(regexp_extract_all(line, '[A-Za-z0-9_@./:+~<>=!-]+'), a)), min(n) FILTER (list_contains(regexp_extract_all(line, '[A-Za-z0-9_@./:+~<>=!-]+'), b)), 1) AS BIGINT) AS line FROM i GROUP BY doc_id""")
def lines_of_needles(t):
    """The first line of two words from the middle of a text, if they stand beside each other; else of the first of them that a line has as a word; else 1."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z0-9_@./:+~<>=!-]+"), F.lit(0))
    half = F.expr("size(w) div 2")
    given = t.documents.select("doc_id", F.split("text", "\n").alias("l"), words.alias("w")).select("doc_id", "l", F.get("w", half).alias("a"), F.coalesce(F.get("w", half + 1), F.lit("")).alias("b"))
    lines = given.select("doc_id", "a", "b", F.posexplode("l").alias("n", "line"))
    own = F.regexp_extract_all("line", F.lit("[A-Za-z0-9_@./:+~<>=!-]+"), F.lit(0))
    first = lambda test: F.min(F.when(test, F.col("n") + 1))
    found = F.coalesce(first(F.contains("line", F.concat("a", F.lit(" "), "b"))), first(F.array_contains(own, F.col("a"))), first(F.array_contains(own, F.col("b"))), F.lit(1))
    return lines.groupBy("doc_id").agg(found.cast("long").alias("line"))


@query("""WITH j AS (SELECT event_id, unnest([props, '[' || props || ', "' || event_type || '", null]', '["' || event_type || '", "' || user_id || '"]', '{"n": ' || user_id || '}', '{"n": "' || event_type || '"}', substr(props, 1, 4), event_type]) AS j, generate_subscripts([1, 2, 3, 4, 5, 6, 7], 1) AS form FROM events)
SELECT event_id, form, CASE WHEN json_valid(j) AND json_type(j) = 'ARRAY' THEN array_to_string(list_filter(list_transform(j::JSON[], lambda x: CASE json_type(x) WHEN 'VARCHAR' THEN x ->> '$' WHEN 'NULL' THEN NULL ELSE replace(x::VARCHAR, ': ', ':') END), lambda x: x IS NOT NULL), ',') ELSE '' END AS aliases,
coalesce(TRY_CAST(CASE WHEN json_valid(j) AND json_type(j) = 'OBJECT' THEN json_extract_string(j, '$.n') END AS BIGINT), -1) AS n FROM j""")
def json_with_defaults(t):
    """Lists and numbers of events' properties: of any type, cut off, or no JSON; what isn't what is asked for becomes the default."""
    kind = F.col("event_type")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    forms = [F.col("props"), F.concat(F.lit("["), "props", F.lit(", "), quoted(kind), F.lit(", null]")), F.concat(F.lit("["), quoted(kind), F.lit(", "), quoted(F.col("user_id")), F.lit("]"))]
    forms += [F.concat(F.lit('{"n": '), "user_id", F.lit("}")), F.concat(F.lit('{"n": '), quoted(kind), F.lit("}")), F.substring("props", 1, 4), kind]
    rows = t.events.select("event_id", F.posexplode(F.array(*forms)).alias("form", "j")).withColumn("form", (F.col("form") + 1).cast("long"))
    list_ = F.when(F.col("j").startswith("["), F.from_json("j", "array<string>"))
    return rows.select("event_id", "form", F.array_join(F.coalesce(F.filter(list_, lambda x: x.isNotNull()), F.array().cast("array<string>")), ",").alias("aliases"), F.coalesce(F.get_json_object("j", "$.n").try_cast("long"), F.lit(-1)).alias("n"))


@query("""WITH f AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, event_type, props FROM events), v AS (SELECT event_id, unnest([iso, iso || 'Z', iso || '+0' || event_id % 10 || ':30', replace(iso, 'T', ' '), left(iso, 10), event_type, props, replace(iso, '-0', '-9')]) AS value FROM f)
SELECT event_id, value, CASE WHEN regexp_matches(value, '[+][0-9]{2}:[0-9]{2}$') THEN epoch(TRY_CAST(left(value, 19) AS TIMESTAMP)) - 3600 * value[21:22]::INT - 60 * value[24:25]::INT ELSE epoch(TRY_CAST(rtrim(value, 'Z') AS TIMESTAMP)) END::BIGINT AS seconds FROM v""")
def parsed_times(t):
    """Naive stamps are UTC, offsets count, and what is no time is null."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    forms = F.array(iso, F.concat(iso, F.lit("Z")), F.concat(iso, F.lit("+0"), F.col("event_id") % 10, F.lit(":30")), F.translate(iso, "T", " "), F.left(iso, F.lit(10)), "event_type", "props", F.replace(iso, F.lit("-0"), F.lit("-9")))
    return t.events.select("event_id", F.explode(forms).alias("value")).select("event_id", "value", F.unix_timestamp(F.try_to_timestamp("value")).alias("seconds"))


@query("""WITH x AS (SELECT doc_id, CAST(ceil(n_chars / 4.0) AS BIGINT) AS i, doc_id % 3000 AS o, doc_id % 3 * 8192 AS native FROM documents), y AS (SELECT *, greatest(512, CAST(ceil(i * 0.1) AS BIGINT), CAST(ceil(greatest(1, o) * 0.1) AS BIGINT)) AS margin FROM x), z AS (SELECT *, i + greatest(1, o) + margin AS required FROM y),
r AS (SELECT *, CAST(pow(2, greatest(11, ceil(log2(greatest(1024, 4000, required))))) AS BIGINT) AS requested FROM z) SELECT doc_id, margin, required, requested, CASE WHEN native > 0 THEN least(requested, native) ELSE requested END AS effective FROM r""")
def context_plans(t):
    plan = shapes.context_plan(F.ceil(F.col("n_chars") / 4).cast("long"), F.col("doc_id") % 3000, F.lit(4000), F.col("doc_id") % 3 * 8192)
    return t.documents.select("doc_id", plan.alias("p")).select("doc_id", "p.margin", "p.required", "p.requested", "p.effective")


@query("""SELECT p_partkey, CASE WHEN p_size % 4 > 0 THEN CAST(8192 * (p_size % 4) AS BIGINT) * p_size * 8 * 256 * 2 ELSE greatest(268435456, CAST(ceil(p_partkey * 1000000 * 0.08 * greatest(1.0, 20000 / 16384)) AS BIGINT)) END AS bytes FROM part""")
def cache_estimates(t):
    context = F.when(F.col("p_size") % 4 > 0, 8192 * (F.col("p_size") % 4)).otherwise(20000)
    heads = F.when(F.col("p_size") % 4 > 0, 8).otherwise(0)
    return t.part.select("p_partkey", shapes.cache_bytes(context, F.col("p_size"), heads, F.lit(128), F.lit(128), F.col("p_partkey") * 1_000_000).alias("bytes"))


@query("SELECT user_id, round(sum(round(value, 3)), 2) AS seconds, count(*) AS calls FROM events GROUP BY user_id")
def running_seconds(t):
    """Sums of durations rounded to three places each."""
    return t.events.groupBy("user_id").agg(F.round(F.sum(F.round("value", 3)), 2).alias("seconds"), F.count("*").alias("calls"))


@query("""SELECT o_custkey, array_to_string(list_sort(list_distinct(list_concat(list('E' || o_orderkey % 9), list('E' || o_orderkey % 4)))), ',') AS ids, len(list_distinct(list('E' || o_orderkey % 9))) AS listed FROM orders GROUP BY o_custkey""")
def item_evidence_ids(t):
    """Ids from a list and from a single field, blank ones left out."""
    id_ = lambda k: F.concat(F.lit("E"), (F.col("o_orderkey") % k).cast("string"))
    rows = t.orders.groupBy("o_custkey").agg(F.collect_list(F.concat(F.lit(" "), id_(9))).alias("many"), F.collect_list(id_(4)).alias("one"))
    many = shapes.clean_strings(F.concat("many", F.array(F.lit(" "))))
    return rows.select("o_custkey", F.array_join(F.array_sort(F.array_union(many, shapes.clean_strings(F.col("one")))), ",").alias("ids"), F.size(F.array_distinct(many)).cast("long").alias("listed"))


@query("""SELECT o_custkey, array_to_string(list_slice(list_distinct_ordered, 1, 4), ',') AS ids FROM (SELECT o_custkey, list(k ORDER BY first) AS list_distinct_ordered FROM (SELECT o_custkey, o_orderkey % 6 AS k, min(o_orderkey) AS first FROM orders GROUP BY ALL) GROUP BY o_custkey)""")
def ordered_distinct_ids(t):
    """The first different ids in their order; the first entries of a map keep theirs."""
    lists = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", (F.col("o_orderkey") % 6).cast("string").alias("k")))).alias("x"))
    return lists.select("o_custkey", F.array_join(F.slice(F.array_distinct(F.transform("x", lambda x: x["k"])), 1, 4), ",").alias("ids"))


@query("""SELECT s_suppkey, sha256('{"base":"' || lower(s_name) || '","provider":"p' || s_nationkey || '"}') AS identity, sha256('v2' || chr(0) || s_nationkey || chr(0) || s_suppkey % 7) AS config, sha256(sha256('base') || ':' || s_suppkey || ':' || s_nationkey) AS item,
'sha256/' || substr(sha256(s_name), 1, 2) || '/' || sha256(s_name) || CASE WHEN s_suppkey % 2 = 0 THEN '.mp4' ELSE '' END AS key FROM supplier""")
def storage_identities(t):
    """Digests of a target without its secrets, of a scan's version and settings, of an item under a base, and keys by content."""
    record = F.to_json(F.struct(F.lower("s_name").alias("base"), F.concat(F.lit("p"), "s_nationkey").alias("provider")))
    config = F.concat_ws("\0", F.lit("v2"), "s_nationkey", F.col("s_suppkey") % 7)
    item = F.concat_ws(":", F.sha2(F.lit("base"), 256), "s_suppkey", "s_nationkey")
    suffix = F.when(F.col("s_suppkey") % 2 == 0, ".MP4").otherwise(".tar gz")
    return t.supplier.select("s_suppkey", F.sha2(record, 256).alias("identity"), F.sha2(config, 256).alias("config"), F.sha2(item, 256).alias("item"), shapes.content_key(F.sha2("s_name", 256), suffix).alias("key"))


@query("""SELECT doc_id, sha256('{"evidence":[' || doc_id || ',' || doc_id + 1 || '],"prompt":"' || lang || '"}') AS input_hash, CAST(ceil(length('{"evidence":[' || doc_id || ',' || doc_id + 1 || '],"prompt":"' || lang || '"}') / 4.0) AS BIGINT) AS tokens FROM documents""")
def input_signatures(t):
    """Digest and token estimate of the canonical JSON of what a document is made from."""
    record = F.to_json(F.struct(F.array("doc_id", F.col("doc_id") + 1).alias("evidence"), F.col("lang").alias("prompt")))
    return t.documents.select("doc_id", F.sha2(record, 256).alias("input_hash"), F.ceil(F.length(record) / 4).alias("tokens"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_discount < 0.01 THEN NULL ELSE round(l_extendedprice / 7, 3) END AS l, CASE WHEN l_linenumber % 2 = 0 THEN 'top' END AS origin FROM lineitem WHERE NOT (l_discount < 0.01 AND l_linenumber % 2 = 1)""")
def boxes(t):
    x = F.when(F.col("l_discount") < 0.01, F.lit(float("nan"))).otherwise(F.col("l_extendedprice") / 7)
    b = shapes.box(x, F.lit(float("inf")), F.lit(float("nan")), F.lit(float("nan")), F.when(F.col("l_linenumber") % 2 == 0, "top").otherwise(""))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", b.alias("b")).where("b IS NOT NULL")
    return rows.select("l_orderkey", "l_linenumber", F.col("b")["l"].cast("double").alias("l"), F.col("b")["origin"].alias("origin"))


@query("""SELECT doc_id, doc_id % 4 <> 3 AS valid, CASE WHEN doc_id % 4 = 3 THEN '' ELSE array_to_string(list_sort(list_distinct(['E' || doc_id, 'E' || doc_id % 5, 'X'])), ',') END AS ids, CASE WHEN doc_id % 4 = 3 THEN '' ELSE 'evidence ids: E' || doc_id || '; E' || doc_id % 5 || '. part: note: ' || lang || '. evidence id: X' END AS readable FROM documents""")
def replies_as_json(t):
    """Replies bare, in fences, after reasoning, or broken: their ids at any depth and their flat text."""
    body = F.format_string('{"evidence_ids": ["E%d", "E%d"], "part": {"note": "%s", "evidence_id": "X"}, "none": null}', "doc_id", F.col("doc_id") % 5, "lang")
    text = F.when(F.col("doc_id") % 4 == 0, body).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nDone."))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("<think>{ no }</think> It is "), body, F.lit(" and so on."))).otherwise("no value")
    rows = shapes.replies(t.documents.select("doc_id", text.alias("text")), "doc_id", "text")
    return rows.select("doc_id", "valid", F.array_join("ids", ",").alias("ids"), F.replace("readable", F.lit("note: "), F.lit("note: ")).alias("readable"))


_ESC = "replace(replace({}, '<', '&lt;'), '>', '&gt;')"


@query(f"""SELECT doc_id, '[Image omitted for local-only safety: ' || lang || '] ' || {_ESC.format('text')} || ' &lt;b&gt;<!--E:' || doc_id || '-->&#36;=' || source || chr(10) || '```text' || chr(10) || text || chr(10) || '```' || chr(10) || '&lt;i&gt;' || {_ESC.format("substr(text, 1, 80)")} AS body FROM documents""")
def inert_documents(t):
    """Documents between an image, tags, evidence and an inline query, and again within a fence."""
    line = F.concat(F.lit("!["), "lang", F.lit("](http://x/"), "source", F.lit(".png) "), "text", F.lit(" <b><!--E:"), "doc_id", F.lit("-->$="), "source")
    body = F.concat(line, F.lit("\n```dataviewjs\n"), "text", F.lit("\n```\n<i>"), F.substring("text", 1, 80))
    return shapes.inert_bodies(t.documents.select("doc_id", body.alias("text")), "doc_id", "text")


@query("""SELECT doc_id, lang, coalesce(quality::VARCHAR, '-') AS quality, source AS project FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)""")
def assembled_metadata(t):
    """Nulls are dropped, extra keys override, and what is left is looked up by name."""
    quality = t.labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = t.documents.join(quality, "doc_id", "left")
    own = F.create_map(F.lit("lang"), F.col("lang"), F.lit("quality"), F.col("quality").cast("string"))
    extra = F.create_map(F.lit("project"), F.col("source"))
    meta = F.map_filter(F.map_concat(own, extra), lambda k, v: v.isNotNull())
    return rows.select("doc_id", meta.alias("m")).select("doc_id", F.col("m")["lang"].alias("lang"), F.coalesce(F.col("m")["quality"], F.lit("-")).alias("quality"), F.col("m")["project"].alias("project"))


@query("""SELECT o_custkey, lower(o_orderpriority) AS entry, max(CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END) AS importance, array_to_string(list_sort(list_distinct(list(o_orderkey % 3))), ',') AS ids, count(*) AS merged FROM orders WHERE o_orderkey % 3 <> 1 GROUP BY ALL""")
def sanitized_entries(t):
    """Entries with allowed ids only, one for each folded text: the highest importance and all ids stay."""
    rank = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "O", 2).otherwise(1)
    rows = t.orders.where("o_orderkey % 3 <> 1").groupBy("o_custkey", F.lower("o_orderpriority").alias("entry"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_set(F.col("o_orderkey") % 3)), lambda x: x.cast("string")), ",")
    return rows.agg(F.max(rank).alias("importance"), ids.alias("ids"), F.count("*").alias("merged"))


@query("""SELECT p_partkey, coalesce(nullif(trim(CASE WHEN p_size % 2 = 0 THEN p_name ELSE ' ' END), ''), nullif(CASE WHEN p_size % 3 = 0 THEN p_brand END, ''), p_type) AS summary FROM part""")
def first_usable_summary(t):
    usable = lambda c: F.when(F.trim(c) != "", F.trim(c))
    a, b = F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(" "), F.when(F.col("p_size") % 3 == 0, F.col("p_brand"))
    return t.part.select("p_partkey", F.coalesce(usable(a), usable(b), F.col("p_type")).alias("summary"))


@query("""WITH f AS (SELECT conv_id, turn, role FROM conversations) SELECT conv_id, count(*) AS entries, count(DISTINCT role) AS kept, sha256(string_agg(DISTINCT role, ',' ORDER BY role)) AS ledger FROM f GROUP BY conv_id""")
def compact_ledgers(t):
    """A ledger is replaced by its count and its digest."""
    roles = F.array_sort(F.collect_set("role"))
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("entries"), F.size(roles).cast("long").alias("kept"), F.sha2(F.array_join(roles, ","), 256).alias("ledger"))


@query()
def trailing_line_chunks(t):
    """tests/test_shapes.py holds the chunks against a plain rule."""
    pieces = chunks.trailing_line_chunks(t.documents, "doc_id", "text", 2400, 300)
    return pieces.select("doc_id", "chunk_index", F.length("body").alias("chars"), F.sha2("body", 256).alias("body_hash"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), c AS (SELECT *, doc_id % 5 + 1 AS cited FROM l)
SELECT doc_id, CAST(n AS BIGINT) AS line, contains(line, 'the') AS preferred FROM c WHERE n BETWEEN cited - 1 AND cited + 1 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY NOT contains(line, 'the'), n) <= 2""")
def fragments_of_cited_lines(t):
    """Lines around those that facts cite, at most two a text, those that hold a needle first (the number is what the report shows)."""
    lines = t.documents.select("doc_id", (F.col("doc_id") % 5 + 1).alias("cited"), F.posexplode(F.split("text", "\n")).alias("n", "line"))
    near = lines.select("doc_id", "line", "cited", (F.col("n") + 1).cast("long").alias("at")).where("at BETWEEN cited - 1 AND cited + 1")
    w = Window.partitionBy("doc_id").orderBy(F.desc(F.contains("line", F.lit("the"))), "at")
    return near.withColumn("k", F.row_number().over(w)).where("k <= 2").select("doc_id", F.col("at").alias("line"), F.contains("line", F.lit("the")).alias("preferred"))
