"""Sources, chunkers, facts, reductions, coverage and streams, on texts and logs derived from the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import chunks, facts
from ..plans import coverage, reduce
from ..sources import captions, markdown
from ..streaming import jobs as streams
from .registry import query


@query("SELECT doc_id, lang, source, CAST(n_chars AS VARCHAR) AS chars, sha256(text) AS body_hash FROM documents")
def front_matter_round_trip(t):
    whole = markdown.assembled({"lang": F.col("lang"), "source": F.col("source"), "chars": F.col("n_chars")}, F.col("text"))
    rows = markdown.parsed(t.documents.select("doc_id", whole.alias("content")), "content")
    meta = lambda k: F.col("meta")[k].alias(k)
    return rows.select("doc_id", meta("lang"), meta("source"), meta("chars"), F.sha2("body", 256).alias("body_hash"))


@query("""SELECT conv_id, turn + 1 AS n, '[00:' || printf('%02d', turn % 60) || ':00] ' || replace(text, chr(10), ' ') AS line FROM
(SELECT *, lag(replace(text, chr(10), ' ')) OVER (PARTITION BY conv_id ORDER BY turn) AS was FROM conversations) WHERE (was IS NULL OR was <> replace(text, chr(10), ' ')) AND trim(replace(text, chr(10), ' ')) <> ''""")
def caption_lines(t):
    said = F.translate("text", "\n", " ")
    cue = F.concat(F.format_string("00:%02d:00.000 --> 00:59:59.000", F.col("turn") % 60), F.lit("\n<v>"), said, F.lit("</v>\n"))
    file = t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", cue.alias("cue")))), lambda x: x["cue"]), "\n").alias("text"))
    lines = captions.cue_lines(file.select("conv_id", F.concat(F.lit("WEBVTT\n\n"), "text").alias("text")), "conv_id", "text")
    return lines.select("conv_id", F.floor((F.col("line_number") - 1) / 3).alias("n"), "line")


@query("""SELECT doc_id, CAST(sha256(text) AS VARCHAR) AS joined_hash, TRUE AS bounded FROM documents""")
def lossless_pieces(t):
    pieces = chunks.lossless_chunks(t.documents, "doc_id", "text", 2000)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "body"))), lambda x: x["body"]), "")
    return pieces.groupBy("doc_id").agg(F.sha2(joined, 256).alias("joined_hash"), (F.max(F.length("body")) <= 2000).alias("bounded"))


@query("""WITH RECURSIVE l AS (SELECT doc_id, generate_subscripts(a, 1) AS r, len(a) AS n, unnest(a) AS line, generate_subscripts(a, 1) < len(a) AS more FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
x AS (SELECT doc_id, r, n, CASE WHEN more THEN line || chr(10) ELSE line END AS line FROM l), f AS (SELECT doc_id, r, n, line AS held, CAST(NULL AS VARCHAR) AS done, 0 AS k FROM x WHERE r = 1
UNION ALL SELECT x.doc_id, x.r, x.n, CASE WHEN length(held) > 0 AND length(held) + length(line) > 1800 THEN right(trim(held, ' ' || chr(10) || chr(9)), 200) || line ELSE held || line END,
CASE WHEN length(held) > 0 AND length(held) + length(line) > 1800 THEN trim(held, ' ' || chr(10) || chr(9)) END, CASE WHEN length(held) > 0 AND length(held) + length(line) > 1800 THEN k + 1 ELSE k END FROM f JOIN x ON x.doc_id = f.doc_id AND x.r = f.r + 1),
o AS (SELECT doc_id, k - 1 AS chunk_index, done AS body FROM f WHERE done IS NOT NULL UNION ALL SELECT doc_id, k, trim(held, ' ' || chr(10) || chr(9)) FROM f WHERE r = n AND trim(held, ' ' || chr(10) || chr(9)) <> '')
SELECT doc_id, chunk_index, length(body) AS chars, sha256(body) AS body_hash FROM o""")
def overlapping_pieces(t):
    pieces = chunks.overlapping_chunks(t.documents, "doc_id", "text")
    return pieces.select("doc_id", "chunk_index", F.length("body").alias("chars"), F.sha2("body", 256).alias("body_hash"))


@query("""SELECT DISTINCT l_orderkey, CASE l_returnflag WHEN 'A' THEN 'dependencies' WHEN 'N' THEN 'devDependencies' ELSE 'peerDependencies' END AS section, 'part' || l_partkey AS name FROM lineitem""")
def package_facts(t):
    rows = t.lineitem.select("l_orderkey", "l_returnflag", F.concat(F.lit("part"), "l_partkey").alias("name")).distinct()
    flag = lambda f: F.map_from_entries(F.collect_list(F.when(F.col("l_returnflag") == f, F.struct("name", F.lit("^1.0").alias("version")))))
    text = F.to_json(F.struct(flag("A").alias("dependencies"), flag("N").alias("devDependencies"), flag("R").alias("peerDependencies")))
    files = rows.groupBy("l_orderkey").agg(text.alias("text"))
    return facts.package_dependencies(files, "l_orderkey", "text").select("l_orderkey", "section", "name")


@query("""SELECT o_custkey, CAST(2 * row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS line, 'order-' || o_orderkey AS name, '>=' || CAST(o_orderkey % 9 AS VARCHAR) AS value FROM orders""")
def requirement_facts(t):
    line = F.concat(F.lit("# bought\norder-"), "o_orderkey", F.lit(" >="), F.col("o_orderkey") % 9)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))), lambda x: x["line"])
    files = t.orders.groupBy("o_custkey").agg(F.array_join(lines, "\n").alias("text"))
    return facts.line_facts(files, "o_custkey", "text", "requirement").select("o_custkey", F.col("line_number").cast("long").alias("line"), "name", "value")


@query("""SELECT o_custkey, count(*) AS items, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS ids FROM orders GROUP BY o_custkey""")
def reduced_level_by_level(t):
    items = t.orders.select("o_custkey", "o_orderkey", F.floor(F.col("o_totalprice") / 1000).alias("size"))
    out = reduce.reduced(items, "o_custkey", "o_orderkey", "size", 900, 3)
    return out.select("o_custkey", F.size("ids").cast("long").alias("items"), F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


_EVIDENCE = "e AS (SELECT d.doc_id, source, n_chars >= 400 AS covered, coalesce(quality, 0) = 1 AS critical FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id))"


def _evidence(t):
    quality = t.labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return t.documents.join(quality, "doc_id", "left").select("doc_id", "source", (F.col("n_chars") >= 400).alias("covered"), (F.coalesce("quality", F.lit(0)) == 1).alias("critical"))


@query(f"""WITH {_EVIDENCE} SELECT source, count(*) AS total, count(*) FILTER (covered) AS covered, count(*) FILTER (critical) AS critical,
CAST(CASE WHEN count(*) FILTER (critical) = 0 THEN 100 ELSE round(100.0 * count(*) FILTER (critical AND covered) / count(*) FILTER (critical)) END AS BIGINT) AS percent FROM e GROUP BY source""")
def coverage_by_source(t):
    return coverage.percentages(_evidence(t), ["source"], "covered", "critical")


@query(f"WITH {_EVIDENCE} SELECT doc_id, CAST(least(4, floor(doc_id * 5 / (SELECT count(*) FROM e))) AS BIGINT) AS part FROM e WHERE NOT covered")
def backfilled_evidence(t):
    rows = _evidence(t)
    return coverage.backfilled(rows, "doc_id", "doc_id", rows.where("covered"), 5)


@query(f"WITH {_EVIDENCE} SELECT doc_id FROM e WHERE critical AND NOT covered AND source NOT IN ('src1', 'src2')")
def critical_evidence_missing(t):
    rows = _evidence(t)
    return coverage.missing(rows.where("critical"), rows.where("covered"), rows.where("source IN ('src1', 'src2')"), "doc_id")


@query("SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) AS body FROM documents")
def lines_two_to_four(t):
    return captions.line_range(t.documents, "doc_id", "text", F.lit(2), F.lit(4))


@query("SELECT user_id, last(event_type ORDER BY ts, event_id) AS event_type, count(*) AS n FROM events GROUP BY user_id")
def streamed_states(t):
    rows = streams.stream(t.spark, f"{t.folder}/event*.parquet", t.events.schema)
    return streams.drained(streams.current_states(rows), "complete")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def streamed_hours(t):
    rows = streams.stream(t.spark, f"{t.folder}/event*.parquet", t.events.schema)
    return streams.drained(streams.hourly(rows), "complete").select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


@query("SELECT epoch(time_bucket(INTERVAL 2 SECOND, ts))::BIGINT AS start, count(*) AS n, round(max(value), 3) AS peak FROM events GROUP BY 1")
def streamed_samples(t):
    """A metric stream sampled every two seconds of event time."""
    rows = streams.stream(t.spark, f"{t.folder}/event*.parquet", t.events.schema)
    return streams.drained(streams.sampled(rows, "value"), "complete").select(F.unix_timestamp("start").alias("start"), "n", F.round("peak", 3).alias("peak"))


@query("""WITH e AS (SELECT *, min(CASE WHEN event_type IN ('purchase', 'error') THEN r END) OVER (PARTITION BY user_id) AS stop, max(r) OVER (PARTITION BY user_id) AS last FROM
(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events))
SELECT user_id, event_type AS status, last - r AS rejected FROM e WHERE r = coalesce(stop, last)""")
def streamed_terminal_states(t):
    rows = streams.stream(t.spark, f"{t.folder}/event*.parquet", t.events.schema)
    return streams.drained(streams.fixed_states(rows, ["purchase", "error"]), "update")


@query("""WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, '<(h[1-6]|p)>', 1)) AS tag, generate_subscripts(regexp_extract_all(html, '<(h[1-6]|p)>', 1), 1) AS place FROM pages)
SELECT page_id, place, tag, (SELECT count(*) FROM b h WHERE h.page_id = b.page_id AND h.place <= b.place AND h.tag <> 'p') AS section FROM b""")
def blocks_in_sections(t):
    blocks = t.pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<(h[1-6]|p)>"), F.lit(1))).alias("n", "tag"))
    w = Window.partitionBy("page_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    section = F.count(F.when(F.col("tag") != "p", 1)).over(w)
    return blocks.select("page_id", (F.col("n") + 1).cast("long").alias("place"), "tag", section.alias("section"))


@query("""SELECT o_custkey, lower(o_orderpriority) AS entry, max(CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END) AS importance, min(o_orderkey) AS first_id, count(DISTINCT o_orderkey) AS lineage FROM orders GROUP BY ALL""")
def merged_entries(t):
    rank = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "O", 2).otherwise(1)
    return t.orders.groupBy("o_custkey", F.lower("o_orderpriority").alias("entry")).agg(F.max(rank).alias("importance"), F.min("o_orderkey").alias("first_id"), F.countDistinct("o_orderkey").alias("lineage"))


@query("""WITH w AS (SELECT DISTINCT p_partkey, p_size, p_type, unnest(string_split(p_name, ' ')) AS word FROM part)
SELECT p_partkey, 'dependencies' AS section, word AS name, '>=' || p_size AS version FROM w UNION ALL SELECT p_partkey, 'dev', lower(p_type) || '-x', '==1.' || p_size FROM part UNION ALL SELECT p_partkey, 'runtime', 'python', '>=3.' || p_size FROM part""")
def project_manifests(t):
    """A manifest for each part: its name's words are required, its type in a group."""
    listed = F.array_join(F.transform(F.array_distinct(F.split("p_name", " ")), lambda w: F.format_string('  "%s>=%d",', w, F.col("p_size"))), "\n")
    text = F.concat(F.lit('[project]\nname = "x"\nrequires-python = ">=3.'), "p_size", F.lit('"\ndependencies = [\n'), listed, F.lit('\n]\n[project.optional-dependencies]\ndev = ["'), F.lower("p_type"), F.lit("-x==1."), "p_size", F.lit('"]\n'))
    return facts.toml_dependencies(t.part.select("p_partkey", text.alias("text")), "p_partkey", "text")
