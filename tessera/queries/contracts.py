"""Contracts of generated records: leaves, reductions, memory, scripts; facts of all manifest formats; files by content."""

from __future__ import annotations

import json
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import shapes
from ..operators import external, facts
from ..sources import captions
from .registry import query


@query("""SELECT doc_id, 'L' || doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'from text' ELSE lang END AS summary, CASE WHEN doc_id % 2 = 0 THEN 'a,b' ELSE '' END AS facts, doc_id % 5 <> 0 AS complete, 'topic,x,y' AS topics FROM documents WHERE NOT (doc_id % 3 = 1 AND doc_id % 7 = 0)""")
def leaf_contracts(t):
    """A leaf's id is forced, its facts are cleaned, a summary is required (a fallback topic may give it), alias fields merge into one; leaves without any summary are refused."""
    given = F.when(F.col("doc_id") % 3 == 0, F.lit(None)).when((F.col("doc_id") % 3 == 1) & (F.col("doc_id") % 7 == 0), F.lit(" ")).otherwise(F.col("lang"))
    rows = t.documents.select("doc_id", given.alias("summary"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(" a"), F.lit(""), F.lit("b "))).alias("facts"), F.when(F.col("doc_id") % 3 == 0, "from text").alias("fallback"))
    summary = F.coalesce(F.when(F.trim("summary") != "", F.trim("summary")), F.col("fallback"))
    merged = F.array_distinct(F.concat(shapes.clean_strings(F.array(F.lit("topic"))), shapes.clean_strings(F.array(F.lit("x"), F.lit(" topic "))), F.array(F.lit("y"))))
    out = rows.select("doc_id", F.concat(F.lit("L"), "doc_id").alias("id"), summary.alias("summary"), F.array_join(shapes.clean_strings(F.col("facts")), ",").alias("facts"), (F.col("doc_id") % 5 != 0).alias("complete"), F.array_join(merged, ",").alias("topics"))
    return out.where("summary IS NOT NULL")


@query("""WITH r AS (SELECT l_orderkey, list_sort(list_distinct(list(l_partkey))) AS input, list_sort(list_distinct(list(CASE WHEN l_orderkey % 4 = 0 THEN l_partkey + 1 ELSE l_partkey END))) AS ledger FROM lineitem GROUP BY 1) SELECT l_orderkey, input = ledger AS exact, len(list_filter(ledger, lambda x: NOT list_contains(input, x))) AS unsupported FROM r""")
def reduce_contracts(t):
    """A reduction's ledger is exactly its input's ids, and its facts cite supported ids only."""
    said = F.when(F.col("l_orderkey") % 4 == 0, F.col("l_partkey") + 1).otherwise(F.col("l_partkey"))
    rows = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("input"), F.array_sort(F.collect_set(said)).alias("ledger"))
    return rows.select("l_orderkey", (F.col("input") == F.col("ledger")).alias("exact"), F.size(F.array_except("ledger", "input")).cast("long").alias("unsupported"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'P' || o_custkey || ',S' || o_orderkey % 5 WHEN o_orderkey % 3 = 1 THEN 'pub' || o_custkey ELSE '' END AS lineage FROM orders""")
def lineage_ids(t):
    """Lineage ids from the private field first, else from the public one."""
    private = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.concat(F.lit("P"), "o_custkey"), F.concat(F.lit("S"), F.col("o_orderkey") % 5), F.concat(F.lit("P"), "o_custkey")))
    public = F.when(F.col("o_orderkey") % 3 != 2, F.array(F.concat(F.lit("pub"), "o_custkey"), F.lit(" ")))
    ids = F.coalesce(private, public, F.array().cast("array<string>"))
    return t.orders.select("o_orderkey", F.array_join(F.array_distinct(shapes.clean_strings(ids)), ",").alias("lineage"))


@query("""WITH e AS (SELECT o_custkey, o_orderpriority AS item, min(o_orderkey) AS first FROM orders GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY first) AS n FROM e), l AS (SELECT o_custkey, max_by(o_orderstatus, o_orderkey) AS newest, count(DISTINCT o_orderkey % 7) AS ids, sha256(array_to_string(list_sort(list_distinct(list((o_orderkey % 7)::VARCHAR))), ',')) AS ledger FROM orders GROUP BY 1)
SELECT o_custkey, string_agg(item, ',' ORDER BY n) FILTER (n <= 3) AS terms, any_value(newest) AS open, any_value(ids) AS ids, any_value(ledger) AS ledger FROM k JOIN l USING (o_custkey) GROUP BY o_custkey""")
def memory_states(t):
    """Fields that grow keep their first different entries, up to a number; fields that are replaced keep the newest; ids are joined to a count and a digest."""
    firsts = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("first"))
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("first"))
    kept = firsts.withColumn("n", n).where("n <= 3").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "o_orderpriority"))), lambda x: x["o_orderpriority"]), ",").alias("terms"))
    ids = F.array_sort(F.collect_set((F.col("o_orderkey") % 7).cast("string")))
    other = t.orders.groupBy("o_custkey").agg(F.max_by("o_orderstatus", "o_orderkey").alias("open"), F.size(ids).cast("long").alias("ids"), F.sha2(F.array_join(ids, ","), 256).alias("ledger"))
    return kept.join(other, "o_custkey")


@query("""WITH s AS (SELECT conv_id, turn, role, count(*) OVER (PARTITION BY conv_id, role) AS same FROM conversations) SELECT conv_id, count(*) AS segments, count(*) FILTER (role = 'system') AS unknown, count(*) FILTER (same > 1) AS doubled, string_agg(DISTINCT role, ',' ORDER BY role) AS ledger FROM s GROUP BY conv_id""")
def script_ledgers(t):
    """The evidence ledger of each script; segments that cite twice or cite unknown ids are counted for refusal."""
    rows = t.conversations.withColumn("same", F.count("*").over(Window.partitionBy("conv_id", "role")))
    return rows.groupBy("conv_id").agg(F.count("*").alias("segments"), F.count_if(F.col("role") == "system").alias("unknown"), F.count_if(F.col("same") > 1).alias("doubled"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("ledger"))


def _json_client():
    """A stand-in for a JSON function: some answers are in prose first, some never hold JSON."""
    seen: dict[str, int] = {}

    def f(text: str) -> str:
        seen[text] = seen.get(text, 0) + 1
        n = int(text.rsplit(" ", 1)[1])
        if n % 7 == 0 or (n % 3 == 0 and seen[text] == 1):
            answer = "Sorry, no record."
        else:
            answer = "Here: " + json.dumps({"evidence_ids": [text.split(" ")[0], str(n)]})
        if shapes.loaded(answer) is None:
            raise external.Transient()
        return answer[answer.index("{") :]

    return f


@query("""SELECT p_partkey, p_partkey % 7 <> 0 AS valid, CASE WHEN p_partkey % 7 <> 0 THEN array_to_string(list_sort([split_part(p_name, ' ', 1), p_partkey::VARCHAR]), ',') END AS ids, CASE WHEN p_partkey % 7 = 0 THEN 3 WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS attempts FROM part""")
def external_json(t):
    """Calls whose answers must hold JSON: an answer without it is tried again."""
    rows = t.part.select("p_partkey", F.concat_ws(" ", "p_name", "p_partkey").alias("text"))
    done = external.completed(rows, "p_partkey", "text", _json_client, attempts=3, wait=0.0)
    parsed = F.from_json("output", "evidence_ids array<string>")
    return done.select("p_partkey", F.col("output").isNotNull().alias("valid"), F.when(F.col("output").isNotNull(), F.array_join(F.array_sort(parsed["evidence_ids"]), ",")).alias("ids"), "attempts")


_KINDS = ["package.json", "composer.json", "go.mod", "requirements.txt", "pyproject.toml", "Dockerfile", "compose.yml"]


@query(f"""WITH k AS (SELECT p_partkey, ({_KINDS})[p_partkey % 7 + 1] AS name FROM part) SELECT p_partkey, CASE name WHEN 'package.json' THEN 'npm' WHEN 'composer.json' THEN 'composer' WHEN 'go.mod' THEN 'go' WHEN 'requirements.txt' THEN 'pip' WHEN 'pyproject.toml' THEN 'pip' WHEN 'Dockerfile' THEN 'image' ELSE 'image' END AS ecosystem, 'dep' || p_partkey AS name FROM k""")
def manifest_facts(t):
    """Facts of manifests by their format, with what they are facts of; each format's files alone are parsed."""
    n, kind = F.col("p_partkey").cast("string"), F.get(F.array(*map(F.lit, _KINDS)), (F.col("p_partkey") % 7).cast("int"))
    body = {
        "package.json": F.concat(F.lit('{"dependencies": {"dep'), n, F.lit('": "^1"}}')),
        "composer.json": F.concat(F.lit('{"require": {"dep'), n, F.lit('": "*"}}')),
        "go.mod": F.concat(F.lit("module x\nrequire dep"), n, F.lit(" v1.0.0\n")),
        "requirements.txt": F.concat(F.lit("# why\ndep"), n, F.lit(">=2\n")),
        "pyproject.toml": F.concat(F.lit('[project]\ndependencies = ["dep'), n, F.lit('>=2"]\n')),
        "Dockerfile": F.concat(F.lit("FROM dep"), n, F.lit("\nRUN x\n")),
        "compose.yml": F.concat(F.lit("svc:\n  image: dep"), n, F.lit("\n")),
    }
    text = F.lit("")
    for name, value in body.items():
        text = F.when(kind == name, value).otherwise(text)
    files = t.part.select("p_partkey", kind.alias("kind"), text.alias("text"))
    of = lambda name: files.where(F.col("kind") == name).select("p_partkey", "text")
    fact = lambda rows, ecosystem, name="name": rows.select("p_partkey", F.lit(ecosystem).alias("ecosystem"), F.col(name).alias("name"))
    images = captions.numbered(of("compose.yml"), "p_partkey", "text").select("p_partkey", F.regexp_extract("line", r"^\s*image:\s*(\S+)", 1).alias("name")).where("name <> ''")
    parts = [
        fact(facts.package_dependencies(of("package.json"), "p_partkey", "text"), "npm"),
        fact(facts.json_sections(of("composer.json"), "p_partkey", "text", {"require": "runtime"}), "composer"),
        fact(facts.module_requirements(of("go.mod"), "p_partkey", "text"), "go"),
        fact(facts.line_facts(of("requirements.txt"), "p_partkey", "text", "requirement"), "pip"),
        fact(facts.toml_dependencies(of("pyproject.toml"), "p_partkey", "text"), "pip"),
        fact(facts.line_facts(of("Dockerfile"), "p_partkey", "text", "image"), "image", "value"),
        fact(images, "image"),
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


@query("""SELECT p_partkey, 'dependencies' AS kind, '{"ecosystem":"npm","line":' || p_size || ',"name":"' || p_name || '","path":"' || p_brand || '","scope":"' || CASE WHEN p_size % 2 = 0 THEN 'dev' ELSE 'runtime' END || '"}' AS fact FROM part WHERE p_size <= 30
UNION ALL SELECT p_partkey, 'commands', '{"command":"run ' || p_name || '","kind":"script","line":' || p_size || ',"path":"' || p_brand || '"}' FROM part WHERE p_size > 30""")
def fact_records(t):
    """Records of dependencies and of commands, in canonical form."""
    dependency = F.to_json(F.struct(F.lit("npm").alias("ecosystem"), F.col("p_size").alias("line"), F.col("p_name").alias("name"), F.col("p_brand").alias("path"), F.when(F.col("p_size") % 2 == 0, "dev").otherwise("runtime").alias("scope")))
    command = F.to_json(F.struct(F.concat(F.lit("run "), "p_name").alias("command"), F.lit("script").alias("kind"), F.col("p_size").alias("line"), F.col("p_brand").alias("path")))
    few = F.col("p_size") <= 30
    return t.part.select("p_partkey", F.when(few, "dependencies").otherwise("commands").alias("kind"), F.when(few, dependency).otherwise(command).alias("fact"))


@query("""SELECT DISTINCT 'node' || c_nationkey % 9 AS service FROM customer WHERE c_acctbal > 0""")
def log_services(t):
    """Names of services, from the names of their log files."""
    path = F.format_string("/var/log/app/node%d.%d.log", F.col("c_nationkey") % 9, F.col("c_custkey"))
    return t.customer.where("c_acctbal > 0").select(F.regexp_extract(path, r"([^/.]+)\.[^/]*\.log$", 1).alias("service")).distinct()


def _page_blocks(html: str) -> list[tuple[str, str]]:
    """A stand-in for a layout parser: headings and paragraphs of a page."""
    return re.findall(r"<(h[1-6]|p)>([^<]*)", html)


@query("""WITH n AS (SELECT page_id, regexp_extract_all(html, '<(h[1-6]|p)>([^<]*)', 1) AS k, regexp_extract_all(html, '<(h[1-6]|p)>([^<]*)', 2) AS x FROM pages)
SELECT page_id, 'ok' AS status, generate_subscripts(k, 1) - 1 AS place, unnest(k) AS kind, sha256(unnest(x)) AS digest FROM n WHERE len(k) <= 12 UNION ALL SELECT page_id, 'refused', NULL, NULL, NULL FROM n WHERE len(k) > 12""")
def parsed_pages(t):
    """Blocks of pages by a parser that is handed in; a page beyond the limit is refused whole."""
    rows = external.parsed(t.pages, "page_id", "html", _page_blocks, 12)
    return rows.select("page_id", "status", "place", "kind", F.sha2("text", 256).alias("digest"))
