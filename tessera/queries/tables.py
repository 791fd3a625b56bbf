"""Parsers as table functions of SQL, and many search strings at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables
from ..operators import needles
from ..sources.shared import tasks
from .registry import query

#: A part's manifests: names from its name's words, versions and commands from its other columns.
_WORDS = "string_split(p_name, ' ')"


def _manifests(t):
    word = F.transform(F.split("p_name", " "), lambda w: w)
    line = lambda pattern: F.array_join(F.transform(F.array_distinct(word), lambda w: F.format_string(pattern, w, F.col("p_size").cast("string"))), "\n")
    pairs = F.map_from_entries(F.transform(F.array_distinct(word), lambda w: F.struct(w.alias("k"), F.concat(F.lit("^"), F.col("p_size").cast("string")).alias("v"))))
    package = F.to_json(F.struct(pairs.alias("dependencies"), F.create_map(F.lit("start"), F.col("p_type")).alias("scripts"), F.create_map(F.lit("node"), F.concat(F.lit(">="), F.col("p_size").cast("string"))).alias("engines")))
    poetry = F.concat(F.lit("[tool.poetry.dependencies]\n"), line('"%s" = {version = "~%s"}'), F.lit("\n[tool.poetry.scripts]\nrun = '"), F.col("p_type"), F.lit("'\n[project]\nrequires-python = '>=3."), F.col("p_size").cast("string"), F.lit("'\n"))
    files = {"a/package.json": package, "b/pyproject.toml": poetry, "c/requirements.txt": line("%s==%s"), "d/Cargo.toml": F.concat(F.lit("[dev-dependencies]\n"), line("\"%s\" = '%s'")), "e/notes.txt": F.lit("none=1"), "f/package.json": F.concat(F.lit("{broken"), "p_name")}
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("path"), x.alias("text")) for p, x in files.items()))).alias("f")
    return t.part.select("p_partkey", "p_name", "p_size", "p_type").repartition(tasks(t.spark), "p_partkey").select("p_partkey", each).select("p_partkey", "f.path", "f.text")


@query(f"""WITH w AS (SELECT DISTINCT p_partkey, p_size, unnest({_WORDS}) AS name FROM part)
SELECT p_partkey, 'a/package.json' AS path, 'dependencies' AS section, 'dependency' AS kind, name, '^' || p_size AS value FROM w
UNION ALL SELECT p_partkey, 'a/package.json', 'scripts', 'command', 'start', p_type FROM part UNION ALL SELECT p_partkey, 'a/package.json', 'engines', 'runtime', 'node', '>=' || p_size FROM part
UNION ALL SELECT p_partkey, 'b/pyproject.toml', 'poetry', 'dependency', name, '~' || p_size FROM w UNION ALL SELECT p_partkey, 'b/pyproject.toml', 'poetry.scripts', 'command', 'run', p_type FROM part
UNION ALL SELECT p_partkey, 'b/pyproject.toml', 'project', 'runtime', 'python', '>=3.' || p_size FROM part
UNION ALL SELECT p_partkey, 'c/requirements.txt', 'requirements', 'dependency', name, '==' || p_size FROM w UNION ALL SELECT p_partkey, 'd/Cargo.toml', 'dev-dependencies', 'dependency', name, p_size::VARCHAR FROM w""")
def facts_by_table_function(t):
    """Manifests of parts, parsed in SQL; the function's columns follow from the table's."""
    tables.register(t.spark)
    _manifests(t).createOrReplaceTempView("part_manifests")
    return t.spark.sql("SELECT * FROM manifest_facts(TABLE(part_manifests), 'path', 'text')")


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<(h[1-6]|p)>', 1)) AS tag, generate_subscripts(regexp_extract_all(html, '<(h[1-6]|p)>', 1), 1) AS n FROM pages),
h AS (SELECT *, CASE WHEN tag <> 'p' THEN substr(tag, 2)::INT END AS level FROM l),
o AS (SELECT a.page_id, a.n, b.n AS at, b.level FROM h a JOIN h b ON b.page_id = a.page_id AND b.n <= a.n AND b.level IS NOT NULL WHERE NOT EXISTS (SELECT 1 FROM h c WHERE c.page_id = a.page_id AND c.n > b.n AND c.n <= a.n AND c.level <= b.level))
SELECT l.page_id, l.n, coalesce(string_agg('t' || o.at, ' > ' ORDER BY o.at), '') AS section, CAST(count(o.at) AS INT) AS depth FROM l LEFT JOIN o USING (page_id, n) GROUP BY l.page_id, l.n""")
def sections_by_table_function(t):
    """Blocks of pages below their headings: each page's blocks in order are one partition of the function's table."""
    tables.register(t.spark)
    blocks = t.pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<(h[1-6]|p)>"), F.lit(1))).alias("at", "tag"))
    n = F.col("at") + 1
    line = F.when(F.col("tag") != "p", F.concat(F.repeat(F.lit("#"), F.substring("tag", 2, 1).cast("int")), F.lit(" t"), n)).otherwise("text")
    blocks.select("page_id", n.cast("long").alias("n"), line.alias("line")).createOrReplaceTempView("page_blocks")
    return t.spark.sql("SELECT page_id, n, section, depth FROM section_paths(TABLE(page_blocks) PARTITION BY page_id ORDER BY n)")


@query("""WITH n AS (SELECT DISTINCT unnest(list_filter([substr(text, 1, 12), substr(text, 20, 9), substr(text, 41, 15)], lambda x: x <> '')) AS needle FROM benchmark)
SELECT doc_id, needle, strpos(text, needle) AS first FROM documents, n WHERE contains(text, needle)""")
def needles_in_documents(t):
    """Pieces of benchmark passages, wherever they begin and end, in whole texts."""
    pieces = t.benchmark.select(F.explode(F.array(*(F.substring("text", at, n) for at, n in ((1, 12), (20, 9), (41, 15))))).alias("needle"))
    hits = needles.found(t.documents.select("doc_id", "text"), ["doc_id"], "text", needles.shards(pieces, "needle"))
    return hits.select("doc_id", "needle", (F.col("first") + 1).alias("first"))
