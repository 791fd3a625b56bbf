"""Full-text, vector and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import MARKED, PLAIN, tokens
from ..operators import search
from .registry import query

_TOKENS = rf"regexp_extract_all(translate(lower(text), '{MARKED}', '{PLAIN}'), '[\p{{L}}\p{{N}}]+')"
#: The first three different words of each benchmark passage are a query; a word of one letter is no term.
_ASKED = f"asked AS (SELECT item_id AS query_id, unnest(list_slice(list_filter({_TOKENS}, lambda x: length(x) > 1), 1, 3)) AS term FROM benchmark)"


def _ranking(p: str, table: str, key: str) -> str:
    """CTEs of a BM25 ranking of a table's texts; {p}r: query_id, key, rank."""
    return f"""{p}d AS (SELECT {key}, {_TOKENS} AS w FROM {table}), {p}z AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM {p}d), {p}e AS (SELECT {key}, len(w) AS size, unnest(w) AS term FROM {p}d),
{p}h AS (SELECT {key}, term, size, count(*) AS tf FROM {p}e WHERE term IN (SELECT term FROM q) GROUP BY ALL), {p}f AS (SELECT term, count(*) AS df FROM {p}h GROUP BY term),
{p}s AS (SELECT query_id, {key}, count(*) AS held, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 4) AS score FROM {p}h JOIN {p}f USING (term) JOIN q USING (term), {p}z GROUP BY query_id, {key}),
{p}r AS (SELECT query_id, {key}, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {key}) AS rank FROM {p}s JOIN m USING (query_id) WHERE held = wanted)"""


_QUERIES = f"{_ASKED}, q AS (SELECT DISTINCT query_id, term FROM asked), m AS (SELECT query_id, count(*) AS wanted FROM q GROUP BY query_id)"
_RANKED = f"WITH {_QUERIES}, {_ranking('', 'documents', 'doc_id')}"


def _asked(t):
    terms = F.slice(F.filter(tokens(F.col("text")), lambda x: F.length(x) > 1), 1, 3)
    return t.benchmark.select(F.col("item_id").alias("query_id"), terms.alias("terms"))


@query(_RANKED + " SELECT query_id, doc_id, rank FROM r WHERE rank <= 20")
def ranked_search(t):
    return search.ranked(t.documents, _asked(t), 20).select("query_id", "doc_id", "rank")


@query(f"WITH d AS MATERIALIZED (SELECT doc_id, {_TOKENS} AS w FROM documents) SELECT doc_id, term, count(*) AS tf, size FROM (SELECT doc_id, len(w) AS size, unnest(w) AS term FROM d) GROUP BY doc_id, term, size")
def inverted_index(t):
    return search.postings(t.documents)


_COS = "list_dot_product(e.embedding::DOUBLE[], q.c) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.c, q.c)))"


@query(f"""WITH q AS (SELECT label AS query_id, first(embedding ORDER BY vec_id)::DOUBLE[] AS c FROM embeddings GROUP BY label),
s AS (SELECT query_id, vec_id, round({_COS}, 6) AS score FROM embeddings e, q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id DESC) AS rank FROM s)
SELECT query_id, vec_id, rank FROM r WHERE rank <= 10 AND score > 0""")
def nearest_vectors(t):
    queries = t.embeddings.groupBy(F.col("label").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("query"))
    return search.nearest(t.embeddings, queries, 10)


#: A query's vector is the first of a group of embeddings; embeddings belong to the documents with their numbers.
_GROUP = "item_id % 10"
_VECTORS = f"""v AS (SELECT label, first(embedding ORDER BY vec_id)::DOUBLE[] AS c FROM embeddings GROUP BY label), qv AS (SELECT item_id AS query_id, c FROM benchmark JOIN v ON label = {_GROUP}),
near AS (SELECT query_id, vec_id AS doc_id, round({_COS.replace('q.c', 'qv.c')}, 6) AS score FROM embeddings e, qv),
sem AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS rank FROM near WHERE score > 0 QUALIFY rank <= 100)"""


def _query_vectors(t):
    groups = t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("query"))
    return t.benchmark.select(F.col("item_id").alias("query_id"), (F.col("item_id") % 10).alias("label")).join(groups, "label").select("query_id", "query")


def _semantic(t, allowed=None):
    found = search.nearest(t.embeddings.select("vec_id", "embedding"), _query_vectors(t), 100, allowed)
    return found.withColumnRenamed("vec_id", "doc_id")


@query(f"""{_RANKED}, {_VECTORS}, u AS (SELECT query_id, doc_id, 1.25 / (60 + rank - 1) AS part FROM r WHERE rank <= 100 UNION ALL SELECT query_id, doc_id, 1.0 / (60 + rank - 1) FROM sem),
o AS (SELECT query_id, doc_id, round(sum(part), 9) AS score FROM u GROUP BY query_id, doc_id) SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM o QUALIFY rank <= 50""")
def fused_search(t):
    whole = search.fused([(search.ranked(t.documents, _asked(t), 100), 1.25), (_semantic(t), 1.0)], "doc_id", ["query_id"]).withColumn("score", F.round("score", 9))
    return search.best(whole, 50, ["doc_id"]).select("query_id", "doc_id", "rank")


@query(f"""{_RANKED}, {_VECTORS}, {_ranking('g', '(SELECT page_id, html AS text FROM pages)', 'page_id')}, {_ranking('c', '(SELECT conv_id * 1000 + turn AS turn_id, text FROM conversations)', 'turn_id')},
u AS (SELECT query_id, doc_id, 1.25 / (60 + rank - 1) AS part FROM r WHERE rank <= 100 UNION ALL SELECT query_id, doc_id, 1.0 / (60 + rank - 1) FROM sem),
o AS (SELECT query_id, doc_id, sum(part) AS score FROM u GROUP BY query_id, doc_id),
k AS (SELECT 'artifact' AS kind, query_id, doc_id AS id, score, lang, source FROM o JOIN documents USING (doc_id) WHERE lang IN ('en', 'fr') AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
UNION ALL SELECT 'repository', query_id, page_id, 1.4 / (60 + rank - 1), NULL, NULL FROM gr WHERE rank <= 12 UNION ALL SELECT 'paper', query_id, turn_id, 1.4 / (60 + rank - 1), NULL, NULL FROM cr WHERE rank <= 96)
SELECT query_id, kind, id, lang, source, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, kind, id) AS rank FROM k QUALIFY rank <= 12""")
def hybrid_search(t):
    """Exact and semantic lists fused, filtered after fusion and hydrated; repository and paper lists with scores of their own; one clamped list."""
    asked = _asked(t)
    whole = search.fused([(search.ranked(t.documents, asked, 100), 1.25), (_semantic(t), 1.0)], "doc_id", ["query_id"])
    tagged = t.labels.where("quality = 1").select("doc_id")
    own = t.documents.where("lang IN ('en', 'fr')").join(tagged, "doc_id", "left_semi").select("doc_id", "lang", "source")
    found = whole.join(own, "doc_id").select(F.lit("artifact").alias("kind"), "query_id", F.col("doc_id").alias("id"), "score", "lang", "source")
    none = F.lit(None).cast("string")
    alone = lambda kind, rows, key: search.fused([(rows, 1.4)], key, ["query_id"]).select(F.lit(kind).alias("kind"), "query_id", F.col(key).alias("id"), "score", none.alias("lang"), none.alias("source"))
    pages = search.ranked(t.pages.select("page_id", F.col("html").alias("text")), asked, 12, "page_id")
    turns = search.ranked(t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "text"), asked, 96, "turn_id")
    every = found.unionByName(alone("repository", pages, "page_id")).unionByName(alone("paper", turns, "turn_id")).withColumn("score", F.round("score", 9))
    return search.best(every, 12, ["kind", "id"]).select("query_id", "kind", "id", "lang", "source", "rank")


@query(_RANKED.replace("FROM documents)", "FROM documents WHERE source = 'src3' AND lang = 'en')", 1) + " SELECT query_id, doc_id, rank FROM r WHERE rank <= 100")
def search_within_a_project(t):
    """Project and snapshot restrict the collection before it is ranked."""
    return search.ranked(t.documents.where("source = 'src3' AND lang = 'en'"), _asked(t), search.clamped(100, 1, 1000)).select("query_id", "doc_id", "rank")


_ALLOWED = "scope AS (SELECT item_id AS query_id, doc_id FROM benchmark JOIN documents ON source = 'src' || item_id % 20 WHERE item_id % 4 <> 0)"


@query(f"""{_RANKED}, {_VECTORS.replace('FROM embeddings e, qv)', 'FROM embeddings e JOIN scope ON scope.doc_id = vec_id JOIN qv USING (query_id))').replace('vec_id AS doc_id', 'vec_id AS doc_id').replace('qv AS (', _ALLOWED + ', qv AS (')},
x AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM (SELECT * FROM r WHERE rank <= 100) SEMI JOIN scope USING (query_id, doc_id)),
u AS (SELECT query_id, doc_id, 1.4 / (60 + rank - 1) AS part FROM x UNION ALL SELECT query_id, doc_id, 1.0 / (60 + rank - 1) FROM sem),
o AS (SELECT query_id, doc_id, round(sum(part), 9) AS score FROM u GROUP BY query_id, doc_id) SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM o QUALIFY rank <= 12""")
def search_within_evidence(t):
    """A series' evidence restricts both lists: the exact one after it is cut, the semantic one before; a query without a series finds nothing."""
    series = t.benchmark.where("item_id % 4 <> 0").select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("source"))
    scope = series.join(t.documents.select("source", "doc_id"), "source").select("query_id", "doc_id")
    exact = search.ranked(t.documents, _asked(t), 100).join(scope, ["query_id", "doc_id"], "left_semi")
    exact = exact.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    near = _semantic(t, scope.withColumnRenamed("doc_id", "vec_id"))
    whole = search.fused([(exact, 1.4), (near, 1.0)], "doc_id", ["query_id"]).withColumn("score", F.round("score", 9))
    return search.best(whole, 12, ["doc_id"]).select("query_id", "doc_id", "rank")


#: Fixed value: the answer to a question that no source speaks of.
REFUSAL = "I couldn't find enough library material to answer that question."


@query((_RANKED + f""", c AS (SELECT query_id, doc_id, rank FROM r WHERE rank <= 12), l AS (SELECT query_id, rank, 'S' || rank || ': ' || substr(text, 1, 40) AS line FROM c JOIN documents USING (doc_id)),
g AS (SELECT query_id, count(*) AS sources, sha256(string_agg(line, chr(10) ORDER BY rank)) AS context FROM l GROUP BY query_id), a AS (SELECT item_id AS query_id FROM benchmark UNION ALL SELECT -1 - item_id FROM benchmark)
SELECT query_id, coalesce(sources, 0) AS sources, context, CASE WHEN sources IS NULL THEN '{REFUSAL.replace("'", "''")}' END AS answer FROM a LEFT JOIN g USING (query_id)""").replace("FROM benchmark), q AS", "FROM (SELECT item_id, text FROM benchmark UNION ALL SELECT -1 - item_id, reverse(text) FROM benchmark)), q AS", 1))
def contexts_of_questions(t):
    """Up to twelve sources labelled S1 to S12, assembled in order; a question without sources, such as a passage read backwards as a rule is, gets the refusal and no context."""
    own = t.benchmark.select("item_id", "text").union(t.benchmark.select(-1 - F.col("item_id"), F.reverse("text")))
    terms = F.slice(F.filter(tokens(F.col("text")), lambda x: F.length(x) > 1), 1, 3)
    asked = own.select(F.col("item_id").alias("query_id"), terms.alias("terms"))
    found = search.ranked(t.documents, asked, 12).join(t.documents.select("doc_id", "text"), "doc_id")
    lines = F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("S"), F.col("rank"), F.lit(": "), F.substring("text", 1, 40)).alias("line"))))
    rows = found.groupBy("query_id").agg(F.count("*").alias("sources"), lines.alias("x"))
    told = rows.select("query_id", "sources", F.sha2(F.array_join(F.transform("x", lambda x: x["line"]), "\n"), 256).alias("context"))
    every = own.select(F.col("item_id").alias("query_id")).join(told, "query_id", "left")
    return every.select("query_id", F.coalesce("sources", F.lit(0)).cast("long").alias("sources"), "context", F.when(F.col("sources").isNull(), REFUSAL).alias("answer"))


@query(_RANKED + ", c AS (SELECT * FROM r WHERE rank <= 100) SELECT query_id, doc_id, rank FROM c JOIN documents USING (doc_id) WHERE lang = 'en' AND source <> 'src0'")
def search_filtered_after_ranking(t):
    candidates = search.ranked(t.documents, _asked(t), 100)
    kept = t.documents.where("lang = 'en' AND source <> 'src0'").select("doc_id")
    return candidates.join(kept, "doc_id").select("query_id", "doc_id", "rank")


@query(f"""WITH {_ASKED} SELECT query_id, count(DISTINCT term) AS terms, string_agg(DISTINCT term, ' ' ORDER BY term) AS sorted_terms FROM asked GROUP BY query_id""")
def query_terms(t):
    each = _asked(t).select("query_id", F.array_sort(F.array_distinct("terms")).alias("x")).where("size(x) > 0")
    return each.select("query_id", F.size("x").cast("long").alias("terms"), F.array_join("x", " ").alias("sorted_terms"))
