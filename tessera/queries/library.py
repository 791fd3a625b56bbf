"""Faceted library: filters, facets, tags, pages, unions and integrity, over documents and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import facets, integrity
from ..operators.search import first_per
from .registry import query

TAGS = ["quality", "toxic"]


def _title():
    return F.substring("text", 1, 60)


_LINKS = "links AS (SELECT DISTINCT doc_id, 'quality' AS tag FROM labels WHERE quality = 1 UNION SELECT DISTINCT doc_id, 'toxic' FROM labels WHERE toxic = 1)"


def _links(t) -> DataFrame:
    return facets.flags(t.labels, TAGS).distinct()


@query("SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source")
def facet_documents_by_source(t):
    return t.documents.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(f"""WITH {_LINKS}, d AS (SELECT * FROM documents WHERE lower(substr(text, 1, 60)) LIKE '%th%' AND lang IN ('en', 'fr', 'de'))
SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM d GROUP BY lang
UNION ALL SELECT 'source', source, count(*) FROM d GROUP BY source
UNION ALL SELECT 'tag', tag, count(*) FROM links JOIN d USING (doc_id) GROUP BY tag""")
def facet_counts(t):
    links = _links(t)
    rows = facets.filtered(t.documents, links, _title(), contains="th", types=("en", "fr", "de"))
    return facets.counts(rows.select("doc_id", "lang", "source"), links, ["lang", "source"])


@query(f"""WITH {_LINKS} SELECT doc_id, lang, source FROM documents WHERE lower(substr(text, 1, 60)) LIKE '%the%' AND lang IN ('en', 'es')
AND source IN ('src0', 'src1', 'src2', 'src3') AND doc_id IN (SELECT doc_id FROM links WHERE tag IN ('quality', 'toxic'))""")
def conjunctive_filter(t):
    rows = facets.filtered(t.documents, _links(t), _title(), contains="the", types=("en", "es"), sources=("src0", "src1", "src2", "src3"), any_tag=("quality", "toxic"))
    return rows.select("doc_id", "lang", "source")


@query(f"WITH {_LINKS} SELECT DISTINCT doc_id FROM documents JOIN links USING (doc_id)")
def documents_with_any_tag(t):
    return t.documents.join(_links(t), "doc_id", "left_semi").select("doc_id")


@query(f"WITH {_LINKS} SELECT d.doc_id, coalesce(string_agg(tag, ',' ORDER BY tag), '') AS tags FROM documents d LEFT JOIN links USING (doc_id) GROUP BY d.doc_id")
def tags_of_documents(t):
    tags = _links(t).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("tag")), ",").alias("tags"))
    return t.documents.select("doc_id").join(tags, "doc_id", "left").fillna("", ["tags"])


@query("""SELECT p.p_brand AS kind, count(l.l_partkey) AS n FROM part p LEFT JOIN lineitem l ON l.l_partkey = p.p_partkey AND l.l_quantity > 49 GROUP BY p.p_brand""")
def counts_with_default_zero(t):
    n = t.lineitem.where("l_quantity > 49").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return t.part.join(n, F.col("p_partkey") == F.col("l_partkey"), "left").groupBy(F.col("p_brand").alias("kind")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))


@query("SELECT doc_id, n_chars, (SELECT count(*) FROM documents) AS total FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50 OFFSET 20")
def page_of_documents(t):
    docs = t.documents.select("doc_id", "n_chars")
    total = docs.agg(F.count("*").alias("total"))
    return facets.paged(docs, [F.desc("n_chars"), F.asc("doc_id")], 20, 50).crossJoin(F.broadcast(total))


@query("SELECT doc_id, lang, row_number() OVER (ORDER BY lower(substr(text, 1, 60)), lang, doc_id) AS place FROM documents ORDER BY place LIMIT 100")
def first_titles_in_order(t):
    top = t.documents.select("doc_id", "lang", F.lower(_title()).alias("title")).orderBy("title", "lang", "doc_id").limit(100)
    return top.withColumn("place", F.row_number().over(Window.orderBy("title", "lang", "doc_id"))).drop("title")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def documents_without_labels(t):
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id", "source")


@query("SELECT d.doc_id, coalesce(l.toxic = 1, TRUE) AS restricted FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)")
def restricted_unless_policy_says_otherwise(t):
    policy = t.labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return t.documents.select("doc_id").join(policy, "doc_id", "left").select("doc_id", F.coalesce(F.col("toxic") == 1, F.lit(True)).alias("restricted"))


@query("""SELECT source, bool_or(coalesce(toxic, 0) = 1) AS restricted, bool_and(coalesce(quality, 0) = 1) AS complete, count(*) AS n
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def sticky_flags_by_source(t):
    joined = t.documents.join(t.labels, "doc_id", "left")
    return joined.groupBy("source").agg(F.bool_or(F.coalesce("toxic", F.lit(0)) == 1).alias("restricted"), F.bool_and(F.coalesce("quality", F.lit(0)) == 1).alias("complete"), F.count("*").alias("n"))


@query("""SELECT 'label' AS kind, CAST(doc_id AS VARCHAR) AS id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'vector', CAST(vec_id AS VARCHAR) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'order', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def orphans_of_each_kind(t):
    return integrity.orphans([
        ("label", t.labels, "doc_id", "doc_id", t.documents, "doc_id"),
        ("vector", t.embeddings, "vec_id", "vec_id", t.labels, "doc_id"),
        ("order", t.orders, "o_orderkey", "o_custkey", t.customer.where("c_acctbal > 0"), "c_custkey"),
        ("customer", t.customer, "c_custkey", "c_custkey", t.orders, "o_custkey"),
    ])


@query("SELECT coalesce(d.doc_id, e.vec_id) AS id, CASE WHEN e.vec_id IS NULL THEN 'left' ELSE 'right' END AS side FROM documents d FULL JOIN embeddings e ON d.doc_id = e.vec_id WHERE d.doc_id IS NULL OR e.vec_id IS NULL")
def keys_on_one_side_only(t):
    return integrity.differences(t.documents.select(F.col("doc_id").alias("id")), t.embeddings.select(F.col("vec_id").alias("id")), "id")


@query("SELECT conv_id, role, n_words, count(*) AS n FROM (SELECT conv_id, role, len(string_split(text, ' ')) // 10 AS n_words FROM conversations) GROUP BY ALL HAVING count(*) > 1")
def repeated_turns(t):
    """Turns of one conversation and role of about the same number of words."""
    return integrity.repeated(t.conversations.select("conv_id", "role", F.expr("size(split(text, ' ')) div 10").cast("long").alias("n_words")), ["conv_id", "role", "n_words"])


@query("""SELECT p_partkey, count(l_partkey) AS n FROM part LEFT JOIN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45) ON l_partkey = p_partkey GROUP BY p_partkey HAVING count(l_partkey) <> 1""")
def parts_not_assigned_once(t):
    uses = t.lineitem.where("l_returnflag = 'R' AND l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey"))
    return integrity.covered_once(uses, t.part, "p_partkey")


@query("SELECT lang, source FROM documents WHERE lang <> 'en' INTERSECT SELECT lang, source FROM documents WHERE n_chars > 5000")
def scopes_in_both(t):
    return t.documents.where("lang <> 'en'").select("lang", "source").intersect(t.documents.where("n_chars > 5000").select("lang", "source"))


@query("SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000")
def nations_left_out(t):
    return t.nation.select("n_nationkey").exceptAll(t.supplier.where("s_acctbal > 9000").select("s_nationkey").distinct())


@query("""SELECT 'document' AS kind, doc_id AS id, n_chars AS size FROM documents UNION ALL SELECT 'page', page_id, length(html) FROM pages
UNION ALL SELECT 'turn', conv_id * 1000 + turn, length(text) FROM conversations""")
def one_list_of_all_kinds(t):
    docs = t.documents.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("n_chars").alias("size"))
    pages = t.pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.length("html").cast("long").alias("size"))
    turns = t.conversations.select(F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.length("text").cast("long").alias("size"))
    return docs.unionByName(pages).unionByName(turns)


@query("SELECT doc_id, source, substr(text, 1, 500) AS excerpt FROM documents")
def excerpts(t):
    return t.documents.select("doc_id", "source", F.substring("text", 1, 500).alias("excerpt"))


@query("""SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n = 1""")
def longest_of_each_language(t):
    return first_per(t.documents, ["lang"], [F.desc("n_chars"), F.asc("doc_id")]).select("lang", "doc_id")


@query("""SELECT lower(sha256(text)) AS body_hash, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY text""")
def content_addresses(t):
    return t.documents.groupBy(F.sha2("text", 256).alias("body_hash")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


@query("""SELECT d.doc_id, coalesce(e.vec_id IS NOT NULL AND e.label % 2 = 0, FALSE) AS fresh FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
def pending_embeddings(t):
    stored = t.embeddings.select(F.col("vec_id").alias("doc_id"), (F.col("label") % 2 == 0).alias("fresh"))
    return t.documents.select("doc_id").join(stored, "doc_id", "left").fillna(False, ["fresh"])


@query("""SELECT n_name, r_name, count(c_custkey) AS customers, CAST(coalesce(sum(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END), 0) AS BIGINT) AS building
FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, r_name""")
def hydrated_dimensions(t):
    joined = t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.groupBy("n_name", "r_name").agg(F.count("c_custkey").alias("customers"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("building"))
