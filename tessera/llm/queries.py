"""The registered queries of this package, opN_<name>, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, conversation_trie, exact_dedup, language_id, lm_scoring, media, merkle_manifest, ngram_join, packing, pii, substring_dedup, token_counts, toxicity
from .common import documents


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file; the files are not part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Every window of 35 words as a string; words of windows that occur again go.
OP1 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\x0C\r]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 34), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
dup AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS j FROM win SEMI JOIN dup USING (s), range(0, 35) t(k)),
word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS text FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)
"""

#: Equal texts share their normalised text.
OP10 = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""

#: The CRC-32 of a number's decimal digits, bit by bit.
CRC32 = """xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(CAST({0} AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST({0} AS VARCHAR), CAST(i AS INTEGER), 1)) AS BIGINT))),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"""

#: Levels of nodes as lists, and for each row the siblings on every level.
OP11 = """
WITH RECURSIVE
f AS (SELECT doc_id, lang, row_number() OVER () AS row, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
  text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, coalesce(<CRC> % 3 = 0, false) AS tampered FROM documents),
d AS (SELECT doc_id, lang, row, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, CASE WHEN tampered THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS altered FROM f),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS i FROM d),
t AS (SELECT lang, 0 AS level, list(leaf ORDER BY i) AS nodes FROM placed GROUP BY lang
  UNION ALL SELECT lang, level + 1, list_transform(range(0, len(nodes), 8), lambda i: sha256(array_to_string(list_slice(nodes, i + 1, i + 8), ''))) FROM t WHERE len(nodes) > 1),
sub AS (SELECT lang, nodes[1] AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS r FROM t WHERE len(nodes) = 1),
u AS (SELECT 0 AS level, list(subroot ORDER BY r) AS nodes FROM sub
  UNION ALL SELECT level + 1, list_transform(range(0, len(nodes), 8), lambda i: sha256(array_to_string(list_slice(nodes, i + 1, i + 8), ''))) FROM u WHERE len(nodes) > 1),
steps AS (SELECT placed.row, level AS step, i // (1 << (3 * level)) AS pos, nodes FROM placed JOIN t ON t.lang IS NOT DISTINCT FROM placed.lang WHERE len(nodes) > 1
  UNION ALL SELECT row, height + u.level, r // (1 << (3 * u.level)), u.nodes FROM placed JOIN sub ON sub.lang IS NOT DISTINCT FROM placed.lang, u WHERE len(u.nodes) > 1),
sides AS (SELECT row, step, array_to_string(list_slice(nodes, pos - pos % 8 + 1, pos), '') AS l, array_to_string(list_slice(nodes, pos + 2, pos - pos % 8 + 8), '') AS r FROM steps),
ways AS (SELECT row, string_agg(l || r, '' ORDER BY step) AS proof, list(l || '|' || r ORDER BY step) AS way FROM sides GROUP BY row),
top AS (SELECT nodes[1] AS root FROM u WHERE len(nodes) = 1),
folded AS (SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, list_reduce(list_concat([coalesce(altered, leaf)], coalesce(way, [])), lambda x, p: sha256(split_part(p, '|', 1) || x || split_part(p, '|', 2))) AS folded_root
  FROM placed JOIN sub ON sub.lang IS NOT DISTINCT FROM placed.lang LEFT JOIN ways USING (row), top)
SELECT *, folded_root = root AS verified FROM folded
""".replace("<CRC>", CRC32.format("doc_id"))

#: Prefixes as digests of their turns written one after another; a node's subtree is every node one of whose prefixes it is.
OP12 = r"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, count(*) AS n, <CRC> % 4 AS h, conv_id - conv_id % 20 AS src FROM o GROUP BY conv_id),
c AS (SELECT n.*, least(n.h, coalesce(s.n, 0)) AS k FROM n LEFT JOIN n s ON s.conv_id = n.src),
r AS (SELECT c.conv_id, p AS d, role, text FROM c JOIN o ON o.conv_id = c.src AND p <= k UNION ALL SELECT c.conv_id, k + p - h, role, text FROM c JOIN o USING (conv_id) WHERE p > h),
pre AS (SELECT conv_id, d AS depth, sha256(string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d)) AS key,
    CAST(len(list_filter(regexp_split_to_array(text, '[ 	

]+'), lambda x: x <> '')) AS BIGINT) AS words FROM r
  UNION ALL SELECT conv_id, 0, '', 0 FROM c),
up AS (SELECT pre.*, lag(key) OVER (PARTITION BY conv_id ORDER BY depth) AS above, lead(key) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS ends FROM pre),
node AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, any_value(above) AS above, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM up GROUP BY key, depth),
kids AS (SELECT above AS key, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY above),
sub AS (SELECT pre.key, pre.depth, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves, CAST(sum((n_convs - 1) * node.words) AS BIGINT) AS saved_tokens
  FROM node LEFT JOIN kids USING (key) JOIN pre ON pre.conv_id = node.conv_id AND pre.depth <= node.depth GROUP BY pre.key, pre.depth)
SELECT node.conv_id, node.depth, parent.conv_id AS parent_conv_id, node.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, node.ends_sha256
FROM node JOIN sub USING (key, depth) LEFT JOIN kids USING (key) LEFT JOIN node parent ON parent.key = node.above AND parent.depth = node.depth - 1
""".replace("<CRC>", CRC32.format("conv_id"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.kept_digests(documents(spark, sf_dir)).drop("starts", "ends")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(documents(spark, sf_dir)).drop("text_key")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.carried(documents(spark, sf_dir)))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.round_trips(documents(spark, sf_dir), tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scores(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identified(language_id.documents_rows(documents(spark, sf_dir)), ["doc_id", "row_key"]).drop("row_key")


def language_id_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identified(language_id.pages_rows(spark.read.parquet(f"{sf_dir}/pages.parquet")), ["page_id"])


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(documents(spark, sf_dir)).drop("text_key", "n_chunks")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.audited(merkle_manifest.leaves(documents(spark, sf_dir)))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.nodes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"), 4096)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_ngram_join": op2_ngram_join,
        "op3_packing": op3_packing,
        "op4_media": op4_media,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_pii": op6_pii,
        "op7_toxicity": op7_toxicity,
        "op8_lm_scoring": op8_lm_scoring,
        "op9_language_id": op9_language_id,
        "language_id_of_pages": language_id_of_pages,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_conversation_trie": op12_conversation_trie,
        "op13_token_counts": op13_token_counts,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": OP1,
        "op10_exact_dedup": OP10,
        "op11_merkle_manifest": OP11,
        "op12_conversation_trie": OP12,
    }
