"""Exact dedup by content-defined chunk recipes, with DataFrame functions only.

A text is cut where its content says so: after at least MIN_CHUNK characters, at the next
white space between a vowel and one of a few letters, or at MAX_CHUNK. Its recipe is the
ordered list of its chunks' 64-bit identifiers. Documents whose recipe nobody shares are
unique and their text never moves. Of the others, the chunks' contents move once, to the
identifier they claim: identifiers under which two contents meet get told apart by
SHA-256. Then equal ordered lists of verified identifiers are equal texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, wrapped
from .ordering import with_group

MIN_CHUNK = 1024
MAX_CHUNK = 4096
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text: Column) -> Column:
    """The text with A-Z in lower case and all else unchanged; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, UPPER.lower()))


def chunks(norm: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """The text's content-defined chunks in order; none for an empty text."""
    pattern = rf"(?s).{{{least},{most}}}?(?<=[aeiou.,])\s(?=[b-hp-t])|.{{1,{most}}}"
    return F.regexp_extract_all(norm, F.lit(pattern), F.lit(0))


def _identifier(chunk: Column, bits: int) -> Column:
    return F.xxhash64(chunk) if bits == 64 else F.pmod(F.xxhash64(chunk), F.lit(1 << bits))


def recipes(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, text_key (hash of the text as it is), n_bytes, recipe, text_sha256 of each row."""
    plain = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), normalised(F.col("text")).alias("norm"))
    return plain.select(
        "doc_id",
        "text_key",
        F.octet_length("norm").cast("long").alias("n_bytes"),
        F.transform(chunks(F.col("norm")), lambda c: _identifier(c, bits)).alias("recipe"),
        F.sha2("norm", 256).alias("text_sha256"),
    )


def _ambiguous(docs: DataFrame, listed: DataFrame, bits: int) -> DataFrame:
    """Identifiers, of chunks in recipes that documents share (listed: with group_size by recipe), under which different contents meet."""
    suspects = listed.where("group_size > 1").select(F.col("doc_id").alias("suspect")).distinct()
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    parts = texts.join(suspects, texts.doc_id.eqNullSafe(suspects.suspect), "left_semi")
    each = parts.select(F.explode(chunks(normalised(F.col("text")))).alias("chunk")).select(_identifier(F.col("chunk"), bits).alias("id"), "chunk")
    met = each.groupBy("id").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
    return met.where("low <> high").select("id")


def groups(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, text_key, keep_id, group_size, kept, text_sha256, n_chunks of each row.

    docs: doc_id, text; other columns are ignored. Null texts and empty texts are equal to
    each other. Of equal texts the largest doc_id stays; a null doc_id stays only if all are null. A row that is
    repeated whole is one document written twice: both its rows are kept, and counted in group_size.
    A long text's recipe has a number for each 1 to 4 thousand characters. An empty table gives an empty result.
    bits: width of the identifiers (fewer only to test what happens when contents meet).
    """
    key = ["n_bytes", "recipe"]
    listed = scratch(with_group(scratch(recipes(docs, bits), "recipes"), key, ["doc_id", "text_key"], "dealt"), "grouped")
    ambiguous = scratch(_ambiguous(docs, listed, bits), "ambiguous")
    told = None
    if not ambiguous.isEmpty():
        touched = listed.select("doc_id", F.explode("recipe").alias("id")).join(ambiguous, "id", "left_semi").select(F.col("doc_id").alias("touched")).distinct()
        texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
        texts = texts.join(touched, texts.doc_id.eqNullSafe(touched.touched), "left_semi").distinct()
        told = texts.select(
            F.col("doc_id").alias("told_id"),
            F.col("text_key").alias("told_key"),
            F.array_join(F.transform(chunks(normalised(F.col("text"))), lambda c: F.sha2(c, 256)), ",").alias("told"),
        )
    if told is not None:
        listed = listed.drop("group_size", "best").join(told, listed.doc_id.eqNullSafe(told.told_id) & listed.text_key.eqNullSafe(told.told_key), "left").drop("told_id", "told_key").fillna("", ["told"])
        listed = with_group(listed, [*key, "told"], ["doc_id", "text_key"], "dealt")
    return listed.select(
        "doc_id",
        "text_key",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & F.col("text_key").eqNullSafe(F.col("best.text_key"))).alias("kept"),
        "text_sha256",
        F.size("recipe").cast("long").alias("n_chunks"),
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns whatever their names, of which one of each group of equal texts stays; a row repeated whole stays once."""
    kept = groups(docs).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key"))
    keyed = wrapped(docs, "doc_id", F.xxhash64("text").alias("key"))
    return keyed.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key")), "left_semi").dropDuplicates(["doc_id", "key"]).select("row.*")
