"""Language ID by Bayesian evidence fusion.

Evidence of a row: its text (letter trigrams), the language that its markup or its metadata
declares, the suffix of its address, and its host. The posterior of a language is its host's prior times
the likelihoods of text, declaration and suffix. All tables come from grouped aggregation
over every row: trigram counts by declared language; how often texts of each language declare each
language and bear each suffix; and how often each host has each language, smoothed
towards its site's shares, which are smoothed towards the shares of all rows. A row doesn't count
towards its own host's prior.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, wrapped

BUCKETS = 1 << 14
#: A trigram's evidence counts as so much of an independent observation.
TEMPER = 0.3
#: Rows that a site's or a host's prior counts for besides its own.
PRIOR_ROWS = 10.0
#: Posterior below which a row is rejected.
LEAST = 0.5
#: Prior of the hypothesis that a text is in none of the languages: its trigrams then fall evenly on all buckets.
NO_LANGUAGE = 0.05
#: Languages that have a model of their own: those that most rows declare, of any share of all rows; others, if there are more than
#: so many different declarations, have one in common. There are fewer written languages of any size than this.
LANGUAGES = 512
OTHER = "~other"

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the letter trigrams of all texts, one after another, and how many each text has; other characters count as blanks."""
    joined = "\0".join(f"  {t.lower()} " for t in texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(codes == 0)
    if len(ends) != len(texts):  # a text holds the separator itself
        return trigrams([t.replace("\0", " ") for t in texts])
    codes = np.where(_is_letter()[codes], codes, 32).astype(np.uint32)
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    at = np.flatnonzero(b != 32)
    mixed = a[at] * np.uint32(0x9E3779B1) + b[at] * np.uint32(0x85EBCA77) + c[at] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    return (mixed >> np.uint32(32 - 14)).astype(np.int64), np.bincount(np.searchsorted(ends, at), minlength=len(texts))[: len(texts)]


def _slices(texts: pd.Series, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about so many characters together."""
    lo, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= most:
            yield lo, k + 1
            lo, held = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[str, np.ndarray] = {}
    for rows in batches:
        texts = rows.text.fillna("")
        for lo, hi in _slices(texts, 1 << 20):
            grams, counts = trigrams(texts.iloc[lo:hi].tolist())
            langs, codes = np.unique(rows.declared.iloc[lo:hi].to_numpy(str), return_inverse=True)
            of = np.repeat(codes, counts)
            both = np.bincount(of * BUCKETS + grams, minlength=len(langs) * BUCKETS).reshape(len(langs), BUCKETS)
            for lang, own in zip(langs, both, strict=True):
                sums[lang] = sums.get(lang, 0) + own
    for lang, own in sums.items():
        at = np.flatnonzero(own)
        yield pd.DataFrame({"declared": lang, "bucket": at, "n": own[at]})


def _scored(langs: list[str], logs: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts = rows.text.fillna("")
            out = []
            for lo, hi in _slices(texts, (1 << 21) // max(4, len(langs))):
                grams, counts = trigrams(texts.iloc[lo:hi].tolist())
                sums = np.zeros((hi - lo, len(langs)))
                full = np.flatnonzero(counts)
                if len(full):
                    sums[full] = np.add.reduceat(logs[grams], (np.cumsum(counts) - counts)[full], axis=0)
                out.append((sums, counts))
            sums, counts = np.concatenate([s for s, _ in out]), np.concatenate([c for _, c in out])
            yield rows.drop(columns="text").assign(likelihood=list(sums * TEMPER), n_grams=counts)

    return run


def code(declared: Column) -> Column:
    """The primary subtag of a language tag in lower case, or null."""
    tag = F.regexp_extract(F.lower(F.trim(declared)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(tag != "", tag)


def site(host: Column) -> Column:
    """The last two labels of a host name."""
    return F.when(host.isNotNull(), F.substring_index(host, ".", -2))


def identified(rows: DataFrame, keys: list[str], least: float = LEAST, languages: int = LANGUAGES) -> DataFrame:
    """keys, declared, text_lang, lang, probability, accepted of each row.

    rows: keys, text, declared (language tag), suffix and host, each of which may be null: a
    null is no evidence. A text without letters says nothing; a row is accepted if its best
    language has a posterior of `least` or more, its text has letters, and no-language doesn't explain it better. Ties go to the language that comes first in
    the alphabet. Languages beyond the most declared ones, `languages` of them, are one, OTHER; a row that OTHER wins is in the language that it declares,
    and not accepted if it declares none of these. Texts of any length are read whole, some millions of characters at a time. Without any declared language in the table, lang and probability are null and no row is accepted. Rows
    that repeat get the same result.
    """
    rows = rows.select(*keys, "text", code(F.col("declared")).alias("declared"), F.lower("suffix").alias("suffix"), F.lower("host").alias("host"))
    named = rows.where("declared IS NOT NULL").groupBy("declared").agg(F.count("*").alias("n"))
    own_model = [r.declared for r in named.orderBy(F.desc("n"), "declared").limit(languages).collect()]
    rows = rows.withColumn("tag", F.col("declared")).withColumn("declared", F.when(F.col("declared").isin(own_model), F.col("declared")).when(F.col("declared").isNotNull(), OTHER))
    counted = rows.where("declared IS NOT NULL").select("text", "declared").mapInPandas(_counted, "declared string, bucket int, n long")
    # Languages times buckets, however many rows there are.
    sums = counted.groupBy("declared", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(sums.declared))
    if not langs:
        return rows.select(*keys, F.col("tag").alias("declared"), F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(False).alias("accepted"))
    table = np.ones((BUCKETS, len(langs)))
    np.add.at(table, (sums.bucket.to_numpy(np.int64), np.searchsorted(langs, sums.declared.to_numpy(str))), sums.n.to_numpy(np.float64))
    logs = np.log(table / table.sum(0)).astype(np.float32)

    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{k} {fields[k]}" for k in (*keys, "tag", "declared", "suffix", "host"))
    scored = rows.mapInPandas(_scored(langs, logs), f"{schema}, likelihood array<double>, n_grams int")
    best = F.array_position("likelihood", F.array_max("likelihood")).cast("int") - 1
    scored = scratch(scored.withColumn("vote", F.when(F.col("n_grams") > 0, best)).withColumn("site", site(F.col("host"))), "scored")

    n, numbers = len(langs), range(len(langs))
    names = F.array(*map(F.lit, langs))
    votes = [F.count(F.when(F.col("vote") == i, 1)).cast("double") for i in numbers]
    counts = F.array(*votes)
    voted = scored.where("vote IS NOT NULL")
    total = voted.agg(counts.alias("c")).first().c

    def likelihoods(evidence: str) -> DataFrame:
        """log P(evidence's value | language), smoothed by one for each value seen."""
        seen = voted.where(F.col(evidence).isNotNull()).groupBy(evidence).agg(counts.alias("c"))
        whole = seen.agg(F.array(*(F.sum(F.col("c")[i]) for i in numbers)).alias("all"), F.count("*").alias("values")).first()
        alls = F.array(*(F.lit(float(x or 0) + (whole["values"] or 0) + 1.0) for x in (whole["all"] or [0] * n)))
        return seen.select(F.col(evidence), F.zip_with("c", alls, lambda c, a: F.log((c + 1.0) / a)).alias(f"given_{evidence}"))

    base = F.array(*(F.lit((c + 1.0) / (sum(total) + n)) for c in total))
    sites = voted.where("site IS NOT NULL").groupBy("site").agg(counts.alias("site_counts"))
    hosts = voted.where("host IS NOT NULL").groupBy("host").agg(counts.alias("host_counts"))
    own = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(F.col("vote") == i, 1.0).otherwise(0.0))

    def smoothed(counts_: str, parent: Column) -> Column:
        others = F.zip_with(F.coalesce(F.col(counts_), F.transform(own, lambda x: x)), own, lambda c, o: F.greatest(c - o, F.lit(0.0)))
        rows_ = F.aggregate(others, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(others, parent, lambda c, p: (c + PRIOR_ROWS * p) / (rows_ + PRIOR_ROWS))

    joined = scored
    for evidence, values in (("declared", likelihoods("declared")), ("suffix", likelihoods("suffix")), ("site", sites), ("host", hosts)):
        # rows without this evidence find nothing: they are spread over keys that no evidence has
        nowhere = F.concat(F.lit("\0"), F.pmod(F.xxhash64(*keys), F.lit(4096)).cast("string"))
        joined = joined.withColumn("found_by", F.coalesce(evidence, nowhere)).join(values.withColumnRenamed(evidence, "found_by"), "found_by", "left").drop("found_by")
    joined = joined.withColumn("prior", smoothed("site_counts", base)).withColumn("prior", smoothed("host_counts", F.col("prior")))
    nothing = F.array_repeat(F.lit(0.0), n)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    log_post = add(add(F.transform("prior", lambda p: F.log(p)), F.col("likelihood")), add(F.coalesce("given_declared", nothing), F.coalesce("given_suffix", nothing)))
    joined = joined.withColumn("log_post", log_post)
    shares = F.transform("log_post", lambda x: F.exp(x - F.array_max("log_post")))
    joined = joined.withColumn("probability", 1.0 / F.aggregate(shares, F.lit(0.0), lambda a, x: a + x))
    top = F.array_max(F.transform("log_post", lambda x, i: F.struct(x.alias("value"), (-i).alias("place"))))
    lang = F.get(names, -top["place"])
    # The text alone must be likelier in the language than evenly spread, by what the prior of no language asks for.
    text_fits = F.array_max("likelihood") > F.col("n_grams") * (-TEMPER * math.log(BUCKETS)) + math.log(NO_LANGUAGE / (1 - NO_LANGUAGE))
    lang = F.when(lang != OTHER, lang).otherwise(F.when(F.col("declared") == OTHER, F.col("tag")))
    accepted = (F.col("n_grams") > 0) & (F.col("probability") >= least) & text_fits & lang.isNotNull()
    vote = F.get(names, F.col("vote"))
    return joined.select(*keys, F.col("tag").alias("declared"), F.when(vote != OTHER, vote).alias("text_lang"), lang.alias("lang"), "probability", accepted.alias("accepted"))


def documents_rows(docs: DataFrame) -> DataFrame:
    """The evidence of the table documents: its language column is a declaration, its source a host; it has no addresses."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text", "lang", "source").alias("row_key"), "text", F.col("lang").cast("string").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").cast("string").alias("host"))


def pages_rows(pages: DataFrame) -> DataFrame:
    """The evidence of the table pages: text without markup, the html element's lang attribute, the host name and its last label."""
    html = F.coalesce("html", F.lit(""))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*+>|&[a-zA-Z0-9#]{1,10};", " ")
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    host = F.when(host != "", host)
    declared = F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z_-]+)", 1)
    return pages.select("page_id", text.alias("text"), declared.alias("declared"), F.substring_index(host, ".", -1).alias("suffix"), host.alias("host"))


def in_a_language(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of docs, all columns whatever their names, that are accepted; lang becomes the identified language."""
    found = identified(documents_rows(docs), ["doc_id", "row_key"], least).where("accepted")
    found = found.select(F.col("doc_id").alias("found_id"), F.col("row_key").alias("found_key"), F.col("lang").alias("found_lang")).distinct()
    keyed = wrapped(docs, "doc_id", F.xxhash64("text", "lang", "source").alias("key"))
    joined = keyed.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("key") == F.col("found_key")))
    return joined.select(*((F.col("found_lang") if c == "lang" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
