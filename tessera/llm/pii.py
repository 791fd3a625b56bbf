"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Base spans come from fixed patterns. They seed the bootstrap: a run of tokens that look like an
identifier (they hold a digit or an at sign) is an instance, the words before it are its
lexical pattern. Over the graph of patterns and instances, confidence goes back and forth: a pattern is
as good as the share of its instances that are believed, an instance is believed if it
is a seed or if good patterns introduce it. Instances that good patterns discover are added as
spans of kind 'context'; base spans always stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, wrapped

#: Base patterns as Java regular expressions. Possessive repeats match what the plain ones match, as what
#: follows can't begin with what is repeated; runs are entered at their start (or where the last match
#: ended) only, so that long runs without a match cost one pass.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to match at all.
_HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": "+"}
_OCTET = r"(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)|0++)"
CONTEXT = "context"
#: Characters of a piece of a text.
PAGE = 256

_TOKEN = r"[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
_INSTANCE = rf"(?<![^\x20\x09-\x0D]){_TOKEN}(?:\x20{_TOKEN})*+"
_SPAN = "array<struct<start:int,end:int,text:string>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use mentions it."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def running(values: Column, op: Callable[[Column, Column], Column], neutral: Column) -> Column:
    """The array's running totals under op, in about log2(size) passes: after each, a value covers twice as many places."""

    def widen(acc: Column, d: Column) -> Column:
        return F.zip_with(acc, F.concat(F.array_repeat(neutral, d), F.slice(acc, F.lit(1), F.size(acc) - d)), lambda x, y: op(x, y))

    def totals(v: Column) -> Column:
        passes = F.ceil(F.log2(F.size(v))).cast("int")
        return F.when(F.size(v) < 2, v).otherwise(F.aggregate(F.transform(F.sequence(F.lit(1), passes), lambda k: F.pow(F.lit(2), k - 1).cast("int")), v, widen))

    return let(values, totals)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, text), in code points."""

    def placed(hits: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), F.char_length)
        ends = running(F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda hit, gap: gap + F.char_length(hit)), lambda x, y: x + y, F.lit(0))
        return F.zip_with(ends, hits, lambda end, hit: F.struct((end - F.char_length(hit)).alias("start"), end.alias("end"), hit.alias("text")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) > 0, placed(hits)).otherwise(F.array().cast(_SPAN)))


def pages(text: Column) -> Column:
    """The text in pieces of PAGE characters, from which `cut` takes parts without walking the whole text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PAGE}}}"), F.lit(0))


def cut(pages_: Column, start: Column, end: Column) -> Column:
    """The characters start to end (exclusive) of the text in pages."""
    first = F.floor(start / PAGE).cast("int")
    count = F.floor((F.greatest(end, start + 1) - 1) / PAGE).cast("int") - first + 1
    return F.substring(F.array_join(F.slice(pages_, first + 1, count), ""), start - first * PAGE + 1, end - start)


def _luhn(digits: Column) -> Column:
    """Whether the digits pass Luhn's check."""
    n = F.length(digits)
    places = F.sequence(F.lit(1), n)

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when((n - i) % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(places, F.lit(0), lambda acc, i: acc + worth(i)) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        return hit.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """The kind's valid spans (start, end, text); matches that fail are dropped without another try."""
    hint = F.contains(text, F.lit(_HINTS[kind])) if len(_HINTS[kind]) == 1 else text.rlike(_HINTS[kind])
    return F.when(hint, F.filter(matches(text, KINDS[kind]), lambda x: _valid(kind, x["text"]))).otherwise(F.array().cast(_SPAN))


def _spelled(spans: Column) -> Column:
    """kind:start:end of spans (start, rank, end, kind), in order, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _ranked(spans: Column, kind: str, rank: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))


_FOUND = "array<struct<start:int,end:int,instance:string,pattern:string>>"


def _instances_of(text: Column, pages_: Column) -> Column:
    """Instances (start, end, instance, pattern): trimmed of punctuation, with the two words before them in lower case."""

    def trimmed(x: Column) -> Column:
        lead = F.length(F.regexp_extract(x["text"], r"^[^A-Za-z0-9+(]*", 0))
        core = F.regexp_replace(x["text"], r"^[^A-Za-z0-9+(]*|[^A-Za-z0-9)]*$", "")
        before = cut(pages_, F.greatest(x["start"] - 79, F.lit(0)), x["start"])
        words = F.lower(F.regexp_extract(before, r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1))
        start = x["start"] + lead
        return let(core, lambda c: F.struct(start.alias("start"), (start + F.char_length(c)).alias("end"), c.alias("instance"), words.alias("pattern")))

    return F.filter(F.transform(matches(text, _INSTANCE), trimmed), lambda x: (x["instance"] != "") & (x["pattern"] != ""))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, base (spans of all kinds), found (instances with the words before them) of each row."""
    plain = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.coalesce("text", F.lit("")).alias("t"))
    t = F.col("t")
    plain = plain.withColumn("pages", F.when(t.rlike("[0-9@]"), pages(t)))
    found = F.when(F.col("pages").isNotNull(), _instances_of(t, F.col("pages"))).otherwise(F.array().cast(_FOUND))
    base = F.concat(*(_ranked(base_spans(t, k), k, i) for i, k in enumerate(KINDS)))
    return plain.select("doc_id", "text_key", base.alias("base"), found.alias("found"))


def instances(rows: DataFrame) -> DataFrame:
    """Each instance: doc_id, text_key, start, end, instance, pattern, seed (a base span overlaps it).

    Seeds come from one sorted list of a text's base spans (by start) and instances (by end): the
    farthest end of the base spans so far lies beyond an instance's start if one overlaps it.
    """
    base = F.transform("base", lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("rank"), b["end"].alias("until"), F.lit(None).cast(_FOUND[6:-1]).alias("own")))
    own = F.transform("found", lambda f: F.struct(f["end"].alias("at"), F.lit(0).alias("rank"), F.lit(-1).alias("until"), f.alias("own")))
    sorted_ = rows.where("size(found) > 0").select("doc_id", "text_key", F.array_sort(F.concat(base, own)).alias("events"))
    reach = running(F.transform("events", lambda e: e["until"]), F.greatest, F.lit(-1))
    each = F.filter(F.zip_with("events", reach, lambda e, m: F.struct(e["own"].alias("own"), (m > e["own"]["start"]).alias("seed"))), lambda x: x["own"].isNotNull())
    return sorted_.select("doc_id", "text_key", F.explode(each).alias("x")).select("doc_id", "text_key", "x.own.start", "x.own.end", "x.own.instance", "x.own.pattern", "x.seed")


def confident(each: DataFrame, rounds: int = 3, least: float = 0.8, support: int = 3) -> DataFrame:
    """Patterns with a confidence of `least` and more: (pattern, confidence).

    A pattern's confidence is (sum of its different instances' beliefs) / (their number + 0.5), given at
    least `support` of them are believed. An instance's belief is 1 for a seed, else the
    probability that one of its confident patterns is right.
    """
    edges = scratch(each.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "edges")
    beliefs = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("belief"))
    patterns = None
    for _ in range(rounds):
        scored = edges.join(beliefs, "instance").groupBy("pattern").agg((F.sum("belief") / (F.count("*") + 0.5)).alias("confidence"), F.sum(F.when(F.col("belief") >= least, 1).otherwise(0)).alias("n"))
        patterns = scratch(scored.where((F.col("confidence") >= least) & (F.col("n") >= support)).select("pattern", "confidence"), "patterns")
        doubt = F.exp(F.sum(F.log(1.0 - F.least(F.col("confidence"), F.lit(0.999)))))
        believed = edges.join(patterns, "pattern").groupBy("instance").agg((1.0 - doubt).alias("learned"))
        seeds = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("seed"))
        beliefs = seeds.join(believed, "instance", "left").select("instance", F.greatest("seed", F.coalesce("learned", F.lit(0.0))).alias("belief"))
    return patterns


def spans(docs: DataFrame, rounds: int = 3, least: float = 0.8, support: int = 3) -> DataFrame:
    """doc_id, text_key, base, discovered of each row: arrays of (start, rank, end, kind).

    docs: doc_id, text; other columns are ignored. A null text is empty. Rows
    that repeat get the same spans; a discovered span has at least four digits and overlaps no base span. A text's spans take time in
    proportion to its length and, but for a logarithm, to their number. An empty table gives an empty result.
    """
    rows = scratch(scanned(docs), "scanned")
    each = instances(rows)
    good = confident(each, rounds, least, support)
    new = each.where("NOT seed").where(F.length(F.regexp_replace("instance", "[^0-9]", "")) >= 4).join(good, "pattern")
    new = new.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct(F.col("start"), F.lit(len(KINDS)).alias("rank"), F.col("end"), F.lit(CONTEXT).alias("kind"))).alias("discovered"))
    new = new.select(F.col("doc_id").alias("new_id"), F.col("text_key").alias("new_key"), "discovered")
    joined = rows.join(new, rows.doc_id.eqNullSafe(new.new_id) & (rows.text_key == new.new_key), "left")
    return joined.select("doc_id", "text_key", "base", F.coalesce("discovered", F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")).alias("discovered"))


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("long")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256 and all spans spelled out, of each row."""
    counts = [_count(k).alias(f"n_{k}") for k in KINDS]
    return spans(docs).select("doc_id", *counts, F.sha2(_spelled(F.col("base")), 256).alias("base_sha256"), _spelled(F.concat("base", "discovered")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns whatever their names, with each span of the text replaced by <kind>; overlapping spans become one, named after the first."""
    found = spans(docs).where("size(base) + size(discovered) > 0")
    found = found.select(F.col("doc_id").alias("found_id"), F.col("text_key").alias("found_key"), F.array_sort(F.concat("base", "discovered")).alias("all")).dropDuplicates(["found_id", "found_key"])
    keyed = wrapped(docs, "doc_id", "text", F.xxhash64("text").alias("key"))
    rows = keyed.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("key") == F.col("found_key")), "left")

    reach = running(F.transform("all", lambda x: x["end"]), F.greatest, F.lit(0))
    rows = rows.withColumn("pages", F.when(F.col("all").isNotNull(), pages(F.col("text")))).withColumn("reach", reach)
    covered = F.zip_with("all", F.concat(F.array(F.lit(0)), F.slice("reach", F.lit(1), F.size("reach") - 1)), lambda x, so_far: F.struct(so_far.alias("so_far"), x["start"].alias("start"), x["kind"].alias("kind")))
    parts = F.transform(F.filter(covered, lambda x: x["start"] >= x["so_far"]), lambda x: F.concat(cut(F.col("pages"), x["so_far"], x["start"]), F.lit("<"), x["kind"], F.lit(">")))
    rest = cut(F.col("pages"), F.element_at("reach", -1), F.char_length("text"))
    clean = F.concat(F.array_join(parts, ""), rest)
    told = F.when(F.col("all").isNull(), F.col("text")).otherwise(clean)
    return rows.select(*((told if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
