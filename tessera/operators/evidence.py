"""Evidence: requested ids, blockers, scopes, importance, entity resolution, revision chains, caps and collisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANKS = ["supporting", "major", "critical"]


def checked(requested: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """key, known: each requested id once, and whether there is such evidence."""
    have = evidence.select(key).distinct().withColumn("known", F.lit(True))
    return requested.select(key).distinct().join(have, key, "left").fillna(False, ["known"])


def blockers(reasons: DataFrame, acknowledged: DataFrame, page: str) -> DataFrame:
    """Reasons on pages that nobody acknowledged with a note; reasons without a page always stay."""
    cleared = acknowledged.where("trim(coalesce(note, '')) <> ''").select(F.col(page).alias("__page")).distinct()
    return reasons.join(cleared, F.col(page) == F.col("__page"), "left_anti")


def importance(entries: DataFrame, by: list[str], label: str) -> DataFrame:
    """by, importance: the highest of supporting, major, critical."""
    rank = F.array_position(F.array(*map(F.lit, RANKS)), F.col(label)).cast("int")
    best = entries.groupBy(*by).agg(F.max(rank).alias("r"))
    return best.select(*by, F.get(F.array(*map(F.lit, RANKS)), F.greatest(F.col("r"), F.lit(1)) - 1).alias("importance"))


def merged(entries: DataFrame, by: list[str], order: str, texts: list[str], ids: str) -> DataFrame:
    """One row for each group: its first texts by order, and the sorted union of its ids."""
    first = [F.min_by(c, order).alias(c) for c in texts]
    return entries.groupBy(*by).agg(*first, F.array_sort(F.collect_set(ids)).alias(ids))


def resolved(names: DataFrame, targets: DataFrame, key: str, kind: str, slug: str, target: str) -> DataFrame:
    """key, target of each name: the least target of its own kind with its slug, else the least target of any kind with it.

    Targets are reduced before names meet them, so that a name costs one row however many targets share its slug.
    """
    own = targets.groupBy(kind, slug).agg(F.min(target).alias("__own"))
    any_ = targets.groupBy(slug).agg(F.min(target).alias("__any"))
    found = names.join(any_, slug).join(own, [kind, slug], "left")
    return found.select(key, F.coalesce("__own", "__any").alias(target)).groupBy(key).agg(F.min(target).alias(target))


def unbroken(chain: DataFrame, by: list[str], order: str, good: Column) -> DataFrame:
    """Rows of each chain before the first that isn't good."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return chain.withColumn("__all", F.min(good.cast("int")).over(w)).where("__all = 1").drop("__all")


def capped(facts: DataFrame, by: list[str], order: list[Column], each: int) -> DataFrame:
    """At most `each` rows of a group, in order, and how many the group had (a feature of the report: the rest is counted)."""
    w = Window.partitionBy(*by)
    return facts.withColumn("of", F.count("*").over(w)).withColumn("place", F.row_number().over(w.orderBy(*order))).where(F.col("place") <= each)


def occurrences(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """rows with nth: how often the same identity came before. Rows are dealt and sorted by a 64-bit hash first; identities decide where hashes are equal."""
    rows = rows.withColumn("__hash", F.xxhash64(*by))
    w = Window.partitionBy("__hash", *by).orderBy(*order)
    return rows.withColumn("nth", (F.row_number().over(w) - 1).cast("long")).drop("__hash")


def collisions(paths: DataFrame, path: str) -> DataFrame:
    """folded, spellings: paths and their parent directories whose spellings differ in case only."""
    parts = F.split(F.col(path), "/")
    every = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("p")).distinct()
    return every.groupBy(F.lower("p").alias("folded")).agg(F.count("*").alias("spellings")).where("spellings > 1")


def host_matches(cookies: DataFrame, hosts: DataFrame, domain: str, host: str) -> DataFrame:
    """Pairs in which the host is the domain or below it: an equi-join on the host's suffixes."""
    labels = F.split(F.col(host), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, n, F.size(labels)), "."))
    return hosts.withColumn("__suffix", F.explode(suffixes)).join(cookies, F.col("__suffix") == F.col(domain)).drop("__suffix")


def holders(docs: DataFrame, passages: DataFrame, key: str, passage: str, text: str, cue: int = 6) -> DataFrame:
    """key, passage of texts that hold a passage, character by character.

    A passage's first and last words may be parts of words in a text; those between are whole. The first `cue` of these (or as many as
    there are) join with the texts' word windows of that length; what joins is compared whole. Passages of fewer than three words have none and
    are compared with every text: they must be few.
    """
    words = F.split(text, " ")
    cued = passages.select(passage, F.col(text).alias("__passage"), F.least(F.lit(cue), F.size(words) - 2).alias("__n"), words.alias("__w"))
    cued = cued.withColumn("cue", F.when(F.col("__n") > 0, F.array_join(F.slice("__w", F.lit(2), F.greatest(F.col("__n"), F.lit(1))), " "))).drop("__w")
    sizes = [r[0] for r in cued.where("__n > 0").select("__n").distinct().collect()]  # `cue` numbers at most
    found = None

    split = docs.select(key, words.alias("__words"))  # once a text, not once a window

    def windows(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("__words") - (n - 1))), lambda i: F.array_join(F.slice("__words", i, n), " "))

    for n in sizes:
        each = split.select(key, F.explode(windows(n)).alias("cue"))
        hits = each.join(cued.where(F.col("__n") == n), "cue").select(key, passage, "__passage")
        found = hits if found is None else found.union(hits)
    short = cued.where("__n <= 0").select(passage, "__passage")
    few = short.limit(1001).count()
    if few > 1000:
        raise ValueError("more than 1000 passages of fewer than three words")
    pairs = None if found is None else found.distinct().join(docs.select(key, text), key).where(F.contains(text, F.col("__passage"))).select(key, passage)
    if few or pairs is None:
        rest = docs.join(F.broadcast(short), F.contains(text, F.col("__passage"))).select(key, passage)
        pairs = rest if pairs is None else pairs.union(rest)
    return pairs.distinct()
