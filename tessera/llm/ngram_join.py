"""N-gram Jaccard join: MinHash banding, pairs verified on the full n-gram sets.

Documents with equal n-gram sets are copies and share one representative. Representatives
meet in the buckets of their band hashes. A bucket isn't paired out: its members are
verified against one of them, the hub, which costs as many pairs as it has members. Links make
components. Where one bucket holds members of several components, every pair across
them is still verified, unless the triangle inequality of Jaccard distances to the hub rules
it out; so each pair that shares a bucket is linked, ruled out, or in one component
anyway, and the components are those of the whole join at the cost of stars. Pairs across
components are first compared by their min-hashes, which rules out all but those near the threshold
(with the same target recall as the bands) before anything is emitted: a bucket's members are dealt over tasks in pairs of
blocks of bounded size.

Links are counted apart from that: all members of a component are compared with each other on their full n-gram sets, in
pairs of blocks of bounded size that are dealt over tasks; a task emits sums, not pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROLL_A, WordHashes, mixed, rolling, scratch, shuffle_partitions, wrapped
from .components import components

N = 5
THRESHOLD = 0.8
#: The chance that a pair at the threshold meets in a bucket.
RECALL = 0.9999
#: Rows to a band; more rows make fewer false candidates and need more bands.
ROWS = 5
#: Min-hashes, a byte of each, by which members of one bucket are compared across components.
MARKS, FEW_MARKS = 384, 64
#: Members and n-grams of a block within which, and with another of which, links are counted; a set isn't divided.
BLOCK, BLOCK_GRAMS = 512, 1 << 20
#: Members of pairs of blocks that one task compares by min-hashes: about half a kilobyte each.
CELL = 1 << 14
#: Entries of the dense tables that are multiplied to count common n-grams.
DENSE = 1 << 23


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands that a pair at the threshold needs to meet with a probability of recall: 1 - (1 - threshold ** rows) ** bands."""
    if threshold >= 1:
        return 1
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def agreement_for(threshold: float, recall: float, hashes: int) -> int:
    """The most of `hashes` min-hashes that a pair at the threshold agrees in with a probability of recall."""
    below = 0.0
    for k in range(hashes + 1):
        below += math.comb(hashes, k) * threshold**k * (1 - threshold) ** (hashes - k)
        if below > 1 - recall:
            return k
    return hashes


def ngrams(words: list[bytes], known: WordHashes, n: int) -> np.ndarray:
    """The different hashes of the text's n-grams, sorted; fewer than n words make one n-gram."""
    if not words:
        return np.zeros(0, np.uint64)
    hashes = known.of(words)
    return np.unique(rolling(hashes, min(n, len(hashes)), ROLL_A))


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 20_240_501):
        r = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.times = r.integers(0, 1 << 63, (bands * rows, 1), np.uint64) * np.uint64(2) + np.uint64(1)
        self.plus = r.integers(0, 1 << 63, (bands * rows, 1), np.uint64)
        self.mix = r.integers(0, 1 << 63, (1, rows), np.uint64) * np.uint64(2) + np.uint64(1)

    def least(self, grams: np.ndarray) -> np.ndarray:
        """The min-hashes."""
        least = np.full(len(self.times), np.iinfo(np.uint64).max, np.uint64)
        for lo in range(0, len(grams), 2048):
            np.minimum(least, (self.times * grams[lo : lo + 2048] + self.plus).min(1), out=least)
        return mixed(least)

    def of(self, grams: np.ndarray) -> np.ndarray:
        """One hash for each band."""
        sums = (self.least(grams).reshape(self.bands, self.rows) * self.mix).sum(1, dtype=np.uint64)
        return mixed(sums + np.arange(self.bands, dtype=np.uint64)).view(np.int64)


def _words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


def signatures(docs: DataFrame, n: int = N, bands: int = 0, rows: int = ROWS) -> DataFrame:
    """doc_id, text_key, set_key (null for a text without words), size, bands of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, minhash = WordHashes(), MinHash(bands, rows)
        for batch in batches:
            out = []
            for text in batch.text:
                grams = ngrams(_words(text), known, n)
                out.append((hashlib.blake2b(grams.tobytes(), digest_size=16).digest(), len(grams), minhash.of(grams)) if len(grams) else (None, 0, []))
            yield pd.DataFrame({"doc_id": batch.doc_id, "text_key": batch.text_key, "set_key": [x[0] for x in out], "size": [x[1] for x in out], "bands": [x[2] for x in out]})

    plain = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    return plain.mapInPandas(run, "doc_id long, text_key long, set_key binary, size int, bands array<long>")


def _gram_sets(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, minhash = WordHashes(), MinHash(MARKS, 1)
        for batch in batches:
            for lo in range(0, len(batch), 500):
                some = batch.iloc[lo : lo + 500]
                grams = [ngrams(_words(t), known, n) for t in some.text]
                marks = [minhash.least(g).astype(np.uint8).tobytes() for g in grams]
                yield pd.DataFrame({"set_key": some.set_key, "grams": [g.view(np.int64) for g in grams], "marks": marks})

    return run


def _distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v, common, all of pairs (u, v): sizes of the n-gram sets' intersection and union."""
    left = sets.select(F.col("set_key").alias("u"), F.col("grams").alias("u_grams"))
    right = sets.select(F.col("set_key").alias("v"), F.col("grams").alias("v_grams"))
    both = pairs.join(left, "u").join(right, "v")
    common = F.size(F.array_intersect("u_grams", "v_grams"))
    return both.select("u", "v", common.alias("common"), (F.size("u_grams") + F.size("v_grams")).alias("sizes")).select("u", "v", "common", (F.col("sizes") - F.col("common")).alias("all"))


def _linked(threshold: float) -> Column:
    return F.col("common") >= threshold * F.col("all") - 1e-9


def _common(lists: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The numbers of common n-grams of the sets at left with those at right."""
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    _, at, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    shared = times > 1
    own = np.flatnonzero(shared[at])
    at = (np.cumsum(shared) - 1)[at[own]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[own][order], at[order]
    out = np.zeros((len(left), len(right)))
    step = max(1, DENSE // len(lists))
    for lo in range(0, int(shared.sum()), step):
        some = slice(*np.searchsorted(at, (lo, lo + step)))
        table = np.zeros((len(lists), min(step, int(shared.sum()) - lo)), np.float32)
        table[owner[some], at[some] - lo] = 1
        out += table[left] @ table[right].T
    return out


def _linked_to(threshold: float):
    """set_key, n_links of each member of each pair of blocks (label, x, y): its links to the other block, or within its own."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(len(rows), np.int64)
        blocks = rows.block.to_numpy()
        for (_, x, y), places in rows.groupby(["label", "x", "y"]).indices.items():
            lists = [np.asarray(g) for g in rows.grams.iloc[places]]
            left, right = np.flatnonzero(blocks[places] == x), np.flatnonzero(blocks[places] == y)
            if not len(left) or not len(right):
                continue
            sizes, common = np.array([len(g) for g in lists]), _common(lists, left, right)
            linked = common >= threshold * (sizes[left][:, None] + sizes[right] - common) - 1e-9
            if x == y:
                np.fill_diagonal(linked, False)
            else:
                counts[places[right]] = linked.sum(0)
            counts[places[left]] = linked.sum(1)
        return pd.DataFrame({"set_key": rows.set_key, "n_links": counts})

    return run


def link_counts(labels: DataFrame, sets: DataFrame, threshold: float, block: int = BLOCK, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """set_key, n_links of each node of labels (node, label): to so many others of its component it is linked."""
    members = labels.withColumnRenamed("node", "set_key").join(sets.select("set_key", F.size("grams").alias("size")), "set_key")
    blocks = members.groupBy("label").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") / block_grams)).cast("int").alias("blocks"), F.sum("size").alias("sizes"))
    blocks = scratch(blocks, "blocks")
    moved = blocks.agg(F.sum(F.col("blocks") * F.col("sizes"))).first()[0] or 0
    cells = moved // (block_grams // 4 + 1) + shuffle_partitions(labels.sparkSession)
    placed = members.join(blocks, "label").withColumn("block", F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("set_key", "label", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    dealt = placed.withColumn("cell", F.pmod(F.xxhash64("label", "x", "y"), F.lit(cells))).join(sets.select("set_key", "grams"), "set_key")
    each = dealt.groupBy("cell").applyInPandas(_linked_to(threshold), "set_key binary, n_links long")
    return each.groupBy("set_key").agg(F.sum("n_links").alias("n_links"))


def _agreeing(threshold: float, recall: float):
    """u, v of pairs across two blocks of one bucket, with different labels, that distances, sizes and min-hashes leave possible."""
    few, most = agreement_for(threshold, recall, FEW_MARKS), agreement_for(threshold, recall, MARKS)
    slack = 1 - threshold + 1e-9

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[bytes, bytes]] = []
        keys, far, size = rows.set_key.to_numpy(), rows.far.to_numpy(), rows["size"].to_numpy()
        labels, low = pd.factorize(rows.label)[0], (rows.own == rows.low).to_numpy()
        bands = [b.tolist() for b in rows.bands]
        for (band, *_), places in rows.groupby(["band", "low", "high"]).indices.items():
            if (labels[places] == labels[places[0]]).all():
                continue
            marks = np.stack([np.frombuffer(x, np.uint8) for x in rows.marks.iloc[places]])
            same = low[places].all()
            left = np.flatnonzero(low[places])
            right = left if same else np.flatnonzero(~low[places])
            for i in left:
                at = right[right > i] if same else right
                x, y = places[i], places[at]
                may = (labels[y] != labels[x]) & (np.abs(far[y] - far[x]) <= slack)
                may &= np.minimum(size[y], size[x]) >= threshold * np.maximum(size[y], size[x]) - 1e-9
                at = at[may]
                at = at[(marks[at, :FEW_MARKS] == marks[i, :FEW_MARKS]).sum(1) >= few]
                at = at[(marks[at] == marks[i]).sum(1) >= most]
                first = [next(b for b in bands[x] if b in also) == band for also in map(set, (bands[k] for k in places[at]))]
                out += [(min(keys[x], k), max(keys[x], k)) for k in keys[places[at[first]]]]
        return pd.DataFrame(out, columns=["u", "v"])

    return run


def near_pairs(within: DataFrame, sizes: DataFrame, threshold: float, recall: float, block: int = BLOCK) -> DataFrame:
    """u, v of pairs of one bucket's members with different labels that may reach the threshold.

    within: band, set_key, label, far (distance to the bucket's hub); sizes: set_key, size, marks. A bucket is
    divided into zones a `slack` of distance and a threshold's ratio of sizes wide, so that only neighbouring zones can hold
    such pairs, and a zone into blocks; pairs of blocks are dealt over tasks, however large the bucket is. A pair is given by the first bucket that it shares.
    """
    placed = within.join(sizes.select("set_key", "size"), "set_key")
    placed = placed.withColumn("f", F.floor(F.col("far") / (1 - threshold + 1e-9)).cast("int")).withColumn("s", F.floor(F.log("size") / -math.log(threshold) + 1e-9).cast("int") if threshold < 1 else F.col("size"))
    zones = placed.groupBy("band", "f", "s").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = placed.join(zones, ["band", "f", "s"]).withColumn("x", F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int"))
    beside = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    moved = placed.select("band", "set_key", "label", "far", "size", F.struct("f", "s", "x").alias("own"), F.explode(F.array(*beside)).alias("d"))
    others = zones.select("band", F.col("f").alias("of"), F.col("s").alias("os"), F.col("blocks").alias("other_blocks"))
    moved = moved.withColumn("of", F.col("own.f") + F.col("d.i")).withColumn("os", F.col("own.s") + F.col("d.j")).join(others, ["band", "of", "os"])
    moved = moved.withColumn("other", F.explode(F.transform(F.sequence(F.lit(0), F.col("other_blocks") - 1), lambda y: F.struct(F.col("of").alias("f"), F.col("os").alias("s"), y.alias("x")))))
    spelled = lambda c: F.concat_ws(":", *(F.col(f"{c}.{k}") for k in ("f", "s", "x")))
    dealt = moved.select("band", "set_key", "label", "far", "size", spelled("own").alias("own"), spelled("other").alias("other"))
    dealt = dealt.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("other")
    pairs = dealt.groupBy("band", "low", "high").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("band", "low", "high")
    dealt = scratch(dealt.join(pairs, ["band", "low", "high"], "left_semi"), "compared")
    # cells of about CELL rows: their number follows the data, so that no task's share grows with the table
    cells = dealt.count() // CELL + shuffle_partitions(within.sparkSession)
    dealt = dealt.withColumn("cell", F.pmod(F.xxhash64("band", "low", "high"), F.lit(cells)))
    own_bands = within.groupBy("set_key").agg(F.array_sort(F.collect_set("band")).alias("bands"))  # `bands_for` numbers at most
    full = dealt.join(sizes.select("set_key", "marks").join(own_bands, "set_key"), "set_key")
    return full.groupBy("cell").applyInPandas(_agreeing(threshold, recall), "u binary, v binary").distinct()


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS, with_links: bool = True) -> DataFrame:
    """doc_id, text_key, class_id, copy_id, n_copies, n_links of each row.

    docs: doc_id, text; other columns are ignored. Words are the lower-cased text's
    between white space. copy_id: the least doc_id with the same n-gram set; n_copies: so many rows have it; class_id: the
    least doc_id of the component; n_links: verified links of this n-gram set to different ones. A text without words (or null) is alone:
    class_id and copy_id are its own doc_id. Without with_links, n_links is 0. A null doc_id never names a class unless all its
    members have none. Rows that repeat are copies. A text of any length is read whole: its set of n-grams is one row, which takes 8 bytes a different n-gram.
    """
    signed = scratch(signatures(docs, n, bands_for(threshold, recall, rows), rows), "signatures")
    full = signed.where("set_key IS NOT NULL")
    reps = full.groupBy("set_key").agg(F.min("doc_id").alias("copy_id"), F.count("*").alias("n_copies"), F.min(F.struct("doc_id", "text_key")).alias("one"))
    reps = scratch(reps, "reps")
    # Bands are the same for all rows of a set, so a bucket's members are told apart by their set alone.
    banded = full.select("set_key", F.explode("bands").alias("band")).distinct()
    buckets = banded.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    shared = scratch(banded.join(buckets, "band"), "shared")
    # The hub is the member that meets most others over all its buckets: of copies of one text, the text that they were made from.
    central = shared.groupBy("set_key").agg(F.sum("members").alias("meetings"))
    hubs = shared.join(central, "set_key").groupBy("band").agg(F.max_by("set_key", F.struct("meetings", "set_key")).alias("hub"))
    met = scratch(shared.join(hubs, "band").select("band", "set_key", "hub"), "met")
    stars = met.where("set_key <> hub").select(F.col("hub").alias("u"), F.col("set_key").alias("v")).distinct()
    involved = met.select("set_key").distinct().join(reps.select("set_key", "one"), "set_key")
    texts = docs.select(F.col("doc_id").cast("long").alias("__doc"), F.xxhash64("text").alias("__text"), "text")
    found = texts.join(involved, texts["__doc"].eqNullSafe(F.col("one.doc_id")) & (texts["__text"] == F.col("one.text_key")))
    sets = scratch(found.select("set_key", "text").mapInPandas(_gram_sets(n), "set_key binary, grams array<long>, marks binary").dropDuplicates(["set_key"]), "sets")
    tested = scratch(_distances(stars, sets), "tested")
    links = tested.where(_linked(threshold)).select("u", "v")
    labels = components(links)

    # Members of one bucket in different components, but for pairs with the hub, which are tested.
    sizes = sets.select("set_key", F.size("grams").alias("size"), "marks")
    near = tested.select(F.col("u").alias("hub"), F.col("v").alias("set_key"), (1 - F.col("common") / F.col("all")).alias("far"))
    placed = met.where("set_key <> hub").join(labels.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("label", F.coalesce("label", "set_key"))
    split = placed.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("band")
    within = scratch(placed.join(split, "band", "left_semi").join(near, ["hub", "set_key"]).select("band", "set_key", "label", "far"), "within")
    across = near_pairs(within, sizes, threshold, recall)
    more = scratch(_distances(across, sets).where(_linked(threshold)).select("u", "v"), "more")
    if not more.isEmpty():
        links = links.union(more).distinct()
        labels = components(links)

    ends = link_counts(labels, sets, threshold) if with_links else labels.select(F.col("node").alias("set_key"), F.lit(0).alias("n_links"))
    named = reps.join(labels.withColumnRenamed("node", "set_key"), "set_key").select("set_key", "label", "copy_id")
    heads = named.groupBy("label").agg(F.min("copy_id").alias("class_id"))
    joined = named.join(heads, "label").select("set_key", "class_id").join(ends, "set_key")
    out = signed.select("doc_id", "text_key", "set_key").join(reps.select("set_key", "copy_id", "n_copies").join(joined, "set_key", "left"), "set_key", "left")
    alone = F.col("set_key").isNull()
    return out.select(
        "doc_id",
        "text_key",
        F.when(alone, F.col("doc_id")).otherwise(F.coalesce("class_id", "copy_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def one_of_each(docs: DataFrame, **params) -> DataFrame:
    """The rows of docs, all columns whatever their names, of which the least doc_id of each class stays; a row repeated whole stays once."""
    kept = classes(docs, **params, with_links=False).where("doc_id <=> class_id").select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key"))
    keyed = wrapped(docs, "doc_id", F.xxhash64("text").alias("key"))
    return keyed.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key")), "left_semi").dropDuplicates(["doc_id", "key"]).select("row.*")
