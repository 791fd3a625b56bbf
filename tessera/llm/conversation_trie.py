"""The prefix trie of conversations, and what sharing prefixes saves, by an Euler tour.

Every distinct sequence of first turns is a node. A node has an arc by which a walk around
the trie enters it and one by which the walk leaves it; the arcs form one list, which is ranked in Spark (list_ranking).
Leaves count 1 and tokens saved count at their node's entering arc: a subtree's sums are those between its two arcs.

Prefixes are told apart by their length and by 128 bits: the exclusive or of hashes of (place, turn), which may be
taken in any grouping, so that a long conversation is hashed in slices. Turns are told apart by SHA-256. Two different prefixes of
equal length meet with a chance of 2**-128.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch
from .list_ranking import WALKED, prefix_sums
from .ordering import positions

#: Rows of one conversation, or ids of one node, that go together.
SLICE = 4096
#: Conversations by this many share the first one's beginning.
FAMILY = 20
#: At most so many turns, less one, are taken from there.
HEADS = 4


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, position (from 1), ident (SHA-256 of role and text), words of each turn; null roles and texts are empty.

    Turns ascend by turn, null first; turns that tie, by ident. Rows without a conv_id are turns of no conversation and left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("ident"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    return positions(scratch(turns, "hashed"), ["conv_id"], ["turn", "ident"], "turns").select("conv_id", "position", "ident", "words")


def rebuilt(turns: DataFrame, size: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """Conversations whose beginnings are taken from the first of their family: (conv_id, length), and (conv_id, depth, ident, words, length) of their turns.

    turns: conv_id, position, ident, words. Conversation c begins with the first h turns of conversation c - c % 20, h being the
    CRC-32 of c's digits modulo 4, and goes on with its own turns after its first h.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("long")
    sizes = turns.groupBy("conv_id").agg(F.max("position").alias("n"))
    own = sizes.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("first"))
    convs = own.join(sizes.select(F.col("conv_id").alias("first"), F.col("n").alias("there")), "first", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    convs = scratch(convs.select("conv_id", "n", "h", "first", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    heads = turns.where(f"position < {HEADS}").select(F.col("conv_id").alias("first"), "position", "ident", "words")
    begun = convs.join(heads, "first").where("position <= taken").select("conv_id", F.col("position").alias("depth"), "ident", "words", "length")
    slices = convs.where("n > h").withColumn("slice", F.explode(F.expr(f"sequence(0, n div {size})")))
    later = turns.where(F.col("position") > h).withColumn("slice", F.expr(f"position div {size}")).join(slices, ["conv_id", "slice"])
    gone_on = later.select("conv_id", (F.col("taken") + F.col("position") - F.col("h")).alias("depth"), "ident", "words", "length")
    return convs.select("conv_id", "length"), begun.union(gone_on)


def prefixes(turns: DataFrame, size: int = SLICE) -> DataFrame:
    """conv_id, depth, the two halves of the prefix's identity and of its parent's, words, ends (whether the conversation ends there), of each rebuilt turn."""
    a, b = F.xxhash64("depth", "ident"), F.xxhash64("ident", "depth")
    each = turns.select("conv_id", "depth", "words", (F.col("depth") == F.col("length")).alias("ends"), a.alias("a"), b.alias("b"), F.expr(f"depth div {size}").alias("slice"))
    each = scratch(each, "rebuilt")
    so_far = Window.partitionBy("conv_id", "slice").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = each.groupBy("conv_id", "slice").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    before = sums.select("conv_id", "slice", F.bit_xor("a").over(earlier).alias("before_a"), F.bit_xor("b").over(earlier).alias("before_b")).where("slice > 0")
    run = each.withColumns({"run_a": F.bit_xor("a").over(so_far), "run_b": F.bit_xor("b").over(so_far)}).join(before, ["conv_id", "slice"], "left")
    key = {c: F.col(f"run_{c}").bitwiseXOR(F.coalesce(f"before_{c}", F.lit(0))) for c in "ab"}
    return run.select("conv_id", "depth", "words", "ends", key["a"].alias("key_a"), key["b"].alias("key_b"), key["a"].bitwiseXOR(F.col("a")).alias("up_a"), key["b"].bitwiseXOR(F.col("b")).alias("up_b"))


NODE = ["depth", "key_a", "key_b"]


def _ends(ended: DataFrame, size: int) -> DataFrame:
    """NODE, ends_sha256: the digest of the ids, ascending, of conversations that end at a node. A node's ids go through one task, in pieces, and through a running digest, never together."""
    placed = positions(ended, NODE, ["conv_id"], "ends").withColumn("piece", F.expr(f"(position - 1) div {size}"))
    pieces = placed.groupBy(*NODE, "piece").agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string"))).alias("ids"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state = None, None
        for frame in batches:
            out = []
            for *own, ids in frame.itertuples(index=False):
                if own == node:
                    state.update(b"," + ids.encode())
                    continue
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = own, sha256(ids.encode())
            yield pd.DataFrame(out, columns=[*NODE, "ends_sha256"])
        if node:
            yield pd.DataFrame([(*node, state.hexdigest())], columns=[*NODE, "ends_sha256"])

    dealt = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece").select(*NODE, "ids")
    return dealt.mapInPandas(run, "depth long, key_a long, key_b long, ends_sha256 string")


def _siblings(children: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, earlier, later (conv_ids of the siblings beside it) of each child, in the order of conv_ids."""
    placed = scratch(positions(children, ["parent_conv_id", "depth"], ["conv_id"], "children"), "placed")
    none, at = F.lit(None).cast("long"), ["parent_conv_id", "depth"]
    told = (
        placed.select(*at, "position", "conv_id", none.alias("earlier"), none.alias("later"))
        .union(placed.select(*at, F.col("position") + 1, none, "conv_id", none))
        .union(placed.select(*at, F.col("position") - 1, none, none, "conv_id"))
    )
    return told.groupBy(*at, "position").agg(*(F.max(c).alias(c) for c in ("conv_id", "earlier", "later"))).where("conv_id IS NOT NULL").drop("position")


def _arcs(nodes: DataFrame) -> DataFrame:
    """The tour as a list: arc, prev, next, leaves, saved. nodes: conv_id, depth, n_convs, words, n_children, first_child, last_child, parent_conv_id, earlier, later."""

    def arc(conv: str, depth: int, side: str):
        return F.when(F.col(conv).isNotNull(), F.concat(F.col(conv).cast("string"), F.lit(":"), (F.col("depth") + depth).cast("string"), F.lit(side)))

    zero = F.lit(0).cast("long")
    entering = nodes.select(
        arc("conv_id", 0, "+").alias("arc"),
        F.coalesce(arc("earlier", 0, "-"), arc("parent_conv_id", -1, "+")).alias("prev"),
        F.coalesce(arc("first_child", 1, "+"), arc("conv_id", 0, "-")).alias("next"),
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    )
    leaving = nodes.select(
        arc("conv_id", 0, "-"),
        F.coalesce(arc("last_child", 1, "-"), arc("conv_id", 0, "+")),
        F.coalesce(arc("later", 0, "+"), arc("parent_conv_id", -1, "-")),
        zero,
        zero,
    )
    return entering.union(leaving)


def nodes(conversations: DataFrame, size: int = SLICE, walked: int = WALKED) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node of the trie of rebuilt conversations.

    conversations: conv_id, turn, role, text; other columns are ignored. A node's conv_id is its least member; with the depth it
    names the node. Nulls: see ordered_turns. Rows that are repeated whole are turns that are said twice. A conversation may be of
    any length, and any number of conversations may share a node: neither meets in one task. An empty table has no conversations and gives no nodes, not even the root.
    size, walked: how much goes together (less only for tests).
    """
    turns = scratch(ordered_turns(conversations), "turns")
    convs, rows = rebuilt(turns, size)
    members = scratch(prefixes(rows, size), "members")
    zero = F.lit(0).cast("long")
    whole = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = whole.select(zero.alias("depth"), zero.alias("key_a"), zero.alias("key_b"), "conv_id", "n_convs", zero.alias("words"), zero.alias("up_a"), zero.alias("up_b"))
    grown = members.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *(F.max(c).alias(c) for c in ("words", "up_a", "up_b")))
    found = scratch(root.union(grown), "nodes")
    above = found.select((F.col("depth") + 1).alias("depth"), F.col("key_a").alias("up_a"), F.col("key_b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    children = scratch(found.where("depth > 0").join(above, ["depth", "up_a", "up_b"]).select("parent_conv_id", "depth", "conv_id"), "children")
    families = children.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(
        F.count("*").alias("n_children"), F.min("conv_id").alias("first_child"), F.max("conv_id").alias("last_child")
    )
    linked = found.join(families, ["conv_id", "depth"], "left").join(_siblings(children), ["conv_id", "depth"], "left").fillna(0, ["n_children"])
    linked = scratch(linked, "linked")
    sums = prefix_sums(_arcs(linked), ["leaves", "saved"], walked)
    entered, side = F.col("side") == "+", F.expr("right(arc, 1)").alias("side")
    at = sums.select(F.expr("left(arc, length(arc) - 1)").alias("node"), side, "leaves", "saved").groupBy("node")
    at = at.agg(*(F.max(F.when(entered if s == "in" else ~entered, F.col(w))).alias(f"{w}_{s}") for w in ("leaves", "saved") for s in ("in", "out")))
    name = F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("depth").cast("string"))
    ended = members.where("ends").select(*NODE, "conv_id").union(convs.where("length = 0").select(zero, zero, zero, "conv_id"))
    out = linked.withColumn("node", name).join(at, "node").join(_ends(ended, size), NODE, "left")
    own = F.when(F.col("n_children") == 0, 1).otherwise(0)
    return out.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        (F.col("leaves_out") - F.col("leaves_in") + own).alias("n_leaves"),
        (F.col("saved_out") - F.col("saved_in") + (F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
