"""A Merkle manifest of a dataset: trees of hashes by group, proofs of every row, and the root that each tampered row would give.

The tree is persistent: a tampered row is a version of its own, which shares every node that
it doesn't change and copies its row's ancestors alone. Nodes are taken in aligned blocks of
FANOUT**DEPTH; within a block a version copies DEPTH nodes, and then goes on, by the path of its
block, through the upper blocks, whose other nodes it shares with all other versions. A block is
a row of a table, so that the lowest level is hashed in as many tasks as there are blocks, and
each level of blocks has 1/512 of the nodes of the one below. Hashes are of text: lowercase hex of SHA-256.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch
from .exact_dedup import normalised
from .ordering import positions

FANOUT = 8
#: Levels of nodes within a block.
DEPTH = 3
#: What a leaf is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


class Block:
    """A run of up to FANOUT**depth nodes and the levels above them: up to one node if they are alone in their tree, else depth levels."""

    def __init__(self, nodes: list[str], alone: bool, depth: int):
        self.levels = [nodes]
        while len(self.levels[-1]) > 1 if alone else len(self.levels) <= depth:
            low = self.levels[-1]
            self.levels.append([digest("".join(low[i : i + FANOUT])) for i in range(0, len(low), FANOUT)])
        self.top = self.levels[-1][0]

    def path(self, i: int) -> list[tuple[str, str]]:
        """The siblings to the left and to the right of node i's ancestors and itself, joined, level by level."""
        out = []
        for low in self.levels[:-1]:
            start = i - i % FANOUT
            out.append(("".join(low[start:i]), "".join(low[i + 1 : start + FANOUT])))
            i //= FANOUT
        return out


def copied(node: str, path: list[tuple[str, str]]) -> str:
    """The top of the version in which a node is replaced: only its ancestors are made anew, their siblings are shared."""
    for left, right in path:
        node = digest(left + node + right)
    return node


def field(c: Column) -> Column:
    """- for null, else the UTF-8 bytes' count, a colon and the value."""
    s = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, key, leaf, altered of each row of documents.

    key: its lang, so marked that null comes first. altered: the leaf after tampering (A-Z of the text in
    lower case), where 3 divides the CRC-32 of the decimal doc_id; else null. A null doc_id isn't tampered with, and a
    null text has nothing to tamper with, so that its altered leaf equals its leaf.
    """
    cols = {c: F.col(c) for c in FIELDS} | {"doc_id": F.col("doc_id").cast("long"), "n_chars": F.col("n_chars").cast("long")}
    lowered = cols | {"text": F.when(F.col("text").isNotNull(), normalised(F.col("text")))}
    hashed = [F.sha2(F.concat(*(field(c[f]) for f in FIELDS)), 256) for c in (cols, lowered)]
    tampered = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 3 == 0
    key = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("+"), F.col("lang")))
    return docs.select(cols["doc_id"].alias("doc_id"), key.alias("key"), hashed[0].alias("leaf"), F.when(tampered, hashed[1]).alias("altered"))


def _blocks(nodes: DataFrame, keep: list[str], depth: int) -> DataFrame:
    """key, block, alone, nodes (sorted structs of place and the columns to keep) of nodes: key, place (from 0), keep."""
    packed = nodes.groupBy("key", F.expr(f"place div {FANOUT**depth}").alias("block")).agg(F.sort_array(F.collect_list(F.struct("place", *keep))).alias("nodes"))
    packed = scratch(packed, "blocks")
    only = packed.groupBy("key").agg((F.max("block") == 0).alias("alone"))
    return packed.join(only, "key").select("key", "block", "alone", *(F.col(f"nodes.{c}").alias(c) for c in keep))


def _tops(blocks: DataFrame, depth: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rows["node"] = [Block(list(x), alone, depth).top for x, alone in zip(rows.leaf, rows.alone, strict=True)]
            yield rows[["key", "block", "alone", "node"]]

    return blocks.select("key", "block", "alone", "leaf").mapInPandas(run, "key string, block long, alone boolean, node string")


def _tree(nodes: DataFrame, keep: list[str], depth: int) -> tuple[list[DataFrame], DataFrame]:
    """The tables of blocks, lowest first, and key, node: the one node that remains of each key. nodes: key, place, leaf and what else to keep."""
    levels, rest = [], nodes
    done = None
    while True:
        blocks = _blocks(rest, keep, depth)
        levels.append(blocks)
        tops = scratch(_tops(blocks, depth), "tops")
        ended = tops.where("alone").select("key", "node")
        done = ended if done is None else done.union(ended)
        rest, keep = tops.where("NOT alone").select("key", F.col("block").alias("place"), F.col("node").alias("leaf")), ["leaf"]
        if rest.isEmpty():
            return levels, done


def _paths(blocks: DataFrame, above: DataFrame | None, depth: int) -> DataFrame:
    """key, block, lefts, rights: for each node of upper blocks, which is a block below, the siblings on its way to the key's one node. above: those of the blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for key, number, alone, nodes, lefts, rights in rows.itertuples(index=False):
                tree = Block(list(nodes), alone, depth)
                further = [] if alone else list(zip(lefts, rights, strict=True))
                for i in range(len(nodes)):
                    path = tree.path(i) + further
                    out.append((key, number * FANOUT**depth + i, [x for x, _ in path], [x for _, x in path]))
            yield pd.DataFrame(out, columns=["key", "block", "lefts", "rights"])

    return _with_paths(blocks.select("key", "block", "alone", "leaf"), above).mapInPandas(run, "key string, block long, lefts array<string>, rights array<string>")


def _with_paths(blocks: DataFrame, above: DataFrame | None) -> DataFrame:
    if above is None:
        return blocks.withColumns({c: F.array().cast("array<string>") for c in ("lefts", "rights")})
    return blocks.join(above, ["key", "block"], "left")


def _down(levels: list[DataFrame], depth: int) -> DataFrame | None:
    """The paths of the lowest blocks; None where every key has one block."""
    above = None
    for blocks in levels[:0:-1]:
        above = scratch(_paths(blocks, above, depth), "paths")
    return above


def audited(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each of rows: doc_id, key, leaf, altered (see leaves).

    Of each key the leaves ascend by doc_id (null first), then by leaf; equal leaves beside each other are
    interchangeable, so that rows that are repeated whole get proofs of places next to each other, in any order. Keys in
    the order of their bytes give the root. A table of one row is its own root and has an empty proof; an empty table gives no rows. Texts
    don't leave the first stage: a row goes on as its digests, whatever its length. No two tasks share a block, and a block has 512 rows at most.
    depth: levels of nodes in a block (fewer only to test many levels of blocks).
    """
    narrow = scratch(rows.select("doc_id", "key", "leaf", "altered"), "hashed")
    ranked = positions(narrow, ["key"], ["doc_id", "leaf"], "leaves").withColumn("place", F.col("position") - 1)
    levels, subroots = _tree(ranked, ["doc_id", "leaf", "altered"], depth)
    subroots = scratch(subroots, "subroots")
    keys = positions(subroots.select(F.lit("").alias("key"), F.col("key").alias("own"), F.col("node").alias("leaf")), ["key"], ["own"], "keys").withColumn("place", F.col("position") - 1)
    upper, tops = _tree(keys, ["leaf", "own"], depth)
    last = tops.first()
    root = last.node if last else ""
    high = _down(upper, depth)

    def lower_paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of each key, the siblings on the way of its one node to the root."""
        for frame in batches:
            out = []
            for alone, nodes, own, lefts, rights in frame.itertuples(index=False):
                tree = Block(list(nodes), alone, depth)
                for i, key in enumerate(own):
                    path = tree.path(i) + ([] if alone else list(zip(lefts, rights, strict=True)))
                    out.append((key, nodes[i], [x for x, _ in path], [x for _, x in path]))
            yield pd.DataFrame(out, columns=["key", "subroot", "root_lefts", "root_rights"])

    by_key = _with_paths(upper[0].select("key", "block", "alone", "leaf", "own"), high).select("alone", "leaf", "own", "lefts", "rights")
    by_key = scratch(by_key.mapInPandas(lower_paths, "key string, subroot string, root_lefts array<string>, root_rights array<string>"), "by_key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for alone, ids, nodes, altered, subroot, root_lefts, root_rights, lefts, rights in frame.itertuples(index=False):
                tree = Block(list(nodes), alone, depth)
                above = ([] if alone else list(zip(lefts, rights, strict=True))) + list(zip(root_lefts, root_rights, strict=True))
                tail = "".join(a + b for a, b in above)
                shared = copied(tree.top, above)
                for i, node in enumerate(nodes):
                    path = tree.path(i)
                    proof = digest("".join(a + b for a, b in path) + tail)
                    changed = altered[i] is not None and altered[i] != node
                    folded = copied(copied(altered[i], path), above) if changed else shared
                    out.append((ids[i], node, subroot, root, proof, folded, folded == root))
            yield pd.DataFrame(out, columns=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]).astype({"doc_id": "Int64"})

    blocks = _with_paths(levels[0].join(by_key, "key"), _down(levels, depth))
    blocks = blocks.select("alone", F.expr("transform(doc_id, x -> cast(x AS string))").alias("ids"), "leaf", "altered", "subroot", "root_lefts", "root_rights", "lefts", "rights")
    return blocks.mapInPandas(lambda b: run(_as_ids(b)), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def _as_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ids come as text, as a null among numbers would turn them into floats."""
    for frame in batches:
        frame["ids"] = [[None if x is None else int(x) for x in ids] for ids in frame.ids]
        yield frame
