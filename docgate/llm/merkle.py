"""Merkle manifest of a dataset: a root over groups of rows, and for each row the proof that it belongs."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgate.llm.common import numbered, stage

#: Children of a node, and the levels that one task collapses at a time: a superblock has FANOUT ** LEVELS nodes.
FANOUT, LEVELS = 8, 4
_NODE = "tree string, idx long, n long, node string"
_PROOF = "before array<string>, after array<string>, tops array<string>"


def leaf_of(*columns: str | Column) -> Column:
    """The digest of a row: SHA-256 over its values, each as its number of UTF-8 bytes, a colon and the value; `-` for null."""
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t), F.lit(":"), t)) for t in texts]), 256)


def folded(leaf: Column, before: Column, after: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(F.arrays_zip(before.alias("before"), after.alias("after")), leaf, lambda node, x: F.sha2(F.concat(x["before"], node, x["after"]), 256))


def siblings(before: Column, after: Column) -> Column:
    """All digests of a proof as one text, level by level, left to right."""
    return F.array_join(F.zip_with(before, after, lambda b, a: F.concat(b, a)), "")


def _collapsed(nodes: list[str], alone: bool, fanout: int, levels: int) -> list[list[str]]:
    """The nodes and the levels above them: as many as stated, or up to one node where the superblock is its whole tree."""
    found = [nodes]
    for _ in range(levels):
        if alone and len(found[-1]) == 1:
            break
        found.append([hashlib.sha256("".join(found[-1][i : i + fanout]).encode()).hexdigest() for i in range(0, len(found[-1]), fanout)])
    return found


def _superblocks(rows: pd.DataFrame, size: int):
    """(tree, number, alone, rows) of each superblock that a group holds."""
    rows = rows.sort_values(["tree", "idx"], kind="stable")
    for (tree, number), own in rows.groupby(["tree", rows["idx"] // size], sort=False):
        yield tree, int(number), int(own["n"].iloc[0]) <= size, own


def _tops(rows: pd.DataFrame, fanout: int, levels: int) -> pd.DataFrame:
    size, out = fanout**levels, []
    for tree, number, alone, own in _superblocks(rows, size):
        out.append((tree, number, -(-int(own["n"].iloc[0]) // size), _collapsed(own["node"].tolist(), alone, fanout, levels)[-1][0]))
    return pd.DataFrame(out, columns=["tree", "idx", "n", "node"])


def _lower(rows: pd.DataFrame, upper: pd.DataFrame, fanout: int, levels: int, columns: list[str]) -> pd.DataFrame:
    """Each node's proof: its siblings inside of the superblock, then those of the superblock's own proof."""
    above = {(t, i): (list(b), list(a), list(tops)) for t, i, b, a, tops in zip(upper["tree"], upper["idx"], upper["before"], upper["after"], upper["tops"], strict=True)}
    parts = []
    for tree, number, alone, own in _superblocks(rows, fanout**levels):
        found = _collapsed(own["node"].tolist(), alone, fanout, levels)[:-1]
        upper_before, upper_after, tops = above[tree, number]
        before, after = [], []
        for i in range(len(own)):
            left, right = [], []
            for level in found:
                run = i - i % fanout
                left.append("".join(level[run:i]))
                right.append("".join(level[i + 1 : run + fanout]))
                i //= fanout
            before.append(left + upper_before)
            after.append(right + upper_after)
        parts.append(own.assign(before=before, after=after, tops=[tops] * len(own)))
    return pd.concat(parts)[columns] if parts else pd.DataFrame(columns=columns)


def _block(number: Column, blocks: int) -> Column:
    """Superblocks are dealt to groups by hash, so that many small trees share a group."""
    return F.pmod(F.xxhash64("tree", number), F.lit(blocks)).alias("block")


def _climb(leaves: DataFrame, fanout: int, levels: int) -> list[tuple[DataFrame, int]]:
    """Tables of nodes, from the leaves to one node for each tree, and the number of groups of each."""
    found, size = [], fanout**levels
    while True:
        rows, most = leaves.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
        blocks = 4 * rows // size + 1
        found.append((leaves, blocks))
        if found[1:] and most <= 1:
            return found
        due = leaves.select("tree", "idx", "n", "node").groupBy(_block(F.floor(F.col("idx") / size), blocks))
        leaves = stage(due.applyInPandas(lambda own: _tops(own, fanout, levels), _NODE), "nodes")


def _descend(found: list[tuple[DataFrame, int]], upper: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The leaves with their proofs, from the proofs of each tree's top: what is below a superblock is joined to what is above."""
    for nodes, blocks in reversed(found[:-1]):
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema) + f", {_PROOF}"
        columns = [*nodes.columns, "before", "after", "tops"]
        each = nodes.groupBy(_block(F.floor(F.col("idx") / fanout**levels), blocks))
        proofs = upper.select("tree", "idx", "before", "after", "tops").groupBy(_block(F.col("idx"), blocks))
        upper = each.cogroup(proofs).applyInPandas(lambda _, a, b: _lower(a, b, fanout, levels, columns), schema)
    return upper


def prove(rows: DataFrame, tree: str, by: str, leaf: str, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """rows with subroot, root, before and after.

    The leaves (hex digests) of each value of `tree` stand in the order of `by`; every `fanout` consecutive nodes become their digest
    until one is left, the tree's subroot. The subroots, in the order of `tree`, give the root in the same way. before and after are
    the proof: an entry per level, from the leaf's to the root's, with the digests that stand before and after the node in its run.

    Nulls of `tree` and `by` come first; rows of one `by` stand in the order of their leaves, and of equal leaves any order gives
    the same rows. Other columns stay as they are, whatever their names (subroot, root, before and after are replaced). No rows give
    no rows. `by` must be of a type that Spark can sort.

    Superblocks of fanout ** levels nodes are collapsed at once by one task each, so that a tree of any size takes
    log(n) / log(fanout ** levels) rounds, and rows of 64 hex digits move; proofs are made in one way down, beside the rows."""
    kept = [c for c in rows.columns if c not in ("subroot", "root", "before", "after")]
    named = {c: f"c{i}" for i, c in enumerate(kept)}
    group = F.when(F.col(f"`{tree}`").isNull(), "").otherwise(F.concat(F.lit("="), F.col(f"`{tree}`").cast("string")))
    leaves = rows.select(group.alias("tree"), F.col(f"`{by}`").alias("by"), F.col(f"`{leaf}`").alias("node"), *[F.col(f"`{c}`").alias(n) for c, n in named.items()])
    leaves = numbered(stage(leaves.drop(named[leaf]), "leaves"), "tree", "by", "node").drop("by")
    trees = _climb(leaves, fanout, levels)
    subroots = trees[-1][0].select(F.lit("").alias("tree"), F.col("tree").alias("by"), "node", F.col("tree").alias("of"))
    forest = _climb(numbered(subroots, "tree", "by").drop("by"), fanout, levels)
    none = F.array().cast("array<string>")
    root = forest[-1][0].select("tree", "idx", none.alias("before"), none.alias("after"), F.array("node").alias("tops"))
    upper = _descend(forest, root, fanout, levels)
    upper = upper.select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("idx"), "before", "after", F.concat(F.array("node"), F.col("tops")).alias("tops"))
    proven = _descend(trees, stage(upper, "upper"), fanout, levels)
    out = [F.col("node" if c == leaf else n).alias(c) for c, n in named.items()]
    return proven.select(*out, F.col("tops")[0].alias("subroot"), F.col("tops")[1].alias("root"), "before", "after")
