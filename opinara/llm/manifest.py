"""Merkle manifest of a table: one tree per group of rows, and one over the groups' roots.

A row's canonical form gives its leaf. The leaves of a group, in order, are hashed in runs of three, level by
level, until one node remains. A superblock is what six levels reduce to one node; it is worked on as a whole. Its top is a
node of the next round, in which tops are numbered and cut into superblocks again, until a group has one left. On the way
back each superblock is cogrouped with the one outer node it needs: the siblings above its top. So a group of any
size is spread over tasks, none of which sees more than a superblock and its path to the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.shared import numbered
from opinara.workspace import stored

#: Nodes hashed into one, and levels of a superblock.
RUN, LEVELS = 3, 6
BLOCK = RUN**LEVELS
#: The columns of ``documents`` in a leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

TREE = ["named", "tree"]
_NODES = "named boolean, tree string, at long, n long, node string"
_PATHS = "named boolean, tree string, at long, above_left array<string>, above_right array<string>, subroot string, root string"
_PROOFS = "key string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(*fields: Column) -> Column:
    """The hash of a row's fields in canonical form: ``-`` for null, else byte count, ``:`` and value."""
    forms = [x.cast("string") for x in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in forms]), 256)


def levels_of(nodes: list[str], whole: bool) -> list[list[str]]:
    """The nodes and the levels above them: up to a single node if these are a whole tree, else ``LEVELS`` of them."""
    levels = [nodes]
    while len(levels[-1]) > 1 if whole else len(levels) <= LEVELS:
        below = levels[-1]
        levels.append([digest("".join(below[i : i + RUN])) for i in range(0, len(below), RUN)])
    return levels


def siblings(levels: list[list[str]], place: int) -> tuple[list[str], list[str]]:
    """What stands left and right of a node's path in its run, on each level below the last."""
    left, right = [], []
    for level in levels[:-1]:
        first = place - place % RUN
        left.append("".join(level[first:place]))
        right.append("".join(level[place + 1 : first + RUN]))
        place //= RUN
    return left, right


def fold(node: str, left: Sequence[str], right: Sequence[str]) -> str:
    """The root that a node leads to with these siblings."""
    for before, after in zip(left, right):
        node = digest(before + node + after)
    return node


def _in_blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"at div {BLOCK}"))


def _block_levels(block: pd.DataFrame, node: str) -> tuple[pd.DataFrame, list[list[str]]]:
    block = block.sort_values("at")
    return block, levels_of(block[node].tolist(), whole=block["n"].iloc[0] <= BLOCK)


def _tops(nodes: DataFrame) -> DataFrame:
    """The top of each superblock, as a node of the next round."""

    def top(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block, levels = _block_levels(block, "node")
        n = -(-int(block["n"].iloc[0]) // BLOCK)
        return pd.DataFrame([(*key, n, levels[-1][0])], columns=[*TREE, "at", "n", "node"])

    return _in_blocks(nodes).groupBy(*TREE, "block").applyInPandas(top, _NODES)


def _paths(nodes: DataFrame, above: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Per node its siblings up to its tree's root and on to what is ``above`` the roots, with the roots."""
    if (nodes.agg(F.max("n")).first()[0] or 1) == 1:
        return above(nodes)
    outer = _paths(stored(_tops(nodes), "block-tops"), above)

    def joined(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        block, levels = _block_levels(block, "node")
        o = outer.iloc[0]
        found = []
        for place in range(len(block)):
            left, right = siblings(levels, place)
            found.append((left + list(o["above_left"]), right + list(o["above_right"]), o["subroot"], o["root"]))
        paths = pd.DataFrame(found, columns=["above_left", "above_right", "subroot", "root"])
        return pd.concat([block[[*TREE, "at"]].reset_index(drop=True), paths], axis=1)

    return stored(_with_outer(nodes, outer).applyInPandas(joined, _PATHS), "block-paths")


def _with_outer(nodes: DataFrame, outer: DataFrame):
    """The nodes of a superblock with the node of the round above that is its top."""
    return _in_blocks(nodes).groupBy(*TREE, "block").cogroup(outer.withColumnRenamed("at", "block").groupBy(*TREE, "block"))


def _over_groups(subroots: DataFrame) -> DataFrame:
    """The paths of the groups' roots in the tree over them, null first, then by bytes."""
    ordered = numbered(subroots.select(*TREE, "node"), [], TREE, "ordered-roots")
    nodes = ordered.select(F.lit(True).alias("named"), F.lit("").alias("tree"), "at", "n", "node")
    nothing = F.array().cast("array<string>")
    root = lambda top: top.select(*TREE, "at", nothing.alias("above_left"), nothing.alias("above_right"), F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"))
    paths = _paths(nodes, root).drop(*TREE, "subroot")
    met = ordered.drop("n").join(paths, "at")
    return stored(met.select(*TREE, F.lit(0).cast("long").alias("at"), "above_left", "above_right", F.col("node").alias("subroot"), "root"), "root-paths")


def merkle_manifest(df: DataFrame, key: str, group: str, leaf: Column, presented: Column | None = None) -> DataFrame:
    """Per row its key, ``leaf``, its group's ``subroot``, the ``root``, its proof's hash and what its presented leaf folds to.

    ``leaf`` and ``presented`` are columns over ``df``; a row without a presented leaf presents its own. The proof is the
    hash of all siblings from the leaf to the root, left to right on each level; ``folded_root`` is what the presented leaf and these
    siblings lead to, ``verified`` whether that is the root. Leaves are in the order of their keys, a
    null key first, then of their hashes, so repeated rows stand side by side and each has its own place. A null group
    is a group of its own, before all others. A group of one row has its leaf as subroot, a table of one
    group its subroot as root, and a row without siblings the hash of nothing as proof. An empty table gives no rows.
    Columns that ``leaf`` and ``presented`` don't use are not read. Texts are hashed where they are
    read; only hashes move.
    """
    name = F.col(f"`{group}`").cast("string")
    rows = df.select(
        name.isNotNull().alias("named"),
        F.coalesce(name, F.lit("")).alias("tree"),
        F.col(f"`{key}`").alias("key"),
        leaf.alias("node"),
        (presented if presented is not None else F.lit(None).cast("string")).alias("presented"),
    )
    leaves = stored(numbered(rows, TREE, ["key", "node"], "ordered-leaves"), "leaves")
    outer = _paths(stored(_tops(leaves), "block-tops"), _over_groups)

    def proved(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        block, levels = _block_levels(block, "node")
        o = outer.iloc[0]
        above = "".join(a + b for a, b in zip(o["above_left"], o["above_right"]))
        beyond: dict[str, str] = {}
        found = []
        for place, (key, node, other) in enumerate(zip(block["key"], block["node"], block["presented"])):
            left, right = siblings(levels, place)
            top = fold(other or node, left, right)
            if top not in beyond:
                beyond[top] = fold(top, o["above_left"], o["above_right"])
            proof = digest("".join(a + b for a, b in zip(left, right)) + above)
            found.append((key, node, o["subroot"], o["root"], proof, beyond[top], beyond[top] == o["root"]))
        return pd.DataFrame(found, columns=[x.split()[0] for x in _PROOFS.split(", ")])

    # Keys pass pandas as text, in which a null does not make numbers inexact.
    found = _with_outer(leaves.withColumn("key", F.col("key").cast("string")), outer).applyInPandas(proved, _PROOFS)
    return found.withColumn("key", F.col("key").cast(df.schema[key].dataType)).withColumnRenamed("key", key)


def document_manifest(df: DataFrame, presented_text: Column | None = None) -> DataFrame:
    """The manifest of ``documents``, a tree per source; ``presented_text`` is the text each row presents where it isn't null."""
    fields = [F.col(f) for f in FIELDS]
    presented = None
    if presented_text is not None:
        presented = F.when(presented_text.isNotNull(), leaf_of(*fields[:-1], presented_text))
    return merkle_manifest(df, "doc_id", "source", leaf_of(*fields), presented)
