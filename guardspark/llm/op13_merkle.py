"""Operator 13: Merkle manifest of a dataset, as trees of SHA-256 midstates.

Leaves are digests of rows; per ``lang`` they ascend by doc_id, and every ``FANOUT`` consecutive
nodes (the last run may have fewer, even one) become the digest of their hex texts joined, until
one is left, the subroot.  The subroots, ordered by lang, are the leaves of one more tree, whose top is the root.

A parent in memory (``Parent``) keeps a copy of its hash state from before each child slot.
Folding a replaced child resumes the copy of its slot with the replacement and the siblings
right of it only; left siblings are not hashed again.  The proof digest of a leaf runs along the same way up.

Scale: digests are taken JVM-side, so texts are read once and never shuffled.  Narrow rows
are ranked per tree by one range sort and per-partition totals.  A tree is cut into
blocks of ``FANOUT ** LEVELS`` nodes at each storey: a task hashes whole
blocks, whatever the share of one lang, and a storey has 512 times fewer rows than the one
below.  The way from a block to the root goes down storey by storey, one row a block, and the leaves
are folded block by block beside it: no path is copied per leaf, no tree sits in one task or on the driver.

Defined results: nulls in any column are written ``-`` (empty texts ``0:``); a null lang is a tree of its own
and comes first; null doc_ids come first in their tree; equal doc_ids are ordered by leaf, so
repeated rows are leaves of their own and reruns agree; very long texts are hashed whole; other columns are ignored; an empty table has no
root and gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardspark.llm.common import crc_mod, staged

FANOUT = 8
#: Levels of a block.
LEVELS = 3
BLOCK = FANOUT**LEVELS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NODES = "tree string, pos long, total long, digest string"
#: A node's way up: for each level from the lowest, its slot and the run's digests.
STEPS = "steps array<struct<slot:int,run:array<string>>>"


class Parent:
    """A run of children and the hash state before each slot."""

    __slots__ = ("children", "states", "digest")

    def __init__(self, children: list[str]) -> None:
        self.children = children
        self.states = []
        state = hashlib.sha256()
        for child in children:
            self.states.append(state.copy())
            state.update(child.encode())
        self.digest = state.hexdigest()

    def folded(self, slot: int, replacement: str) -> str:
        """The digest with one child replaced."""
        state = self.states[slot].copy()
        state.update(replacement.encode())
        state.update("".join(self.children[slot + 1 :]).encode())
        return state.hexdigest()

    def siblings(self, slot: int) -> str:
        return "".join(self.children[:slot] + self.children[slot + 1 :])


def height(nodes: int) -> int:
    """Levels from ``nodes`` nodes up to one."""
    levels = 0
    while nodes > 1:
        nodes = -(-nodes // FANOUT)
        levels += 1
    return levels


def block_parents(digests: list[str], total: int) -> list[list[Parent]]:
    """The parents of a block level by level: of a tree with ``total`` nodes no
    more levels than it has."""
    out: list[list[Parent]] = []
    for _ in range(min(LEVELS, height(total))):
        row = [Parent(digests[i : i + FANOUT]) for i in range(0, len(digests), FANOUT)]
        out.append(row)
        digests = [p.digest for p in row]
    return out


# ----------------------------------------------------------------- ranking


def _ranked(rows: DataFrame, by: list[Column], tree: str, name: str) -> DataFrame:
    """Staged ``rows`` with their place ``pos`` in the tree and its ``total``.

    One range sort; places inside a partition come from the row numbers, those
    between partitions from totals of (partition, tree).
    """
    held = staged(
        rows.repartitionByRange(F.col(tree), *by).sortWithinPartitions(F.col(tree), *by).withColumn("at", F.monotonically_increasing_id()),
        name,
    ).withColumn("part", F.shiftright("at", 33))
    parts = held.groupBy(tree, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(tree).orderBy("part")
    parts = parts.select(
        F.col(tree).alias("p_tree"),
        F.col("part").alias("p_part"),
        (F.sum("n").over(order) - F.col("n") - F.col("first")).alias("shift"),
        F.sum("n").over(Window.partitionBy(tree)).alias("total"),
    )
    on = (F.col(tree) == F.col("p_tree")) & (F.col("part") == F.col("p_part"))
    return held.join(parts, on).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "p_tree", "p_part", "shift")


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """SHA-256 of the fields, each ``-`` or its byte count, ``:`` and value."""

    def field(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[field(c) for c in (doc_id, source, lang, n_chars, text)]).cast("binary"), 256)


def leaves(docs: DataFrame, replaced: Column | None = None, where: Column | None = None) -> DataFrame:
    """Ranked rows (doc_id, tree, leaf, replacement, pos, total).

    ``replacement`` is the leaf with the text ``replaced`` in rows that ``where`` selects, else
    the leaf itself.
    """
    digest = lambda text: leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    leaf = digest(F.col("text"))
    other = leaf if replaced is None or where is None else F.when(where, digest(replaced)).otherwise(leaf)
    rows = docs.select(
        "doc_id",
        # '-' sorts before '=', so the null lang comes first
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-")).alias("tree"),
        leaf.alias("leaf"),
        other.alias("replacement"),
    )
    # staged: the range sort reads its input twice, and texts are to be read once
    hashed = staged(rows, "merkle-hashes")
    return _ranked(hashed, [F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("replacement")], "tree", "merkle-leaves")


# ----------------------------------------------------------------- upwards


def _tops(block: pd.DataFrame) -> pd.DataFrame:
    """The node above a block."""
    block = block.sort_values("pos")
    total, digests = int(block["total"].iloc[0]), block["digest"].tolist()
    parents = block_parents(digests, total)
    top = parents[-1][0].digest if parents else digests[0]
    pos = int(block["pos"].iloc[0]) // BLOCK
    return pd.DataFrame({"tree": [block["tree"].iloc[0]], "pos": [pos], "total": [-(-total // BLOCK)], "digest": [top]})


def storeys(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` (tree, pos, total, digest) and the nodes above their blocks,
    up to one node a tree."""
    out = [nodes]
    while (out[-1].agg(F.max("total")).first()[0] or 0) > 1:
        below = out[-1].select("tree", "pos", "total", "digest", F.floor(F.col("pos") / BLOCK).alias("block"))
        up = below.groupBy("tree", "block").applyInPandas(_tops, NODES)
        out.append(staged(up, f"merkle-storey{len(out)}"))
    return out


# --------------------------------------------------------------- downwards


def _block_steps(nodes: pd.DataFrame, above: pd.DataFrame) -> tuple[pd.DataFrame, list[list[Parent]], list[tuple[Parent, int]]]:
    """A block in order, its parents, and the way from its top to the root."""
    nodes = nodes.sort_values("pos")
    parents = block_parents(nodes["digest"].tolist(), int(nodes["total"].iloc[0]))
    way = [(Parent(list(s["run"])), int(s["slot"])) for s in above["steps"].iloc[0]]
    return nodes, parents, way


def _way(parents: list[list[Parent]], at: int) -> Iterator[tuple[Parent, int]]:
    for row in parents:
        yield row[at // FANOUT], at % FANOUT
        at //= FANOUT


def _steps(nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
    nodes, parents, way = _block_steps(nodes, above)
    steps = [
        [{"slot": slot, "run": parent.children} for parent, slot in [*_way(parents, at), *way]] for at in range(len(nodes))
    ]
    return pd.DataFrame({"tree": nodes["tree"], "pos": nodes["pos"], "steps": steps})


def _cogrouped(nodes: DataFrame, above: DataFrame):
    """Blocks of ``nodes`` beside the row of their top in ``above``."""
    blocks = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK)).groupBy("tree", "block")
    return blocks.cogroup(above.withColumnRenamed("pos", "block").groupBy("tree", "block"))


def ways(levels: list[DataFrame], top: DataFrame, lowest: int) -> DataFrame:
    """(tree, pos, steps): the way up of each node of storey ``lowest``.
    ``top`` has the ways of the trees' tops."""
    way = top
    for nodes in reversed(levels[lowest:-1]):
        cells = nodes.select("tree", "pos", "total", "digest")
        way = staged(_cogrouped(cells, way).applyInPandas(_steps, f"tree string, pos long, {STEPS}"), "merkle-ways")
    return way


def _folded(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
    """Leaves of a block folded up to the root, and their proofs' digests."""
    rows, parents, way = _block_steps(rows, above)
    roots, proofs = [], []
    # siblings of the way above the block, once for all leaves
    rest = "".join(parent.siblings(slot) for parent, slot in way).encode()
    for at, digest in enumerate(rows["replacement"]):
        proof = hashlib.sha256()
        for parent, slot in _way(parents, at):
            proof.update(parent.siblings(slot).encode())
            digest = parent.folded(slot, digest)
        for parent, slot in way:
            digest = parent.folded(slot, digest)
        proof.update(rest)
        roots.append(digest)
        proofs.append(proof.hexdigest())
    return pd.DataFrame(
        {"doc_id": rows["doc_id"], "tree": rows["tree"], "leaf": rows["digest"], "proof_sha256": proofs, "folded_root": roots}
    )


def manifest(leaf_rows: DataFrame) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """(storeys of the trees, rows (tree, subroot, root), ways of the subroots)."""
    levels = storeys(leaf_rows.select("tree", "pos", "total", F.col("leaf").alias("digest")))
    subroots = levels[-1].select(F.lit("root").alias("forest"), "tree", F.col("digest").alias("subroot"))
    ranked = _ranked(subroots, [F.col("tree")], "forest", "merkle-subroots")
    forest = storeys(ranked.select(F.col("forest").alias("tree"), "pos", "total", F.col("subroot").alias("digest")))
    start = leaf_rows.sparkSession.createDataFrame([("root", 0, [])], f"tree string, pos long, {STEPS}")
    way = ways(forest, start, 0).select("pos", "steps")
    tops = ranked.join(way, "pos").select("tree", F.lit(0).cast("long").alias("pos"), "steps")
    top = forest[-1].select(F.col("tree").alias("forest"), F.col("digest").alias("root"))
    return levels, ranked.join(top, "forest").select("tree", "subroot", "root"), tops


def folded(docs: DataFrame, replaced: Column | None = None, where: Column | None = None) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, proof_sha256 (all of ``docs`` as they are),
    folded_root (with its replacement, if ``where`` selects it) and verified."""
    rows = leaves(docs, replaced, where)
    levels, roots, tops = manifest(rows)
    # ids travel as text: pandas has no integer column with nulls
    cells = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "tree", "pos", "total", F.col("leaf").alias("digest"), "replacement")
    done = _cogrouped(cells, ways(levels, tops, 1)).applyInPandas(
        _folded, "doc_id string, tree string, leaf string, proof_sha256 string, folded_root string"
    )
    return done.join(roots, "tree").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        "proof_sha256",
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def tamper_check(docs: DataFrame) -> DataFrame:
    """``folded`` where every document whose id has a crc32 that 3 divides (a null id counts
    as the text '') gets the A-Z of its text lower-cased."""
    return folded(docs, F.translate("text", UPPER, LOWER), crc_mod(F.col("doc_id"), 3) == 0)
