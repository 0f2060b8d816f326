"""A Merkle manifest of a dataset: one tree a partition value, one over their roots, and versions by path copying."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equipoise.llm.common import ship
from equipoise.operators.positions import with_position
from equipoise.session import cut_lineage

#: Children of a node.
FANOUT = 8
#: Levels of an aligned block, which is built and changed in one task: 8**4 leaves at most.
HEIGHT = 4
BLOCK = FANOUT**HEIGHT
HEX = 64

NODES = "tree string, position long, digest string"
STEPS = "before array<string>, after array<string>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(columns: Sequence[Column]) -> Column:
    """The digest of a row: each value as ``-`` if null, else its length in UTF-8 bytes, a colon and the value."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def levels_above(n: int) -> int:
    """How many levels stand on ``n`` nodes until one node is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def parents(nodes: list[str]) -> list[str]:
    return [digest("".join(nodes[i : i + FANOUT])) for i in range(0, len(nodes), FANOUT)]


class Block:
    """The nodes of an aligned block of one version, level by level from the bottom."""

    def __init__(self, levels: list[list[str]]):
        self.levels = levels
        self.runs = [["".join(level[i : i + FANOUT]) for i in range(0, len(level), FANOUT)] for level in levels[:-1]]

    @classmethod
    def build(cls, index: int, nodes: list[str]) -> Block:
        """A tree's only block ends where one node is left; every other one has HEIGHT levels, as has a full first one."""
        levels = [nodes]
        for _ in range(HEIGHT if index else levels_above(len(nodes))):
            levels.append(parents(levels[-1]))
        return cls(levels)

    def steps(self, at: int) -> Iterator[tuple[str, str]]:
        """The siblings before and after the node at ``at`` and each of its ancestors, up to the block's root."""
        for runs in self.runs:
            run, begin = runs[at // FANOUT], HEX * (at % FANOUT)
            yield run[:begin], run[begin + HEX :]
            at //= FANOUT


def copies(node: str, steps: Sequence[tuple[str, str]]) -> list[str]:
    """The ancestors that a version with another ``node`` copies, bottom up; all siblings are shared."""
    out = []
    for before, after in steps:
        node = digest(before + node + after)
        out.append(node)
    return out


def _ordered(rows: pa.Table, index: int) -> pa.Table:
    rows = rows.sort_by("position")
    positions = rows["position"].to_pylist()
    if positions != list(range(index * BLOCK, index * BLOCK + len(positions))):
        raise ValueError(f"positions of block {index} have gaps or repeat")
    return rows


def _build(key: tuple, rows: pa.Table) -> pa.Table:
    tree, index = (k.as_py() for k in key)
    block = Block.build(index, _ordered(rows, index)["digest"].to_pylist())
    inner = pa.array([block.levels[1:]], pa.list_(pa.list_(pa.string())))
    return pa.table({"tree": [tree], "position": [index], "digest": [block.levels[-1][0]], "inner": inner})


def climb(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` (tree, position from 0, digest) and above them the roots of blocks, of blocks of blocks, until each tree has one.

    Each round makes one row of BLOCK rows; ``inner`` holds a block's nodes by level. A group is one
    block, so no tree meets in one task. Every round is stored.
    """
    ship(nodes.sparkSession)
    out = [nodes]
    while True:
        dealt = out[-1].select("tree", F.expr(f"position div {BLOCK}").alias("block"), "position", "digest")
        out.append(cut_lineage(dealt.groupBy("tree", "block").applyInArrow(_build, f"{NODES}, inner array<array<string>>")))
        if not out[-1].agg(F.max("position")).first()[0]:
            return out


def _dealt(nodes: DataFrame, blocks: DataFrame):
    return (
        nodes.withColumn("block", F.expr(f"position div {BLOCK}")).groupBy("tree", "block")
        .cogroup(blocks.withColumnRenamed("position", "block").groupBy("tree", "block"))
    )


def _own_steps(key: tuple, nodes: pa.Table, block: pa.Table) -> tuple[pa.Table, list[list[tuple[str, str]]], list[tuple[str, str]]]:
    """The block's nodes in order, each one's steps in the block, and the steps from its root to the tree's."""
    nodes = _ordered(nodes, key[1].as_py())
    tree = Block([nodes["digest"].to_pylist(), *block["inner"][0].as_py()])
    upper = list(zip(block["before"][0].as_py(), block["after"][0].as_py(), strict=True))
    return nodes, [list(tree.steps(i)) for i in range(nodes.num_rows)], upper


def descend(nodes: DataFrame, blocks: DataFrame, given: Sequence[str] = ()) -> DataFrame:
    """``nodes`` with the siblings on their way to the root (``before``, ``after``), from those of the blocks above.

    A block's nodes meet its one row, never a tree's. ``given`` are columns that a node takes from its block.
    """
    own = [f for f in nodes.schema if f.name not in given]

    def walk(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows, lower, upper = _own_steps(key, left, right)
        columns = {f.name: rows[f.name] for f in own}
        for side, name in enumerate(("before", "after")):
            columns[name] = pa.array([[s[side] for s in (*steps, *upper)] for steps in lower], pa.list_(pa.string()))
        return pa.table(columns | {g: pa.array([right[g][0].as_py()] * rows.num_rows, pa.string()) for g in given})

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own), STEPS, *(f"{g} string" for g in given)])
    return _dealt(nodes, blocks).applyInArrow(walk, kinds)


@dataclass(frozen=True)
class Manifest:
    """``levels``: the rows and the block roots above them; ``top``: the same over the trees' roots; ``root``: None without rows."""

    levels: list[DataFrame]
    top: list[DataFrame]
    root: str | None


def manifest(leaves: DataFrame, tree: Column, order: Sequence[Column | str]) -> Manifest:
    """The trees over ``leaves`` (digest and any columns but tree, position, block, inner, before, after, subroot).

    ``tree`` is text and never null; trees are ordered by its bytes. ``order`` ranks the leaves of a tree.
    """
    placed = with_position(leaves.withColumn("tree", tree), order, ["tree"])
    levels = climb(cut_lineage(placed.withColumn("position", F.col("position") - 1)))
    subroots = with_position(levels[-1].drop("position").withColumnRenamed("tree", "name"), ["name"])
    top = climb(cut_lineage(subroots.withColumn("position", F.col("position") - 1).withColumn("tree", F.lit(""))))
    root = top[-1].first()  # one row, or none
    return Manifest(levels, top, root and root["digest"])


def proofs(built: Manifest, changed: str) -> DataFrame:
    """The leaves with ``subroot``, ``proof_sha256``, and the version that each one's ``changed`` digest makes.

    Persistent trees: a version holds new digests of one leaf's ancestors and shares every other node
    with the original. The ancestors in the leaf's block are copied where the block is; the version then
    goes on through the upper levels with the siblings that its block's root has there, which are sent
    to the block once and not to every leaf. ``copied`` has the copies, bottom up (the node at level k
    is number position / 8**k of its level), and ``folded_root`` is the last of them, or the leaf itself
    in a tree of one. Without a changed digest the original one is folded in the same way.
    """
    no_steps = F.array().cast("array<string>")
    above = built.top[-1].withColumn("before", no_steps).withColumn("after", no_steps)
    for nodes in built.top[-2::-1]:
        above = cut_lineage(descend(nodes, above))
    above = above.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("position"), "digest", "inner", "before", "after", F.col("digest").alias("subroot"))
    for nodes in built.levels[-2:0:-1]:
        above = cut_lineage(descend(nodes, above, ["subroot"]))
    leaves = built.levels[0]
    own = list(leaves.schema)

    def fold(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows, lower, upper = _own_steps(key, left, right)
        shared = "".join(b + a for b, a in upper)
        proof = [digest("".join(b + a for b, a in steps) + shared) for steps in lower]
        start = [c or d for c, d in zip(rows[changed].to_pylist(), rows["digest"].to_pylist(), strict=True)]
        copied = [copies(node, [*steps, *upper]) for node, steps in zip(start, lower, strict=True)]
        columns = {f.name: rows[f.name] for f in own}
        columns["subroot"] = pa.array([right["subroot"][0].as_py()] * rows.num_rows, pa.string())
        columns["proof_sha256"] = pa.array(proof, pa.string())
        columns["folded_root"] = pa.array([c[-1] if c else d for c, d in zip(copied, start, strict=True)], pa.string())
        return pa.table(columns | {"copied": pa.array(copied, pa.list_(pa.string()))})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)
    folded = _dealt(leaves, above).applyInArrow(fold, f"{kinds}, subroot string, proof_sha256 string, folded_root string, copied array<string>")
    root = F.lit(built.root).cast("string")
    return folded.withColumn("root", root).withColumn("verified", F.col("folded_root") == root)


def verify_tampering(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, and ``copied``, for every row of documents.

    A tree for each lang (null is one, and comes first), its leaves by doc_id; rows with one doc_id, or
    none (they come first), are ordered by their leaf, and rows alike in every column have equal results
    in some order. Where 3 divides the crc32 of the decimal doc_id, the row is tampered with: A-Z of its
    text become a-z, so without them, or without a text or id, it still verifies. Other columns are
    ignored; an empty table gives no rows.
    """
    text = F.col("text").cast("string")
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    row = lambda body: leaf_digest([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), body])
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    leaves = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("own_tree"),
        row(text).alias("digest"), F.when(tampered, row(lower)).alias("changed"), F.monotonically_increasing_id().alias("row"),
    )
    # texts are read once; ``row`` is fixed by this and parts rows that are alike in everything
    stored = cut_lineage(leaves)
    built = manifest(stored, F.col("own_tree"), [F.col("doc_id").asc_nulls_first(), "digest", "row"])
    return proofs(built, "changed").select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", "verified", "copied")
