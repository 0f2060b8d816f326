"""Upstream closure over an edge table, in rounds that double the distance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equipoise.session import cut_lineage

#: Paths are joined where at most so many pairs (those that lead to a node times those that leave it) come of it.
WIDE = 64


def upstream(edges: DataFrame, start: DataFrame, *, of: Sequence[str] = (), max_depth: int | None = None) -> DataFrame:
    """Every node reachable from ``start`` (column node) along ``edges`` (node, parent), with its depth.

    Path doubling: round k has the paths of 2**k steps. What was reached in fewer steps goes on along
    them, so after it all within 2**(k+1) steps is reached, and paths are joined with themselves for the
    next round. A chain of a thousand nodes takes ten rounds. Joining paths through a node that many lead
    to and many leave would give their product, so paths end at such a node; sweeps over the rounds'
    paths then go on from there until single edges reach nothing new, which alone ends the search. So
    cycles end too, and depths are shortest paths. Rows equal in both columns and edges without a parent
    do not count; each round is stored, and what is reached has one row a node. With ``of``, further
    columns of ``start``, every combination of their values has a closure of its own, all of them in the
    same rounds. With ``max_depth`` a deeper closure raises.
    """
    paths = cut_lineage(
        edges.where(F.col("parent").isNotNull()).select(F.col("node").alias("from"), F.col("parent").alias("to")).where("`from` <> `to`").distinct()
    )
    reached = cut_lineage(start.select("node", *of).distinct().withColumn("depth", F.lit(0).cast("long")))
    size, rounds = _size(reached), []
    while True:
        rounds.append(paths)
        reached, now = _further(reached, paths, 1 << (len(rounds) - 1))
        if now == size:
            break
        size = now
        paths = cut_lineage(_joined(paths))
        if paths.isEmpty():
            break
    while True:
        begin = size
        for k, paths in enumerate(rounds):
            reached, size = _further(reached, paths, 1 << k)
            if k == 0 and size == begin:
                deepest = reached.agg(F.max("depth")).first()[0]
                if max_depth is not None and deepest is not None and deepest > max_depth:
                    raise ValueError(f"the closure is {deepest} levels deep, over {max_depth}")
                return reached.select("node", *of, F.col("depth").cast("int").alias("depth"))


def _size(reached: DataFrame) -> tuple:
    """Equal before and after a round only if no node is new and none is nearer."""
    return tuple(reached.agg(F.count("*"), F.sum("depth")).first())


def _further(reached: DataFrame, paths: DataFrame, length: int) -> tuple[DataFrame, tuple]:
    """``reached`` and what lies ``length`` steps on along ``paths``, each node at its smallest depth."""
    own = [c for c in reached.columns if c not in ("node", "depth")]
    on = reached.join(paths, reached["node"] == paths["from"]).select(F.col("to").alias("node"), *own, (F.col("depth") + length).alias("depth"))
    stored = cut_lineage(reached.unionByName(on).groupBy("node", *own).agg(F.min("depth").alias("depth")))
    return stored, _size(stored)


def _joined(paths: DataFrame) -> DataFrame:
    """Paths of twice the length, through nodes that are not wide."""
    arriving = paths.groupBy(F.col("to").alias("via")).agg(F.count("*").alias("n"))
    leaving = paths.groupBy(F.col("from").alias("via")).agg(F.count("*").alias("m"))
    narrow = arriving.join(leaving, "via").where(f"cast(n as decimal(19)) * m <= {WIDE}").select("via")
    first = paths.join(narrow, F.col("to") == F.col("via"), "left_semi").select(F.col("from").alias("begin"), F.col("to").alias("via"))
    return first.join(paths, F.col("via") == F.col("from")).select(F.col("begin").alias("from"), "to").where("`from` <> `to`").distinct()
