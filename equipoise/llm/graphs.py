"""Connected components as joins and aggregates, cut to written tables between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equipoise.session import cut_lineage


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node it is linked with) of an undirected graph with columns u, v.

    Large-star and small-star rounds: every node's larger neighbours, then its smaller ones, are tied
    to its smallest neighbour, until nothing changes. Minima are aggregates that are combined before
    the shuffle and joined back, so a node with very many links is never one group in a task. Loops
    and repeated links change nothing; null ends are left out; without links there are no rows.
    """
    edges = edges.filter("u is not null and v is not null and u <> v")
    current = cut_lineage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _mark(current)
    while before[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = cut_lineage(small.unionByName(smallest.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        after = _mark(current)
        if after == before:
            break
        before = after
    roots = current.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
