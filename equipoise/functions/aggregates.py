"""Aggregates. Each one combines map-side, so a group holding most of the rows is reduced
before it is shuffled."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equipoise.functions.ordering import descending


def listagg_distinct(value: Column, separator: str = ",") -> Column:
    """Distinct values in order; a group without values gives ''."""
    return F.coalesce(F.array_join(F.sort_array(F.collect_set(value)), separator), F.lit(""))


def listagg(value: Column, order: Column, separator: str = ",") -> Column:
    """All values in ``order``; NULLs are skipped, a group without values gives ''."""
    return F.coalesce(F.array_join(_ordered(value, order), separator), F.lit(""))


def array_agg_json(value: Column, order: Column) -> Column:
    """Ordered array as JSON text; NULLs are dropped, a group without values gives '[]'."""
    return F.to_json(_ordered(value, order))


def array_agg_distinct_json(value: Column) -> Column:
    return F.to_json(F.sort_array(F.collect_set(value)))


def _ordered(value: Column, order: Column) -> Column:
    pairs = F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v"))))
    return F.transform(F.array_sort(pairs), lambda p: p["v"])


def max_if(condition: Column, value: Column) -> Column:
    return F.max(F.when(condition, value))


def surplus_keys(df: DataFrame, *keys: str) -> DataFrame:
    """One row: how many rows are surplus to one per key."""
    repeated = df.groupBy(*keys).count().where("count > 1")
    return repeated.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("surplus"))


def row_digest(columns: list[Column]) -> Column:
    """MD5 of a row: each value's text with its length before it, ``-`` for NULL; equal in every engine that has the texts."""
    texts = [c.cast("string") for c in columns]
    return F.md5(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def _content(digest: Column) -> list[Column]:
    """Rows and two sums of 60 bits of their digests. A sum keeps repeated rows apart, which XOR would cancel out."""
    part = lambda at: F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(19,0)")).cast("decimal(38,0)")
    return [F.count(F.lit(1)).alias("n"), part(1).alias("a"), part(16).alias("b")]


def fingerprint(df: DataFrame, *columns: str) -> DataFrame:
    """One row: row_count, and content, which does not depend on order, of the listed columns (all by default).

    Built from MD5 digits and exact sums, so another engine gets the same where it writes values the same way.
    """
    digest = row_digest([F.col(f"`{c}`") for c in (columns or df.columns)])
    text = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    return df.agg(*_content(digest)).select(F.col("n").alias("row_count"), F.concat_ws(":", text("a"), text("b")).alias("content"))


def bucket_tree(df: DataFrame, key: list[str], depth: int = 3) -> DataFrame:
    """The fingerprint of ``df`` as a tree over its keys: level, bucket, n, a, b; an inner bucket is the sum of its 16 children.

    A bucket is the beginning of the key's MD5, so a key is in one bucket of each level whatever the
    table's order or layout. Rows are added up by the deepest level's 16**depth buckets with a map-side
    combine; the levels above are made from those. Trees of a table's parts add up to the table's tree
    (``merged_trees``), so stored trees of unchanged parts need no second scan.
    """
    if not 0 <= depth <= 6:
        raise ValueError("depth must be 0 to 6")
    digest = row_digest([F.col(f"`{c}`") for c in df.columns])
    leaves = df.groupBy(F.substring(row_digest([F.col(f"`{k}`") for k in key]), 1, depth).alias("bucket")).agg(*_content(digest))
    levels = leaves.select(F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"), "bucket", "n", "a", "b")
    return _added(levels.withColumn("bucket", F.expr("substring(bucket, 1, level)")))


def _added(rows: DataFrame) -> DataFrame:
    total = lambda c, kind: F.sum(c).cast(kind).alias(c)
    return rows.groupBy("level", "bucket").agg(total("n", "bigint"), total("a", "decimal(38,0)"), total("b", "decimal(38,0)"))


def merged_trees(*trees: DataFrame) -> DataFrame:
    return _added(reduce(DataFrame.unionByName, trees))


def differing_buckets(left: DataFrame, right: DataFrame) -> DataFrame:
    """Where two trees of one depth differ: level, bucket, rows_left, rows_right. No rows: the tables hold the same rows.

    The trees are added up with opposite signs, so nothing is joined, and a changed row shows in one
    bucket of every level, the deepest of which says which keys to look at.
    """

    def side(tree: DataFrame, sign: int) -> DataFrame:
        signed = [(F.col(c) * sign).alias(c) for c in ("n", "a", "b")]
        return tree.select("level", "bucket", *signed, (F.col("n") if sign > 0 else F.lit(0)).cast("bigint").alias("l"))

    both = side(left, 1).unionByName(side(right, -1)).groupBy("level", "bucket").agg(*[F.sum(c).alias(c) for c in ("n", "a", "b", "l")])
    changed = both.where("n <> 0 or a <> 0 or b <> 0")
    return changed.select("level", "bucket", F.col("l").cast("bigint").alias("rows_left"), (F.col("l") - F.col("n")).cast("bigint").alias("rows_right"))


def most_frequent(df: DataFrame, *columns: str) -> DataFrame:
    """Frequency table, most frequent first, ties by value."""
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(descending("n"), *[F.col(c).asc_nulls_last() for c in columns])
