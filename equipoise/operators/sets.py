"""Set differences, replacement of rows by key, and merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equipoise.operators.keyed import same_key


def only_in(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` does not have; NULL keys match NULL keys."""
    a, b = left.select(*keys).distinct(), right.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    return a.join(b, same_key(a, b, keys, [f"__{k}" for k in keys]), "left_anti")


def difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys found on one side only, with the side they are on."""
    return (
        only_in(left, right, keys).withColumn("side", F.lit("left"))
        .unionByName(only_in(right, left, keys).withColumn("side", F.lit("right")))
    )


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child values without a parent, with their row counts; NULL references are allowed.

    Children are counted per value first, so a value that fills much of the table is one row
    by the time it is shuffled.
    """
    used = child.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("child_rows"))
    known = parent.select(F.col(parent_column).alias("__parent")).distinct()
    return used.join(known, used[column] == known["__parent"], "left_anti")


def delete_insert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Incremental build: rows of ``old`` whose key is in ``new`` are replaced by ``new``."""
    arriving = new.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    kept = old.join(arriving, same_key(old, arriving, keys, [f"__{k}" for k in keys]), "left_anti")
    return kept.unionByName(new)


def merge(target: DataFrame, source: DataFrame, keys: list[str], *, delete_when: Column | None = None) -> DataFrame:
    """MERGE by key: matched rows take the source's values, unmatched rows of both sides stay.

    ``source`` has one row per key. ``delete_when`` is a condition on the source columns that
    removes a matched row.
    """
    if delete_when is None:
        return delete_insert(target, source, keys)
    removed = source.where(delete_when).select(*[F.col(k).alias(f"__{k}") for k in keys])
    survivors = target.join(removed, same_key(target, removed, keys, [f"__{k}" for k in keys]), "left_anti")
    return delete_insert(survivors, source.where(~F.coalesce(delete_when, F.lit(False))), keys)
