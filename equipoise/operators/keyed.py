"""Helpers for joins on keys that may be NULL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def same_key(left: DataFrame, right: DataFrame, keys: list[str], right_keys: list[str] | None = None) -> Column:
    """NULL-safe equality on every key; still an equi-join for the planner."""
    pairs = zip(keys, right_keys or keys)
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[r]) for k, r in pairs])


def attach(df: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Add the columns of ``lookup`` (one row per key) to ``df``, NULL keys included.

    ``df`` is the side that can be skewed; it is the streamed side of an inner or left join, so
    adaptive execution can split a hot key's partition.
    """
    renamed = lookup.select(
        *[F.col(k).alias(f"__{k}") for k in keys], *[c for c in lookup.columns if c not in keys]
    )
    joined = df.join(renamed, same_key(df, renamed, keys, [f"__{k}" for k in keys]), how)
    return joined.drop(*[f"__{k}" for k in keys])
