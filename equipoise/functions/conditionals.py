"""Conditionals and NULL handling.

NVL, IFNULL, NVL2, ZEROIFNULL, NULLIFZERO and EQUAL_NULL already exist in Spark under the same
names with the same results, so they are used directly from ``pyspark.sql.functions``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def iff(condition: Column, then, otherwise) -> Column:
    """A NULL condition takes the else branch."""
    return F.when(condition, _lit(then)).otherwise(_lit(otherwise))


def decode(value: Column, mapping: dict, default=None) -> Column:
    """First matching entry of ``mapping``; a ``None`` entry matches NULL."""
    branches = None
    for search, result in mapping.items():
        hit = value.eqNullSafe(_lit(search))
        branches = F.when(hit, _lit(result)) if branches is None else branches.when(hit, _lit(result))
    return branches.otherwise(_lit(default))


def _all_present(columns) -> Column:
    return reduce(lambda a, b: a & b, [c.isNotNull() for c in columns])


def greatest_strict(*columns: Column) -> Column:
    """NULL as soon as one argument is NULL (``F.greatest`` skips NULLs)."""
    return F.when(_all_present(columns), F.greatest(*columns))


def least_strict(*columns: Column) -> Column:
    return F.when(_all_present(columns), F.least(*columns))


def greatest_ignore_nulls(*columns: Column) -> Column:
    return F.greatest(*columns)


def least_ignore_nulls(*columns: Column) -> Column:
    return F.least(*columns)


def concat_ws_strict(separator: str, *columns: Column) -> Column:
    """NULL as soon as one argument is NULL (``F.concat_ws`` skips NULLs)."""
    parts = [columns[0]]
    for column in columns[1:]:
        parts += [F.lit(separator), column]
    return F.concat(*parts)
