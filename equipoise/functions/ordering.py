"""NULL order of the source warehouse: last when ascending, first when descending.

Spark's default is the opposite both ways, so no ordering here relies on it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def ascending(column) -> Column:
    return _col(column).asc_nulls_last()


def descending(column) -> Column:
    return _col(column).desc_nulls_first()
