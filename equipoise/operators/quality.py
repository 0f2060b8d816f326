"""Data-quality checks: each gives the number of failing rows, never the rows.

All single-column checks of a table share one pass over it; every distinct-key check is a
counting aggregate that combines map-side.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equipoise.operators.sets import orphans


@dataclass(frozen=True)
class NotNull:
    column: str

    @property
    def label(self) -> str:
        return f"not_null_{self.column}"

    def fails(self) -> Column:
        return F.col(self.column).isNull()


@dataclass(frozen=True)
class Accepted:
    column: str
    values: tuple

    @property
    def label(self) -> str:
        return f"accepted_values_{self.column}"

    def fails(self) -> Column:
        return F.col(self.column).isNotNull() & ~F.col(self.column).isin(*self.values)


@dataclass(frozen=True)
class Expression:
    """A condition every row must meet; NULL passes."""

    name: str
    condition: Column

    @property
    def label(self) -> str:
        return f"expression_{self.name}"

    def fails(self) -> Column:
        return F.coalesce(~self.condition, F.lit(False))


@dataclass(frozen=True)
class Unique:
    """Failing rows are the values, or combinations of values, that occur more than once."""

    columns: tuple

    @property
    def label(self) -> str:
        return "unique_" + "_".join(self.columns)


@dataclass(frozen=True)
class References:
    column: str
    parent: DataFrame
    parent_column: str

    @property
    def label(self) -> str:
        return f"relationships_{self.column}"


def _result(df: DataFrame, table: str, test: str) -> DataFrame:
    return df.select(F.lit(table).alias("table_name"), F.lit(test).alias("test"), F.col("n").cast("bigint").alias("failing_rows"))


def failing_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keys that occur more than once. NULL is not a value of one column, but it is one in a combination."""
    counted = df.where(F.col(columns[0]).isNotNull()) if len(columns) == 1 else df
    return counted.groupBy(*columns).agg(F.count(F.lit(1)).alias("row_count")).where("row_count > 1")


def check(df: DataFrame, table: str, tests: list) -> DataFrame:
    """(table_name, test, failing_rows) for every test, as one lazy frame."""
    row_tests = [t for t in tests if isinstance(t, (NotNull, Accepted, Expression))]
    parts = []
    if row_tests:
        counts = df.agg(*[F.count_if(t.fails()).alias(f"c{i}") for i, t in enumerate(row_tests)])
        entries = F.array(
            *[F.struct(F.lit(t.label).alias("test"), F.col(f"c{i}").alias("n")) for i, t in enumerate(row_tests)]
        )
        parts.append(
            counts.select(F.inline(entries)).select(
                F.lit(table).alias("table_name"), "test", F.col("n").cast("bigint").alias("failing_rows")
            )
        )
    for test in tests:
        if isinstance(test, Unique):
            parts.append(_result(failing_keys(df, list(test.columns)).agg(F.count(F.lit(1)).alias("n")), table, test.label))
        elif isinstance(test, References):
            missing = orphans(df, test.column, test.parent, test.parent_column)
            parts.append(_result(missing.agg(F.coalesce(F.sum("child_rows"), F.lit(0)).alias("n")), table, test.label))
    return reduce(DataFrame.unionByName, parts)


def count_failures(failing: DataFrame, table: str, test: str) -> DataFrame:
    """Summary row of a hand-written test given as the frame of its failing rows."""
    return _result(failing.agg(F.count(F.lit(1)).alias("n")), table, test)
