"""Row numbers and running sums over a whole table, or over groups of any size, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equipoise.operators.keyed import attach
from equipoise.session import cut_lineage

_ROW, _RANGE = "_equipoise_row", "_equipoise_range"


def _ranged(df: DataFrame, order: Sequence[Column | str], within: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``df`` sorted by range and stored with the number of its range and its place there; and the names of its runs' keys.

    Ranges and places are fixed by storing them. A run is what a group has in one range.
    """
    groups = [f"_equipoise_group_{i}" for i in range(len(within))]
    keyed = df.select("*", *[F.col(f"`{c}`").alias(g) for c, g in zip(within, groups, strict=True)])
    sort = [*[F.col(g).asc_nulls_first() for g in groups], *order]
    ranged = keyed.repartitionByRange(*sort).sortWithinPartitions(*sort)
    stored = cut_lineage(ranged.withColumn(_ROW, F.monotonically_increasing_id()))
    return stored.withColumn(_RANGE, F.shiftright(_ROW, 33)), [_RANGE, *groups]


def _of_ranges_before(runs: DataFrame, keys: list[str], amount: str) -> Column:
    """The sum of ``amount`` over a group's runs in earlier ranges: a window over no more rows than there are ranges."""
    before = Window.partitionBy(*(keys[1:] or [F.lit(0)])).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(amount).over(before), F.lit(0))


def with_position(df: DataFrame, order: Sequence[Column | str], within: Sequence[str] = (), name: str = "position") -> DataFrame:
    """``df`` with each row's place, counted from 1, in the order of ``order``; with ``within`` in each of its groups.

    The rows are sorted by range and stored, so a range's number and a row's place in it are fixed. A
    group is then at most one run of rows in each range: runs are counted, summed over the ranges before
    and joined back by range and group. So a group that holds most of the rows is spread over as many
    tasks as its share needs. NULL is a group of its own. Rows that are equal in ``order`` take their
    places in no stated order; give a last key that tells them apart. ``df`` is read twice (the ranges
    are sampled), so it should be stored or cheap. A column called ``name`` is replaced.
    """
    kept = [c for c in df.columns if c != name]
    stored, keys = _ranged(df.select(*[F.col(f"`{c}`") for c in kept]), order, within)
    runs = stored.groupBy(*keys).agg(F.min(_ROW).alias("_equipoise_first"), F.count(F.lit(1)).alias("_equipoise_n"))
    offset = _of_ranges_before(runs, keys, "_equipoise_n") - F.col("_equipoise_first") + 1
    # stored, so that its true size decides between a broadcast and a shuffle
    starts = cut_lineage(runs.select(*keys, offset.alias("_equipoise_offset")))
    placed = attach(stored, starts, keys)
    return placed.select(*[F.col(f"`{c}`") for c in kept], (F.col(_ROW) + F.col("_equipoise_offset")).alias(name))


def with_running_sum(df: DataFrame, amount: str, order: Sequence[Column | str], within: Sequence[str] = (), name: str = "running") -> DataFrame:
    """``df`` with the sum of ``amount`` over a row and all rows before it in ``order``; with ``within`` in each of its groups.

    As ``with_position``: a window runs over a group's rows in one range, and what the group has in the
    ranges before is added. NULL amounts count as nothing. Rows equal in ``order`` are added one after
    another in no stated order.
    """
    kept = [c for c in df.columns if c != name]
    stored, keys = _ranged(df.select(*[F.col(f"`{c}`") for c in kept]), order, within)
    runs = stored.groupBy(*keys).agg(F.coalesce(F.sum(amount), F.lit(0)).alias("_equipoise_sum"))
    starts = cut_lineage(runs.select(*keys, _of_ranges_before(runs, keys, "_equipoise_sum").alias("_equipoise_before")))
    own = Window.partitionBy(*keys).orderBy(_ROW).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = stored.withColumn("_equipoise_own", F.coalesce(F.sum(amount).over(own), F.lit(0)))
    placed = attach(summed, starts, keys)
    return placed.select(*[F.col(f"`{c}`") for c in kept], (F.col("_equipoise_own") + F.col("_equipoise_before")).alias(name))
