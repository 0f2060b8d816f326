"""Window semantics without one task per group.

A plain window sends a whole partition to one task. Where a group can hold a large part of
the table, the same result comes from an aggregate that combines map-side and is joined back,
or from a window over pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equipoise.functions.dates import wall_micros
from equipoise.functions.numbers import round_div
from equipoise.operators.keyed import attach
from equipoise.session import cut_lineage


def first_per_group(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """QUALIFY ROW_NUMBER() OVER (PARTITION BY by ORDER BY order) = 1, ascending, NULLs last.

    ``order`` must be total within a group.
    """
    rest = [c for c in df.columns if c not in by]
    kept = df.groupBy(*by).agg(F.min_by(F.struct(*rest), _rank(order)).alias("_row"))
    return kept.select(*[F.col(c) if c in by else F.col("_row")[c].alias(c) for c in df.columns])


def qualify_top(df: DataFrame, by: list[str], order: list[Column], n: int, rank=F.row_number) -> DataFrame:
    """QUALIFY rank() <= n. The planner cuts every group to n rows before the shuffle."""
    ranked = df.withColumn("_rank", rank().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def add_group_values(df: DataFrame, by: list[str], **aggregates: Column) -> DataFrame:
    """Aggregates OVER (PARTITION BY by) added to every row."""
    totals = df.groupBy(*by).agg(*[agg.alias(name) for name, agg in aggregates.items()])
    return attach(df, totals, by)


def _rank(order: list[str]) -> Column:
    """Ordering value for min_by and max_by: ascending, NULLs last."""
    return F.struct(*[part for c in order for part in (F.col(c).isNull().alias(f"_{c}"), F.col(c))])


def first_in(value: str, order: list[str]) -> Column:
    """Aggregate form of FIRST_VALUE over a whole group."""
    return F.min_by(value, _rank(order))


def last_in(value: str, order: list[str]) -> Column:
    """Aggregate form of LAST_VALUE with the full frame."""
    return F.max_by(value, _rank(order))


def first_value(df: DataFrame, by: list[str], value: str, order: list[str], name: str) -> DataFrame:
    """FIRST_VALUE added to every row. Several values of one grouping: one ``add_group_values``."""
    return add_group_values(df, by, **{name: first_in(value, order)})


def last_value(df: DataFrame, by: list[str], value: str, order: list[str], name: str) -> DataFrame:
    """LAST_VALUE with the full frame added to every row."""
    return add_group_values(df, by, **{name: last_in(value, order)})


def nth_in_group(df: DataFrame, by: list[str], value: str, order: list[Column], n: int, name: str) -> DataFrame:
    """One row per group that has an n-th row: its value. Groups are cut to n rows before the shuffle."""
    numbered = df.select(*by, value, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).alias("_n"))
    return numbered.where(F.col("_n") <= n).where(F.col("_n") == n).select(*by, F.col(value).alias(name))


def nth_value(df: DataFrame, by: list[str], value: str, order: list[Column], n: int, name: str) -> DataFrame:
    """NTH_VALUE with the full frame; a group with fewer than n rows gives NULL."""
    return attach(df, nth_in_group(df, by, value, order, n, name), by, "left")


def ratio_over(value: Column, window) -> Column:
    """RATIO_TO_REPORT as a plain window, for groups of known small size (rows of a report)."""
    number = value.cast("double")
    return F.try_divide(number, F.nullif(F.sum(number).over(window), F.lit(0.0)))


def ratio_to_report(df: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
    """Share of the group total as DOUBLE; a zero total gives NULL.

    Pass whole cents, so the float sum is exact in any order and the share is the same on
    every run.
    """
    valued = df.withColumn("_v", value.cast("double"))
    totals = add_group_values(valued, by, _t=F.sum("_v"))
    return totals.withColumn(name, F.try_divide("_v", F.nullif("_t", F.lit(0.0)))).drop("_v", "_t")


def exact_ratio_to_report(df: DataFrame, by: list[str], value: str, name: str, scale: int, *, value_type=(14, 2)) -> DataFrame:
    """Share of the group total as DECIMAL, rounded half away from zero at ``scale``."""
    p, s = value_type
    typed = df.withColumn("_v", F.col(value).cast(f"decimal({p},{s})"))
    totals = add_group_values(typed, by, _t=F.sum("_v"))
    share = round_div(F.col("_v"), F.col("_t"), scale, num_type=value_type, den_type=(p + 4, s))
    return totals.withColumn(name, share).drop("_v", "_t")


def rate_breaches(
    df: DataFrame, by: list[str], ts: str, limit: int, *, seconds: int = 60, slice_seconds: int = 3600
) -> DataFrame:
    """Moments at which more than ``limit`` events fell in the last ``seconds`` (both ends included).

    Equal moments are counted first. The window then runs per (key, time slice), each slice
    carrying the tail of the one before it, so a key with most of the events is spread over as
    many tasks as it has slices.
    """
    if slice_seconds < seconds:
        raise ValueError("a slice must be at least as long as the window")
    span, width = seconds * 1_000_000, slice_seconds * 1_000_000
    counted = df.groupBy(*by, ts).agg(F.count(F.lit(1)).alias("_n"))
    instant = isinstance(df.schema[ts].dataType, T.TimestampType)
    micros = F.unix_micros(ts) if instant else wall_micros(F.col(ts))
    own = counted.withColumn("_us", micros).withColumn("_slice", F.floor(F.col("_us") / width))
    reaches_next = F.floor((F.col("_us") + span) / width) > F.col("_slice")
    copies = F.when(reaches_next, F.array(F.col("_slice"), F.col("_slice") + 1)).otherwise(F.array("_slice"))
    sliced = own.select("*", F.explode(copies).alias("_in"))
    window = Window.partitionBy(*by, "_in").orderBy("_us").rangeBetween(-span, Window.currentRow)
    return (
        sliced.withColumn("events_in_window", F.sum("_n").over(window))
        .where((F.col("_in") == F.col("_slice")) & (F.col("events_in_window") > limit))
        .select(*by, ts, "events_in_window", F.col("_n").alias("events_now"))
    )


#: Edges that a round of selection cuts an open segment at, and the accuracy with which they are looked for.
_EDGES, _ACCURACY = 16, 1000


def exact_quantiles(df: DataFrame, by: list[str], value: str, quantiles: Mapping[str, float], *, most: int = 100_000) -> DataFrame:
    """Continuous quantiles per group (linear interpolation), exact, several at once: ``by`` and a column for each name.

    Iterative selection: a round looks for edges in every open segment (an approximate percentile, which
    is combined before its shuffle), counts the values below, on and between them, and keeps the segments
    that hold a wanted rank. Edges follow the values' ranks, so an outlier does not widen a segment, and
    a common value becomes an edge and is done. Segments of at most ``most`` values are then counted
    value by value. Counts decide alone; bad edges would only cost a round. NULL is left out; NaN is
    larger than all else. ``median`` and ``percentile`` keep a group's distinct values in one buffer instead.
    """
    names, at = list(quantiles), list(quantiles.values())
    if not names or any(not 0 <= q <= 1 for q in at):
        raise ValueError("quantiles must be from 0 to 1, one at least")
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    around = sorted({min(1.0, max(0.0, q + d)) for q in at for d in (-2 / _ACCURACY, 2 / _ACCURACY)})
    edges = lambda probabilities: F.array_distinct(F.percentile_approx("_v", probabilities, _ACCURACY))
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), edges(around).alias("_e"))
    position = lambda q: F.lit(float(q)) * (F.col("_n") - 1)
    wanted = [
        F.struct(F.lit(2 * i + up).alias("i"), (F.ceil if up else F.floor)(position(q)).cast("long").alias("r"), (position(q) - F.floor(position(q))).alias("part"))
        for i, q in enumerate(at) for up in (0, 1)
    ]
    cut = cut_lineage(sizes.select(*by, F.when(F.col("_n") > most, F.col("_e")).otherwise(F.array().cast("array<double>")).alias("_e"), F.array(*wanted).alias("_w")))
    keys, found = list(by), []
    while True:
        segment = F.expr("2 * size(filter(_e, e -> e < _v)) + int(array_contains(_e, _v))")
        placed = attach(rows, cut.select(*keys, "_e"), keys).withColumn("_s", segment).drop("_e")
        counts = placed.groupBy(*keys, "_s").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        before = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
        ranked = attach(counts.withColumn("_b", F.coalesce(F.sum("_c").over(before), F.lit(0))), cut.select(*keys, "_w"), keys)
        inside = F.expr("transform(filter(_w, w -> w.r >= _b and w.r < _b + _c), w -> struct(w.i, w.r - _b as r, w.part))")
        held = cut_lineage(ranked.withColumn("_w", inside).where("size(_w) > 0").select(*keys, "_s", "_c", "_lo", "_hi", "_w"))
        found.append(held.where("_lo <=> _hi").select(*by, F.explode("_w").alias("w"), F.col("_lo").alias("_v")))
        widest = held.where("not (_lo <=> _hi)").agg(F.max("_c")).first()[0]
        if widest is None:
            break
        fresh = f"_s{len(keys) - len(by)}"
        open_ = held.where("not (_lo <=> _hi)").withColumnRenamed("_s", fresh)
        keys = [*keys, fresh]
        rows = attach(placed.withColumnRenamed("_s", fresh), open_.select(*keys), keys)
        if widest <= most:
            counted = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
            before = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
            ranked = attach(counted.withColumn("_b", F.coalesce(F.sum("_c").over(before), F.lit(0))), open_.select(*keys, "_w"), keys)
            found.append(ranked.select(*by, F.explode(F.expr("filter(_w, w -> w.r >= _b and w.r < _b + _c)")).alias("w"), "_v"))
            break
        rows = cut_lineage(rows)
        grid = [k / (_EDGES + 1) for k in range(1, _EDGES + 1)]
        cut = cut_lineage(attach(rows.groupBy(*keys).agg(edges(grid).alias("_e")), open_.select(*keys, "_w"), keys))
    ends = reduce(DataFrame.unionByName, found).groupBy(*by).agg(
        *[F.max(F.when(F.col("w.i") == j, F.col("_v"))).alias(f"_{j}") for j in range(2 * len(at))],
        *[F.max(F.when(F.col("w.i") == 2 * i, F.col("w.part"))).alias(f"_p{i}") for i in range(len(at))],
    )
    low, high, part = (lambda i: F.col(f"_{2 * i}")), (lambda i: F.col(f"_{2 * i + 1}")), (lambda i: F.col(f"_p{i}"))
    return ends.select(*by, *[(low(i) + F.when(part(i) > 0, (high(i) - low(i)) * part(i)).otherwise(0.0)).alias(n) for i, n in enumerate(names)])


def exact_quantile(df: DataFrame, by: list[str], value: str, q: float) -> DataFrame:
    """One continuous quantile per group, as ``<value>_quantile``."""
    return exact_quantiles(df, by, value, {f"{value}_quantile": q})
