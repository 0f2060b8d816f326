"""Mergeable summaries: distinct counts, quantiles and frequent values, stored by part and added up later.

A sketch has a bounded size whatever it has seen, and sketches of parts merge into that of the whole.
So a day's sketches are written once with the day, and any later question over many days reads them alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of the registers of a distinct-count sketch, the size of a quantile sketch, and the values a frequency sketch tracks.
LG_REGISTERS, QUANTILE_SIZE, TRACKED = 14, 800, 1000

# Stated errors of the sketches at these sizes: three standard errors of a distinct count, relative; of a rank, as a
# share of all rows (99 % of cases have less than half of it); of a count, as a share of all rows.
DISTINCT_ERROR = 3 * 1.04 / 2 ** (LG_REGISTERS / 2)
RANK_ERROR = 2 * 2.296 / QUANTILE_SIZE**0.9021
COUNT_ERROR = 3.5 / 1024


def sketches(df: DataFrame, by: Sequence[str], *, distinct: str, quantile: str, frequent: str) -> DataFrame:
    """Per group: ``n``, and sketches of the distinct values, the quantiles (of a number) and the frequent values of one column each.

    Every task sketches what it reads and only sketches are shuffled. NULL is in none of them.
    """
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.hll_sketch_agg(distinct, LG_REGISTERS).alias("distinct_sketch"),
        F.kll_sketch_agg_double(F.col(quantile).cast("double"), QUANTILE_SIZE).alias("quantile_sketch"),
        F.expr(f"approx_top_k_accumulate(`{frequent}`, {TRACKED})").alias("frequent_sketch"),
    )


def merged(stored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Stored sketches added up to coarser groups; the result can be merged again."""
    return stored.groupBy(*by).agg(
        F.sum("n").cast("bigint").alias("n"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"),
        F.expr(f"approx_top_k_combine(frequent_sketch, {TRACKED})").alias("frequent_sketch"),
    )


def distinct_estimate() -> Column:
    """How many different values there are, at most DISTINCT_ERROR off relative to their number."""
    return F.hll_sketch_estimate("distinct_sketch")


def quantile_estimate(q: float) -> Column:
    """A value whose rank is at most RANK_ERROR of all rows from ``q``."""
    return F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(float(q)))


def frequent_estimate(k: int) -> Column:
    """The ``k`` most frequent values as (item, count), each count at most COUNT_ERROR of all rows off."""
    return F.expr(f"approx_top_k_estimate(frequent_sketch, {int(k)})")
