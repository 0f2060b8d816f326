"""Masked views, protected tables, and checks that a model can be rebuilt identically."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equipoise.operators.parity import ParityReport, compare
from equipoise.plans import textscan

MASK = "****"
PII_FLAGS = ("contains_pii", "pii", "is_pii")
BODY_FIELDS = ("view_definition", "procedure_definition", "function_definition", "text", "body")


def mask_full(value: Column) -> Column:
    return F.when(value.isNotNull(), F.lit(MASK))


def mask_partial(value: Column, keep: int = 4) -> Column:
    """All but the last ``keep`` characters starred; shorter values are starred whole."""
    starred = F.regexp_replace(value, f"(?s).(?=.{{{keep}}})", "*")
    return F.when(F.length(value) > keep, starred).otherwise(F.repeat(F.lit("*"), F.length(value)))


def masked(df: DataFrame, policies: dict[str, str]) -> DataFrame:
    """Apply ``{column: "full" | "partial"}``; every other column passes through."""
    rules = {"full": mask_full, "partial": mask_partial}
    return df.withColumns({c: rules[p](F.col(c).cast("string")) for c, p in policies.items()})


def pii_tables(sources: DataFrame) -> DataFrame:
    """Tables whose metadata marks personal data. ``sources``: source, table_name, meta (map)."""
    flag = F.exists(
        F.map_entries("meta"),
        lambda e: F.lower(e["key"]).isin(*PII_FLAGS) & ~F.lower(F.coalesce(e["value"], F.lit(""))).isin("", "false", "0", "no"),
    )
    return sources.where(flag).select("source", "table_name").distinct()


def strip_bodies(df: DataFrame, fields: tuple[str, ...] = BODY_FIELDS) -> DataFrame:
    """Replace SQL bodies with ``<field>_read``: an inventory is not a copy of the source code."""
    for name in [f for f in fields if f in df.columns]:
        df = df.withColumn(f"{name}_read", F.coalesce(F.col(name) != "", F.lit(False))).drop(name)
    return df


def forbidden_reads(corpus: DataFrame, tables: list[str], source_calls: dict[str, list[tuple[str, str]]] | None = None) -> DataFrame:
    """Lines of SQL text that reach a protected table. ``corpus``: path, text.

    A table is reached by its name or by a ``source('s', 't')`` call that resolves to it;
    anything after ``--`` on a line is a comment.
    """
    patterns = [rf"\b{re.escape(t.split('.')[-1])}\b" for t in tables]
    for table in tables:
        for source, name in (source_calls or {}).get(table, []):
            patterns.append(rf"source\s*\(\s*['\"]{re.escape(source)}['\"]\s*,\s*['\"]{re.escape(name)}['\"]\s*\)")
    lines = corpus.select("path", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    code = F.regexp_replace("line", "--.*", "")
    return lines.where(code.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))).select(
        "path", (F.col("at") + 1).alias("line_no")
    )


def unstable_calls(corpus: DataFrame) -> DataFrame:
    """(path, construct, line_no, matched) of clock reads, random values and sequences: what makes two builds of one model differ.

    ``corpus``: path, context, text. Comments, literals and templates do not count.
    """
    found = textscan.scan(corpus, ["clock functions", "random values and sequences"])
    return found.select("path", "construct", "line_no", "matched")


def tests_on_forbidden(tests: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Declared tests that would read a protected source: (source, table_name, test, n), names compared without case.

    ``tests``: source, table_name, test. ``forbidden``: source, table_name.
    """
    folded = forbidden.select(F.lower("source").alias("_s"), F.lower("table_name").alias("_t")).distinct()
    reads = tests.join(folded, (F.lower("source") == F.col("_s")) & (F.lower("table_name") == F.col("_t")), "left_semi")
    return reads.groupBy("source", "table_name", "test").agg(F.count(F.lit(1)).alias("n"))


def rebuild_matches(build, key: list[str]) -> ParityReport:
    """Build a model twice and compare the two results."""
    return compare(build(), build(), key, name="rebuild")
