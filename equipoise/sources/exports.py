"""Names of exported files, and the check of an export against its plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equipoise.operators.sets import only_in

# What an unload appends to a file name, and the prefix ingest adds per kind.
_SUFFIXES = r"(?:\.parquet|\.snappy|\.gz|\.zst|\.lzo|\.brotli|_\d+_\d+_\d+)"
KIND_PREFIX = {"raw": "raw_", "expected": "sf_"}
_VALID = r"^[a-z_][a-z0-9_]*\z"


def export_name(file_name: Column, kind: Column) -> Column:
    """Canonical ``<table>.parquet`` for an exported file, or NULL when no table name is left."""
    stem = F.regexp_extract(F.lower(file_name), rf"^(.+?){_SUFFIXES}*\z", 1)
    for name, prefix in KIND_PREFIX.items():
        redundant = (kind == name) & stem.startswith(prefix) & (F.length(stem) > len(prefix))
        stem = F.when(redundant, F.regexp_replace(stem, f"^{prefix}", "")).otherwise(stem)
    return F.when(stem.rlike(_VALID), F.concat(stem, F.lit(".parquet")))


def named_exports(files: DataFrame) -> DataFrame:
    """``files`` (kind, file_name) with the canonical name and how many files claim it."""
    named = files.withColumn("name", export_name(F.col("file_name"), F.col("kind")))
    claims = named.where(F.col("name").isNotNull()).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("files"))
    return named.join(claims, ["kind", "name"], "left").select(
        "kind",
        "file_name",
        "name",
        F.when(F.col("name").isNull(), "no table name").when(F.col("files") > 1, "name clash").otherwise("ok").alias("status"),
    )


def check_exports(present: DataFrame, planned: DataFrame) -> DataFrame:
    """(kind, name) that arrived but were not planned, or were planned and did not arrive."""
    keys = ["kind", "name"]
    return (
        only_in(present, planned, keys).withColumn("problem", F.lit("not planned"))
        .unionByName(only_in(planned, present, keys).withColumn("problem", F.lit("missing")))
    )
