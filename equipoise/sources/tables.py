"""Scanning, materialising, unloading and ingesting Parquet tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equipoise.operators.sets import delete_insert

FILE_BYTES = 268_435_456
SINGLE_FILE_LIMIT = 5 * 1024**3
TARGET_PREFIX = {"raw": "raw_", "expected": "sf_"}


class ForbiddenTable(PermissionError):
    """A plan asked for a table nobody may read."""


@dataclass(frozen=True)
class Catalog:
    """Resolves source names to Parquet scans; the only way the project reaches a source.

    Forbidden tables are refused here, so no model, test or query can read them by accident.
    """

    spark: SparkSession
    root: str
    schemas: dict[str, str] | None = None
    forbidden: tuple[str, ...] = ()

    def scan(self, name: str) -> DataFrame:
        bare = name.lower().split(".")[-1]
        for table in self.forbidden:
            hidden = table.lower().split(".")[-1]
            if bare in (hidden, *[p + hidden for p in TARGET_PREFIX.values()]):
                raise ForbiddenTable(f"{name} holds protected data and may not be read")
        reader = self.spark.read
        if self.schemas and bare in self.schemas:
            reader = reader.schema(self.schemas[bare])
        return reader.parquet(f"{self.root}/{name}.parquet")


def create_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def write_table(df: DataFrame, path: str, *, partition_by: list[str] | None = None) -> DataFrame:
    """Replace the table at ``path`` wholesale and return a scan of it.

    The scan starts a new lineage from committed files, so a lost executor never recomputes
    what is already written.
    """
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def write_incremental(path: str, new: DataFrame, keys: list[str]) -> tuple[DataFrame, str]:
    """Delete + insert by key into a new folder next to ``path``; returns the scan and its path.

    The old folder is left as it is: readers switch when the caller points them at the new one.
    """
    spark = new.sparkSession
    target = f"{path.rstrip('/')}__{uuid.uuid4().hex}"
    return write_table(delete_insert(spark.read.parquet(path), new, keys), target), target


# --------------------------------------------------------------------------- unload


def encode_semi_structured(df: DataFrame) -> DataFrame:
    """Struct, array, map and variant columns become JSON text; other columns are untouched."""
    nested = (T.StructType, T.ArrayType, T.MapType, T.VariantType)
    return df.select(
        *[
            F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def unload(df: DataFrame, path: str, *, row_bytes: int, estimated_bytes: int | None = None) -> None:
    """Write Parquet, replacing ``path``, in files of about FILE_BYTES by the caller's bytes a row.

    Only a table known to fit one such file goes through one task.
    """
    out = encode_semi_structured(df)
    if estimated_bytes is not None and estimated_bytes <= FILE_BYTES:
        out = out.coalesce(1)
    out.write.mode("overwrite").option("maxRecordsPerFile", max(1, FILE_BYTES // row_bytes)).parquet(path)


# --------------------------------------------------------------------------- ingest


def row_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """(name, row_count) of every frame, as one job."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("name"), "row_count") for n, df in frames.items()]
    return reduce(DataFrame.unionByName, parts)


def ingest(spark: SparkSession, sources: dict[str, str], target_root: str, *, kind: str = "raw", at_once: int = 4) -> DataFrame:
    """Load Parquet files as ``<prefix><name>`` tables and prove the row counts.

    Returns (target, rows_in, rows_out, ok): rows that went into the write against rows read back from
    the written table. Rows are counted while they are written, so a source is read once, and the
    read-back needs file footers alone. Tables are written ``at_once``, since a small one does not fill a cluster.
    """

    def load(name: str, path: str) -> tuple[str, int, DataFrame]:
        target, seen = TARGET_PREFIX[kind] + name, Observation()
        source = spark.read.parquet(path)
        written = write_table(source.observe(seen, F.count(F.lit(1)).alias("rows_in")), f"{target_root}/{target}")
        return target, seen.get.get("rows_in", 0), written

    with ThreadPoolExecutor(max(1, at_once)) as pool:
        jobs = [pool.submit(inheritable_thread_target(spark)(load), name, path) for name, path in sources.items()]
        done = [job.result() for job in jobs]
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows_out")).select(F.lit(target).alias("target"), F.lit(n).cast("bigint").alias("rows_in"), "rows_out")
        for target, n, df in done
    ]
    counted = reduce(DataFrame.unionByName, parts)
    return counted.withColumn("ok", F.col("rows_in") == F.col("rows_out"))


# --------------------------------------------------------------------------- status

_STATUS = "table_schema string, table_name string, row_count bigint, error string"


def relation_status(spark: SparkSession, relations: dict[tuple[str, str], Callable[[], DataFrame]]) -> DataFrame:
    """(table_schema, table_name, row_count, error), counted in one job.

    A relation that cannot be resolved reports its error and does not hide the others. When the
    joint job itself fails, relations are counted one by one.
    """
    frames, failed = {}, []
    for (schema, name), load in relations.items():
        try:
            frames[schema, name] = load().agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(schema).alias("table_schema"), F.lit(name).alias("table_name"), "row_count",
                F.lit(None).cast("string").alias("error"),
            )
        except (PySparkException, OSError) as problem:
            failed.append((schema, name, None, _short(problem)))
    broken = spark.createDataFrame(failed, _STATUS)
    if not frames:
        return broken
    joint = reduce(DataFrame.unionByName, frames.values())
    return joint.unionByName(broken) if failed else joint


def relation_status_checked(spark: SparkSession, relations: dict[tuple[str, str], Callable[[], DataFrame]]) -> DataFrame:
    """``relation_status`` run now; falls back to one count per relation if the joint job fails."""
    try:
        rows = relation_status(spark, relations).collect()
    except PySparkException:
        rows = []
        for key, load in relations.items():
            try:
                rows += relation_status(spark, {key: load}).collect()
            except PySparkException as problem:
                rows.append((*key, None, _short(problem)))
    return spark.createDataFrame(rows, _STATUS)


def _short(problem: Exception) -> str:
    return str(problem).splitlines()[0]


def source_types(spark: SparkSession, frames: dict[str, DataFrame], *, protected: tuple[str, ...] = ()) -> DataFrame:
    """(table_name, position, column_name, data_type, row_count, null_count) of every column; protected tables are left out.

    Types come from the schema, counts from one aggregate a table, whose single row is spread over its columns.
    """
    parts = []
    for name, df in frames.items():
        if name in protected or not df.columns:
            continue
        counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
        rows = [
            F.struct(F.lit(i + 1).alias("position"), F.lit(c).alias("column_name"), F.lit(kind).alias("data_type"), F.col("n").alias("row_count"), (F.col("n") - F.col(f"c{i}")).alias("null_count"))
            for i, (c, kind) in enumerate(df.dtypes)
        ]
        parts.append(counts.select(F.inline(F.array(*rows))).select(F.lit(name).alias("table_name"), "*"))
    if not parts:
        return spark.createDataFrame([], "table_name string, position int, column_name string, data_type string, row_count bigint, null_count bigint")
    return reduce(DataFrame.unionByName, parts)
