"""Estate assessment over metadata tables: what is there, what it costs to move, in which order.

Inputs are metadata frames (tables, columns, views, ...) and the SQL-text scan; every result is a
frame. Only the fixed type map is ever broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from equipoise.functions.ordering import descending
from equipoise.operators.keyed import attach
from equipoise.operators.positions import with_position
from equipoise.operators.windows import qualify_top
from equipoise.plans.rules import AUTOMATIC, CLASSES, NAMED_CLASSES, REDESIGN, REVIEW, UNSUPPORTED
from equipoise.plans.textscan import class_of, severity
from equipoise.session import cut_lineage
from equipoise.sources.tables import FILE_BYTES, SINGLE_FILE_LIMIT, TARGET_PREFIX

VERIFIED, INFERENCE = "verified", "inference"
# Measured unload size of seven tables, in bytes: warehouse storage and Parquet.
WAREHOUSE_BYTES, PARQUET_BYTES = 1_631_232, 2_486_443
PARQUET_RATIO = round(PARQUET_BYTES / WAREHOUSE_BYTES, 2)
SEMI_STRUCTURED = ("VARIANT", "OBJECT", "ARRAY")
BASE_TABLE_TYPES = ("BASE TABLE", "TABLE", "TEMPORARY TABLE", "TRANSIENT TABLE")
SCHEMA_COLUMNS = (
    "schema_name", "table_schema", "procedure_schema", "function_schema", "sequence_schema", "stage_schema", "file_format_schema",
)

# Source type -> (target type, class, basis, rule).
TYPE_MAP = (
    ("NUMBER", "DECIMAL(p,s)", AUTOMATIC, VERIFIED, "N1"),
    ("DECIMAL", "DECIMAL(p,s)", AUTOMATIC, VERIFIED, "N1"),
    ("NUMERIC", "DECIMAL(p,s)", AUTOMATIC, VERIFIED, "N1"),
    ("INT", "DECIMAL(38,0)", AUTOMATIC, VERIFIED, "N1"),
    ("INTEGER", "DECIMAL(38,0)", AUTOMATIC, VERIFIED, "N1"),
    ("BIGINT", "DECIMAL(38,0)", AUTOMATIC, VERIFIED, "N1"),
    ("SMALLINT", "DECIMAL(38,0)", AUTOMATIC, VERIFIED, "N1"),
    ("TINYINT", "DECIMAL(38,0)", AUTOMATIC, VERIFIED, "N1"),
    ("BYTEINT", "DECIMAL(38,0)", AUTOMATIC, VERIFIED, "N1"),
    ("FLOAT", "DOUBLE", AUTOMATIC, VERIFIED, "N1"),
    ("FLOAT4", "DOUBLE", AUTOMATIC, VERIFIED, "N1"),
    ("FLOAT8", "DOUBLE", AUTOMATIC, VERIFIED, "N1"),
    ("DOUBLE", "DOUBLE", AUTOMATIC, VERIFIED, "N1"),
    ("DOUBLE PRECISION", "DOUBLE", AUTOMATIC, VERIFIED, "N1"),
    ("REAL", "DOUBLE", AUTOMATIC, VERIFIED, "N1"),
    ("TEXT", "VARCHAR", AUTOMATIC, VERIFIED, ""),
    ("VARCHAR", "VARCHAR", AUTOMATIC, VERIFIED, ""),
    ("CHAR", "VARCHAR", AUTOMATIC, VERIFIED, ""),
    ("CHARACTER", "VARCHAR", AUTOMATIC, VERIFIED, ""),
    ("STRING", "VARCHAR", AUTOMATIC, VERIFIED, ""),
    ("BOOLEAN", "BOOLEAN", AUTOMATIC, VERIFIED, ""),
    ("DATE", "DATE", AUTOMATIC, VERIFIED, ""),
    ("TIME", "TIME", AUTOMATIC, VERIFIED, ""),
    ("BINARY", "BLOB", AUTOMATIC, INFERENCE, ""),
    ("VARBINARY", "BLOB", AUTOMATIC, INFERENCE, ""),
    ("DATETIME", "TIMESTAMP", AUTOMATIC, VERIFIED, "D1"),
    ("TIMESTAMP", "TIMESTAMP", AUTOMATIC, VERIFIED, "D1"),
    ("TIMESTAMP_NTZ", "TIMESTAMP", AUTOMATIC, VERIFIED, "D1"),
    ("TIMESTAMP_LTZ", "TIMESTAMPTZ", REVIEW, VERIFIED, "D1"),
    ("TIMESTAMP_TZ", "TIMESTAMPTZ", REVIEW, VERIFIED, "D1"),
    ("VARIANT", "VARCHAR holding JSON text", REVIEW, VERIFIED, "J0"),
    ("OBJECT", "VARCHAR holding JSON text", REVIEW, VERIFIED, "J0"),
    ("ARRAY", "VARCHAR holding JSON text", REVIEW, VERIFIED, "J0"),
    ("GEOGRAPHY", "none", UNSUPPORTED, INFERENCE, ""),
    ("GEOMETRY", "none", UNSUPPORTED, INFERENCE, ""),
    ("VECTOR", "none", UNSUPPORTED, INFERENCE, ""),
    ("FILE", "none", UNSUPPORTED, INFERENCE, ""),
)
UNKNOWN_TYPE = ("unknown", REVIEW, INFERENCE, "")
# Words that make a procedure body more than one statement.
PROCEDURAL = ("execute immediate", "declare", "begin", " let ", "for ", "while ", "loop", "return ", "call ", "exception")
# Name fragments of BI and SQL clients.
BI_CLIENTS = (
    "tableau", "power bi", "powerbi", "looker", "qlik", "jdbc", "odbc", "excel", "sigma", "thoughtspot", "metabase",
    "superset", "mstr", "microstrategy", "spotfire", "dbeaver", "datagrip", "alteryx", "sisense", "domo", "hex", "mode",
)


def type_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TYPE_MAP, "source_type string, target_type string, class string, basis string, rule string")


def _base_type(data_type: Column) -> Column:
    return F.trim(F.substring_index(F.upper(F.trim(data_type)), "(", 1))


def mapped_columns(columns: DataFrame) -> DataFrame:
    """``columns`` with target_type, class, basis and rule; an unknown type needs a review."""
    known = F.broadcast(type_map(columns.sparkSession).withColumnRenamed("source_type", "_type"))
    joined = columns.join(known, _base_type(F.col("data_type")) == F.col("_type"), "left")
    return joined.withColumns(
        {c: F.coalesce(c, F.lit(v)) for c, v in zip(("target_type", "class", "basis", "rule"), UNKNOWN_TYPE)}
    ).drop("_type")


def type_summary(columns: DataFrame) -> DataFrame:
    """Per source type: target, class, how many columns and distinct tables use it."""
    return (
        mapped_columns(columns)
        .groupBy(F.upper("data_type").alias("source_type"), "target_type", "class", "basis", "rule")
        .agg(F.count(F.lit(1)).alias("columns"), F.count_distinct("table_schema", "table_name").alias("tables"))
    )


def table_classes(columns: DataFrame) -> DataFrame:
    """Worst column class per table."""
    return mapped_columns(columns).groupBy("table_schema", "table_name").agg(
        class_of(F.max(severity(F.col("class")))).alias("class"),
        F.count_if(F.col("class") != AUTOMATIC).alias("flagged_columns"),
    )


def in_schemas(df: DataFrame, schemas: list[str]) -> DataFrame:
    """Keep rows of the given schemas, case-insensitively.

    A frame without a schema column is kept whole: dropping it would hide objects.
    """
    wanted = [s.strip().upper() for s in schemas if s.strip()]
    column = next((c for c in SCHEMA_COLUMNS if c in df.columns), None)
    if not wanted or column is None:
        return df
    return df.where(F.upper(F.col(column)).isin(*wanted))


# --------------------------------------------------------------------------- objects


def _item(df: DataFrame, kind, name: Column, klass, reason, basis=VERIFIED, rule="") -> DataFrame:
    wrap = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.select(
        wrap(kind).alias("kind"), name.alias("name"), wrap(klass).alias("class"), wrap(reason).alias("reason"),
        wrap(basis).alias("basis"), wrap(rule).alias("rule"),
    )


def _name(schema: str, name: str) -> Column:
    return F.concat_ws(".", F.col(schema), F.col(name))


def _optional(df: DataFrame, column: str) -> Column:
    return F.col(column) if column in df.columns else F.lit(None).cast("string")


def _yes(df: DataFrame, column: str) -> Column:
    return F.coalesce(F.upper(_optional(df, column)).isin("YES", "TRUE"), F.lit(False))


def procedural(body: Column) -> Column:
    """True for a scripting body, and for one that cannot be read."""
    flat = F.concat(F.lit(" "), F.regexp_replace(F.lower(body), r"\s+", " "), F.lit(" "))
    return F.coalesce(reduce(lambda a, b: a | b, [flat.contains(m) for m in PROCEDURAL]), F.lit(True)) | (body == "")


def _routines(df: DataFrame, kind: str) -> DataFrame:
    language = F.upper(F.coalesce(_optional(df, f"{kind}_language"), F.lit("")))
    foreign = language.isin("PYTHON", "JAVASCRIPT", "JAVA", "SCALA")
    name = F.concat(_name(f"{kind}_schema", f"{kind}_name"), F.coalesce(_optional(df, "argument_signature"), F.lit("")))
    if kind == "function":
        return _item(
            df, kind, name, F.when(foreign, REDESIGN).otherwise(REVIEW),
            F.when(foreign, "no runtime for the language: rewrite the logic as SQL").otherwise("SQL function: inline it into its callers"),
            F.when(foreign, VERIFIED).otherwise(INFERENCE), F.when(foreign, "F-NOTPORT").otherwise(""),
        )
    body = _optional(df, "procedure_definition")
    scripted = procedural(body)
    reason = (
        F.when(foreign, "no runtime for the language: rewrite the logic as SQL")
        .when(body.isNull() | (body == ""), "body not readable: assumed to be scripting")
        .when(scripted, "scripting control flow: rebuild it outside the procedure")
        .otherwise("single statement: portable, check every caller")
    )
    return _item(df, kind, name, F.when(foreign | scripted, REDESIGN).otherwise(REVIEW), reason, VERIFIED, "F-NOTPORT")


def _relations(meta: dict[str, DataFrame], built: DataFrame | None, view_hits: DataFrame | None) -> DataFrame:
    """Tables and views. Order of the tests matters: built, iceberg, external, materialized, view, table."""
    tables = meta["tables"].withColumn("_key", F.upper("table_name")).withColumn("_type", F.upper(F.coalesce("table_type", F.lit(""))))
    for flag, names in (
        ("_built", built.select(F.upper("model").alias("n")) if built is not None else None),
        ("_iceberg", meta["iceberg_tables"].select(F.upper("name").alias("n")) if "iceberg_tables" in meta else None),
        ("_external", meta["external_tables"].select(F.upper("name").alias("n")) if "external_tables" in meta else None),
        ("_materialized", meta["materialized_views"].select(F.upper("name").alias("n")) if "materialized_views" in meta else None),
    ):
        if names is None:
            tables = tables.withColumn(flag, F.lit(False))
        else:
            marked = names.distinct().withColumn(flag, F.lit(True))
            tables = tables.join(marked, tables["_key"] == marked["n"], "left").drop("n").withColumn(flag, F.coalesce(flag, F.lit(False)))
    if "views" in meta:
        views = meta["views"].select(
            F.col("table_schema").alias("_vs"), F.col("table_name").alias("_vn"), "view_definition", _yes(meta["views"], "is_secure").alias("_secure")
        )
        tables = tables.join(views, (tables["table_schema"] == views["_vs"]) & (tables["table_name"] == views["_vn"]), "left")
    else:
        tables = tables.withColumn("view_definition", F.lit(None).cast("string")).withColumn("_secure", F.lit(False))
    name = _name("table_schema", "table_name")
    if view_hits is not None:
        found = view_hits.where("counts").groupBy(F.col("path").alias("_path")).agg(
            F.max(severity(F.col("class"))).alias("_rank"), F.array_join(F.sort_array(F.collect_set("rule")), ",").alias("_rules")
        )
        tables = tables.join(found, name == found["_path"], "left")
    else:
        tables = tables.withColumn("_rank", F.lit(None).cast("bigint")).withColumn("_rules", F.lit(None).cast("string"))
    classes = table_classes(meta["columns"]).select(
        F.col("table_schema").alias("_cs"), F.col("table_name").alias("_cn"), F.col("class").alias("_columns")
    )
    tables = tables.join(classes, (tables["table_schema"] == classes["_cs"]) & (tables["table_name"] == classes["_cn"]), "left")

    built_c, iceberg = F.col("_built"), F.col("_iceberg")
    external = F.col("_external") | F.col("_type").contains("EXTERNAL")
    materialized = F.col("_materialized") | F.col("_type").contains("MATERIALIZED")
    view = F.col("_type") == "VIEW"
    unread = F.coalesce("view_definition", F.lit("")) == ""
    secure = F.coalesce("_secure", F.lit(False))
    view_rank = F.greatest(
        F.lit(CLASSES.index(REVIEW)), F.coalesce("_rank", F.lit(0)), F.when(secure, CLASSES.index(REDESIGN)).otherwise(0)
    )
    column_class = F.coalesce("_columns", F.lit(AUTOMATIC))
    kind = (
        F.when(built_c & view, "view (built)").when(built_c, "table (built)").when(iceberg, "iceberg table")
        .when(external, "external table").when(materialized, "materialized view").when(view, "view").otherwise("table")
    )
    klass = (
        F.when(built_c, AUTOMATIC).when(iceberg | external, UNSUPPORTED).when(materialized, REDESIGN)
        .when(view, class_of(view_rank)).otherwise(column_class)
    )
    view_reason = F.concat(
        F.when(unread, "definition not readable: assume a port and a review")
        .when(F.col("_rules").isNotNull(), F.concat(F.lit("ported like a model; rules: "), F.col("_rules")))
        .otherwise("ported like a model; no dialect construct found"),
        F.when(secure, "; secure view: redo the protection as masking or row policies").otherwise(""),
    )
    reason = (
        F.when(built_c, "a model builds this relation; its copy is the parity answer key")
        .when(iceberg, "no Iceberg read path").when(external, "no external table read path")
        .when(materialized, "becomes a scheduled table model").when(view, view_reason)
        .when(column_class == UNSUPPORTED, "a column type has no equivalent")
        .when(column_class == REVIEW, "a column type changes shape on the way")
        .otherwise("every column type maps one to one")
    )
    basis = F.when(built_c | iceberg | external, VERIFIED).when(materialized, INFERENCE).when(view, VERIFIED)
    basis = basis.when(column_class == UNSUPPORTED, INFERENCE).otherwise(VERIFIED)
    rule = (
        F.when(built_c | materialized, "").when(iceberg | external, "F-NOREADER").when(view, F.coalesce("_rules", F.lit("")))
        .when(column_class == UNSUPPORTED, "").when(column_class == REVIEW, "F-UNLOAD").otherwise("F-NOREADER")
    )
    return _item(tables, kind, name, klass, reason, basis, rule)


def classify_inventory(meta: dict[str, DataFrame], *, built: DataFrame | None = None, view_hits: DataFrame | None = None) -> DataFrame:
    """items(kind, name, class, reason, basis, rule) for every object in the metadata frames.

    ``built``: model names the project itself builds. ``view_hits``: the text scan of view
    definitions, with path ``schema.view``. Absent metadata frames are simply not there.
    """
    parts = []
    if "tables" in meta:
        parts.append(_relations(meta, built, view_hits))
    if "columns" in meta and "is_identity" in meta["columns"].columns:
        identity = meta["columns"].where(_yes(meta["columns"], "is_identity"))
        parts.append(
            _item(identity, "identity column", F.concat_ws(".", "table_schema", "table_name", "column_name"), UNSUPPORTED,
                  "no generator on the target: new rows need a key strategy", INFERENCE)
        )
    if "procedures" in meta:
        parts.append(_routines(meta["procedures"], "procedure"))
    if "functions" in meta:
        parts.append(_routines(meta["functions"], "function"))
    if "tasks" in meta:
        tasks = meta["tasks"]
        calls = F.lower(F.coalesce("definition", F.lit(""))).contains("call")
        parts.append(
            _item(tasks, "task", _name("schema_name", "name"), F.when(calls, UNSUPPORTED).otherwise(REVIEW),
                  F.when(calls, "calls a procedure, which a schedule cannot do").otherwise("becomes a step of an external schedule"),
                  VERIFIED, "F-NOTPORT")
        )
    for table, kind, klass, reason, basis, rule in (
        ("streams", "stream", REDESIGN, "change capture has to be rebuilt", INFERENCE, ""),
        ("dynamic_tables", "dynamic table", REDESIGN, "becomes a scheduled table model", INFERENCE, ""),
        ("masking_policies", "masking policy", REVIEW, "re-created by an administrator", VERIFIED, "F-MASK-MAIN"),
        ("row_access_policies", "row access policy", REDESIGN, "the predicate is re-expressed and re-tested", VERIFIED, "F-RLS-BREAK"),
    ):
        if table in meta:
            parts.append(_item(meta[table], kind, _name("schema_name", "name"), klass, reason, basis, rule))
    if "stages" in meta:
        stages = meta["stages"]
        url = F.coalesce(_optional(stages, "stage_url"), F.lit(""))
        internal = F.coalesce(F.upper("stage_type").startswith("INTERNAL"), F.lit(False)) & (url == "")
        parts.append(
            _item(stages, "stage", _name("stage_schema", "stage_name"), F.when(internal, AUTOMATIC).otherwise(REVIEW),
                  F.when(internal, "the unload target itself").otherwise("becomes a data source with new credentials"),
                  F.when(internal, VERIFIED).otherwise(INFERENCE), F.when(internal, "F-NOREADER").otherwise(""))
        )
    if "file_formats" in meta:
        parts.append(_item(meta["file_formats"], "file format", _name("file_format_schema", "file_format_name"), AUTOMATIC,
                           "replaced by the ingest format", VERIFIED, "F-INGEST"))
    if "sequences" in meta:
        parts.append(_item(meta["sequences"], "sequence", _name("sequence_schema", "sequence_name"), UNSUPPORTED,
                           "values cannot be reproduced: redesign the key", VERIFIED, "Y2"))
    if "shares" in meta:
        shares = meta["shares"]
        owner = F.upper(F.coalesce(_optional(shares, "owner_account"), F.lit("")))
        provided = (owner == "SNOWFLAKE") | owner.contains("SFC_SAMPLES") | owner.contains("SFSALESSHARED")
        inbound = F.upper(F.coalesce("kind", F.lit(""))) == "INBOUND"
        who = F.when(owner == "", "another account").otherwise(owner)
        parts.append(
            _item(shares, F.when(provided, "share (provided)").when(inbound, "share (inbound)").otherwise("share (outbound)"),
                  F.col("name"), F.when(provided, AUTOMATIC).otherwise(UNSUPPORTED),
                  F.when(provided, "the vendor's own share, nothing to move")
                  .when(inbound, F.concat(F.lit("data of "), who, F.lit(" has to arrive as files")))
                  .otherwise("every consumer needs another route"),
                  F.when(provided, VERIFIED).otherwise(INFERENCE))
        )
    return reduce(DataFrame.unionByName, parts)


def class_counts(items: DataFrame) -> DataFrame:
    """Objects per class with their share in percent; classes without objects are listed."""
    every = items.sparkSession.createDataFrame([(c,) for c in CLASSES], "class string")
    counted = items.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    joined = every.join(counted, "class", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # four rows
    return joined.select("class", "n", F.round(F.coalesce(F.try_divide(F.col("n") * 100, total), F.lit(0.0)), 1).alias("share_pct"))


def kind_counts(items: DataFrame) -> DataFrame:
    """Objects per kind and how many of them need a human, most first."""
    return (
        items.groupBy("kind")
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("class").isin(*NAMED_CLASSES)).alias("needs_human"))
        .orderBy(F.col("total").desc(), "kind")
    )


# --------------------------------------------------------------------------- volume and moves


def parquet_estimate(size: Column, ratio: float = PARQUET_RATIO) -> Column:
    return F.floor(size * F.lit(ratio)).cast("bigint")


def volume(tables: DataFrame, ratio: float = PARQUET_RATIO) -> DataFrame:
    """Per schema and over all: tables, views, rows, bytes and the estimated Parquet size.

    One aggregate over two grouping sets; ``is_total`` marks the row of all schemas, which tells it from
    that of tables without a schema. Without tables there are no rows.
    """
    is_view = F.coalesce(F.upper("table_type") == "VIEW", F.lit(False))
    amount = lambda c: F.coalesce(F.sum(F.when(~is_view, F.coalesce(c, F.lit(0)))), F.lit(0)).cast("bigint")
    return tables.groupingSets([["table_schema"], []], "table_schema").agg(
        (F.grouping("table_schema") == 1).alias("is_total"),
        F.count_if(~is_view).alias("tables"),
        F.count_if(is_view).alias("views"),
        amount(F.col("row_count")).alias("total_rows"),
        amount(F.col("bytes")).alias("total_bytes"),
        amount(parquet_estimate(F.col("bytes"), ratio)).alias("est_parquet_bytes"),
    )


def largest_tables(tables: DataFrame, n: int = 15, *, classes: DataFrame | None = None, ratio: float = PARQUET_RATIO) -> DataFrame:
    """The ``n`` largest tables by bytes with their ``position``, rows, estimate and class (``-`` where ``classes`` has none).

    Of tables with equal bytes and names, that with fewer rows comes first. ``classes``: table_schema, table_name, class.
    """
    kept = tables.where(~F.coalesce(F.upper("table_type") == "VIEW", F.lit(False)))
    order = [F.coalesce("bytes", F.lit(0)).desc(), *[F.col(c).asc_nulls_last() for c in ("table_schema", "table_name", "row_count")]]
    top = with_position(cut_lineage(kept.orderBy(*order).limit(_top(n))), order)
    top = top.withColumn("est_parquet_bytes", parquet_estimate(F.col("bytes"), ratio))
    if classes is None:
        return top.withColumn("class", F.lit("-"))
    named = attach(top, classes.select("table_schema", "table_name", "class"), ["table_schema", "table_name"], "left")
    return named.withColumn("class", F.coalesce("class", F.lit("-")))


def move_plan(
    tables: DataFrame,
    columns: DataFrame,
    *,
    built: DataFrame | None = None,
    sources: DataFrame | None = None,
    ratio: float = PARQUET_RATIO,
    prefix: str = "raw",
) -> DataFrame:
    """One row per base table: target name, order, estimated size, file layout and notes.

    ``built``: model. ``sources``: source, table_name, identifier, contains_pii. Ingest puts all
    tables in one schema, so a name used in several schemas is prefixed with its schema. Tables
    the project reads come first, tables it builds last, then by size and name.
    """
    base = tables.where(F.upper("table_type").isin(*BASE_TABLE_TYPES)).withColumn("_key", F.upper("table_name"))
    repeated = base.groupBy("_key").agg((F.count(F.lit(1)) > 1).alias("_clash"))
    listed = columns.groupBy(F.col("table_schema").alias("_s"), F.col("table_name").alias("_t")).agg(
        F.count(F.lit(1)).alias("column_count"),
        F.count_if(F.upper("data_type").isin(*SEMI_STRUCTURED)).alias("json_columns"),
    )
    plan = base.join(repeated, "_key").join(listed, (F.col("table_schema") == F.col("_s")) & (F.col("table_name") == F.col("_t")), "left")
    if built is not None:
        models = built.select(F.upper("model").alias("_m")).distinct().withColumn("_built", F.lit(True))
        plan = plan.join(models, plan["_key"] == models["_m"], "left")
    else:
        plan = plan.withColumn("_built", F.lit(None).cast("boolean"))
    if sources is not None:
        spelled = sources.select(
            F.explode(F.array_distinct(F.array(F.upper("table_name"), F.upper(F.coalesce("identifier", "table_name"))))).alias("_n"),
            F.concat_ws(".", "source", "table_name").alias("_source"), F.col("contains_pii").alias("_pii"),
        )
        read = spelled.groupBy("_n").agg(F.max("_source").alias("_source"), F.max("_pii").alias("_pii"))
        plan = plan.join(read, plan["_key"] == read["_n"], "left")
    else:
        plan = plan.withColumn("_source", F.lit(None).cast("string")).withColumn("_pii", F.lit(None).cast("boolean"))
    is_built, is_pii = F.coalesce("_built", F.lit(False)), F.coalesce("_pii", F.lit(False))
    suffix = F.when(F.col("_clash"), F.concat_ws("_", F.lower("table_schema"), F.lower("table_name"))).otherwise(F.lower("table_name"))
    folder = F.when(is_built, "expected").otherwise(prefix)
    estimate = parquet_estimate(F.col("bytes"), ratio)
    single = F.coalesce(estimate < SINGLE_FILE_LIMIT, F.lit(True))
    move_group = F.when(is_built, 3).when(F.col("_source").isNotNull(), 1).otherwise(2)
    notes = F.concat_ws(
        "; ",
        F.when(F.col("json_columns") > 0, F.concat(F.col("json_columns").cast("string"), F.lit(" semi-structured column(s) unload as JSON text"))),
        F.when(F.col("column_count").isNull(), "no column list: check the column order"),
        F.when(F.col("_clash") & ~is_built, "name used in several schemas"),
        F.when(~single, "several files: each one is ingested separately"),
        F.when(is_pii, "holds personal data: mask after ingest, no model may read it"),
        F.when(is_built, "a model rebuilds it: use it as the answer key only"),
    )
    return plan.select(
        "table_schema", "table_name", "row_count", "bytes",
        estimate.alias("est_parquet_bytes"),
        F.concat(F.when(is_built, TARGET_PREFIX["expected"]).otherwise(f"{prefix}_"), suffix).alias("target_table"),
        F.concat(folder, F.lit("/"), suffix, F.when(single, ".parquet").otherwise("/")).alias("file_target"),
        move_group.alias("move_group"),
        F.when(is_built, "built by a model").when(F.col("_source").isNotNull(), F.concat(F.lit("read as "), F.col("_source")))
        .otherwise("not referenced").alias("why"),
        notes.alias("notes"),
    )


def in_move_order(plan: DataFrame) -> DataFrame:
    """The plan with each table's ``position`` in the move: by group, then small tables first. Ranges are sorted, never the whole in one task."""
    order = ["move_group", F.coalesce("bytes", F.lit(0)), F.col("table_schema").asc_nulls_last(), F.col("table_name").asc_nulls_last(), "row_count", "why"]
    return with_position(cut_lineage(plan), order)


def _identifier(name) -> Column:
    """A quoted name; quotes inside it are doubled."""
    return F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))


def copy_text(columns: DataFrame, plan: DataFrame, database: str, stage: str) -> DataFrame:
    """COPY statement of every table of a ``move_plan``: its select list in column order, JSON-encoding where needed.

    The target is the plan's, so tables of one name in several schemas do not overwrite each other.
    A folder target is unloaded as several files of bounded size, any other as one. A table without a
    column list is copied as a whole. A column list is bounded by the metadata of one table.
    """
    quoted = _identifier(F.col("column_name"))
    entry = F.when(F.upper("data_type").isin(*SEMI_STRUCTURED), F.concat(F.lit("TO_JSON("), quoted, F.lit(") AS "), quoted)).otherwise(quoted)
    ordered = F.array_sort(F.collect_list(F.struct("ordinal_position", entry.alias("sql"))))
    listed = columns.groupBy("table_schema", "table_name").agg(F.array_join(F.transform(ordered, lambda e: e["sql"]), ", ").alias("select_list"))
    keys = ["table_schema", "table_name"]
    several = F.endswith("file_target", F.lit("/"))
    return plan.select(*keys, "file_target").join(listed, keys, "left").select(
        *keys,
        F.concat(
            F.lit(f"COPY INTO @{stage}/"), F.col("file_target"), F.lit(" FROM (SELECT "), F.coalesce("select_list", F.lit("*")), F.lit(" FROM "),
            F.concat_ws(".", _identifier(F.lit(database)), _identifier(F.col("table_schema")), _identifier(F.col("table_name"))),
            F.lit(") FILE_FORMAT = (TYPE = PARQUET) HEADER = TRUE OVERWRITE = TRUE"),
            F.when(several, f" MAX_FILE_SIZE = {FILE_BYTES}").otherwise(f" SINGLE = TRUE MAX_FILE_SIZE = {SINGLE_FILE_LIMIT}"),
        ).alias("copy_sql"),
    )


def parity_plan(models: DataFrame) -> DataFrame:
    """Parity entry per model (model, schema_name, key): relation, answer key, key or NULL."""
    return models.select(
        "model",
        F.concat_ws(".", F.coalesce("schema_name", F.lit("<target schema>")), F.col("model")).alias("relation"),
        F.concat(F.lit("main.sf_"), F.col("model")).alias("answer_key"),
        F.array_join("key", ",").alias("key"),
        F.coalesce(F.size("key") == 0, F.lit(True)).alias("needs_key"),
    )


# --------------------------------------------------------------------------- usage


def _recent(history: DataFrame, as_of, days: int, database: str | None) -> DataFrame:
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    kept = history.where(F.col("start_time").cast("timestamp_ntz") > cutoff)
    return kept if database is None else kept.where(F.col("database_name") == database)


def _top(n: int) -> int:
    if not 1 <= n <= 200:
        raise ValueError(f"a report has 1 to 200 rows, not {n}")
    return n


def queries_by_type(history: DataFrame, as_of, *, days: int = 7, top: int = 20, database: str | None = None) -> DataFrame:
    """Query count, elapsed seconds and distinct users per type, most frequent first."""
    return (
        _recent(history, as_of, days, database)
        .groupBy("query_type")
        .agg(
            F.count(F.lit(1)).alias("queries"),
            F.round(F.sum("total_elapsed_time") / 1000, 1).alias("elapsed_seconds"),
            F.count_distinct("user_name").alias("users"),
        )
        .orderBy(F.col("queries").desc(), "query_type")
        .limit(_top(top))
    )


def queries_by_client(history: DataFrame, sessions: DataFrame, as_of, *, days: int = 7, top: int = 20, database: str | None = None) -> DataFrame:
    """Queries per client application; sessions are counted before they are looked up."""
    per_session = _recent(history, as_of, days, database).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    named = per_session.join(sessions.select("session_id", "client_application_id"), "session_id")
    return (
        named.groupBy(F.coalesce("client_application_id", F.lit("unknown")).alias("client"))
        .agg(F.sum("n").alias("queries"))
        .orderBy(F.col("queries").desc(), "client")
        .limit(_top(top))
    )


def bi_clients(clients: DataFrame) -> DataFrame:
    """Clients whose name contains a BI or SQL tool marker."""
    return clients.where(F.lower("client").rlike("|".join(BI_CLIENTS)))


def largest_per_schema(tables: DataFrame, n: int = 3) -> DataFrame:
    """The n largest tables of every schema (ties share a rank)."""
    return qualify_top(tables, ["table_schema"], [descending("bytes")], n, rank=F.rank)
