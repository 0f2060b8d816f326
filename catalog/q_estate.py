"""Estate assessment over metadata and SQL texts derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.planted import PLANTED
from catalog.registry import query
from catalog.shop import table
from equipoise.operators.keyed import attach
from equipoise.operators.windows import first_per_group
from equipoise.plans import estate, governance, textscan
from equipoise.plans.rules import RULES, full_pattern

# Metadata: a part is a table, its order lines are the columns.
_TYPES = ("NUMBER(38,0)", "VARCHAR", "VARIANT", "TIMESTAMP_LTZ", "GEOGRAPHY", "float", "DATE", "HYPERCUBE", "ARRAY", "BOOLEAN", "TIMESTAMP_NTZ", "TEXT")
_PICK_TYPE = "([" + ", ".join(f"'{t}'" for t in _TYPES) + "])[l_suppkey % 12 + 1]"
_TABLES_SQL = """
meta_tables AS (SELECT p_brand AS table_schema, 'T' || (p_partkey % 700) AS table_name, CASE p_partkey % 9 WHEN 0 THEN 'VIEW' WHEN 1 THEN 'EXTERNAL TABLE' WHEN 2 THEN 'MATERIALIZED VIEW' WHEN 3 THEN 'TRANSIENT TABLE' ELSE 'BASE TABLE' END AS table_type,
  p_size * 10 AS row_count, CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE (p_retailprice::DECIMAL(12,2) * 100)::BIGINT * (CASE WHEN p_partkey % 50 = 7 THEN 60000000 ELSE 1000 END) END AS bytes, p_partkey FROM part)
"""
_COLUMNS_SQL = f"""
meta_columns AS (SELECT p_brand AS table_schema, 'T' || (p_partkey % 700) AS table_name, 'c' || l_orderkey AS column_name, l_orderkey AS ordinal_position, {_PICK_TYPE} AS data_type,
  CASE WHEN l_linenumber = 7 AND l_suppkey % 20 = 0 THEN 'YES' ELSE 'NO' END AS is_identity FROM lineitem JOIN part ON p_partkey = l_partkey)
"""


def meta_tables(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr(
        "p_brand as table_schema", "concat('T', p_partkey % 700) as table_name",
        "case p_partkey % 9 when 0 then 'VIEW' when 1 then 'EXTERNAL TABLE' when 2 then 'MATERIALIZED VIEW' when 3 then 'TRANSIENT TABLE' else 'BASE TABLE' end as table_type",
        "p_size * 10 as row_count",
        "if(p_partkey % 31 = 0, null, cast(cast(p_retailprice as decimal(12,2)) * 100 as bigint) * if(p_partkey % 50 = 7, 60000000, 1000)) as bytes",
        "p_partkey",
    )


def meta_columns(spark, sf_dir):
    listed = ", ".join(f"'{t}'" for t in _TYPES)
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.selectExpr(
        "p_brand as table_schema", "concat('T', p_partkey % 700) as table_name", "concat('c', l_orderkey) as column_name",
        "l_orderkey as ordinal_position", f"array({listed})[int(l_suppkey % 12)] as data_type",
        "if(l_linenumber = 7 and l_suppkey % 20 = 0, 'YES', 'NO') as is_identity",
    )


_MAP_SQL = "type_map AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in estate.TYPE_MAP) + ") m(source_type, target_type, class, basis, rule))"
_MAPPED_SQL = f"""
{_MAP_SQL}, {_COLUMNS_SQL},
mapped AS (SELECT c.*, coalesce(m.target_type, 'unknown') AS target_type, coalesce(m.class, 'AGENT_PLUS_REVIEW') AS class, coalesce(m.basis, 'inference') AS basis, coalesce(m.rule, '') AS rule
  FROM meta_columns c LEFT JOIN type_map m ON m.source_type = trim(split_part(upper(trim(c.data_type)), '(', 1)))
"""
_RANK = "CASE class WHEN 'AUTOMATIC' THEN 0 WHEN 'AGENT_PLUS_REVIEW' THEN 1 WHEN 'REDESIGN' THEN 2 ELSE 3 END"


@query("type_map", f"""
WITH {_MAPPED_SQL}
SELECT upper(data_type) AS source_type, target_type, class, basis, rule, count(*) AS columns, count(DISTINCT table_schema || '.' || table_name) AS tables FROM mapped GROUP BY 1, 2, 3, 4, 5""")
def type_map(spark, sf_dir):
    return estate.type_summary(meta_columns(spark, sf_dir))


@query("table_classes", f"""
WITH {_MAPPED_SQL}
SELECT table_schema, table_name, (['AUTOMATIC', 'AGENT_PLUS_REVIEW', 'REDESIGN', 'NOT_SUPPORTED_TODAY'])[max({_RANK}) + 1] AS class,
  count(*) FILTER (WHERE class <> 'AUTOMATIC') AS flagged_columns FROM mapped GROUP BY 1, 2""")
def table_classes(spark, sf_dir):
    return estate.table_classes(meta_columns(spark, sf_dir))


_VOLUME_SQL = """count(*) FILTER (WHERE table_type <> 'VIEW') AS tables, count(*) FILTER (WHERE table_type = 'VIEW') AS views,
  coalesce(sum(row_count) FILTER (WHERE table_type <> 'VIEW'), 0)::BIGINT AS total_rows, coalesce(sum(bytes) FILTER (WHERE table_type <> 'VIEW'), 0)::BIGINT AS total_bytes,
  coalesce(sum(floor(bytes * 1.52::DOUBLE)) FILTER (WHERE table_type <> 'VIEW'), 0)::BIGINT AS est_parquet_bytes FROM"""


@query("volume_rollup", f"""
WITH {_TABLES_SQL}, own AS (SELECT CASE WHEN p_partkey % 17 <> 0 THEN table_schema END AS table_schema, table_type, row_count, bytes FROM meta_tables)
SELECT table_schema, false AS is_total, {_VOLUME_SQL} own GROUP BY 1 UNION ALL SELECT NULL, true, {_VOLUME_SQL} own""")
def volume_rollup(spark, sf_dir):
    """Per schema, those without one, and the total."""
    return estate.volume(meta_tables(spark, sf_dir).withColumn("table_schema", F.expr("if(p_partkey % 17 <> 0, table_schema, null)")))


@query("largest_tables", f"""
WITH {_TABLES_SQL}, {_MAPPED_SQL},
classes AS (SELECT table_schema, table_name, (['AUTOMATIC', 'AGENT_PLUS_REVIEW', 'REDESIGN', 'NOT_SUPPORTED_TODAY'])[max({_RANK}) + 1] AS class FROM mapped GROUP BY 1, 2),
top AS (SELECT row_number() OVER (ORDER BY coalesce(bytes, 0) DESC, table_schema, table_name) AS position, * FROM meta_tables WHERE table_type <> 'VIEW')
SELECT position, t.table_schema, t.table_name, row_count, bytes, floor(bytes * 1.52::DOUBLE)::BIGINT AS est_parquet_bytes, coalesce(class, '-') AS class
FROM top t LEFT JOIN classes c ON c.table_schema = t.table_schema AND c.table_name = t.table_name WHERE position <= 15""")
def largest_tables(spark, sf_dir):
    top = estate.largest_tables(meta_tables(spark, sf_dir), classes=estate.table_classes(meta_columns(spark, sf_dir)))
    return top.select("position", "table_schema", "table_name", "row_count", "bytes", "est_parquet_bytes", "class")


@query("largest_per_schema", f"WITH {_TABLES_SQL} SELECT table_schema, table_name, bytes FROM meta_tables QUALIFY rank() OVER (PARTITION BY table_schema ORDER BY bytes DESC NULLS FIRST) <= 3")
def largest_per_schema(spark, sf_dir):
    return estate.largest_per_schema(meta_tables(spark, sf_dir)).select("table_schema", "table_name", "bytes")


@query("schema_filter", f"WITH {_TABLES_SQL} SELECT p_partkey, table_schema FROM meta_tables WHERE table_schema IN ('Brand#3', 'Brand#11')")
def schema_filter(spark, sf_dir):
    return estate.in_schemas(meta_tables(spark, sf_dir), ["brand#3", " BRAND#11 "]).select("p_partkey", "table_schema")


_PLAN_SQL = f"""
WITH {_TABLES_SQL}, {_COLUMNS_SQL},
base AS (SELECT * FROM meta_tables WHERE table_type IN ('BASE TABLE', 'TRANSIENT TABLE')),
clash AS (SELECT upper(table_name) AS k, count(*) > 1 AS clash FROM base GROUP BY 1),
listed AS (SELECT table_schema, table_name, count(*) AS n, count(*) FILTER (WHERE data_type IN ('VARIANT', 'ARRAY')) AS j FROM meta_columns GROUP BY 1, 2),
built AS (SELECT DISTINCT 'T' || s_suppkey AS m FROM supplier WHERE s_suppkey % 5 = 0),
src AS (SELECT 'T' || c_custkey AS n, max('raw.t' || c_custkey) AS source, bool_or(c_mktsegment = 'BUILDING') AS pii FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1),
p AS (SELECT b.*, c.clash, l.n AS ncols, coalesce(l.j, 0) AS j, bt.m IS NOT NULL AS is_built, s.source, coalesce(s.pii, false) AS pii,
    floor(b.bytes * 1.52::DOUBLE)::BIGINT AS est, CASE WHEN c.clash THEN lower(b.table_schema) || '_' || lower(b.table_name) ELSE lower(b.table_name) END AS suffix
  FROM base b JOIN clash c ON c.k = upper(b.table_name) LEFT JOIN listed l ON l.table_schema = b.table_schema AND l.table_name = b.table_name
    LEFT JOIN built bt ON bt.m = upper(b.table_name) LEFT JOIN src s ON s.n = upper(b.table_name)),
planned AS (SELECT table_schema, table_name, row_count, bytes, est AS est_parquet_bytes, CASE WHEN is_built THEN 'sf_' ELSE 'raw_' END || suffix AS target_table,
  CASE WHEN is_built THEN 'expected' ELSE 'raw' END || '/' || suffix || CASE WHEN coalesce(est < 5368709120, true) THEN '.parquet' ELSE '/' END AS file_target,
  CASE WHEN is_built THEN 3 WHEN source IS NOT NULL THEN 1 ELSE 2 END AS move_group,
  CASE WHEN is_built THEN 'built by a model' WHEN source IS NOT NULL THEN 'read as ' || source ELSE 'not referenced' END AS why,
  concat_ws('; ', CASE WHEN j > 0 THEN j || ' semi-structured column(s) unload as JSON text' END, CASE WHEN ncols IS NULL THEN 'no column list: check the column order' END,
    CASE WHEN clash AND NOT is_built THEN 'name used in several schemas' END, CASE WHEN NOT coalesce(est < 5368709120, true) THEN 'several files: each one is ingested separately' END,
    CASE WHEN pii THEN 'holds personal data: mask after ingest, no model may read it' END, CASE WHEN is_built THEN 'a model rebuilds it: use it as the answer key only' END) AS notes
FROM p)
"""


@query("move_plan", _PLAN_SQL + "SELECT *, row_number() OVER (ORDER BY move_group, coalesce(bytes, 0), table_schema, table_name, row_count, why) AS position FROM planned")
def move_plan(spark, sf_dir):
    built = table(spark, sf_dir, "supplier").where("s_suppkey % 5 = 0").selectExpr("concat('t', s_suppkey) as model")
    sources = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").selectExpr(
        "'raw' as source", "concat('t', c_custkey) as table_name", "cast(null as string) as identifier", "c_mktsegment = 'BUILDING' as contains_pii"
    )
    return estate.in_move_order(estate.move_plan(meta_tables(spark, sf_dir), meta_columns(spark, sf_dir), built=built, sources=sources))


_ENTRY_SQL = """CASE WHEN data_type IN ('VARIANT', 'ARRAY') THEN 'TO_JSON("' || column_name || '") AS "' || column_name || '"' ELSE '"' || column_name || '"' END"""


@query("copy_text", _PLAN_SQL + f""",
lists AS (SELECT table_schema, table_name, string_agg({_ENTRY_SQL}, ', ' ORDER BY ordinal_position, {_ENTRY_SQL}) AS select_list FROM meta_columns GROUP BY 1, 2)
SELECT table_schema, table_name, md5('COPY INTO @EXPORT/' || file_target || ' FROM (SELECT ' || coalesce(select_list, '*') || ' FROM "WAREHOUSE"."' || table_schema || '"."' || table_name
  || '") FILE_FORMAT = (TYPE = PARQUET) HEADER = TRUE OVERWRITE = TRUE' || CASE WHEN file_target LIKE '%/' THEN ' MAX_FILE_SIZE = 268435456' ELSE ' SINGLE = TRUE MAX_FILE_SIZE = 5368709120' END) AS statement_hash
FROM planned LEFT JOIN lists USING (table_schema, table_name)""")
def copy_text(spark, sf_dir):
    text = estate.copy_text(meta_columns(spark, sf_dir), move_plan(spark, sf_dir), "WAREHOUSE", "EXPORT")
    return text.select("table_schema", "table_name", F.md5("copy_sql").alias("statement_hash"))


_VIEWS_SQL = "views AS (SELECT table_schema, table_name, CASE WHEN p_partkey % 27 = 0 THEN NULL WHEN p_partkey % 18 = 0 THEN 'select initcap(x), iff(a, b, c) from t' ELSE 'select nvl(a, b) -- hash(x)' END AS body, p_partkey % 45 = 0 AS secure FROM meta_tables WHERE table_type = 'VIEW')"


def _inventory(spark, sf_dir):
    tables = first_per_group(meta_tables(spark, sf_dir), ["table_schema", "table_name"], ["p_partkey"])
    views = meta_tables(spark, sf_dir).where("table_type = 'VIEW'")
    views = views.selectExpr(
        "table_schema", "table_name",
        "case when p_partkey % 27 = 0 then null when p_partkey % 18 = 0 then 'select initcap(x), iff(a, b, c) from t' else 'select nvl(a, b) -- hash(x)' end as view_definition",
        "if(p_partkey % 45 = 0, 'YES', 'NO') as is_secure",
    )
    nodes = table(spark, sf_dir, "supplier")
    named = lambda cond: nodes.where(cond).selectExpr("concat('N', s_nationkey) as schema_name", "concat('T', s_suppkey) as name", "s_suppkey")
    return {
        "tables": tables,
        "columns": meta_columns(spark, sf_dir),
        "views": views,
        "iceberg_tables": named("s_suppkey % 11 = 1"),
        "tasks": named("s_suppkey % 2 = 0").selectExpr("schema_name", "name", "if(s_suppkey % 4 = 0, 'CALL x()', 'INSERT INTO t SELECT 1') as definition"),
        "streams": named("s_suppkey % 7 = 0"),
        "procedures": nodes.selectExpr(
            "'P' as procedure_schema", "concat('P', s_suppkey) as procedure_name", "'()' as argument_signature",
            "if(s_suppkey % 5 = 0, 'python', 'SQL') as procedure_language",
            "case s_suppkey % 3 when 0 then 'BEGIN\\n LET x := 1; END' when 1 then 'INSERT INTO t SELECT 1' else null end as procedure_definition",
        ),
        "functions": nodes.selectExpr("'F' as function_schema", "concat('F', s_suppkey) as function_name", "if(s_suppkey % 5 = 0, 'JAVA', 'SQL') as function_language"),
        "sequences": named("s_suppkey % 9 = 0").selectExpr("schema_name as sequence_schema", "name as sequence_name"),
        "stages": named("s_suppkey % 6 = 0").selectExpr("schema_name as stage_schema", "name as stage_name", "if(s_suppkey % 12 = 0, 's3://b', null) as stage_url", "'Internal Named' as stage_type"),
        "file_formats": named("s_suppkey % 13 = 0").selectExpr("schema_name as file_format_schema", "name as file_format_name"),
        "dynamic_tables": named("s_suppkey % 17 = 0"),
        "masking_policies": named("s_suppkey % 19 = 0"),
        "row_access_policies": named("s_suppkey % 23 = 0"),
        "shares": nodes.selectExpr(
            "concat('S', s_suppkey) as name", "if(s_suppkey % 2 = 0, 'INBOUND', 'OUTBOUND') as kind",
            "case s_suppkey % 3 when 0 then 'SNOWFLAKE' when 1 then 'PARTNER' else '' end as owner_account",
        ),
    }


def inventory_items(spark, sf_dir):
    """Every metadata object in its class."""
    meta = _inventory(spark, sf_dir)
    corpus = meta["views"].where("view_definition is not null").selectExpr("concat_ws('.', table_schema, table_name) as path", "'sql' as context", "view_definition as text")
    built = table(spark, sf_dir, "supplier").where("s_suppkey % 25 = 0").selectExpr("concat('t', s_suppkey) as model")
    return estate.classify_inventory(meta, built=built, view_hits=textscan.scan(corpus))


query("inventory_items")(inventory_items)


@query("object_classes", """
WITH s AS (SELECT * FROM supplier), i AS (
  SELECT 'task' AS kind, CASE WHEN s_suppkey % 4 = 0 THEN 'NOT_SUPPORTED_TODAY' ELSE 'AGENT_PLUS_REVIEW' END AS class FROM s WHERE s_suppkey % 2 = 0
  UNION ALL SELECT 'stream', 'REDESIGN' FROM s WHERE s_suppkey % 7 = 0
  UNION ALL SELECT 'procedure', CASE WHEN s_suppkey % 5 = 0 OR s_suppkey % 3 <> 1 THEN 'REDESIGN' ELSE 'AGENT_PLUS_REVIEW' END FROM s
  UNION ALL SELECT 'function', CASE WHEN s_suppkey % 5 = 0 THEN 'REDESIGN' ELSE 'AGENT_PLUS_REVIEW' END FROM s
  UNION ALL SELECT 'sequence', 'NOT_SUPPORTED_TODAY' FROM s WHERE s_suppkey % 9 = 0
  UNION ALL SELECT 'stage', CASE WHEN s_suppkey % 12 = 0 THEN 'AGENT_PLUS_REVIEW' ELSE 'AUTOMATIC' END FROM s WHERE s_suppkey % 6 = 0
  UNION ALL SELECT 'file format', 'AUTOMATIC' FROM s WHERE s_suppkey % 13 = 0 UNION ALL SELECT 'dynamic table', 'REDESIGN' FROM s WHERE s_suppkey % 17 = 0
  UNION ALL SELECT 'masking policy', 'AGENT_PLUS_REVIEW' FROM s WHERE s_suppkey % 19 = 0 UNION ALL SELECT 'row access policy', 'REDESIGN' FROM s WHERE s_suppkey % 23 = 0
  UNION ALL SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'share (provided)' WHEN s_suppkey % 2 = 0 THEN 'share (inbound)' ELSE 'share (outbound)' END,
    CASE WHEN s_suppkey % 3 = 0 THEN 'AUTOMATIC' ELSE 'NOT_SUPPORTED_TODAY' END FROM s)
SELECT kind, class, count(*) AS n FROM i GROUP BY 1, 2""")
def object_classes(spark, sf_dir):
    meta = _inventory(spark, sf_dir)
    for name in ("tables", "columns", "views"):
        del meta[name]
    return estate.classify_inventory(meta).groupBy("kind", "class").agg(F.count(F.lit(1)).alias("n"))


_RELATION_CLASSES_SQL = f"""
WITH {_TABLES_SQL}, {_MAPPED_SQL},
worst AS (SELECT table_schema, table_name, max({_RANK}) AS r FROM mapped GROUP BY 1, 2),
named AS (SELECT DISTINCT table_schema, table_name, table_type FROM meta_tables),
i AS (SELECT CASE WHEN table_type = 'EXTERNAL TABLE' THEN 'external table' WHEN table_type = 'MATERIALIZED VIEW' THEN 'materialized view' WHEN table_type = 'VIEW' THEN 'view' ELSE 'table' END AS kind,
    CASE WHEN table_type = 'EXTERNAL TABLE' THEN 3 WHEN table_type = 'MATERIALIZED VIEW' THEN 2 WHEN table_type = 'VIEW' THEN 1 ELSE coalesce(r, 0) END AS r
  FROM named LEFT JOIN worst USING (table_schema, table_name))
"""


@query("class_counts", f"""
{_RELATION_CLASSES_SQL}
SELECT class, count(i.r) AS n, round(count(i.r) * 100.0 / (SELECT count(*) FROM i), 1)::DECIMAL(6,1) AS share_pct
FROM (VALUES ('AUTOMATIC', 0), ('AGENT_PLUS_REVIEW', 1), ('REDESIGN', 2), ('NOT_SUPPORTED_TODAY', 3)) c(class, r) LEFT JOIN i ON i.r = c.r GROUP BY 1""")
def class_counts(spark, sf_dir):
    items = estate.classify_inventory(_relations(spark, sf_dir))
    return estate.class_counts(items).withColumn("share_pct", F.col("share_pct").cast("decimal(6,1)"))


@query("kind_counts", f"{_RELATION_CLASSES_SQL} SELECT kind, count(*) AS total, count(*) FILTER (WHERE r >= 2) AS needs_human FROM i GROUP BY 1")
def kind_counts(spark, sf_dir):
    return estate.kind_counts(estate.classify_inventory(_relations(spark, sf_dir)))


def _relations(spark, sf_dir):
    tables = meta_tables(spark, sf_dir).select("table_schema", "table_name", "table_type").distinct()
    return {"tables": tables, "columns": meta_columns(spark, sf_dir).drop("is_identity")}


@query("parity_plan", """
SELECT lang || doc_id AS model, CASE WHEN doc_id % 3 = 0 THEN '<target schema>' ELSE source END || '.' || lang || doc_id AS relation, 'main.sf_' || lang || doc_id AS answer_key,
  CASE WHEN doc_id % 4 <> 0 THEN 'k' || (doc_id % 5) || ',m' END AS key, doc_id % 4 = 0 AS needs_key FROM documents""")
def parity_plan(spark, sf_dir):
    models = table(spark, sf_dir, "documents").selectExpr(
        "concat(lang, doc_id) as model", "if(doc_id % 3 = 0, null, source) as schema_name", "if(doc_id % 4 = 0, null, array(concat('k', doc_id % 5), 'm')) as key"
    )
    return estate.parity_plan(models)


# --------------------------------------------------------------------------- usage

_AS_OF = "2024-01-20 00:00:00"


def _history(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(
        "upper(event_type) as query_type", "cast(value * 100 as bigint) as total_elapsed_time", "concat('u', user_id) as user_name",
        "ts as start_time", "if(event_id % 4 = 0, 'OTHER', 'MAIN') as database_name", "event_id % 97 as session_id",
    )


_HISTORY_SQL = f"h AS (SELECT upper(event_type) AS query_type, trunc(value * 100)::BIGINT AS ms, user_id, ts, event_id % 97 AS session_id FROM events WHERE ts > TIMESTAMP '{_AS_OF}' - INTERVAL 7 DAY AND event_id % 4 <> 0)"


@query("query_history", f"WITH {_HISTORY_SQL} SELECT query_type, count(*) AS queries, round(sum(ms) / 1000.0, 1)::DECIMAL(18,1) AS elapsed_seconds, count(DISTINCT user_id) AS users FROM h GROUP BY 1 ORDER BY queries DESC, query_type LIMIT 3")
def query_history(spark, sf_dir):
    top = estate.queries_by_type(_history(spark, sf_dir), _AS_OF, top=3, database="MAIN")
    return top.withColumn("elapsed_seconds", F.col("elapsed_seconds").cast("decimal(18,1)"))


_SESSIONS_SQL = "s AS (SELECT c_custkey AS session_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'Tableau Desktop' WHEN 'MACHINERY' THEN NULL WHEN 'AUTOMOBILE' THEN 'PythonConnector' ELSE 'Power BI ' || c_mktsegment END AS app FROM customer)"


def _clients(spark, sf_dir):
    sessions = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as session_id",
        "case c_mktsegment when 'BUILDING' then 'Tableau Desktop' when 'MACHINERY' then null when 'AUTOMOBILE' then 'PythonConnector' else concat('Power BI ', c_mktsegment) end as client_application_id",
    )
    return estate.queries_by_client(_history(spark, sf_dir), sessions, _AS_OF, database="MAIN")


query("query_clients", f"WITH {_HISTORY_SQL}, {_SESSIONS_SQL} SELECT coalesce(app, 'unknown') AS client, count(*) AS queries FROM h JOIN s USING (session_id) GROUP BY 1 ORDER BY queries DESC, client LIMIT 20")(_clients)


@query("bi_clients", f"WITH {_HISTORY_SQL}, {_SESSIONS_SQL} SELECT app AS client, count(*) AS queries FROM h JOIN s USING (session_id) WHERE app ILIKE '%tableau%' OR app ILIKE '%power bi%' GROUP BY 1")
def bi_clients(spark, sf_dir):
    return estate.bi_clients(_clients(spark, sf_dir))


# --------------------------------------------------------------------------- SQL texts

# Statements appended to real text, so that prose, pages and dialect constructs all occur.
_SNIPPETS = (
    "select iff(a, 1, 0), nvl(b, 0) from t",
    "select listagg(distinct c, '','') within group (order by c) -- avg(x)",
    "select div0(a, b), /* hash(x) */ avg(p) qualify row_number() over (order by k) = 1",
    "select ''it''''s'' as note, to_varchar(d, ''YYYY''), dateadd(day, 1, d), datediff(day, a, b)",
    "select parse_json(v), flatten(input => v), regexp_substr(s, ''x'') from {# nvl(a) #} t",
    "select initcap(n), uuid_string(), try_to_number(s, 10, 2), decode(a, b, c), concat(a, b) from t",
)
_CORPUS_SQL = "corpus AS (SELECT 'documents/' || doc_id AS path, text || chr(10) || ([" + ", ".join(f"'{s}'" for s in _SNIPPETS) + "])[doc_id % 6 + 1] AS text FROM documents UNION ALL SELECT 'pages/' || page_id, html FROM pages)"


def corpus(spark, sf_dir):
    listed = ", ".join("'" + s.replace("''", "\\'") + "'" for s in _SNIPPETS)
    docs = table(spark, sf_dir, "documents").selectExpr("concat('documents/', doc_id) as path", "'sql' as context", f"concat(text, '\\n', array({listed})[int(doc_id % 6)]) as text")
    return docs.unionByName(table(spark, sf_dir, "pages").selectExpr("concat('pages/', page_id) as path", "'sql' as context", "html as text"))


# Rules made of function names only; the others look around a match, which the checking engine's
# expressions cannot.
_CALLS = [r for r in RULES if r.functions and not r.pattern]
_CALLS_SQL = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"('{r.id}', '{r.name}', '{r.cost}', '(?i){full_pattern(r)}')" for r in _CALLS) + ") r(rule, construct, class, pattern))"
_SPECIAL = r"--[^\n]*|/\*.*?(?:\*/|\z)|\{#.*?(?:#\}|\z)|\$\$.*?(?:\$\$|\z)|''[^'']*(?:''''[^'']*)*''?"
_MASKED_SQL = (
    "masked AS (SELECT path, array_to_string(list_transform(regexp_extract_all(text, '(?s)" + _SPECIAL + "|[^-/{$'']+|.'), lambda s: CASE WHEN regexp_matches(s, '(?s)^(?:--|/\\*|\\{#|\\$\\$|'').*') "
    "THEN regexp_replace(s, '[^\\n]', ' ', 'g') ELSE s END), '') AS code FROM corpus)"
)
_HITS_SQL = f"{_CORPUS_SQL}, {_MASKED_SQL}, {_CALLS_SQL}, hits AS (SELECT path, rule, construct, class, len(regexp_extract_all(code, pattern)) AS n FROM masked, rules WHERE regexp_matches(code, pattern))"


def _call_hits(spark, sf_dir):
    return textscan.scan(corpus(spark, sf_dir), [r.name for r in _CALLS])


query("construct_scan")(lambda spark, sf_dir: textscan.scan(corpus(spark, sf_dir)))


@query("construct_hits", f"WITH {_HITS_SQL} SELECT path, rule, construct, sum(n)::BIGINT AS n FROM hits GROUP BY 1, 2, 3")
def construct_hits(spark, sf_dir):
    return _call_hits(spark, sf_dir).groupBy("path", "rule", "construct").agg(F.count(F.lit(1)).alias("n"))


@query("construct_frequency", f"WITH {_HITS_SQL} SELECT rule, construct, class, sum(n)::BIGINT AS n FROM hits GROUP BY 1, 2, 3")
def construct_frequency(spark, sf_dir):
    return textscan.construct_frequency(_call_hits(spark, sf_dir))


@query("hit_lines", f"""
WITH {_CORPUS_SQL}, {_MASKED_SQL}, {_CALLS_SQL}, lines AS (SELECT path, unnest(string_split(code, chr(10))) AS line, unnest(range(1, len(string_split(code, chr(10))) + 1)) AS line_no FROM masked)
SELECT path, rule, construct, line_no, sum(len(regexp_extract_all(line, pattern)))::BIGINT AS n FROM lines, rules WHERE regexp_matches(line, pattern) GROUP BY 1, 2, 3, 4""")
def hit_lines(spark, sf_dir):
    return _call_hits(spark, sf_dir).groupBy("path", "rule", "construct", F.col("line_no").cast("bigint").alias("line_no")).agg(F.count(F.lit(1)).alias("n"))


_REACH_SQL = f"""own AS (SELECT path, max({_RANK}) AS r, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules FROM hits GROUP BY 1),
calls AS (SELECT DISTINCT doc_id AS caller, doc_id // 7 AS macro FROM documents),
reach(start, node) AS (SELECT caller, macro FROM calls UNION SELECT r.start, c.macro FROM reach r JOIN calls c ON c.caller = r.node),
pushed AS (SELECT 'documents/' || start AS caller, max(r) AS r, string_agg(DISTINCT x, ',' ORDER BY x) AS rules FROM (SELECT start, r, unnest(string_split(rules, ',')) AS x FROM reach JOIN own ON own.path = 'documents/' || node) GROUP BY 1),
texts AS (SELECT c.path, greatest(coalesce(o.r, 0), coalesce(p.r, 0)) AS rank, coalesce(o.rules, '') AS rules, coalesce(p.rules, '') AS macro_rules, coalesce(p.r, 0) > coalesce(o.r, 0) AS raised_by_macro
  FROM corpus c LEFT JOIN own o ON o.path = c.path LEFT JOIN pushed p ON p.caller = c.path)"""
_CLASS_AT = "(['AUTOMATIC', 'AGENT_PLUS_REVIEW', 'REDESIGN', 'NOT_SUPPORTED_TODAY'])[{0} + 1]"


def _calls(spark, sf_dir):
    """Document n calls document n // 7, so calls are several levels deep and the first document calls itself."""
    return table(spark, sf_dir, "documents").selectExpr("concat('documents/', doc_id) as caller", "concat('documents/', doc_id div 7) as macro")


@query("text_classes", f"WITH RECURSIVE {_HITS_SQL}, {_REACH_SQL} SELECT path, {_CLASS_AT.format('rank')} AS class, rules, macro_rules, raised_by_macro FROM texts")
def text_classes(spark, sf_dir):
    return textscan.classify_texts(corpus(spark, sf_dir).select("path"), _call_hits(spark, sf_dir), _calls(spark, sf_dir))


@query("node_classes", f"""
WITH RECURSIVE {_HITS_SQL}, {_REACH_SQL},
n AS (SELECT t.*, CASE d.doc_id % 11 WHEN 0 THEN 'seed' WHEN 1 THEN 'snapshot' ELSE 'model' END AS kind, CASE WHEN d.doc_id % 13 = 2 THEN 'python' ELSE 'sql' END AS language,
  CASE d.doc_id % 3 WHEN 0 THEN 'incremental' WHEN 1 THEN 'table' END AS materialized FROM texts t JOIN documents d ON t.path = 'documents/' || d.doc_id)
SELECT path, kind, CASE WHEN kind <> 'model' THEN 'NOT_SUPPORTED_TODAY' WHEN language = 'python' THEN 'REDESIGN' ELSE {_CLASS_AT.format("greatest(rank, CASE WHEN materialized = 'incremental' THEN 1 ELSE 0 END)")} END AS class,
  CASE WHEN kind <> 'model' THEN kind WHEN language = 'python' THEN 'python model' WHEN coalesce(materialized = 'incremental', false) AND rank < 1 THEN 'incremental' WHEN raised_by_macro THEN 'macro'
    WHEN rules <> '' THEN 'rules' ELSE 'nothing found' END AS because, rules, macro_rules FROM n""")
def node_classes(spark, sf_dir):
    """Documents as the nodes of a project: seeds, snapshots, Python and incremental models among them."""
    nodes = table(spark, sf_dir, "documents").selectExpr(
        "concat('documents/', doc_id) as path", "case doc_id % 11 when 0 then 'seed' when 1 then 'snapshot' else 'model' end as kind",
        "if(doc_id % 13 = 2, 'python', 'sql') as language", "case doc_id % 3 when 0 then 'incremental' when 1 then 'table' end as materialized",
    )
    hits = _call_hits(spark, sf_dir)
    return textscan.classify_nodes(nodes, hits.where("path like 'documents/%'"), _calls(spark, sf_dir))


@query("kind_frequency", """
WITH k AS (SELECT 'test' AS what, CASE WHEN l_linenumber = 1 THEN 'unique' WHEN l_returnflag = 'R' THEN 'accepted_values' ELSE 'not_null' END AS name FROM lineitem
  UNION ALL SELECT 'materialization', coalesce(nullif(CASE o_orderkey % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'incremental' WHEN 2 THEN '' END, ''), 'view') FROM orders)
SELECT what, name, count(*) AS n, row_number() OVER (PARTITION BY what ORDER BY count(*) DESC, name) AS position FROM k GROUP BY 1, 2""")
def kind_frequency(spark, sf_dir):
    tests = table(spark, sf_dir, "lineitem").selectExpr("case when l_linenumber = 1 then 'unique' when l_returnflag = 'R' then 'accepted_values' else 'not_null' end as type")
    models = table(spark, sf_dir, "orders").selectExpr("case o_orderkey % 4 when 0 then 'table' when 1 then 'incremental' when 2 then '' end as materialized")
    return textscan.kind_frequency(tests, models)


_TYPE_NAMES_SQL = ", ".join(f"'{n}'" for n in textscan.TYPE_NAMES)
_ALIAS = "[^a-z0-9_]as[ \\t]+([a-z_][a-z0-9_]*)"


@query("alias_shadow", f"""
WITH corpus AS (SELECT 'documents/' || doc_id AS path, 'select' || chr(10) || ' coalesce(d' || doc_id % 9 || ', 0) as d' || doc_id % 9 || ',' || chr(10) || ' x * d' || doc_id % 7 || ' as y' || chr(10) || 'from t' || chr(10) || text AS text FROM documents),
{_MASKED_SQL}, split AS (SELECT path, regexp_split_to_array(lower(code), '\\r?\\n') AS ls FROM masked),
lines AS (SELECT path, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM split),
blocks AS (SELECT *, sum(regexp_matches(line, '(^|[^a-z0-9_])select([^a-z0-9_]|$)')::INT) OVER (PARTITION BY path ORDER BY pos) AS block FROM lines),
known AS (SELECT path, block, alias, min(pos) AS since FROM (SELECT path, block, pos, unnest(regexp_extract_all(line, '{_ALIAS}', 1)) AS alias FROM blocks) WHERE alias NOT IN ({_TYPE_NAMES_SQL}) GROUP BY 1, 2, 3),
used AS (SELECT DISTINCT path, block, pos, w FROM (SELECT path, block, pos, unnest(regexp_extract_all(regexp_replace(line, '{_ALIAS}', ' ', 'g'), '[a-z0-9_.]+\\(?')) AS w FROM blocks) WHERE regexp_full_match(w, '[a-z_][a-z0-9_]*'))
SELECT u.path, (pos + 1)::INT AS line_no, alias FROM used u JOIN known k ON k.path = u.path AND k.block = u.block AND k.alias = u.w AND u.pos > since""")
def alias_shadow(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").selectExpr(
        "concat('documents/', doc_id) as path", "concat('select\\n coalesce(d', doc_id % 9, ', 0) as d', doc_id % 9, ',\\n x * d', doc_id % 7, ' as y\\nfrom t\\n', text) as text"
    )
    return textscan.alias_shadow(texts)


@query("regex_backslashes", r"""
SELECT 'pages/' || page_id AS path, 2::BIGINT AS line_no, '\\d+' || page_id AS literal FROM pages WHERE page_id % 2 = 0""")
def regex_backslashes(spark, sf_dir):
    texts = table(spark, sf_dir, "pages").selectExpr(
        "concat('pages/', page_id) as path",
        "concat('select 1,\\nregexp_substr(s, \\'', if(page_id % 2 = 0, '\\\\\\\\d+', 'd+'), page_id, '\\') from t\\n', replace(html, '\\'', '')) as text",
    )
    return textscan.regex_backslashes(texts).withColumn("line_no", F.col("line_no").cast("bigint"))


# --------------------------------------------------------------------------- planted truth


def _planted(spark, sf_dir):
    """Every document after the statement that its id picks; ``lines`` says how many lines of it are the statement's."""
    entries = ", ".join(f"named_struct('kind', {_quoted(kind)}, 'text', {_quoted(text)}, 'lines', {text.count(chr(10)) + 1})" for kind, text, _ in PLANTED)
    return table(spark, sf_dir, "documents").selectExpr("concat('documents/', doc_id) as path", "text as own", f"array({entries})[int(doc_id % {len(PLANTED)})] as s").selectExpr(
        "path", "s.kind as context", "concat(s.text, '\\n', own) as text", "s.lines as lines"
    )


def _quoted(text):
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


_EXPECTED = [(no, *hit.rsplit(" ", 1)) for no, (_, _, found) in enumerate(PLANTED) for hit in found]
_CONSTRUCTS = {r.name: (r.id, r.cost) for r in RULES}
_EXPECTED_SQL = ", ".join(f"({no}, '{_CONSTRUCTS[name][0]}', '{name}', '{_CONSTRUCTS[name][1]}', {line})" for no, name, line in _EXPECTED)


@query("planted_constructs", f"""
WITH e(no, rule, construct, class, line_no) AS (VALUES {_EXPECTED_SQL})
SELECT 'documents/' || doc_id AS path, rule, construct, class, line_no::BIGINT AS line_no, count(*) AS n FROM documents JOIN e ON no = doc_id % {len(PLANTED)} GROUP BY ALL""")
def planted_constructs(spark, sf_dir):
    """The hits in statements planted before every document: all 62 constructs, each found where it is and nowhere else."""
    corpus = _planted(spark, sf_dir)
    hits = attach(textscan.scan(corpus), corpus.select("path", "lines"), ["path"]).where("line_no <= lines")
    return hits.groupBy("path", "rule", "construct", "class", F.col("line_no").cast("bigint").alias("line_no")).agg(F.count(F.lit(1)).alias("n"))


_GUARDED = ("clock functions", "random values and sequences")


@query("clock_guard", f"""
WITH e(no, rule, construct, class, line_no) AS (VALUES {_EXPECTED_SQL})
SELECT 'documents/' || doc_id AS path, construct, line_no::BIGINT AS line_no, count(*) AS n FROM documents JOIN e ON no = doc_id % {len(PLANTED)} WHERE construct IN {_GUARDED} GROUP BY ALL""")
def clock_guard(spark, sf_dir):
    """Model texts whose result depends on when or how often they run."""
    corpus = _planted(spark, sf_dir)
    found = attach(governance.unstable_calls(corpus), corpus.select("path", "lines"), ["path"]).where("line_no <= lines")
    return found.groupBy("path", "construct", F.col("line_no").cast("bigint").alias("line_no")).agg(F.count(F.lit(1)).alias("n"))
