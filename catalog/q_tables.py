"""Loading, unloading, status, set operations, governance and closure on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.shop import money, table
from equipoise.operators import sets
from equipoise.plans import closure, governance
from equipoise.session import shared_folder
from equipoise.sources import exports, tables

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
)


@query("ingest_verify", " UNION ALL ".join(
    f"SELECT 'raw_{t}' AS target, count(*) AS rows_in, count(*) AS rows_out, true AS ok FROM {t}" for t in TABLES))
def ingest_verify(spark, sf_dir):
    paths = {t: f"{sf_dir}/{t}.parquet" for t in TABLES}
    return tables.ingest(spark, paths, shared_folder(spark))


@query("unload_roundtrip", """
SELECT event_id, user_id, '{"kind":"' || event_type || '","k":' || (props ->> '$.k') || '}' AS payload, '["' || event_type || '","' || user_id || '"]' AS tags FROM events""")
def unload_roundtrip(spark, sf_dir):
    """Nested columns leave as JSON text and come back as strings."""
    nested = table(spark, sf_dir, "events").select(
        "event_id", "user_id",
        F.struct(F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("int").alias("k")).alias("payload"),
        F.array("event_type", F.col("user_id").cast("string")).alias("tags"),
    )
    path = f"{shared_folder(spark)}/raw_events"
    tables.unload(nested, path, row_bytes=100)
    return spark.read.parquet(path)


@query("relation_status", " UNION ALL ".join(f"SELECT 'main' AS table_schema, '{t}' AS table_name, count(*) AS row_count, NULL::VARCHAR AS error FROM {t}" for t in TABLES))
def relation_status(spark, sf_dir):
    load = lambda t: (lambda: table(spark, sf_dir, t))
    return tables.relation_status(spark, {("main", t): load(t) for t in TABLES})


_COLUMN_KINDS = {
    "orders": {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"},
    "nation": {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"},
    "events": {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"},
}


@query("source_types", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, {i} AS position, '{c}' AS column_name, '{kind}' AS data_type, count(*) AS row_count, count(*) - count({c}) AS null_count FROM {t}"
    for t, columns in _COLUMN_KINDS.items() for i, (c, kind) in enumerate(columns.items(), 1)))
def source_types(spark, sf_dir):
    """Every column with its type, rows and NULLs; a protected table is not described."""
    frames = {t: table(spark, sf_dir, t) for t in (*_COLUMN_KINDS, "customer")}
    return tables.source_types(spark, frames, protected=("customer",))


@query("incremental_upsert", """
WITH new AS (SELECT o_orderkey, o_custkey, o_totalprice::DECIMAL(12,2) + 1 AS price FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'
  UNION ALL SELECT -1 - o_orderkey, o_custkey, 5 FROM orders WHERE o_orderkey % 100 = 3)
SELECT o_orderkey, o_custkey, o_totalprice::DECIMAL(12,2)::DECIMAL(14,2) AS price FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new)
UNION ALL SELECT o_orderkey, o_custkey, price::DECIMAL(14,2) FROM new""")
def incremental_upsert(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    price = money("o_totalprice").cast("decimal(14,2)")
    old = orders.select("o_orderkey", "o_custkey", price.alias("price"))
    recent = orders.where("o_orderdate >= timestamp_ntz '2000-01-01'").select("o_orderkey", "o_custkey", (price + 1).cast("decimal(14,2)").alias("price"))
    added = orders.where("o_orderkey % 100 = 3").selectExpr("-1 - o_orderkey as o_orderkey", "o_custkey", "cast(5 as decimal(14,2)) as price")
    return sets.delete_insert(old, recent.unionByName(added), ["o_orderkey"])


@query("merge_accounts", """
WITH src AS (SELECT c_custkey, c_name, c_acctbal::DECIMAL(12,2) * 2 AS bal, c_acctbal < 0 AS gone FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT c_custkey + 10000000, c_name, 0, false FROM customer WHERE c_custkey % 50 = 1)
SELECT c_custkey, c_name, c_acctbal::DECIMAL(14,2) AS bal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM src)
UNION ALL SELECT c_custkey, c_name, bal::DECIMAL(14,2) FROM src WHERE NOT gone""")
def merge_accounts(spark, sf_dir):
    people = table(spark, sf_dir, "customer")
    target = people.select("c_custkey", "c_name", money("c_acctbal").cast("decimal(14,2)").alias("bal"), F.lit(False).alias("gone"))
    twice = (money("c_acctbal") * 2).cast("decimal(14,2)").alias("bal")
    changed = people.where("c_custkey % 3 = 0").select("c_custkey", "c_name", twice, (F.col("c_acctbal") < 0).alias("gone"))
    fresh = people.where("c_custkey % 50 = 1").selectExpr("c_custkey + 10000000 as c_custkey", "c_name", "cast(0 as decimal(14,2)) as bal", "false as gone")
    return sets.merge(target, changed.unionByName(fresh), ["c_custkey"], delete_when=F.col("gone")).drop("gone")


@query("set_ops", """
WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer), b AS (SELECT DISTINCT user_id AS k FROM events)
SELECT k, 'left' AS side FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'right' FROM b WHERE k NOT IN (SELECT k FROM a)""")
def set_ops(spark, sf_dir):
    buyers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return sets.difference(buyers, table(spark, sf_dir, "events").select(F.col("user_id").alias("k")), ["k"])


@query("orphan_parts", """
SELECT l_partkey, count(*) AS child_rows FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 10) GROUP BY 1""")
def orphan_parts(spark, sf_dir):
    return sets.orphans(table(spark, sf_dir, "lineitem"), "l_partkey", table(spark, sf_dir, "part").where("p_size > 10"), "p_partkey")


_FILES_SQL = r"""
files AS (SELECT CASE WHEN page_id % 2 = 0 THEN 'raw' ELSE 'expected' END AS kind,
  CASE page_id % 5 WHEN 0 THEN upper('t' || page_id) || '.parquet' WHEN 1 THEN 'sf_t' || page_id || '_0_0_0.snappy.parquet' WHEN 2 THEN 'raw_t' || page_id || '.parquet_0_1_0.snappy.parquet'
    WHEN 3 THEN 't' || (page_id // 20) ELSE split_part(url, '/', 3) || '.gz' END AS file_name FROM pages),
stems AS (SELECT *, regexp_extract(lower(file_name), '^(.+?)(?:\.parquet|\.snappy|\.gz|\.zst|\.lzo|\.brotli|_\d+_\d+_\d+)*$', 1) AS s FROM files),
cut AS (SELECT *, CASE WHEN kind = 'raw' AND starts_with(s, 'raw_') AND length(s) > 4 THEN substr(s, 5) WHEN kind = 'expected' AND starts_with(s, 'sf_') AND length(s) > 3 THEN substr(s, 4) ELSE s END AS n FROM stems),
named AS (SELECT kind, file_name, CASE WHEN regexp_full_match(n, '[a-z_][a-z0-9_]*') THEN n || '.parquet' END AS name FROM cut)
"""


def _files(spark, sf_dir):
    return table(spark, sf_dir, "pages").selectExpr(
        "if(page_id % 2 = 0, 'raw', 'expected') as kind",
        "case page_id % 5 when 0 then concat(upper(concat('t', page_id)), '.parquet') when 1 then concat('sf_t', page_id, '_0_0_0.snappy.parquet') "
        "when 2 then concat('raw_t', page_id, '.parquet_0_1_0.snappy.parquet') when 3 then concat('t', page_id div 20) "
        "else concat(split_part(url, '/', 3), '.gz') end as file_name",
    )


@query("export_names", f"""
WITH {_FILES_SQL}
SELECT kind, file_name, name, CASE WHEN name IS NULL THEN 'no table name' WHEN count(*) OVER (PARTITION BY kind, name) > 1 THEN 'name clash' ELSE 'ok' END AS status FROM named""")
def export_names(spark, sf_dir):
    return exports.named_exports(_files(spark, sf_dir))


@query("export_check", f"""
WITH {_FILES_SQL}, present AS (SELECT DISTINCT kind, name FROM named WHERE name IS NOT NULL),
planned AS (SELECT CASE WHEN page_id % 2 = 0 THEN 'raw' ELSE 'expected' END AS kind, 't' || page_id || '.parquet' AS name FROM pages)
SELECT kind, name, 'not planned' AS problem FROM (SELECT * FROM present EXCEPT SELECT * FROM planned) UNION ALL
SELECT kind, name, 'missing' FROM (SELECT * FROM planned EXCEPT SELECT * FROM present)""")
def export_check(spark, sf_dir):
    present = exports.named_exports(_files(spark, sf_dir)).where("name is not null").select("kind", "name")
    planned = table(spark, sf_dir, "pages").selectExpr("if(page_id % 2 = 0, 'raw', 'expected') as kind", "concat('t', page_id, '.parquet') as name")
    return exports.check_exports(present, planned)


@query("masked_view", """
SELECT c_custkey, CASE WHEN length(c_name) > 4 THEN repeat('*', length(c_name)::INTEGER - 4) || right(c_name, 4) ELSE repeat('*', length(c_name)::INTEGER) END AS c_name,
  CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE '****' END AS segment FROM customer""")
def masked_view(spark, sf_dir):
    people = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_name", "nullif(c_mktsegment, 'BUILDING') as segment")
    return governance.masked(people, {"c_name": "partial", "segment": "full"})


@query("masked_texts", "SELECT conv_id, turn, CASE WHEN length(text) > 4 THEN repeat('*', length(text)::INTEGER - 4) || right(text, 4) ELSE repeat('*', length(text)::INTEGER) END AS text FROM conversations")
def masked_texts(spark, sf_dir):
    return governance.masked(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), {"text": "partial"})


@query("pii_tables", """
SELECT DISTINCT lang AS source, source AS table_name FROM documents WHERE doc_id % 40 IN (3, 4)""")
def pii_tables(spark, sf_dir):
    meta = F.when(F.col("doc_id") % 40 == 3, F.create_map(F.lit("Contains_PII"), F.lit("true"))).when(
        F.col("doc_id") % 40 == 4, F.create_map(F.lit("owner"), F.lit("x"), F.lit("pii"), F.lit("yes"))
    ).otherwise(F.create_map(F.lit("contains_pii"), F.lit("false"), F.lit("owner"), F.lit("true")))
    return governance.pii_tables(table(spark, sf_dir, "documents").select(F.col("lang").alias("source"), F.col("source").alias("table_name"), meta.alias("meta")))


@query("strip_bodies", "SELECT doc_id, lang, coalesce(nullif(text, '') <> '', false) AS text_read FROM (SELECT doc_id, lang, CASE WHEN doc_id % 9 = 0 THEN '' WHEN doc_id % 9 = 1 THEN NULL ELSE text END AS text FROM documents)")
def strip_bodies(spark, sf_dir):
    text = F.when(F.col("doc_id") % 9 == 0, "").when(F.col("doc_id") % 9 != 1, F.col("text"))
    return governance.strip_bodies(table(spark, sf_dir, "documents").select("doc_id", "lang", text.alias("text")))


@query("forbidden_reads", r"""
WITH t AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM
  (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN chr(10) || 'select * from raw_customer_contacts' WHEN 1 THEN chr(10) || 'x -- raw_customer_contacts'
    WHEN 2 THEN chr(10) || 'from {{ source( ''raw'' , "customer_contacts") }}' ELSE '' END AS text FROM documents))
SELECT 'documents/' || doc_id AS path, line_no FROM t
WHERE regexp_matches(regexp_replace(line, '--.*', ''), '(?i)\braw_customer_contacts\b|source\s*\(\s*[''"]raw[''"]\s*,\s*[''"]customer_contacts[''"]\s*\)')""")
def forbidden_reads(spark, sf_dir):
    tail = (
        F.when(F.col("doc_id") % 4 == 0, "\nselect * from raw_customer_contacts").when(F.col("doc_id") % 4 == 1, "\nx -- raw_customer_contacts")
        .when(F.col("doc_id") % 4 == 2, "\nfrom {{ source( 'raw' , \"customer_contacts\") }}").otherwise("")
    )
    corpus = table(spark, sf_dir, "documents").select(F.concat(F.lit("documents/"), F.col("doc_id").cast("string")).alias("path"), F.concat("text", tail).alias("text"))
    found = governance.forbidden_reads(corpus, ["main.raw_customer_contacts"], {"main.raw_customer_contacts": [("raw", "customer_contacts")]})
    return found.withColumn("line_no", F.col("line_no").cast("bigint"))


@query("ref_closure", """
WITH RECURSIVE edges AS (
  SELECT 'order:' || o_orderkey AS node, 'customer:' || o_custkey AS parent FROM orders UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation UNION ALL SELECT 'region:' || r_regionkey, 'region:' || r_regionkey FROM region),
reach AS (SELECT 'order:' || o_orderkey AS node, 0 AS depth FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION SELECT e.parent, r.depth + 1 FROM reach r JOIN edges e ON e.node = r.node WHERE r.depth < 4)
SELECT node, min(depth) AS depth FROM reach GROUP BY 1""")
def ref_closure(spark, sf_dir):
    """What urgent orders depend on: customers, their nations, the regions (which refer to themselves)."""
    t = lambda name: table(spark, sf_dir, name)
    edges = (
        t("orders").selectExpr("concat('order:', o_orderkey) as node", "concat('customer:', o_custkey) as parent")
        .unionByName(t("customer").selectExpr("concat('customer:', c_custkey) as node", "concat('nation:', c_nationkey) as parent"))
        .unionByName(t("nation").selectExpr("concat('nation:', n_nationkey) as node", "concat('region:', n_regionkey) as parent"))
        .unionByName(t("region").selectExpr("concat('region:', r_regionkey) as node", "concat('region:', r_regionkey) as parent"))
    )
    start = t("orders").where("o_orderpriority = '1-URGENT'").selectExpr("concat('order:', o_orderkey) as node")
    return closure.upstream(edges, start)
