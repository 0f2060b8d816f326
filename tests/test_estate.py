"""Classification, move plan and usage on small metadata frames."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from equipoise.plans import estate, textscan
from equipoise.plans.rules import AUTOMATIC, REDESIGN, REVIEW, UNSUPPORTED


def frame(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


@pytest.fixture(scope="module")
def meta(spark):
    return {
        "tables": frame(spark, "table_schema string, table_name string, table_type string, row_count bigint, bytes bigint",
                        ("RAW", "ORDERS", "BASE TABLE", 20000, 1_000_000), ("RAW", "GEO", "BASE TABLE", 10, 1000), ("RAW", "V_ORDERS", "VIEW", None, None),
                        ("MARTS", "FCT_ORDERS", "BASE TABLE", 20000, 800_000), ("RAW", "PLAIN", "BASE TABLE", 1, 5), ("RAW", "V_BLIND", "VIEW", None, None)),
        "columns": frame(spark, "table_schema string, table_name string, column_name string, ordinal_position int, data_type string, is_identity string",
                         ("RAW", "ORDERS", "ORDER_ID", 1, "NUMBER", "YES"), ("RAW", "ORDERS", "META", 2, "VARIANT", "NO"), ("RAW", "GEO", "SHAPE", 1, "GEOGRAPHY", "NO"),
                         ("RAW", "PLAIN", "X", 1, "number(38,0)", "NO"), ("RAW", "PLAIN", "Y", 2, "SOMETHING_NEW", None)),
        "views": frame(spark, "table_schema string, table_name string, view_definition string, is_secure string",
                       ("RAW", "V_ORDERS", "create or replace view v as select iff(paid, total, 0) t from orders", "YES")),
        "iceberg_tables": frame(spark, "name string", ("lake",)),
        "tasks": frame(spark, "schema_name string, name string, definition string", ("OPS", "T1", "call nightly()"), ("OPS", "T2", "insert into log select 1")),
        "sequences": frame(spark, "sequence_schema string, sequence_name string", ("RAW", "S1")),
        "shares": frame(spark, "name string, kind string, owner_account string", ("USAGE", "INBOUND", "SNOWFLAKE"), ("SAMPLE", "INBOUND", "SFSALESSHARED.SFC_SAMPLES_EU"),
                        ("DAILY", "INBOUND", "WEATHER_CO"), ("OUT", "OUTBOUND", "")),
        "procedures": frame(spark, "procedure_schema string, procedure_name string, argument_signature string, procedure_language string, procedure_definition string",
                            ("S", "A", "()", "PYTHON", "x"), ("S", "B", "()", "SQL", "declare n int; begin n := 2; end"), ("S", "C", "()", "SQL", "insert into daily select * from hourly"), ("S", "D", "()", "SQL", None)),
        "functions": frame(spark, "function_schema string, function_name string, function_language string", ("S", "F", "SQL"), ("S", "G", "JAVASCRIPT")),
    }


def test_inventory(spark, meta):
    views = meta["views"].selectExpr("concat_ws('.', table_schema, table_name) as path", "'sql' as context", "view_definition as text")
    built = frame(spark, "model string", ("fct_orders",))
    items = {(r.kind, r.name): r for r in estate.classify_inventory(meta, built=built, view_hits=textscan.scan(views)).collect()}
    klass = {k: r["class"] for k, r in items.items()}
    assert klass["table", "RAW.ORDERS"] == REVIEW and klass["table", "RAW.GEO"] == UNSUPPORTED and klass["table", "RAW.PLAIN"] == REVIEW
    assert klass["view", "RAW.V_ORDERS"] == REDESIGN and items["view", "RAW.V_ORDERS"].rule == "S1"
    assert klass["view", "RAW.V_BLIND"] == REVIEW and "not readable" in items["view", "RAW.V_BLIND"].reason
    assert klass["table (built)", "MARTS.FCT_ORDERS"] == AUTOMATIC
    assert klass["identity column", "RAW.ORDERS.ORDER_ID"] == UNSUPPORTED
    assert klass["task", "OPS.T1"] == UNSUPPORTED and klass["task", "OPS.T2"] == REVIEW
    assert klass["sequence", "RAW.S1"] == UNSUPPORTED
    assert klass["share (provided)", "USAGE"] == klass["share (provided)", "SAMPLE"] == AUTOMATIC
    assert klass["share (inbound)", "DAILY"] == UNSUPPORTED and "WEATHER_CO" in items["share (inbound)", "DAILY"].reason
    assert klass["share (outbound)", "OUT"] == UNSUPPORTED
    assert [klass["procedure", f"S.{p}()"] for p in "ABCD"] == [REDESIGN, REDESIGN, REVIEW, REDESIGN]
    assert "not readable" in items["procedure", "S.D()"].reason
    assert klass["function", "S.F"] == REVIEW and klass["function", "S.G"] == REDESIGN
    assert estate.classify_inventory({"tasks": meta["tasks"]}).count() == 2


def test_iceberg_beats_the_plain_table(spark, meta):
    lake = {**meta, "iceberg_tables": frame(spark, "name string", ("orders",))}
    kinds = {r.name: (r.kind, r["class"]) for r in estate.classify_inventory(lake).where("name = 'RAW.ORDERS'").collect()}
    assert kinds["RAW.ORDERS"] == ("iceberg table", UNSUPPORTED)


def test_types(spark, meta):
    got = {r.source_type: (r.target_type, r["class"], r.columns, r.tables) for r in estate.type_summary(meta["columns"]).collect()}
    assert got["VARIANT"] == ("VARCHAR holding JSON text", REVIEW, 1, 1)
    assert got["NUMBER(38,0)"][1] == AUTOMATIC and got["SOMETHING_NEW"][:2] == ("unknown", REVIEW)
    assert len(estate.TYPE_MAP) == 37 and estate.type_map(spark).count() == 37


def test_counts(spark):
    items = frame(spark, "kind string, class string", ("a", AUTOMATIC), ("a", REDESIGN), ("b", AUTOMATIC))
    assert rows(estate.class_counts(items)) == sorted([(AUTOMATIC, 2, 66.7), (REVIEW, 0, 0.0), (REDESIGN, 1, 33.3), (UNSUPPORTED, 0, 0.0)])
    assert [tuple(r) for r in estate.kind_counts(items).collect()] == [("a", 2, 1), ("b", 1, 0)]


def test_moves(spark):
    tables = frame(spark, "table_schema string, table_name string, table_type string, row_count bigint, bytes bigint",
                   ("RAW", "ORDERS", "BASE TABLE", 20000, 1_000_000), ("STAGE", "ORDERS", "BASE TABLE", 5, 500), ("RAW", "LOGS", "BASE TABLE", 1, 10),
                   ("RAW", "V", "VIEW", None, None), ("RAW", "BIG", "BASE TABLE", 1, 20 * 1024**3), ("RAW", "DONE", "BASE TABLE", 1, None))
    columns = frame(spark, "table_schema string, table_name string, column_name string, ordinal_position int, data_type string",
                    ("RAW", "ORDERS", "META", 2, "VARIANT"), ("RAW", "ORDERS", "ID", 1, "NUMBER"))
    sources = frame(spark, "source string, table_name string, identifier string, contains_pii boolean", ("raw", "logs", "raw_logs", True))
    plan = estate.in_move_order(estate.move_plan(tables, columns, built=frame(spark, "model string", ("done",)), sources=sources, ratio=1.0)).orderBy("position").collect()
    assert [r.position for r in plan] == [1, 2, 3, 4, 5]
    assert [(r.table_schema, r.table_name) for r in plan] == [("RAW", "LOGS"), ("STAGE", "ORDERS"), ("RAW", "ORDERS"), ("RAW", "BIG"), ("RAW", "DONE")]
    by = {(r.table_schema, r.table_name): r for r in plan}
    assert by["RAW", "ORDERS"].target_table == "raw_raw_orders" and by["STAGE", "ORDERS"].target_table == "raw_stage_orders"
    assert "JSON text" in by["RAW", "ORDERS"].notes and "no column list" in by["RAW", "LOGS"].notes and "personal data" in by["RAW", "LOGS"].notes
    assert by["RAW", "BIG"].file_target == "raw/big/" and "several files" in by["RAW", "BIG"].notes
    assert by["RAW", "DONE"].target_table == "sf_done" and by["RAW", "DONE"].move_group == 3
    made = estate.move_plan(tables, columns, built=frame(spark, "model string", ("done",)), sources=sources, ratio=1.0)
    copied = {(r.table_schema, r.table_name): r.copy_sql for r in estate.copy_text(columns, made, "DB", "STAGE").collect()}
    assert 'INTO @STAGE/raw/raw_orders.parquet FROM (SELECT "ID", TO_JSON("META") AS "META" FROM "DB"."RAW"."ORDERS")' in copied["RAW", "ORDERS"]
    assert "INTO @STAGE/raw/stage_orders.parquet FROM (SELECT * FROM" in copied["STAGE", "ORDERS"] and "SINGLE = TRUE" in copied["STAGE", "ORDERS"]
    assert "@STAGE/raw/big/ " in copied["RAW", "BIG"] and "SINGLE" not in copied["RAW", "BIG"] and "@STAGE/expected/done.parquet" in copied["RAW", "DONE"]
    assert len(set(copied.values())) == len(copied) == 5
    volume = {(r.table_schema, r.is_total): tuple(r)[2:] for r in estate.volume(tables, 1.5).collect()}
    assert volume["STAGE", False] == (1, 0, 5, 500, 750) and volume["RAW", False][:2] == (4, 1)
    assert volume[None, True] == tuple(map(sum, zip(volume["STAGE", False], volume["RAW", False], strict=True))) and len(volume) == 3
    assert rows(estate.volume(tables.limit(0))) == []
    top = estate.largest_tables(tables, 3, classes=frame(spark, "table_schema string, table_name string, class string", ("RAW", "ORDERS", "REDESIGN"))).orderBy("position").collect()
    assert [(r.position, r.table_name, r["class"]) for r in top] == [(1, "BIG", "-"), (2, "ORDERS", "REDESIGN"), (3, "ORDERS", "-")]
    assert estate.PARQUET_RATIO == 1.52


def test_largest_tables_of_equal_size_and_name(spark):
    """Rows decide, among those listed and at the cut, in whatever order the tables come."""
    for counts in ((300, 280, None, 290), (None, 290, 300, 280)):
        tables = frame(spark, "table_schema string, table_name string, table_type string, row_count bigint, bytes bigint", *[("RAW", "T", "BASE TABLE", n, 10) for n in counts])
        assert [(r.position, r.row_count) for r in estate.largest_tables(tables.repartition(4), 3).orderBy("position").collect()] == [(1, 280), (2, 290), (3, 300)]


def test_scope(spark):
    df = frame(spark, "schema_name string, n int", ("raw", 1), ("OTHER", 2))
    assert rows(estate.in_schemas(df, [" RAW "])) == [("raw", 1)] and estate.in_schemas(df, []).count() == 2
    assert estate.in_schemas(frame(spark, "name string", ("mystery",)), ["RAW"]).count() == 1


def test_usage(spark):
    history = frame(spark, "query_type string, total_elapsed_time bigint, user_name string, start_time string, database_name string, session_id int",
                    ("SELECT", 1500, "a", "2025-01-07 00:00:00", "DB", 1), ("SELECT", 600, "b", "2025-01-06 00:00:00", "DB", 2), ("COPY", 100, "a", "2025-01-02 12:00:00", "DB", 3),
                    ("SELECT", 1, "a", "2024-12-01 00:00:00", "DB", 1), ("SELECT", 1, "a", "2025-01-07 00:00:00", "X", 1)).withColumn("start_time", F.col("start_time").cast("timestamp_ntz"))
    assert [tuple(r) for r in estate.queries_by_type(history, "2025-01-08 00:00:00", database="DB").collect()] == [("SELECT", 2, 2.1, 2), ("COPY", 1, 0.1, 1)]
    for top in (0, 500):
        with pytest.raises(ValueError):
            estate.queries_by_type(history, "2025-01-08 00:00:00", top=top)
    sessions = frame(spark, "session_id int, client_application_id string", (1, "Tableau Desktop 2024.1"), (2, None), (3, "PythonConnector"))
    clients = estate.queries_by_client(history, sessions, "2025-01-08 00:00:00", database="DB")
    assert rows(clients) == [("PythonConnector", 1), ("Tableau Desktop 2024.1", 1), ("unknown", 1)]
    assert rows(estate.bi_clients(clients)) == [("Tableau Desktop 2024.1", 1)]


def test_parity_plan(spark):
    models = frame(spark, "model string, schema_name string, key array<string>", ("fct", "marts", ["id"]), ("rpt", None, None))
    assert rows(estate.parity_plan(models)) == [("fct", "marts.fct", "main.sf_fct", "id", False), ("rpt", "<target schema>.rpt", "main.sf_rpt", None, True)]
