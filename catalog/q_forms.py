"""Smaller forms that other queries do not hold, each over whole tables."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from catalog.registry import query
from catalog.shop import money, table
from equipoise.functions import dates as dt
from equipoise.functions import numbers as nu
from equipoise.functions import semi as js
from equipoise.functions import strings as st
from equipoise.operators.parity import compare
from equipoise.plans import governance
from equipoise.sources import tables


@query("select_forms", """
WITH t AS (SELECT * EXCLUDE (o_orderdate, o_custkey) RENAME (o_orderkey AS order_id) FROM orders)
SELECT o_orderstatus AS status, left(o_orderpriority, 1) AS urgency, order_id % 3 AS part, count(*) AS n, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents, sum(round(o_totalprice * 100)::BIGINT)::BIGINT * 2 AS twice,
  sum(round(o_totalprice * 100)::BIGINT)::BIGINT * 2 + count(*) AS more FROM t GROUP BY ALL""")
def select_forms(spark, sf_dir):
    """Columns left out and renamed, a select list that uses its own aliases, and grouping by all that is not aggregated."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "order_id")
    return spark.sql(
        """select *, cents * 2 as twice, twice + n as more from (
             select o_orderstatus as status, left(o_orderpriority, 1) as urgency, order_id % 3 as part, count(*) as n, sum(cast(round(o_totalprice * 100) as bigint)) as cents
             from (select * except (o_orderdate, o_custkey) from {orders}) group by all)""",
        orders=orders,
    )


@query("number_forms", """
WITH t AS (SELECT l_linenumber, l_quantity::BIGINT AS q, l_extendedprice::DECIMAL(12,2) AS p, round(l_extendedprice * 100)::BIGINT AS cents FROM lineitem),
h AS (SELECT *, CASE WHEN cents % 2 = 0 THEN cents // 2 WHEN (cents // 2) % 2 = 0 THEN cents // 2 ELSE cents // 2 + 1 END AS half FROM t)
SELECT l_linenumber, sum(half)::BIGINT AS halves_to_even, sum(CASE WHEN q <> 7 THEN (p / q)::DECIMAL(18,4) ELSE 0 END)::DECIMAL(28,4) > 0 AS divides, true AS zero_raises FROM h GROUP BY 1""")
def number_forms(spark, sf_dir):
    """Half to even, and division that must fail on zero: it does for whole lines that hold one, and not for the others."""
    t = table(spark, sf_dir, "lineitem").select("l_linenumber", F.col("l_quantity").cast("bigint").alias("q"), money("l_extendedprice").alias("p"))
    half = F.round(F.col("p") * 100).cast("decimal(20,0)") * F.lit("0.5").cast("decimal(2,1)")
    try:
        t.agg(F.sum(nu.divide_or_raise(F.col("p"), F.col("q") - F.col("q")))).collect()
        raised = False
    except PySparkException as problem:
        raised = "division by zero" in str(problem)
    return t.groupBy("l_linenumber").agg(
        F.sum(nu.round_half_even(half, 0)).cast("bigint").alias("halves_to_even"),
        (F.sum(F.when(F.col("q") != 7, nu.divide_or_raise(F.col("p"), F.col("q"))).otherwise(0)) > 0).alias("divides"), F.lit(raised).alias("zero_raises"),
    )


@query("text_forms", """
SELECT page_id, CASE WHEN regexp_matches(url, '[0-9]+') THEN length(regexp_extract(url, '^([^0-9]*)', 1)) + 1 ELSE 0 END::BIGINT AS first_digit, CASE WHEN contains(url, '/fr/') THEN instr(url, '/fr/') ELSE 0 END::BIGINT AS french,
  list_reduce(list_concat([''], list_transform(string_split('one two' || (page_id % 10) || ' x', ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2)))), lambda a, w: CASE WHEN a = '' THEN w ELSE a || ' ' || w END) AS capitals,
  (page_id * 1.50::DECIMAL(4,2))::DECIMAL(18,2)::VARCHAR AS scaled, (DATE '2024-02-28' + (page_id % 9)::INT)::DATE::VARCHAR AS day, (page_id % 2 = 0)::VARCHAR AS even FROM pages""")
def text_forms(spark, sf_dir):
    """Places of matches, capitals, and values as text: decimals keep their scale."""
    n, u = F.col("page_id"), F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", st.regexp_instr(u, "[0-9]+").cast("bigint").alias("first_digit"), st.regexp_instr(u, "/fr/").cast("bigint").alias("french"),
        st.initcap(F.concat(F.lit("one two"), (n % 10).cast("string"), F.lit(" x"))).alias("capitals"), (n * F.lit("1.50").cast("decimal(4,2)")).cast("decimal(18,2)").cast("string").alias("scaled"),
        F.date_add(F.lit("2024-02-28").cast("date"), (n % 9).cast("int")).cast("string").alias("day"), (n % 2 == 0).cast("string").alias("even"),
    )


@query("moment_forms", """
SELECT event_id, make_timestamp(2024, 1, 1, 0, 0, 0) + to_months((event_id % 30)::INT - 3) + to_days((event_id % 70)::INT - 1) + to_hours(event_id % 50) + to_minutes(-(event_id % 200)) + to_microseconds(event_id % 100 * 1500000) AS moment,
  strptime(strftime(ts, '%Y/%m/%d %H-%M-%S'), '%Y/%m/%d %H-%M-%S') AS parsed FROM events""")
def moment_forms(spark, sf_dir):
    """Moments from parts, of which any may be out of range, and from text of a stated form."""
    i, whole = F.col("event_id"), lambda c: c.cast("int")
    parts = whole(i % 30 - 2), whole(i % 70), whole(i % 50), whole(-(i % 200)), (i % 100) * F.lit("1.5").cast("decimal(3,1)")
    return table(spark, sf_dir, "events").select(
        "event_id", dt.timestamp_from_parts(F.lit(2024), *parts).alias("moment"), dt.to_timestamp(dt.to_char(F.col("ts"), "YYYY/MM/DD HH24-MI-SS"), "YYYY/MM/DD HH24-MI-SS").alias("parsed")
    )


@query("json_forms", """
SELECT o_orderkey, (o_custkey * 100)::VARCHAR || '.0' AS exponent, o_custkey || '.5' AS trailing_zero, json_array(o_orderkey, o_orderstatus, CASE WHEN o_custkey % 2 = 0 THEN true END, NULL)::VARCHAR AS listed,
  CASE o_orderkey % 4 WHEN 0 THEN 'ARRAY' WHEN 1 THEN 'OBJECT' WHEN 2 THEN 'NULL_VALUE' END AS kind FROM orders""")
def json_forms(spark, sf_dir):
    """Numbers normalised as text, arrays from values of several types, and types by path, one of them missing."""
    key = F.col("o_custkey").cast("string")
    text = F.concat(F.lit('{"e":'), key, F.lit('e2,"z":'), key, F.lit('.50,"v":'), F.expr("array('[]', '{}', 'null')[int(o_orderkey % 4) % 3]"), F.lit("}"))
    v = F.when(F.col("o_orderkey") % 4 == 3, F.regexp_replace(text, '"v"', '"w"')).otherwise(text)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", js.get_text(v, "e").alias("exponent"), js.get_text(v, "z").alias("trailing_zero"),
        js.array_construct(F.col("o_orderkey"), F.col("o_orderstatus"), F.when(F.col("o_custkey") % 2 == 0, True), F.lit(None).cast("string")).alias("listed"), js.type_of(v, "v").alias("kind"),
    )


@query("parity_columns", """
SELECT 'mismatch' AS status, 'o_orderpriority' AS columns_only_in_expected, 'checked' AS columns_only_in_actual, 0 AS differing_columns, (SELECT count(*) FROM orders) AS rows_expected""")
def parity_columns(spark, sf_dir):
    """Equal values, but each side has a column that the other lacks; names differ in case only where they are shared."""
    o = table(spark, sf_dir, "orders")
    other = o.drop("o_orderpriority").withColumnRenamed("o_totalprice", "O_TOTALPRICE").withColumn("checked", F.lit(True))
    return compare(o, other, ["o_orderkey"]).models.select("status", "columns_only_in_expected", "columns_only_in_actual", "differing_columns", "rows_expected")


@query("parity_zones", "SELECT 0::BIGINT AS in_utc, 0::BIGINT AS in_tokyo, (SELECT count(*) FROM events) AS rows_expected")
def parity_zones(spark, sf_dir):
    """Instants against wall-clock times in UTC: equal whatever the session's zone is."""
    events, name = table(spark, sf_dir, "events").select("event_id", "ts"), "spark.sql.session.timeZone"
    zone, found = spark.conf.get(name), []
    try:
        for other in ("UTC", "Asia/Tokyo"):
            spark.conf.set(name, other)
            instants = events.select("event_id", F.timestamp_micros(dt.wall_micros(F.col("ts"))).alias("ts"))
            row = compare(events, instants, ["event_id"]).columns.where("column_name = 'ts'").first()
            found.append(int(row["differing_rows"]))
    finally:
        spark.conf.set(name, zone)
    return events.agg(F.count(F.lit(1)).alias("rows_expected")).select(F.lit(found[0]).cast("bigint").alias("in_utc"), F.lit(found[1]).cast("bigint").alias("in_tokyo"), "rows_expected")


@query("view_status", "SELECT 'main' AS table_schema, 'open_orders' AS table_name, count(*) AS row_count, false AS failed FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'main', 'gone', NULL, true")
def view_status(spark, sf_dir):
    """A view that is read by name, and a relation that cannot be resolved: it reports its error and does not hide the other."""
    tables.create_view(table(spark, sf_dir, "orders").where("o_orderstatus = 'O'"), "open_orders")
    load = {("main", "open_orders"): lambda: spark.table("open_orders"), ("main", "gone"): lambda: spark.table("no_such_relation")}
    return tables.relation_status_checked(spark, load).select("table_schema", "table_name", "row_count", F.col("error").isNotNull().alias("failed"))


@query("tests_on_forbidden", """
SELECT 'raw' AS source, CASE c_nationkey % 4 WHEN 0 THEN 'Customer_Contacts' ELSE 'customer_contacts' END AS table_name, CASE WHEN c_custkey % 2 = 0 THEN 'unique' ELSE 'not_null' END AS test, count(*) AS n
FROM customer WHERE c_nationkey % 3 = 0 GROUP BY ALL""")
def tests_on_forbidden(spark, sf_dir):
    declared = table(spark, sf_dir, "customer").selectExpr(
        "'raw' as source", "case when c_nationkey % 3 <> 0 then 'orders' when c_nationkey % 4 = 0 then 'Customer_Contacts' else 'customer_contacts' end as table_name", "if(c_custkey % 2 = 0, 'unique', 'not_null') as test"
    )
    return governance.tests_on_forbidden(declared, spark.createDataFrame([("RAW", "customer_contacts")], "source string, table_name string"))
