"""The retail sources, models and data tests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog import shop, shop_sql
from catalog.registry import portable, query
from catalog.shop import money, table
from equipoise.functions.aggregates import listagg_distinct
from equipoise.functions.conditionals import iff
from equipoise.functions.dates import trunc_date
from equipoise.functions.numbers import exact_avg, gross_amount, line_amount, rounded_ratio
from equipoise.operators.windows import ratio_over
from equipoise.plans import retail, retail_tests
from equipoise.session import cut_lineage
from equipoise.sources.schemas import SOURCE_SCHEMAS

for _name in SOURCE_SCHEMAS:
    query(f"source_{_name}", shop_sql.source_sql(_name))(
        lambda spark, sf_dir, name=_name: portable(shop.sources(spark, sf_dir)[name])
    )


def _model(name: str):
    def run(spark, sf_dir):
        df = shop.models(spark, sf_dir)[name]
        if name == "rpt_monthly_revenue":
            df = df.withColumn("revenue_share_pct", F.col("revenue_share_pct").cast("decimal(9,2)"))
            df = df.withColumn("avg_order_value", F.col("avg_order_value").cast("decimal(18,2)"))
        return portable(df)

    return run


for _name in retail.KEYS:
    query(_name, shop_sql.model_sql(_name))(_model(_name))

def _tests_sql() -> str:
    """One SELECT per declared test, from the same declarations' names and columns."""
    relation = {"source.orders": "shop_orders"}
    declared = retail_tests.declared({"stg_customers": None})
    parts = []
    for name, tests in declared.items():
        rel = relation.get(name, name.removeprefix("source."))
        for t in tests:
            kind = type(t).__name__
            if kind == "Unique":
                cols = ", ".join(t.columns)
                present = " AND ".join(f"{c} IS NOT NULL" for c in t.columns)
                count = f"SELECT count(*) FROM (SELECT {cols} FROM {rel} WHERE {present} GROUP BY {cols} HAVING count(*) > 1)"
            elif kind == "NotNull":
                count = f"SELECT count(*) FROM {rel} WHERE {t.column} IS NULL"
            elif kind == "Accepted":
                values = ", ".join(f"'{v}'" for v in t.values)
                count = f"SELECT count(*) FROM {rel} WHERE {t.column} NOT IN ({values})"
            else:
                count = (
                    f"SELECT count(*) FROM {rel} c WHERE c.{t.column} IS NOT NULL AND NOT EXISTS "
                    f"(SELECT 1 FROM stg_customers p WHERE p.{t.parent_column} = c.{t.column})"
                )
            parts.append(f"SELECT '{name}' AS table_name, '{t.label}' AS test, ({count})::BIGINT AS failing_rows")
    parts.append(
        "SELECT 'fct_orders', 'order_totals_reconcile', (SELECT count(*) FROM fct_orders f LEFT JOIN "
        "(SELECT order_id, sum(line_amount) AS s FROM stg_order_items GROUP BY 1) l ON l.order_id = f.order_id "
        "WHERE f.items_amount <> coalesce(l.s, 0))::BIGINT"
    )
    parts.append(
        "SELECT 'rpt_monthly_revenue', 'grain', (SELECT count(*) FROM (SELECT 1 FROM rpt_monthly_revenue "
        "GROUP BY order_month, country_code HAVING count(*) > 1))::BIGINT"
    )
    return shop_sql.model_query(" UNION ALL ".join(parts))


@query("retail_tests", _tests_sql())
def retail_test_results(spark, sf_dir):
    sources = shop.sources(spark, sf_dir, stored=True)
    models = retail.build(sources)
    # what joins is made once; of the lines, the columns that tests read
    models["int_web_item_views"] = cut_lineage(models["int_web_item_views"])
    models["int_order_lines"] = cut_lineage(models["int_order_lines"].select("order_item_id", "order_id"))
    for mart in ("fct_orders", "dim_customers", "rpt_monthly_revenue"):  # the later ones read the first
        models[mart] = cut_lineage(models[mart])
    return retail_tests.run(sources, models)


# --------------------------------------------------------------------------- on the order tables

_DISCOUNT_SQL = "(CASE WHEN l_linenumber % 3 = 0 THEN 12.50 WHEN l_linenumber % 5 = 0 THEN 33.33 ELSE l_discount::DECIMAL(5,2) * 100 END)::DECIMAL(5,2)"
_LINES_SQL = f"""
lines AS (
  SELECT l_orderkey, l_suppkey, l_quantity::DECIMAL(18,0) AS q, l_extendedprice::DECIMAL(10,2) AS p, {_DISCOUNT_SQL} AS d FROM lineitem),
amounts AS (
  SELECT l_orderkey, l_suppkey, q, q * p AS gross, round(q * p * (1 - d * 0.01), 2) AS line FROM lines)
"""


def lines(spark, sf_dir):
    """Order lines with exact quantity, price and a discount that lands on half cents."""
    rate = (
        F.when(F.col("l_linenumber") % 3 == 0, F.lit("12.50").cast("decimal(5,2)"))
        .when(F.col("l_linenumber") % 5 == 0, F.lit("33.33").cast("decimal(5,2)"))
        .otherwise((F.col("l_discount").cast("decimal(5,2)") * 100).cast("decimal(5,2)"))
    )
    typed = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", F.col("l_quantity").cast("decimal(18,0)").alias("q"),
        F.col("l_extendedprice").cast("decimal(10,2)").alias("p"), rate.alias("d"),
    )
    return typed.select(
        "l_orderkey", "l_suppkey", "q", gross_amount(F.col("q"), F.col("p")).alias("gross"),
        line_amount(F.col("q"), F.col("p"), F.col("d")).alias("line"),
    )


@query("line_amounts", f"""
WITH {_LINES_SQL}
SELECT l_suppkey, count(*) AS n_lines, sum(gross)::DECIMAL(28,2) AS gross, sum(line)::DECIMAL(28,2) AS net,
  sum(gross - line)::DECIMAL(28,2) AS discount, max(line)::DECIMAL(18,2) AS largest
FROM amounts GROUP BY l_suppkey""")
def line_amounts(spark, sf_dir):
    return lines(spark, sf_dir).groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum("gross").cast("decimal(28,2)").alias("gross"),
        F.sum("line").cast("decimal(28,2)").alias("net"),
        F.sum(F.col("gross") - F.col("line")).cast("decimal(28,2)").alias("discount"),
        F.max("line").cast("decimal(18,2)").alias("largest"),
    )


_FACTS_SQL = f"""
{_LINES_SQL},
sums AS (SELECT l_orderkey, count(*) AS n_lines, sum(q)::BIGINT AS units, sum(line)::DECIMAL(18,2) AS amount FROM amounts GROUP BY 1),
order_facts AS (
  SELECT o_orderkey, o_custkey, n.n_name AS nation, date_trunc('month', o_orderdate)::DATE AS order_month, o_orderpriority AS channel,
    o_orderstatus = 'P' AS cancelled, coalesce(n_lines, 0) AS n_lines, coalesce(units, 0) AS units,
    coalesce(amount, 0)::DECIMAL(18,2) AS amount, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE coalesce(amount, 0) END::DECIMAL(18,2) AS net_revenue
  FROM orders LEFT JOIN sums ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey
    LEFT JOIN nation n ON n_nationkey = c_nationkey)
"""


def order_facts(spark, sf_dir):
    """One row per order with its line sums (an order without lines is 0) and the buyer's nation."""
    sums = lines(spark, sf_dir).groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("q").cast("bigint").alias("units"), F.sum("line").cast("decimal(18,2)").alias("amount")
    )
    buyers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    joined = (
        table(spark, sf_dir, "orders")
        .join(sums, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .join(buyers.select("c_custkey", "n_name"), F.col("o_custkey") == F.col("c_custkey"), "left")
    )
    cancelled = F.col("o_orderstatus") == "P"
    amount = F.coalesce("amount", F.lit(0)).cast("decimal(18,2)")
    return joined.select(
        "o_orderkey", "o_custkey", F.col("n_name").alias("nation"),
        trunc_date("month", F.col("o_orderdate")).alias("order_month"),
        F.col("o_orderpriority").alias("channel"), cancelled.alias("cancelled"),
        F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("units", F.lit(0)).alias("units"),
        amount.alias("amount"), iff(cancelled, F.lit(0), amount).cast("decimal(18,2)").alias("net_revenue"),
    )


query("order_facts", f"WITH {_FACTS_SQL} SELECT * FROM order_facts")(order_facts)


@query("monthly_revenue", f"""
WITH {_FACTS_SQL},
monthly AS (
  SELECT order_month, nation, count(*) AS orders, count(*) FILTER (WHERE NOT cancelled) AS revenue_orders,
    count(DISTINCT o_custkey) AS customers, sum(net_revenue)::DECIMAL(18,2) AS revenue,
    coalesce(string_agg(DISTINCT channel, ',' ORDER BY channel), '') AS channels
  FROM order_facts GROUP BY 1, 2)
SELECT order_month, nation, orders, revenue_orders, customers, revenue,
  round({shop_sql.exact_div('revenue', 'revenue_orders', 8, div0=True)}, 2)::DECIMAL(18,2) AS avg_order_value,
  round(100 * ((revenue * 100)::DOUBLE / nullif(sum((revenue * 100)::DOUBLE) OVER (PARTITION BY order_month), 0)), 2)::DECIMAL(9,2) AS revenue_share_pct,
  channels
FROM monthly""")
def monthly_revenue(spark, sf_dir):
    monthly = order_facts(spark, sf_dir).groupBy("order_month", "nation").agg(
        F.count(F.lit(1)).alias("orders"),
        F.count_if(~F.col("cancelled")).alias("revenue_orders"),
        F.count_distinct("o_custkey").alias("customers"),
        F.sum("net_revenue").cast("decimal(18,2)").alias("revenue"),
        listagg_distinct(F.col("channel")).alias("channels"),
    )
    share = ratio_over(F.col("revenue") * 100, Window.partitionBy("order_month"))
    average = rounded_ratio(F.col("revenue"), F.col("revenue_orders"), 2, num_type=(18, 2), den_type=(9, 0), div0=True)
    return monthly.select(
        "order_month", "nation", "orders", "revenue_orders", "customers", "revenue", average.cast("decimal(18,2)").alias("avg_order_value"),
        F.round(share * 100, 2).cast("decimal(9,2)").alias("revenue_share_pct"), "channels",
    )


@query("exact_avg_price", f"""
SELECT p_brand, count(*) AS parts, sum(p_retailprice::DECIMAL(12,2))::DECIMAL(28,2) AS total,
  round({shop_sql.exact_div('sum(p_retailprice::DECIMAL(12,2))', 'count(*)', 8)}, 2)::DECIMAL(18,2) AS avg_price
FROM part GROUP BY p_brand""")
def exact_avg_price(spark, sf_dir):
    return table(spark, sf_dir, "part").withColumn("price", money("p_retailprice")).groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("parts"),
        F.sum("price").cast("decimal(28,2)").alias("total"),
        exact_avg(F.col("price"), 2).cast("decimal(18,2)").alias("avg_price"),
    )
