"""The retail sources derived from the given tables.

Ids, buyers, prices, names and moments come from the tables; everything else is drawn per id by
the deterministic generator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equipoise.functions.dates import add_to_timestamp
from equipoise.plans import retail
from equipoise.session import cut_lineage
from equipoise.sources import synthetic


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(column) -> Column:
    """DOUBLE amounts in the tables hold two decimals; from here on they are exact."""
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(12,2)")


def sources(spark: SparkSession, sf_dir: str, *, stored: bool = False) -> dict[str, DataFrame]:
    """The seven sources; ``stored`` writes each one once, for plans that read it many times."""
    t = lambda name: table(spark, sf_dir, name)
    n_products = lambda: t("part").count()  # noqa: E731  footer row counts only

    def people():
        return t("customer").selectExpr("c_custkey + 1 as id")

    def goods():
        cents = "cast(cast(p_retailprice as decimal(12,2)) * 100 as bigint) as price_cents"
        return t("part").selectExpr("p_partkey + 1 as id", cents, "p_name as product_name")

    def heads():
        moment = add_to_timestamp("second", F.col("o_orderkey") % 86_400, F.col("o_orderdate"))
        return t("orders").select((F.col("o_orderkey") + 1).alias("id"), (F.col("o_custkey") + 1).alias("customer_id"), moment.alias("order_ts"))

    def clicks():
        return t("events").selectExpr("event_id + 1 as id", "user_id + 1 as customer_id", "ts as event_ts")

    recipes = {
        "customers": lambda: synthetic.customers(people()),
        "customer_contacts": lambda: synthetic.customer_contacts(people()),
        "products": lambda: synthetic.products(goods()),
        "orders": lambda: synthetic.orders(heads()),
        "web_events": lambda: synthetic.web_events(clicks(), n_products=n_products()),
        "order_items": lambda: synthetic.order_items(made["orders"], made["products"], n_products()),
        "payments": lambda: synthetic.payments(made["orders"], made["order_items"]),
    }
    made = retail.OnDemand(recipes, lambda recipe: cut_lineage(recipe()) if stored else recipe())
    return made


def models(spark: SparkSession, sf_dir: str, *, stored: bool = False) -> dict[str, DataFrame]:
    """The ten models; ``stored`` also writes the marts once, as the project materialises them."""
    built = retail.build(sources(spark, sf_dir, stored=stored))
    for mart in retail.MARTS if stored else ():
        built[mart] = cut_lineage(built[mart])
    return built
