"""The data tests declared for the retail sources and models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equipoise.operators.quality import Accepted, NotNull, References, Unique, check, count_failures

# The accepted values of the project's coded columns.
COUNTRIES = ("NL", "DE", "BE", "FR", "AT", "DK", "SE", "IT", "ES", "PL")
CATEGORY_CODES = ("EL", "HO", "SP", "BO", "TO")
ORDER_STATUSES = ("placed", "shipped", "delivered", "cancelled", "returned")
PAYMENT_STATUSES = ("success", "failed", "refunded")
ITEM_EVENTS = ("product_view", "add_to_cart", "checkout")
SEGMENTS = ("prospect", "loyal", "lapsed", "active")


def _key(column: str) -> list:
    return [Unique((column,)), NotNull(column)]


def declared(models: dict[str, DataFrame]) -> dict[str, list]:
    """Tests per source (``source.*``) and model."""
    return {
        "source.customers": _key("customer_id"),
        "source.products": _key("product_id"),
        "source.orders": _key("order_id"),
        "source.order_items": _key("order_item_id"),
        "source.payments": _key("payment_id"),
        "source.web_events": _key("event_id"),
        "stg_customers": [
            *_key("customer_id"), NotNull("email"), NotNull("country_code"), Accepted("country_code", COUNTRIES),
            NotNull("marketing_opt_in"),
        ],
        "stg_products": [*_key("product_id"), *_key("sku"), Accepted("category_code", CATEGORY_CODES)],
        "stg_orders": [*_key("order_id"), NotNull("customer_id"), NotNull("status"), Accepted("status", ORDER_STATUSES)],
        "stg_order_items": [*_key("order_item_id"), NotNull("order_id"), NotNull("product_id"), NotNull("line_amount")],
        "stg_payments": [*_key("payment_id"), NotNull("order_id"), Accepted("payment_status", PAYMENT_STATUSES)],
        "int_order_lines": [*_key("order_item_id"), NotNull("order_id")],
        "int_web_item_views": [
            *_key("web_item_view_id"), NotNull("event_id"), NotNull("item_position"), Accepted("event_type", ITEM_EVENTS),
        ],
        "fct_orders": [
            *_key("order_id"), NotNull("customer_id"), References("customer_id", models["stg_customers"], "customer_id"),
            NotNull("country_code"), NotNull("order_date"), Accepted("status", ORDER_STATUSES), NotNull("order_total"),
        ],
        "dim_customers": [*_key("customer_id"), *_key("email"), NotNull("customer_segment"), Accepted("customer_segment", SEGMENTS)],
        "rpt_monthly_revenue": [NotNull("order_month"), NotNull("country_code")],
    }


def totals_that_disagree(facts: DataFrame, items: DataFrame) -> DataFrame:
    """Orders whose items_amount is not the sum of their line amounts, to the cent."""
    expected = items.groupBy("order_id").agg(F.sum("line_amount").alias("line_sum"))
    checked = facts.select("order_id", "items_amount").join(expected, "order_id", "left").select(
        "order_id", "items_amount", F.coalesce("line_sum", F.lit(0)).alias("expected_items_amount")
    )
    return checked.where(F.col("items_amount") != F.col("expected_items_amount"))


def grain_violations(report: DataFrame) -> DataFrame:
    """Report rows that share a (month, country)."""
    return report.groupBy("order_month", "country_code").agg(F.count(F.lit(1)).alias("row_count")).where("row_count > 1")


def run(sources: dict[str, DataFrame], models: dict[str, DataFrame]) -> DataFrame:
    """(table_name, test, failing_rows) for all 63 tests."""
    parts = []
    for table, tests in declared(models).items():
        frame = sources[table.split(".", 1)[1]] if table.startswith("source.") else models[table]
        parts.append(check(frame, table, tests))
    parts.append(count_failures(totals_that_disagree(models["fct_orders"], models["stg_order_items"]), "fct_orders", "order_totals_reconcile"))
    parts.append(count_failures(grain_violations(models["rpt_monthly_revenue"]), "rpt_monthly_revenue", "grain"))
    return reduce(DataFrame.unionByName, parts)
