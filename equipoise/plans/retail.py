"""The ten-model retail project.

A model is a function from frames to a frame; staging and intermediate models stay lazy, so a
mart is one plan in which Catalyst prunes columns and pushes filters to the Parquet scans.
Ids keep whatever exact type the sources have.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equipoise.functions.aggregates import listagg_distinct, max_if
from equipoise.functions.conditionals import decode, iff
from equipoise.functions.dates import add_to_date, boundaries_between, to_char, trunc_date
from equipoise.functions.numbers import cents_to_units, gross_amount, line_amount, round_div, rounded_ratio, try_to_number
from equipoise.functions.semi import get_typed
from equipoise.operators.windows import ratio_over

AS_OF = date(2026, 6, 30)

# Category names, countries of the home region, status groups, segment limits.
CATEGORIES = {"EL": "Electronics", "HO": "Home & Living", "SP": "Sports", "BO": "Books", "TO": "Toys"}
HOME_REGION = ("NL", "BE", "LU")
NO_REVENUE = ("cancelled", "returned")
PAYMENT_SIGN = {"success": 1, "refunded": -1}
LOYAL_ORDERS, LAPSED_DAYS = 15, 180
RETURN_DAYS = 30

# Grain of every model.
KEYS = {
    "stg_customers": ["customer_id"],
    "stg_products": ["product_id"],
    "stg_orders": ["order_id"],
    "stg_order_items": ["order_item_id"],
    "stg_payments": ["payment_id"],
    "int_order_lines": ["order_item_id"],
    "int_web_item_views": ["event_id", "item_position"],
    "dim_customers": ["customer_id"],
    "fct_orders": ["order_id"],
    "rpt_monthly_revenue": ["order_month", "country_code"],
}
MARTS = ("dim_customers", "fct_orders", "rpt_monthly_revenue")

_PAYLOAD = "session_id string, items array<struct<sku:string,qty:string>>, utm struct<source:string,campaign:string>"


def _zero(value: Column, sql_type: str | None = None) -> Column:
    filled = F.coalesce(value, F.lit(0))
    return filled.cast(sql_type) if sql_type else filled


def stg_customers(customers: DataFrame, as_of: date = AS_OF) -> DataFrame:
    country = F.upper(F.trim("country_code"))
    signed_up = F.col("signup_ts").cast("timestamp_ntz")
    return customers.select(
        "customer_id",
        F.trim("first_name").alias("first_name"),
        F.trim("last_name").alias("last_name"),
        F.lower(F.trim("email")).alias("email"),
        country.alias("country_code"),
        iff(country.isin(*HOME_REGION), "Benelux", "Rest of EU").alias("region"),
        signed_up.alias("signup_ts"),
        signed_up.cast("date").alias("signup_date"),
        to_char(signed_up, "YYYY-MM").alias("signup_cohort"),
        boundaries_between("day", signed_up, F.lit(as_of)).alias("account_age_days"),
        F.coalesce("marketing_opt_in", F.lit(False)).alias("marketing_opt_in"),
    )


def stg_products(products: DataFrame) -> DataFrame:
    category = F.upper("category_code")
    return products.select(
        "product_id",
        F.upper(F.trim("sku")).alias("sku"),
        F.trim("product_name").alias("product_name"),
        category.alias("category_code"),
        decode(category, CATEGORIES, "Other").alias("category_name"),
        _zero(F.col("unit_price"), "decimal(10,2)").alias("list_price"),
        F.col("unit_price").isNull().alias("is_price_missing"),
        "is_active",
    )


def stg_orders(orders: DataFrame) -> DataFrame:
    ordered, meta = F.col("order_ts").cast("timestamp_ntz"), F.col("order_meta")
    day = ordered.cast("date")
    return orders.select(
        "order_id",
        "customer_id",
        ordered.alias("order_ts"),
        day.alias("order_date"),
        trunc_date("month", day).alias("order_month"),
        F.lower(F.trim("status")).alias("status"),
        F.lower("channel").alias("channel"),
        get_typed(meta, "coupon", "string").alias("coupon_code"),
        get_typed(meta, "device", "string").alias("device"),
        get_typed(meta, "shipping.method", "string").alias("shipping_method"),
        try_to_number(get_typed(meta, "shipping.cost", "string"), 10, 2).alias("shipping_cost"),
        F.coalesce(get_typed(meta, "gift", "boolean"), F.lit(False)).alias("is_gift"),
        add_to_date("day", RETURN_DAYS, day).alias("return_deadline"),
    )


def stg_order_items(order_items: DataFrame) -> DataFrame:
    gross = gross_amount(F.col("quantity"), F.col("unit_price"))
    line = line_amount(F.col("quantity"), F.col("unit_price"), F.col("discount_pct"))
    return order_items.select(
        "order_item_id",
        "order_id",
        "product_id",
        "quantity",
        "unit_price",
        "discount_pct",
        gross.alias("gross_amount"),
        line.alias("line_amount"),
        (gross - line).alias("discount_amount"),
    )


def stg_payments(payments: DataFrame) -> DataFrame:
    status = F.lower("status")
    amount = cents_to_units(F.col("amount_cents"))
    sign = decode(status, PAYMENT_SIGN, 0)
    paid = F.col("paid_ts").cast("timestamp_ntz")
    return payments.select(
        "payment_id",
        "order_id",
        F.lower("payment_method").alias("payment_method"),
        status.alias("payment_status"),
        "amount_cents",
        amount.alias("amount"),
        (amount * sign).cast("decimal(14,2)").alias("net_amount"),
        paid.alias("paid_ts"),
        paid.cast("date").alias("paid_date"),
    )


def int_order_lines(items: DataFrame, orders: DataFrame, products: DataFrame) -> DataFrame:
    """Lines with their order and product, and the share of the order each line carries.

    The order's total is summed map-side and travels on the order header, so the lines are
    shuffled once and a huge order is never one window partition. Whole cents keep the float
    sum exact in any order.
    """
    cents = (F.col("line_amount") * 100).cast("double")
    totals = items.groupBy("order_id").agg(F.sum(cents).alias("order_cents"))
    header = orders.select(
        "order_id", "customer_id", "order_date", "order_month", F.col("status").alias("order_status"), "channel"
    ).join(totals, "order_id")
    catalogue = products.select("product_id", "sku", "category_name")
    joined = items.join(header, "order_id").join(catalogue, "product_id", "left")
    return joined.select(
        "order_item_id", "order_id", "customer_id", "order_date", "order_month", "order_status", "channel",
        "product_id", "sku", "category_name", "quantity", "unit_price", "discount_pct", "gross_amount",
        "discount_amount", "line_amount", F.try_divide(cents, F.nullif("order_cents", F.lit(0.0))).alias("share_of_order"),
    )


def int_web_item_views(web_events: DataFrame, products: DataFrame) -> DataFrame:
    """One row per item of an event; an event without items gives none.

    The payload is parsed once with its known schema.
    """
    body = F.from_json("payload", _PAYLOAD)
    shown = (
        web_events.select("event_id", "customer_id", "event_ts", "event_type", body.alias("body"))
        .select("*", F.posexplode("body.items").alias("item_position", "item"))
        .select(
            "event_id",
            F.col("item_position").cast("bigint").alias("item_position"),
            "customer_id",
            F.col("event_ts").cast("timestamp_ntz").alias("event_ts"),
            F.lower("event_type").alias("event_type"),
            F.col("body.session_id").alias("session_id"),
            F.upper("item.sku").alias("sku"),
            F.col("item.qty").cast("decimal(38,0)").alias("quantity"),
            F.col("body.utm.source").alias("utm_source"),
            F.col("body.utm.campaign").alias("utm_campaign"),
        )
    )
    return shown.join(products.select("sku", "product_id"), "sku", "left").select(
        F.concat(F.col("event_id").cast("string"), F.lit("-"), F.col("item_position").cast("string")).alias("web_item_view_id"),
        "event_id", "item_position", "customer_id", "event_ts", "event_type", "session_id", "sku", "product_id",
        "quantity", "utm_source", "utm_campaign",
    )


def fct_orders(orders: DataFrame, customers: DataFrame, lines: DataFrame, payments: DataFrame) -> DataFrame:
    """One row per order with its line and payment totals.

    Lines and payments are summed per order before they meet the orders; those joins share one
    partitioning on order_id, and the customer lookup comes last.
    """
    line_totals = lines.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("item_count"),
        F.sum("quantity").alias("units"),
        F.sum("gross_amount").alias("gross_amount"),
        F.sum("discount_amount").alias("discount_amount"),
        F.sum("line_amount").alias("items_amount"),
    )
    payment_totals = payments.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("payment_attempts"),
        F.count_if(F.col("payment_status") == "failed").alias("failed_payments"),
        F.sum("net_amount").alias("paid_amount"),
        max_if(F.col("payment_status") == "success", F.col("paid_ts")).alias("paid_ts"),
    )
    joined = (
        orders.join(line_totals, "order_id", "left")
        .join(payment_totals, "order_id", "left")
        .join(customers.select("customer_id", "country_code"), "customer_id", "left")
    )
    money = "decimal(12,2)"
    order_total = (_zero(F.col("items_amount")) + _zero(F.col("shipping_cost"))).cast(money)
    paid = _zero(F.col("paid_amount"), money)
    settled = round_div(paid, order_total, 8, num_type=(12, 2), den_type=(12, 2), div0=True) >= 1
    return joined.select(
        "order_id", "customer_id", "country_code", "order_ts", "order_date", "order_month", "status", "channel",
        "device", "shipping_method", "coupon_code",
        F.col("coupon_code").isNotNull().alias("has_coupon"),
        "is_gift",
        _zero(F.col("item_count")).alias("item_count"),
        _zero(F.col("units")).alias("units"),
        _zero(F.col("gross_amount"), money).alias("gross_amount"),
        _zero(F.col("discount_amount"), money).alias("discount_amount"),
        _zero(F.col("items_amount"), money).alias("items_amount"),
        _zero(F.col("shipping_cost"), money).alias("shipping_amount"),
        order_total.alias("order_total"),
        paid.alias("paid_amount"),
        _zero(F.col("payment_attempts")).alias("payment_attempts"),
        _zero(F.col("failed_payments")).alias("failed_payments"),
        "paid_ts",
        iff(settled, True, False).alias("is_fully_paid"),
        iff(F.col("status").isin(*NO_REVENUE), F.lit(0), order_total).cast(money).alias("net_revenue"),
    )


def dim_customers(customers: DataFrame, orders: DataFrame, item_views: DataFrame, as_of: date = AS_OF) -> DataFrame:
    """One row per person: accounts that share an e-mail merge into the earliest signup.

    Orders and views are first summed per account, so a busy account is one row before it is
    shuffled, then credited to the person.
    """
    kept = [
        "customer_id", "first_name", "last_name", "country_code", "region", "signup_date", "signup_cohort",
        "marketing_opt_in",
    ]
    earliest = F.struct(F.col("signup_ts").isNull().alias("late"), "signup_ts", "customer_id")
    people = customers.groupBy("email").agg(
        F.min_by(F.struct(*kept), earliest).alias("person"), F.count(F.lit(1)).alias("accounts")
    )
    owner = people.select(F.col("email").alias("owner_email"), F.col("person.customer_id").alias("owner_id"))
    accounts = customers.select("customer_id", "email")
    account_map = accounts.join(owner, accounts["email"].eqNullSafe(owner["owner_email"])).select("customer_id", "owner_id")

    per_account = orders.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("lifetime_orders"),
        F.count_if(F.col("status") == "delivered").alias("delivered_orders"),
        F.count_if(F.col("status").isin(*NO_REVENUE)).alias("cancelled_or_returned_orders"),
        F.count_if("has_coupon").alias("orders_with_coupon"),
        F.sum("net_revenue").alias("lifetime_revenue"),
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
    )
    counts = ["lifetime_orders", "delivered_orders", "cancelled_or_returned_orders", "orders_with_coupon"]
    order_stats = per_account.join(account_map, "customer_id").groupBy("owner_id").agg(
        *[F.sum(c).alias(c) for c in [*counts, "lifetime_revenue"]],
        F.min("first_order_date").alias("first_order_date"),
        F.max("last_order_date").alias("last_order_date"),
    )
    views_per_account = item_views.where(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
        F.count_if(F.col("event_type") == "product_view").alias("product_views"),
        F.count_if(F.col("event_type") == "add_to_cart").alias("cart_adds"),
    )
    web_stats = views_per_account.join(account_map, "customer_id").groupBy("owner_id").agg(
        F.sum("product_views").alias("product_views"), F.sum("cart_adds").alias("cart_adds")
    )
    joined = (
        people.select("email", "accounts", "person.*")
        .join(order_stats.withColumnRenamed("owner_id", "customer_id"), "customer_id", "left")
        .join(web_stats.withColumnRenamed("owner_id", "customer_id"), "customer_id", "left")
    )
    idle = boundaries_between("day", F.col("last_order_date"), F.lit(as_of))
    segment = (
        F.when(_zero(F.col("lifetime_orders")) == 0, "prospect")
        .when(F.col("lifetime_orders") >= LOYAL_ORDERS, "loyal")
        .when(idle > LAPSED_DAYS, "lapsed")
        .otherwise("active")
    )
    return joined.select(
        "customer_id", "first_name", "last_name", "email", "country_code", "region", "signup_date", "signup_cohort",
        "marketing_opt_in",
        (F.col("accounts") - 1).alias("merged_accounts"),
        *[_zero(F.col(c)).alias(c) for c in counts],
        _zero(F.col("lifetime_revenue"), "decimal(12,2)").alias("lifetime_revenue"),
        "first_order_date",
        "last_order_date",
        idle.alias("days_since_last_order"),
        _zero(F.col("product_views")).alias("product_views"),
        _zero(F.col("cart_adds")).alias("cart_adds"),
        segment.alias("customer_segment"),
    )


def rpt_monthly_revenue(orders: DataFrame) -> DataFrame:
    """Revenue per order month and customer country.

    The share is a window over the aggregated rows, one per country and month.
    """
    monthly = orders.groupBy("order_month", "country_code").agg(
        F.count(F.lit(1)).alias("orders"),
        F.count_if(~F.col("status").isin(*NO_REVENUE)).alias("revenue_orders"),
        F.count_distinct("customer_id").alias("customers"),
        F.sum("net_revenue").cast("decimal(14,2)").alias("revenue"),
        F.sum("discount_amount").cast("decimal(14,2)").alias("discounts"),
        listagg_distinct(F.col("channel")).alias("channels"),
    )
    share = ratio_over(F.col("revenue") * 100, Window.partitionBy("order_month"))
    average = rounded_ratio(
        F.col("revenue"), F.col("revenue_orders"), 2, num_type=(14, 2), den_type=(11, 0), div0=True
    )
    return monthly.select(
        "order_month", "country_code", "orders", "revenue_orders", "customers", "revenue", "discounts",
        average.alias("avg_order_value"), F.round(share * 100, 2).alias("revenue_share_pct"), "channels",
    )


# How each model is made from its inputs; ``s`` are the sources, ``m`` the models.
RECIPES = {
    "stg_customers": lambda s, m, as_of: stg_customers(s["customers"], as_of),
    "stg_products": lambda s, m, as_of: stg_products(s["products"]),
    "stg_orders": lambda s, m, as_of: stg_orders(s["orders"]),
    "stg_order_items": lambda s, m, as_of: stg_order_items(s["order_items"]),
    "stg_payments": lambda s, m, as_of: stg_payments(s["payments"]),
    "int_order_lines": lambda s, m, as_of: int_order_lines(m["stg_order_items"], m["stg_orders"], m["stg_products"]),
    "int_web_item_views": lambda s, m, as_of: int_web_item_views(s["web_events"], m["stg_products"]),
    # The totals only need columns the staged lines already have, and only lines of an existing
    # order can join: reading them here saves the enrichment joins.
    "fct_orders": lambda s, m, as_of: fct_orders(m["stg_orders"], m["stg_customers"], m["stg_order_items"], m["stg_payments"]),
    "dim_customers": lambda s, m, as_of: dim_customers(m["stg_customers"], m["fct_orders"], m["int_web_item_views"], as_of),
    "rpt_monthly_revenue": lambda s, m, as_of: rpt_monthly_revenue(m["fct_orders"]),
}


class OnDemand(dict):
    """Frames made the first time they are asked for."""

    def __init__(self, recipes: dict, make):
        super().__init__()
        self._recipes, self._make = recipes, make

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self._make(self._recipes[name])
        return self[name]


def build(sources, as_of: date = AS_OF) -> dict[str, DataFrame]:
    """The ten models, each planned when first used; inputs are planned with it."""
    models = OnDemand(RECIPES, lambda recipe: recipe(sources, models, as_of))
    return models
