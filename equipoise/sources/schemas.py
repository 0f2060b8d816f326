"""Declared source tables of the retail project."""

from __future__ import annotations

# Column names and types are fixed by the source system's unload.
SOURCE_SCHEMAS = {
    "customers": (
        "customer_id decimal(38,0), first_name string, last_name string, email string, "
        "country_code string, signup_ts timestamp_ntz, marketing_opt_in boolean"
    ),
    "customer_contacts": "customer_id decimal(38,0), phone string, iban string, date_of_birth date",
    "products": (
        "product_id decimal(38,0), sku string, product_name string, category_code string, "
        "unit_price decimal(10,2), is_active boolean"
    ),
    "orders": (
        "order_id decimal(38,0), customer_id decimal(38,0), order_ts timestamp_ntz, status string, "
        "channel string, order_meta string"
    ),
    "order_items": (
        "order_item_id decimal(38,0), order_id decimal(38,0), product_id decimal(38,0), "
        "quantity decimal(38,0), unit_price decimal(10,2), discount_pct decimal(5,2)"
    ),
    "payments": (
        "payment_id decimal(38,0), order_id decimal(38,0), payment_method string, "
        "amount_cents decimal(38,0), status string, paid_ts timestamp_ntz"
    ),
    "web_events": (
        "event_id decimal(38,0), customer_id decimal(38,0), event_ts timestamp_ntz, event_type string, payload string"
    ),
}

# Tables that carry personal data; no model, test or query may read them.
FORBIDDEN = ("customer_contacts",)
