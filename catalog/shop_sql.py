"""The retail sources and models as SQL for the checking engine.

Sources are rendered from the generator's table of columns. Models are written from the output
contract alone: one fact per query, put together by keys.
"""

from __future__ import annotations

from equipoise.sources import synthetic as g


class Checking(g.Dialect):
    """The checking engine's spelling."""

    def draw(self, name: str, key: str, n) -> str:
        return f"(('0x' || substr(md5('{name}|' || {key}), 1, 12))::BIGINT % {n})"

    def moment(self, text: str) -> str:
        return f"TIMESTAMP '{text}'"

    def later(self, moment: str, seconds: str) -> str:
        return f"({moment} + to_seconds(({seconds})::BIGINT))"

    def day(self, text: str, days: str) -> str:
        return f"(DATE '{text}' + ({days})::INTEGER)"

    def rows(self, n: str) -> str:
        return f"unnest(range(1, ({n})::BIGINT + 1))"

    def id(self, value: str) -> str:
        return f"({value})::BIGINT"

    def money_of_json(self, text: str, path: str) -> str:
        return f"try_cast({text} ->> '$.{path}' AS DECIMAL(10,2))"


D = Checking()
_PARTS = "(SELECT count(*) FROM part)"


def _listed(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {g.NAMES.get(n, n)}" for n, e in columns.items())


def _steps(source: str, columns: list[dict[str, str]]) -> str:
    *steps, last = columns
    for step in steps:
        source = f"(SELECT *, {', '.join(f'{e} AS {n}' for n, e in step.items())} FROM {source})"
    return f"SELECT {_listed(last)} FROM {source}"


_LINES, _LINE = g.line_columns(D, _PARTS)
_ATTEMPTS = " UNION ALL ".join(f"SELECT {_listed(g.attempt_columns(D, k))} FROM due WHERE {when}" for k, (_, _, when) in enumerate(g.ATTEMPTS))

SOURCES = f"""
people AS (SELECT c_custkey + 1 AS id FROM customer),
goods AS (SELECT p_partkey + 1 AS id, (p_retailprice::DECIMAL(12,2) * 100)::BIGINT AS price_cents, p_name AS product_name FROM part),
heads AS (SELECT o_orderkey + 1 AS id, o_custkey + 1 AS customer_id, o_orderdate + to_seconds(o_orderkey % 86400) AS order_ts FROM orders),
clicks AS (SELECT event_id + 1 AS id, user_id + 1 AS customer_id, ts AS event_ts FROM events),
customers AS ({_steps('people', g.customer_columns(D))}),
customer_contacts AS ({_steps('people', g.contact_columns(D))}),
products AS ({_steps('goods', g.product_columns(D))}),
shop_orders AS ({_steps('heads', g.order_columns(D))}),
web_events AS ({_steps('clicks', g.event_columns(D, _PARTS))}),
drawn_lines AS (SELECT order_id, {_listed(_LINE)} FROM (SELECT order_id, {_listed(_LINES)} FROM shop_orders WHERE order_id % 350 <> 0)),
order_items AS (SELECT order_item_id, order_id, product_id, quantity, coalesce(p.unit_price, {g.old_price(D, 'product_id')}) AS unit_price, discount_pct
  FROM drawn_lines JOIN products p ON product_id = wanted),
due AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in g.payment_columns(D)[0].items())} FROM shop_orders
  JOIN (SELECT order_id, sum(round(quantity * unit_price * (1 - discount_pct * 0.01), 2)) AS items_amount FROM order_items GROUP BY order_id) USING (order_id)
  WHERE NOT {g.is_unpaid(D)}),
payments AS ({_ATTEMPTS})
"""


def exact_div(num: str, den: str, scale: int, *, num_scale: int = 2, den_scale: int = 0, div0: bool = False) -> str:
    """Half-away rounding of a quotient by integer arithmetic."""
    n = f"(abs({num}) * {10 ** num_scale})::HUGEINT * {10 ** (scale + den_scale)}"
    d = f"(abs({den}) * {10 ** den_scale})::HUGEINT * {10 ** num_scale}"
    whole = f"(2 * {n} + {d}) // (2 * {d})"
    step = f"0.{'0' * (scale - 1)}1"
    return (
        f"(CASE WHEN ({den}) = 0 THEN {'0' if div0 else 'NULL'} "
        f"ELSE (sign({num}) * sign({den}) * ({whole}))::DECIMAL(30,0) * {step} END)"
    )


# The cut-off date, category names and segment limits of the output contract.
AS_OF = "DATE '2026-06-30'"
CATEGORIES = {"EL": "Electronics", "HO": "Home & Living", "SP": "Sports", "BO": "Books", "TO": "Toys"}
LOYAL_ORDERS, LAPSED_DAYS = 15, 180

_NAMES = ", ".join(f"'{code}': '{name}'" for code, name in CATEGORIES.items())
_LOST = "status IN ('cancelled', 'returned')"
_zero = lambda column, size: f"coalesce({column}, 0)::DECIMAL({size},2)"

MODELS = f"""
stg_customers AS (
  SELECT c.* REPLACE (trim(first_name) AS first_name, trim(last_name) AS last_name, lower(trim(email)) AS email, upper(trim(country_code)) AS country_code,
      marketing_opt_in IS NOT DISTINCT FROM true AS marketing_opt_in),
    if(list_contains(['NL', 'BE', 'LU'], upper(trim(country_code))), 'Benelux', 'Rest of EU') AS region, CAST(signup_ts AS DATE) AS signup_date,
    format('{{:04d}}-{{:02d}}', year(signup_ts), month(signup_ts)) AS signup_cohort, {AS_OF} - CAST(signup_ts AS DATE) AS account_age_days
  FROM customers c),
stg_products AS (
  SELECT product_id, is_active, upper(trim(sku)) AS sku, trim(product_name) AS product_name, upper(category_code) AS category_code,
    coalesce(MAP {{{_NAMES}}}[upper(category_code)], 'Other') AS category_name, {_zero('unit_price', 10)} AS list_price, unit_price IS NULL AS is_price_missing
  FROM products),
stg_orders AS (
  SELECT order_id, customer_id, order_ts, CAST(order_ts AS DATE) AS order_date, make_date(year(order_ts), month(order_ts), 1) AS order_month,
    lower(trim(status)) AS status, lower(channel) AS channel, m.coupon AS coupon_code, m.device AS device, m.shipping.method AS shipping_method,
    try_cast(m.shipping.cost AS DECIMAL(10,2)) AS shipping_cost, coalesce(m.gift, false) AS is_gift, CAST(order_ts AS DATE) + 30 AS return_deadline
  FROM (SELECT *, from_json(order_meta, '{{"coupon":"VARCHAR","device":"VARCHAR","shipping":{{"method":"VARCHAR","cost":"VARCHAR"}},"gift":"BOOLEAN"}}') AS m FROM shop_orders)),
stg_order_items AS (
  SELECT *, (gross_amount - line_amount)::DECIMAL(18,2) AS discount_amount FROM (
    SELECT order_item_id, order_id, product_id, quantity, unit_price, discount_pct, (quantity * unit_price)::DECIMAL(18,2) AS gross_amount,
      round(quantity * unit_price * (1 - discount_pct * 0.01), 2)::DECIMAL(18,2) AS line_amount FROM order_items)),
stg_payments AS (
  SELECT *, (amount * coalesce(MAP {{'success': 1, 'refunded': -1}}[payment_status], 0))::DECIMAL(14,2) AS net_amount FROM (
    SELECT payment_id, order_id, lower(payment_method) AS payment_method, lower(status) AS payment_status, amount_cents,
      (amount_cents * 0.01)::DECIMAL(12,2) AS amount, paid_ts, CAST(paid_ts AS DATE) AS paid_date FROM payments)),
sums AS (SELECT order_id, sum(CAST(line_amount * 100 AS DOUBLE)) AS cents FROM stg_order_items GROUP BY order_id),
int_order_lines AS (
  SELECT order_item_id, order_id, o.customer_id, o.order_date, o.order_month, o.status AS order_status, o.channel, product_id, p.sku, p.category_name,
    quantity, unit_price, discount_pct, gross_amount, discount_amount, line_amount, if(cents = 0, NULL, CAST(line_amount * 100 AS DOUBLE) / cents) AS share_of_order
  FROM stg_order_items JOIN sums USING (order_id) JOIN stg_orders o USING (order_id) LEFT JOIN stg_products p USING (product_id)),
int_web_item_views AS (
  SELECT concat_ws('-', event_id, pos - 1) AS web_item_view_id, event_id, pos - 1 AS item_position, customer_id, event_ts, event_type, session_id,
    upper(item.sku) AS sku, p.product_id, item.qty AS quantity, utm_source, utm_campaign
  FROM (SELECT event_id, customer_id, event_ts, lower(event_type) AS event_type, w.session_id, w.utm.source AS utm_source, w.utm.campaign AS utm_campaign,
      unnest(w.items) AS item, generate_subscripts(w.items, 1) AS pos
    FROM (SELECT *, from_json(payload, '{{"session_id":"VARCHAR","utm":{{"source":"VARCHAR","campaign":"VARCHAR"}},"items":[{{"sku":"VARCHAR","qty":"BIGINT"}}]}}') AS w FROM web_events))
  LEFT JOIN stg_products p ON p.sku = upper(item.sku)),
booked AS (
  SELECT order_id, 1 AS lines, quantity, gross_amount, discount_amount, line_amount, NULL AS payment_status, NULL AS net_amount, NULL AS paid_ts FROM stg_order_items
  UNION ALL SELECT order_id, 0, NULL, NULL, NULL, NULL, payment_status, net_amount, paid_ts FROM stg_payments),
fct_orders AS (
  SELECT *, if(order_total = 0, false, {exact_div('paid_amount', 'order_total', 8, den_scale=2)} >= 1) AS is_fully_paid, if({_LOST}, 0, order_total)::DECIMAL(12,2) AS net_revenue
  FROM (SELECT o.order_id, o.customer_id, any_value(c.country_code) AS country_code, o.order_ts, o.order_date, o.order_month, o.status, o.channel, o.device, o.shipping_method,
      o.coupon_code, o.coupon_code IS NOT NULL AS has_coupon, o.is_gift, coalesce(sum(b.lines), 0)::BIGINT AS item_count, coalesce(sum(b.quantity), 0)::BIGINT AS units,
      {_zero('sum(b.gross_amount)', 12)} AS gross_amount, {_zero('sum(b.discount_amount)', 12)} AS discount_amount, {_zero('sum(b.line_amount)', 12)} AS items_amount,
      {_zero('o.shipping_cost', 12)} AS shipping_amount, ({_zero('sum(b.line_amount)', 12)} + {_zero('o.shipping_cost', 12)})::DECIMAL(12,2) AS order_total,
      {_zero('sum(b.net_amount)', 12)} AS paid_amount, count(b.payment_status) AS payment_attempts, count(*) FILTER (WHERE b.payment_status = 'failed') AS failed_payments,
      max(b.paid_ts) FILTER (WHERE b.payment_status = 'success') AS paid_ts
    FROM stg_orders o LEFT JOIN booked b USING (order_id) LEFT JOIN stg_customers c ON c.customer_id = o.customer_id
    GROUP BY o.order_id, o.customer_id, o.order_ts, o.order_date, o.order_month, o.status, o.channel, o.device, o.shipping_method, o.coupon_code, o.is_gift, o.shipping_cost)),
persons AS (SELECT email, arg_min(customer_id, (signup_ts, customer_id)) AS customer_id, count(*) - 1 AS merged_accounts FROM stg_customers GROUP BY email),
lives AS (
  SELECT email, count(order_id) AS lifetime_orders, count(*) FILTER (WHERE status = 'delivered') AS delivered_orders, count(*) FILTER (WHERE {_LOST}) AS cancelled_or_returned_orders,
    count(*) FILTER (WHERE has_coupon) AS orders_with_coupon, {_zero('sum(net_revenue)', 12)} AS lifetime_revenue, min(order_date) AS first_order_date, max(order_date) AS last_order_date
  FROM stg_customers LEFT JOIN fct_orders USING (customer_id) GROUP BY email),
looks AS (
  SELECT email, count(*) FILTER (WHERE event_type = 'product_view') AS product_views, count(*) FILTER (WHERE event_type = 'add_to_cart') AS cart_adds
  FROM stg_customers LEFT JOIN int_web_item_views USING (customer_id) GROUP BY email),
dim_customers AS (
  SELECT customer_id, first_name, last_name, email, country_code, region, signup_date, signup_cohort, marketing_opt_in, merged_accounts, lives.* EXCLUDE (email),
    {AS_OF} - last_order_date AS days_since_last_order, product_views, cart_adds,
    CASE WHEN lifetime_orders >= {LOYAL_ORDERS} THEN 'loyal' WHEN lifetime_orders = 0 THEN 'prospect' WHEN {AS_OF} - last_order_date <= {LAPSED_DAYS} THEN 'active' ELSE 'lapsed' END AS customer_segment
  FROM persons JOIN stg_customers USING (customer_id, email) JOIN lives USING (email) JOIN looks USING (email)),
rpt_monthly_revenue AS (
  WITH months AS (
    SELECT order_month, country_code, count(*) AS orders, count(*) FILTER (WHERE NOT {_LOST}) AS revenue_orders, count(DISTINCT customer_id) AS customers,
      sum(net_revenue)::DECIMAL(14,2) AS revenue, sum(discount_amount)::DECIMAL(14,2) AS discounts, array_to_string(list_sort(list(DISTINCT channel)), ',') AS channels
    FROM fct_orders GROUP BY ALL),
  totals AS (SELECT order_month, sum(CAST(revenue * 100 AS DOUBLE)) AS month_cents FROM months GROUP BY ALL)
  SELECT months.*, round({exact_div('revenue', 'revenue_orders', 8, div0=True)}, 2)::DECIMAL(18,2) AS avg_order_value,
    round(100 * (CAST(revenue * 100 AS DOUBLE) / nullif(month_cents, 0)), 2)::DECIMAL(9,2) AS revenue_share_pct
  FROM months JOIN totals USING (order_month))
"""


def source_sql(name: str) -> str:
    return f"WITH {SOURCES} SELECT * FROM {'shop_orders' if name == 'orders' else name}"


def model_sql(name: str) -> str:
    return f"WITH {SOURCES}, {MODELS} SELECT * FROM {name}"


def model_query(select: str) -> str:
    return f"WITH {SOURCES}, {MODELS} {select}"
