"""Deterministic retail data with planted defects, from one table of columns.

A column is an SQL expression over the row's id, in the part of SQL that engines share; what they
spell differently (draws, time steps, rows from a number) comes from a ``Dialect``. So the same table
of columns makes the data on Spark and rebuilds it anywhere else. A draw is the MD5 of table, column
and key, so columns are independent and a rebuild gives the same rows. No window is needed, and a
shuffle only where a table looks values up in another.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What the project's column contracts and data tests accept.
COUNTRY_WEIGHTS = {"NL": 30, "BE": 18, "DE": 20, "FR": 12, "IT": 9, "PL": 7, "SE": 4}
CATEGORY_WEIGHTS = {"EL": 3, "HO": 2, "SP": 2, "BO": 2, "TO": 1}
STATUS_WEIGHTS = {"delivered": 52, "shipped": 16, "placed": 12, "cancelled": 11, "returned": 9}
CHANNEL_WEIGHTS = {"web": 46, "app": 38, "marketplace": 16}
EVENT_WEIGHTS = {"product_view": 45, "add_to_cart": 22, "page_view": 20, "checkout": 13}

# Free choices.
GIVEN = {"Noor": 3, "Milan": 3, "Esra": 2, "Tobias": 2, "Ravi": 1, "Annelies": 1, "Kofi": 1}
FAMILY = {"Okafor": 2, "Lindqvist": 2, "de Wit": 3, "Moreau": 2, "Kowal": 1, "Rossi": 1, "Ahmadi": 1}
HOSTS = {"mail.example": 5, "post.example": 3, "box.example": 2}
THINGS = {"kettle": 3, "notebook": 2, "rope": 1, "puzzle": 2, "headset": 2, "bench": 1}
COUPON_CODES = {"FIVEOFF": 4, "TENOFF": 2, "SHIPFREE": 1}
SCREENS = {"phone": 6, "laptop": 3, "tablet": 1}
PAY_WITH = {"card": 5, "transfer": 3, "wallet": 2}
ORIGINS = {"search": 5, "mailing": 3, "affiliate": 1}
ACTIONS = {"launch": 2, "clearance": 2, "birthday": 1}
DISCOUNTS = {"0": 50, "7.5": 14, "12.5": 16, "20": 14, "33.33": 6}
AMOUNTS = {"1": 60, "2": 22, "3": 12, "6": 6}
LINES = {"1": 30, "2": 28, "3": 22, "4": 12, "5": 8}
SHIPPING = {"3.50": 60, "0": 25, "7.95": 15}
DAY = 86_400
MOST_ITEMS = 4


class Dialect:
    """Spark's spelling of what engines spell differently."""

    def draw(self, name: str, key: str, n) -> str:
        """A number in [0, n) from the column's name and the key."""
        return f"(cast(conv(substr(md5('{name}|' || {key}), 1, 12), 16, 10) as bigint) % {n})"

    def moment(self, text: str) -> str:
        return f"timestamp_ntz '{text}'"

    def later(self, moment: str, seconds: str) -> str:
        return f"({moment} + make_dt_interval(0, 0, 0, cast({seconds} as decimal(18,6))))"

    def day(self, text: str, days: str) -> str:
        return f"date_add(date '{text}', cast({days} as int))"

    def rows(self, n: str) -> str:
        return f"explode(sequence(1, cast({n} as int)))"

    def id(self, value: str) -> str:
        return f"cast({value} as decimal(38,0))"

    def money_of_json(self, text: str, path: str) -> str:
        return f"try_cast(get_json_object({text}, '$.{path}') as decimal(10,2))"

    # What follows reads the same everywhere.

    def text(self, value: str) -> str:
        return f"cast({value} as string)"

    def chance(self, name: str, key: str, percent: int) -> str:
        return f"({self.draw(name, key, 100)} < {percent})"

    def choose(self, name: str, key: str, weights: dict[str, int], quote: str = "'") -> str:
        """A value by weight."""
        bounds, values = list(accumulate(weights.values())), [f"{quote}{v}{quote}" for v in weights]
        at = self.draw(name, key, bounds[-1])
        arms = " ".join(f"when {at} < {bound} then {value}" for bound, value in zip(bounds[:-1], values[:-1], strict=True))
        return f"case {arms} else {values[-1]} end"

    def digits(self, name: str, key: str, width: int) -> str:
        return f"lpad({self.text(self.draw(name, key, 10**width))}, {width}, '0')"

    def capital(self, value: str) -> str:
        return f"(upper(substr({value}, 1, 1)) || substr({value}, 2))"

    def json(self, **members: str) -> str:
        """An object; a member that is NULL is left out."""
        listed = ", ".join(f"""'"{name}":' || {value}""" for name, value in members.items())
        return f"('{{' || concat_ws(',', {listed}) || '}}')"

    def sku(self, product: str) -> str:
        return f"({self.choose('products.category', self.text(product), CATEGORY_WEIGHTS)} || '.' || lpad({self.text(product)}, 9, '0'))"


class InSpark(Dialect):
    """What Spark runs: the same values from shorter code, since a compiled plan with a draw in every arm of a CASE is too long to run fast."""

    def choose(self, name: str, key: str, weights: dict[str, int], quote: str = "'") -> str:
        """A value by weight, looked up in a constant array with each value as often as it weighs: one draw, whatever the number of values."""
        listed = ", ".join(f"{quote}{v}{quote}" for v, weight in weights.items() for _ in range(weight))
        return f"array({listed})[cast({self.draw(name, key, sum(weights.values()))} as int)]"


def _string(value: str) -> str:
    return f"""('"' || {value} || '"')"""


def customer_columns(d: Dialect) -> list[dict[str, str]]:
    """From id. Every 40th is a second account of the one 19 before it."""
    own = d.text("person")
    mail = f"(lower(given) || '_' || {own} || '@' || {d.choose('customers.host', own, HOSTS)})"
    return [
        {"person": "case when id % 40 = 0 then id - 19 else id end"},
        {"given": d.choose("customers.given", own, GIVEN), "family": d.choose("customers.family", own, FAMILY), "land": d.choose("customers.country", own, COUNTRY_WEIGHTS),
         "joined": d.later(d.moment("2022-05-01 06:00:00"), d.draw("customers.joined", own, 1000 * DAY)), "slip": d.draw("customers.slip", d.text("id"), 60)},
        {"mail": mail},
        {
            "customer_id": d.id("id"),
            "first_name": "case when slip = 1 then ' ' || given else given end",
            "last_name": "case when slip = 2 then family || '   ' else family end",
            "email": f"case when person = id then case when slip in (3, 4) then {d.capital('mail')} else mail end when slip < 30 then upper(mail) else ' ' || mail end",
            "country_code": "case when slip in (5, 6, 7) then lower(land) else land end",
            "signup_ts": f"case when person = id then joined else {d.later('joined', f'(11 + slip) * {3 * DAY}')} end",
            "marketing_opt_in": f"case when slip < 56 then {d.chance('customers.opt_in', d.text('id'), 45)} end",
        },
    ]


def contact_columns(d: Dialect) -> list[dict[str, str]]:
    own = d.text("id")
    return [
        {
            "customer_id": d.id("id"),
            "phone": f"case when {d.chance('contacts.none', own, 92)} then '06-' || {d.digits('contacts.phone', own, 8)} end",
            "iban": f"'XX00TEST' || {d.digits('contacts.account', own, 11)}",
            "date_of_birth": d.day("1944-03-01", d.draw("contacts.birth", own, 22_000)),
        }
    ]


def product_columns(d: Dialect) -> list[dict[str, str]]:
    """From id, price_cents, product_name. Every fifth price makes an odd number of pieces at 12.5 % end on half a cent."""
    cents = "case when id % 5 = 0 then price_cents - price_cents % 16 + 12 else price_cents end"
    return [
        {"fault": d.draw("products.fault", d.text("id"), 40)},
        {
            "product_id": d.id("id"),
            "sku": f"case when fault in (0, 1, 2) then lower({d.sku('id')}) else {d.sku('id')} end",
            "name": "case when fault = 3 then product_name || ' ' else product_name end",
            "category_code": d.choose("products.category", d.text("id"), CATEGORY_WEIGHTS),
            "unit_price": f"case when fault <> 4 then cast(cast({cents} as decimal(12,0)) * 0.01 as decimal(10,2)) end",
            "is_active": d.chance("products.active", d.text("id"), 88),
        },
    ]


def order_columns(d: Dialect) -> list[dict[str, str]]:
    """From id, customer_id, order_ts."""
    own = d.text("id")
    coupon = f"case when extra < 55 then cast(null as string) when extra < 70 then 'null' else {_string(d.choose('orders.coupon', own, COUPON_CODES))} end"
    cost = f"case when fault = 0 then 'n/a' else {d.choose('orders.cost', own, SHIPPING)} end"
    way = f"case when {d.chance('orders.fast', own, 18)} then 'express' else 'standard' end"
    meta = d.json(
        shipping=f"case when fault <> 1 then {d.json(cost=_string(cost), method=_string(way))} end",
        device=f"case when fault <> 2 then {_string(d.choose('orders.device', own, SCREENS))} end",
        gift=f"case when extra % 8 <> 0 then {d.text(d.chance('orders.gift', own, 12))} end",
        coupon=coupon,
    )
    return [
        {"fault": d.draw("orders.fault", own, 50), "extra": d.draw("orders.extra", own, 100), "state": d.choose("orders.status", own, STATUS_WEIGHTS)},
        {
            "order_id": d.id("id"),
            "buyer": d.id("customer_id"),
            "ordered": "order_ts",
            "status": f"case when extra % 6 = 1 then upper(state) when extra % 6 = 2 then {d.capital('state')} when extra % 20 = 3 then state || ' ' else state end",
            "channel": d.choose("orders.channel", own, CHANNEL_WEIGHTS),
            "order_meta": meta,
        },
    ]


def line_columns(d: Dialect, n_products) -> list[dict[str, str]]:
    """From order_id: one to five lines, none for every 350th order; the price comes from the product."""
    own = f"({d.text('order_id')} || '/' || {d.text('line_no')})"
    return [
        {"line_no": d.rows(d.choose("lines.count", d.text("order_id"), LINES, ""))},
        {
            "order_item_id": d.id("order_id * 8 + line_no"),
            "wanted": d.id(f"{d.draw('lines.product', own, n_products)} + 1"),
            "quantity": d.id(d.choose("lines.quantity", own, AMOUNTS, "")),
            "discount_pct": f"cast({d.choose('lines.discount', own, DISCOUNTS)} as decimal(5,2))",
        },
    ]


def old_price(d: Dialect, product: str) -> str:
    """What was asked for a product that has no price now."""
    return f"cast(cast({d.draw('lines.old_price', d.text(product), 9000)} + 250 as decimal(12,0)) * 0.01 as decimal(10,2))"


#: Payments of an order: what happens, when (seconds after the order), and for which orders.
ATTEMPTS = (("failed", 45, "declined"), ("success", 300, "true"), ("refunded", 9 * DAY, "state = 'returned'"))


def payment_columns(d: Dialect) -> list[dict[str, str]]:
    """From order_id, order_ts, status, order_meta, items_amount; ``due`` is what is paid."""
    return [
        {
            "due": f"items_amount + coalesce({d.money_of_json('order_meta', 'shipping.cost')}, 0)",
            "state": "lower(trim(status))",
            "declined": d.chance("payments.declined", d.text("order_id"), 9),
        }
    ]


def attempt_columns(d: Dialect, number: int) -> dict[str, str]:
    what, seconds, _ = ATTEMPTS[number]
    return {
        "payment_id": d.id(f"order_id * 4 + {number}"),
        "paid_order": "order_id",
        "payment_method": d.choose("payments.method", f"({d.text('order_id')} || '/{number}')", PAY_WITH),
        "amount_cents": d.id("due * 100"),
        "payment_status": f"'{what}'",
        "paid_ts": d.later("order_ts", str(seconds)),
    }


def is_unpaid(d: Dialect) -> str:
    return d.chance("payments.none", d.text("order_id"), 6)


def event_columns(d: Dialect, n_products) -> list[dict[str, str]]:
    """From id, customer_id, event_ts: up to MOST_ITEMS items, unknown and lower-case codes among them."""
    own = d.text("id")
    items = []
    for k in range(MOST_ITEMS):
        key = f"({own} || '/{k}')"
        code = d.sku(f"({d.draw('events.product', key, n_products)} + 1)")
        fault = d.draw("events.code", key, 24)
        spelled = f"case when {fault} = 0 then '??.' || {d.digits('events.unknown', key, 6)} when {fault} < 4 then lower({code}) else {code} end"
        items.append(f"case when shown > {k} then {d.json(qty=d.text(f'(1 + {d.draw("events.quantity", key, 4)})'), sku=_string(spelled))} end")
    listed = f"('[' || concat_ws(',', {', '.join(items)}) || ']')"
    campaign = f"case when mood % 5 = 0 then 'null' else {_string(d.choose('events.campaign', own, ACTIONS))} end"
    payload = d.json(
        utm=f"case when mood >= 18 then {d.json(campaign=campaign, source=_string(d.choose('events.origin', own, ORIGINS)))} end",
        session_id=_string(f"'visit-' || {d.digits('events.session', own, 6)}"),
        items=f"case when kind <> 'page_view' or mood % 2 = 0 then {listed} end",
    )
    return [
        {"kind": d.choose("events.kind", own, EVENT_WEIGHTS), "mood": d.draw("events.mood", own, 100)},
        {"shown": f"case kind when 'page_view' then 0 when 'product_view' then 1 else 1 + {d.draw('events.shown', own, MOST_ITEMS)} end"},
        {
            "event_id": d.id("id"),
            "visitor": f"case when {d.chance('events.known', own, 69)} then {d.id('customer_id')} end",
            "seen": "event_ts",
            "event_type": "kind",
            "payload": payload,
        },
    ]


#: Result columns where the last step's names differ, so that no step reads its own result.
NAMES = {"name": "product_name", "buyer": "customer_id", "ordered": "order_ts", "visitor": "customer_id", "seen": "event_ts", "paid_order": "order_id", "payment_status": "status"}
SPARK = InSpark()


def _made(df: DataFrame, columns: list[dict[str, str]]) -> DataFrame:
    """Each step adds its columns; the last one keeps only its own."""
    *steps, last = columns
    for step in steps:
        df = df.selectExpr("*", *[f"{e} as {n}" for n, e in step.items()])
    return df.selectExpr(*[f"{e} as {NAMES.get(n, n)}" for n, e in last.items()])


def ids(spark: SparkSession, n: int) -> DataFrame:
    """1..n, generated in parallel."""
    return spark.range(1, n + 1)


def customers(people: DataFrame) -> DataFrame:
    return _made(people, customer_columns(SPARK))


def customer_contacts(people: DataFrame) -> DataFrame:
    return _made(people, contact_columns(SPARK))


def products(goods: DataFrame) -> DataFrame:
    return _made(goods, product_columns(SPARK))


def orders(heads: DataFrame) -> DataFrame:
    return _made(heads, order_columns(SPARK))


def order_items(heads: DataFrame, catalogue: DataFrame, n_products: int) -> DataFrame:
    """A line is numbered within its order, so no numbering over all orders is needed."""
    first, last = line_columns(SPARK, n_products)
    lines = heads.where("order_id % 350 <> 0").selectExpr("order_id", *[f"{e} as {n}" for n, e in first.items()])
    drawn = lines.selectExpr("order_id", *[f"{e} as {n}" for n, e in last.items()])
    priced = drawn.join(catalogue.selectExpr("product_id", "unit_price as price"), F.col("wanted") == F.col("product_id"))
    return priced.selectExpr("order_item_id", "order_id", "product_id", "quantity", f"coalesce(price, {old_price(SPARK, 'product_id')}) as unit_price", "discount_pct")


def payments(heads: DataFrame, items: DataFrame) -> DataFrame:
    """All attempts of one order come from one row, so the orders are read and joined once."""
    line = "round(quantity * unit_price * (1 - discount_pct * 0.01), 2)"
    totals = items.groupBy("order_id").agg(F.expr(f"sum({line})").alias("items_amount"))
    (step,) = payment_columns(SPARK)
    due = heads.where(f"not {is_unpaid(SPARK)}").join(totals, "order_id").selectExpr("*", *[f"{e} as {n}" for n, e in step.items()])
    attempt = lambda k: "struct(" + ", ".join(f"{e} as {NAMES.get(n, n)}" for n, e in attempt_columns(SPARK, k).items()) + ")"
    listed = ", ".join(f"case when {when} then {attempt(k)} end" for k, (_, _, when) in enumerate(ATTEMPTS))
    return due.selectExpr(f"inline(array_compact(array({listed})))")


def web_events(clicks: DataFrame, n_products: int) -> DataFrame:
    return _made(clicks, event_columns(SPARK, n_products))


def retail_sources(spark: SparkSession, *, n_customers=2000, n_products=150, n_orders=20_000, n_events=15_000, buyers=1850) -> dict[str, DataFrame]:
    """The seven source tables at the given sizes; buyers, prices and moments are drawn too."""
    d, own = SPARK, SPARK.text("id")
    moment = lambda name: d.later(d.moment("2024-10-01 00:00:00"), d.draw(name, own, 600 * DAY))
    goods = ids(spark, n_products).selectExpr("id", f"{d.draw('goods.cents', own, 30_000)} + 150 as price_cents", f"{d.choose('goods.name', own, THINGS)} as product_name")
    heads = ids(spark, n_orders).selectExpr("id", f"{d.draw('heads.buyer', own, buyers)} + 1 as customer_id", f"{moment('heads.moment')} as order_ts")
    clicks = ids(spark, n_events).selectExpr("id", f"{d.draw('clicks.visitor', own, n_customers)} + 1 as customer_id", f"{moment('clicks.moment')} as event_ts")
    out = {
        "customers": customers(ids(spark, n_customers)), "customer_contacts": customer_contacts(ids(spark, n_customers)),
        "products": products(goods), "orders": orders(heads), "web_events": web_events(clicks, n_products),
    }
    out["order_items"] = order_items(out["orders"], out["products"], n_products)
    out["payments"] = payments(out["orders"], out["order_items"])
    return out
