"""Scans, sinks, ingest, export names and the generated retail project."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from equipoise.operators.parity import ParitySpec, run_specs
from equipoise.plans import closure, governance, retail, retail_tests
from equipoise.session import cut_lineage
from equipoise.sources import exports, synthetic, tables
from equipoise.sources.schemas import FORBIDDEN, SOURCE_SCHEMAS


def test_export_names(spark):
    files = [
        ("raw", "CUSTOMERS.parquet", "customers.parquet"), ("raw", "customers_0_0_0.snappy.parquet", "customers.parquet"),
        ("raw", "orders.parquet_0_0_0.snappy.parquet", "orders.parquet"), ("raw", "plain", "plain.parquet"),
        ("raw", "raw_items.gz", "items.parquet"), ("expected", "sf_fct.zst", "fct.parquet"), ("expected", "raw_x.parquet", "raw_x.parquet"),
        ("raw", "raw_", "raw_.parquet"), ("raw", "weird name!.parquet", None), ("raw", "9lives.parquet", None), ("raw", "t_1_2_3_4.parquet", "t_1.parquet"),
    ]
    df = spark.createDataFrame([(k, f) for k, f, _ in files], "kind string, file_name string")
    got = {(r.kind, r.file_name): r for r in exports.named_exports(df).collect()}
    assert {k: r["name"] for k, r in got.items()} == {(k, f): n for k, f, n in files}
    assert got["raw", "CUSTOMERS.parquet"]["status"] == "name clash" and got["raw", "plain"]["status"] == "ok"
    assert got["raw", "weird name!.parquet"]["status"] == "no table name"
    present = spark.createDataFrame([("raw", "a.parquet"), ("raw", "old.parquet")], "kind string, name string")
    planned = spark.createDataFrame([("raw", "a.parquet"), ("raw", "b.parquet")], "kind string, name string")
    assert rows(exports.check_exports(present, planned)) == [("raw", "b.parquet", "missing"), ("raw", "old.parquet", "not planned")]


def test_catalog_ingest_and_status(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    tables.write_table(df, f"{tmp_path}/orders.parquet")
    catalog = tables.Catalog(spark, str(tmp_path), forbidden=("main.raw_secret",))
    assert rows(catalog.scan("orders")) == [(1, "a"), (2, "b")]
    with pytest.raises(tables.ForbiddenTable):
        catalog.scan("raw_secret")
    guarded = tables.Catalog(spark, str(tmp_path), SOURCE_SCHEMAS, FORBIDDEN)
    with pytest.raises(tables.ForbiddenTable):
        guarded.scan("raw_customer_contacts")
    report = tables.ingest(spark, {"orders": f"{tmp_path}/orders.parquet"}, f"{tmp_path}/main")
    assert rows(report) == [("raw_orders", 2, 2, True)]
    load = {("main", "raw_orders"): lambda: spark.read.parquet(f"{tmp_path}/main/raw_orders"), ("main", "gone"): lambda: spark.read.parquet(f"{tmp_path}/none")}
    got = {r.table_name: (r.row_count, r.error is None) for r in tables.relation_status(spark, load).collect()}
    assert got == {"raw_orders": (2, True), "gone": (None, False)}
    bad = {**load, ("main", "late"): lambda: df.select(F.raise_error(F.lit("boom")).alias("x")).where("x is not null")}
    got = {r.table_name: (r.row_count, r.error is None) for r in tables.relation_status_checked(spark, bad).collect()}
    assert got == {"raw_orders": (2, True), "gone": (None, False), "late": (None, False)}
    merged, path = tables.write_incremental(f"{tmp_path}/orders.parquet", spark.createDataFrame([(2, "new"), (3, "c")], "k int, v string"), ["k"])
    assert rows(merged) == [(1, "a"), (2, "new"), (3, "c")] and rows(spark.read.parquet(f"{tmp_path}/orders.parquet")) == [(1, "a"), (2, "b")]
    assert tables.create_view(df, "seen").sparkSession.sql("select count(*) from seen").first()[0] == 2
    assert [tuple(r) for r in tables.source_types(spark, {"t": df, "p": df}, protected=("p",)).collect()] == [("t", 1, "k", "int", df.count(), df.where("k is null").count()), ("t", 2, "v", "string", df.count(), df.where("v is null").count())]
    assert tables.source_types(spark, {"p": df}, protected=("p",)).count() == 0


def test_unload_encodes_nested_columns(spark, tmp_path):
    df = spark.sql("select 1 k, named_struct('a', 1, 'b', array('x')) s, map('m', 2) m, parse_json('[1,{}]') v")
    tables.unload(df, f"{tmp_path}/out", row_bytes=50, estimated_bytes=100)
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == [(1, '{"a":1,"b":["x"]}', '{"m":2}', "[1,{}]")]


def test_shared_folder_comes_from_the_session(spark, tmp_path, monkeypatch):
    conf = spark.sparkContext.getConf().set("spark.checkpoint.dir", str(tmp_path))
    monkeypatch.setattr(spark.sparkContext, "getConf", lambda: conf)
    df = cut_lineage(spark.range(5))
    assert df.inputFiles() and all(str(tmp_path) in f for f in df.inputFiles()) and df.count() == 5


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("c", None)], "node string, parent string")
    got = closure.upstream(edges, spark.createDataFrame([("a",)], "node string"))
    assert rows(got) == [("a", 0), ("b", 1), ("c", 2)]
    with pytest.raises(ValueError):
        closure.upstream(edges, spark.createDataFrame([("a",)], "node string"), max_depth=1)


def shortest(edges, start):
    depth, frontier, level = dict.fromkeys(start, 0), list(start), 0
    while frontier:
        level += 1
        frontier = list(dict.fromkeys(b for a, b in edges if a in set(frontier) and b is not None and b not in depth))
        depth |= dict.fromkeys(frontier, level)
    return sorted(depth.items())


def test_closure_of_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds, further = [], closure._further
    monkeypatch.setattr(closure, "_further", lambda *a: rounds.append(a[2]) or further(*a))
    edges = [(f"n{i}", f"n{i + 1}") for i in range(999)]
    got = closure.upstream(spark.createDataFrame(edges, "node string, parent string"), spark.createDataFrame([("n0",)], "node string"))
    assert rows(got) == shortest(edges, ["n0"]) and len(rounds) <= 12


@pytest.mark.parametrize("wide", [1, 64])
def test_closure_of_a_graph_with_hubs(spark, monkeypatch, wide):
    """Shortest depths with hubs, short cuts and cycles, however few paths may be joined."""
    monkeypatch.setattr(closure, "WIDE", wide)
    draw = random.Random(4)
    edges = [(f"a{i}", "hub") for i in range(30)] + [("hub", f"b{i}") for i in range(30)] + [(f"b{i}", f"c{draw.randrange(30)}") for i in range(30)]
    edges += [(f"c{i}", f"c{i + 1}") for i in range(30)] + [("c30", "c3"), ("c9", "c27"), ("c30", "hub"), ("x", "x"), ("a1", "a1")]
    got = closure.upstream(spark.createDataFrame(edges, "node string, parent string"), spark.createDataFrame([("a1",), ("a2",), ("lone",)], "node string"))
    assert rows(got) == shortest(edges, ["a1", "a2", "lone"])
    assert rows(closure.upstream(spark.createDataFrame(edges, "node string, parent string"), spark.createDataFrame([], "node string"))) == []


def test_governance(spark):
    df = spark.createDataFrame([("NL12DEMO345", "+31 6"), ("abc", None)], "iban string, phone string")
    assert rows(governance.masked(df, {"iban": "partial", "phone": "full"})) == [("***", None), ("*******O345", "****")]
    corpus = spark.createDataFrame(
        [("m.sql", "select 1\nfrom RAW_SECRET -- x"), ("ok.sql", "-- raw_secret\nselect raw_secrets"), ("s.sql", "{{ source('raw', 'secret') }}")],
        "path string, text string",
    )
    found = governance.forbidden_reads(corpus, ["main.raw_secret"], {"main.raw_secret": [("raw", "secret")]})
    assert rows(found) == [("m.sql", 2), ("s.sql", 1)]
    stripped = governance.strip_bodies(spark.createDataFrame([("v", "select 1"), ("w", ""), ("x", None)], "name string, view_definition string"))
    assert rows(stripped) == [("v", True), ("w", False), ("x", False)]
    flagged = spark.createDataFrame([("s", "a", {"PII": "yes"}), ("s", "b", {"pii": "false"}), ("s", "c", {"x": "1"})], "source string, table_name string, meta map<string,string>")
    assert rows(governance.pii_tables(flagged)) == [("s", "a")]


@pytest.fixture(scope="module")
def project(spark):
    made = synthetic.retail_sources(spark, n_customers=600, n_products=60, n_orders=2500, n_events=1500, buyers=550)
    sources = {name: cut_lineage(df) for name, df in made.items()}
    return sources, retail.build(sources)


def test_generated_sources_hold_the_planted_defects(spark, project):
    sources, _ = project
    for name, schema in SOURCE_SCHEMAS.items():
        declared = spark.createDataFrame([], schema).schema
        assert [(f.name, f.dataType) for f in sources[name].schema] == [(f.name, f.dataType) for f in declared], name
    c = sources["customers"]
    assert c.where("marketing_opt_in is null").count() > 10 and c.where("first_name <> trim(first_name)").count() > 0 and c.where("last_name <> trim(last_name)").count() > 0
    assert c.where("email <> lower(trim(email))").count() > 10 and c.where("country_code <> upper(country_code)").count() > 10
    assert c.selectExpr("lower(trim(email)) e").distinct().count() == 600 - 600 // 40
    p = sources["products"]
    assert p.where("unit_price is null or sku <> upper(sku)").count() > 0 and p.where("not is_active").count() > 0
    o = sources["orders"]
    assert o.where("status <> lower(trim(status))").count() > 300 and o.where("order_meta like '%n/a%'").count() > 10
    assert o.where("order_meta like '%\"coupon\":null%'").count() > 100 and o.where("order_meta not like '%coupon%'").count() > 1000
    i = sources["order_items"]
    assert i.where("order_id % 350 = 0").count() == 0 and 2 < i.count() / 2500 < 4
    assert i.where("pmod(quantity * unit_price * discount_pct * 10, 10) = 5").count() > 0
    pay = sources["payments"]
    unpaid = o.join(pay, "order_id", "left_anti").count()
    assert 50 < unpaid < 300 and pay.where("status = 'failed'").count() > 100 and pay.where("status = 'refunded'").count() > 100
    e = sources["web_events"]
    assert 0.2 < e.where("customer_id is null").count() / 1500 < 0.4 and e.where("payload like '%\"items\":[]%'").count() > 50
    assert e.where("payload like '%??.%'").count() > 10 and e.where("payload not like '%items%'").count() > 50 and e.where("payload not like '%utm%'").count() > 100
    again = synthetic.customers(synthetic.ids(spark, 600))
    assert rows(again) == rows(c)


def test_all_63_data_tests_pass(project):
    sources, models = project
    result = retail_tests.run(sources, models).collect()
    assert len(result) == 63
    assert [tuple(r) for r in result if r.failing_rows] == []


def test_models_equal_a_plain_sql_version(spark, project):
    """The marts restated as one SQL text each, compared with the parity operator."""
    sources, models = project
    for name in ("stg_customers", "stg_orders", "stg_order_items", "stg_payments", "int_web_item_views", "fct_orders"):
        models[name].createOrReplaceTempView(name)
    answers = {
        "dim_customers": """
            with m as (select customer_id, first_value(customer_id) over (partition by email order by signup_ts, customer_id) o, count(*) over (partition by email) n from stg_customers)
            select o as customer_id, any_value(n) - 1 as merged_accounts, count(order_id) as lifetime_orders, coalesce(sum(net_revenue), 0) as lifetime_revenue
            from m left join fct_orders f on f.customer_id = m.customer_id group by o""",
        "rpt_monthly_revenue": """
            select order_month, country_code, count(*) as orders, count(distinct customer_id) as customers, sum(net_revenue) as revenue,
              array_join(sort_array(collect_set(channel)), ',') as channels from fct_orders group by 1, 2""",
    }
    load = lambda rel: models[rel].select(spark.sql(answers[rel]).columns) if rel in answers else spark.sql(answers[rel[3:]])
    report = run_specs(spark, [ParitySpec(n, n, f"sf_{n}", tuple(retail.KEYS[n])) for n in answers], load)
    assert {r["model"]: r["status"] for r in report.models.collect()} == {n: "match" for n in answers}


def test_tiny_orders_to_the_cent(spark):
    make = spark.createDataFrame
    from datetime import datetime as at
    from decimal import Decimal as D

    sources = {
        "customers": make([(D(1), " Una", "Vos ", "U@V.NL ", "nl", at(2025, 1, 2, 10), None), (D(2), "Uma", "Voss", "u@v.nl", "DE", at(2025, 3, 7, 14, 5, 9), True)], SOURCE_SCHEMAS["customers"]),
        "products": make([(D(1), "el-7", "Lamp", "el", D("10.20"), True), (D(2), "zz-8", "Cord", None, None, False)], SOURCE_SCHEMAS["products"]),
        "orders": make([
            (D(1), D(1), at(2025, 3, 7, 14, 5, 9), "Placed", "Web", '{"coupon":"FIVE","device":"ios","shipping":{"method":"express","cost":"4.95"},"gift":true}'),
            (D(2), D(2), at(2025, 4, 1, 9), "delivered", "app", "{}"), (D(3), D(2), at(2025, 4, 2, 9), "Returned ", "app", '{"coupon":null,"shipping":{"cost":"n/a"}}'),
        ], SOURCE_SCHEMAS["orders"]),
        "order_items": make([(D(1), D(1), D(1), D(3), D("10.20"), D("12.50")), (D(2), D(1), D(2), D(1), D("5.00"), D("0.00")), (D(3), D(2), D(1), D(2), D("10.20"), D("0.00"))], SOURCE_SCHEMAS["order_items"]),
        "payments": make([(D(1), D(1), "Card", D(3673), "Success", at(2025, 3, 7, 15)), (D(2), D(1), "Card", D(3673), "Failed", None), (D(3), D(2), "card", D(2040), "Refunded", at(2025, 4, 2, 9))], SOURCE_SCHEMAS["payments"]),
        "web_events": make([
            (D(1), D(1), at(2025, 3, 1, 10), "Product_View", '{"session_id":"q1","utm":{"source":"mail","campaign":"may"},"items":[{"sku":"el-7","qty":2},{"sku":"no-1","qty":1}]}'),
            (D(2), None, at(2025, 3, 2, 10), "add_to_cart", '{"session_id":"q2","items":[]}'), (D(3), D(2), at(2025, 3, 3, 10), "checkout", '{"session_id":"q3"}'),
        ], SOURCE_SCHEMAS["web_events"]),
    }
    m = retail.build(sources)
    facts = {int(r.order_id): r for r in m["fct_orders"].collect()}
    assert (facts[1].items_amount, facts[1].order_total, facts[1].paid_amount, facts[1].is_fully_paid) == (D("31.78"), D("36.73"), D("36.73"), True)
    assert (facts[1].payment_attempts, facts[1].failed_payments, facts[1].has_coupon) == (2, 1, True)
    assert (facts[2].paid_amount, facts[2].is_fully_paid, facts[2].net_revenue) == (D("-20.40"), False, D("20.40"))
    assert (facts[3].item_count, facts[3].order_total, facts[3].net_revenue, facts[3].has_coupon, facts[3].status) == (0, D("0.00"), D("0.00"), False, "returned")
    assert [(r.web_item_view_id, r.sku, r.product_id, int(r.quantity)) for r in m["int_web_item_views"].orderBy("item_position").collect()] == [
        ("1-0", "EL-7", D(1), 2), ("1-1", "NO-1", None, 1)
    ]
    people = m["dim_customers"].collect()
    assert [(int(p.customer_id), p.merged_accounts, p.lifetime_orders, p.email, p.customer_segment, p.product_views) for p in people] == [(1, 1, 3, "u@v.nl", "lapsed", 2)]
    shares = {int(r.order_item_id): r.share_of_order for r in m["int_order_lines"].collect()}
    assert shares[3] == 1.0 and shares[1] + shares[2] == pytest.approx(1.0)
    april = [r for r in m["rpt_monthly_revenue"].collect() if r.order_month.month == 4][0]
    assert (april.orders, april.revenue_orders, april.customers, april.avg_order_value, april.revenue_share_pct, april.channels) == (2, 1, 1, D("20.40"), 100.0, "app")


def test_a_choice_draws_once(spark):
    """Spark's form of a choice has one draw and gives the value that the CASE of other engines gives."""
    weights = {"a": 3, "b": 1, "c": 2}
    short, spelled = synthetic.InSpark(), synthetic.Dialect()
    assert short.choose("x", "k", weights).count("md5") == 1
    df = spark.range(500).selectExpr("cast(id as string) as k").selectExpr(f"{short.choose('x', 'k', weights)} as a", f"{spelled.choose('x', 'k', weights)} as b", f"{short.choose('y', 'k', {'1': 2, '5': 3}, '')} as m", f"{spelled.choose('y', 'k', {'1': 2, '5': 3}, '')} as n")
    assert df.where("a <=> b and m <=> n").count() == 500
