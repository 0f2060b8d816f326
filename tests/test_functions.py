"""Target semantics of every scalar function, and the exact-money grids."""

from datetime import date, datetime
from decimal import ROUND_HALF_UP, Decimal as D, getcontext

import pytest
from pyspark.sql import functions as F

from conftest import rows
from equipoise.functions import aggregates as ag
from equipoise.functions import conditionals as sc
from equipoise.functions import dates as dt
from equipoise.functions import numbers as nu
from equipoise.functions import semi as js
from equipoise.functions import strings as st

getcontext().prec = 60
L = F.lit
ts = lambda s: L(s).cast("timestamp_ntz")
day = lambda s: L(s).cast("date")
dec = lambda s, t="decimal(10,2)": L(s).cast(t)
NONE = lambda: L(None).cast("int")
TEXT_NONE = lambda: L(None).cast("string")
V = '{"coupon":"SAVE10","gift":true,"n":2.5,"e":1e2,"nul":null,"arr":[1,2],"a":{"b":[10,20]},"bad":"n/a"}'

PROBES = [
    ("S1", lambda: sc.iff(L(None).cast("boolean"), "a", "b"), "b"),
    ("S2 nvl", lambda: F.nvl(TEXT_NONE(), L("x")), "x"),
    ("S2 zeroifnull", lambda: F.zeroifnull(dec(None)), D("0.00")),
    ("S2 nullifzero", lambda: F.nullifzero(L(0)), None),
    ("S2 nvl2", lambda: F.nvl2(NONE(), L(1), L(2)), 2),
    ("S2 equal_null", lambda: F.equal_null(NONE(), NONE()), True),
    ("S3", lambda: sc.decode(L("EL"), {"EL": "Electronics"}, "Other"), "Electronics"),
    ("S3 null", lambda: sc.decode(TEXT_NONE(), {None: "none", "EL": "Electronics"}, "Other"), "none"),
    ("S4 greatest", lambda: sc.greatest_strict(L(1), NONE()), None),
    ("S4 least", lambda: sc.least_strict(L(1), L(2)), 1),
    ("S4 skip", lambda: sc.greatest_ignore_nulls(L(1), NONE(), L(3)), 3),
    ("S4 least skip", lambda: sc.least_ignore_nulls(NONE(), L(3)), 3),
    ("S5 concat", lambda: F.concat(L("a"), TEXT_NONE()), None),
    ("S5 concat_ws", lambda: sc.concat_ws_strict("-", L("a"), TEXT_NONE(), L("b")), None),
    ("S5 concat_ws full", lambda: sc.concat_ws_strict("-", L("a"), L("b")), "a-b"),
    ("N4", lambda: nu.line_amount(L(1), dec("10.20"), dec("12.5")), D("8.93")),
    ("N5 up", lambda: F.round(dec("8.925", "decimal(10,3)"), 2), D("8.93")),
    ("N5 down", lambda: F.round(dec("-8.925", "decimal(10,3)"), 2), D("-8.93")),
    ("N5 even", lambda: F.bround(dec("8.925", "decimal(10,3)"), 2), D("8.92")),
    ("N6 decimal cast", lambda: dec("8.925", "decimal(10,3)").cast("decimal(12,2)"), D("8.93")),
    ("N6 integer cast", lambda: nu.to_integer(dec("2.5", "decimal(3,1)")), D("3")),
    ("N7", lambda: nu.round_div(dec("17.85"), L(2), 2), D("8.93")),
    ("N7 negative", lambda: nu.round_div(dec("-490.83"), L(6), 2), D("-81.81")),
    ("N7 zero", lambda: nu.round_div(dec("1.00"), L(0), 2), None),
    ("N7 div0", lambda: nu.round_div(dec("1.00"), L(0), 2, div0=True), D("0.00")),
    ("N7 div0 null", lambda: nu.round_div(dec(None), L(5), 2, div0=True), None),
    ("N7 null divisor", lambda: nu.round_div(dec("1.00"), NONE(), 2, div0=True), None),
    ("N7 two steps", lambda: nu.rounded_ratio(dec("45.90"), L(2), 2, div0=True), D("22.95")),
    ("N8", lambda: nu.cents_to_units(L(1234)), D("12.34")),
    ("N11 a", lambda: nu.try_to_number(L("4.95"), 10, 2), D("4.95")),
    ("N11 b", lambda: nu.try_to_number(L("4.955"), 10, 2), D("4.96")),
    ("N11 c", lambda: nu.try_to_number(L(""), 10, 2), None),
    ("N11 d", lambda: nu.try_to_number(L(" 4.95 "), 10, 2), D("4.95")),
    ("N11 e", lambda: nu.try_to_number(L("abc"), 10, 2), None),
    ("N11 f", lambda: nu.try_to_number(L("4.95")), D("5")),
    ("N11 g", lambda: nu.try_to_number(L("1,234.5"), 10, 2), None),
    ("N11 h", lambda: nu.try_to_double(L("x")), None),
    ("D2 month", lambda: dt.to_char(ts("2025-03-07 14:05:09.123456"), "YYYY-MM"), "2025-03"),
    ("D2 default", lambda: dt.timestamp_text(ts("2025-03-07 14:05:09.123456")), "2025-03-07 14:05:09.123"),
    ("D2 day first", lambda: dt.to_char(day("2025-03-07"), "DD/MM/YYYY"), "07/03/2025"),
    ("D2 names", lambda: dt.to_char(day("2025-03-07"), "DY MON"), "Fri Mar"),
    ("D2 long", lambda: dt.to_char(ts("2025-03-07 14:05:09.123456"), "YY MMMM HH24 HH12 AM MI SS FF3 FF6"), "25 March 14 02 PM 05 09 123 123456"),
    ("D3 days", lambda: dt.add_to_date("day", 30, day("2025-01-01")), date(2025, 1, 31)),
    ("D3 clamp", lambda: dt.add_to_date("month", 1, day("2025-01-31")), date(2025, 2, 28)),
    ("D3 year", lambda: dt.add_to_date("year", 1, day("2024-02-29")), date(2025, 2, 28)),
    ("D3 week", lambda: dt.add_to_date("week", 2, day("2025-01-01")), date(2025, 1, 15)),
    ("D3 ts clamp", lambda: dt.add_to_timestamp("month", 1, ts("2025-01-31 10:00:00")), datetime(2025, 2, 28, 10)),
    ("D3 ts hours", lambda: dt.add_to_timestamp("hour", -3, ts("2025-01-01 01:00:00")), datetime(2024, 12, 31, 22)),
    ("D4 day", lambda: dt.boundaries_between("day", ts("2025-01-01 23:59:00"), ts("2025-01-02 00:01:00")), 1),
    ("D4 month", lambda: dt.boundaries_between("month", day("2025-01-31"), day("2025-02-01")), 1),
    ("D4 negative", lambda: dt.boundaries_between("day", day("2025-01-05"), day("2025-01-01")), -4),
    ("D4 week", lambda: dt.boundaries_between("week", day("2025-01-05"), day("2025-01-06")), 1),
    ("D4 week same", lambda: dt.boundaries_between("week", day("2025-01-06"), day("2025-01-12")), 0),
    ("D4 week before 1970", lambda: dt.boundaries_between("week", day("1969-12-28"), day("1969-12-29")), 1),
    ("D4 hour", lambda: dt.boundaries_between("hour", ts("2025-01-01 10:59:00"), ts("2025-01-01 11:01:00")), 1),
    ("D4 year", lambda: dt.boundaries_between("year", ts("2024-12-31 23:00:00"), ts("2025-01-01 01:00:00")), 1),
    ("D4 year back", lambda: dt.boundaries_between("year", day("2025-01-01"), day("2023-12-31")), -2),
    ("D5 date", lambda: dt.trunc_date("month", day("2025-03-17")), date(2025, 3, 1)),
    ("D5 ts", lambda: dt.trunc_timestamp("month", ts("2025-03-17 10:00:00")), datetime(2025, 3, 1)),
    ("D5 week", lambda: dt.trunc_date("week", day("2025-03-09")), date(2025, 3, 3)),
    ("D6 day", lambda: dt.day_name(day("2025-03-07")), "Fri"),
    ("D6 month", lambda: dt.month_name(day("2025-03-07")), "Mar"),
    ("D6 sunday", lambda: dt.day_of_week(day("2025-03-09")), 0),
    ("D6 iso sunday", lambda: dt.day_of_week_iso(day("2025-03-09")), 7),
    ("D6 iso week", lambda: dt.week_of_year(day("2025-01-01")), 1),
    ("D7 format", lambda: dt.to_date(L("07/03/2025"), "DD/MM/YYYY"), date(2025, 3, 7)),
    ("D7 plain", lambda: dt.to_date(L("2026-06-30")), date(2026, 6, 30)),
    ("D7 parts", lambda: F.make_date(L(2025), L(3), L(7)), date(2025, 3, 7)),
    ("D7 last day", lambda: F.last_day(day("2024-02-10")), date(2024, 2, 29)),
    ("D7 epoch", lambda: dt.epoch_seconds(ts("2025-01-01 00:00:00.9")), 1735689600),
    ("D9", lambda: dt.convert_timezone("UTC", "Europe/Amsterdam", ts("2025-07-01 10:00:00")), datetime(2025, 7, 1, 12)),
    ("J1 text", lambda: js.get_text(L(V), "coupon"), "SAVE10"),
    ("J1 missing", lambda: js.get_text(L(V), "none.here"), None),
    ("J1 null", lambda: js.get_text(L(V), "nul"), None),
    ("J1 index", lambda: js.get_text(L(V), "a.b[0]"), "10"),
    ("J1 large", lambda: js.get_text(L('{"n":900000e2}'), "n"), "90000000.0"),
    ("J1 large fraction", lambda: js.get_text(L('{"n":-12345678.25}'), "n"), "-12345678.25"),
    ("J1 small", lambda: js.get_text(L('{"a":[0.00025]}'), "a[0]"), "0.00025"),
    ("J1 text like a number", lambda: js.get_text(L('{"n":"9.0E7"}'), "n"), "9.0E7"),
    ("J1 typed", lambda: js.get_typed(L(V), "n", "decimal(10,2)"), D("2.50")),
    ("J1 boolean", lambda: js.get_typed(L(V), "gift", "boolean"), True),
    ("J1 try", lambda: js.try_get_typed(L(V), "bad", "decimal(10,2)"), None),
    ("J3 size", lambda: js.array_size(L(V), "arr"), 2),
    ("J3 size of null", lambda: js.array_size(L(V), "nul"), None),
    ("J3 size of missing", lambda: js.array_size(L(V), "zip"), None),
    ("J3 is null", lambda: js.is_json_null(L(V), "nul"), True),
    ("J3 is not null", lambda: js.is_json_null(L(V), "arr"), False),
    ("J3 is missing", lambda: js.is_json_null(L(V), "zip"), None),
    ("J3 bad json", lambda: F.try_parse_json(L('{"a":')), None),
    ("J3 construct", lambda: js.object_construct(a=L(1), b=NONE()), '{"a":1}'),
    ("J3 keep", lambda: js.object_construct_keep_null(a=L(1), b=NONE()), '{"a":1,"b":null}'),
    ("J3 typeof int", lambda: js.type_of(L("1")), "INTEGER"),
    ("J3 typeof dec", lambda: js.type_of(L("1.5")), "DECIMAL"),
    ("J3 typeof text", lambda: js.type_of(L('"s"')), "VARCHAR"),
    ("J3 typeof null", lambda: js.type_of(L("null")), "NULL_VALUE"),
    ("J3 typeof array", lambda: js.type_of(L("[1]")), "ARRAY"),
    ("J3 typeof object", lambda: js.type_of(L('{"a":1}')), "OBJECT"),
    ("J4", lambda: js.get_typed(L(V), "e", "double"), 100.0),
    ("X1 no match", lambda: st.regexp_substr(L("abcdef"), "[0-9]+"), None),
    ("X1 match", lambda: st.regexp_substr(L("abc123"), "[0-9]+"), "123"),
    ("X1 anchored", lambda: st.regexp_like(L("abc123"), "[0-9]"), False),
    ("X1 whole", lambda: st.regexp_like(L("abc123"), "[a-z]+|[a-z]+[0-9]+"), True),
    ("X1 newline", lambda: st.regexp_like(L("abc\n"), "abc"), False),
    ("X1 replace all", lambda: F.regexp_replace(L("a-b-c"), "-", ""), "abc"),
    ("X2 zero", lambda: st.split_part(L("a,b,c"), ",", 0), "a"),
    ("X2 out", lambda: st.split_part(L("a,b,c"), ",", 9), ""),
    ("X2 last", lambda: st.split_part(L("a,b,c"), ",", -1), "c"),
    ("X2 split", lambda: st.split(L("a.b."), "."), ["a", "b", ""]),
    ("X2 tokens", lambda: st.tokens(L(" a  b "), " "), ["a", "b"]),
    ("X3 charindex", lambda: st.charindex("b", L("abc")), 2),
    ("X3 initcap", lambda: st.initcap(L("o'neil-smith foo_bar")), "O'neil-Smith Foo_bar".replace("-Smith", "-smith")),
    ("X4", lambda: F.md5(L("abc")), "900150983cd24fb0d6963f7d28e17f72"),
    ("X13 number text", lambda: dec("12.30").cast("string"), "12.30"),
    ("X13 boolean text", lambda: L(True).cast("string"), "true"),
]


@pytest.fixture(scope="module")
def results(spark):
    row = spark.range(1).select(*[make().alias(f"p{i}") for i, (_, make, _) in enumerate(PROBES)]).first()
    return list(row)


@pytest.mark.parametrize("i", range(len(PROBES)), ids=[p[0] for p in PROBES])
def test_probe(results, i):
    assert results[i] == PROBES[i][2]


def half_up(x: D, places: int) -> D:
    return x.quantize(D(1).scaleb(-places), rounding=ROUND_HALF_UP)


def test_line_amount_grid(spark):
    discounts = ["0", "5", "10", "12.5", "15", "33.33"]
    grid = spark.range(1, 6).selectExpr("id as q").crossJoin(spark.range(1, 4000).selectExpr("cast(id * 5 * 0.01 as decimal(10,2)) as p")).crossJoin(
        spark.createDataFrame([(D(d),) for d in discounts], "d decimal(5,2)")
    )
    got = grid.select("q", "p", "d", nu.line_amount(F.col("q"), F.col("p"), F.col("d")).alias("v")).collect()
    assert len(got) == 5 * 3999 * 6
    assert all(r.v == half_up(D(r.q) * r.p * (1 - r.d / 100), 2) for r in got)


@pytest.mark.parametrize("types", [((14, 2), (11, 0)), ((38, 2), (38, 0))], ids=["padded", "integers"])
def test_division_grid(spark, types):
    num_type, den_type = types
    grid = spark.range(-50000, 50001, 91).selectExpr("cast(id * 0.01 as decimal(38,2)) as r").crossJoin(spark.range(-3, 41).selectExpr("id as n"))
    div = lambda s: nu.round_div(F.col("r"), F.col("n"), s, num_type=num_type, den_type=den_type, div0=True)
    got = grid.select("r", "n", div(2).alias("one"), F.round(div(8), 2).alias("two")).collect()
    for r in got:
        if r.n == 0:
            assert r.one == 0 and r.two == 0
            continue
        exact = r.r / D(r.n)
        assert (r.one, r.two) == (half_up(exact, 2), half_up(half_up(exact, 8), 2))


def test_wide_division_keeps_its_scale(spark):
    big = spark.sql("select cast('999999999999999999.99' as decimal(38,2)) r, cast(7 as decimal(38,0)) n")
    got = big.select(nu.round_div(F.col("r"), F.col("n"), 8, num_type=(38, 2), den_type=(38, 0)).alias("v")).first().v
    assert got == half_up(D("999999999999999999.99") / 7, 8)


def test_fractional_divisors(spark):
    grid = spark.range(-300, 301, 7).selectExpr("cast(id * 0.000137 as decimal(20,6)) as x").crossJoin(spark.range(1, 41).selectExpr("cast(id * 0.25 as decimal(10,2)) as y"))
    got = grid.select("x", "y", nu.round_div(F.col("x"), F.col("y"), 3, num_type=(16, 6), den_type=(10, 2)).alias("v")).collect()
    assert all(r.v == half_up(r.x / r.y, 3) for r in got)


def test_a_value_too_wide_raises(spark):
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE|CANNOT_CHANGE_DECIMAL"):
        spark.sql("select cast('123456789012345.00' as decimal(38,2)) r").select(nu.round_div(F.col("r"), L(3), 8)).collect()


def test_quotient_scale():
    assert [nu.quotient_scale(s) for s in (0, 2, 3, 4, 6, 9, 12)] == [6, 8, 9, 10, 12, 12, 12]


def test_aggregates(spark):
    df = spark.createDataFrame([(1, "web", 2), (1, "app", 1), (1, "web", 3), (2, None, 1)], "g int, c string, o int")
    got = df.groupBy("g").agg(
        ag.listagg_distinct(F.col("c")).alias("a"), ag.listagg(F.col("c"), F.col("o"), "|").alias("b"),
        ag.array_agg_json(F.col("c"), F.col("o")).alias("j"), ag.array_agg_distinct_json(F.col("c")).alias("d"),
        ag.max_if(F.col("c") == "web", F.col("o")).alias("m"),
    )
    assert rows(got) == [(1, "app,web", "app|web|web", '["app","web","web"]', '["app","web"]', 3), (2, "", "", "[]", "[]", None)]
    assert ag.surplus_keys(df, "g").first().surplus == 2
    assert rows(ag.fingerprint(df)) == rows(ag.fingerprint(df.orderBy("o"))) != rows(ag.fingerprint(df.union(df)))
    tree = ag.bucket_tree(df, ["g"], 2)
    assert rows(ag.differing_buckets(tree, ag.merged_trees(ag.bucket_tree(df.where("o > 1"), ["g"], 2), ag.bucket_tree(df.where("o = 1"), ["g"], 2)))) == []
    changed = ag.differing_buckets(tree, ag.bucket_tree(df.withColumn("o", F.expr("if(g = 2, 9, o)")), ["g"], 2)).orderBy("level").collect()
    assert [(r.level, len(r.bucket)) for r in changed] == [(0, 0), (1, 1), (2, 2)] and [tuple(r)[2:] for r in changed][::2] == [(4, 4), (1, 1)]
    assert [tuple(r) for r in ag.most_frequent(df, "c").collect()] == [("web", 2), ("app", 1), (None, 1)]
    prices = spark.createDataFrame([(D("0.01"),), (D("0.02"),), (None,)], "p decimal(10,2)")
    assert prices.agg(nu.exact_avg(F.col("p"), 2).alias("v")).first().v == D("0.02")


def test_flatten(spark):
    df = spark.createDataFrame([(1, '{"i":[{"s":"a"},{"s":"b"}],"o":{"x":1,"y":2}}'), (2, '{"i":[]}'), (3, "{}"), (4, None), (5, '{"i":7}')], "k int, v string")
    inner = js.flatten(df, F.col("v"), "i").select("k", "position", js.item_text(F.col("item"), "s"))
    assert rows(inner) == [(1, 0, "a"), (1, 1, "b")]
    outer = js.flatten(df, F.col("v"), "i", outer=True).select("k", "position")
    assert rows(outer) == [(1, 0), (1, 1), (2, None), (3, None), (4, None), (5, None)]
    deep = spark.createDataFrame([(1, '[{"a":[5,{"b":null}]},[]]'), (2, "7"), (3, None), (4, "{}"), (5, "not json")], "k int, v string")
    got = js.flatten_recursive(deep, F.col("v"), outer=True).select("k", "path", "depth", "key", "index", F.to_json("item").alias("j"), F.to_json("this").alias("t"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(
        [(1, "[0]", 1, None, 0, '{"a":[5,{"b":null}]}', '[{"a":[5,{"b":null}]},[]]'), (1, "[1]", 1, None, 1, "[]", '[{"a":[5,{"b":null}]},[]]'), (1, "[0].a", 2, "a", None, '[5,{"b":null}]', '{"a":[5,{"b":null}]}'),
         (1, "[0].a[0]", 3, None, 0, "5", '[5,{"b":null}]'), (1, "[0].a[1]", 3, None, 1, '{"b":null}', '[5,{"b":null}]'), (1, "[0].a[1].b", 4, "b", None, "null", '{"b":null}')]
        + [(k, None, None, None, None, None, None) for k in (2, 3, 4, 5)], key=str)
    assert js.flatten_recursive(deep.where("k > 1"), F.col("v")).count() == 0
    assert df.where("k = 1").select(js.array_construct(F.lit(1), F.lit("a"), F.lit(None).cast("int"))).first()[0] == '[1,"a",null]'
    keys = js.flatten_object(df, F.col("v"), "o").select("k", "key", F.col("item").cast("int"))
    assert rows(keys) == [(1, "x", 1), (1, "y", 2)]
    assert df.where("k = 1").select(js.object_keys(F.col("v"))).first()[0] == ["i", "o"]
    assert rows(df.where("k = 2").select(st.split_to_table(F.lit("p;q"), ";"))) == [(1, "p"), (2, "q")]
