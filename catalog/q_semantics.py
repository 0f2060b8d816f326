"""Function semantics, aggregates and windows on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.shop import money, table
from catalog.shop_sql import exact_div
from equipoise.functions import aggregates as ag
from equipoise.functions import conditionals as sc
from equipoise.functions import dates as dt
from equipoise.functions import numbers as nu
from equipoise.functions import semi as js
from equipoise.functions import sketches as sk
from equipoise.functions import strings as st
from equipoise.functions.ordering import ascending, descending
from equipoise.operators import windows as wn
from equipoise.operators.keyed import attach
from equipoise.session import cut_lineage


@query("cond_nulls", """
WITH t AS (SELECT o_orderkey, nullif(o_orderstatus, 'F') AS a, nullif(o_orderpriority, '5-LOW') AS b,
  nullif(o_custkey % 7, 3) AS x, nullif(o_orderkey % 5, 2) AS y FROM orders)
SELECT o_orderkey, CASE WHEN a = 'O' THEN 'open' ELSE 'other' END AS iff_v, coalesce(a, b) AS nvl_v,
  CASE WHEN a IS NOT NULL THEN b ELSE 'none' END AS nvl2_v, coalesce(x, 0) AS zero_v, nullif(y, 0) AS nullzero_v,
  x IS NOT DISTINCT FROM y AS equal_v,
  CASE WHEN a IS NULL THEN 'missing' WHEN a = 'O' THEN 'open' ELSE 'else' END AS decode_v,
  CASE WHEN x IS NULL OR y IS NULL THEN NULL ELSE greatest(x, y) END AS greatest_v,
  CASE WHEN x IS NULL OR y IS NULL THEN NULL ELSE least(x, y) END AS least_v,
  greatest(x, y) AS greatest_skip, a || b AS concat_v, a || '/' || b AS concat_ws_v
FROM t""")
def cond_nulls(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("a"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("b"),
        F.nullif(F.col("o_custkey") % 7, F.lit(3)).alias("x"), F.nullif(F.col("o_orderkey") % 5, F.lit(2)).alias("y"),
    )
    a, b, x, y = (F.col(c) for c in "abxy")
    return t.select(
        "o_orderkey", sc.iff(a == "O", "open", "other").alias("iff_v"), F.nvl(a, b).alias("nvl_v"),
        F.nvl2(a, b, F.lit("none")).alias("nvl2_v"), F.zeroifnull(x).alias("zero_v"), F.nullifzero(y).alias("nullzero_v"),
        F.equal_null(x, y).alias("equal_v"), sc.decode(a, {None: "missing", "O": "open"}, "else").alias("decode_v"),
        sc.greatest_strict(x, y).alias("greatest_v"), sc.least_strict(x, y).alias("least_v"),
        sc.greatest_ignore_nulls(x, y).alias("greatest_skip"), F.concat(a, b).alias("concat_v"),
        sc.concat_ws_strict("/", a, b).alias("concat_ws_v"),
    )


@query("number_semantics", f"""
WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS q, l_extendedprice::DECIMAL(12,2) AS p, l_discount::DECIMAL(5,2) AS d FROM lineitem)
SELECT l_linenumber, count(*) AS n, sum(round(p * 0.125, 2))::DECIMAL(28,2) AS half_away,
  sum(round(-p * 0.125, 2))::DECIMAL(28,2) AS half_away_negative,
  sum(round(p * 0.5, 0))::BIGINT AS whole,
  sum((p * 100)::BIGINT * 0.01)::DECIMAL(28,2) AS from_cents,
  sum({exact_div('p', 'q', 8)})::DECIMAL(30,8) AS unit_price,
  sum({exact_div('p', '(q - 10)', 2, div0=True)})::DECIMAL(28,2) AS with_zero,
  count({exact_div('p', '(q - 10)', 2)}) AS non_null,
  sum(q % 7)::BIGINT AS mods, sum(q // 7)::BIGINT AS divs, sum(sign(q - 25))::BIGINT AS signs
FROM t GROUP BY l_linenumber""")
def number_semantics(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(
        "l_linenumber", F.col("l_quantity").cast("bigint").alias("q"), money("l_extendedprice").alias("p")
    )
    q, p = F.col("q"), F.col("p")
    eighth = p * F.lit("0.125").cast("decimal(4,3)")
    total = lambda c, kind: F.sum(c).cast(kind)
    return t.groupBy("l_linenumber").agg(
        F.count(F.lit(1)).alias("n"),
        total(F.round(eighth, 2), "decimal(28,2)").alias("half_away"),
        total(F.round(-eighth, 2), "decimal(28,2)").alias("half_away_negative"),
        total(nu.to_integer(p * F.lit("0.5").cast("decimal(2,1)")), "bigint").alias("whole"),
        total(nu.cents_to_units(p * 100), "decimal(28,2)").alias("from_cents"),
        total(nu.round_div(p, q, 8, num_type=(12, 2), den_type=(11, 0)), "decimal(30,8)").alias("unit_price"),
        total(nu.round_div(p, q - 10, 2, num_type=(12, 2), den_type=(11, 0), div0=True), "decimal(28,2)").alias("with_zero"),
        F.count(nu.round_div(p, q - 10, 2, num_type=(12, 2), den_type=(11, 0))).alias("non_null"),
        total(q % 7, "bigint").alias("mods"), F.sum(F.expr("q div 7")).cast("bigint").alias("divs"),
        F.sum(F.signum(q - 25)).cast("bigint").alias("signs"),
    )


@query("try_number", """
WITH t AS (SELECT doc_id, string_split(text, ' ') AS words, CASE doc_id % 8 WHEN 0 THEN (doc_id % 900) || '.955' WHEN 1 THEN ' ' || doc_id || ' '
  WHEN 2 THEN '' WHEN 3 THEN 'n/a' WHEN 4 THEN '1,' || doc_id WHEN 5 THEN '-' || (doc_id % 900) || '.4' WHEN 6 THEN doc_id || 'e1' ELSE NULL END AS s FROM documents)
SELECT doc_id, try_cast(s AS DECIMAL(10,2)) AS two_places, try_cast(s AS DECIMAL(18,0))::BIGINT AS whole, try_cast(s AS DOUBLE) AS as_double,
  len(list_filter(words, lambda w: try_cast(w AS DECIMAL(10,2)) IS NOT NULL))::BIGINT AS number_words FROM t""")
def try_number(spark, sf_dir):
    i = F.col("doc_id")
    spelled = (
        F.when(i % 8 == 0, F.concat((i % 900).cast("string"), F.lit(".955"))).when(i % 8 == 1, F.concat(F.lit(" "), i.cast("string"), F.lit(" ")))
        .when(i % 8 == 2, "").when(i % 8 == 3, "n/a").when(i % 8 == 4, F.concat(F.lit("1,"), i.cast("string")))
        .when(i % 8 == 5, F.concat(F.lit("-"), (i % 900).cast("string"), F.lit(".4"))).when(i % 8 == 6, F.concat(i.cast("string"), F.lit("e1")))
    )
    t = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("words"), spelled.alias("s"))
    return t.select(
        "doc_id", nu.try_to_number(F.col("s"), 10, 2).alias("two_places"), nu.try_to_number(F.col("s"), 18, 0).cast("bigint").alias("whole"),
        nu.try_to_double(F.col("s")).alias("as_double"), F.size(F.filter("words", lambda w: nu.try_to_number(w, 10, 2).isNotNull())).cast("bigint").alias("number_words"),
    )


@query("date_semantics", """
WITH t AS (SELECT event_id, ts AS a, ts + to_seconds(event_id * 7919) + INTERVAL 47 MINUTE AS b, ts::DATE AS d FROM events)
SELECT event_id, strftime(a, '%Y-%m') AS ym, strftime(a, '%d/%m/%y %H:%M:%S') AS dmy, strftime(a, '%a %b %I %p') AS names,
  strftime(a, '%Y-%m-%d %H:%M:%S.%g') AS default_text, d + 30 AS plus_days, CAST(d + INTERVAL 1 MONTH AS DATE) AS plus_month,
  CAST(d - INTERVAL 1 YEAR AS DATE) AS minus_year, a + INTERVAL 90 MINUTE AS plus_minutes, a + INTERVAL 2 MONTH AS plus_months,
  datediff('day', a, b) AS days, datediff('month', a, b) AS months, datediff('year', a, b) AS years, datediff('hour', a, b) AS hours,
  datediff('minute', a, b) AS minutes, datediff('day', date_trunc('week', a), date_trunc('week', b)) // 7 AS weeks,
  datediff('quarter', a, b) AS quarters,
  CAST(date_trunc('month', d) AS DATE) AS month_start, CAST(date_trunc('week', d) AS DATE) AS week_start, date_trunc('hour', a) AS hour_start,
  strftime(d, '%a') AS day_name, strftime(d, '%b') AS month_name, dayofweek(d) AS dow, isodow(d) AS dow_iso, week(d) AS iso_week,
  d AS day_start, d AS hour_of_date, d::TIMESTAMP + INTERVAL 5 HOUR AS plus_hours, CAST(make_date(year(d), 1, 1) + INTERVAL 14 MONTH - INTERVAL 3 DAY AS DATE) AS carried_parts,
  last_day(d) AS month_end, trunc(epoch(a))::BIGINT AS epoch_s, CAST(strptime(strftime(a, '%d/%m/%Y'), '%d/%m/%Y') AS DATE) AS parsed,
  timezone('Europe/Amsterdam', timezone('UTC', a)) AS amsterdam
FROM t""")
def date_semantics(spark, sf_dir):
    t = table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").alias("a"), F.col("ts").cast("date").alias("d"),
        dt.add_to_timestamp("minute", 47, dt.add_to_timestamp("second", F.col("event_id") * 7919, F.col("ts"))).alias("b"),
    )
    a, b, d = F.col("a"), F.col("b"), F.col("d")
    between = lambda part: dt.boundaries_between(part, a, b)
    return t.select(
        "event_id", dt.to_char(a, "YYYY-MM").alias("ym"), dt.to_char(a, "DD/MM/YY HH24:MI:SS").alias("dmy"),
        dt.to_char(a, "DY MON HH12 AM").alias("names"), dt.timestamp_text(a).alias("default_text"),
        dt.add_to_date("day", 30, d).alias("plus_days"), dt.add_to_date("month", 1, d).alias("plus_month"),
        dt.add_to_date("year", -1, d).alias("minus_year"), dt.add_to_timestamp("minute", 90, a).alias("plus_minutes"),
        dt.add_to_timestamp("month", 2, a).alias("plus_months"), between("day").alias("days"), between("month").alias("months"),
        between("year").alias("years"), between("hour").alias("hours"), between("minute").alias("minutes"),
        between("week").alias("weeks"), between("quarter").alias("quarters"),
        dt.trunc_date("month", d).alias("month_start"), dt.trunc_date("week", d).alias("week_start"),
        dt.trunc_date("day", d).alias("day_start"), dt.trunc_date("hour", d).alias("hour_of_date"), dt.add_to_date("hour", 5, d).alias("plus_hours"),
        dt.date_from_parts(F.year(d), F.lit(15), F.lit(-2)).alias("carried_parts"),
        dt.trunc_timestamp("hour", a).alias("hour_start"), dt.day_name(d).alias("day_name"), dt.month_name(d).alias("month_name"),
        dt.day_of_week(d).cast("bigint").alias("dow"), dt.day_of_week_iso(d).cast("bigint").alias("dow_iso"),
        dt.week_of_year(d).cast("bigint").alias("iso_week"), F.last_day(d).alias("month_end"), dt.epoch_seconds(a).cast("bigint").alias("epoch_s"),
        dt.to_date(dt.to_char(a, "DD/MM/YYYY"), "DD/MM/YYYY").alias("parsed"),
        dt.convert_timezone("UTC", "Europe/Amsterdam", a).alias("amsterdam"),
    )


@query("string_semantics", """
SELECT page_id, upper(url) AS up, lower(url) AS low, trim('  ' || url || ' ') AS trimmed, split_part(url, '/', 1) AS part0,
  split_part(url, '/', 3) AS host, split_part(url, '/', -1) AS last_part, split_part(url, '/', 99) AS out_of_range,
  instr(url, 'example') AS pos, contains(url, 'example') AS has, starts_with(url, 'https') AS starts, ends_with(url, 'html') AS ends,
  md5(url) AS hash, substr(url, 1, 5) AS left5, lpad(page_id::VARCHAR, 8, '0') AS padded, replace(url, '/', '|') AS piped,
  len(string_split(url, '/')) AS n_parts, url ILIKE 'HTTPS://%' AS ilike_v,
  len(list_filter(string_split_regex(url, '[/.]+'), lambda x: x <> '')) AS n_tokens, page_id::VARCHAR || ':' || (page_id % 2 = 0)::VARCHAR AS as_text
FROM pages""")
def string_semantics(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.upper(u).alias("up"), F.lower(u).alias("low"), F.trim(F.concat(F.lit("  "), u, F.lit(" "))).alias("trimmed"),
        st.split_part(u, "/", 0).alias("part0"), st.split_part(u, "/", 3).alias("host"), st.split_part(u, "/", -1).alias("last_part"),
        st.split_part(u, "/", 99).alias("out_of_range"), st.charindex("example", u).cast("bigint").alias("pos"),
        F.contains(u, F.lit("example")).alias("has"), F.startswith(u, F.lit("https")).alias("starts"), F.endswith(u, F.lit("html")).alias("ends"),
        F.md5(u).alias("hash"), F.left(u, F.lit(5)).alias("left5"), F.lpad(F.col("page_id").cast("string"), 8, "0").alias("padded"),
        F.replace(u, F.lit("/"), F.lit("|")).alias("piped"), F.size(st.split(u, "/")).cast("bigint").alias("n_parts"),
        u.ilike("HTTPS://%").alias("ilike_v"), F.size(st.tokens(u, "/.")).cast("bigint").alias("n_tokens"),
        F.concat(F.col("page_id").cast("string"), F.lit(":"), (F.col("page_id") % 2 == 0).cast("string")).alias("as_text"),
    )


@query("regex_semantics", r"""
SELECT page_id, nullif(regexp_extract(url, '[0-9]+'), '') AS first_number, regexp_full_match(url, 'https?://[^/]+/.*') AS whole,
  regexp_full_match(url, 'example') AS inner_only, regexp_replace(url, '[0-9]', '#', 'g') AS masked,
  len(regexp_extract_all(url, '[aeiou]')) AS vowels, nullif(regexp_extract(url, 'utm_[a-z]+'), '') AS tag FROM pages""")
def regex_semantics(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", st.regexp_substr(u, "[0-9]+").alias("first_number"), st.regexp_like(u, "https?://[^/]+/.*").alias("whole"),
        st.regexp_like(u, "example").alias("inner_only"), F.regexp_replace(u, "[0-9]", "#").alias("masked"),
        F.regexp_count(u, F.lit("[aeiou]")).cast("bigint").alias("vowels"), st.regexp_substr(u, "utm_[a-z]+").alias("tag"),
    )


@query("split_to_table", "SELECT page_id, idx AS index, part AS value FROM pages, unnest(string_split(url, '/')) WITH ORDINALITY AS u(part, idx)")
def split_rows(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", st.split_to_table(F.col("url"), "/")).select(
        "page_id", F.col("index").cast("bigint").alias("index"), "value"
    )


# --------------------------------------------------------------------------- JSON

_META_SQL = """
meta AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '{"k":' || (event_id % 50) || ',"a":{"b":[' || event_id || ',20]},"n":null}'
  WHEN 1 THEN '{"k":"' || event_type || '","a":{"b":[]}}' WHEN 2 THEN props WHEN 3 THEN '{"k":true,"n":"n/a"}'
  WHEN 4 THEN '{"k":1.5,"a":{"b":[1,2,3]}}' ELSE NULL END AS v FROM events)
"""


def _meta(spark, sf_dir):
    i, e = F.col("event_id"), F.col("event_type")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    v = (
        F.when(i % 6 == 0, text('{"k":', (i % 50).cast("string"), ',"a":{"b":[', i.cast("string"), ',20]},"n":null}'))
        .when(i % 6 == 1, text('{"k":"', e, '","a":{"b":[]}}')).when(i % 6 == 2, F.col("props"))
        .when(i % 6 == 3, '{"k":true,"n":"n/a"}').when(i % 6 == 4, '{"k":1.5,"a":{"b":[1,2,3]}}')
    )
    return table(spark, sf_dir, "events").select("event_id", v.alias("v"))


@query("json_paths", f"""
WITH {_META_SQL}
SELECT event_id, v ->> '$.k' AS k, v ->> '$.a.b[0]' AS first_b, v ->> '$.missing' AS missing, v ->> '$.n' AS n,
  try_cast(v ->> '$.n' AS DECIMAL(10,2)) AS n_number, try_cast(v ->> '$.a.b[1]' AS BIGINT) AS second_b,
  CASE WHEN json_type(v, '$.a.b') = 'ARRAY' THEN json_array_length(v, '$.a.b')::BIGINT END AS size_b,
  json_type(v, '$.n') = 'NULL' AS null_n FROM meta""")
def json_paths(spark, sf_dir):
    v = F.col("v")
    return _meta(spark, sf_dir).select(
        "event_id", js.get_text(v, "k").alias("k"), js.get_text(v, "a.b[0]").alias("first_b"), js.get_text(v, "missing").alias("missing"),
        js.get_text(v, "n").alias("n"), js.try_get_typed(v, "n", "decimal(10,2)").alias("n_number"),
        js.try_get_typed(v, "a.b[1]", "bigint").alias("second_b"), js.array_size(v, "a.b").cast("bigint").alias("size_b"),
        js.is_json_null(v, "n").alias("null_n"),
    )


@query("json_flatten", f"""
WITH {_META_SQL}
SELECT event_id, f.idx - 1 AS position, CAST(f.item ->> '$' AS BIGINT) AS item
FROM meta, unnest(json_extract(v, '$.a.b[*]')) WITH ORDINALITY AS f(item, idx)""")
def json_flatten(spark, sf_dir):
    return js.flatten(_meta(spark, sf_dir), F.col("v"), "a.b").select(
        "event_id", F.col("position").cast("bigint").alias("position"), F.col("item").cast("bigint").alias("item")
    )


@query("json_flatten_outer", f"""
WITH {_META_SQL}
SELECT event_id, f.idx - 1 AS position, CAST(f.item ->> '$' AS BIGINT) AS item
FROM meta LEFT JOIN LATERAL unnest(json_extract(v, '$.a.b[*]')) WITH ORDINALITY AS f(item, idx) ON TRUE""")
def json_flatten_outer(spark, sf_dir):
    return js.flatten(_meta(spark, sf_dir), F.col("v"), "a.b", outer=True).select(
        "event_id", F.col("position").cast("bigint").alias("position"), F.col("item").cast("bigint").alias("item")
    )


@query("json_object_keys", f"WITH {_META_SQL} SELECT event_id, unnest(json_keys(v)) AS key FROM meta WHERE v IS NOT NULL")
def json_keys(spark, sf_dir):
    return _meta(spark, sf_dir).select("event_id", F.explode(js.object_keys(F.col("v"))).alias("key"))


@query("json_flatten_object", f"WITH {_META_SQL} SELECT event_id, unnest(json_keys(v, '$.a')) AS key FROM meta WHERE json_type(v, '$.a') = 'OBJECT'")
def json_flatten_object(spark, sf_dir):
    return js.flatten_object(_meta(spark, sf_dir), F.col("v"), "a").select("event_id", "key")


@query("json_build", """
SELECT o_orderkey, '{' || concat_ws(',', CASE WHEN o_orderstatus <> 'F' THEN '"status":"' || o_orderstatus || '"' END, '"customer":' || o_custkey) || '}' AS dropped,
  '{"status":' || coalesce('"' || nullif(o_orderstatus, 'F') || '"', 'null') || ',"customer":' || o_custkey || '}' AS kept FROM orders""")
def json_build(spark, sf_dir):
    fields = {"status": F.nullif("o_orderstatus", F.lit("F")), "customer": F.col("o_custkey")}
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", js.object_construct(**fields).alias("dropped"), js.object_construct_keep_null(**fields).alias("kept")
    )


@query("json_types", f"""
WITH {_META_SQL}
SELECT CASE json_type(v, '$.k') WHEN 'UBIGINT' THEN 'INTEGER' WHEN 'BIGINT' THEN 'INTEGER' WHEN 'VARCHAR' THEN 'VARCHAR' WHEN 'BOOLEAN' THEN 'BOOLEAN'
  WHEN 'DOUBLE' THEN 'DECIMAL' END AS kind, count(*) AS n FROM meta GROUP BY 1""")
def json_types(spark, sf_dir):
    return _meta(spark, sf_dir).groupBy(js.type_of(F.col("v"), "k").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_NESTED_SQL = """nested AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '[1,[2,[' || o_custkey || ',[]]],{}]' WHEN 1 THEN '{"a":{"b":{"c":{"d":[' || o_custkey || ',null]}}}}'
  WHEN 2 THEN '{"status":"' || o_orderstatus || '","tags":[{"n":1,"x":[true,"' || o_orderpriority || '"]},{"n":2}]}' WHEN 3 THEN CASE WHEN o_orderkey % 2 = 0 THEN '7' END ELSE '{}' END AS v FROM orders)"""


@query("json_flatten_recursive", f"""
WITH RECURSIVE {_NESTED_SQL},
t(o_orderkey, path, depth, key, idx, item) AS (SELECT o_orderkey, '', 0, NULL::VARCHAR, NULL::BIGINT, v::JSON FROM nested WHERE json_type(v) IN ('OBJECT', 'ARRAY')
  UNION ALL SELECT o_orderkey, path || CASE WHEN e.key IS NULL THEN '[' || e.idx || ']' WHEN path = '' THEN e.key ELSE '.' || e.key END, depth + 1, e.key, e.idx, e.item
  FROM (SELECT o_orderkey, path, depth, unnest(CASE json_type(item) WHEN 'OBJECT' THEN list_transform(json_keys(item), lambda k: {{'key': k, 'idx': NULL::BIGINT, 'item': json_extract(item, '$."' || k || '"')}})
    ELSE list_transform(range(0, json_array_length(item)::BIGINT), lambda i: {{'key': NULL::VARCHAR, 'idx': i, 'item': json_extract(item, '$[' || i || ']')}}) END) AS e FROM t WHERE json_type(item) IN ('OBJECT', 'ARRAY')))
SELECT o_orderkey, path, depth, key, idx AS index, item::VARCHAR AS item FROM t WHERE depth > 0
UNION ALL SELECT o_orderkey, NULL, NULL, NULL, NULL, NULL FROM nested WHERE v IS NULL OR v IN ('7', '{{}}')""")
def json_flatten_recursive(spark, sf_dir):
    """Every value inside nested JSON, up to five levels down, with its path."""
    nested = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        """case o_orderkey % 5 when 0 then concat('[1,[2,[', o_custkey, ',[]]],{}]') when 1 then concat('{"a":{"b":{"c":{"d":[', o_custkey, ',null]}}}}')
        when 2 then concat('{"status":"', o_orderstatus, '","tags":[{"n":1,"x":[true,"', o_orderpriority, '"]},{"n":2}]}') when 3 then if(o_orderkey % 2 = 0, '7', null) else '{}' end as v""",
    )
    return js.flatten_recursive(nested, F.col("v"), outer=True).select("o_orderkey", "path", "depth", "key", F.col("index").cast("bigint").alias("index"), F.to_json("item").alias("item"))


# --------------------------------------------------------------------------- aggregates


@query("listagg_types", """
SELECT ts::DATE AS day, coalesce(string_agg(DISTINCT event_type, ',' ORDER BY event_type), '') AS types,
  coalesce(string_agg(DISTINCT CASE WHEN user_id < 20 THEN event_type END, ',' ORDER BY CASE WHEN user_id < 20 THEN event_type END), '') AS few,
  coalesce(string_agg(DISTINCT CASE WHEN value < 0 THEN event_type END, ',' ORDER BY CASE WHEN value < 0 THEN event_type END), '') AS none
FROM events GROUP BY 1""")
def listagg_types(spark, sf_dir):
    e = F.col("event_type")
    return table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(
        ag.listagg_distinct(e).alias("types"), ag.listagg_distinct(F.when(F.col("user_id") < 20, e)).alias("few"),
        ag.listagg_distinct(F.when(F.col("value") < 0, e)).alias("none"),
    )


@query("array_agg_json", """
SELECT conv_id, '[' || string_agg('"' || role || '"', ',' ORDER BY turn) || ']' AS roles,
  coalesce('[' || string_agg(CASE WHEN role = 'user' THEN turn::VARCHAR END, ',' ORDER BY turn) || ']', '[]') AS user_turns,
  '[' || string_agg(DISTINCT '"' || role || '"', ',' ORDER BY '"' || role || '"') || ']' AS kinds,
  string_agg(role, '>' ORDER BY turn) AS path FROM conversations GROUP BY conv_id""")
def array_agg_json(spark, sf_dir):
    # A conversation's own turns: the group is the result row itself.
    role, turn = F.col("role"), F.col("turn")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        ag.array_agg_json(role, turn).alias("roles"), ag.array_agg_json(F.when(role == "user", turn), turn).alias("user_turns"),
        ag.array_agg_distinct_json(role).alias("kinds"), ag.listagg(role, turn, ">").alias("path"),
    )


@query("agg_semantics", """
SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE value > 50) AS large,
  bool_and(value >= 0) AS all_positive, bool_or(value > 99) AS any_huge, max(CASE WHEN user_id % 2 = 0 THEN ts END) AS last_even,
  min(user_id) AS smallest_user FROM events GROUP BY event_type HAVING count(*) > 1""")
def agg_semantics(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.count_if(v > 50).alias("large"),
        F.bool_and(v >= 0).alias("all_positive"), F.bool_or(v > 99).alias("any_huge"),
        ag.max_if(F.col("user_id") % 2 == 0, F.col("ts")).alias("last_even"), F.min("user_id").alias("smallest_user"),
    ).where("n > 1")


@query("exact_quantiles", """
SELECT event_type, quantile_cont(value, 0.5)::DECIMAL(18,6) AS median_value, quantile_cont(value, 0.9)::DECIMAL(18,6) AS p90_value FROM events GROUP BY event_type""")
def exact_quantiles(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    found = wn.exact_quantiles(events, ["event_type"], "value", {"median_value": 0.5, "p90_value": 0.9})
    return found.select("event_type", *[F.col(c).cast("decimal(18,6)").alias(c) for c in ("median_value", "p90_value")])


@query("stored_sketches", """
SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, true AS users_close, true AS median_close, true AS p95_close, true AS top_close FROM events GROUP BY 1""")
def stored_sketches(spark, sf_dir):
    """Sketches stored by day and type and merged by type: each estimate is held against the exact value and its stated error."""
    events = table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))
    daily = cut_lineage(sk.sketches(events, ["day", "event_type"], distinct="user_id", quantile="value", frequent="user_id"))
    q = {"median": 0.5, "p95": 0.95}
    whole = cut_lineage(sk.merged(daily, ["event_type"]).select(
        "event_type", "n", sk.distinct_estimate().alias("about"), sk.frequent_estimate(3).alias("top"), *[sk.quantile_estimate(x).alias(f"{name}_at") for name, x in q.items()]
    ))
    ranks = [F.count_if(F.col("value") < F.col(f"{n}_at")).alias(f"{n}_below") for n in q] + [F.count_if(F.col("value") <= F.col(f"{n}_at")).alias(f"{n}_upto") for n in q]
    exact = attach(events, whole, ["event_type"]).groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), *ranks)
    counts = cut_lineage(events.where("user_id is not null").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("c")))
    places = wn.qualify_top(counts, ["event_type"], [F.col("c").desc()], 3)
    truly = places.groupBy("event_type").agg(F.min("c").alias("third"), F.count(F.lit(1)).alias("places"))
    listed = whole.select("event_type", F.explode("top").alias("t")).select("event_type", F.col("t.item").alias("user_id"), F.col("t.count").alias("told"))
    # where no value stands out, a sketch lists fewer than three or none: a place that is left empty counts as a value that never occurs
    tops = attach(listed, counts, ["event_type", "user_id"], "left").fillna(0, ["c"]).groupBy("event_type").agg(
        F.max(F.abs(F.col("told") - F.col("c"))).alias("off"), F.min("c").alias("least"), F.count(F.lit(1)).alias("told_places")
    )
    tops = attach(attach(whole.select("event_type"), truly, ["event_type"], "left"), tops, ["event_type"], "left").fillna(0, ["third", "places", "off", "told_places"])
    tops = tops.withColumn("short", F.when(F.col("told_places") < F.col("places"), 0).otherwise(F.coalesce("least", F.lit(0))) - F.col("third"))
    near = lambda name, x: ((F.col(f"{name}_below") <= (x + sk.RANK_ERROR) * F.col("n")) & (F.col(f"{name}_upto") >= (x - sk.RANK_ERROR) * F.col("n"))).alias(f"{name}_close")
    return attach(attach(whole, exact, ["event_type"]), tops, ["event_type"]).select(
        "event_type", "n", "users", (F.abs(F.col("about") - F.col("users")) <= sk.DISTINCT_ERROR * F.col("users")).alias("users_close"), *[near(n, x) for n, x in q.items()],
        ((F.col("off") <= sk.COUNT_ERROR * F.col("n")) & (F.col("short") >= -sk.COUNT_ERROR * F.col("n"))).alias("top_close"),
    )


@query("surplus_keys", """
SELECT coalesce(sum(n - 1), 0)::BIGINT AS surplus FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""")
def surplus_keys(spark, sf_dir):
    return ag.surplus_keys(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


_LINE_COLUMNS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity::DECIMAL(12,2)", "l_extendedprice::DECIMAL(12,2)", "l_discount::DECIMAL(12,2)", "l_tax::DECIMAL(12,2)", "l_returnflag", "l_linestatus", "l_shipdate::DATE")


def _digest_sql(*columns):
    return "md5(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in columns) + ")"


def _sum_sql(at, digest="digest"):
    return f"coalesce(sum(('0x' || substr({digest}, {at}, 15))::BIGINT::HUGEINT), 0)"


def _lines(spark, sf_dir):
    typed = [F.col(c.split("::")[0]).cast(c.split("::")[1].lower()).alias(c.split("::")[0]) if "::" in c else F.col(c) for c in _LINE_COLUMNS]
    return table(spark, sf_dir, "lineitem").select(*typed)


@query("fingerprint", f"SELECT count(*) AS row_count, {_sum_sql(1)}::VARCHAR || ':' || {_sum_sql(16)}::VARCHAR AS content FROM (SELECT {_digest_sql(*_LINE_COLUMNS)} AS digest FROM lineitem)")
def fingerprint(spark, sf_dir):
    """One number for all lines, whatever their order."""
    return ag.fingerprint(_lines(spark, sf_dir))


_CHANGED_LINES = ["CASE WHEN l_orderkey % 911 = 5 AND l_linenumber = 1 THEN 'Z' ELSE l_returnflag END" if c == "l_returnflag" else c for c in _LINE_COLUMNS]


@query("differing_buckets", f"""
WITH a AS (SELECT {_digest_sql("l_orderkey")} AS k, {_digest_sql(*_LINE_COLUMNS)} AS digest FROM lineitem),
b AS (SELECT {_digest_sql("l_orderkey")} AS k, {_digest_sql(*_CHANGED_LINES)} AS digest FROM lineitem WHERE l_orderkey % 1009 <> 3),
t AS (SELECT 1 AS side, k, digest FROM a UNION ALL SELECT -1, k, digest FROM b),
l AS (SELECT level, substr(k, 1, level) AS bucket, side, count(*) AS n, {_sum_sql(1)} AS x, {_sum_sql(16)} AS y FROM t, (VALUES (0), (1), (2), (3)) v(level) GROUP BY ALL)
SELECT level, bucket, sum(CASE WHEN side = 1 THEN n ELSE 0 END)::BIGINT AS rows_left, sum(CASE WHEN side = -1 THEN n ELSE 0 END)::BIGINT AS rows_right
FROM l GROUP BY 1, 2 HAVING sum(side * n) <> 0 OR sum(side * x) <> 0 OR sum(side * y) <> 0""")
def differing_buckets(spark, sf_dir):
    """Which key buckets of two versions of all lines differ: some lines changed, some orders are missing."""
    lines = _lines(spark, sf_dir)
    changed = lines.where("l_orderkey % 1009 <> 3").withColumn("l_returnflag", F.expr("if(l_orderkey % 911 = 5 and l_linenumber = 1, 'Z', l_returnflag)"))
    halves = [ag.bucket_tree(changed.where(f"l_suppkey % 2 = {i}"), ["l_orderkey"]) for i in (0, 1)]
    return ag.differing_buckets(ag.bucket_tree(lines, ["l_orderkey"]), ag.merged_trees(*halves))


@query("type_frequency", "SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2")
def type_frequency(spark, sf_dir):
    return ag.most_frequent(table(spark, sf_dir, "documents"), "lang", "source")


# --------------------------------------------------------------------------- windows


@query("qualify_latest_event", """
SELECT user_id, event_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS FIRST, event_id) <= 2""")
def qualify_latest_event(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return wn.qualify_top(events, ["user_id"], [descending("ts"), ascending("event_id")], 2)


@query("first_per_group", """
SELECT c_nationkey, c_mktsegment, c_custkey, c_name, a AS balance FROM (SELECT *, nullif(c_acctbal, 0)::DECIMAL(12,2) AS a FROM customer)
QUALIFY row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY a ASC NULLS LAST, c_custkey) = 1""")
def first_per_group(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", "c_custkey", "c_name", money(F.nullif("c_acctbal", F.lit(0.0))).alias("balance"))
    return wn.first_per_group(people, ["c_nationkey", "c_mktsegment"], ["balance", "c_custkey"])


@query("window_values", """
SELECT c_custkey, first_value(c_custkey) OVER w AS first_key, last_value(c_custkey) OVER f AS last_key, nth_value(c_custkey, 3) OVER f AS third_key,
  count(*) OVER (PARTITION BY c_nationkey) AS accounts
FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey),
  f AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def window_values(spark, sf_dir):
    people, by, order = table(spark, sf_dir, "customer"), ["c_nationkey"], ["c_acctbal", "c_custkey"]
    third = wn.nth_in_group(people, by, "c_custkey", [ascending(c) for c in order], 3, "third_key")
    out = wn.add_group_values(
        people, by, first_key=wn.first_in("c_custkey", order), last_key=wn.last_in("c_custkey", order), accounts=F.count(F.lit(1))
    )
    return attach(out, third, by, "left").select("c_custkey", "first_key", "last_key", "third_key", "accounts")


@query("rank_suppliers", """
SELECT s_nationkey, s_suppkey, floor(s_acctbal / 1000)::BIGINT AS band FROM supplier
QUALIFY rank() OVER (PARTITION BY s_nationkey ORDER BY floor(s_acctbal / 1000) DESC NULLS FIRST) <= 2""")
def rank_suppliers(spark, sf_dir):
    banded = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.floor(F.col("s_acctbal") / 1000).alias("band"))
    return wn.qualify_top(banded, ["s_nationkey"], [descending("band")], 2, rank=F.rank)


@query("order_lines_share", """
SELECT l_orderkey, l_linenumber, c AS cents, c::DOUBLE / nullif(sum(c::DOUBLE) OVER (PARTITION BY l_orderkey), 0) AS share
FROM (SELECT l_orderkey, l_linenumber, (l_extendedprice::DECIMAL(12,2) * 100)::BIGINT AS c FROM lineitem)""")
def order_lines_share(spark, sf_dir):
    typed = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (money("l_extendedprice") * 100).cast("bigint").alias("cents"))
    return wn.ratio_to_report(typed, ["l_orderkey"], F.col("cents"), "share")


@query("share_exact", f"""
WITH t AS (SELECT c_nationkey, c_mktsegment, sum(c_acctbal::DECIMAL(12,2))::DECIMAL(14,2) AS x FROM customer GROUP BY 1, 2),
w AS (SELECT *, sum(x) OVER (PARTITION BY c_nationkey) AS total FROM t)
SELECT c_nationkey, c_mktsegment, x AS balance, {exact_div('x', 'total', 8, den_scale=2)}::DECIMAL(20,8) AS share FROM w""")
def share_exact(spark, sf_dir):
    totals = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(
        F.sum(money("c_acctbal")).cast("decimal(14,2)").alias("balance")
    )
    shared = wn.exact_ratio_to_report(totals, ["c_nationkey"], "balance", "share", 8)
    return shared.withColumn("share", F.col("share").cast("decimal(20,8)"))


@query("rate_breaches", """
WITH t AS (SELECT event_type, ts, count(*) AS n FROM events GROUP BY 1, 2),
w AS (SELECT event_type, ts, n AS events_now, sum(n) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW)::BIGINT AS events_in_window FROM t)
SELECT * FROM w WHERE events_in_window > 5""")
def rate_breaches(spark, sf_dir):
    return wn.rate_breaches(table(spark, sf_dir, "events"), ["event_type"], "ts", 5, seconds=3600, slice_seconds=86_400)
