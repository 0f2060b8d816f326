"""The construct scan against texts with known hits."""

import pytest
from pyspark.sql import functions as F

from equipoise.plans import rules, textscan


def hits(spark, cases):
    """{case: [(rule, line, class, counts, construct)]} for {case: (text, context)}."""
    corpus = spark.createDataFrame([(k, c, t) for k, (t, c) in cases.items()], "path string, context string, text string")
    out = {k: [] for k in cases}
    for r in textscan.scan(corpus).collect():
        out[r["path"]].append((r["rule"], r["line_no"], r["class"], r["counts"], r["construct"], r["matched"]))
    return out


CASES = {
    "line comment": ("select a -- formerly ifnull(a, 1)\nfrom t", "sql", set()),
    "block and template comment": ("/* array_agg(k) */ select 2 {# div0null(p, q) #}\n", "sql", set()),
    "literals": ("select 'decode(x)' as hint, 'least(' || name from t", "sql", set()),
    "escaped quote": ("select 'o''clock' as w, nvl(h, 12) as h from t", "sql", {"S2"}),
    "unterminated": ("select iff(ok, 'y', 'n') /* concat(a, b)", "sql", {"S1"}),
    "conditionals": ("select nvl2(a, 1, 2), iff(b, 3, 4),\n  greatest(c, d), decode(e, 1, 'one'),\n  concat_ws('-', f, g) from t", "sql", {"S1", "S2", "S3", "S4", "S5"}),
    "cast is no path": ("select amount::text as shown from t", "sql", set()),
    "half even": ("select round(fee, 1, 'half_to_even') from t", "sql", {"N5"}),
    "half even in comment": ("select 1 /* round(fee, 1, 'half_to_even') */", "sql", set()),
    "begin in sql": ("begin\n delete from t;\nend", "sql", set()),
    "begin in proc": ("begin\n delete from t;\nend", "proc", {"F-NOTPORT"}),
    "loop in proc": ("for i in 1 to 3 do x; end for", "proc", {"F-NOTPORT"}),
    "scripting": ("call refresh_all();\nexecute immediate stmt;", "sql", {"F-NOTPORT"}),
    "three parts": ("select 1 from prod_db.sales.invoices", "sql", {"P5"}),
    "templated source": ("select 1 from {{ source('erp', 'invoices') }}", "sql", set()),
    "random": ("select random() as r, randstr(4, r) from t", "sql", {"H10"}),
    "nextval": ("insert into t select ids.nextval", "sql", {"H10"}),
    "quoted nextval": ('select "Ids" . nextval from t', "sql", {"H10"}),
    "no nextval": ("select nextval_seen, t.next_val from t", "sql", set()),
    "int cast": ("select qty::smallint from t", "sql", {"N1"}),
    "int cast function": ("select cast(n as tinyint ) from t", "sql", {"N1"}),
    "bigint cast": ("select count_if(late)::bigint from t", "sql", {"A7"}),
    "bare decimal": ("select price::numeric from t", "sql", {"N1"}),
    "sized decimal": ("select price::numeric(12,4) from t", "sql", set()),
    "desc": ("select 1 from t order by seen_at desc, id", "sql", {"A4"}),
    "desc nulls": ("select 1 from t order by seen_at desc nulls last", "sql", set()),
    "desc in name": ("select long_desc, describe_me from t", "sql", set()),
    "subscript": ("select e.body['kind'] from e", "sql", {"J1"}),
    "list index": ("select parts[0], e.parts[2], parts[n] from e", "sql", set()),
    "secure": ("create secure view v as select 1", "sql", {"Y2"}),
    "grants": ("grant select on t to role reader;\ncreate table u clone t;", "sql", {"Y2"}),
    "money": ("select price * (100 - pct) / 100 as net, div0(net, n) as each from t", "sql", {"N2", "N7"}),
    "division in template": ("select {{ a / b }} as y from t", "sql", set()),
    "windows": (
        "select x.index, last_value(v) over (order by k), ratio_to_report(v) over (partition by g),\n listagg(n, ';') within group (order by n)\n"
        "from t, lateral flatten(input => t.doc:list) x\nqualify rank() over (order by k) = 1",
        "sql", {"A1", "A2", "A5", "A6", "F1", "J1"},
    ),
    "configs": ("models:\n  proj:\n    +copy_grants: true\n    daily:\n      +materialized: 'incremental'\n", "yaml", {"P2", "P6"}),
    "database": ("sources:\n  - name: erp\n    database: prod\n", "yaml", {"P3"}),
    "yaml grants": ("models:\n  proj:\n    +grants:\n      select: [reader]\n", "yaml", {"P2"}),
    "hooks": ("on-run-end:\n  - a; b\n", "yaml", {"P10"}),
    "null text": (None, "sql", set()),
}


@pytest.fixture(scope="module")
def found(spark):
    return hits(spark, {k: (t, c) for k, (t, c, _) in CASES.items()})


@pytest.mark.parametrize("case", CASES)
def test_rules_fire(found, case):
    assert {h[0] for h in found[case]} == CASES[case][2]


def test_classes(spark, found):
    got = {k: {h[2] for h in v if h[3]} for k, v in found.items()}
    assert got["bare decimal"] == {"AGENT_PLUS_REVIEW"} and got["random"] == {"REDESIGN"} and got["secure"] == {"REDESIGN"}
    assert got["desc"] == set() and got["grants"] == got["yaml grants"] == {"NOT_SUPPORTED_TODAY"}


def test_lines_and_text(spark):
    text = "select d.doc:visit::string as v,\n doc:cart.total as t,\n x.value:code as c\nfrom d where iff\n (a, b, c)"
    got = hits(spark, {"a": (text, "sql")})["a"]
    assert sorted(h[1] for h in got if h[0] == "J1") == [1, 2, 3]
    assert [(h[1], h[5]) for h in got if h[0] == "S1"] == [(4, "iff (")]


def test_a_long_text_is_scanned_whole(spark):
    text = "select 'x''y' -- nvl(\n" * 40_000 + "from t where nvl(a, b)"
    got = hits(spark, {"a": (text, "sql")})["a"]
    assert [(h[0], h[1]) for h in got] == [("S2", 40_001)]


def test_masking_keeps_length_and_lines(spark):
    src = "select 1 -- iff(a)\nfrom /* x\ny */ t where a = 'it''s' {# n\n #} $$ b $$\n"
    row = spark.range(1).select(
        textscan.mask_sql(F.lit(src)).alias("a"), textscan.mask_sql(F.lit(src), keep_strings=True).alias("b")
    ).first()
    for masked in row:
        assert len(masked) == len(src) and [i for i, c in enumerate(masked) if c == "\n"] == [i for i, c in enumerate(src) if c == "\n"]
    assert "iff" not in row["a"] and "it" not in row["a"] and "'it''s'" in row["b"] and "n" not in row["b"].split("'s'")[1]


def test_rule_table():
    assert len(rules.RULES) == 62
    assert [sum(r.text_kind == c for r in rules.RULES) for c in ("sql", "proc", "yaml")] == [54, 2, 6]


def test_alias_shadow(spark):
    corpus = spark.createDataFrame(
        [
            ("a", "select\n  nvl(rate, 1) as rate,\n  fee * rate as charged\nfrom t\n"),
            ("b", "select cast(n as text) as m,\n  text from t\n"),
            ("c", "select a as b,\n 1 as c\nselect b from t"),
        ],
        "path string, text string",
    )
    assert [tuple(r) for r in textscan.alias_shadow(corpus).collect()] == [("a", 3, "rate")]


def test_regex_backslashes(spark):
    corpus = spark.createDataFrame([("a", "select 1,\nregexp_count(s, '\\\\w+') from t\n"), ("b", "regexp_count(s, 'w')")], "path string, text string")
    assert [tuple(r) for r in textscan.regex_backslashes(corpus).collect()] == [("a", 2, "\\\\w+")]


def test_macro_risk_reaches_callers(spark):
    nodes = spark.createDataFrame([("clean",), ("caller",), ("macro",)], "path string")
    found = spark.createDataFrame(
        [("macro", "N7", "DIV0", "AGENT_PLUS_REVIEW", True, 1, "div0("), ("clean", "A4", "DESC", "AGENT_PLUS_REVIEW", False, 1, "desc")],
        "path string, rule string, construct string, class string, counts boolean, line_no int, matched string",
    )
    calls = spark.createDataFrame([("caller", "macro")], "caller string, macro string")
    got = {r["path"]: tuple(r)[1:] for r in textscan.classify_texts(nodes, found, calls).collect()}
    assert got["clean"] == ("AUTOMATIC", "", "", False)
    assert got["caller"] == ("AGENT_PLUS_REVIEW", "", "N7", True)
    assert got["macro"] == ("AGENT_PLUS_REVIEW", "N7", "", False)


def test_every_construct_is_planted():
    """The statements of the registered query hold all constructs of the rulebook, and some of them none."""
    from catalog.planted import PLANTED

    found = {hit.rsplit(" ", 1)[0] for _, _, hits in PLANTED for hit in hits}
    assert found == {r.name for r in rules.RULES} and len(rules.RULES) == 62 and sum(not hits for _, _, hits in PLANTED) > 5


def test_one_file_is_dealt_out(spark):
    """A corpus in one partition is scanned by as many tasks as a shuffle has; positions are those of the text."""
    text = "select nvl(a, b)\nfrom t where {{ a / b }} > 1 and c / d > nvl(e, 1)"
    corpus = spark.createDataFrame([(f"p{i}", "sql", text) for i in range(64)], "path string, context string, text string").coalesce(1)
    assert textscan.spread(corpus).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    hits = textscan.scan(corpus, ["NVL family", "division"])
    assert "RoundRobinPartitioning" in hits._jdf.queryExecution().optimizedPlan().toString() or "RoundRobinPartitioning" in hits._jdf.queryExecution().executedPlan().toString()
    found = {tuple(r) for r in hits.where("path = 'p7'").select("construct", "line_no", "matched").collect()}
    assert found == {("NVL family", 1, "nvl("), ("NVL family", 2, "nvl("), ("division", 2, "/")}


def test_alias_shadow_keeps_few_lines(spark, monkeypatch):
    """Lines that name nothing, use no alias and begin no select list go no further than their text."""
    stored, original = [], textscan.cut_lineage
    monkeypatch.setattr(textscan, "cut_lineage", lambda df: stored.append(original(df)) or stored[-1])
    idle = "\n".join(f"plain words {i}" for i in range(500))
    rows = [("a", f"select x as y,\n{idle}\n y + 1 as z\nselect y"), ("b", idle + "\nselect y\n"), ("c", None)]
    found = textscan.alias_shadow(spark.createDataFrame(rows, "path string, text string"))
    assert [tuple(r) for r in found.collect()] == [("a", 502, "y")]
    assert [df.count() for df in stored] == [3]
