"""Statements with known hits, one or more for every construct of the estate scan, and some that must give none.

A row: the kind of text, the statement, and what the scan has to find in it as construct and line. The
statements are planted before the text of every document, so real text follows them.
"""

from __future__ import annotations

# fmt: off
PLANTED = (
    ("sql", "select iff(late, 'y', 'n') as flag from t;", ("IFF 1",)),
    ("sql", "select nvl(a, 0),\n  equal_null(a, b), zeroifnull(c) from t;", ("NVL family 1", "NVL family 2", "NVL family 2")),
    ("sql", "select decode(state, 1, 'on') from t;", ("DECODE 1",)),
    ("sql", "select greatest(a, b),\n\n least_ignore_nulls(a, b) from t;", ("GREATEST / LEAST 1", "GREATEST / LEAST 3")),
    ("sql", "select concat_ws('-', a, b) from t;", ("CONCAT / CONCAT_WS 1",)),
    ("sql", "create table t (n number(10, 2), m number );", ("NUMBER type 1", "NUMBER type 1")),
    ("sql", "select a::integer,\n cast(b as tinyint) from t;", ("integer cast 1", "integer cast 2")),
    ("sql", "select p::numeric from t;", ("bare decimal cast 1",)),
    ("sql", "select total / days from t;", ("division 1",)),
    ("sql", "select round(fee, 1, 'half_to_even') from t;", ("round half to even 1",)),
    ("sql", "select div0null(a, b) from t;", ("DIV0 1",)),
    ("sql", "select k,\n avg(v) from t group by k;", ("AVG 2",)),
    ("sql", "select try_to_decimal(s, 10, 2) from t;", ("TO_NUMBER family 1",)),
    ("sql", "create table t (seen timestamp_ltz, was timestamp_tz);", ("zoned timestamp type 1", "zoned timestamp type 1")),
    ("sql", "create table t (seen timestamp_ntz);", ("TIMESTAMP_NTZ 1",)),
    ("sql", "select to_char(d, 'YYYY') from t;", ("TO_VARCHAR / TO_CHAR 1",)),
    ("sql", "select dateadd(day, 1, d) from t;", ("DATEADD family 1",)),
    ("sql", "select datediff(day, a, b) from t;", ("DATEDIFF family 1",)),
    ("sql", "select date_trunc('week', d) from t;", ("DATE_TRUNC / TRUNC 1",)),
    ("sql", "select dayname(d), weekofyear(d) from t;", ("day and week names 1", "day and week names 1")),
    ("sql", "select date_part(hour, d) from t;", ("DATE_PART 1",)),
    ("sql", "select last_day(d), to_date(s) from t;", ("date constructors 1", "date constructors 1")),
    ("sql", "select current_date as today\n from t where seen < sysdate();", ("clock functions 1", "clock functions 2")),
    ("sql", "select uuid_string() as id, ids.nextval from t;", ("random values and sequences 1", "random values and sequences 1")),
    ("sql", "select convert_timezone('UTC', 'Asia/Tokyo', seen) from t;", ("CONVERT_TIMEZONE 1",)),
    ("sql", "select doc:kind from t;", ("semi-structured path 1",)),
    ("sql", "select parse_json(s), object_keys(o) from t;", ("JSON functions 1", "JSON functions 1")),
    ("sql", "select body['kind'] from t;", ("semi-structured subscript 1",)),
    ("sql", "select typeof(v) from t;", ("TYPEOF 1",)),
    ("sql", "select 1 from t, lateral flatten(input => v) x;", ("FLATTEN 1",)),
    ("sql", "select f.path\n from t, table(explode_all(input => v, recursive => true)) f;", ("recursive FLATTEN 1", "recursive FLATTEN 2")),
    ("sql", "select listagg(n, ',') from t;", ("LISTAGG 1",)),
    ("sql", "select ratio_to_report(v) over (partition by k) from t;", ("RATIO_TO_REPORT 1",)),
    ("sql", "select array_agg(n) from t;", ("ARRAY_AGG 1",)),
    ("sql", "select n from t order by n desc, m desc nulls last;", ("DESC without NULLS 1",)),
    ("sql", "select nth_value(v, 2) over (order by k) from t;", ("LAST_VALUE / NTH_VALUE 1",)),
    ("sql", "select n from t\nqualify rank() over (order by n) = 1;", ("QUALIFY 2",)),
    ("sql", "select count_if(late) from t;", ("COUNT_IF 1",)),
    ("sql", "select booland_agg(ok) from t;", ("boolean aggregates 1",)),
    ("sql", "select any_value(n), hash_agg(m) from t;", ("estimates and arbitrary picks 1", "estimates and arbitrary picks 1")),
    ("sql", "select 1 from t where s rlike 'a+' or regexp_count(s, 'b') > 1;", ("regular expressions 1", "regular expressions 1")),
    ("sql", "select split_part(s, '-', 1) from t;", ("SPLIT family 1",)),
    ("sql", "select charindex('a', s), endswith(s, 'b') from t;", ("CHARINDEX / STARTSWITH / ENDSWITH 1", "CHARINDEX / STARTSWITH / ENDSWITH 1")),
    ("sql", "select initcap(s) from t;", ("INITCAP 1",)),
    ("sql", "select hash(s) from t;", ("HASH 1",)),
    ("sql", "select top 5 n from t;", ("TOP n 1",)),
    ("sql", "select n from t sample (10);", ("SAMPLE 1",)),
    ("sql", "grant select on t to role reader;\nrevoke all on t from role reader;", ("GRANT / REVOKE 1", "GRANT / REVOKE 2")),
    ("sql", "create table u clone t;\nselect n from t at (offset => -60);", ("CLONE / UNDROP / time travel 1", "CLONE / UNDROP / time travel 2")),
    ("sql", "create transient table t (n text) cluster by (n);", ("physical options 1", "physical options 1")),
    ("sql", "create secure view v as select 1;", ("secure view / tags 1",)),
    ("sql", "set limit_of = 5;\nselect n from identifier($named);", ("IDENTIFIER and session variables 1", "IDENTIFIER and session variables 2", "IDENTIFIER and session variables 2")),
    ("sql", "select 1 from prod_db.sales.invoices;", ("three-part name 1",)),
    ("sql", "call refresh_all();\nexecute immediate stmt;", ("scripting statements 1", "scripting statements 2")),
    ("proc", "begin\n insert into t select 1;\nend;", ("BEGIN block 1",)),
    ("proc", "for i in 1 to 3 do x;\nend for;", ("control flow 1",)),
    ("proc", "return iff(a, 1, 2);", ("IFF 1",)),
    ("yaml", "models:\n  +transient: true\n  +copy_grants: true", ("physical model configs 2", "physical model configs 3")),
    ("yaml", "models:\n  +grants:", ("grants config 2",)),
    ("yaml", "sources:\n  - name: erp\n    database: prod", ("source database 3",)),
    ("yaml", "models:\n  +materialized: incremental", ("incremental materialization 2",)),
    ("yaml", "models:\n  +materialized: 'dynamic_table'", ("materialized view 2",)),
    ("yaml", "on-run-end:\n  - a", ("statement hooks 1",)),
    # nothing is to be found in these: comments, literals, templates, names that only look alike, other kinds of text
    ("sql", "select 1 -- nvl(a, b) / c, typeof(d)\n from t;", ()),
    ("sql", "select 2 /* hash(s)\n qualify */ {# iff(a, b, c) #} from t;", ()),
    ("sql", "select 'decode(a, 1, 2)' as note, 'it''s avg(x)' as more from t;", ()),
    ("sql", "select {{ a / b }} as y from {{ source('erp', 'invoices') }};", ()),
    ("sql", "select nvl_of, long_desc, nextval_seen, describe_me, x.grants from t;", ()),
    ("sql", "select p::numeric(12, 4), q::text from t;", ()),
    ("yaml", "models:\n  - name: grants_of\n    meta: 'transient: true'", ()),
)
# fmt: on
