"""Semi-structured values: JSON text on disk, VARIANT in flight."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equipoise.session import cut_lineage

# Spark's variant type names and the names the source warehouse reports.
VARIANT_TYPE_NAMES = {
    "BIGINT": "INTEGER",
    "DOUBLE": "DOUBLE",
    "STRING": "VARCHAR",
    "BOOLEAN": "BOOLEAN",
    "VOID": "NULL_VALUE",
}


def _path(path: str) -> str:
    return "$" + (path if path.startswith("[") else "." + path)


#: A number as the engine prints it below 0.001 and from 10 million on.
_SCIENTIFIC = "^(-?)([0-9])[.]([0-9]+)E(-?[0-9]+)$"


def _without_exponent(text: Column) -> Column:
    """The same number with all its digits: 9.0E7 is 90000000.0."""
    sign, first, rest, power = (F.regexp_extract(text, _SCIENTIFIC, i) for i in range(1, 5))
    digits, places = F.concat(first, F.regexp_replace(rest, "0+$", "")), power.try_cast("int")
    after = F.substring(digits, places + 2, F.length(digits))
    large = F.concat(F.rpad(digits, places + 1, F.lit("0")), F.lit("."), F.when(after == "", "0").otherwise(after))
    return F.concat(sign, F.when(places >= 0, large).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -places - 1), digits)))


def get_text(json: Column, path: str) -> Column:
    """Missing key, JSON null and NULL column all give NULL; indexes are 0-based. Numbers of any size come without an exponent."""
    text = F.get_json_object(json, _path(path))
    # Only what looks like such a number is parsed again: a string may look the same. As a function of an array it adds
    # no code to a compiled plan, which becomes slow when it is long.
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(json), _path(path), "variant"))
    spelled = F.transform(F.array(text), lambda t: F.when(F.coalesce(kind, F.lit("STRING")) == "STRING", t).otherwise(_without_exponent(t)))
    return F.when(text.rlike(_SCIENTIFIC), F.element_at(spelled, 1)).otherwise(text)


def get_typed(json: Column, path: str, sql_type: str) -> Column:
    """The path cast to ``sql_type``; text that does not parse raises."""
    return F.get_json_object(json, _path(path)).cast(sql_type)


def try_get_typed(json: Column, path: str, sql_type: str) -> Column:
    return F.get_json_object(json, _path(path)).try_cast(sql_type)


def array_size(json: Column, path: str) -> Column:
    """NULL unless the path holds an array."""
    return F.json_array_length(F.get_json_object(json, _path(path)))


def is_json_null(json: Column, path: str) -> Column:
    """True for a JSON null, false for any other value, NULL for a missing key."""
    node = F.try_variant_get(F.try_parse_json(json), _path(path), "variant")
    return F.when(node.isNotNull(), F.is_variant_null(node))


def type_of(json: Column, path: str | None = None) -> Column:
    """The type name of a JSON text, or of what ``path`` leads to; NULL where it does not parse or leads nowhere."""
    value = F.try_parse_json(json)
    kind = F.schema_of_variant(value if path is None else F.try_variant_get(value, _path(path), "variant"))
    named = None
    for spark_name, name in VARIANT_TYPE_NAMES.items():
        named = F.when(kind == spark_name, name) if named is None else named.when(kind == spark_name, name)
    return (
        named.when(kind.startswith("DECIMAL"), "DECIMAL")
        .when(kind.startswith("ARRAY"), "ARRAY")
        .when(kind.startswith("OBJECT"), "OBJECT")
    )


def object_construct(**fields: Column) -> Column:
    """JSON object text; pairs whose value is NULL are left out."""
    return F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()]))


def object_construct_keep_null(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})


def flatten(df: DataFrame, json: Column, path: str, *, outer: bool = False) -> DataFrame:
    """One row per array element: ``position`` (0-based) and ``item`` (VARIANT).

    An empty, missing or non-array path gives no row, or one row with NULLs when ``outer``.
    """
    items = F.try_variant_get(F.try_parse_json(json), _path(path), "array<variant>")
    explode = F.posexplode_outer if outer else F.posexplode
    return df.select("*", explode(items).alias("position", "item"))


def flatten_object(df: DataFrame, json: Column, path: str) -> DataFrame:
    """One row per key of a JSON object: ``key`` and ``item`` (VARIANT)."""
    entries = F.try_variant_get(F.try_parse_json(json), _path(path), "map<string,variant>")
    return df.select("*", F.explode(entries).alias("key", "item"))


def flatten_recursive(df: DataFrame, json: Column, *, outer: bool = False) -> DataFrame:
    """One row for every value inside a JSON text, at any depth: ``path``, ``depth``, ``key`` or ``index``, ``item`` and the ``this`` it is in.

    Paths are written ``a.b[0]``; an element of an array has an index and no key. Descends level by level:
    a step explodes the containers of one level, without a shuffle, and stores them, so a step's plan and
    work are those of its level alone and there is no limit on the depth. Texts that are no JSON, scalars
    and empty containers give no rows, or with ``outer`` one row of NULLs.
    """
    whole = [c for c in df.columns if c not in ("path", "depth", "key", "index", "item", "this")]
    top = df.select(*[F.col(f"`{c}`") for c in whole], F.try_parse_json(json).alias("item"))
    kind = F.schema_of_variant("item")
    container = F.coalesce(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.lit(False))
    level = cut_lineage(top.where(container).select("*", F.lit("").alias("path"), F.lit(0).alias("depth")))
    found = []
    while not level.isEmpty():
        fields, elements = F.try_variant_get("item", F.lit("$"), "map<string,variant>"), F.try_variant_get("item", F.lit("$"), "array<variant>")
        entry = "struct<key:string,index:int,item:variant>"
        of_object = F.transform(F.map_entries(fields), lambda e: F.struct(e["key"].alias("key"), F.lit(None).cast("int").alias("index"), e["value"].alias("item")))
        of_array = F.transform(elements, lambda v, i: F.struct(F.lit(None).cast("string").alias("key"), i.alias("index"), v.alias("item")))
        inner = F.explode(F.when(kind.startswith("OBJECT"), of_object.cast(f"array<{entry}>")).otherwise(of_array.cast(f"array<{entry}>")))
        spread = level.select(*[F.col(f"`{c}`") for c in whole], "path", "depth", F.col("item").alias("this"), inner.alias("e"))
        step = F.when(F.col("e.key").isNull(), F.concat(F.lit("["), F.col("e.index").cast("string"), F.lit("]"))).when(F.col("path") == "", F.col("e.key")).otherwise(F.concat(F.lit("."), "e.key"))
        found.append(cut_lineage(spread.select(*[F.col(f"`{c}`") for c in whole], F.concat("path", step).alias("path"), (F.col("depth") + 1).alias("depth"), "e.key", "e.index", "e.item", "this")))
        level = found[-1].where(container).select(*[F.col(f"`{c}`") for c in whole], "item", "path", "depth")
    empty = top.where(~F.coalesce(container & ~F.to_json("item").isin("{}", "[]"), F.lit(False)))
    nothing = empty.select(
        *[F.col(f"`{c}`") for c in whole], *[F.lit(None).cast(t).alias(c) for c, t in (("path", "string"), ("depth", "int"), ("key", "string"), ("index", "int"))],
        *[F.parse_json(F.lit(None).cast("string")).alias(c) for c in ("item", "this")],
    )
    return reduce(DataFrame.unionByName, found + [nothing if outer else nothing.limit(0)])


def item_text(item: Column, path: str) -> Column:
    return F.try_variant_get(item, _path(path), "string")


def array_construct(*values: Column) -> Column:
    """JSON array text of values of any types, in order; NULL is kept as JSON null."""
    alone = [F.to_json(F.array(v)) for v in values]
    inner = F.concat_ws(",", *[F.substring(t, F.lit(2), F.length(t) - 2) for t in alone])
    return F.concat(F.lit("["), inner, F.lit("]"))


def object_keys(json: Column) -> Column:
    return F.json_object_keys(json)
