"""Scan of a SQL-text corpus for dialect constructs.

The corpus is a table (path, context, text). All work is per text, inside the JVM and without a
grouping: comments and literals are blanked at equal length so offsets still point into the
original, one pass lists the functions a text calls, and only texts with a match pay for positions.
Before that, texts are dealt out evenly. Alias hints join lines and names of a text, but only those
lines that begin a block, name something or use a name.
"""

from __future__ import annotations

from collections.abc import Callable, Collection
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equipoise.operators.keyed import attach
from equipoise.operators.positions import with_position
from equipoise.plans.closure import upstream
from equipoise.plans.rules import CLASSES, REDESIGN, REVIEW, RULES, UNSUPPORTED, full_pattern
from equipoise.session import cut_lineage

_MARK, _TEMPLATE = "\u0001", "\u0002"
# The delimiters of comments, template comments, dollar bodies and literals.
_COMMENTS = r"--[^\n]*|/\*.*?(?:\*/|\z)|\{#.*?(?:#\}|\z)|\$\$.*?(?:\$\$|\z)"
_LITERAL = r"'[^']*+(?:''[^']*+)*+'?"
_TEMPLATES = r"\{\{.*?\}\}|\{%.*?%\}"
# Words after AS that are types, not aliases.
TYPE_NAMES = (
    "varchar", "decimal", "numeric", "number", "timestamp", "timestamptz", "date", "double", "float", "real",
    "bigint", "hugeint", "integer", "int", "boolean", "json", "text", "string",
)


def _segments(text: Column, special: str, openers: str) -> Column:
    """The text cut into special spans and the stretches between them."""
    return F.regexp_extract_all(text, F.lit(f"(?s){special}|[^{openers}]++|."), F.lit(0))


def mask_sql(text: Column, *, keep_strings: bool = False) -> Column:
    """Comments (and literals) blanked; length and line breaks stay the same."""
    special = _COMMENTS if keep_strings else f"{_COMMENTS}|{_LITERAL}"
    openers = "-/{$" if keep_strings else "-/{$'"
    opened = r"(?s)^(?:--|/\*|\{#|\$\$" + ("" if keep_strings else "|'") + ").*"
    blank = lambda s: F.when(s.rlike(opened), F.regexp_replace(s, r"[^\n]", " ")).otherwise(s)
    blanked = F.array_join(F.transform(_segments(text, special, openers), blank), "")
    present = r"--|/\*|\{#|\$\$" + ("" if keep_strings else "|'")
    return F.translate(F.when(text.rlike(present), blanked).otherwise(text), _MARK + _TEMPLATE, "  ")


def mask_templates(text: Column) -> Column:
    """Template spans overwritten with a marker, at equal length."""
    inside = lambda s: F.when(s.rlike(r"(?s)^(?:\{\{|\{%).+"), F.repeat(F.lit(_TEMPLATE), F.length(s))).otherwise(s)
    plain = F.translate(text, _TEMPLATE, " ")
    return F.array_join(F.transform(_segments(plain, _TEMPLATES, "{"), inside), "")


def spread(texts: DataFrame) -> DataFrame:
    """The same rows dealt out evenly: a file of few row groups would otherwise keep all but a few tasks idle.

    Rows go round, so neither a long file nor a path that repeats weighs on one task. Looking through a
    text takes far longer than sending it once.
    """
    return texts.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: Numbers that are summed one by one; whole blocks before them come as one sum.
_BLOCK = 256


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda total, v: total + v)


def _with_running(df: DataFrame, **sums: str) -> DataFrame:
    """For each new column the sums [0, v1, v1 + v2, ...] of an array column.

    Sums of blocks, then of the blocks before each block, then within a block: a step only reads
    columns of the step before, so the work grows with the length of the array and not with its square.
    """
    part = lambda name, block, n: F.slice(name, block * _BLOCK + 1, n)
    blocks = lambda name: F.sequence(F.lit(0), F.floor(F.size(name) / _BLOCK).cast("int"))
    ahead = lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v))
    block_sums = lambda name: F.transform(blocks(name), lambda k: _sum(part(name, k, F.lit(_BLOCK))))
    df = df.withColumns({f"{new}_blocks": block_sums(name) for new, name in sums.items()})
    df = df.withColumns({f"{new}_before": F.aggregate(f"{new}_blocks", F.array(F.lit(0)), ahead) for new in sums})

    def running(new: str, name: str) -> Column:
        block = lambda i: F.floor(i / _BLOCK).cast("int")
        return F.transform(
            F.sequence(F.lit(0), F.size(name)),
            lambda i: F.get(F.col(f"{new}_before"), block(i)) + _sum(part(name, block(i), i % _BLOCK)),
        )

    return df.withColumns({new: running(new, name) for new, name in sums.items()})


def located(df: DataFrame, haystack: Column, pattern: Column, *kept: str, shown: Callable | None = None, **arrays: Column) -> DataFrame:
    """One row per match of ``pattern``: ``start`` (0-based), ``line`` (1-based), ``size``.

    ``kept`` columns pass through; ``arrays`` are extra per-match arrays. ``shown`` makes a further column
    of start and size; it is None where a match does not count. It may read columns that are not kept, so
    long texts are not copied for each match. One pass marks both ends of every match and the text is cut
    there; running sums of the pieces' lengths and line breaks place the matches; each step is a column of
    its own, so nothing is computed per match.
    """
    read = [c for c in df.columns if shown is not None or c in kept]
    cut = df.select(*read, haystack.alias("_hay"), pattern.alias("_pattern")).withColumns(
        {"_pieces": F.split(F.regexp_replace("_hay", F.col("_pattern"), F.lit(f"{_MARK}$0{_MARK}")), _MARK, -1), **{f"_{n}": a for n, a in arrays.items()}}
    )
    breaks = lambda p: F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit("")))
    # pieces are text, match, text, match, ..., text
    measures = cut.select(
        *read, *[F.col(f"_{n}") for n in arrays], F.transform("_pieces", F.length).alias("_each"), F.transform("_pieces", breaks).alias("_each_breaks"),
    )
    count = F.floor(F.size("_each") / 2).cast("int")
    matches = F.slice(F.sequence(F.lit(0), count), F.lit(1), count)
    # from a match's begin (or the text's) to the next one's
    stretch = lambda name: F.concat(F.slice(name, 1, 1), F.transform(matches, lambda k: F.get(name, 2 * k + 1) + F.get(name, 2 * k + 2)))
    lengths = measures.select(
        *read, *[F.col(f"_{n}") for n in arrays],
        F.transform(matches, lambda k: F.get("_each", 2 * k + 1)).alias("_size"), stretch("_each").alias("_lengths"), stretch("_each_breaks").alias("_lines"),
    )
    measured = _with_running(lengths, _starts="_lengths", _breaks="_lines")
    nth = lambda c: F.slice(c, F.lit(2), F.size("_size"))
    fields = ["_start", "_break", "_size", *[f"_{n}" for n in arrays]]
    zipped = F.arrays_zip(*fields)
    placed = measured.select(*read, "_size", *[F.col(f"_{n}") for n in arrays], nth("_starts").alias("_start"), nth("_breaks").alias("_break"))
    names = ["start", "breaks", "size", *arrays]
    if shown is not None:
        with_shown = lambda m: F.struct(*[m[f].alias(n) for f, n in zip(fields, names, strict=True)], shown(m["_start"], m["_size"]).alias("shown"))
        zipped, names = F.filter(F.transform(zipped, with_shown), lambda m: m["shown"].isNotNull()), [*names, "shown"]
    rows = placed.select(*kept, F.inline(zipped)).toDF(*kept, *names)
    return rows.withColumn("line", F.col("breaks") + 1).drop("breaks")


def scan(corpus: DataFrame, constructs: Collection[str] | None = None) -> DataFrame:
    """Every hit: (path, rule, construct, class, counts, line_no, matched); of the named constructs alone where some are named."""
    unknown = set(constructs or ()) - {r.name for r in RULES}
    if unknown:
        raise ValueError("no such construct: " + ", ".join(sorted(unknown)))
    parts = [
        _scan_context(corpus.where(F.col("context") == context), context, constructs) for context in ("sql", "proc", "yaml")
    ]
    return reduce(DataFrame.unionByName, parts)


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _bool(value: bool) -> str:
    return str(value).lower()


def _fires(rule, flags: str) -> str:
    tests = []
    if rule.functions:
        tests.append(f"arrays_overlap(called, array({', '.join(_sql(n) for n in rule.functions.split())}))")
    if rule.pattern:
        # Inside a literal the construct is looked for again on the hits, with literals kept.
        where, lowered = ("text", "lowered_text") if "strings" in rule.marks else ("code", "lowered")
        checks = [" or ".join(f"contains({lowered}, {_sql(n)})" for n in rule.words.split())] if rule.words else []
        checks += [f"rlike({where}, {_sql(rule.gate)})"] if rule.gate else []
        checks += [f"rlike({where}, {_sql(flags + rule.pattern)})"]
        tests.append("(" + " and ".join(f"({c})" for c in checks) + ")")
    return " or ".join(tests)


def _scan_context(texts: DataFrame, context: str, constructs: Collection[str] | None) -> DataFrame:
    # Java's U flag gives \w, \b and \s the Unicode meaning the patterns were written for.
    flags = "(?iuUm)" if context == "yaml" else "(?iuU)"
    # a procedure body is searched for what SQL texts are searched for, too
    kinds = {context, "sql"} if context == "proc" else {context}
    rules = [(i, r) for i, r in enumerate(RULES) if r.text_kind in kinds and (constructs is None or r.name in constructs)]
    sql = context != "yaml"
    prepared = spread(texts).select(
        "path", "text", (mask_sql(F.col("text")) if sql else F.translate("text", _MARK, " ")).alias("code")
    )
    # One pass lists the functions a text calls; a rule made of names is then a set lookup.
    calls = "array_distinct(transform(regexp_extract_all(code, r'(?U)\\b(\\w++)\\s*+\\(', 1), c -> lower(c)))"
    prepared = prepared.selectExpr(
        "*", "lower(code) as lowered", "lower(text) as lowered_text",
        f"if(contains(code, '('), {calls}, array()) as called" if sql else "cast(array() as array<string>) as called",
    )
    # Tests as one SQL expression: an alternative with fixed text is searched for that text first.
    fired = ", ".join(["cast(null as int)", *(f"if({_fires(r, flags)}, {i}, null)" for i, r in rules)])
    pairs = prepared.select("path", "text", "code", F.explode(F.expr(f"array_compact(array({fired}))")).alias("rule_no"))
    entries = ", ".join(
        f"struct({_sql(flags + full_pattern(r))} as pattern, '{r.id}' as rule, {_sql(r.name)} as construct, '{r.cost}' as class, "
        f"{_bool('hint' not in r.marks)} as counts, {_bool('templates' in r.marks)} as skip, {_bool('strings' in r.marks)} as keep)"
        for r in RULES
    )
    table = F.expr(f"array({entries})")
    # Only pairs with a match pay for positions, and only these are masked again where a rule asks for it.
    haystack = F.when(F.col("r.keep"), mask_sql(F.col("text"), keep_strings=True)).otherwise(F.col("code"))
    placed = pairs.withColumn("r", F.get(table, F.col("rule_no")))
    if sql:
        opened = F.col("text").contains("{{") | F.col("text").contains("{%")
        placed = placed.withColumn("template", F.when(F.col("r.skip") & opened, mask_templates(F.col("text"))))
    else:
        placed = placed.withColumn("template", F.lit(None).cast("string"))

    def matched(start: Column, size: Column) -> Column:
        in_template = F.substring(F.col("template"), start + 1, F.lit(1)) == _TEMPLATE
        text = F.trim(F.regexp_replace(F.substring(F.col("text"), start + 1, size), r"(?U)\s+", " "))
        return F.when(~F.coalesce(in_template, F.lit(False)), text)

    hits = located(placed, haystack, F.col("r.pattern"), "path", "r", shown=matched)
    return hits.select(
        "path", F.col("r.rule").alias("rule"), F.col("r.construct").alias("construct"), F.col("r.class").alias("class"),
        F.col("r.counts").alias("counts"), F.col("line").alias("line_no"), F.col("shown").alias("matched"),
    )


# --------------------------------------------------------------------------- hints


def alias_shadow(corpus: DataFrame) -> DataFrame:
    """(path, line_no, alias): a name used again in the select list that just aliased it.

    Candidates to read, not defects.
    """
    alias = r"[^a-z0-9_]as[ \t]+([a-z_][a-z0-9_]*)"
    word = r"(?<![a-z0-9_.])([a-z_][a-z0-9_]*+)(?![a-z0-9_.(])"
    # fixed text that every match holds is looked for first, which is many times faster than the patterns
    can_name = lambda line: line.contains("as ") | line.contains("as\t")
    names_in = lambda line: F.filter(F.regexp_extract_all(line, F.lit(alias), F.lit(1)), lambda a: ~a.isin(*TYPE_NAMES))
    known_in = lambda line: F.when(can_name(line), names_in(line)).otherwise(F.expr("cast(array() as array<string>)"))
    # texts are told apart by a number, since paths may repeat
    lines = spread(corpus.select("path", "text")).select("path", F.split(F.lower(mask_sql(F.col("text"))), r"\r?\n", -1).alias("lines"))
    named = lines.withColumn("known", F.transform("lines", known_in)).withColumn("text_no", F.monotonically_increasing_id())
    numbered = named.withColumn("names", F.array_distinct(F.flatten("known")))

    def looked_at(line: Column, at: Column) -> Column:
        rest = F.when(can_name(line), F.regexp_replace(line, alias, " ")).otherwise(line)
        used = F.array_intersect(F.regexp_extract_all(rest, F.lit(word), F.lit(1)), F.col("names"))
        begins = (line.contains("select") & line.rlike(r"(^|[^a-z0-9_])select([^a-z0-9_]|$)")).cast("int")
        return F.struct(at.alias("at"), begins.alias("begins"), F.get("known", at).alias("known"), used.alias("used"))

    # only lines that begin a block, name something or use a name of the text go on
    seen = F.filter(F.transform("lines", looked_at), lambda m: (m["begins"] > 0) | (F.size(m["known"]) > 0) | (F.size(m["used"]) > 0))
    # a text without an alias has nothing to find; said here, since a filter would be moved ahead of the masking and of spread
    found = F.inline(F.when(F.size("names") > 0, seen))
    # stored, since two sides read it and the numbers of texts have to be the same for both
    stored = cut_lineage(numbered.select("path", "text_no", found))
    order = Window.partitionBy("text_no").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    blocks = stored.withColumn("block", F.sum("begins").over(order))
    known = blocks.select("text_no", "block", "at", F.explode("known").alias("alias")).groupBy("text_no", "block", "alias").agg(F.min("at").alias("since"))
    used = blocks.select("path", "text_no", "block", "at", F.explode("used").alias("alias"))
    return used.join(known, ["text_no", "block", "alias"]).where("at > since").select("path", (F.col("at") + 1).alias("line_no"), "alias")


def regex_backslashes(corpus: DataFrame) -> DataFrame:
    """(path, line_no, literal): regex literals that contain a backslash, to be re-escaped by hand."""
    pattern = r"(?isU)\bregexp_\w+\s*\([^)]{0,400}?'((?:[^']|'')*+)'"
    plain = F.translate("text", _MARK, " ")
    literals = F.regexp_extract_all("_hay", F.lit(pattern), F.lit(1))
    found = located(corpus.where(F.col("text").contains("\\")), plain, F.lit(pattern), "path", literal=literals)
    return found.where(F.col("literal").contains("\\")).select(
        "path", F.col("line").alias("line_no"), "literal"
    )


# --------------------------------------------------------------------------- roll-ups


def severity(klass: Column) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in CLASSES]), klass) - 1


def class_of(rank: Column) -> Column:
    """The class of a severity rank; nothing at all is the cheapest class."""
    return F.get(F.array(*[F.lit(c) for c in CLASSES]), F.coalesce(rank, F.lit(0)).cast("int"))


def construct_frequency(hits: DataFrame) -> DataFrame:
    """Constructs that fired, most frequent first."""
    return hits.groupBy("rule", "construct", "class").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "rule", "construct")


def classify_texts(nodes: DataFrame, hits: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """Worst class per text, raised by all macros it reaches: those it calls, those they call, and so on.

    ``nodes``: path. ``calls``: caller, macro (both paths). Hits that do not count are ignored. The
    maximum along the call graph is the fixed point that a closure finds: each (macro, rule) travels to
    all callers in rounds that double the distance, so deep calls and cycles end; there are no more
    travellers than texts with hits times rules.
    """
    found = hits.where("counts").groupBy("path", "rule").agg(F.max(severity(F.col("class"))).alias("rank"))
    own = found.groupBy("path").agg(F.max("rank").alias("own_rank"), F.sort_array(F.collect_set("rule")).alias("rules"))
    ranked = nodes.join(own, "path", "left")
    if calls is None:
        inherited = ranked.withColumn("macro_rank", F.lit(None).cast("bigint")).withColumn("macro_rules", F.expr("cast(array() as array<string>)"))
    else:
        edges = cut_lineage(calls.select(F.col("macro").alias("node"), F.col("caller").alias("parent")).distinct())
        # from the direct callers on, so that what a text has of its own is not counted as inherited
        direct = cut_lineage(found.join(edges, found["path"] == edges["node"]).select(F.col("parent").alias("node"), "rule", "rank").distinct())
        carried = upstream(edges, direct, of=["rule", "rank"])
        # Rule ids form a small fixed set, so the collected set is bounded.
        pushed = carried.groupBy(F.col("node").alias("path")).agg(F.max("rank").alias("macro_rank"), F.sort_array(F.collect_set("rule")).alias("macro_rules"))
        inherited = ranked.join(pushed, "path", "left")
    own_rank, macro_rank = F.coalesce("own_rank", F.lit(0)), F.coalesce("macro_rank", F.lit(0))
    return inherited.select(
        "path",
        class_of(F.greatest(own_rank, macro_rank)).alias("class"),
        F.array_join(F.coalesce("rules", F.expr("cast(array() as array<string>)")), ",").alias("rules"),
        F.array_join(F.coalesce("macro_rules", F.expr("cast(array() as array<string>)")), ",").alias("macro_rules"),
        (macro_rank > own_rank).alias("raised_by_macro"),
    )


def classify_nodes(nodes: DataFrame, hits: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """``classify_texts`` for the nodes of a project, whose kind can decide alone; ``because`` names what did.

    ``nodes``: path, kind, language, materialized. Seeds and snapshots cannot run on the target at all,
    Python models are written anew, and an incremental model is at least reviewed.
    """
    judged = attach(classify_texts(nodes.select("path").distinct(), hits, calls), nodes.select("path", "kind", "language", "materialized"), ["path"])
    is_a = lambda column, value: F.coalesce(F.lower(column) == value, F.lit(False))
    fixed = F.when(is_a("kind", "seed") | is_a("kind", "snapshot"), F.lit(UNSUPPORTED)).when(is_a("language", "python"), F.lit(REDESIGN))
    incremental = is_a("materialized", "incremental")
    least = F.when(incremental, severity(F.lit(REVIEW))).otherwise(F.lit(0))
    raised = class_of(F.greatest(severity(F.col("class")), least))
    reason = (
        F.when(is_a("kind", "seed"), "seed").when(is_a("kind", "snapshot"), "snapshot").when(is_a("language", "python"), "python model")
        .when(incremental & (severity(F.col("class")) < severity(F.lit(REVIEW))), "incremental").when(F.col("raised_by_macro"), "macro")
        .when(F.col("rules") != "", "rules").otherwise("nothing found")
    )
    return judged.select("path", "kind", F.coalesce(fixed, raised).alias("class"), reason.alias("because"), "rules", "macro_rules")


def kind_frequency(tests: DataFrame, models: DataFrame) -> DataFrame:
    """How often each test type and each materialization (none: view) occurs: what, name, n and its ``position``, most frequent first.

    ``tests``: type. ``models``: materialized.
    """
    named = tests.select(F.lit("test").alias("what"), F.col("type").alias("name")).unionByName(
        models.select(F.lit("materialization").alias("what"), F.coalesce(F.nullif("materialized", F.lit("")), F.lit("view")).alias("name"))
    )
    counted = cut_lineage(named.groupBy("what", "name").agg(F.count(F.lit(1)).alias("n")))
    return with_position(counted, [F.col("n").desc(), "name"], ["what"])
