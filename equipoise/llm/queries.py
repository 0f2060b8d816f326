"""One query for each operator, over its whole table with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equipoise.llm import binary, counting, lattice, merkle, mixing, neardup, packing, quality, resampling, substrings, topk, url_filter, warc
from equipoise.llm.common import table
from equipoise.session import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

URL_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


OP1_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT r, i, md5(array_to_string(list_slice(ws, i, i + 34), ' ')) AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY win) AS c FROM s) WHERE c > 1),
g AS (SELECT r, i, max(i) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM d),
x AS (SELECT r, list(i ORDER BY i) AS gone FROM (SELECT r, unnest(range(greatest(i, coalesce(before, -99) + 35), i + 35)) AS i FROM g) GROUP BY r),
k AS (SELECT w.r, string_agg(w.word, ' ' ORDER BY w.i) AS kept FROM (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w) w
  LEFT JOIN (SELECT r, unnest(gone) AS i FROM x) y ON w.r = y.r AND w.i = y.i WHERE y.i IS NULL GROUP BY w.r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN x USING (r) LEFT JOIN k USING (r)
"""


@query("op1_lempel_ziv_substrings", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 35 words that stand more than once, taken out of all documents."""
    return substrings.remove_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op2_seekable_tokens")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to seekable files and read back."""
    folder, written = binary.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return binary.token_starts(spark, folder, written)


@query("op3_raked_mixture")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn so that tokens by source, language and topic follow tempered shares."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    counted = cut_lineage(mixing.with_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), topic_column="topic").drop("text"))
    targets = mixing.tempered_targets(counted, ("source", "lang", "topic"), "n_tokens", power=0.9, keep=0.85)
    return mixing.mix(counted, targets, keep=0.85).select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"), "sampled")


@query("op4_best_fit_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return packing.pack(pieces)


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
j AS (SELECT page_id, body, max(page_id) OVER (PARTITION BY body) AS last FROM p),
h AS (SELECT page_id, last, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS hex FROM j),
b AS (SELECT *, list_transform(range(1, 41), lambda i: instr('0123456789abcdef', hex[i]) - 1) AS d FROM h)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (list_sum(list_transform(range(0, 5), lambda t: (((d[(5*k+t)//4 + 1]::INT) >> (3 - (5*k+t) % 4)::INT) & 1) << (4-t)::INT))::INT + 1), 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM b
"""


@query("op5_warc_transactions", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC captures, and the transactions assembled from the archives."""
    return warc.page_captures(spark, warc.write_archives(table(spark, sf_dir, "pages")))


OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id,
  list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT r, array_to_string(list_slice(ws, i, i + 4), ' ') AS g FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
e AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
t(r, o) AS (SELECT r, r FROM w UNION SELECT t.r, l.b FROM t JOIN l ON l.a = t.o),
c AS (SELECT t.r, min(w.doc_id) AS component_id FROM t JOIN w ON w.r = t.o GROUP BY t.r)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, coalesce(w.doc_id = component_id, false) AS kept FROM w JOIN c USING (r) LEFT JOIN n USING (r)
"""


@query("op6_circulant_minhash", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies among all documents."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@query("op7_edit_aware_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents after four edits each: at the beginning, a third, the middle and the end."""
    docs, path = table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    trees = counting.token_trees(docs, path)
    n = F.coalesce(F.length("text"), F.lit(0))
    edit = lambda at, deleted, inserted: F.struct(at.cast("int").alias("at"), F.lit(deleted).alias("deleted"), F.lit(inserted).alias("inserted"))
    edits = F.array(edit(F.lit(0), 3, "Re: "), edit(n / 3, 0, " edited  here"), edit(n / 2, 40, "\n"), edit(n + 100, 0, " The end."))
    return counting.edited_counts(docs.withColumn("edits", edits), trees, path)


OP8_SQL = r"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages),
r(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (SELECT u.*, (SELECT arg_max({'rule': h || p, 'verdict': verdict}, length(h || p)) FROM r
  WHERE (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p)) AS best FROM u)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM m
"""


@query("op8_url_filter", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the trie."""
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5
"""


@query("op9_exact_top_k", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest rows of every fiftieth vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


@query("op10_quality_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and calibrated model for every document."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, model).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("probability", 6).alias("probability"))


@query("op11_lattice_scores")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability, summed over all segmentations of its words into subword pieces."""
    return lattice.score_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


#: CRC-32 of the UTF-8 bytes of x, a byte and seven zeros at a time.
_CRC_SQL = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, (length(hex(encode(x))) // 2 + 1)::BIGINT),
  lambda i: [((instr('0123456789ABCDEF', substr(hex(encode(x)), 2*i-1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(hex(encode(x)), 2*i, 1)) - 1)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, v: xor(xor(a, v) >> 1, 3988292384 * (xor(a, v) & 1))), 4294967295)"""

OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
dw AS (SELECT r, unnest(ws) AS x FROM d), bw AS (SELECT unnest(ws) AS x FROM b),
k AS (SELECT x, {_CRC_SQL} % 10000 AS bucket FROM (SELECT x FROM dw UNION SELECT x FROM bw)),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN k USING (x) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN k USING (x) GROUP BY 1),
n AS (SELECT (SELECT count(*) FROM dw)::DOUBLE AS ss, (SELECT count(*) FROM bw)::DOUBLE AS tt),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (ss + 10000) / ((s + 1)::DOUBLE * (tt + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), n),
w AS (SELECT r, sum(gain)::BIGINT AS weight FROM dw JOIN k USING (x) JOIN g USING (bucket) GROUP BY 1),
h AS (SELECT r, list_reduce(list_concat([0::BIGINT], list_transform(range(1, 9), lambda i: (instr('0123456789abcdef', substr(sha256('2024:' || coalesce(doc_id::VARCHAR, 'null')), i, 1)) - 1)::BIGINT)), lambda a, v: a * 16 + v) AS h FROM d),
o AS (SELECT r, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, (coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM d JOIN h USING (r) LEFT JOIN w USING (r)),
p AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place FROM o WHERE n_features >= 20)
SELECT o.doc_id, o.n_features, o.weight, o.score, CASE WHEN place <= 10 * (SELECT count(*) FROM p) // 100 THEN place END AS rank FROM o LEFT JOIN p USING (r)
"""


@query("op12_crc_resampling", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn towards the words of the benchmark."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_PART_SQL = "coalesce(strlen({0}) || ':' || {0}, '-')"
_LEAF_SQL = "sha256(" + " || ".join(_PART_SQL.format(c) for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", "{0}")) + ")"

OP13_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, *, {_LEAF_SQL.format("text")} AS leaf,
    {_LEAF_SQL.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS other, coalesce('=' || lang, '') AS tree FROM documents),
c AS (SELECT r, {_CRC_SQL} AS crc FROM (SELECT r, doc_id::VARCHAR AS x FROM d WHERE doc_id IS NOT NULL)),
p AS (SELECT d.r, doc_id, tree, leaf, CASE WHEN coalesce(crc % 3 = 0, false) THEN other ELSE leaf END AS start,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, d.r) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM d LEFT JOIN c ON c.r = d.r),
nodes(tree, l, i, digest, n) AS (SELECT tree, 0, i, leaf, n FROM p
  UNION ALL SELECT tree, l + 1, i // 8, sha256(string_agg(digest, '' ORDER BY i)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY tree, l, n, i // 8),
subroots AS (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
top(l, i, digest, n) AS (SELECT 0, i, digest, n FROM subroots
  UNION ALL SELECT l + 1, i // 8, sha256(string_agg(digest, '' ORDER BY i)), (n + 7) // 8 FROM top WHERE n > 1 GROUP BY l, n, i // 8),
steps AS (
  SELECT p.r, a.l, coalesce(string_agg(a.digest, '' ORDER BY a.i) FILTER (WHERE a.i < p.i // pow(8, a.l)::BIGINT), '') AS before, coalesce(string_agg(a.digest, '' ORDER BY a.i) FILTER (WHERE a.i > p.i // pow(8, a.l)::BIGINT), '') AS after
    FROM p JOIN nodes a ON a.tree = p.tree AND a.n > 1 AND a.i // 8 = p.i // pow(8, a.l + 1)::BIGINT GROUP BY p.r, a.l
  UNION ALL SELECT p.r, 100 + a.l, coalesce(string_agg(a.digest, '' ORDER BY a.i) FILTER (WHERE a.i < s.i // pow(8, a.l)::BIGINT), ''), coalesce(string_agg(a.digest, '' ORDER BY a.i) FILTER (WHERE a.i > s.i // pow(8, a.l)::BIGINT), '')
    FROM p JOIN subroots s ON s.tree = p.tree JOIN top a ON a.n > 1 AND a.i // 8 = s.i // pow(8, a.l + 1)::BIGINT GROUP BY p.r, a.l),
f AS (SELECT r, sha256(string_agg(before || after, '' ORDER BY l)) AS proof_sha256, list(before || '|' || after ORDER BY l) AS way FROM steps GROUP BY r)
SELECT p.doc_id, p.leaf, s.digest AS subroot, t.digest AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = t.digest AS verified
FROM p JOIN subroots s ON s.tree = p.tree JOIN top t ON t.n = 1
JOIN (SELECT p.r, proof_sha256, list_reduce(list_concat([start], coalesce(way, [])), lambda a, v: sha256(split_part(v, '|', 1) || a || split_part(v, '|', 2))) AS folded_root FROM p LEFT JOIN f ON f.r = p.r) z ON z.r = p.r
"""


@query("op13_merkle_versions", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof in the manifest, and whether its version with a tampered text still gives the root."""
    rows = merkle.verify_tampering(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
