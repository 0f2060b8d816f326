"""The registered queries against their SQL, and each stage of the pipeline against brute force, on the smallest data."""

import collections
import hashlib
import os
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
pytest.importorskip("public_tokenizers")
duckdb = pytest.importorskip("duckdb")

import corpus_pipeline  # noqa: E402
from equipoise.llm import queries  # noqa: E402
from test_llm_edges import BYTE, WORD, components, crc, encoded, removed, shingles  # noqa: E402
from test_llm_models import base_model  # noqa: E402

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="the given tables are not here")


def table(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(row[i] for i in order) for row in data), key=str)


def brute_files(rows):
    ids, start, out = [encoded(BYTE, r["text"], 2) for r in rows], 0, []
    for r, own in zip(rows, ids, strict=True):
        out.append((r["doc_id"], start, len(own), crc(own)))
        start += len(own)
    return ["doc_id", "start", "n_tokens", "ids_crc32"], out


def brute_pieces(rows):
    out = [(r["doc_id"], k // 4096, k, len(ids[k : k + 4096]), crc(ids[k : k + 4096])) for r in rows for ids in [encoded(WORD, r["text"], 1)] for k in range(0, len(ids), 4096)]
    return ["doc_id", "piece", "start", "length", "ids_crc32"], out


def brute_edits(rows):
    out = []
    for r in rows:
        text = r["text"] or ""
        n, before = len(text), len(encoded(BYTE, text, 2)) - 1
        for at, deleted, inserted in ((0, 3, "Re: "), (n // 3, 0, " edited  here"), (n // 2, 40, "\n"), (n + 100, 0, " The end.")):
            at = min(at, len(text))
            text = text[:at] + inserted + text[at + deleted :]
        out.append((r["doc_id"], before, len(encoded(BYTE, text, 2)) - 1))
    return ["doc_id", "n_tokens", "n_tokens_after"], out


def brute_quality(rows):
    out = []
    for r in rows:
        text, words, seen = r["text"] or "", (r["text"] or "").encode().split(), set()
        duplicates = 0
        for line in text.split("\n"):
            if line.encode().split():
                duplicates += line in seen
                seen.add(line)
        windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        again = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
        failed = len(words) < 20 or 100 * len(again) > 30 * len(words)
        out.append((r["doc_id"], len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), duplicates, len(again), failed))
    return ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"], out


def brute_scores(rows):
    return ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens"], [x[:5] for x in base_model(rows)[0]]


def brute_ids(rows):
    """The mixture's decisions are tested by their margins below."""
    return ["doc_id"], [(r["doc_id"],) for r in rows]


BRUTE = {"op2": brute_files, "op3": brute_ids, "op4": brute_pieces, "op7": brute_edits, "op10": brute_quality, "op11": brute_scores}


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, name):
    df = queries.QUERIES[name](spark, str(DATA))
    got = table(df.columns, df.collect())
    if name not in queries.SQL:
        rows = sorted(spark.read.parquet(f"{DATA}/documents.parquet").collect(), key=lambda r: r["doc_id"])
        columns, want = BRUTE[name.split("_")[0]](rows)
        assert sorted(tuple(r) for r in df.select(*columns).collect()) == sorted(want)
        return
    connection = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    result = connection.execute(queries.SQL[name])
    assert got == table([c[0] for c in result.description], result.fetchall())


def tempered(held, power, keep):
    """Shares of held ** power, none over held / keep: what is over goes to the values that have room."""
    whole = set()
    while True:
        rest = {v: h**power for v, h in held.items() if v not in whole}
        left = keep - sum(held[v] for v in whole)
        out = {v: held[v] if v in whole else left * rest[v] / sum(rest.values()) for v in held}
        over = {v for v in rest if out[v] > held[v] * (1 + 1e-12)}
        if not over:
            return {v: x / keep for v, x in out.items()}
        whole |= over


def test_mixture_meets_its_margins(spark):
    """The query's own keep and power: every value of every dimension has its target's share of the expected tokens."""
    rows = queries.QUERIES["op3_raked_mixture"](spark, str(DATA)).collect()
    total, kept = sum(r["n_tokens"] for r in rows), sum(r["n_tokens"] * r["probability"] for r in rows)
    assert abs(kept / total - 0.85) < 1e-4
    for d in ("source", "lang", "topic"):
        held, got = collections.Counter(), collections.Counter()
        for r in rows:
            held[str(r[d])] += r["n_tokens"] / total
            got[str(r[d])] += r["n_tokens"] * r["probability"] / kept
        want = tempered({v: h for v, h in held.items() if h}, 0.9, 0.85)
        assert {v: abs(got[v] / x - 1) < 1e-4 for v, x in want.items()} == dict.fromkeys(want, True)


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_quality_on_held_out_labels(spark):
    """Labels the model has not seen: fitted on the even ids, tried on the odd ones."""
    from equipoise.llm import quality

    data = Path("/root/testdata/sf0.01")
    docs, labels = (spark.read.parquet(f"{data if data.is_dir() else DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels.filter("doc_id % 2 = 0"))
    seen = quality.score_documents(docs, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    right = np.mean([(r["probability"] >= 0.5) == (r["quality"] == 1) for r in seen])
    clean = [r for r in seen if r["quality"] == 1 and not r["base_failed"]]
    assert right > 0.9 and np.mean([r["kept"] for r in clean]) > 0.97


def test_pipeline_stages(spark):
    first = spark.read.parquet(f"{DATA}/documents.parquet")
    docs, seen = first, [first.collect()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, str(DATA)))
        assert docs.columns == first.columns
        seen.append(docs.collect())
    start, good, single, cut, drawn = seen
    assert {r["doc_id"] for r in good} <= {r["doc_id"] for r in start}
    kept = {(x[0], x[1]) for x in components(good, corpus_pipeline.NEAR_PERCENT) if x[3]}
    assert sorted((r["doc_id"], len(shingles(r["text"]))) for r in single) == sorted(kept)
    want = {r["doc_id"]: x for r, x in zip(single, removed([r["text"] for r in single]), strict=True)}
    assert {r["doc_id"] for r in cut} == {i for i, (n, gone, _) in want.items() if gone == 0 or gone < n}
    for r in cut:
        assert hashlib.sha256(b" ".join(r["text"].encode().split())).hexdigest() == want[r["doc_id"]][2]
        assert not want[r["doc_id"]][1] or r["n_chars"] == len(r["text"])
    assert {r["doc_id"] for r in drawn} <= {r["doc_id"] for r in cut} and len(drawn) > 0.6 * len(cut)
    packed = corpus_pipeline.sequences(spark, docs, str(DATA)).collect()
    pieces = [(r["doc_id"], k // 4096, k, crc(ids[k : k + 4096])) for r in drawn for ids in [encoded(WORD, r["text"], 1)] for k in range(0, len(ids), 4096)]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["ids_crc32"]) for r in packed) == sorted(pieces)
    filled = collections.Counter()
    for r in packed:
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 4096


def test_stages_keep_further_columns(spark):
    """Columns that operators add under the same names, and one without equality, come out as they went in; edge rows too."""
    from pyspark.sql import functions as F

    names = ["kept_text", "n_words", "n_removed", "spans", "kept_sha256", "topic", "n_tokens", "probability", "sampled", "quality_rules", "a.b"]
    base = spark.read.parquet(f"{DATA}/documents.parquet").filter("doc_id < 60")
    odd = spark.createDataFrame([(1000, None), (1001, ""), (1002, "x " * 9), (None, "no id " * 40), (1003, "tie " * 50), (1003, "tie " * 50)], "doc_id long, text string")
    docs = base.unionByName(odd, allowMissingColumns=True).withColumns({n: F.concat(F.lit(f"{n}:"), F.coalesce("doc_id", F.lit(-1))) for n in names}).withColumn("labels", F.create_map(F.lit("k"), "doc_id"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(DATA))
        assert out.columns == docs.columns and out.schema["labels"].dataType == docs.schema["labels"].dataType
        rows = out.collect()
        assert rows and all(r[n] == f"{n}:{-1 if r['doc_id'] is None else r['doc_id']}" and r["labels"] == {"k": r["doc_id"]} for r in rows for n in names), name
        assert stage(spark, docs.limit(0), str(DATA)).count() == 0
