"""Lattice scores, resampling and the Merkle manifest against brute force: nulls, ties, repeated rows, clashing columns, no rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
pytest.importorskip("sentencepiece")

from equipoise.llm import lattice, merkle, resampling  # noqa: E402

PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, score string, rank string, tree string, digest string, position string, word string"
LONG = " ".join(f"word{i % 977} filler{i}" for i in range(9000))
TEXTS = [
    None, "", " \n\t", "one", "one", "ONE One oNe", "É ñ 日本語  nbsp  double " * 9, "again and again " * 60, "x" * 200 + " " + "y" * 70_000, LONG,
    *(f"the quick {w} jumps over the lazy dog number {i} and {w} again, then the rest of it all goes home to sleep well now ok" for i, w in enumerate(("fox", "cat", "fox", "Hen"))),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None, "éa"][i % 4], f"src{i % 4}", len(t or "")) for i, t in enumerate(TEXTS * 3)]
    rows += [rows[9], rows[9], rows[10], (None, "nameless words", None, None, None), (None, "nameless words", None, None, None), (3, "another text under a used id", "fr", "src1", 1)]
    return spark.createDataFrame([(*r, 1, "x", "x", "x", "x", "x", "x") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ways(word, ids, weights):
    """The probability of each segmentation of a space and the word, every one listed."""
    word, out = b" " + word, []

    def go(at, p):
        if at == len(word):
            out.append(p)
        for end in range(at + 1, len(word) + 1):
            if (i := ids.get(word[at:end])) is not None:
                go(end, p * math.exp(weights[i]))

    go(0, 1.0)
    return out


def test_lattice_sums_all_segmentations():
    vocabulary = lattice.read_vocabulary(PIECES)
    assert abs(np.exp(vocabulary.weights).sum() + math.exp(vocabulary.end) - 1) < 1e-9
    one = lattice.Lattice(vocabulary)
    words = [b"the", b"the", "éa".encode(), b"x", b"stations", "日本".encode(), b"\xff", b"#", b"again,"]
    listed = [ways(w, one.ids, one.weights) for w in words]
    assert max(map(len, listed)) > 50
    assert np.allclose(one.scores(words), [math.log(sum(x)) for x in listed], rtol=1e-12)
    # words too long for a matrix have the same recursion
    expected, alone = np.zeros(len(one.weights)), np.zeros(len(one.weights))
    n = np.arange(1, len(words) + 1)
    assert np.allclose(one.scores(words, n, expected), [one._long(b" " + w, float(k), alone) for w, k in zip(words, n, strict=True)], rtol=1e-12)
    assert np.allclose(expected, alone)
    # the pieces of a word are as long as the word
    sizes = np.array([len(p) for p in vocabulary.pieces])
    assert abs(expected @ sizes - sum(k * (len(w) + 1) for w, k in zip(words, n, strict=True))) < 1e-6
    assert one.scores([]).size == 0
    long = b"ab" * 400
    assert math.isfinite(one.scores([long])[0]) and one.scores([long])[0] < one.scores([long[:-2]])[0]


def base_model(rows):
    tokens = [((r["text"] or "").encode().lower().split(), r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0) for r in rows]
    c = collections.Counter(w for words, out in tokens if not out for w in [*words, None])
    below = sum(c.values()) + 0.1 * (len(c) + 1)
    return [(r["doc_id"], out, len(w) + 1, sum(c[x] > 0 for x in [*w, None]), sum(c.values()), sum(math.log10((c[x] + 0.1) / below) for x in [*w, None])) for r, (w, out) in zip(rows, tokens, strict=True)], c


@pytest.mark.parametrize("head", [0, 40, 200_000])
def test_document_scores(spark, docs, empty, head):
    """The same scores however many words are sent to the tasks and however many are joined."""
    rows = docs.collect()
    want, c = base_model(rows)
    got = lattice.score_documents(docs, PIECES, head=head).collect()
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    pairs = list(zip(sorted((tuple(r) for r in got), key=key), sorted(want, key=key), strict=True))
    assert all(g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9) for g, w in pairs)
    # the model, refitted in one place
    vocabulary = start = lattice.read_vocabulary(PIECES)
    words = [w for w in c if w is not None]
    for _ in range(lattice.ROUNDS):
        expected = np.zeros(len(start.pieces))
        lattice.Lattice(vocabulary).scores(words, np.array([c[w] for w in words]), expected)
        total = expected.sum() + c[None] + lattice.PRIOR
        vocabulary = lattice.Vocabulary(start.pieces, np.log((expected + lattice.PRIOR * np.exp(start.weights)) / total), math.log((c[None] + lattice.PRIOR * math.exp(start.end)) / total))
    model = lattice.Lattice(vocabulary)
    scores = sorted((sum(model.scores((r["text"] or "").encode().lower().split())) + vocabulary.end) / math.log(10) for r in rows)
    assert np.allclose(sorted(r["score"] for r in got), scores, rtol=1e-9)
    assert lattice.score_documents(empty, PIECES, head=head).count() == 0


def test_learning_suits_held_out_texts(spark, docs):
    plain = lattice.score_documents(docs, PIECES, rounds=0).filter("held_out").agg({"score": "sum"}).first()[0]
    learned = lattice.score_documents(docs, PIECES, rounds=2, prior=100.0).filter("held_out").agg({"score": "sum"}).first()[0]
    assert learned > plain


def test_long_texts_are_cut_at_white_space(monkeypatch):
    monkeypatch.setattr(lattice, "STEP_BYTES", 50)
    texts = [LONG.encode()[:3000], None, b"", b"x" * 500 + b" A b", b"tail"]
    groups = list(lattice._parts(texts))
    assert len(groups) > 40
    words = collections.defaultdict(list)
    for group in groups:
        for i, part in group:
            words[i] += part.split()
    assert [words[i] for i in range(len(texts))] == [(t or b"").lower().split() for t in texts]


def test_crcs_of_matrices():
    texts = [("Ab c0 é" * (i % 9) + f" x{i}").encode() for i in range(60)] + [None, b"", b"  ", ("z" * 300 + " q").encode()]
    for most in (1, 3):
        raw, begins, sizes, counts = resampling.word_bytes(texts)
        begin, size, of = resampling.feature_slices(begins, sizes, counts, most)
        want = [(i, zlib.crc32(f)) for i, t in enumerate(texts) for f in features((t or b"").decode(), most)]
        assert resampling.feature_crcs(*(x[:0] for x in (raw, begin, size))).size == 0
        assert [*zip(of.tolist(), resampling.feature_crcs(raw, begin, size).tolist(), strict=True)] == want


def features(text, most):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))
    return [" ".join(w[i : i + n]).encode() for n in range(1, most + 1) for i in range(len(w) - n + 1)]


@pytest.mark.parametrize("ngrams, buckets", [(1, 10_000), (2, 50)])
def test_resampling(spark, docs, empty, ngrams, buckets):
    target = spark.createDataFrame([("The lazy dog goes home", "x"), (None, "x"), ("", "x")], "text string, doc_id string")
    bucket = lambda t: [zlib.crc32(f) % buckets for f in features(t or "", ngrams)]
    rows = docs.collect()
    s, t = collections.Counter(b for r in rows for b in bucket(r["text"])), collections.Counter(b for r in target.collect() for b in bucket(r["text"]))
    ns, nt, found = s.total(), t.total(), []
    for r in rows:
        own = bucket(r["text"])
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in own)
        h = int(hashlib.sha256(f"2024:{'null' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()[:8], 16)
        found.append([r["doc_id"], len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(features(r["text"] or "", 1)) >= 20])
    able = sorted((f for f in found if f[5]), key=lambda f: (-f[3], f[0] is None, f[0] or 0, f[1], f[2]))
    for place, f in enumerate(able[: len(able) * 30 // 100]):
        f[4] = place + 1
    got = resampling.resample(docs, target, ngrams=ngrams, buckets=buckets, percent=30)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted((tuple(f[:5]) for f in found), key=str)
    assert resampling.resample(empty, target).count() == 0 and resampling.resample(docs, target.limit(0)).count() == len(rows)


def brute_manifest(rows):
    """(tree, doc_id, leaf) in order, each tree's levels, and the levels over the trees' roots."""
    H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: H(part(r["doc_id"]), part(r["source"]), part(r["lang"]), part(r["n_chars"]), part(text))

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    def siblings(levels, at):
        out = []
        for level in levels[:-1]:
            run = level[at // 8 * 8 : at // 8 * 8 + 8]
            out.append((run[: at % 8], run[at % 8 + 1 :]))
            at //= 8
        return out

    trees = collections.defaultdict(list)
    for r in rows:
        trees[r["lang"]].append(r)
    order = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    for own in trees.values():
        own.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
    levels = {k: climb([leaf(r, r["text"]) for r in trees[k]]) for k in order}
    top, out = climb([levels[k][-1][0] for k in order]), []
    for place, k in enumerate(order):
        for at, r in enumerate(trees[k]):
            way = siblings(levels[k], at) + siblings(top, place)
            changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None
            node = leaf(r, r["text"].translate({c: c + 32 for c in range(65, 91)})) if changed else leaf(r, r["text"])
            for before, after in way:
                node = H(*before, node, *after)
            out.append((r["doc_id"], leaf(r, r["text"]), levels[k][-1][0], top[-1][0], H(*(s for b, a in way for s in (*b, *a))), node, node == top[-1][0]))
    return out


def test_manifest(spark, docs, empty):
    got = merkle.verify_tampering(docs)
    assert sorted((tuple(r)[:7] for r in got.collect()), key=str) == sorted(brute_manifest(docs.collect()), key=str)
    assert merkle.verify_tampering(empty).count() == 0
    alone = docs.filter("doc_id = 0")
    row = merkle.verify_tampering(alone.limit(1)).first()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == hashlib.sha256(b"").hexdigest() and row["copied"] == []


def test_manifest_of_many_blocks(spark):
    """Trees of several blocks, one of exactly one block, one with a lone leaf in its last block."""
    sizes = {"a": merkle.BLOCK, "b": 2 * merkle.BLOCK + 1, "c": 9, "d": 1, None: 700}
    rows = [(i * 7 % 100_003, f"T{i}", k, "s", i) for i, k in enumerate(k for k, n in sizes.items() for _ in range(n))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(6)
    got = [tuple(r) for r in merkle.verify_tampering(df).collect()]
    assert sorted((g[:7] for g in got), key=str) == sorted(brute_manifest([dict(zip(df.columns, r, strict=True)) for r in rows]), key=str)
    # a version copies its leaf's ancestors alone, and the last copy is its root
    assert all(g[5] == g[7][-1] for g in got) and {len(g[7]) for g in got} == {5 + 1, 4 + 1, 2 + 1, 0 + 1}
