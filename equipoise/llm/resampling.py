"""Importance resampling towards a target's distribution of hashed features, with CRCs of whole matrices at once."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equipoise.llm.common import map_arrow, steps
from equipoise.operators.positions import with_position
from equipoise.session import cut_lineage

#: Hash buckets of features; their counts are held on the driver and their gains sent to the executors.
BUCKETS, MOST_BUCKETS = 10_000, 1 << 20
#: Longer features, each of which would mostly be a matrix of one row, are hashed one by one.
MATRIX_BYTES = 256
#: Scores are in thousandths.
SCALE = 1000

# Word bytes are 0-9, a-z and all of characters beyond ASCII; A-Z become a-z; the polynomial of the CRC.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[ord("0") : ord("9") + 1] = IN_WORD[ord("a") : ord("z") + 1] = IN_WORD[0x80:] = True
POLYNOMIAL = 0xEDB88320


def crc_table() -> np.ndarray:
    values = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        values = np.where(values & 1, (values >> 1) ^ np.uint32(POLYNOMIAL), values >> 1).astype(np.uint32)
    return values


CRC = crc_table()


def matrix_crcs(matrix: np.ndarray) -> np.ndarray:
    """The CRC-32 of every row of a two-dimensional uint8 array, all of them moved on by one column at a time."""
    value = np.full(len(matrix), 0xFFFFFFFF, dtype=np.uint32)
    for column in range(matrix.shape[1]):
        value = CRC[(value ^ matrix[:, column]) & 0xFF] ^ (value >> 8)
    return value ^ np.uint32(0xFFFFFFFF)


def word_bytes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts with one space after each, begin and length of each word there, and the number of words by text."""
    joined = np.frombuffer(b"\x00".join([*(t or b"" for t in texts), b""]), dtype=np.uint8)
    raw = LOWER[joined]
    word = IN_WORD[raw]
    edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
    begins, ends = edges[::2], edges[1::2]  # a text ends with a zero byte, so no word goes on into the next
    bounds = np.concatenate([[0], np.cumsum([len(t or b"") + 1 for t in texts])]).astype(np.int64)
    counts = np.diff(np.searchsorted(begins, bounds))
    word[ends] = True
    raw[ends] = 0x20
    sizes = ends - begins
    return raw[word], np.cumsum(sizes + 1) - (sizes + 1), sizes, counts


def feature_slices(begins: np.ndarray, sizes: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, length and text of every run of 1 to ``most`` words, by text; words of a run are parted by one space already."""
    text = np.repeat(np.arange(len(counts)), counts)
    begin, size, of = [begins], [sizes], [text]
    for n in range(2, most + 1):
        last = np.arange(n - 1, len(begins))
        last = last[text[last] == text[last - n + 1]]
        begin.append(begins[last - n + 1])
        size.append(begins[last] + sizes[last] - begins[last - n + 1])
        of.append(text[last])
    begin, size, of = np.concatenate(begin), np.concatenate(size), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return begin[order], size[order], of[order]


def feature_crcs(raw: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The CRC-32 of every feature: those of one length form a matrix, whose distinct rows are hashed and scattered back."""
    out = np.zeros(len(begins), dtype=np.uint32)
    if not len(begins):
        return out
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order], prepend=-1))
    for at, end in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
        rows = order[at:end]
        length = int(sizes[rows[0]])
        if length > MATRIX_BYTES:
            out[rows] = [zlib.crc32(raw[b : b + length]) for b in begins[rows].tolist()]
            continue
        matrix = np.empty((len(rows), length), dtype=np.uint8)
        for column in range(length):
            matrix[:, column] = raw[begins[rows] + column]
        coded = pa.FixedSizeBinaryArray.from_buffers(pa.binary(length), len(rows), [None, pa.py_buffer(matrix)]).dictionary_encode()
        known = coded.dictionary
        distinct = np.frombuffer(known.buffers()[1], dtype=np.uint8, count=len(known) * length, offset=known.offset * length).reshape(-1, length)
        out[rows] = matrix_crcs(distinct)[coded.indices.to_numpy()]
    return out


def hashed_features(docs: DataFrame, ngrams: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` (doc_id, row, text) as doc_id, row, n_words, n_features and ``hashed``: the bucket of every feature, four bytes each.

    Whole texts, in Arrow steps of bounded bytes, without a shuffle; a null text has no features.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            raw, begins, sizes, n_words = word_bytes(batch["text"].cast(pa.binary()).to_pylist())
            begins, sizes, of = feature_slices(begins, sizes, n_words, ngrams)
            packed = (feature_crcs(raw, begins, sizes) % np.uint32(buckets)).astype("<u4").tobytes()
            n = np.bincount(of, minlength=batch.num_rows)
            ends = 4 * np.cumsum(n)
            hashed = [packed[b:e] for b, e in zip((ends - 4 * n).tolist(), ends.tolist(), strict=True)]
            columns = [batch["doc_id"], batch["row"], pa.array(n_words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(hashed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "n_words", "n_features", "hashed"])

    return map_arrow(docs.select("doc_id", "row", "text"), run, "doc_id long, row long, n_words long, n_features long, hashed binary")


def bucket_counts(hashed: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows are in each bucket; a task adds up its own before they meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in steps(batches, "hashed"):
            total += np.bincount(np.frombuffer(b"".join(batch["hashed"].to_pylist()), dtype="<u4"), minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    counts = map_arrow(hashed.select("hashed"), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # a row a bucket
    out[counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a weight: the log of its share in the target over that in the source, in thousandths."""
    s, t = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(SCALE * math.log((y + 1.0) * s / ((x + 1.0) * t))) for x, y in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weighted(hashed: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, row, n_words, n_features and ``weight``, the sum of its features' gains."""
    sent = hashed.sparkSession.sparkContext.broadcast(gains)  # a number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "hashed"):
            total = np.concatenate([[0], np.cumsum(sent.value[np.frombuffer(b"".join(batch["hashed"].to_pylist()), dtype="<u4")])])
            ends = np.concatenate([[0], np.cumsum(batch["n_features"].to_numpy())])
            weight = total[ends[1:]] - total[ends[:-1]]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "row", "n_words", "n_features")), pa.array(weight)], ["doc_id", "row", "n_words", "n_features", "weight"])

    return map_arrow(hashed, run, "doc_id long, row long, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, *, ngrams: int = 1, buckets: int = BUCKETS, percent: int = 10, min_words: int = 20, seed: int = 2024
) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) of every row of ``docs``, towards the texts of ``target``.

    A feature is a run of 1 to ``ngrams`` words; words are runs of 0-9, a-z (after A-Z) and characters
    beyond ASCII. A score is the weight plus Gumbel noise of ``seed`` and doc_id, so the highest
    ``percent`` of the documents with ``min_words`` words or more are a draw without replacement in
    proportion to exp(weight). Every text is cut and hashed once; its buckets are stored and read for the
    counts and for the weights. Ranks are given by ranges of scores, not in one task.

    Null, empty and wordless texts have weight 0 and are not drawn (unless min_words is 0). Documents without an id take
    part; their noise is that of the id ``null``, and they come after others of their score. Rows with
    one doc_id share its noise and stay rows of their own; rows alike in all that is returned are ranked
    in some order. Without target texts the gains come from the documents alone. Other columns are
    ignored; an empty table gives no rows.
    """
    if not 0 < buckets <= MOST_BUCKETS or ngrams < 1 or not 0 <= percent <= 100:
        raise ValueError(f"buckets must be 1 to {MOST_BUCKETS}, ngrams 1 or more, percent 0 to 100")
    text = F.col("text").cast("string").alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text)
    hashed = cut_lineage(hashed_features(rows, ngrams, buckets))
    wanted = hashed_features(target.select(F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("row"), text), ngrams, buckets)
    gains = bucket_gains(bucket_counts(hashed, buckets), bucket_counts(wanted, buckets))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    drawn = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-SCALE * F.log(-F.log((drawn + 0.5) / 4294967296.0)))
    scored = cut_lineage(weighted(hashed, gains).withColumn("score", F.col("weight") + noise))
    able = scored.filter(F.col("n_words") >= min_words)
    n = percent * able.count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n_features", "weight", "row"]
    ranked = with_position(able, order).withColumn("rank", F.when(F.col("position") <= n, F.col("position")).cast("long")).drop("position")
    rest = scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
