"""Duplicate passages by matching of content-defined blocks, in place of a relative Lempel-Ziv parse.

A reference block is the text around an anchor. The anchor of a window of ``window`` words is the
least of the hashes of its ``seed``-word sequences, the first of equals; neighbouring windows with
one anchor form a run, and the run's words are its block. Anchor and block depend on nothing but the
words, so equal windows have equal anchors wherever they stand, and one record a run (one in about 13
words) indexes all of them.

No greedy factors are formed, since each text would need the whole index for that; equal blocks are
counted by one aggregate instead. A phrase is a run whose whole block occurs elsewhere too; all its
windows are duplicates. Of a run whose anchor occurs elsewhere but whose whole block does not, and only
of those, single windows are counted among the windows of all blocks with that anchor. Runs whose anchor
occurs once are literals. Which words go depends on the repeated windows alone, so the result is the same.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equipoise.llm.common import U64, WordHashes, covered, inside, map_arrow, mixed, steps, window_hashes, word_arrays
from equipoise.llm.filters import bit_filter, passing
from equipoise.session import cut_lineage

WINDOW, SEED = 35, 7
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
BASE = 0x9E3779B97F4A7C15
#: Most single windows of one batch that goes back to the JVM, which holds a batch outside its heap.
EDGE_ROWS = 1 << 15


def text_key(text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(text)


def _anchors(hashes: np.ndarray, bounds: np.ndarray, window: int, seed: int):
    """Runs of windows with one anchor: anchor hash, first and last window (places among all words)."""
    grams = window_hashes(hashes, seed)
    n, width = len(hashes) - window + 1, window - seed + 1
    if n <= 0:
        return np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64)
    least, span = np.arange(len(grams)), 1
    first = lambda a, b: np.where(grams[a] <= grams[b], a, b)
    while 2 * span <= width:
        least, span = first(least[: len(least) - span], least[span:]), 2 * span
    if span < width:
        least = first(least[:n], least[width - span : width - span + n])
    places = np.flatnonzero(inside(bounds, window))
    if not len(places):
        return np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64)
    at = least[places]
    new = np.ones(len(places), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (places[1:] != places[:-1] + 1)
    begin = np.flatnonzero(new)
    return grams[at[begin]], places[begin], places[np.append(begin[1:], len(places)) - 1]


def _blocks(hashes: np.ndarray, first: np.ndarray, last: np.ndarray, window: int) -> np.ndarray:
    """A hash of the words of each run, from first to last + window."""
    power = np.concatenate([[U64(1)], np.cumprod(np.full(len(hashes), U64(BASE)))])
    inverse = np.concatenate([[U64(1)], np.cumprod(np.full(len(hashes), U64(pow(BASE, -1, 1 << 64))))])
    sums = np.concatenate([[U64(0)], np.cumsum(hashes * power[:-1])])
    return mixed((sums[last + window] - sums[first]) * inverse[first] + mixed((last - first).astype(U64)))


def _parsed(batch: pa.RecordBatch, known: WordHashes, window: int, seed: int):
    texts = [(t or "").encode() for t in batch["text"].to_pylist()]
    hashes, bounds = word_arrays(texts, known)
    anchor, first, last = _anchors(hashes, bounds, window, seed)
    row = np.searchsorted(bounds, first, side="right") - 1
    return texts, hashes, bounds, anchor, first, last, row


def _run_value(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One number for a run of a text: the first half of the key and the first window."""
    return mixed(keys + first.astype(U64) * U64(BASE))


def index_runs(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """key (of the text), anchor, block, first (window of the run, in the text), n (windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in steps(batches):
            texts, hashes, bounds, anchor, first, last, row = _parsed(batch, known, window, seed)
            keys = pa.array([text_key(t) for t in texts], pa.binary())
            block = _blocks(hashes, first, last, window)
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(row)), pa.array(anchor.view(np.int64)), pa.array(block.view(np.int64)), pa.array((first - bounds[row]).astype(np.int32)), pa.array((last - first + 1).astype(np.int32))],
                ["key", "anchor", "block", "first", "n"],
            )

    return map_arrow(docs.select(F.col("text").cast("string").alias("text")), run, "key binary, anchor long, block long, first int, n int")


def _edge_windows(docs: DataFrame, words: np.ndarray, window: int, seed: int) -> DataFrame:
    """key, anchor, hash and place of every window of the runs that pass the filter."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, words = WordHashes(), sent.value
        for batch in steps(batches):
            texts, hashes, bounds, anchor, first, last, row = _parsed(batch, known, window, seed)
            raw = [text_key(t) for t in texts]
            half = np.frombuffer(b"".join(raw), U64)[::2] if raw else np.empty(0, U64)
            value = _run_value(half[row], first - bounds[row])
            # a text that stands twice in this task is looked at once for each copy, so that its windows count twice
            hit = np.flatnonzero(passing(value, words)) if len(value) else np.empty(0, np.int64)
            sizes = (last - first + 1)[hit]
            place = np.repeat(first[hit] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
            run_of = np.repeat(hit, sizes)
            fine, keys = window_hashes(hashes, window, base=0xC2B2AE3D27D4EB4F), pa.array(raw, pa.binary())
            for begin in range(0, len(place), EDGE_ROWS):
                at, of = place[begin : begin + EDGE_ROWS], run_of[begin : begin + EDGE_ROWS]
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(row[of])), pa.array(anchor[of].view(np.int64)), pa.array(fine[at].view(np.int64)), pa.array((at - bounds[row[of]]).astype(np.int32))],
                    ["key", "anchor", "fine", "place"],
                )

    return map_arrow(docs.select(F.col("text").cast("string").alias("text")), run, "key binary, anchor long, fine long, place int")


def _only(df: DataFrame, column: str, words: np.ndarray) -> DataFrame:
    """The rows whose long column passes the filter."""
    sent = df.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passing(batch[column].to_numpy().view(U64), sent.value)))

    return map_arrow(df, run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema))


def duplicate_windows(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """key and ``runs``, the windows of a text that also start elsewhere: first window, number and kind in one long each.

    Runs are whole phrases (kind 0) or single checked windows (2); those of kind 1 only say which windows
    were in question and cancel a phrase there. One row for each text with any repeated anchor.
    """
    runs = cut_lineage(index_runs(docs, window, seed))
    repeated = cut_lineage(runs.groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1").select("anchor"))
    candidates = cut_lineage(_only(runs, "anchor", bit_filter(repeated, "anchor")).join(repeated, "anchor", "left_semi"))
    # equal blocks stand in one file by now, so most of this aggregate is done before its shuffle
    blocks = cut_lineage(candidates.groupBy("anchor", "block").agg(F.count("*").alias("c"), F.min(F.struct("key", "first", "n")).alias("one")))
    edges = blocks.filter("c = 1").select("anchor", "one.*")
    # of a phrase with the anchor of an edge one block stands for all
    examples = blocks.filter("c > 1").join(edges.select("anchor").distinct(), "anchor", "left_semi").select("anchor", "one.*")
    # stored, so that making the filter does not chain a second worker to each task
    value = cut_lineage(map_arrow(edges.unionByName(examples).select("key", "first"), _value_batches, "value long"))
    windows = cut_lineage(_edge_windows(docs, bit_filter(value, "value"), window, seed))
    twice = cut_lineage(windows.groupBy("anchor", "fine").agg(F.count("*").alias("c")).filter("c > 1").select("anchor", "fine"))
    checked = _only(windows, "fine", bit_filter(twice, "fine")).join(twice, ["anchor", "fine"], "left_semi")
    coded = lambda df, first, n, kind: df.selectExpr("key", f"shiftleft(bigint({first}), 33) | shiftleft(bigint({n}), 2) | bigint({kind}) as run")
    parts = coded(candidates, "first", "n", 0).unionByName(coded(edges, "first", "n", 1)).unionByName(coded(checked, "place", 1, 2))
    # a set of longs takes a fraction of what a set of rows does, and sets are kept outside Spark's bookkeeping
    return cut_lineage(parts.groupBy("key").agg(F.collect_set("run").alias("runs")))


def _value_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        half = np.frombuffer(b"".join(batch["key"].to_pylist()), U64)[::2]
        yield pa.RecordBatch.from_arrays([pa.array(_run_value(half, batch["first"].to_numpy().astype(np.int64)).view(np.int64))], ["value"])


def removed_words(n: int, runs: np.ndarray, window: int) -> np.ndarray:
    """Which of ``n`` words lie in a duplicate window: phrases, without the edges, with the checked windows."""
    starts = np.zeros(n, dtype=bool)
    first, size, kind = (runs >> U64(33)).astype(np.int64), (runs >> U64(2) & U64(0x7FFFFFFF)).astype(np.int64), runs & U64(3)
    for which, value in ((0, True), (1, False), (2, True)):
        of, change = kind == U64(which), np.zeros(n + 1, dtype=np.int32)
        np.add.at(change, first[of], 1)
        np.add.at(change, first[of] + size[of], -1)
        starts[np.cumsum(change[:-1]) > 0] = value
    return covered(np.flatnonzero(starts), window, n)


def without(text: bytes, left: list[int]) -> bytes:
    """The words with the numbers ``left``, each with the white space that follows it in the text."""
    begins = [m.start() for m in WORD.finditer(text)] + [len(text)]
    return b"".join([text[begins[i] : begins[i + 1]] for i in left]).rstrip()


def remove_duplicates(docs: DataFrame, window: int = WINDOW, seed: int = SEED, text_column: str = "kept_text") -> DataFrame:
    """The columns of ``docs`` and n_words, n_removed, spans (removed parts as word places), kept_sha256, kept text.

    A word goes if it is covered by a window of ``window`` words whose sequence also starts anywhere
    else, the same text included; windows are judged on the input. kept_sha256 is that of the kept words
    joined by one space; ``text_column`` has them with the white space that follows each, and the text
    as it was where nothing goes. Null text has no words; texts shorter than a window stay whole. Rows that
    repeat a text, with one id or several, lose it together. An empty table gives no rows; columns of
    ``docs`` whose names clash with the result's are replaced. Texts are shuffled once, compressed.
    """
    found = duplicate_windows(docs, window, seed)
    added = {"n_words": "long", "n_removed": "long", "spans": "array<struct<first:int,n:int>>", "kept_sha256": "string", text_column: "string"}
    carried = [f for f in docs.schema if f.name not in added and f.name != "text"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried)
    names = [f.name for f in carried]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts = [(t or "").encode() for t in batch["text"].to_pylist()]
            packed = [pa.array([text_key(t) for t in texts], pa.binary()), pa.array([squeeze(t) for t in texts], pa.binary()), pa.array(batch["text"].is_null())]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), *packed], [*names, "_equipoise_key", "_equipoise_packed", "_equipoise_null"])

    comma = ", " if kinds else ""
    packed = map_arrow(docs.select(*[F.col(f"`{c}`") for c in names], F.col("text").cast("string").alias("text")), pack, f"{kinds}{comma}_equipoise_key binary, _equipoise_packed binary, _equipoise_null boolean")
    both = packed.join(found.select(F.col("key").alias("_equipoise_key"), F.col("runs").alias("_equipoise_runs")), "_equipoise_key", "left").drop("_equipoise_key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        spans_type = pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32())]))
        for batch in batches:
            out = {name: [] for name in added}
            for packed, null, runs in zip(batch["_equipoise_packed"], batch["_equipoise_null"].to_pylist(), batch["_equipoise_runs"], strict=True):
                text = expand(packed.as_py())
                words = text.split()
                gone = removed_words(len(words), runs.values.to_numpy().view(U64), window) if runs.is_valid else np.zeros(len(words), dtype=bool)
                left = np.flatnonzero(~gone).tolist()
                kept = b" ".join([words[i] for i in left])
                edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                out["n_words"].append(len(words))
                out["n_removed"].append(int(gone.sum()))
                out["spans"].append([{"first": int(a), "n": int(b - a)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out[text_column].append(None if null else (without(text, left) if gone.any() else text).decode())
            types = [pa.int64(), pa.int64(), spans_type, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), *(pa.array(out[n], t) for n, t in zip(added, types, strict=True))], [*names, *added])

    return map_arrow(both, cut, f"{kinds}{comma}" + ", ".join(f"{n} {t}" for n, t in added.items()))
