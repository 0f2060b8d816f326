"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard on full sets, components."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equipoise.llm.common import U64, WordHashes, inside, map_arrow, mixed, steps, window_hashes, word_arrays
from equipoise.llm.filters import bit_filter, passing
from equipoise.llm.graphs import components
from equipoise.session import cut_lineage

SHINGLE = 5
#: A link needs at least this many hundredths of the union in common, where the caller names no other number.
PERCENT = 85
#: A pair at the threshold shares no band with probability (1 - 0.85 ** 4) ** 32, about 6e-11; at 80 % it is 5e-8.
BANDS, ROWS = 32, 4
K = BANDS * ROWS
#: How often a pair at the threshold may agree in too few coordinates by chance.
MISSED = 1e-9
#: Frequent shingles whose order is sent to the executors.
FREQUENT = 200_000
CHUNK = 1 << 15


def _sets(texts: list[str | None], known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text in a row, and the bounds of each text."""
    hashes, bounds = word_arrays([x and x.encode().lower() for x in texts], known)
    windows, whole = window_hashes(hashes, SHINGLE), inside(bounds, SHINGLE)
    text_of = np.repeat(np.arange(len(texts)), np.maximum(np.diff(bounds) - SHINGLE + 1, 0))
    shingles = windows[whole]
    short = np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < SHINGLE))
    if len(short):
        own = np.array([xxhash.xxh3_64_intdigest(hashes[bounds[i] : bounds[i + 1]].tobytes()) for i in short], dtype=U64)
        shingles, text_of = np.concatenate([shingles, own]), np.concatenate([text_of, short])
    order = np.lexsort((shingles, text_of))
    shingles, text_of = shingles[order], text_of[order]
    first = np.ones(len(shingles), dtype=bool)
    first[1:] = (shingles[1:] != shingles[:-1]) | (text_of[1:] != text_of[:-1])
    shingles, text_of = shingles[first], text_of[first]
    return shingles, np.searchsorted(text_of, np.arange(len(texts) + 1))


def _signatures(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """K coordinates of every text: the second permutation, shifted in a circle by k, of the first.

    Both permutations act on 32-bit numbers. The first spreads the folded shingles; the second is one
    fixed bijection, and coordinate k is the least value it has at (first + k) modulo 2**32.
    """
    filled = np.flatnonzero(np.diff(bounds))
    out = np.full((len(bounds) - 1, K), 0xFFFFFFFF, dtype=np.uint32)
    if not len(filled):
        return out
    first = (mixed(shingles) >> U64(32)).astype(np.uint32)
    # texts are taken together up to CHUNK shingles, so that the arrays stay in the cache
    starts = bounds[filled]
    groups = np.flatnonzero(np.diff(starts // CHUNK, prepend=-1))
    for a, b in zip(groups, [*groups[1:], len(filled)], strict=True):
        low, high = starts[a], bounds[filled[b - 1] + 1]
        offsets = starts[a:b] - low
        values, turned = np.empty(high - low, np.uint32), np.empty(high - low, np.uint32)
        for k in range(K):
            np.add(first[low:high], np.uint32(k), out=values)
            for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
                np.right_shift(values, np.uint32(shift), out=turned)
                np.bitwise_xor(values, turned, out=values)
                np.multiply(values, np.uint32(factor), out=values)
            out[filled[a:b], k] = np.minimum.reduceat(values, offsets)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (of the whole set), signature (a byte a coordinate) and band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        number = np.arange(BANDS, dtype=U64)
        for batch in steps(batches):
            shingles, bounds = _sets(batch["text"].to_pylist(), known)
            signature = _signatures(shingles, bounds)
            coordinates = signature.astype(U64).reshape(-1, BANDS, ROWS)
            band = mixed(number * U64(0x9E3779B97F4A7C15))[None, :].repeat(len(signature), axis=0)
            for r in range(ROWS):
                band = mixed(band ^ coordinates[:, :, r])
            raw = [shingles[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array(np.diff(bounds).astype(np.int64)),
                    pa.array([xxhash.xxh3_128_digest(x) for x in raw], pa.binary()),
                    pa.array([x.tobytes() for x in (mixed(signature.astype(U64)) & U64(0xFF)).astype(np.uint8)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, band.size + 1, BANDS, dtype=np.int32)), pa.array(band.ravel().view(np.int64))),
                ],
                ["doc_id", "n_shingles", "set_key", "signature", "bands"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, n_shingles long, set_key binary, signature binary, bands array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """set_key, n_shingles and the whole set (sorted 8-byte hashes) of the documents of ``wanted`` (doc_id).

    Texts are not shuffled: a filter of the wanted ids goes to the tasks, and those that pass are
    shingled again. It may let others through, which later joins leave out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted, "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, words, done = WordHashes(), sent.value, set()
        for batch in batches:
            ids = batch["doc_id"].fill_null(0).to_numpy().astype(np.int64)
            hit = passing(ids.view(U64), words) | batch["doc_id"].is_null().to_numpy(zero_copy_only=False)
            for part in steps(iter([batch.filter(pa.array(hit))])):
                shingles, bounds = _sets(part["text"].to_pylist(), known)
                raw = [shingles[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                keys = [xxhash.xxh3_128_digest(x) for x in raw]
                new = [i for i, k in enumerate(keys) if k not in done and not done.add(k)]
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in new], pa.binary()), pa.array([len(raw[i]) // 8 for i in new], pa.int64()), pa.array([raw[i] for i in new], pa.binary())], ["set_key", "n_shingles", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, "set_key binary, n_shingles long, shingles binary")


def least_agreeing(percent: int) -> int:
    """Pairs that agree in fewer coordinates are no links: at ``percent`` one misses this by chance once in 1 / MISSED (81 at 85, 73 at 80)."""
    p, missed, least = percent / 100, 0.0, 0
    while least < K and (missed := missed + comb(K, least) * p**least * (1 - p) ** (K - least)) <= MISSED:
        least += 1
    return least


def _sized(a: str, b: str, percent: int) -> str:
    """Could sets of these sizes be linked at all?"""
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def likely(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures do not rule out a link."""
    least = least_agreeing(percent)
    side = lambda x: classes.select(F.col("set_key").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("signature").alias(f"s_{x}"))

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(-1, K) for c in ("s_a", "s_b")]
            kept = pa.array((s[0] == s[1]).sum(axis=1) >= least)
            yield batch.select(["a", "b"]).filter(kept)

    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(_sized("n_a", "n_b", percent))
    return map_arrow(both.select("a", "b", "s_a", "s_b"), agree, "a binary, b binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) that are links by their full sets, as u and v."""
    side = lambda x: sets.select(F.col("set_key").alias(x), F.col("shingles").alias(f"s_{x}"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(batch["s_a"], batch["s_b"], strict=True):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                kept.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["u", "v"]).filter(pa.array(kept, pa.bool_()))

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return map_arrow(both.select("a", "b", "s_a", "s_b"), compare, "u binary, v binary")


def _prefixes(open_sets: DataFrame, percent: int) -> DataFrame:
    """Each set's rarest shingles, enough of them that two linked sets have one in common.

    Any order that is the same for all sets is right; here it is the number of sets that hold a
    shingle, known for the FREQUENT most frequent ones, and then the hash.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, n = np.unique(np.frombuffer(b"".join(batch["shingles"].to_pylist()), U64), return_counts=True)
            often = n > 1
            yield pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(n[often])], ["shingle", "n"])

    counts = map_arrow(open_sets.select("shingles"), count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    frequent = counts.orderBy(F.col("n").desc(), "shingle").limit(FREQUENT).toArrow()
    values = frequent["shingle"].to_numpy().view(U64)
    order = np.argsort(values)
    sent = open_sets.sparkSession.sparkContext.broadcast((values[order], frequent["n"].to_numpy()[order]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, n = sent.value
        for batch in batches:
            rows, shingles, ranks = [], [], []
            for i, raw in enumerate(batch["shingles"]):
                x = np.frombuffer(raw.as_buffer(), U64)
                at = np.searchsorted(values, x)
                known = np.zeros(len(x), dtype=np.int64)
                if len(values):
                    at = np.minimum(at, len(values) - 1)
                    known = np.where(values[at] == x, n[at], 0)
                size = len(x) - -(-percent * len(x) // 100) + 1
                shingles.append(x[np.lexsort((x, known))[:size]])
                rows += [i] * len(shingles[-1])
                ranks += range(len(shingles[-1]))
            taken = batch.select(["set_key", "component", "n_shingles", "number"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.concatenate(shingles or [np.empty(0, U64)]).view(np.int64)), pa.array(ranks, pa.int64())], ["set_key", "component", "n_shingles", "number", "shingle", "place"])

    return map_arrow(open_sets.select("set_key", "component", "n_shingles", "number", "shingles"), cut, "set_key binary, component binary, n_shingles long, number long, shingle long, place long")


def _alone(open_sets: DataFrame) -> DataFrame:
    """number and alone: how many shingles of a set no other set holds."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(iter([batch]), "shingles"):
                sizes = np.array([len(x) // 8 for x in part["shingles"].to_pylist()], dtype=np.int64)
                values = np.frombuffer(b"".join(part["shingles"].to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(np.repeat(part["number"].to_numpy(), sizes))], ["shingle", "number"])

    spread_out = map_arrow(open_sets.select("number", "shingles"), spread, "shingle long, number long")
    held = spread_out.groupBy("shingle").agg(F.count("*").alias("c"), F.min("number").alias("number"))
    return held.filter("c = 1").groupBy("number").agg(F.count("*").alias("alone"))


def link_components(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(fingerprints of all documents, component of each linked set_key); links have ``percent`` hundredths in common.

    1. Equal sets are one class, found by an aggregate; all that follows works on classes.
    2. In each bucket (classes that share a band) every member is compared with one of them, that
       which shares most buckets over all. Buckets of two are then done.
    3. In larger buckets whose members are still in several components, every pair across components
       that can be a link has one of its rarest shingles in common. Shingles whose holders are all in
       one component need no pairs; for the others the pairs across components are compared.
    So a group of copies costs one comparison a member, and pairs are only spelled out where sets that
    are not yet linked have rare text in common. All comparisons end on full sets.
    """
    prints = cut_lineage(fingerprints(docs))
    first = prints.filter("n_shingles > 0").groupBy("set_key").agg(
        F.min("doc_id").alias("doc_id"), F.any_value("n_shingles").alias("n_shingles"), F.any_value(F.struct("signature", "bands")).alias("x")
    )
    classes = cut_lineage(first.select("set_key", "doc_id", "n_shingles", "x.*"))
    bands = classes.select("set_key", F.explode("bands").alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    members = cut_lineage(bands.join(shared, "bucket"))
    weight = members.groupBy("set_key").agg(F.sum("members").alias("weight"))
    centre = members.join(weight, "set_key").groupBy("bucket").agg(F.max(F.struct("weight", "set_key")).alias("c"))
    stars = members.select("bucket", F.col("set_key").alias("a")).join(centre.select("bucket", F.col("c.set_key").alias("b")), "bucket").filter("a <> b")
    # a pair is written one way round, so that two buckets with the two as centres give it once
    pairs = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = cut_lineage(likely(pairs, classes, percent))
    large = members.filter("members > 2")
    keys = pairs.select(F.explode(F.array("a", "b")).alias("set_key")).unionByName(large.select("set_key")).distinct()
    sets = cut_lineage(full_sets(docs, classes.join(keys, "set_key", "left_semi").select("doc_id")))
    links = cut_lineage(confirmed(pairs, sets, percent))
    found = components(links)

    label = F.coalesce("component", "set_key")
    placed = large.join(found.withColumnRenamed("node", "set_key"), "set_key", "left").select("bucket", "set_key", label.alias("component"))
    mixed_buckets = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("bucket")
    undecided = placed.join(mixed_buckets, "bucket", "left_semi").groupBy("set_key").agg(F.any_value("component").alias("component"))
    open_sets = cut_lineage(sets.join(undecided, "set_key").withColumn("number", F.monotonically_increasing_id()))
    # what a set has in common with any other is at most what others hold too
    common = (F.col("n_shingles") - F.coalesce("alone", F.lit(0))).alias("common")
    prefixes = _prefixes(open_sets, percent).join(_alone(open_sets), "number", "left").select("set_key", "component", "n_shingles", "shingle", "place", common)
    prefixes = cut_lineage(prefixes.filter(f"100 * common >= {percent} * n_shingles"))
    split = prefixes.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("shingle")
    across = prefixes.join(split, "shingle", "left_semi")
    side = lambda x: across.select("shingle", F.col("set_key").alias(x), F.col("component").alias(f"c_{x}"), F.col("n_shingles").alias(f"n_{x}"), F.least("common", F.col("n_shingles") - F.col("place")).alias(f"m_{x}"))
    # all that two sets share comes no earlier than the first shingle they share, so at that one this holds for a link
    enough = f"{100 + percent} * least(m_a, m_b) >= {percent} * (n_a + n_b)"
    rest = side("a").join(side("b"), "shingle").filter(f"a < b and c_a <> c_b and {_sized('n_a', 'n_b', percent)} and {enough}").select("a", "b").distinct()
    more = cut_lineage(confirmed(likely(rest, classes, percent), sets, percent))
    if not more.isEmpty():
        found = components(links.unionByName(more))
    return prints, found


def _judged(docs: DataFrame, percent: int) -> DataFrame:
    prints, found = link_components(docs, percent)
    rows = prints.select("doc_id", "n_shingles", "set_key")
    filled = rows.filter("n_shingles > 0")
    ids = filled.groupBy("set_key").agg(F.min("doc_id").alias("least"))
    named = cut_lineage(ids.join(found.withColumnRenamed("node", "set_key"), "set_key", "left").select("set_key", "least", F.coalesce("component", "set_key").alias("component")))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_key = named.join(names, "component").select("set_key", "component_id")
    linked = filled.join(by_key, "set_key").select("doc_id", "n_shingles", "component_id", "set_key")
    alone = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "set_key")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return linked.unionByName(alone).select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "set_key")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links lead to), kept; one row a document.

    A-Z count as lower case; words are runs of bytes other than 20 and 09-0D. A document with fewer
    than five words has its whole sequence as its one shingle; one without words or text has none and
    is linked with nothing. Rows with a null id take part, but have no name: their component is named
    after the others (null if there are none) and they are not kept. Rows that repeat an id are rows of
    their own. Other columns are ignored; an empty table gives no rows.
    """
    return _judged(docs, percent).drop("set_key")


def _distinct(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``rows`` with one of those that are equal in the columns of ``docs``; types that have no equality are compared as JSON."""
    whole = [f.name for f in docs.schema if "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString()]
    texts = {f"_equipoise_json_{i}": F.to_json(F.struct(F.col(f"`{c}`"))) for i, c in enumerate(whole)}
    return rows.withColumns(texts).dropDuplicates([*(c for c in docs.columns if c not in whole), *texts]).drop(*texts) if texts else rows.dropDuplicates(docs.columns)


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents with one of each group of near copies: that with the smallest id, all columns as they are.

    Equal rows are one. Rows without an id go where their group has a document with one; otherwise one
    of each set stays. Texts of documents that surely stay are not shuffled: a filter of all ids that
    lose a row or occur twice parts them from the few that are joined with the decisions.
    """
    judged = cut_lineage(_judged(docs, percent))
    doubtful = judged.groupBy("doc_id").agg(F.count("*").alias("c"), F.every("kept").alias("all")).filter("c > 1 or not all")
    sent = docs.sparkSession.sparkContext.broadcast(bit_filter(doubtful, "doc_id"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    may_lose = lambda ids: ~ids.is_valid().to_numpy(zero_copy_only=False) | passing(ids.fill_null(0).to_numpy().astype(np.int64).view(U64), sent.value)

    def sure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~may_lose(batch["doc_id"])))

    def other(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for part in steps(iter([batch.filter(pa.array(may_lose(batch["doc_id"])))])):
                shingles, bounds = _sets(part["text"].to_pylist(), known)
                keys = [xxhash.xxh3_128_digest(shingles[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys, pa.binary())], [*part.schema.names, "_equipoise_key"])

    stays = judged.filter("kept or (doc_id is null and component_id is null)").select(F.col("doc_id").alias("_equipoise_id"), F.col("set_key").alias("_equipoise_key")).distinct()
    rest = map_arrow(docs, other, f"{kinds}, _equipoise_key binary")
    nameless = rest.filter("doc_id is null").dropDuplicates(["_equipoise_key"])
    named = _distinct(rest.filter("doc_id is not null"), docs)
    both = named.unionByName(nameless).alias("d")
    decided = both.join(stays.alias("s"), F.expr("d._equipoise_key = s._equipoise_key and d.doc_id <=> s._equipoise_id"), "left_semi")
    return map_arrow(docs, sure, kinds).unionByName(decided.drop("_equipoise_key"))
