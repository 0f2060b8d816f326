"""Exact top-k search by distributed histogram selection."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equipoise.llm.common import map_arrow
from equipoise.session import cut_lineage

#: Queries that are scored together; only such a block is sent to the executors.
QUERY_BLOCK = 2048
#: Histogram bins of one refinement.
BINS = 1024
NEVER = np.iinfo(np.int64).min


def quantized(df: DataFrame, key: str, vector: str, factor: int) -> DataFrame:
    """vec_id and floor(factor * component) of the vectors that take part."""
    c = F.col(f"`{vector}`")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    return df.filter(F.col(f"`{key}`").isNotNull() & c.isNotNull() & F.forall(c, finite)).select(
        F.col(f"`{key}`").cast("long").alias("vec_id"), F.transform(c, lambda x: F.floor(x.cast("double") * factor)).alias("v")
    )


class Block:
    """Queries of one length, and where the search for each one's k-th score stands."""

    def __init__(self, places: np.ndarray, ids: np.ndarray, matrix: np.ndarray, largest: int, k: int):
        self.places, self.ids, self.matrix = places, ids, matrix
        lengths = np.sqrt((matrix.astype(np.float64) ** 2).sum(axis=1))
        reach = np.ceil(lengths * largest).astype(np.int64) + 1  # no score is further from 0
        if float(reach.max(initial=0)) >= 2**62:
            raise ValueError("a score could leave 64 bits")
        self.exact = bool(reach.max(initial=0) < 1 << 52)  # then doubles hold every partial sum
        self.low, self.need = -reach, np.full(len(ids), k, dtype=np.int64)
        self.span = 2 * reach + 1  # the k-th score is in [low, low + span)
        self.width = -(-self.span // BINS)
        self.all = np.zeros(len(ids), dtype=bool)

    def scores(self, ids: np.ndarray, matrix: np.ndarray) -> np.ndarray:
        q, c = self.matrix, matrix
        out = (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64) if self.exact else q @ c.T
        out[self.ids[:, None] == ids[None, :]] = NEVER
        return out

    def narrow(self, counts: dict[int, list[tuple[int, int]]], first: bool) -> None:
        """Go on with the bin that holds the k-th score; counts are (bin, rows) by place."""
        for i, place in enumerate(self.places):
            found = sorted(counts.get(int(place), ()), reverse=True)
            if first and sum(n for _, n in found) < self.need[i]:
                self.all[i] = True
            if self.all[i] or not self.width[i]:
                continue
            for bin_, n in found:
                if n >= self.need[i]:
                    self.low[i] += bin_ * self.width[i]
                    break
                self.need[i] -= n
        self.span = self.width.copy()
        self.width = np.where((self.span > 1) & ~self.all, -(-self.span // BINS), 0)  # 0: found


def _candidates(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Ids and components by length of vector."""
    v = batch["v"]
    ids, sizes = batch["vec_id"].to_numpy(), np.diff(v.offsets.to_numpy())
    flat, starts = v.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])[:-1]
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield int(dim), ids[rows], flat[(starts[rows][:, None] + np.arange(dim)).ravel()].reshape(len(rows), dim)


def _histograms(blocks, vectors: DataFrame) -> DataFrame:
    """Rows of each query and bin over all vectors; a task reports the bins down to its own k-th score."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dim = blocks.value
        sums = {dim: np.zeros((len(b.ids), BINS), dtype=np.int64) for dim, b in by_dim.items()}
        for batch in batches:
            for dim, ids, matrix in _candidates(batch):
                if dim in by_dim:
                    b = by_dim[dim]
                    above = b.scores(ids, matrix) - b.low[:, None]
                    bins = above // np.maximum(b.width, 1)[:, None]
                    # the sentinel of a query's own row may wrap round; it is left out by its score
                    valid = (above >= 0) & (above < b.span[:, None]) & (b.ids[:, None] != ids[None, :]) & (b.width > 0)[:, None]
                    flat = (np.arange(len(b.ids))[:, None] * BINS + bins)[valid]
                    sums[dim] += np.bincount(flat, minlength=sums[dim].size).reshape(sums[dim].shape)
        for dim, b in by_dim.items():
            down = np.cumsum(sums[dim][:, ::-1], axis=1)[:, ::-1]
            useful = (sums[dim] > 0) & (down - sums[dim] < b.need[:, None])
            q, bin_ = np.nonzero(useful)
            yield pa.RecordBatch.from_arrays([pa.array(b.places[q], pa.int64()), pa.array(bin_, pa.int64()), pa.array(sums[dim][q, bin_], pa.int64())], ["place", "bin", "n"])

    return map_arrow(vectors, count, "place long, bin long, n long").groupBy("place", "bin").agg(F.sum("n").alias("n"))


def _selected(blocks, vectors: DataFrame) -> DataFrame:
    """From each task: every row above a query's k-th score, and the smallest ids at it."""

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dim = blocks.value
        ties: dict[int, np.ndarray] = {}
        schema = pa.schema([("place", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        for batch in batches:
            for dim, ids, matrix in _candidates(batch):
                if dim not in by_dim:
                    continue
                b = by_dim[dim]
                scores = b.scores(ids, matrix)
                own = b.ids[:, None] == ids[None, :]
                q, c = np.nonzero(((scores > b.low[:, None]) | b.all[:, None]) & ~own)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (b.places[q], b.ids[q], ids[c], scores[q, c])], schema=schema)
                equal = (scores == b.low[:, None]) & ~own & ~b.all[:, None]
                for i in np.flatnonzero(equal.any(axis=1)):
                    seen = np.concatenate([ties.get(b.places[i], np.empty(0, np.int64)), ids[equal[i]]])
                    ties[b.places[i]] = np.sort(seen)[: b.need[i]]
        for b in by_dim.values():
            held = [i for i, place in enumerate(b.places) if place in ties]
            n = [len(ties[b.places[i]]) for i in held]
            columns = [np.repeat(x[held], n) for x in (b.places, b.ids)] + [np.concatenate([np.empty(0, np.int64), *(ties[b.places[i]] for i in held)]), np.repeat(b.low[held], n)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], schema=schema)

    return map_arrow(vectors, select, "place long, query_id long, vec_id long, score long")


def top_k(df: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding", factor: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows with the highest integer inner product per query.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but those with the
    query's own id. Everything is scored, in blocks of queries; a block is sent to the executors, so
    vectors are never shuffled. A histogram of all scores of a query, refined around its k-th value
    until a bin holds one value, gives that value exactly; then the rows above it and the smallest ids
    at it stay. A task reports only the bins down to its own k-th value, and at the end fewer than
    ``k`` rows above the threshold and ``k`` at it, so a common vector makes no more rows than others.

    Null ids and vectors that are null or hold null or non-finite components take no part; vectors of
    different lengths are not compared; rows with one id are never candidates of each other, and equal
    query rows count once. Other columns are ignored; an empty table gives no rows.
    """
    spark = df.sparkSession
    vectors = quantized(df, key, vector, factor)
    queries = cut_lineage(vectors.filter(F.col("vec_id") % every == 0).distinct())
    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    largest = int(np.ceil(vectors.agg(F.max(length)).first()[0] or 0)) + 1
    results = []
    for n in range(n_blocks):
        # one block of about QUERY_BLOCK queries
        rows = queries.filter(F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_blocks)) == n).collect()
        by_dim = {}
        for dim in {len(r["v"]) for r in rows}:
            places = np.array([i for i, r in enumerate(rows) if len(r["v"]) == dim], dtype=np.int64)
            matrix = np.array([rows[i]["v"] for i in places], dtype=np.int64).reshape(len(places), dim)
            by_dim[dim] = Block(places, np.array([rows[i]["vec_id"] for i in places], dtype=np.int64), matrix, largest, k)
        first = True
        while any((b.width > 0).any() for b in by_dim.values()):
            sent = spark.sparkContext.broadcast(by_dim)
            counts: dict[int, list[tuple[int, int]]] = {}
            for place, bin_, count in _histograms(sent, vectors).collect():  # some bins of each query of the block
                counts.setdefault(place, []).append((bin_, count))
            for b in by_dim.values():
                if (b.width > 0).any():
                    b.narrow(counts, first)
            first = False
        w = Window.partitionBy("place").orderBy(F.col("score").desc(), "vec_id")
        ranked = _selected(spark.sparkContext.broadcast(by_dim), vectors).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        results.append(cut_lineage(ranked.select("query_id", "rank", "vec_id", "score")))
    return reduce(DataFrame.unionByName, results)
