"""Bulk-synchronous best-fit packing of documents into sequences of a fixed capacity."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equipoise.llm.bpe import encode_bytes, encoder, read_tokenizer
from equipoise.llm.common import map_arrow, ship, steps
from equipoise.session import cut_lineage

CAPACITY = 4096


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, lean: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document; nothing is shuffled.

    A document is its whole text's ids and ``end_id``; only longer ones are cut, at multiples of
    ``capacity``. Null text is empty, null and repeated ids are kept, other columns are ignored.
    With ``lean`` the tasks remember fewer words: slower, for runs that have little memory left.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(sent.value, lean).encode
        for batch in steps(batches, size=encode_bytes(lean)):
            ids, bounds = encode(batch["text"])
            ids = np.insert(ids, bounds[1:], end_id)
            bounds = bounds + np.arange(len(bounds))
            sizes = np.diff(bounds)
            n = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(sizes[row] - start, capacity)
            raw = ids.astype("<u4").tobytes()
            begin = 4 * (bounds[row] + start)
            crc = [zlib.crc32(raw[a : a + b]) for a, b in zip(begin.tolist(), (4 * length).tolist(), strict=True)]
            columns = [batch["doc_id"].take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Runs:
    """Sequences by gap: for each gap a stack of runs (first sequence, number) of neighbours with that gap."""

    def __init__(self, capacity: int):
        self.by_gap: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.count = np.zeros(capacity + 1, dtype=np.int64)
        self.opened = 0

    def add(self, gap: int, first: int, n: int) -> None:
        self.by_gap[gap].append((first, n))
        self.count[gap] += n

    def take(self, gap: int, most: int) -> tuple[int, int]:
        first, n = self.by_gap[gap].pop()
        used = min(n, most)
        if used < n:
            self.by_gap[gap].append((first + used, n - used))
        self.count[gap] -= used
        return first, used

    def open(self, n: int) -> int:
        self.opened += n
        return self.opened - n


def sweeps(count: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The rounds of best-fit on sizes: rows (length, rank, n, sequence, offset), and the number of sequences.

    ``count`` has the number of documents by length; documents of one length are told apart by rank
    alone, sequences with one gap by number alone. So however many documents there are, a round works
    on at most ``capacity`` sizes. A round is one sweep for the largest length that is left: its
    successor is the smallest gap that holds it; that gap's sequences go to the documents in the order
    of rank, which resolves all conflicts at once; those left over go on to the next larger gap, and
    after the last one into new sequences. Gaps are then updated, and the next round sees them.
    """
    runs, plan = Runs(capacity), []
    for length in range(capacity, 0, -1):
        left, rank = int(count[length]), 0
        while left:
            fitting = np.flatnonzero(runs.count[length:])
            if len(fitting):
                gap = length + int(fitting[0])
                first, n = runs.take(gap, left)
            else:
                gap, per = capacity, capacity // length
                n = -(-left // per) if length < capacity else left
                first = runs.open(n)
            plan.append((length, rank, n, first, capacity - gap))
            if gap > length:
                runs.add(gap - length, first, n)
            left, rank = left - n, rank + n
    return np.array(plan, dtype=np.int64).reshape(-1, 5), runs.opened


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (any columns and ``length``) with sequence_id and offset, in as few sequences as best-fit gives.

    Pieces are range-sorted by length once and stored; a piece's rank among those of its length is its
    place in its range plus the sizes of the ranges before it, so no length, however common, has to
    meet in one task. The sweeps give intervals of ranks (their number is bounded by ``capacity``, not
    by the pieces), which are sent to the tasks and looked up by binary search. Lengths must be 1 to
    ``capacity``; columns sequence_id and offset are replaced. The result has the rows of ``pieces``; which of equal lengths goes where is not defined.
    """
    spark = pieces.sparkSession
    ship(spark)
    pieces = cut_lineage(pieces.drop("sequence_id", "offset"))  # sorting by range reads its rows twice; they are encoded once
    columns = pieces.columns
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    others = [F.col(f"`{c}`") for c in columns if c != "length"]
    order = ["length", F.xxhash64(*others)] if others else ["length"]
    ordered = pieces.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            added = [pa.array(np.full(batch.num_rows, part), pa.int32()), pa.array(np.arange(place, place + batch.num_rows), pa.int64())]
            place += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "_equipoise_range", "_equipoise_place"])

    stored = cut_lineage(map_arrow(ordered, number, f"{kinds}, _equipoise_range int, _equipoise_place long"))
    # a row a range, and a row a length: both are bounded by settings, not by the pieces
    sizes = stored.groupBy("_equipoise_range").agg(F.count("*").alias("n")).collect()
    by_length = stored.groupBy("length").agg(F.count("*").alias("n")).collect()
    if any(not r["length"] or not 0 < r["length"] <= capacity for r in by_length):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    before = np.zeros(max((r["_equipoise_range"] for r in sizes), default=-1) + 2, dtype=np.int64)
    for r in sizes:
        before[r["_equipoise_range"] + 1] = r["n"]
    before = np.cumsum(before)
    count = np.zeros(capacity + 1, dtype=np.int64)
    for r in by_length:
        count[r["length"]] = r["n"]
    smaller = np.cumsum(count) - count
    plan, _ = sweeps(count, capacity)
    begin = smaller[plan[:, 0]] + plan[:, 1]
    order = np.argsort(begin)
    sent = spark.sparkContext.broadcast((before, begin[order], plan[order, 3], plan[order, 4]))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, begin, first, offset = sent.value
        for batch in batches:
            place = before[batch["_equipoise_range"].to_numpy()] + batch["_equipoise_place"].to_numpy()
            at = np.searchsorted(begin, place, side="right") - 1
            added = [pa.array(first[at] + place - begin[at], pa.int64()), pa.array(offset[at], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch[c] for c in columns] + added, [*columns, "sequence_id", "offset"])

    return map_arrow(stored, assign, f"{kinds}, sequence_id long, offset long")
