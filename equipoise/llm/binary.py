"""Token ids as seekable zstandard files: independent frames, a seek table at the end, checksums."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from equipoise.llm.bpe import ENCODE_BYTES, encoder, read_tokenizer
from equipoise.llm.common import commit_file, files, map_arrow, open_folder, ship, steps
from equipoise.session import shared_folder

# Fixed values of the published format of seekable zstandard files (frame magics of a skippable frame
# and of the seek table's foot; flag of a table with checksums).
SKIPPABLE, SEEKABLE, WITH_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
#: The magic of another skippable frame, which decoders pass over: it holds the ids of each frame.
ID_INDEX = 0x184D2A5D
#: Uncompressed bytes after which a frame is closed; a document is never cut between frames.
FRAME_BYTES = 1 << 18
LEVEL = 3
SUFFIX = ".tokens.zst"
#: A document in a frame: its id, whether it has one, and its number of ids.
HEAD = np.dtype([("doc_id", "<i8"), ("known", "<u4"), ("n", "<u4")])
#: What the index says of a frame: its smallest and largest id, and how many documents have one.
IDS = np.dtype([("first", "<i8"), ("last", "<i8"), ("known", "<u4")])
#: Ids that are looked for at once; they are sent to the tasks.
MOST_IDS = 1_000_000


def frame_body(heads: np.ndarray, ids: np.ndarray) -> bytes:
    """Documents, bytes of an id, heads, then all ids; two bytes do while every id fits."""
    wide = len(ids) > 0 and int(ids.max()) > 0xFFFF
    return struct.pack("<II", len(heads), 4 if wide else 2) + heads.tobytes() + ids.astype("<u4" if wide else "<u2").tobytes()


def parse_body(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, width = struct.unpack_from("<II", body)
    heads = np.frombuffer(body, HEAD, count=n, offset=8)
    return heads, np.frombuffer(body, f"<u{width}", offset=8 + heads.nbytes).astype(np.uint32)


def seek_table(entries: list[tuple[int, int, int]]) -> bytes:
    """The skippable frame at the end: sizes and checksum of each frame, then their number."""
    rows = b"".join(struct.pack("<III", *e) for e in entries)
    return struct.pack("<II", SKIPPABLE, len(rows) + 9) + rows + struct.pack("<IBI", len(entries), WITH_CHECKSUMS, SEEKABLE)


def id_range(heads: np.ndarray) -> tuple[int, int, int]:
    """The smallest and the largest id of a frame's documents, and how many have one."""
    ids = heads["doc_id"][heads["known"] == 1]
    return (int(ids.min()), int(ids.max()), len(ids)) if len(ids) else (0, 0, 0)


def id_index(ranges: list[tuple[int, int, int]]) -> bytes:
    """The skippable frame before the seek table, with a row a frame."""
    rows = np.array(ranges, IDS)
    return struct.pack("<II", ID_INDEX, rows.nbytes) + rows.tobytes()


class Reader:
    """Reads chosen frames of one file; only their bytes are fetched and decompressed."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, io.SEEK_END) or source.tell()
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE or flags != WITH_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        source.seek(size - 17 - 12 * n)
        if struct.unpack("<II", source.read(8)) != (SKIPPABLE, 12 * n + 9):
            raise ValueError("the seek table does not begin where it should")
        self.table = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])

    def __len__(self) -> int:
        return len(self.table)

    def frames_with(self, ids: np.ndarray) -> np.ndarray:
        """The numbers of the frames that may hold one of the sorted ``ids``, from the index alone; all of them in a file without one."""
        self.source.seek(int(self.starts[-1]))
        magic, size = struct.unpack("<II", self.source.read(8))
        if magic != ID_INDEX:
            return np.arange(len(self))
        rows = np.frombuffer(self.source.read(size), IDS)
        at = np.searchsorted(ids, rows["first"])
        return np.flatnonzero((rows["known"] > 0) & (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] <= rows["last"])) if len(ids) else np.empty(0, np.int64)

    def frame(self, k: int) -> bytes:
        packed, size, checksum = (int(x) for x in self.table[k])
        self.source.seek(int(self.starts[k]))
        body = zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=size)
        if len(body) != size or xxhash.xxh64_intdigest(body) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} is damaged")
        return body


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None) -> tuple[str, DataFrame]:
    """Encode whole texts, append ``end_id`` and write them in ascending doc_id order.

    Returns the folder and a table of the files: file (the order of the names is that of the ids),
    n_docs, n_ids, n_bytes. Documents are dealt out by ranges of (doc_id, text hash), so a repeated id
    may spread over files, and each task writes its range in order under a draft name that is renamed
    at the end; a lost task is run again and replaces its file. Null text counts as empty, null ids
    come first; an empty table gives no files. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or f"{shared_folder(spark)}/tokens"
    sent = spark.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        entries: list[tuple[int, int, int]] = []
        ranges: list[tuple[int, int, int]] = []
        totals = [0, 0]

        def frames(first: pa.RecordBatch) -> Iterator[bytes]:
            encode, pack = encoder(sent.value).encode, zstandard.ZstdCompressor(level=LEVEL, write_content_size=True).compress
            open_heads, open_ids, size = [], [], 0

            def close() -> bytes:
                heads = np.concatenate(open_heads)
                ranges.append(id_range(heads))
                body = frame_body(heads, np.concatenate(open_ids))
                packed = pack(body)
                entries.append((len(packed), len(body), xxhash.xxh64_intdigest(body) & 0xFFFFFFFF))
                open_heads.clear()
                open_ids.clear()
                return packed

            for batch in steps(_chain(first, batches), size=ENCODE_BYTES):
                ids, bounds = encode(batch["text"])
                heads = np.zeros(batch.num_rows, HEAD)
                heads["doc_id"] = batch["doc_id"].fill_null(0).to_numpy()
                heads["known"] = batch["doc_id"].is_valid().to_numpy(zero_copy_only=False)
                heads["n"] = np.diff(bounds) + 1
                ids = np.insert(ids, bounds[1:], end_id)
                bounds = bounds + np.arange(len(bounds))
                totals[0] += len(heads)
                totals[1] += len(ids)
                begin = 0
                while begin < len(heads):
                    # the documents that still fit, one at least
                    room = int(np.searchsorted(bounds, bounds[begin] + max(0, FRAME_BYTES - size) // 2, side="right")) - 1
                    end = min(max(room, begin + 1), len(heads))
                    open_heads.append(heads[begin:end])
                    open_ids.append(ids[bounds[begin] : bounds[end]])
                    size += 2 * int(bounds[end] - bounds[begin])
                    if size >= FRAME_BYTES or end < len(heads):
                        yield close()
                        size = 0
                    begin = end
            if open_heads:
                yield close()
            yield id_index(ranges)
            yield seek_table(entries)

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        name = f"part-{context.partitionId():06d}{SUFFIX}"
        n_bytes = commit_file(folder, name, context.taskAttemptId(), frames(first))
        yield pa.RecordBatch.from_pydict({"file": [name], "n_docs": [totals[0]], "n_ids": [totals[1]], "n_bytes": [n_bytes]})

    system, path = open_folder(folder)
    system.create_dir(path, recursive=True)
    written = map_arrow(ordered, write, "file string, n_docs long, n_ids long, n_bytes long")
    # one small row a file; this runs the writing once
    return folder, spark.createDataFrame(written.collect(), "file string, n_docs long, n_ids long, n_bytes long")


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """The documents of a folder from its files: file, place and offset (in the file), doc_id, n_tokens, ids_crc32, and ids if asked.

    Each file is opened in its task and read frame by frame; every checksum is checked.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                system, inner = open_folder(path)
                with system.open_input_file(inner) as source:
                    reader, place, read_ids = Reader(source), 0, 0
                    for k in range(len(reader)):
                        heads, ids = parse_body(reader.frame(k))
                        raw, ends = ids.astype("<u4").tobytes(), np.cumsum(heads["n"], dtype=np.int64)
                        starts = ends - heads["n"]
                        columns = {
                            "file": pa.array([inner.rpartition("/")[2]] * len(heads)),
                            "place": pa.array(np.arange(place, place + len(heads))),
                            "doc_id": pa.array(heads["doc_id"].astype(np.int64), mask=heads["known"] == 0),
                            "offset": pa.array(starts + read_ids),
                            "n_tokens": pa.array(heads["n"].astype(np.int64)),
                            "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64()),
                        }
                        if with_ids:
                            columns["ids"] = pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1:]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                        place, read_ids = place + len(heads), read_ids + len(ids)
                        yield pa.RecordBatch.from_pydict(columns)

    schema = "file string, place long, doc_id long, offset long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return map_arrow(files(spark, folder, SUFFIX).select("path"), read, schema)


def read_documents(spark: SparkSession, folder: str, ids: Iterable[int]) -> DataFrame:
    """doc_id, n_tokens and ids of the documents with the given ids, one row for each that is there.

    A file gives its seek table and the range of ids of each frame; only frames that can hold a wanted id
    are fetched and decompressed. Ids are sent to the tasks, so over MOST_IDS raise.
    """
    wanted = np.unique(np.array(list(ids), dtype=np.int64))
    if len(wanted) > MOST_IDS:
        raise ValueError(f"{len(wanted)} ids; at most {MOST_IDS} are looked for at once")
    ship(spark)
    sent = spark.sparkContext.broadcast(wanted)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                system, inner = open_folder(path)
                with system.open_input_file(inner) as source:
                    reader = Reader(source)
                    for k in reader.frames_with(sent.value).tolist():
                        heads, tokens = parse_body(reader.frame(k))
                        ends = np.cumsum(heads["n"], dtype=np.int64)
                        rows = np.flatnonzero((heads["known"] == 1) & np.isin(heads["doc_id"], sent.value))
                        listed = pa.array([tokens[ends[i] - heads["n"][i] : ends[i]].astype(np.int32) for i in rows.tolist()], pa.list_(pa.int32()))
                        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(heads["doc_id"][rows].astype(np.int64)), "n_tokens": pa.array(heads["n"][rows].astype(np.int64)), "ids": listed})

    return map_arrow(files(spark, folder, SUFFIX).select("path"), read, "doc_id long, n_tokens long, ids array<int>")


def token_starts(spark: SparkSession, folder: str, written: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32: read back from the files.

    Offsets within a file come with its documents; the sums before each file come from the table of
    files, which has a row a file and is joined as a broadcast.
    """
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    before = written.select("file", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("before"))
    rows = read_tokens(spark, folder, with_ids=False).join(F.broadcast(before), "file")
    return rows.select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
