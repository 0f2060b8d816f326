"""Helpers of the operators: Arrow batches of bounded bytes, word hashes, files in the shared folder."""

from __future__ import annotations

import ctypes
import re
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: Texts of one step in a task, in bytes; a longer text is a step of its own.
STEP_BYTES = 1 << 21
#: Rows of one Arrow batch; with it a batch of long texts stays small.
BATCH_ROWS = 512
#: Bytes of the words whose hash a task remembers, and what a remembered word takes besides its own.
REMEMBERED_BYTES, WORD_BYTES = 32 << 20, 160


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Hand the package to the executors through Spark's own file service, once for each context."""
    context, package = spark.sparkContext, Path(__file__).resolve().parents[1]
    if getattr(context, "_equipoise_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="equipoise-")) / "equipoise_tasks.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, str(source.relative_to(package.parent)))
    context.addPyFile(str(archive))
    context._equipoise_shipped = True


#: What else a worker forgets at the end of a task.
AT_TASK_END: list[Callable[[], None]] = []


def give_back() -> None:
    """Return memory that this worker no longer uses, so that workers waiting for their next task are small."""
    for forget in AT_TASK_END:
        forget()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with small batches, so that long texts do not meet in one; a task gives its memory back at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            give_back()

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name, "10000")) <= BATCH_ROWS:
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``size`` bytes of ``column``, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // size
        cuts = np.flatnonzero(np.diff(group)) + 1
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(start, end - start)


class WordHashes(dict):
    """64-bit hash of a word's bytes; remembers as many words as fit in REMEMBERED_BYTES."""

    room = REMEMBERED_BYTES

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if self.room > 0:
            self.room -= len(word) + WORD_BYTES
            self[word] = value
        return value


def word_arrays(texts: list[bytes | None], known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in a row, and the bounds of each text among them.

    ``bytes.split`` parts at the bytes 09-0D and 20 alone, which is the word rule of all operators.
    """
    words = [text.split() if text else [] for text in texts]
    bounds = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in words], out=bounds[1:])
    hashes = np.empty(int(bounds[-1]), dtype=U64)
    get = known.__getitem__
    for x, start in zip(words, bounds, strict=False):
        hashes[start : start + len(x)] = np.fromiter(map(get, x), dtype=U64, count=len(x))
    return hashes, bounds


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def window_hashes(hashes: np.ndarray, size: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """The hash of every ``size`` consecutive values; windows across texts are among them.

    Windows of doubling length are put together, so the work grows with the logarithm of ``size``.
    """
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=U64)
    out, done, power, span, factor = np.zeros(n, dtype=U64), 0, hashes, 1, base % (1 << 64)
    rest = size
    while rest:
        if rest & 1:
            out = out * U64(factor) + power[done : done + n]
            done += span
        rest >>= 1
        if rest:
            power = power[: len(power) - span] * U64(factor) + power[span:]
            span, factor = 2 * span, factor * factor % (1 << 64)
    return mixed(out)


def inside(bounds: np.ndarray, size: int) -> np.ndarray:
    """For every window of ``window_hashes``: does it lie in one text?"""
    n = int(bounds[-1]) - size + 1
    valid = np.ones(max(n, 0), dtype=bool)
    for end in bounds[1:-1]:
        valid[max(0, end - size + 1) : end] = False
    return valid


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in a window of ``size`` that starts at one of ``starts``."""
    change = np.zeros(n + 1, dtype=np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + size, n), -1)
    return np.cumsum(change[:-1]) > 0


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder in a shared store; works in tasks and on the driver."""
    uri = re.sub(r"^file:/+", "file:///", uri)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def commit_file(uri: str, name: str, attempt: int, chunks: Iterator[bytes]) -> int:
    """Write a file under a name of this attempt and give it its final name at the end.

    A task that is run again, or twice at once, replaces the file by an equal one.
    """
    system, path = open_folder(uri)
    system.create_dir(path, recursive=True)
    draft, size = f"{path}/_draft-{attempt}-{name}", 0
    with system.open_output_stream(draft, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    system.move(draft, f"{path}/{name}")
    return size


def files(spark: SparkSession, uri: str, suffix: str) -> DataFrame:
    """Path and length of the files of a folder; Spark deals them out by length, their content is not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(uri).select("path", "length")
