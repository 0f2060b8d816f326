"""WARC archives: writing captures with request and metadata records, and assembling transactions."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equipoise.llm.common import commit_file, files, map_arrow, open_folder, ship
from equipoise.session import cut_lineage, shared_folder

# Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SUFFIX = ".warc.gz"
#: Compressed bytes after which a task begins another file.
FILE_BYTES = 64 << 20
#: Where an archive folder lists its files, and how many names are sent to the executors at most; more are joined.
LIST, MOST_SENT = "_files", 100_000
#: The time of every capture: the pages carry none, and a file must be the same when it is written again.
DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
LEVEL = 4


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(kind: str, key) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{kind}:{key}')}>"


def record(kind: str, own_id: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    lines = [("WARC-Type", kind), ("WARC-Record-ID", own_id), ("WARC-Date", DATE), *headers, ("Content-Length", str(len(block)))]
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in lines) + b"\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def _one_line(value: str) -> str:
    return " ".join(value.split())


def capture(page_id: int | None, place: str, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """Response or revisit, request and metadata of one page. ``place`` tells apart pages without id or with one id."""
    own, target = record_id("capture", place), _one_line(url or "")
    uri = [("WARC-Target-URI", target)] if target else []
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    common = [*uri, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if payload is not None:
        first = record("response", own, common, http + payload)
    else:
        first = record("revisit", own, [*common, ("WARC-Profile", IDENTICAL), ("WARC-Refers-To", record_id("capture", refers_to))], http)
    host, _, path = target.partition("://")[2].partition("/")
    request = f"GET /{path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    fields = f"page-id: {'' if page_id is None else page_id}\r\n".encode()
    return (
        first
        + record("request", record_id("request", place), [*uri, ("WARC-Concurrent-To", own), ("Content-Type", "application/http;msgtype=request")], request)
        + record("metadata", record_id("metadata", place), [*uri, ("WARC-Concurrent-To", own), ("Content-Type", "application/warc-fields")], fields)
    )


def write_archives(pages: DataFrame, smallest_revisit: int = 0, folder: str | None = None) -> str:
    """Write a capture for every row (page_id, url, html) and return the folder of the archives.

    Payload is the html in UTF-8; null is empty. Of rows with equal payloads of at least
    ``smallest_revisit`` bytes the one with the largest page_id is a response and the others revisit
    it; rows that share that largest id (or that have no id where none has one) are all responses.
    The largest id of each digest is an aggregate that is combined before its shuffle. Responses keep
    their payload and meet it by digest and id, which few rows share; the others meet it by digest
    without their payload, so a common payload is never carried to one place. Extra columns are
    ignored; an empty table gives an empty folder.

    Each attempt of a task writes files of bounded size under names of its own. The names of those that
    ended are committed with the job as a list in the folder, and only listed files are read, so what a
    lost attempt left behind does not count.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = folder or f"{shared_folder(spark)}/warc"
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.cast("binary").alias("payload"),
        F.octet_length(html).cast("long").alias("size"), F.unhex(F.sha1(html.cast("binary"))).alias("sha"),
    )
    large = rows.filter(F.col("size") >= smallest_revisit)
    last = cut_lineage(large.groupBy("sha").agg(F.max("page_id").alias("last")))
    first = last.select(F.col("sha").alias("own_sha"), "last")
    same = (F.col("sha") == F.col("own_sha")) & F.col("page_id").eqNullSafe(F.col("last"))
    responses = large.join(first, same, "left_semi")
    if smallest_revisit > 0:
        responses = responses.unionByName(rows.filter(F.col("size") < smallest_revisit))
    revisits = large.drop("payload").join(last, "sha").filter(~F.col("page_id").eqNullSafe(F.col("last")))
    columns = ["page_id", "url", "payload", "size", "sha"]
    lean = responses.select(*columns, F.lit(None).cast("long").alias("refers_to")).unionByName(
        revisits.withColumn("payload", F.lit(None).cast("binary")).select(*columns, F.col("last").alias("refers_to"))
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        records = (capture(p, f"{p}" if p is not None and r is None else f"{p}/{context.partitionId()}/{n}", u, None if r is not None else body, s, base64.b32encode(sha).decode(), r)
                   for n, (p, u, body, s, sha, r) in enumerate(x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True)))
        n, held = 0, next(records, None)
        while held is not None:

            def some() -> Iterator[bytes]:
                nonlocal held
                size = 0
                while held is not None and size < FILE_BYTES:
                    size += len(held)
                    yield held
                    held = next(records, None)

            name = f"part-{context.partitionId():06d}-{n:04d}-{context.taskAttemptId()}{SUFFIX}"
            size = commit_file(folder, name, context.taskAttemptId(), some())
            yield pa.RecordBatch.from_pydict({"file": [name], "n_bytes": [size]})
            n += 1

    system, path = open_folder(folder)
    system.create_dir(path, recursive=True)
    map_arrow(lean, write, "file string, n_bytes long").write.parquet(f"{folder}/{LIST}")
    return folder


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of the archives of a folder: the listed ones where there is a list, else all. Spark deals them out by length."""
    paths = files(spark, folder, SUFFIX).select("path")
    system, inner = open_folder(folder)
    if system.get_file_info(f"{inner.rstrip('/')}/{LIST}").type == fs.FileType.NotFound:
        return paths
    listed = spark.read.schema("file string").parquet(f"{folder}/{LIST}")
    n, named = listed.count(), paths.withColumn("file", F.element_at(F.split("path", "/"), -1))
    if n <= MOST_SENT:
        return named.join(F.broadcast(listed), "file", "left_semi").select("path")
    return named.join(listed, "file", "left_semi").select("path").repartition(-(-n // 8))


def _lines(source) -> Iterator[bytes]:
    """Decompressed pieces of a file of gzip members."""
    packed, unpacker = b"", zlib.decompressobj(31)
    while True:
        packed = packed or source.read(1 << 20)
        if not packed:
            return
        out = unpacker.decompress(packed, 1 << 20)
        if out:
            yield out
        packed = unpacker.unconsumed_tail
        if unpacker.eof:
            packed, unpacker = unpacker.unused_data, zlib.decompressobj(31)


class Stream:
    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, bytearray()

    def _more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.held += piece
        return True

    def until(self, end: bytes) -> bytes | None:
        """Up to and with ``end``; None at the end of the file."""
        start = 0
        while (at := self.held.find(end, start)) < 0:
            start = max(0, len(self.held) - len(end))
            if not self._more():
                if self.held.strip():
                    raise ValueError("a record breaks off")
                return None
        return self.take(at + len(end))

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError("a record breaks off")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def parse_records(source) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """Headers (names in lower case) and block of each record of an open archive."""
    stream = Stream(_lines(source))
    while (head := stream.until(b"\r\n\r\n")) is not None:
        version, *lines = head.decode("utf-8", "replace").strip("\r\n").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record begins with {version[:40]!r}")
        headers: dict[str, list[str]] = {}
        for line in lines:
            name, _, value = line.partition(":")
            headers.setdefault(name.strip().lower(), []).append(value.strip())
        block = stream.take(int(headers["content-length"][0]))
        stream.take(4)
        yield headers, block


RECORDS = (
    "record_id string, record_type string, concurrent_to array<string>, refers_to string, target_uri string, date string, "
    "stated_digest string, payload_digest string, payload_bytes long, fields map<string,string>, payload binary"
)
ARROW_RECORDS = pa.schema(
    [*((name, pa.string()) for name in ("record_id", "record_type")), ("concurrent_to", pa.list_(pa.string()))]
    + [(name, pa.string()) for name in ("refers_to", "target_uri", "date", "stated_digest", "payload_digest")]
    + [("payload_bytes", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
)


def read_records(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of all archives of a folder, each file streamed in its task.

    ``payload`` is the HTTP body of a response or request, else the block; its digest and size are
    computed here. For a revisit, which has no body, both are those it states for the full payload.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = ARROW_RECORDS
        for batch in batches:
            for path in batch["path"].to_pylist():
                system, inner = open_folder(path)
                rows, size = [], 0
                with system.open_input_stream(inner, compression=None) as source:
                    for headers, block in parse_records(source):
                        get = lambda name, h=headers: h.get(name, [None])[0]
                        kind, content = get("warc-type"), get("content-type") or ""
                        head, gap, body = block.partition(b"\r\n\r\n") if content.startswith("application/http") else (block, b"", block)
                        fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")) if _) if gap or content.startswith("application/warc-fields") else {}
                        stated = (get("warc-payload-digest") or "").removeprefix("sha1:") or None
                        revisit = kind == "revisit"
                        n = int(fields["content-length"]) if revisit and fields.get("content-length", "").isdigit() else len(body)
                        rows.append((get("warc-record-id"), kind, headers.get("warc-concurrent-to", []), get("warc-refers-to"), get("warc-target-uri"), get("warc-date"),
                                     stated, stated if revisit else payload_digest(body), n, list(fields.items()), body if with_payload else None))
                        size += len(body) * with_payload + 500
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return map_arrow(archives(spark, folder), read, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One row a capture: ``response`` (a response or revisit), and arrays of its ``requests`` and ``metadata``.

    Records belong together if either names the other as concurrent. Links are (capture, other) pairs
    from both directions; they meet the other records by id and are grouped by capture, so a group
    holds one capture's few records. Requests and metadata without a capture are left out; a capture
    without them has empty arrays. A record id should be unique; of a repeated one, each row is kept.
    """
    captures = records.filter("record_type in ('response', 'revisit')")
    others = records.filter("record_type in ('request', 'metadata')").select("record_id", "concurrent_to", F.struct("record_type", "record_id", "target_uri", "fields", "payload").alias("other"))
    forward = others.select(F.explode("concurrent_to").alias("capture"), "record_id", "other")
    named = captures.select(F.col("record_id").alias("capture"), F.explode("concurrent_to").alias("record_id"))
    backward = named.join(others.select("record_id", "other"), "record_id").select("capture", "record_id", "other")
    listed = forward.unionByName(backward).groupBy("capture").agg(F.collect_list("other").alias("others"))
    ids = F.transform("others", lambda x: x["record_id"])  # a pair that names each other is there twice
    together = listed.withColumn("others", F.filter("others", lambda x, i: F.array_position(ids, x["record_id"]) == i + 1))
    of = lambda kind: F.coalesce(F.filter("others", lambda x: x["record_type"] == kind), F.array().cast(together.schema["others"].dataType))
    response = F.struct(*[c for c in records.columns if c != "concurrent_to"])
    return captures.select(F.col("record_id").alias("capture"), response.alias("response")).join(together, "capture", "left").select("capture", "response", of("request").alias("requests"), of("metadata").alias("metadata"))


def page_captures(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id), from the archives alone."""
    # the archives are parsed once, however often assembling reads their records
    nested = assemble(cut_lineage(read_records(spark, folder)))
    pages = cut_lineage(nested.select(
        F.get("metadata", 0)["fields"]["page-id"].try_cast("long").alias("page_id"), "capture", F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), F.col("response.record_type").alias("record_type"), F.col("response.refers_to").alias("refers"),
    ))
    origin = pages.filter("record_type = 'response'").groupBy(F.col("capture").alias("refers")).agg(F.max("page_id").alias("refers_to"))
    # captures that refer to nothing would be one key of the join
    own = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    revisits = pages.filter("refers is not null").join(origin, "refers", "left").select(*own, "refers_to")
    return revisits.unionByName(pages.filter("refers is null").select(*own, F.lit(None).cast("long").alias("refers_to")))
