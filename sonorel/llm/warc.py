"""WARC archives: a writer, and a PySpark Python data source that reads them.

The reader plans partitions from whole files, parses a record's headers first,
and decides from them alone: record types and header predicates that Spark
pushes down (or that are given as options) drop a record before its block is
touched, and unwanted blocks of uncompressed archives are skipped by seeking.
Files are opened through pyarrow's file systems, so any shared store serves.

Cases: null html is an empty payload. Payloads of at least 100 bytes that are
equal share one response, that of the smallest page_id; the others are revisit
records without payload, and repeated rows of that smallest page_id are all
responses. A null page_id has no page header and is never referred to (its
copies refer to the smallest id that isn't null; if there is none, all are
responses). Urls are percent-encoded where a header can't hold them, and null
ones left out. An empty table gives a folder without records, and a folder that
isn't there is read as one without. Other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from sonorel.llm.common import broadcast_if_small, materialize

LEAST_SHARED = 100
_URN = "urn:sonorel:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, page_id bigint, payload_digest string, payload_bytes bigint, refers_to bigint, payload binary"
#: Columns that headers alone decide, with the header each comes from.
HEADER_OF = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "warc_date": "warc-date",
    "page_id": "x-page-id",
    "payload_digest": "warc-payload-digest",
}


def mark_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload binary, digest, refers_to (null: a response)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    shared = base.where(F.octet_length("payload") >= LEAST_SHARED).groupBy("digest").agg(
        F.count("*").alias("n"),
        F.min("page_id").alias("first"),
    )
    shared = materialize(shared.where("n > 1 and first is not null").select("digest", "first"), "shared")
    joined = base.join(broadcast_if_small(shared), "digest", "left")
    return joined.withColumn(
        "refers_to",
        F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first")),
    ).drop("first")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%:/?#[]@!$&'()*+,;=~-._"))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_URN}{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", compress: bool = False) -> DataFrame:
    """One archive per task. A task writes under a name of its attempt and renames it at the end, so a task that
    is lost or runs twice leaves one whole file. Returns the manifest: file, records."""
    suffix = ".warc.gz" if compress else ".warc"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        files, root = fs.FileSystem.from_uri(path)
        name = f"part-{context.partitionId():06d}{suffix}"
        attempt, n = f"{root}/_attempts/{name}-{context.taskAttemptId()}", 0
        with files.open_output_stream(attempt, compression=None) as out:
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    raw = record(*row, date)
                    out.write(gzip.compress(raw, 6, mtime=0) if compress else raw)
                    n += 1
        files.move(attempt, f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["file", "records"])

    # Made before any task runs: a table without rows may have no task at all.
    files, root = fs.FileSystem.from_uri(path)
    files.create_dir(f"{root}/_attempts", recursive=True)
    marked = mark_revisits(pages).select("page_id", "url", "payload", "digest", "refers_to")
    return materialize(marked.mapInArrow(run, "file string, records bigint"), "manifest")


class Files(InputPartition):
    def __init__(self, names: list[tuple[str, int]]):
        super().__init__(0)
        self.names = names


def parse(stream, wanted, payloads: bool) -> Iterator[tuple]:
    """Records of an archive, as rows of SCHEMA. wanted: from the headers, whether to go on to the block."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"a record must begin with its version, not {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode("utf-8", "replace").partition(":")
            head[key.strip().lower()] = value.strip()
        size = int(head["content-length"])
        if not wanted(head):
            stream.seek(size, io.SEEK_CUR)
            continue
        end = stream.tell() + size
        declared = None
        if head.get("content-type", "").startswith("application/http"):
            while (line := stream.readline()).strip():
                key, _, value = line.partition(b":")
                if key.strip().lower() == b"content-length":
                    declared = int(value)
        rest = end - stream.tell()
        digest = head.get("warc-payload-digest", "").removeprefix("sha256:") or None
        body, length = None, rest if declared is None else declared
        if payloads and head.get("warc-type") != "revisit":
            body = stream.read(rest)
            if len(body) != rest:
                raise ValueError("the archive ends within a record")
            length = len(body)
            actual = hashlib.sha256(body).hexdigest()
            if digest is not None and actual != digest:
                raise ValueError(f"payload and digest of {head.get('warc-record-id')} differ")
            digest = actual
        stream.seek(end)
        number = lambda x: None if x is None else int(x.strip("<>").rpartition(":")[2])
        yield (
            head.get("warc-record-id"),
            head.get("warc-type"),
            head.get("warc-target-uri"),
            head.get("warc-date"),
            number(head.get("x-page-id")),
            digest,
            length,
            number(head.get("warc-refers-to")),
            body,
        )


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payloads = options.get("payloads", "true").lower() != "false"
        self.target = int(options.get("partitionbytes", 64 << 20))
        types = options.get("recordtypes")
        self.tests: dict[str, set[str]] = {"warc-type": set(types.split(","))} if types else {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            header = HEADER_OF.get(f.attribute[0]) if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if header is None:
                yield f
                continue
            allowed = {str(v) for v in ([f.value] if isinstance(f, EqualTo) else f.value)}
            if header == "warc-payload-digest":
                allowed = {f"sha256:{v}" for v in allowed}
            self.tests[header] = self.tests[header] & allowed if header in self.tests else allowed

    def partitions(self) -> list[Files]:
        files, root = fs.FileSystem.from_uri(self.path)
        found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        found = sorted((x.path, x.size) for x in found if x.is_file and x.path.endswith((".warc", ".warc.gz")))
        out, held = [], 0
        for path, size in found:
            if not out or held + size > self.target:
                out.append(Files([]))
                held = 0
            out[-1].names.append((path, size))
            held += size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(self.path)
        tests = list(self.tests.items())
        wanted = lambda head: all(head.get(h) in allowed for h, allowed in tests)
        types = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for path, _ in partition.names:
            with files.open_input_file(path) as raw:
                stream = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else io.BufferedReader(_Raw(raw), 1 << 16)
                rows, held = [], 0
                for row in parse(stream, wanted, self.payloads):
                    rows.append(row)
                    held += len(row[-1] or b"")
                    if len(rows) >= 2000 or held > 8 << 20:
                        yield _batch(rows, types, names)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, types, names)


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


class _Raw(io.RawIOBase):
    """A random-access file as a raw stream, so that buffered seeks skip blocks."""

    def __init__(self, file):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        at = {io.SEEK_SET: 0, io.SEEK_CUR: self.file.tell(), io.SEEK_END: self.file.size()}[whence] + offset
        self.file.seek(at)
        return at

    def tell(self) -> int:
        return self.file.tell()


class WarcDataSource(DataSource):
    """spark.read.format("warc").load(path). Options: payloads (false: headers only), recordTypes, partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader({k.lower(): v for k, v in dict(self.options).items()})


def read_warc(spark: SparkSession, path: str, record_types: tuple[str, ...] = (), payloads: bool = True) -> DataFrame:
    """Turns on the session's pushdown into Python data sources, without which Spark refuses a reader that takes filters."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("warc").option("payloads", str(payloads).lower())
    if record_types:
        reader = reader.option("recordTypes", ",".join(record_types))
    return reader.load(path)


ORACLE_SQL = f"""
WITH d AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= {LEAST_SHARED} GROUP BY payload_digest),
m AS (SELECT d.*, CASE WHEN page_id <> first THEN first END AS refers_to FROM d LEFT JOIN g USING (payload_digest))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM m
"""
