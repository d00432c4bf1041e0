"""WARC records in ZIP-packaged archives, written and read by byte ranges.

An archive is a ZIP file with the stored members ``archive/data.warc.gz`` (a
gzip member per record) and ``indexes/index.cdxj`` (a line per record with its
place).  Of records with equal payloads of at least ``MIN_REVISIT`` bytes the
one with the smallest ``page_id`` is a response, the others revisit it.

Reading goes over the table of archives: the first step parses each ZIP
directory and its index and lists spans of records, the second reads the
spans from the stored member where they lie.

Defined cases: null or empty html is an empty payload (a response); a null
``page_id`` counts as larger than any other, and rows that share the smallest
``page_id`` are all responses, so repeated rows repeat; a null url has no
target header; an empty table gives no archives and no rows; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm.storage import file_system, put_file, work_dir
from sitelens.llm.ziparchive import data_start, read_directory, zip_chunks

MIN_REVISIT = 100
ARCHIVE_BYTES = 32 << 20
SPAN_BYTES = 2 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
ARCHIVES = "archive string, size long, records long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def classified(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Pages with payload, digest and the ``page_id`` of the response to their payload."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    small = F.octet_length("payload") < min_revisit
    first = rows.where(~small).groupBy("digest").agg(F.min("page_id").alias("first_id"))
    # a small payload shares no key with another, so no hot empty page gathers in a task
    key = F.when(~small, F.col("digest"))
    return rows.withColumn("key", key).join(first.withColumnRenamed("digest", "key"), "key", "left").drop("key")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, first_id: int | None) -> tuple[str, bytes]:
    """(type, WARC record) of a page."""
    revisit = first_id is not None and first_id != page_id
    kind = "revisit" if revisit else "response"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{first_id}>"]
    block = HTTP_HEAD % len(payload) + (b"" if revisit else payload)
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return kind, "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, payload) of a WARC record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, zip64: bool = False, level: int = 3) -> DataFrame:
    """Write a record per page into archives below ``folder``; returns the table of archives, also kept there."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        parts: list[bytes] = []
        lines: list[bytes] = []
        at = number = 0

        def close() -> pa.RecordBatch:
            name = f"part-{task.partitionId():06d}-{number:04d}.wacz"
            size = put_file(f"{folder}/{name}", f"{task.taskAttemptId()}", zip_chunks([(DATA, parts), (INDEX, [b"".join(lines)])], zip64))
            return pa.record_batch([pa.array([name]), pa.array([size]), pa.array([len(parts)])], names=["archive", "size", "records"])

        for batch in batches:
            for page_id, url, payload, digest, first_id in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "first_id")), strict=True):
                kind, record = record_bytes(page_id, url, payload, digest.hex(), first_id)
                data = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = data.compress(record) + data.flush()
                entry = {"offset": at, "length": len(data), "page_id": page_id, "mime": f"warc/{kind}"}
                lines.append(b"%012d %s\n" % (len(lines), json.dumps(entry, separators=(",", ":")).encode()))
                parts.append(data)
                at += len(data)
                if at >= archive_bytes:
                    yield close()
                    parts, lines, at, number = [], [], 0, number + 1
        if parts:
            yield close()

    rows = classified(pages).select("page_id", "url", "payload", "digest", "first_id")
    rows.mapInArrow(write, ARCHIVES).write.parquet(f"{folder}/archives")
    return pages.sparkSession.read.schema(ARCHIVES).parquet(f"{folder}/archives")


def ranges_of(stream, size: int):
    def read(at: int, n: int) -> bytes:
        stream.seek(at)
        return stream.read(n)

    return read


def read_archives(spark: SparkSession, folder: str, span_bytes: int = SPAN_BYTES) -> DataFrame:
    """A row per record: page, payload length and digest, type, and the page a revisit refers to."""
    archives = spark.read.schema(ARCHIVES).parquet(f"{folder}/archives")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for batch in batches:
            for archive, size in zip(batch.column("archive").to_pylist(), batch.column("size").to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{archive}") as f:
                    read = ranges_of(f, size)
                    members = {m.name: m for m in read_directory(read, size)}
                    index = read(data_start(read, members[INDEX]), members[INDEX].size)
                    base = data_start(read, members[DATA])
                out, begin, end = [], 0, 0
                for line in index.splitlines():
                    entry = json.loads(line.split(b" ", 1)[1])
                    if end > begin and entry["offset"] + entry["length"] - begin > span_bytes:
                        out.append((archive, base + begin, end - begin))
                        begin = entry["offset"]
                    end = entry["offset"] + entry["length"]
                out.append((archive, base + begin, end - begin))
                yield pa.record_batch([pa.array(c) for c in zip(*out, strict=True)], names=["archive", "at", "length"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for batch in batches:
            for archive, at, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "at", "length")), strict=True):
                with fs.open_input_file(f"{root}/{archive}") as f:
                    f.seek(at)
                    data = f.read(length)
                out = []
                while data:
                    member = zlib.decompressobj(31)
                    headers, payload = parse_record(member.decompress(data) + member.flush())
                    data = member.unused_data
                    digest = headers["warc-payload-digest"].removeprefix("sha256:")
                    if headers["warc-type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{archive}: payload does not match its digest")
                    refers_to = _page(headers["warc-refers-to"]) if "warc-refers-to" in headers else None
                    out.append((_page(headers["warc-record-id"]), int(headers["x-payload-length"]), digest, headers["warc-type"], refers_to))
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[x.split()[0] for x in RECORDS.split(", ")])

    places = archives.mapInArrow(spans, "archive string, at long, length long")
    spread = places.repartition(max(1, 4 * spark.sparkContext.defaultParallelism), "archive", "at")
    return spread.mapInArrow(records, RECORDS)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """The round trip: archives in a folder of this run, read back."""
    spark = pages.sparkSession
    folder = work_dir(spark, "warc")
    write_archives(pages, folder)
    return read_archives(spark, folder)
