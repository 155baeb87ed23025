"""WARC archives with revisit records.

Archives are written by Spark's text writer: a record is one value, the writer ends it with the two
line ends the format asks for, files are compressed whole, committed like any table and readable from
every file system Spark knows. A task starts a new archive whenever the current one would pass
ARCHIVE_BYTES, so that a file can be read as one value and parsed by the lengths in its headers.

Resolution never shuffles a payload. Headers alone (id, digest, length) are grouped by payload digest
with partial aggregates, so a payload that a third of the pages share is one row per task; the largest
id of a digest becomes the response. Headers joined with these originals tell which records stay
responses; records are then read again and written with fresh headers, responses with their block,
revisits without.

A null page is an empty payload. Repeated rows with one id are records of their own: all but one of
them are revisits of that id, chosen by their place in the archives. Rows without an id are written
under the id of no page and resolved like the others, after all that have one. An empty table writes no
records.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import Staged, bounded_batches, table

ARCHIVE_BYTES = 8 << 20
MIN_BYTES = 0
VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = (
    "record_id string, record_type string, url string, payload_digest string, payload_bytes long, refers_to string, archive string, place int"
)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: dict[str, str], block: bytes) -> bytes:
    """A record without the two line ends after it."""
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers.items()), f"Content-Length: {len(block)}".encode(), b"", b""]
    return b"\r\n".join(lines) + block


def parse(data: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Headers and block of every record of an archive, by the lengths its headers give."""
    at, view = 0, memoryview(data)
    while at < len(data):
        if data[at : at + len(VERSION)] != VERSION:
            raise ValueError(f"no record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        headers = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        begin = end + 4
        at = begin + int(headers["Content-Length"])
        yield headers, view[begin:at]
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"no end of record at byte {at}")
        at += 4


def unpacked(content: bytes) -> bytes:
    """The archive itself; compressed files may have one or many members."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:
        member = zlib.decompressobj(31)
        out.append(member.decompress(content))
        content = member.unused_data
    return b"".join(out)


def write_archives(records: DataFrame, path: str) -> None:
    """Writes (record binary, archive string): one folder per archive, in the order of the rows."""
    records.select(F.col("record").cast("string").alias("value"), "archive").write.partitionBy("archive").option(
        "lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


class Roll:
    """Names of archives within a task: the next one when the current is full."""

    def __init__(self, limit: int):
        from pyspark import TaskContext

        self.task, self.limit, self.number, self.size = TaskContext.get().partitionId(), limit, 0, 0

    def __call__(self, size: int) -> str:
        if self.size and self.size + size > self.limit:
            self.number, self.size = self.number + 1, 0
        self.size += size
        return f"{self.task:06d}-{self.number:04d}"


def responses(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", limit: int = ARCHIVE_BYTES) -> DataFrame:
    """A response record per page, and the archive it goes to."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Roll(limit)
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                records, archives = [], []
                for key, address, payload in zip(*(c.to_pylist() for c in batch.slice(begin, 64).columns)):
                    payload = payload or b""
                    headers = {"WARC-Type": "response", "WARC-Record-ID": f"<urn:page:{'' if key is None else key}>", "WARC-Date": DATE}
                    if address is not None:
                        headers["WARC-Target-URI"] = " ".join(address.split())
                    headers |= {"WARC-Payload-Digest": f"sha1:{payload_digest(payload)}", "Content-Type": "text/html"}
                    records.append(record(headers, payload))
                    archives.append(roll(len(records[-1])))
                yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary()), pa.array(archives)], names=["record", "archive"])

    return pages.select(F.col(page_id).cast("string"), F.col(url).cast("string"), F.col(html).cast("binary")).mapInArrow(
        build, "record binary, archive string")


def _files(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def _described(headers: dict[str, str], block) -> tuple:
    kind = headers["WARC-Type"]
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    refers = headers.get("WARC-Refers-To")
    size = int(headers["X-Payload-Length"]) if kind == "revisit" else len(block)
    return headers["WARC-Record-ID"][len("<urn:page:") : -1] or None, kind, headers.get("WARC-Target-URI"), digest, size, refers and refers[len("<urn:page:") : -1]


def read_headers(spark, path: str) -> DataFrame:
    """A row per record of all archives below `path`, without payloads; digests of blocks are
    computed anew and must agree with the headers."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.string(), pa.int32()]
        names = [part.split()[0] for part in HEADERS.split(", ")]
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows = []
                for place, (headers, block) in enumerate(parse(unpacked(content.as_py()))):
                    row = _described(headers, block)
                    if row[1] == "response" and payload_digest(bytes(block)) != row[3]:
                        raise ValueError(f"{name}: payload of record {place} does not have its digest")
                    rows.append((*row, name.as_py(), place))
                columns = list(zip(*rows)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return _files(bounded_batches(spark), path).mapInArrow(scan, HEADERS)


def resolve(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """The headers with the type each record has after resolution, and the record it refers to.

    Of records with one payload digest and length the one with the largest numeric id (then the last
    place) is the response. Payloads shorter than `min_bytes` are all responses.
    """
    order = F.struct(F.col("record_id").cast("long").alias("number"), "record_id", "archive", "place")
    originals = headers.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes").agg(F.max(order).alias("original"))
    original = F.col("original.archive").eqNullSafe(F.col("archive")) & F.col("original.place").eqNullSafe(F.col("place"))
    revisit = F.col("original").isNotNull() & ~original
    return headers.drop("record_type", "refers_to").join(originals, ["payload_digest", "payload_bytes"], "left").select(
        "record_id", "url", "payload_digest", "payload_bytes", "archive", "place",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.coalesce("original.record_id", F.lit(""))).alias("refers_to"),
    )


def rewritten(spark, path: str, resolved: DataFrame, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """The records of the archives below `path` with fresh headers, as resolved.

    A file and its decisions meet by the file's name; files are at most ARCHIVE_BYTES large before
    compression, which bounds both.
    """
    decisions = resolved.groupBy("archive").agg(F.collect_list(F.struct("place", "record_type", "refers_to")).alias("decided"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Roll(limit)
        for batch in batches:
            for content, decided in zip(batch.column("content"), batch.column("decided")):
                records, archives = [], []
                by_place = {d["place"]: d for d in decided.as_py()}
                for place, (headers, block) in enumerate(parse(unpacked(content.as_py()))):
                    del headers["Content-Length"]
                    size = len(block)
                    headers["WARC-Type"] = by_place[place]["record_type"]
                    if headers["WARC-Type"] == "revisit":
                        headers |= {"WARC-Profile": REVISIT, "WARC-Refers-To": f"<urn:page:{by_place[place]['refers_to']}>", "X-Payload-Length": str(size)}
                        block = b""
                    records.append(record(headers, bytes(block)))
                    archives.append(roll(len(records[-1])))
                yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary()), pa.array(archives, pa.string())], names=["record", "archive"])

    files = _files(spark, path).withColumnRenamed("path", "archive")
    return files.join(decisions, "archive").select("content", "decided").mapInArrow(rewrite, "record binary, archive string")


def deduplicate(pages: DataFrame, staged: Staged, min_bytes: int = MIN_BYTES, **columns) -> str:
    """Writes an archive of all pages, then the deduplicated one; returns the folder of the latter."""
    raw, final = staged.path("raw"), staged.path("deduplicated")
    write_archives(responses(pages, **columns), raw)
    headers = staged.write(read_headers(pages.sparkSession, raw), "headers")
    resolved = staged.write(resolve(headers, min_bytes), "resolved")
    write_archives(rewritten(pages.sparkSession, raw, resolved), final)
    staged.drop(headers, resolved)
    return final


def op2_warc(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = deduplicate(pages, Staged(spark, "warc"))
    return read_headers(spark, folder).select(
        F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"))
