"""WARC archives written and read by tasks, with payloads as rows of chunks.

Writing: rows are joined with the first page of their payload (groups of copies are found on digests alone,
pre-aggregated before the shuffle), and every task streams its records into gzip members, one for a record,
in slices of `CHUNK_BYTES`.  A file's name holds the task attempt; only files of the attempts that Spark
accepted are listed in the manifest table, so that retried tasks leave no double records.

Reading: every archive of the manifest becomes rows (record_id, chunk_no, data, ...) that carry the digest
and the length of the payload so far; no record is ever held whole.

Defined results: a null html is an empty payload.  All rows that carry the smallest page_id of equal
payloads are responses, the others revisit it; rows without page_id revisit it too, and are responses if no
row of the group has a page_id.  Payloads under `least_bytes` are always responses.  An empty table gives no
archives and no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadweave.llm.scratch import new_folder, small_batches, written

CHUNK_BYTES = 256 * 1024
FILE_BYTES = 256 * 1024 * 1024
BLOCK_BYTES = 256 * 1024
_END = b"\r\n\r\n"
_IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_first_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds `digest` (SHA-1, binary), `first_page` (smallest page_id of equal payloads, null where alone)."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.unhex(F.sha1(payload)).alias("digest"))
    large = rows.where(F.octet_length("html") >= least_bytes) if least_bytes else rows
    first = large.groupBy("digest").agg(F.min("page_id").alias("first_page"), F.count("*").alias("n")).where("n > 1").drop("n")
    # Read back from a written table, both sides of the join are plain shuffles, which AQE can split at a hot digest.
    return rows.join(written(first, "first-pages"), "digest", "left")


def _record(page_id, url, html: memoryview, digest: bytes, first, stamp: str) -> Iterator[bytes]:
    """A record slice by slice."""
    named = "sha1:" + base64.b32encode(digest).decode()
    revisit = first is not None and first != page_id
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        f"WARC-Date: {stamp}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: {named}",
        f"Content-Length: {len(http) + (0 if revisit else len(html))}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {_IDENTICAL}", f"X-Refers-To-Page-Id: {first}"]
    yield "\r\n".join(head).encode() + _END
    yield http
    if not revisit:
        for at in range(0, len(html), CHUNK_BYTES):
            yield html[at : at + CHUNK_BYTES]
    yield _END


def write_archives(rows: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes `with_first_pages` rows to .warc.gz files below a shared folder; returns the written manifest."""

    def run(batches):
        import datetime

        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        task = TaskContext.get()
        stamp = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        out, name, size, records, number, done = None, "", 0, 0, 0, []
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "digest", "first_page")]
            for page_id, url, html, digest, first in zip(*columns, strict=True):
                if out is None:
                    name = f"{at}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{number}.warc.gz"
                    out, number = store.open_output_stream(name, compression=None), number + 1
                member = zlib.compressobj(1, zlib.DEFLATED, 31)
                for piece in _record(page_id.as_py(), url.as_py(), memoryview(html.as_buffer() or b""), digest.as_py(), first.as_py(), stamp):
                    got = member.compress(piece)
                    size += len(got)
                    out.write(got)
                got = member.flush()
                size, records = size + len(got), records + 1
                out.write(got)
                if size >= file_bytes:
                    out.close()
                    done.append((name, records, size))
                    out, size, records = None, 0, 0
        if out is not None:
            out.close()
            done.append((name, records, size))
        yield pa.RecordBatch.from_pydict({"path": pa.array([d[0] for d in done], pa.string()), "records": pa.array([d[1] for d in done], pa.int64()), "bytes": pa.array([d[2] for d in done], pa.int64())})

    return written(rows.select("page_id", "url", "html", "digest", "first_page").mapInArrow(run, "path string, records bigint, bytes bigint"), "manifest")


class _Unzipped:
    """Bytes of concatenated gzip members, as a stream."""

    def __init__(self, stream):
        self.stream, self.member, self.held, self.packed = stream, zlib.decompressobj(31), b"", b""

    def _more(self) -> bool:
        while True:
            if self.member.eof:
                self.packed, self.member = self.member.unused_data, zlib.decompressobj(31)
            elif self.member.unconsumed_tail:
                self.packed = self.member.unconsumed_tail
            else:
                self.packed = b""
            self.packed = self.packed or self.stream.read(BLOCK_BYTES)
            if not self.packed:
                return False
            if got := self.member.decompress(self.packed, CHUNK_BYTES):
                self.held += got
                return True

    def until(self, mark: bytes) -> bytes:
        """Bytes before the next mark, which is passed over; nothing at the end of the stream."""
        while (at := self.held.find(mark)) < 0:
            if not self._more():
                if self.held:
                    raise ValueError("a record is cut short")
                return b""
        got, self.held = self.held[:at], self.held[at + len(mark) :]
        return got

    def take(self, most: int) -> bytes:
        """From 1 to `most` bytes."""
        if not self.held and not self._more():
            raise ValueError("a record is cut short")
        got, self.held = self.held[:most], self.held[most:]
        return got


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


def read_chunks(stream) -> Iterator[dict]:
    """Chunk rows of one archive; the last row of a record is marked and carries the whole digest."""
    source = _Unzipped(stream)
    while head := source.until(_END):
        if not head.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = _fields(head)
        http = source.until(_END)
        left = int(fields["content-length"]) - len(http) - len(_END)
        revisit = fields["warc-type"] == "revisit"
        row = {"record_id": fields["warc-record-id"], "record_type": fields["warc-type"], "target_uri": fields.get("warc-target-uri"), "page_id": int(fields["x-page-id"]) if "x-page-id" in fields else None, "refers_to": int(fields["x-refers-to-page-id"]) if "x-refers-to-page-id" in fields else None, "declared_digest": fields["warc-payload-digest"].removeprefix("sha1:")}
        digest, size, number, held = hashlib.sha1(), 0, 0, bytearray()
        if revisit:  # its payload is elsewhere: the length is that of the HTTP head
            size = int(_fields(http)["content-length"])
        while True:
            while left and len(held) < CHUNK_BYTES:
                got = source.take(min(left, CHUNK_BYTES - len(held)))
                held += got
                left -= len(got)
            data = bytes(held)
            held.clear()
            digest.update(data)
            size += len(data)
            so_far = row["declared_digest"] if revisit else base64.b32encode(digest.digest()).decode()
            yield row | {"chunk_no": number, "data": data, "bytes_so_far": size, "digest_so_far": so_far, "last": not left}
            number += 1
            if not left:
                break
        if source.until(_END):
            raise ValueError("a record is not closed")
        if so_far != row["declared_digest"]:
            raise ValueError(f"{row['record_id']}: payload differs from its digest")


_CHUNK_SCHEMA = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("declared_digest", pa.string()), ("chunk_no", pa.int64()), ("data", pa.binary()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("last", pa.bool_())])
_CHUNK_DDL = "record_id string, record_type string, target_uri string, page_id bigint, refers_to bigint, declared_digest string, chunk_no bigint, data binary, bytes_so_far bigint, digest_so_far string, last boolean"


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """The chunk table of all archives of a manifest; a task reads whole archives, chunk by chunk."""

    def run(batches):
        from pyarrow import fs

        store = fs.FileSystem.from_uri(folder)[0] if "://" in folder or folder.startswith("file:") else fs.LocalFileSystem()
        for batch in batches:
            for path in batch.column("path"):
                held, size = [], 0
                with store.open_input_stream(path.as_py(), compression=None) as stream:
                    for row in read_chunks(stream):
                        held.append(row)
                        size += len(row["data"]) + 300
                        if size >= 4 * CHUNK_BYTES:
                            yield pa.RecordBatch.from_pylist(held, _CHUNK_SCHEMA)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, _CHUNK_SCHEMA)

    spark = manifest.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return manifest.select("path").repartition(tasks).mapInArrow(run, _CHUNK_DDL)


def archive_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """One row per page, from the archives written for them: what the last chunk of each record carries."""
    small_batches(pages.sparkSession)
    folder = new_folder(pages.sparkSession, "warc")
    manifest = write_archives(with_first_pages(pages, least_bytes), folder)
    chunks = read_archives(manifest, folder)
    return chunks.where("last").select("page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to", F.col("chunk_no").alias("last_chunk"))
