"""RDF/XML documents written by a data source with a commit: what failed or repeated attempts wrote is never seen.

Packagings: "xml" (a file for each document), "zip_each" (an archive for each) and "zip_all" (one archive).  Tasks stream their documents, as they
come, into files of their attempt below `_attempts`; the commit renames those of accepted attempts and removes the rest.  For "zip_all" tasks
write compressed members, and one further task joins them as they are, with headers and directory: one file has one writer, but nothing
is compressed again and no document is held.  Files are reached by `pyarrow.fs` (file, hdfs, s3, gs).
"""

from __future__ import annotations

import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass, field
from xml.sax.saxutils import quoteattr

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from quadweave.model import ORDER
from quadweave.sinks.files import RDF, cimxml_objects
from quadweave.sources.xmlfiles import _at
from quadweave.steps import written

PACKAGINGS = ("xml", "zip_each", "zip_all")
MANIFEST = "_members.json"
BLOCK = 1 << 20


class _Member:
    """A raw deflate stream with what a zip directory says of it."""

    def __init__(self, stream):
        self.stream, self.packer = stream, zlib.compressobj(6, zlib.DEFLATED, -15)
        self.crc = self.size = self.packed = 0

    def _out(self, data: bytes) -> None:
        self.packed += len(data)
        self.stream.write(data)

    def write(self, data: bytes) -> None:
        self.crc, self.size = zlib.crc32(data, self.crc), self.size + len(data)
        self._out(self.packer.compress(data))

    def close(self) -> None:
        self._out(self.packer.flush())
        self.stream.close()


@dataclass
class Written(WriterCommitMessage):
    """Files of one attempt: (document, file, crc, size, packed size)."""

    attempt: str
    files: list[tuple[str, str, int, int, int]] = field(default_factory=list)


class DocumentWriter(DataSourceArrowWriter):
    """Rows (document, xml) in the order in which they are to stand; a document's rows come together."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.packaging, self.overwrite = options["path"], options.get("packaging", "xml"), overwrite
        if self.packaging not in PACKAGINGS:
            raise ValueError(f"packaging is one of {', '.join(PACKAGINGS)}")
        self.job = uuid.uuid4().hex

    def _attempts(self) -> tuple[fs.FileSystem, str, str]:
        store, where = _at(self.path)
        return store, where, f"{where}/_attempts/{self.job}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, _, attempts = self._attempts()
        done = Written(uuid.uuid4().hex)
        folder = f"{attempts}/{done.attempt}"
        current, closing = None, None

        def opened(name: str, number: int):
            file = f"{folder}/{number}"
            store.create_dir(folder, recursive=True)
            stream = store.open_output_stream(file, compression=None)
            if self.packaging == "zip_all":
                member = _Member(stream)

                def close():
                    member.close()
                    done.files.append((name, file, member.crc, member.size, member.packed))

                return member.write, close
            archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED) if self.packaging == "zip_each" else None
            inner = archive.open(name, "w", force_zip64=True) if archive else stream

            def finish():
                for part in [inner, *([archive, stream] if archive else [])]:
                    part.close()
                done.files.append((name, file, 0, 0, 0))

            return inner.write, finish

        for batch in batches:
            for name, xml in zip(batch.column("document").to_pylist(), batch.column("xml").to_pylist(), strict=True):
                if name != current:
                    if closing:
                        closing()
                    current = name
                    put, closing = opened(name, len(done.files))
                put(xml.encode() + b"\n")
        if closing:
            closing()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        store, where, attempts = self._attempts()
        files = [f for m in messages if m is not None for f in m.files]
        if len({f[0] for f in files}) < len(files):
            raise ValueError("a document was written by two tasks; bring its rows together first")
        store.create_dir(where, recursive=True)
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(where)):
                if info.type == fs.FileType.File:
                    store.delete_file(info.path)
        if self.packaging == "zip_all":
            store.create_dir(f"{where}/_parts", recursive=True)
            for i, f in enumerate(sorted(files)):
                store.move(f[1], f"{where}/_parts/{i}")
            with store.open_output_stream(f"{where}/_parts/{MANIFEST}") as stream:
                stream.write(json.dumps([(f[0], i, *f[2:]) for i, f in enumerate(sorted(files))]).encode())
        else:
            for name, file, *_ in files:
                store.move(file, f"{where}/{name if self.packaging == 'xml' else name.removesuffix('.xml') + '.zip'}")
        self._gone(store, where, attempts)

    def abort(self, messages: list[Written | None]) -> None:
        self._gone(*self._attempts())

    @staticmethod
    def _gone(store, where: str, attempts: str) -> None:
        with suppress(OSError):
            store.delete_dir(attempts)
        with suppress(OSError):
            if not store.get_file_info(fs.FileSelector(f"{where}/_attempts")):
                store.delete_dir(f"{where}/_attempts")


class XmlDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xmldocuments"

    def schema(self) -> str:
        return "document string, xml string"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(dict(self.options), overwrite)


def _header(signature: bytes, name: bytes, crc: int, size: int, packed: int, at: int | None = None) -> bytes:
    """A local header, or with `at` an entry of the directory; large numbers go to the extra field for 64 bits."""
    top = 0xFFFFFFFF
    large = [n for n in (size, packed, *([at] if at is not None else [])) if n >= top]
    extra = struct.pack(f"<HH{len(large)}Q", 1, 8 * len(large), *large) if large else b""
    low = lambda n: min(n, top)
    both = struct.pack("<HHHHHIIIHH", 45, 0x800, 8, 0, 0x21, crc, low(packed), low(size), len(name), len(extra))
    if at is None:
        return signature + both + name + extra
    return signature + struct.pack("<H", 45) + both + struct.pack("<HHHII", 0, 0, 0, 0, low(at)) + name + extra


def join_members(path: str, target: str) -> int:
    """Joins compressed members into one archive, block by block; returns their number."""
    store, where = _at(path)
    with store.open_input_stream(f"{where}/_parts/{MANIFEST}") as stream:
        members = json.loads(stream.readall())
    directory, at = [], 0
    # Written aside; if this task is done again, the parts are still there.
    with store.open_output_stream(f"{where}/_parts/archive", compression=None) as out:
        for name, part, crc, size, packed in members:
            header = _header(b"PK\x03\x04", name.encode(), crc, size, packed)
            directory.append(_header(b"PK\x01\x02", name.encode(), crc, size, packed, at))
            out.write(header)
            with store.open_input_stream(f"{where}/_parts/{part}", compression=None) as stream:
                while block := stream.read(BLOCK):
                    out.write(block)
            at += len(header) + packed
        length = 0
        for entry in directory:
            out.write(entry)
            length += len(entry)
        n = len(members)
        if n >= 0xFFFF or at >= 0xFFFFFFFF or length >= 0xFFFFFFFF:
            out.write(b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, length, at))
            out.write(b"PK\x06\x07" + struct.pack("<IQI", 0, at + length, 1))
        out.write(b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(length, 0xFFFFFFFF), min(at, 0xFFFFFFFF), 0))
    store.move(f"{where}/_parts/archive", f"{where}/{target}")
    store.delete_dir(f"{where}/_parts")
    return n


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(XmlDocuments)
    return spark


def write_documents(data: DataFrame, folder: str, namespaces: dict[str, str], packaging: str = "xml", references: list[str] | None = None, prefix: str = "cim", objects_per_file: int = 500_000, archive: str = "all.zip", overwrite: bool = False) -> None:
    """The instances of a graph table as documents of at most `objects_per_file` objects, called by their label, or else by the instance."""
    spark = registered(data.sparkSession)
    objects = written(cimxml_objects(data, references, prefix), "objects")  # counted, dealt and asked for their documents
    # Labels alone are looked at: a first text by order sorts all rows that it is taken from.
    names = data.where((F.col("KEY") == "label") & F.col("VALUE").isNotNull()).groupBy("INSTANCE_ID").agg(F.min_by("VALUE", ORDER).alias("label"))
    counts = objects.groupBy("INSTANCE_ID").agg(F.ceil(F.count("*") / objects_per_file).cast("int").alias("files")).join(names, "INSTANCE_ID", "left")
    # Instances that share a label keep apart by their ID.
    counts = counts.withColumn("alike", F.count("label").over(Window.partitionBy("label")))
    stem = F.when(F.col("label").isNull(), F.col("INSTANCE_ID")).when(F.col("alike") > 1, F.concat_ws("-", F.regexp_replace("label", r"\.xml\z", ""), "INSTANCE_ID")).otherwise(F.regexp_replace("label", r"\.xml\z", ""))
    dealt = objects.join(counts.withColumn("stem", F.regexp_replace(stem, r"[/\\:]", "_")), "INSTANCE_ID").withColumn("file", F.pmod(F.xxhash64("ID"), F.col("files")).cast("int"))
    dealt = dealt.withColumn("document", F.concat("stem", F.when(F.col("files") > 1, F.concat(F.lit("-"), F.col("file").cast("string"))).otherwise(""), F.lit(".xml")))
    spaces = " ".join(f"xmlns:{p}={quoteattr(u)}" for p, u in ({"rdf": RDF} | namespaces).items())
    head, foot = f'<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF {spaces}>', "</rdf:RDF>"
    ends = dealt.select("document").distinct().select("document", F.inline(F.array(F.struct(F.lit(-(1 << 62)).alias("place"), F.lit(head).alias("xml")), F.struct(F.lit(1 << 62).alias("place"), F.lit(foot).alias("xml")))))
    rows = dealt.select("document", "place", "xml").unionByName(ends).repartition("document").sortWithinPartitions("document", "place", "xml")
    rows.select("document", "xml").write.format("xmldocuments").mode("overwrite" if overwrite else "append").option("path", folder).option("packaging", packaging).save()
    if packaging == "zip_all":
        _joined(spark, folder, archive)


def _joined(spark: SparkSession, folder: str, archive: str) -> None:
    def run(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([join_members(folder, archive)], pa.int64())], ["members"])

    spark.range(1, numPartitions=1).mapInArrow(run, "members bigint").collect()  # a retried task does it anew


def write_archive(rows: DataFrame, folder: str, archive: str) -> None:
    """One archive of documents, of rows (document, xml) that come together and in order; other files of the folder stay."""
    spark = registered(rows.sparkSession)
    rows.write.format("xmldocuments").mode("append").option("path", folder).option("packaging", "zip_all").save()
    _joined(spark, folder, archive)
