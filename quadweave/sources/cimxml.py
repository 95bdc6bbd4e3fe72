"""RDF/XML power-grid files, plain or in (nested) zip archives.

Files are listed and read by Spark (any store that it reads), one or more in a task; a streaming parser gives
a fact for every element.  Object order within a file is kept in `_ord`; files are ordered by path.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from typing import IO
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Names of the RDF vocabulary and the prefixes that IDs lose, in this order.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XML = "http://www.w3.org/XML/1998/namespace"
ID_PREFIXES = ("urn:uuid:", "#_", "_")
BATCH = 20_000
#: Bytes that the XML parser takes at a time.
BLOCK = 1 << 20


def clean_id(value: str | None) -> str:
    value = value or ""
    for prefix in ID_PREFIXES:
        value = value.removeprefix(prefix)
    return value


def local_name(name: str) -> str:
    """The part behind a namespace or a prefix."""
    return name.rpartition(" ")[2].rpartition("}")[2].rpartition(":")[2] if " " not in name else name.rpartition(" ")[2]


def members(name: str, content: bytes) -> Iterator[tuple[str, bytes]]:
    """XML files of a file; archives are opened, also those inside archives."""
    lower = name.lower()
    if lower.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for inner in archive.namelist():
                if inner.lower().endswith((".xml", ".rdf", ".zip")):
                    yield from members(f"{name}/{inner}", archive.read(inner))
    elif lower.endswith((".xml", ".rdf")):
        yield name, content


def streams(name: str, stream) -> Iterator[tuple[str, IO[bytes]]]:
    """XML files of an open file, as streams; of an archive one member is open at a time, and archives inside it are held."""
    lower = name.lower()
    if lower.endswith(".zip"):
        with zipfile.ZipFile(stream) as archive:
            for inner in archive.namelist():
                if inner.lower().endswith(".zip"):
                    yield from streams(f"{name}/{inner}", io.BytesIO(archive.read(inner)))
                elif inner.lower().endswith((".xml", ".rdf")):
                    with archive.open(inner) as opened:
                        yield f"{name}/{inner}", opened
    elif lower.endswith((".xml", ".rdf")):
        yield name, stream


class _Facts:
    """Collects facts while expat walks a document: objects at depth 1, properties at depth 2."""

    def __init__(self, name: str, instance: str, shorten: bool):
        self.rows: list[tuple[str, str, str, str]] = []
        self.places: list[tuple[int | None, int | None]] = []  # line and byte of each fact's element
        self.parser, self.at = None, (None, None)
        self.instance, self.shorten = instance, shorten
        self.depth, self.object, self.namespaces, self.text = 0, "", {}, None
        self.name, self.attributes, self.begun = name, {}, False

    def meta(self, root: dict) -> None:
        of = lambda kind: str(uuid.uuid5(uuid.NAMESPACE_URL, f"{self.instance}#{kind}"))
        label, space = of("Distribution"), of("NamespaceMap")
        self.add(label, "Type", "Distribution")
        self.add(label, "label", self.name.rpartition("/")[2])
        self.add(space, "Type", "NamespaceMap")
        for prefix, uri in self.namespaces.items():
            self.add(space, prefix or "", uri)
        if f"{XML} base" in root:
            self.add(space, "xml_base", root[f"{XML} base"])

    def add(self, ID: str, key: str, value: str) -> None:
        self.rows.append((ID, key, value, self.instance))
        self.places.append(self.at)

    def namespace(self, prefix, uri) -> None:
        if self.depth == 0:
            self.namespaces[prefix] = uri

    def here(self) -> None:
        self.at = (self.parser.CurrentLineNumber, self.parser.CurrentByteIndex)

    def start(self, name: str, attributes: dict) -> None:
        if self.depth == 0:
            self.meta(attributes)
        elif self.depth == 1:
            self.here()
            self.object = clean_id(attributes.get(f"{RDF} ID") or attributes.get(f"{RDF} about") or attributes.get(f"{RDF} nodeID"))
            self.add(self.object, "Type", local_name(name))
        elif self.depth == 2:
            self.text, self.attributes = None, attributes
            self.here()
        self.depth += 1

    def data(self, text: str) -> None:
        if self.depth == 3:
            self.text = text if self.text is None else self.text + text

    def end(self, name: str) -> None:
        self.depth -= 1
        if self.depth != 2:
            return
        value = self.text
        if value is None and self.attributes:
            value = clean_id(self.attributes.get(f"{RDF} resource") or self.attributes.get(f"{RDF} nodeID"))
            if self.shorten and value.startswith("http") and "#" in value:
                value = value.rpartition("#")[2]
        self.add(self.object, local_name(name), value or "")


def _no_entities(*_):
    raise ValueError("entity declarations are not accepted")


def parse_stream(name: str, stream, shorten: bool = True) -> Iterator[tuple[list[tuple[str, str, str, str]], list[tuple[int | None, int | None]]]]:
    """Facts of one document and where they stand (line, byte), some at a time, from anything with read(); a block of bytes is held.

    The instance follows from the name, so that a retried task gives the same."""
    facts = _Facts(name, str(uuid.uuid5(uuid.NAMESPACE_URL, name)), shorten)
    parser = facts.parser = expat.ParserCreate(namespace_separator=" ")
    parser.buffer_text = True
    parser.StartNamespaceDeclHandler = facts.namespace
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = facts.start, facts.end, facts.data
    parser.EntityDeclHandler = _no_entities
    while block := stream.read(BLOCK):
        parser.Parse(block, False)
        if len(facts.rows) >= BATCH:
            yield facts.rows, facts.places
            facts.rows, facts.places = [], []
    parser.Parse(b"", True)
    yield facts.rows, facts.places


def parse(name: str, content: bytes, shorten: bool = True) -> Iterator[list[tuple[str, str, str, str]]]:
    """Facts of one document that is held whole, some at a time."""
    for rows, _ in parse_stream(name, io.BytesIO(content), shorten):
        yield rows


def read_cimxml(spark: SparkSession, paths, shorten_resources: bool = True) -> DataFrame:
    """The graph table of some files or folders; `_ord` follows the files by their paths, and the places in each.

    Facts are given out while a document is read; the bytes of a file (2 GB at most, Spark's limit) are held whole, once.  `sources/xmlfiles` reads
    files of any size in blocks, from stores that pyarrow reaches."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    listed = sorted(r["path"] for r in files.select("path").collect())  # Spark's own listing is on the driver as well
    places = spark.sparkContext.broadcast({path: i for i, path in enumerate(listed)})

    def run(batches):
        names = ["ID", "KEY", "VALUE", "INSTANCE_ID"]
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                at = places.value[path.as_py()] << 40
                for name, document in streams(path.as_py(), pa.BufferReader(content.as_buffer())):
                    for part, _ in parse_stream(name, document, shorten_resources):
                        if part:
                            columns = [pa.array(c, pa.string()) for c in zip(*part, strict=True)]
                            yield pa.RecordBatch.from_arrays([*columns, pa.array(range(at, at + len(part)), pa.int64())], [*names, "_ord"])
                            at += len(part)

    return files.select("path", "content").mapInArrow(run, "ID string, KEY string, VALUE string, INSTANCE_ID string, _ord bigint")


_OBJECT = re.compile(rb"<[\w:.-]+\s[^>]*?rdf:(?:ID|about|nodeID)\s*=\s*[\"']([^\"']*)[\"']")


def _lines(name: str, document: bytes | memoryview) -> Iterator[pa.RecordBatch]:
    """Where objects begin in a document that is held once, some at a time."""
    rows, line, at = [], 1, 0
    for m in _OBJECT.finditer(document):
        line, at = line + bytes(document[at : m.start()]).count(b"\n"), m.start()
        snippet = bytes(document[m.start() : m.start() + 120]).split(b"\n")[0].decode(errors="replace")
        rows.append((name, clean_id(bytes(m[1]).decode()), line, snippet))
        if len(rows) == BATCH:
            yield _batch(rows)
            rows = []
    yield _batch(rows)


def _batch(rows: list[tuple[str, str, int, str]]) -> pa.RecordBatch:
    kinds = {"SOURCE_URI": pa.string(), "ID": pa.string(), "SOURCE_LINE": pa.int32(), "SOURCE_SNIPPET": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], list(kinds))


def object_lines(spark: SparkSession, paths) -> DataFrame:
    """(SOURCE_URI, ID, SOURCE_LINE, SOURCE_SNIPPET): where objects begin in their files; join violations on ID."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                if path.as_py().lower().endswith(".zip"):
                    found = members(path.as_py(), content.as_py())
                else:
                    found = [(path.as_py(), memoryview(content.as_buffer()))] if path.as_py().lower().endswith((".xml", ".rdf")) else []
                for name, document in found:
                    yield from _lines(name, document)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "content")
    return files.mapInArrow(run, "SOURCE_URI string, ID string, SOURCE_LINE int, SOURCE_SNIPPET string")
