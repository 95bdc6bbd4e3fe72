"""RDF/XML files as a data source: spark.read.format("cimxml") and spark.readStream.format("cimxml").

A document is a file, or a member of a (nested) zip archive, whose directory alone is read to list it.  A partition is as many documents, one after the
other, as make up its share of bytes: small ones share a task, which opens their archive once, and a large one has its own.  A task reads a document
in blocks, so that memory does not grow with it.  Files are reached by `pyarrow.fs` (file, hdfs, s3, gs).

Options: path (a file or a folder, searched deeply), shorten (true: references lose their namespace), positions (false; true adds
SOURCE_URI, SOURCE_LINE and SOURCE_BYTE of the element of each fact), and of a stream progress, a folder in a shared store in which lists of the files of
each batch are kept: a file belongs to the batch that saw it first, also when a batch is read again.
"""

from __future__ import annotations

import json
import tempfile
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quadweave.sources.cimxml import parse_stream

_FACTS = "ID string, KEY string, VALUE string, INSTANCE_ID string, _ord bigint"
_PLACES = ", SOURCE_URI string, SOURCE_LINE int, SOURCE_BYTE bigint"
_ENDINGS = (".xml", ".rdf")
#: Bytes of an archive inside an archive that are held in memory; more goes to the task's own temporary file.
HELD = 32 << 20
#: Bytes of documents that a task reads: at least, and at most unless one document has more; between them, a share of all bytes.  Up to SHARES
#: documents have a task each.
LEAST, MOST, SHARES = 1 << 20, 32 << 20, 64
#: Archives whose directories are read at a time.
LISTED = 16


@dataclass
class Document:
    """A file, the members that lead to the document, its place among all documents, and its bytes."""

    uri: str
    members: tuple[str, ...]
    place: int
    size: int = 0

    @property
    def name(self) -> str:
        """As Spark writes paths, so that an instance is called alike by whatever reads it."""
        return "/".join((self.uri.replace("file:///", "file:/", 1), *self.members))


@dataclass
class Documents(InputPartition):
    """Documents that one task reads, in order."""

    documents: list[Document]


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _inner(archive: zipfile.ZipFile, member: str):
    """A member that can be read anywhere, as an archive has to be."""
    held = tempfile.SpooledTemporaryFile(HELD)
    with archive.open(member) as stream:
        while block := stream.read(1 << 20):
            held.write(block)
    held.seek(0)
    return held


def _members(stream, before: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], int]]:
    with zipfile.ZipFile(stream) as archive:
        for info in archive.infolist():
            if info.filename.lower().endswith(_ENDINGS):
                yield (*before, info.filename), info.file_size
            elif info.filename.lower().endswith(".zip"):
                with _inner(archive, info.filename) as inner:
                    yield from _members(inner, (*before, info.filename))


def files_of(path: str, endings: tuple[str, ...] = (*_ENDINGS, ".zip")) -> list[str]:
    """URIs of the files of some endings of a file or folder, in order."""
    store, where = _at(path)
    address = urlsplit(path)
    # Paths of an object store begin with the bucket; those of other stores leave out the host.
    begin = f"{address.scheme}://" if address.scheme not in ("", "file", "hdfs") else f"{address.scheme or 'file'}://{address.netloc}"
    infos = [store.get_file_info(where)]
    if infos[0].type == fs.FileType.Directory:
        infos = store.get_file_info(fs.FileSelector(where, recursive=True))
    kept = [i.path for i in infos if i.type == fs.FileType.File and i.path.lower().endswith(endings)]
    return sorted(f"{begin}{p}" for p in kept if not any(part.startswith(("_", ".")) for part in p[len(where) :].split("/")))


def _listed(uri: str) -> list[tuple[tuple[str, ...], int]]:
    store, where = _at(uri)
    if not uri.lower().endswith(".zip"):
        return [((), store.get_file_info(where).size or 0)]
    with store.open_input_file(where) as stream:
        return list(_members(stream))


def documents(uris: list[str], first: int = 0) -> list[Document]:
    with ThreadPoolExecutor(LISTED) as pool:
        found = [(uri, *of) for uri, inside in zip(uris, pool.map(_listed, uris), strict=True) for of in inside]
    return [Document(uri, members, first + i, size) for i, (uri, members, size) in enumerate(found)]


def shared(found: list[Document]) -> list[Documents]:
    """The documents in runs for a task each; few documents have one each."""
    share = min(MOST, max(LEAST, sum(d.size for d in found) // SHARES)) if len(found) > SHARES else 0
    runs, filled = [], 0
    for d in found:
        if not runs or filled >= share:
            runs.append(Documents([]))
            filled = 0
        runs[-1].documents.append(d)
        filled += d.size
    return runs


def facts(document: Document, shorten: bool, positions: bool) -> Iterator[pa.RecordBatch]:
    """The facts of a document; their order follows the document's place and their own."""
    return facts_of([document], shorten, positions)


def facts_of(run: list[Document], shorten: bool, positions: bool) -> Iterator[pa.RecordBatch]:
    """The facts of documents, one after the other; an archive stays open while its documents follow each other."""
    opened, within = [], None
    try:
        for document in run:
            store, where = _at(document.uri)
            if not document.members:
                with store.open_input_stream(where) as stream:
                    yield from _facts_of(document, stream, shorten, positions)
                continue
            if within != (document.uri, document.members[:-1]):
                _closed(opened)
                within = (document.uri, document.members[:-1])
                opened.append(store.open_input_file(where))
                opened.append(zipfile.ZipFile(opened[-1]))
                for member in document.members[:-1]:
                    opened.append(_inner(opened[-1], member))
                    opened.append(zipfile.ZipFile(opened[-1]))
            with opened[-1].open(document.members[-1]) as stream:
                yield from _facts_of(document, stream, shorten, positions)
    finally:
        _closed(opened)


def _closed(opened: list) -> None:
    while opened:
        opened.pop().close()


def _facts_of(document: Document, stream, shorten: bool, positions: bool) -> Iterator[pa.RecordBatch]:
    at = document.place << 40
    for rows, places in parse_stream(document.name, stream, shorten):
        if not rows:
            continue
        columns = [pa.array(c, pa.string()) for c in zip(*rows, strict=True)] + [pa.array(range(at, at + len(rows)), pa.int64())]
        names = ["ID", "KEY", "VALUE", "INSTANCE_ID", "_ord"]
        if positions:
            lines, offsets = zip(*places, strict=True)
            columns += [pa.array([document.name] * len(rows), pa.string()), pa.array(lines, pa.int32()), pa.array(offsets, pa.int64())]
            names += ["SOURCE_URI", "SOURCE_LINE", "SOURCE_BYTE"]
        at += len(rows)
        yield pa.RecordBatch.from_arrays(columns, names)


class _Reading:
    def __init__(self, options: dict[str, str]):
        flag = lambda name, other: options.get(name, other).lower() == "true"
        self.path, self.progress = options["path"], options.get("progress")
        self.shorten, self.positions = flag("shorten", "true"), flag("positions", "false")

    def read(self, partition: Documents) -> Iterator[pa.RecordBatch]:
        return facts_of(partition.documents, self.shorten, self.positions)


class BatchReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Documents]:
        return shared(documents(files_of(self.path)))


class StreamReader(_Reading, DataSourceStreamReader):
    """Offsets are numbers of lists of files; a list is written once, before its batch begins."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        if not self.progress:
            raise ValueError("a stream of cimxml files needs the option progress, a folder in a shared store")

    def _lists(self) -> dict[int, dict]:
        """Of each list its files, and how many documents came before."""
        store, where = _at(self.progress)
        store.create_dir(where, recursive=True)
        found = {}
        for info in store.get_file_info(fs.FileSelector(where)):
            if info.base_name.isdigit():
                with store.open_input_stream(info.path) as stream:
                    found[int(info.base_name)] = json.loads(stream.readall())
        return found

    def initialOffset(self) -> dict:
        return {"lists": 0}

    def latestOffset(self) -> dict:
        lists = self._lists()
        known = {uri for of in lists.values() for uri in of["files"]}
        new = [uri for uri in files_of(self.path) if uri not in known]
        last = max(lists, default=0)
        if new:
            before = lists[last]["before"] + lists[last]["documents"] if lists else 0
            last += 1
            store, where = _at(self.progress)
            with store.open_output_stream(f"{where}/.{last}") as stream:
                stream.write(json.dumps({"files": new, "before": before, "documents": len(documents(new))}).encode())
            store.move(f"{where}/.{last}", f"{where}/{last}")
        return {"lists": last}

    def partitions(self, start: dict, end: dict) -> list[Documents]:
        lists = self._lists()
        return shared([d for n in range(start["lists"] + 1, end["lists"] + 1) for d in documents(lists[n]["files"], lists[n]["before"])])

    def commit(self, end: dict) -> None:
        pass


class CimXml(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cimxml"

    def schema(self) -> str:
        return _FACTS + (_PLACES if self.options.get("positions", "false").lower() == "true" else "")

    def reader(self, schema) -> BatchReader:
        return BatchReader(dict(self.options))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(dict(self.options))


def registered(spark: SparkSession) -> SparkSession:
    """The session, in which "cimxml" is a format from now on."""
    spark.dataSource.register(CimXml)
    return spark


def places(violations: DataFrame, scan: DataFrame) -> DataFrame:
    """Violations with SOURCE_URI, SOURCE_LINE and SOURCE_BYTE of the first fact of their ID and KEY, or else of the object itself.

    scan: facts read with positions.  A value that violates is looked up by itself before its property is."""
    from quadweave.model import TYPE

    wanted = scan.where(F.col("SOURCE_LINE").isNotNull()).join(violations.select("ID").distinct(), "ID", "left_semi")
    place = F.struct("SOURCE_URI", "SOURCE_LINE", "SOURCE_BYTE")
    of_value = wanted.groupBy("ID", "KEY", "VALUE").agg(F.min_by(place, "_ord").alias("__value"))
    of_key = wanted.groupBy("ID", "KEY").agg(F.min_by(place, "_ord").alias("__key"))
    of_object = wanted.where(F.col("KEY") == TYPE).groupBy("ID").agg(F.min_by(place, "_ord").alias("__object"))
    found = violations.join(of_value, ["ID", "KEY", "VALUE"], "left").join(of_key, ["ID", "KEY"], "left").join(of_object, "ID", "left")
    best = F.coalesce("__value", "__key", "__object")
    return found.select(*violations.columns, best["SOURCE_URI"].alias("SOURCE_URI"), best["SOURCE_LINE"].alias("SOURCE_LINE"), best["SOURCE_BYTE"].alias("SOURCE_BYTE"))
