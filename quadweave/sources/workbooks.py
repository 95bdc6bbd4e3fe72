"""Sheets of workbooks, and CSV tables in archives, as a data source: spark.read.format("sheets").

A partition is a sheet of a workbook, or of very many some that follow each other, or a CSV member of an archive; it is read row by row.  A workbook's
directory and shared texts are read once by each task that reads sheets of it, and held.  The first row names columns; every further cell that is not empty is a row (SHEET, ROW, ID, KEY, VALUE, _ord), ID being the cell in the
column of that name.  Cells may be left out (their references tell), columns without a name are left out, and numbers stay as they are written.

Options: path (files or a folder of .xlsx, .csv and .zip, the latter with workbooks or CSV inside).
"""

from __future__ import annotations

import csv
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quadweave.model import ORDER, TYPE
from quadweave.sources.cimxml import BLOCK, _no_entities
from quadweave.sources.xmlfiles import _at, _inner, files_of

# Names of the workbook format.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
BATCH = 20_000
#: Tasks that sheets of a workbook are dealt to, at most: each reads its directory, which grows with the sheets.
MOST_TASKS = 256


@dataclass
class Sheet(InputPartition):
    """A sheet `part` of the workbook behind `members`, or a CSV table (no part)."""

    uri: str
    members: tuple[str, ...]
    name: str
    part: str
    place: int


@dataclass
class Together(InputPartition):
    """Sheets of one workbook, or one CSV table."""

    sheets: list[Sheet]


def _elements(stream, start=None, end=None, data=None) -> Iterator[None]:
    """Walks over a document, giving way after every block."""
    parser = expat.ParserCreate(namespace_separator=" ")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    parser.EntityDeclHandler = _no_entities
    while block := stream.read(BLOCK):
        parser.Parse(block, False)
        yield
    parser.Parse(b"", True)
    yield


def _attributes(archive: zipfile.ZipFile, part: str, element: str) -> list[dict]:
    found: list[dict] = []
    with archive.open(part) as stream:
        for _ in _elements(stream, start=lambda name, a: found.append(a) if name == element else None):
            pass
    return found


def _sheets_of(archive: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of the sheets of a workbook."""
    (main,) = [a["Target"] for a in _attributes(archive, "_rels/.rels", f"{_PACKAGE} Relationship") if a["Type"].endswith("/officeDocument")]
    main = main.lstrip("/")
    folder, file = posixpath.split(main)
    targets = {a["Id"]: a["Target"] for a in _attributes(archive, f"{folder}/_rels/{file}.rels", f"{_PACKAGE} Relationship")}
    path = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(posixpath.join(folder, t))
    return [(a["name"], path(targets[a[f"{_REL} id"]])) for a in _attributes(archive, main, f"{_MAIN} sheet")]


def _shared_texts(archive: zipfile.ZipFile) -> list[str]:
    """Texts that cells refer to by number; of phonetic hints only the text itself counts."""
    texts: list[str] = []
    state = {"open": False, "hint": 0}

    def start(name, _):
        if name == f"{_MAIN} si":
            texts.append("")
        elif name == f"{_MAIN} rPh":
            state["hint"] += 1
        state["open"] = name == f"{_MAIN} t"

    def end(name):
        if name == f"{_MAIN} rPh":
            state["hint"] -= 1
        state["open"] = False

    def data(text):
        if state["open"] and not state["hint"]:
            texts[-1] += text

    part = next((n for n in archive.namelist() if n.lower().endswith("sharedstrings.xml")), None)
    if part is not None:
        with archive.open(part) as stream:
            for _ in _elements(stream, start, end, data):
                pass
    return texts


def column_number(reference: str) -> int:
    """The column of a cell such as AB12, from 0."""
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - ord("A") + 1
    return n - 1


def _rows_of_sheet(archive: zipfile.ZipFile, part: str, shared: list[str]) -> Iterator[dict[int, str]]:
    """The cells of each row by column; shared: texts that cells refer to."""
    done, row, cell = [], {}, {}

    def start(name, a):
        if name == f"{_MAIN} row":
            row.clear()
            cell["next"] = 0
        elif name == f"{_MAIN} c":
            cell["at"] = column_number(a["r"]) if "r" in a else cell["next"]
            cell["next"], cell["kind"], cell["text"], cell["open"] = cell["at"] + 1, a.get("t", "n"), None, False
        elif name in (f"{_MAIN} v", f"{_MAIN} t"):
            cell["open"] = True

    def data(text):
        if cell.get("open"):
            cell["text"] = text if cell["text"] is None else cell["text"] + text

    def end(name):
        cell["open"] = False
        if name == f"{_MAIN} row":
            done.append(dict(row))
        elif name == f"{_MAIN} c" and cell["text"] is not None:
            text = cell["text"]
            row[cell["at"]] = shared[int(text)] if cell["kind"] == "s" else ("true" if text == "1" else "false") if cell["kind"] == "b" else text

    with archive.open(part) as stream:
        for _ in _elements(stream, start, end, data):
            yield from done
            done.clear()


def _cells(rows: Iterator[dict[int, str]], sheet: Sheet) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    names: dict[int, str] | None = None
    at = sheet.place << 40
    for number, row in enumerate(rows, 1):
        if names is None:
            names = {i: text for i, text in row.items() if text}
            continue
        ID = next((row.get(i) for i, name in names.items() if name == "ID"), None)
        for i, text in sorted(row.items()):
            if i in names and names[i] != "ID" and text != "":
                held.append((sheet.name, number, ID, names[i], text, at + len(held)))
        if len(held) >= BATCH:
            yield _batch(held)
            at, held = at + len(held), []
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["SHEET", "ROW", "ID", "KEY", "VALUE", ORDER])


def _stem(path: str) -> str:
    return posixpath.splitext(posixpath.basename(path))[0]


class Sheets(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sheets"

    def schema(self) -> str:
        return f"SHEET string, ROW int, ID string, KEY string, VALUE string, {ORDER} bigint"

    def reader(self, schema) -> SheetReader:
        return SheetReader(self.options["path"])


class SheetReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def _inside(self, uri: str, stream, members: tuple[str, ...] = ()) -> Iterator[tuple[str, tuple[str, ...], str, str]]:
        with zipfile.ZipFile(stream) as archive:
            if "[Content_Types].xml" in archive.namelist():
                yield from ((uri, members, name, part) for name, part in _sheets_of(archive))
                return
            for member in archive.namelist():
                if member.lower().endswith(".csv"):
                    yield uri, (*members, member), _stem(member), ""
                elif member.lower().endswith((".xlsx", ".zip")):
                    with _inner(archive, member) as inner:
                        yield from self._inside(uri, inner, (*members, member))

    def partitions(self) -> list[Together]:
        found: list[tuple] = []
        for uri in files_of(self.path, (".xlsx", ".csv", ".zip")):
            if uri.lower().endswith(".csv"):
                found.append((uri, (), _stem(uri), ""))
            else:
                store, where = _at(uri)
                with store.open_input_file(where) as stream:
                    found += self._inside(uri, stream)
        out: list[Together] = []
        for _, several in groupby(enumerate(found), key=lambda f: (*f[1][:2], -1 if f[1][3] else f[0])):  # sheets of one workbook
            sheets = [Sheet(*f, place) for place, f in several]
            each = -(-len(sheets) // MOST_TASKS)
            out += [Together(sheets[i : i + each]) for i in range(0, len(sheets), each)]
        return out

    def read(self, together: Together) -> Iterator[pa.RecordBatch]:
        first = together.sheets[0]
        store, where = _at(first.uri)
        opened = [store.open_input_file(where)]
        try:
            for i, member in enumerate(first.members):
                archive = zipfile.ZipFile(opened[-1])
                last = not first.part and i == len(first.members) - 1
                opened += [archive, archive.open(member) if last else _inner(archive, member)]
            if first.part:
                opened.append(zipfile.ZipFile(opened[-1]))
                shared = _shared_texts(opened[-1])
                for sheet in together.sheets:
                    yield from _cells(_rows_of_sheet(opened[-1], sheet.part, shared), sheet)
            else:
                text = io.TextIOWrapper(opened[-1], "utf-8-sig", newline="")
                yield from _cells(({i: v for i, v in enumerate(row) if v != ""} for row in csv.reader(text)), first)
        finally:
            for stream in reversed(opened):
                stream.close()


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(Sheets)
    return spark


def read_sheets(spark: SparkSession, path: str, sheets: list[str] | None = None, facts_sheet: str | None = None, instance_id: str | None = None, multivalue: bool = True) -> DataFrame:
    """The graph table of sheets: a class for each, called like it, where a row has no Type; of `facts_sheet` the rows are facts themselves.

    Cells like ['a', 'b'] are a fact for each value, unless multivalue is false.  Rows without ID are left out."""
    cells = registered(spark).read.format("sheets").load(path)
    of = F.lit(instance_id).cast("string")
    views = cells if facts_sheet is None else cells.where(F.col("SHEET") != facts_sheet)
    views = views if sheets is None else views.where(F.col("SHEET").isin(list(sheets)))
    views = views.where(F.col("ID").isNotNull())
    texts = F.array(F.col("VALUE"))
    if multivalue:
        texts = F.when(F.col("VALUE").rlike(r"^\[\s*'[\s\S]*'\s*\]\z"), F.split(F.regexp_replace("VALUE", r"^\[\s*'|'\s*\]\z", ""), r"'\s*,\s*'")).otherwise(texts)
    rows = views.select("ID", "KEY", F.explode(texts).alias("VALUE"), of.alias("INSTANCE_ID"), ORDER)
    typed = views.groupBy("SHEET", "ROW").agg(F.first("ID").alias("ID"), F.min(ORDER).alias(ORDER), F.max(F.col("KEY") == TYPE).alias("typed")).where("not typed")
    rows = rows.unionByName(typed.select("ID", F.lit(TYPE).alias("KEY"), F.col("SHEET").alias("VALUE"), of.alias("INSTANCE_ID"), ORDER))
    if facts_sheet is not None:
        pick = lambda key: F.max(F.when(F.col("KEY") == key, F.col("VALUE"))).alias(key)
        own = cells.where(F.col("SHEET") == facts_sheet).groupBy("SHEET", "ROW").agg(F.first("ID").alias("ID"), pick("KEY"), pick("VALUE"), pick("INSTANCE_ID"), F.min(ORDER).alias(ORDER))
        rows = rows.unionByName(own.where("ID is not null and KEY is not null").select("ID", "KEY", "VALUE", F.coalesce("INSTANCE_ID", of).alias("INSTANCE_ID"), ORDER))
    return rows
