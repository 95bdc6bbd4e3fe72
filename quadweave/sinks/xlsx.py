"""Workbooks with a sheet for each class.

Rows become XML as columns; each sheet is streamed into a compressed part by a task of the committing writer (`xmlfiles`), and the parts are
joined into one file as they are.  A sheet holds 1,048,575 rows at most: larger views go on in further sheets.
"""

from __future__ import annotations

import os
import posixpath
from functools import reduce
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadweave.model import quoted
from quadweave.sinks.files import _xml_text
from quadweave.sinks.xmlfiles import write_archive
from quadweave.steps import written

MOST_ROWS = 1_048_575  # what a sheet can hold below its head
MOST_CHARS = 32_767  # what a cell can hold
# Names of the workbook format.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"


def _cell(view: DataFrame, name: str) -> Column:
    value, kind = quoted(name), dict(view.dtypes)[name]
    if kind in ("int", "bigint", "smallint", "tinyint", "double", "float") or kind.startswith("decimal"):
        return F.when(value.isNull() | F.isnan(value.cast("double")), F.lit("<c/>")).otherwise(F.concat(F.lit("<c><v>"), value.cast("string"), F.lit("</v></c>")))
    text = F.regexp_replace(value.cast("string"), r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]", "")
    text = F.when(F.length(text) > MOST_CHARS, F.raise_error(F.lit(f"a cell of {name.replace('%', '')} holds no more than {MOST_CHARS} characters; write CSV instead"))).otherwise(text)
    return F.when(value.isNull(), F.lit("<c/>")).otherwise(F.concat(F.lit('<c t="inlineStr"><is><t xml:space="preserve">'), _xml_text(text), F.lit("</t></is></c>")))


def _names(names: list[str]) -> list[str]:
    """Sheets' names: 31 characters at most, without some, and no two alike."""
    out: list[str] = []
    used: set[str] = set()
    numbers: dict[str, int] = {}  # of each stem the last number: smaller ones are taken
    for name in names:
        stem = "".join("_" if c in "[]:*?/\\" else c for c in name)[:31] or "_"
        n = numbers.get(stem, 1)
        found = stem
        while found.lower() in used:
            n += 1
            found = f"{stem[: 28 - len(str(n))]} ({n})"
        numbers[stem] = n
        used.add(found.lower())
        out.append(found)
    return out


def write_workbook(views: dict[str, DataFrame], path: str, width: int = 38, most_rows: int = MOST_ROWS) -> None:
    """Writes the views as one workbook; rows stand in the order of their first column."""
    if not views:
        raise ValueError("a workbook has one sheet at least")
    sizes = {r["name"]: r["count"] for r in reduce(DataFrame.unionByName, (v.select(F.lit(n).alias("name")) for n, v in views.items())).groupBy("name").count().collect()}  # a row a view
    sheets = [(name, k) for name in views for k in range(max(1, -(-sizes.get(name, 0) // most_rows)))]
    names, place = _names([name for name, _ in sheets]), {s: i for i, s in enumerate(sheets, 1)}
    struct = lambda at, key, xml: F.struct(F.lit(at).alias("at"), F.lit(key).alias("key"), F.lit(xml).alias("xml"))
    parts = []
    for name, view in views.items():
        several = sizes.get(name, 0) > most_rows
        document = lambda k: F.concat(F.lit("xl/worksheets/sheet"), (k + place[name, 0]).cast("string"), F.lit(".xml"))  # noqa: B023, E731
        rows = view.select(quoted(view.columns[0]).cast("string").alias("key"), F.concat(F.lit("<row>"), *(_cell(view, c) for c in view.columns), F.lit("</row>")).alias("xml"))
        if several:  # rows are dealt by their rank; ranks of ranges, not of one window over all
            rows = _ranked(rows).select("key", "xml", F.floor(F.col("rank") / most_rows).cast("int").alias("k"))
        else:
            rows = rows.withColumn("k", F.lit(0))
        parts.append(rows.select(document(F.col("k")).alias("document"), F.lit(1).alias("at"), "key", "xml"))
        columns = "".join(f'<c t="inlineStr"><is><t>{escape(c)}</t></is></c>' for c in view.columns)
        head = f'<worksheet xmlns="{_MAIN}"><sheetViews><sheetView workbookViewId="0"><pane xSplit="1" ySplit="1" topLeftCell="B2" state="frozen"/></sheetView></sheetViews><cols><col min="1" max="{len(view.columns)}" width="{width}" customWidth="1"/></cols><sheetData><row>{columns}</row>'
        ends = view.sparkSession.range(len([s for s in sheets if s[0] == name])).select(document(F.col("id")).alias("document"), F.inline(F.array(struct(0, "", head), struct(2, "", "</sheetData></worksheet>"))))
        parts.append(ends)
    spark = next(iter(views.values())).sparkSession
    listed = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1))
    links = "".join(f'<Relationship Id="r{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
    kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
    fixed = {
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{listed}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships">{links}</Relationships>',
        "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>',
    }
    parts.append(spark.createDataFrame([(n, 0, "", x) for n, x in fixed.items()], "document string, at int, key string, xml string"))
    every = reduce(DataFrame.unionByName, parts).repartition("document").sortWithinPartitions("document", "at", "key", "xml")
    write_archive(every.select("document", "xml"), *posixpath.split(path if "://" in path else os.path.abspath(path)))


def _ranked(rows: DataFrame) -> DataFrame:
    """`rank` from 0 in the order of key and xml: ranges are sorted apart, and each begins behind what the others before it hold."""
    spread = written(rows.repartitionByRange("key", "xml").withColumn("range", F.spark_partition_id()), "ranges")
    sizes = sorted((r["range"], r["count"]) for r in spread.groupBy("range").count().collect())  # a row a range
    before, starts = 0, []
    for number, n in sizes:
        starts.append((number, before))
        before += n
    starts = F.broadcast(rows.sparkSession.createDataFrame(starts, "range int, before bigint"))
    own = F.row_number().over(Window.partitionBy("range").orderBy("key", "xml")) - 1
    return spread.join(starts, "range").withColumn("rank", F.col("before") + own)
