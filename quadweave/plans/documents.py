"""Queries that pass the given tables through documents, archives, streams and versions of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadweave.functions import terms
from quadweave.model import TYPE
from quadweave.operators.tableview import rendered, tableviews
from quadweave.plans.catalogue import _CUSTOMER, _NATION, _query
from quadweave.plans.shapes import Rule, validate
from quadweave.sinks import xmlfiles as sink
from quadweave.sinks.xlsx import write_workbook
from quadweave.sources import star, versions, workbooks, xmlfiles
from quadweave.steps import new_path, written


def _written(spark, sf, packaging, *classes, **more):
    path = new_path(spark, "documents")
    sink.write_documents(star.graph(spark, sf, *classes), path, {"cim": terms.CIM}, packaging, references=["Nation.Region", "Customer.Nation"], **more)
    return path


def _facts(found):
    """Without what a reader adds of files and namespaces; documents are parsed once."""
    found = written(found.select("ID", "KEY", "VALUE"), "facts")
    meta = found.where((F.col("KEY") == TYPE) & F.col("VALUE").isin("Distribution", "NamespaceMap")).select("ID")
    return found.join(meta, "ID", "left_anti").select("ID", "KEY", "VALUE")


@_query("SELECT ID, KEY, VALUE FROM (" + _NATION + ") UNION ALL SELECT ID, KEY, VALUE FROM (" + _CUSTOMER + ")")
def cimxml_one_archive(spark, sf):
    path = _written(spark, sf, "zip_all", "Nation", "Customer", objects_per_file=100)
    return _facts(xmlfiles.registered(spark).read.format("cimxml").load(path))


@_query("SELECT ID, KEY, VALUE FROM (" + _CUSTOMER + ")")
def cimxml_archives(spark, sf):
    path = _written(spark, sf, "zip_each", "Customer", objects_per_file=200)
    return _facts(xmlfiles.registered(spark).read.format("cimxml").load(path))


@_query("SELECT ID, KEY, VALUE FROM (" + _CUSTOMER + ")")
def cimxml_stream(spark, sf):
    """Documents as a stream that ends when all of them are read."""
    path, lists, table, progress = _written(spark, sf, "xml", "Customer", objects_per_file=300), *(new_path(spark, n) for n in ("lists", "table", "progress"))
    rows = xmlfiles.registered(spark).readStream.format("cimxml").option("progress", lists).load(path)
    rows.writeStream.format("parquet").option("path", table).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    return _facts(spark.read.parquet(table))


@_query("SELECT 'Customer-' || c_custkey AS ID, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS VALUE, CAST(3 + 6 * (row - 1) + 2 AS INTEGER) AS SOURCE_LINE FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS row FROM customer) WHERE c_acctbal < 0")
def violation_places(spark, sf):
    """Lines of the property that violates: two lines of head, six for each customer, the balance being the third of these."""
    path = _written(spark, sf, "xml", "Customer", objects_per_file=100_000_000)
    scan = xmlfiles.registered(spark).read.format("cimxml").option("positions", "true").load(path)
    found = validate(scan, [Rule("s", "minInclusive", "Customer", "Customer.c_acctbal", 0)])
    return xmlfiles.places(found, scan).select("ID", "VALUE", "SOURCE_LINE")


@_query("SELECT ID, KEY, VALUE FROM (" + _CUSTOMER + ") UNION ALL SELECT ID, KEY, VALUE FROM (" + _NATION + ") UNION ALL SELECT 'Order-' || o_orderkey, 'Type', 'Order' FROM orders UNION ALL SELECT 'Order-' || l_orderkey, 'Order.Part', 'Part-' || l_partkey FROM lineitem")
def xlsx_tableview(spark, sf):
    """Views as sheets of a workbook, which are read back; orders with several parts have them in one cell, and go on in further sheets."""
    folder = new_path(spark, "workbooks")
    data = star.graph(spark, sf, "Customer", "Nation").unionByName(star.graph(spark, sf, "Order", "OrderParts").where(F.col("KEY").isin(TYPE, "Order.Part")))
    views = {name: rendered(view) for name, view in tableviews(data, multivalue=True).items()}
    write_workbook(views, f"{folder}/all.xlsx", most_rows=700)
    return workbooks.read_sheets(spark, folder).select("ID", "KEY", "VALUE")


@_query("SELECT ID, KEY, VALUE FROM (" + _CUSTOMER + ") UNION ALL SELECT ID, KEY, VALUE FROM (" + _NATION + ")")
def versions_replaced(spark, sf):
    """A table that is replaced whole and then added to; what a reader began with before is not what it has now."""
    table = new_path(spark, "versions")
    versions.replace(star.graph(spark, sf, "Nation"), table)
    versions.replace(star.graph(spark, sf, "Customer"), table)
    versions.append(star.graph(spark, sf, "Nation"), table)
    return versions.read(spark, table).select("ID", "KEY", "VALUE")
