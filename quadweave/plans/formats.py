"""Queries that pass the given tables through file formats and back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadweave.functions import terms
from quadweave.model import TYPE
from quadweave.operators import tableview as t
from quadweave.plans.catalogue import _CUSTOMER, _NATION, _query
from quadweave.sinks import files
from quadweave.sources import cimxml, nquads, sheets, star
from quadweave.steps import new_path, written


def _folder(spark) -> str:
    """A new path in the folder that driver and executors share."""
    return new_path(spark, "formats")


@_query("SELECT '<urn:uuid:' || ID || '> <' || CASE WHEN KEY = 'Type' THEN 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' ELSE 'http://iec.ch/TC57/CIM100#' || KEY END || '> ' || CASE WHEN KEY = 'Type' THEN '<http://iec.ch/TC57/CIM100#' || VALUE || '>' ELSE '\"' || VALUE || '\"' END || ' <urn:uuid:EQ> .' AS line FROM (" + _NATION + ")")
def nquads_lines(spark, sf):
    return terms.quads(star.graph(spark, sf, "Nation"))


@_query("SELECT ID, KEY, VALUE FROM (" + _CUSTOMER + ") UNION ALL SELECT 'Document-' || doc_id, 'Document.text', text FROM documents")
def nquads_roundtrip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.concat(F.lit("Document-"), F.col("doc_id").cast("string")).alias("ID"), F.lit("Document.text").alias("KEY"), F.col("text").alias("VALUE"), F.lit("DOC").alias("INSTANCE_ID"), F.col("doc_id").alias("_ord"))
    path = _folder(spark)
    files.write_nquads(star.graph(spark, sf, "Customer").unionByName(docs), path)
    return nquads.read_nquads(spark, path).select("ID", "KEY", "VALUE")


@_query("SELECT ID, KEY, VALUE FROM (" + _CUSTOMER + ")")
def csv_tableview(spark, sf):
    path = _folder(spark)
    files.write_tables(star.graph(spark, sf, "Customer"), path)
    return sheets.read_tables(spark, {"Customer": f"{path}/Customer"}).select("ID", "KEY", "VALUE")


@_query("SELECT ID, KEY, VALUE FROM (" + _NATION + ") UNION ALL SELECT ID, KEY, VALUE FROM (" + _CUSTOMER + ")")
def cimxml_roundtrip(spark, sf):
    path = _folder(spark)
    files.write_cimxml(star.graph(spark, sf, "Nation", "Customer"), path, {"cim": terms.CIM}, references=["Nation.Region", "Customer.Nation"])
    found = written(cimxml.read_cimxml(spark, _documents(spark, path)).select("ID", "KEY", "VALUE"), "facts")  # documents are parsed once
    return found.where(~F.col("VALUE").isin("Distribution", "NamespaceMap")).join(_meta(found), "ID", "left_anti").select("ID", "KEY", "VALUE")


def _documents(spark, path):
    """The written documents, renamed to .xml as readers of this format expect."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found, listing = [], fs.listFiles(root, True)
    while listing.hasNext():
        file = listing.next().getPath()
        if file.getName().startswith("part-"):
            to = jvm.org.apache.hadoop.fs.Path(file.getParent(), file.getName().rsplit(".", 1)[0] + ".xml")
            fs.rename(file, to)
            found.append(to.toString())
    return found


def _meta(found):
    return found.where((F.col("KEY") == TYPE) & F.col("VALUE").isin("Distribution", "NamespaceMap")).select("ID")


@_query("SELECT 'Customer-' || c_custkey AS ID_FROM, 'Customer.Nation' AS KEY, 'Nation-' || c_nationkey AS ID_TO, 'Nation' AS type_to FROM customer")
def graph_nodes_edges(spark, sf):
    nodes, edges = files.graph_frames(star.graph(spark, sf, "Customer", "Nation"))
    return edges.where("KEY = 'Customer.Nation'").join(nodes.select(F.col("ID").alias("ID_TO"), F.col("Type").alias("type_to")), "ID_TO").select("ID_FROM", "KEY", "ID_TO", "type_to")


@_query("SELECT 'Order-' || l_orderkey AS ID, count(*) AS parts FROM lineitem GROUP BY 1")
def multivalue_sizes(spark, sf):
    return t.wide(star.graph(spark, sf, "OrderParts"), ["Order.Part"], multivalue=True).select("ID", F.size("`Order.Part`").cast("bigint").alias("parts"))


@_query("SELECT ID, KEY, VALUE FROM (" + _CUSTOMER + ")")
def landing_stream(spark, sf):
    """The customer table as a stream of files, appended to a graph table until all are taken."""
    from quadweave.streaming import landing

    kind = spark.read.parquet(f"{sf}/customer.parquet").schema
    rows = spark.readStream.schema(kind).option("pathGlobFilter", "customer.parquet").parquet(sf)
    table, progress = _folder(spark), _folder(spark)
    landing.append_new(star.objects(rows, star.CLASSES["Customer"]), table, progress)
    landing.append_new(star.objects(rows, star.CLASSES["Customer"]), table, progress)  # nothing is taken twice
    return spark.read.parquet(table).select("ID", "KEY", "VALUE")
