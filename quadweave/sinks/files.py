"""Graph tables and reports to files; Spark writes them in parts, except where one document is one file."""

from __future__ import annotations

from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadweave.functions.terms import quads
from quadweave.model import ORDER, TYPE
from quadweave.operators.tableview import rendered, tableviews
from quadweave.steps import written

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


def write_nquads(data: DataFrame, path: str, **schema) -> None:
    quads(data, **schema).write.text(path)


def write_tables(data: DataFrame, folder: str, multivalue: bool = True) -> list[str]:
    """A CSV folder for each class; returns the classes."""
    views = tableviews(data, multivalue=multivalue)
    for name, view in views.items():
        (rendered(view) if multivalue else view).write.csv(f"{folder}/{name}", header=True, escape='"')
    return list(views)


def graph_frames(data: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (ID, Type) and edges (ID_FROM, KEY, ID_TO)."""
    from quadweave.operators.references import references_all

    nodes = data.groupBy("ID").agg(F.min_by(F.when(F.col("KEY") == TYPE, F.col("VALUE")), F.when(F.col("KEY") == TYPE, F.col(ORDER))).alias("Type"))
    return nodes, references_all(data)


def _xml_text(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def cimxml_objects(data: DataFrame, references: list[str] | None = None, prefix: str = "cim") -> DataFrame:
    """(INSTANCE_ID, ID, place, xml): the element of every typed object; references are properties that link.

    Properties are links if their name is listed, or without a list if their value is the ID of an object."""
    rows = data.where(F.col("VALUE").isNotNull())
    if references is None:
        ids = data.select(F.col("ID").alias("VALUE")).distinct().withColumn("_link", F.lit(True))
        rows = rows.join(ids, "VALUE", "left")
    else:
        rows = rows.withColumn("_link", F.col("KEY").isin(references))
    name = F.concat(F.lit(f"{prefix}:"), F.col("KEY"))
    link = F.concat(F.lit("    <"), name, F.lit(' rdf:resource="#_'), _xml_text(F.col("VALUE")), F.lit('"/>'))
    plain = F.concat(F.lit("    <"), name, F.lit(">"), _xml_text(F.col("VALUE")), F.lit("</"), name, F.lit(">"))
    properties = rows.select("INSTANCE_ID", "ID", "KEY", "VALUE", ORDER, F.when(F.coalesce("_link", F.lit(False)), link).otherwise(plain).alias("xml"))
    is_type = F.col("KEY") == TYPE
    grouped = properties.groupBy("INSTANCE_ID", "ID").agg(
        F.min_by(F.when(is_type, F.col("VALUE")), F.when(is_type, F.col(ORDER))).alias("class"),
        F.min(ORDER).alias("place"),
        F.array_sort(F.collect_list(F.when(~is_type, F.struct(ORDER, "xml")))).alias("parts"),
    )
    typed = grouped.where(F.col("class").isNotNull() & ~F.col("class").isin("Distribution", "NamespaceMap"))
    inner = F.array_join(F.transform("parts", lambda p: p["xml"]), "\n")
    tag = F.concat(F.lit(f"{prefix}:"), F.col("class"))
    return typed.select("INSTANCE_ID", "ID", "place", F.concat(F.lit("  <"), tag, F.lit(' rdf:ID="_'), _xml_text(F.col("ID")), F.lit('">\n'), inner, F.lit("\n  </"), tag, F.lit(">")).alias("xml"))


def write_cimxml(data: DataFrame, folder: str, namespaces: dict[str, str], references: list[str] | None = None, prefix: str = "cim", objects_per_file: int = 500_000) -> None:
    """A folder for each instance, with whole documents of at most `objects_per_file` objects.

    Spark's text writer partitions by instance and file; a document's head and foot are rows like its objects."""
    objects = written(cimxml_objects(data, references, prefix), "objects")  # counted, dealt and asked for their documents
    counts = objects.groupBy("INSTANCE_ID").agg(F.ceil(F.count("*") / objects_per_file).cast("int").alias("files"))
    dealt = objects.join(counts, "INSTANCE_ID").withColumn("file", F.pmod(F.xxhash64("ID"), F.col("files")).cast("int"))
    spaces = " ".join(f"xmlns:{p}={quoteattr(u)}" for p, u in ({"rdf": RDF} | namespaces).items())
    head, foot = f'<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF {spaces}>', "</rdf:RDF>"
    ends = dealt.select("INSTANCE_ID", "file").distinct().select("INSTANCE_ID", "file", F.inline(F.array(F.struct(F.lit(-(1 << 62)).alias("place"), F.lit(head).alias("xml")), F.struct(F.lit(1 << 62).alias("place"), F.lit(foot).alias("xml")))))
    rows = dealt.select("INSTANCE_ID", "file", "place", "xml").unionByName(ends)
    rows.repartition("INSTANCE_ID", "file").sortWithinPartitions("INSTANCE_ID", "file", "place").select("INSTANCE_ID", "file", F.col("xml").alias("value")).write.partitionBy("INSTANCE_ID", "file").text(folder)


def links_html(nodes: list[tuple[str, str]], edges: list[tuple[str, str, str]], title: str = "links") -> str:
    """A page that lists a small graph: nodes with class, and their links."""
    rows = "".join(f"<tr><td>{escape(n)}</td><td>{escape(t or '')}</td></tr>" for n, t in nodes)
    lines = "".join(f"<tr><td>{escape(a)}</td><td>{escape(k)}</td><td>{escape(b)}</td></tr>" for a, k, b in edges)
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><table>{rows}</table><table>{lines}</table></body></html>"


def draw(data: DataFrame, object_id: str, levels: int = 2, most: int = 5_000) -> str:
    """The page of what is around an object; refuses more than `most` nodes."""
    from quadweave.operators.references import references

    near = references(data, object_id, levels)
    nodes, edges = graph_frames(near.select("ID", "KEY", "VALUE", "INSTANCE_ID", ORDER))
    found = nodes.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} objects around {object_id}")
    return links_html([(n["ID"], n["Type"]) for n in found], [tuple(e) for e in edges.collect()], object_id)


