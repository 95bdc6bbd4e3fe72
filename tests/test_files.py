"""Files, read and written."""

import zipfile

import pytest

from quadweave import model
from quadweave.functions import terms
from quadweave.sinks import files
from quadweave.sources import cimxml, nquads

QUADS = [
    ("a1", "Type", "Breaker", "g1"),
    ("a1", "name", 'quote " back \\ line\nend\rtab\t', "g1"),
    ("a1", "Breaker.Bay", "01234567-89ab-cdef-0123-456789abcdef", "g1"),
    ("b2", "Type", "Bay", "g2"),
    ("b2", "name", "", "g2"),
]
XML = """<?xml version="1.0" encoding="UTF-8"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:cim="http://iec.ch/TC57/2013/CIM-schema-cim16#" xml:base="here">
  <cim:Substation rdf:ID="_S1"><cim:IdentifiedObject.name>Sub &amp; 1</cim:IdentifiedObject.name><cim:Substation.kind rdf:resource="http://x#Kind.a"/></cim:Substation>
  <cim:Bay rdf:about="urn:uuid:b"><cim:Bay.Substation rdf:resource="#_S1"/><cim:Bay.empty/></cim:Bay>
</rdf:RDF>"""


def _set(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_quads_round_trip(spark, tmp_path):
    path = str(tmp_path / "q")
    files.write_nquads(model.graph(spark, QUADS), path)
    assert _set(nquads.read_nquads(spark, path), *model.COLUMNS) == set(QUADS)


def test_quad_terms(spark):
    lines = ['<urn:uuid:s> <http://iec.ch/TC57/CIM100#k> "caf\\u00e9"@fr <urn:uuid:g> .', "# note", "", '_:b <http://x/p> "1"^^<http://www.w3.org/2001/XMLSchema#integer> .', "<s> <p> <http://x/y> ."]
    found = terms.facts_of_quads(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert _set(found, *model.COLUMNS) == {("s", "k", "café", "g"), ("b", "http://x/p", "1", None), ("s", "p", "http://x/y", None)}


def test_malformed_lines_are_errors(spark):
    with pytest.raises(Exception, match="not N-Quads"):
        terms.facts_of_quads(spark.createDataFrame([("no quad",)], "value string")).collect()


def test_xml_in_files_and_archives(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("inner.xml", XML)
    g = cimxml.read_cimxml(spark, str(tmp_path))
    assert g.select("INSTANCE_ID").distinct().count() == 2
    want = {("S1", "Type", "Substation"), ("S1", "IdentifiedObject.name", "Sub & 1"), ("S1", "Substation.kind", "Kind.a"), ("b", "Type", "Bay"), ("b", "Bay.Substation", "S1"), ("b", "Bay.empty", "")}
    assert want <= _set(g, "ID", "KEY", "VALUE")
    assert ("xml_base", "here") in _set(g, "KEY", "VALUE")


def test_cleaned_ids():
    assert [cimxml.clean_id(x) for x in ("urn:uuid:abc-123", "#_foo_bar", "_123", None, "")] == ["abc-123", "foo_bar", "123", "", ""]


def test_entities_are_refused():
    with pytest.raises(ValueError):
        list(cimxml.parse("x.xml", b'<!DOCTYPE a [<!ENTITY e "x">]><a>&e;</a>'))


def test_lines_of_objects(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    found = cimxml.object_lines(spark, str(tmp_path))
    assert _set(found, "ID", "SOURCE_LINE") == {("S1", 3), ("b", 4)}
    assert found.where("ID = 'S1'").first()["SOURCE_SNIPPET"].startswith('<cim:Substation rdf:ID="_S1">')
