"""Shapes in Turtle, profiles in RDFS, workbooks, streams and the command line."""

import zipfile

from quadweave import model
from quadweave.cli import main
from quadweave.functions import rdfs
from quadweave.graph import Graph
from quadweave.plans.shapes import enriched, rules_of_schema, validate
from quadweave.plans.turtle import rules_of_turtle, triples
from quadweave.sinks import files, xlsx
from quadweave.streaming import landing

SHAPES = """
@prefix sh: <http://www.w3.org/ns/shacl#> .
@prefix cim: <http://iec.ch/TC57/CIM100#> .
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
# a comment; with punctuation.
cim:SwitchShape a sh:NodeShape ;
  sh:targetClass cim:Breaker ;
  sh:closed true ; sh:ignoredProperties ( cim:extra ) ;
  sh:property [ sh:path cim:name ; sh:minCount 1 ; sh:maxLength 5 ; sh:message "a name, \\"short\\"" ] , [ sh:path cim:state ; sh:in ( "open" "closed" ) ; sh:severity sh:Warning ] ;
  sh:property [ sh:path [ sh:inversePath cim:Terminal.Equipment ] ; sh:minCount 1 ] ;
  sh:or ( [ sh:path cim:rate ; sh:minInclusive 10 ] [ sh:path cim:state ; sh:hasValue "open" ] ) .
"""
ROWS = [
    ("b1", "Type", "Breaker", "i"), ("b1", "name", "ok", "i"), ("b1", "state", "open", "i"), ("b1", "rate", "5", "i"), ("t1", "Terminal.Equipment", "b1", "i"), ("t1", "Type", "Terminal", "i"),
    ("b2", "Type", "Breaker", "i"), ("b2", "name", "too long", "i"), ("b2", "state", "stuck", "i"), ("b2", "rate", "5", "i"), ("b2", "odd", "x", "i"), ("b2", "extra", "x", "i"),
]
U = "http://x#"
PROFILE = [
    (U + "Base", "type", "http://www.w3.org/2000/01/rdf-schema#Class", "p"), (U + "Line", "type", "http://www.w3.org/2000/01/rdf-schema#Class", "p"), (U + "Line", "subClassOf", U + "Base", "p"), (U + "Line", "stereotype", "http://y#concrete", "p"),
    (U + "Base.name", "domain", U + "Base", "p"), (U + "Base.name", "multiplicity", "http://y#M:1..1", "p"), (U + "Base.name", "dataType", U + "Integer", "p"),
    (U + "Line.to", "domain", U + "Line", "p"), (U + "Line.to", "range", U + "Base", "p"), (U + "Line.to", "multiplicity", "http://y#M:0..n", "p"), (U + "Line.from", "domain", U + "Line", "p"), (U + "Line.from", "AssociationUsed", "No", "p"),
]


def _set(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_turtle_statements():
    found = triples('@prefix : <http://x/> . :a :p "1"^^:t , 2 ; :q [ :r ( :b ) ] .')
    assert ("http://x/a", "http://x/p", "1") in found and ("http://x/a", "http://x/p", "2") in found
    assert any(o == "http://x/b" for _, _, o in found)


def test_shapes(spark):
    rules, skipped = rules_of_turtle(SHAPES)
    assert not skipped
    found = validate(model.graph(spark, ROWS), rules)
    assert _set(found, "ID", "KEY", "VALUE", "VIOLATION_TYPE") == {
        ("b2", "name", "too long", "maxLength"), ("b2", "state", "stuck", "in"), ("b2", "odd", "x", "closed"), ("b2", "Terminal.Equipment", None, "minCount"), ("b2", None, None, "or"),
        ("b1", "rate", "5", "closed"), ("b2", "rate", "5", "closed"),
    }
    assert _set(found.where("VIOLATION_TYPE = 'maxLength'"), "MESSAGE") == {('a name, "short"',)}
    assert _set(found.where("VIOLATION_TYPE = 'in'"), "SEVERITY") == {("Warning",)}


def test_shapes_that_are_no_rules():
    assert rules_of_turtle(SHAPES.replace("sh:closed true", 'sh:sparql [ sh:select "q" ]'))[1] == ["SwitchShape"]


def test_paths_and_targets(spark):
    head = SHAPES[: SHAPES.index("# a comment")] + "@prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .\n"
    text = head + """
cim:A sh:targetClass cim:Terminal ; sh:property [ sh:path ( cim:Terminal.Equipment rdf:type ) ; sh:in ( cim:Bay ) ; sh:nodeKind sh:IRI ] .
cim:B sh:targetObjectsOf cim:Terminal.Equipment ; sh:property [ sh:path [ sh:alternativePath ( cim:odd [ sh:inversePath cim:Terminal.Equipment ] ) ] ; sh:maxCount 0 ] .
cim:C sh:targetNode <urn:uuid:b2> , <urn:uuid:gone> ; sh:property [ sh:path cim:odd ; sh:minCount 2 ] ; sh:property [ sh:path [ sh:inversePath ( cim:Terminal.Equipment cim:state ) ] ; sh:minCount 0 ] .
cim:D sh:targetClass cim:Breaker ; sh:property [ sh:path [ sh:zeroOrMorePath cim:odd ] ; sh:maxCount 1 ] ; sh:property [ sh:path ( [ sh:inversePath [ sh:zeroOrOnePath cim:Terminal.Equipment ] ] [ sh:oneOrMorePath cim:Terminal.Equipment ] ) ; sh:maxCount 0 ] .
cim:E sh:targetClass cim:Bay ; sh:target [ a sh:SPARQLTarget ] .
"""
    rules, skipped = rules_of_turtle(text)
    assert skipped == ["E"]
    data = model.graph(spark, [*ROWS, ("t2", "Type", "Terminal", "i"), ("t2", "Terminal.Equipment", "nowhere", "i")])
    assert _set(validate(data, rules), "ID", "KEY", "VALUE", "VIOLATION_TYPE", "SOURCE_SHAPE") == {
        ("t1", "Terminal.Equipment/Type", "Breaker", "in", "A"),
        ("b1", "(odd|^Terminal.Equipment)", None, "maxCount", "B"), ("nowhere", "(odd|^Terminal.Equipment)", None, "maxCount", "B"),
        ("b2", "odd", None, "minCount", "C"), ("gone", "odd", None, "minCount", "C"),
        ("b2", "odd*", None, "maxCount", "D"), ("b1", "^(Terminal.Equipment?)/Terminal.Equipment+", None, "maxCount", "D"),
    }


def test_qualified_counts_and_nesting_in_texts(spark):
    head = SHAPES[: SHAPES.index("# a comment")]
    text = head + """
cim:Bays sh:targetClass cim:Bay ;
  sh:property [ sh:path [ sh:inversePath cim:in ] ; sh:qualifiedValueShape [ sh:property [ sh:path cim:state ; sh:hasValue "open" ] ] ; sh:qualifiedMinCount 1 ; sh:qualifiedMaxCount 1 ; sh:qualifiedValueShapesDisjoint true ] ;
  sh:property [ sh:path [ sh:inversePath cim:in ] ; sh:qualifiedValueShape [ sh:property [ sh:path cim:rate ; sh:minInclusive 10 ; sh:minCount 1 ] ] ; sh:qualifiedMinCount 1 ] .
cim:Loop sh:targetClass cim:Bay ; sh:node cim:Loop .
cim:Two sh:targetClass cim:Bay , cim:Yard ; sh:not [ sh:property [ sh:path cim:name ; sh:minCount 1 ] ] .
"""
    rules, skipped = rules_of_turtle(text)
    assert skipped == ["Loop"]
    rows = [(y, "Type", "Bay", "i") for y in ("y1", "y2", "y3")] + [("y4", "Type", "Yard", "i"), ("y4", "name", "n", "i"), ("y1", "name", "n", "i")]
    rows += [("s1", "in", "y1", "i"), ("s1", "state", "open", "i"), ("s2", "in", "y1", "i"), ("s2", "state", "open", "i"), ("s2", "rate", "20", "i")]  # s2 is claimed: one open is left
    rows += [("s3", "in", "y2", "i"), ("s3", "state", "open", "i"), ("s4", "in", "y2", "i"), ("s4", "state", "open", "i")]  # two open, none rated
    found = validate(model.graph(spark, rows), rules)
    assert _set(found, "ID", "VIOLATION_TYPE", "SOURCE_SHAPE") == {
        ("y2", "qualifiedMaxCount", "Bays"), ("y2", "qualifiedMinCount", "Bays"), ("y3", "qualifiedMinCount", "Bays"), ("y1", "not", "Two"), ("y4", "not", "Two"),
    }
    assert found.where("ID = 'y3'").count() == 2 and found.where("VIOLATION_TYPE = 'not'").count() == 2


def test_what_is_said_of_violations(spark):
    text = SHAPES.replace("sh:targetClass cim:Breaker ;", 'sh:targetClass cim:Breaker ; sh:name "switches" ; sh:description "all of them" ;').replace("sh:path cim:name ;", 'sh:path cim:name ; sh:name "naming" ;')
    rules, _ = rules_of_turtle(text)
    data = model.graph(spark, [*ROWS, ("i", "label", "file.xml", "i")])
    profile = model.graph(spark, [(U + "name", "comment", "its name", "p"), (U + "name", "multiplicity", "http://y#M:0..1", "p"), (U + "Breaker", "comment", "a switch", "p")])
    violations = validate(data, rules)
    found = enriched(violations, data, rules, profile).where("ID = 'b2'")
    columns = ("VIOLATION_TYPE", "INSTANCE_LABEL", "SHAPE_NAME", "SHAPE_DESCRIPTION", "SCHEMA_DESCRIPTION", "SCHEMA_MULTIPLICITY", "CLASS_DESCRIPTION")
    rows = _set(found, *columns)
    assert ("maxLength", "file.xml", "naming", "all of them", "its name", "0..1", "a switch") in rows
    assert ("closed", "file.xml", "switches", "all of them", None, None, "a switch") in rows
    assert ("or", "file.xml", "switches", "all of them", None, None, "a switch") in rows
    bare = enriched(violations, data)
    assert bare.count() == violations.count() and _set(bare, "SHAPE_NAME", "CLASS_DESCRIPTION") == {(None, None)}


def test_profiles(spark):
    schema = rdfs.schema(model.graph(spark, PROFILE))
    assert schema == {"Line": {"Base.name": {"min": 1, "max": 1, "datatype": "integer"}, "Line.to": {"min": 0, "max": None, "range": ["Line"]}}}
    data = model.graph(spark, [("l", "Type", "Line", "i"), ("l", "Line.to", "s", "i"), ("s", "Type", "Station", "i")])
    assert _set(validate(data, rules_of_schema(schema)), "ID", "KEY", "VIOLATION_TYPE") == {("l", "Base.name", "minCount"), ("l", "Line.to", "range")}


def test_workbook_and_methods(spark, tmp_path):
    g = Graph(model.graph(spark, ROWS))
    assert g.filter_by_type("Breaker").count() == 10 and "types_count" in dir(g)
    with g.cached() as kept:
        xlsx.write_workbook(kept.tableviews(), str(tmp_path / "w.xlsx"))
    with zipfile.ZipFile(tmp_path / "w.xlsx") as z:
        assert "too long" in z.read("xl/worksheets/sheet1.xml").decode() and 'name="Terminal"' in z.read("xl/workbook.xml").decode()
    assert "too long" not in files.draw(g.data.drop("x"), "b1", 1) and "b1" in files.draw(g.data, "b1", 1)


def test_files_that_land_are_taken_once(spark, tmp_path):
    inbox, table, progress = (str(tmp_path / n) for n in ("in", "table", "progress"))
    files.write_nquads(model.graph(spark, ROWS[:3]), inbox)
    landing.append_new(landing.quads_landing(spark, inbox), table, progress)
    files.write_nquads(model.graph(spark, ROWS[3:5]), inbox + "/more")
    landing.append_new(landing.quads_landing(spark, inbox), table, progress)
    assert spark.read.parquet(table).count() == 3
    seen = []
    landing.each_batch(landing.quads_landing(spark, inbox), lambda batch, number: seen.append((number, batch.count())), str(tmp_path / "p2"))
    assert seen == [(0, 3)]


def test_command_line(spark, tmp_path, capsys):
    head = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:c="http://c#">'
    (tmp_path / "a.xml").write_text(head + '<c:Bay rdf:ID="_b"><c:name>one</c:name></c:Bay></rdf:RDF>')
    (tmp_path / "b.xml").write_text(head + '<c:Bay rdf:ID="_b"><c:name>two</c:name></c:Bay></rdf:RDF>')
    a, b = str(tmp_path / "a.xml"), str(tmp_path / "b.xml")
    assert main(["diff", a, a]) == 0
    assert main(["diff", a, b]) == 1 and "+ name: two" in capsys.readouterr().out
    assert main(["tables", a, "--out", str(tmp_path / "t")]) == 0
    assert spark.read.csv(str(tmp_path / "t" / "Bay"), header=True).first()["name"] == "one"
    assert main(["nquads", a, "--out", str(tmp_path / "q")]) == 0


def test_bundles_of_profiles(spark):
    from quadweave.functions import bundles
    from quadweave.plans import profiles as pr

    cls, prop, ont = "http://y#Class", "http://www.w3.org/1999/02/22-rdf-syntax-ns#Property", "http://www.w3.org/2002/07/owl#Ontology"
    of = lambda doc, rows: [(U + s, k, v, doc) for s, k, v in rows]
    base = [("Base", "type", cls), ("Line", "type", cls), ("Line", "stereotype", "http://y#concrete"), ("Line", "subClassOf", U + "Base"), ("Bay", "type", cls), ("Bay", "stereotype", "Description")]
    first = of("d1", [("o", "type", ont), ("o", "keyword", "EQ"), ("o", "versionIRI", "http://v/1"), *base, ("Base.kind", "domain", U + "Base"), ("Base.kind", "range", U + "Kind"), ("Base.kind", "multiplicity", "M:1..1"), ("Kind.a", "type", U + "Kind"), ("Kind.b", "type", U + "Kind"), ("Line.to", "domain", U + "Line"), ("Line.to", "AssociationUsed", "Yes"), ("Line.to", "range", U + "Base"), ("Line.to", "multiplicity", "M:0..n"), ("Line.from", "domain", U + "Line"), ("Line.from", "AssociationUsed", "No"), ("lost", "type", prop), ("lost", "dataType", U + "String")])
    second = of("d2", [("o", "type", ont), ("o", "keyword", "EQ"), *base, ("Base.kind", "domain", U + "Base"), ("Base.kind", "dataType", U + "Integer"), ("Line.x", "domain", U + "Line"), ("Line.x", "dataType", U + "Float"), ("Line.x", "multiplicity", "M:0..1")])
    older = of("d3", [("V.shortName", "isFixed", "TP"), ("V.date", "isFixed", "2020"), ("V.entsoeUML", "isFixed", "CGMESv02"), *base, ("Line.to", "domainIncludes", U + "Line"), ("Line.to", "dataType", U + "Integer")])
    g = model.graph(spark, first + second + older)
    assert _set(bundles.metadata(g), "INSTANCE_ID", "KEY", "VALUE") >= {("d1", "versionIRI", "http://v/1"), ("d2", "keyword", "EQ"), ("d3", "keyword", "TP"), ("d3", "title", "TP"), ("d3", "modified", "2020"), ("d3", "versionInfo", "02")}
    assert _set(bundles.orphans(g), "INSTANCE_ID", "property") == {("d1", "lost")}
    assert [(r["property"], r["values"]) for r in bundles.enumerations(g).collect()] == [("Base.kind", ["Kind.a", "Kind.b"])]
    from quadweave.functions import terms

    given = bundles.writer_arguments(g)
    assert given["datatypes"] == {"Line.x": "http://www.w3.org/2001/XMLSchema#float", "lost": None} and given["enumerations"] == ("Base.kind",)
    lines = terms.quads(model.graph(spark, [("l", "Line.x", "1", None), ("l", "Base.kind", "Kind.a", None), ("l", "lost", "t", None)]), **given)
    assert {r["line"] for r in lines.collect()} == {f'<urn:uuid:l> <{U}Line.x> "1"^^<http://www.w3.org/2001/XMLSchema#float> .', f"<urn:uuid:l> <{U}Base.kind> <http://iec.ch/TC57/CIM100#Kind.a> .", f'<urn:uuid:l> <{U}lost> "t" .'}
    header = model.graph(spark, of("h", [("Head", "type", cls), ("Head", "stereotype", "http://y#concrete"), ("Head.v", "domain", U + "Head"), ("Head.v", "dataType", U + "String"), *base[1:3], ("Line.to", "domain", U + "Line"), ("Line.to", "dataType", U + "String")]))
    merged = bundles.bundle(g, header)
    got = {(r["keyword"], r["class"], r["property"]): (r["kind"], tuple(r["sources"])) for r in merged.collect()}
    assert got == {
        ("EQ", "Line", "Base.kind"): ("Enumeration", ("d1", "d2")), ("EQ", "Line", "Line.to"): ("Association", ("d1",)), ("EQ", "Line", "Line.x"): ("Attribute", ("d2",)), ("EQ", "Head", "Head.v"): ("Attribute", ("h",)),
        ("TP", "Line", "Line.to"): ("Attribute", ("d3",)), ("TP", "Head", "Head.v"): ("Attribute", ("h",)),
    }
    equipment, topology = bundles.profiles(merged, g)
    assert equipment.version == "http://v/1" and equipment.classes["Line"]["Base.kind"] == {"min": 1, "max": 1, "in": ["Kind.a", "Kind.b"]}
    assert equipment.classes["Line"]["Line.to"] == {"min": 0, "max": None, "range": ["Line"]} and topology.classes["Line"]["Line.to"]["datatype"] == "integer"
    data = model.graph(spark, [("m", "keyword", "EQ", "i"), ("l", "Type", "Line", "i"), ("l", "Base.kind", U + "Kind.c", "i"), ("l", "Line.to", "b", "i"), ("b", "Type", "Bay", "i")])
    assert _set(pr.validate_profiles(data, [equipment, topology]), "KEY", "VIOLATION_TYPE", "PROFILE") == {("Base.kind", "in", "EQ"), ("Line.to", "range", "EQ")}
