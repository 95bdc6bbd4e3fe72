"""Documents in blocks and archives, streams of them, writers that commit, and versions of tables."""

import io
import tracemalloc
import zipfile

import pyarrow as pa
import pytest

from quadweave import model
from quadweave.plans.shapes import Rule, validate
from quadweave.sinks import xmlfiles as sink
from quadweave.sources import cimxml, versions, xmlfiles
from tests.test_files import XML

ROWS = [("d", "Type", "Distribution", "i"), ("d", "label", "one.xml", "i"), ("a", "Type", "Bay", "i"), ("a", "name", "A & <b>", "i"), ("b", "Type", "Bay", "i"), ("b", "next", "a", "i"), ("c", "Type", "Bay", "j"), ("c", "name", "é", "j")]
FACTS = {r[:3] for r in ROWS[2:]}


def _set(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def _read(spark, path, **options):
    return xmlfiles.registered(spark).read.format("cimxml").options(**options).load(str(path))


def test_documents_in_nested_archives(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.rdf", XML)
        z.writestr("note.txt", "no document")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("x/inner.zip", inner.getvalue())
        z.writestr("top.xml", XML)
    (tmp_path / "a.xml").write_text(XML)
    (tmp_path / "_hidden.xml").write_text("no xml")
    g = _read(spark, tmp_path)
    assert g.rdd.getNumPartitions() == 3 and g.select("INSTANCE_ID").distinct().count() == 3
    one = g.orderBy("_ord").limit(g.count() // 3)
    assert _set(one, "ID", "KEY", "VALUE") == _set(cimxml.read_cimxml(spark, str(tmp_path / "a.xml")), "ID", "KEY", "VALUE")
    assert [r["VALUE"] for r in g.where("KEY = 'label'").orderBy("_ord").collect()] == ["a.xml", "deep.rdf", "top.xml"]
    assert ("S1", "Substation.kind", "http://x#Kind.a") in _set(_read(spark, tmp_path / "a.xml", shorten="false"), "ID", "KEY", "VALUE")


def test_places_of_violations(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML.replace("<cim:Bay.empty/>", "\n<cim:Bay.empty/>\n<cim:Bay.empty>x</cim:Bay.empty>"))
    scan = _read(spark, tmp_path, positions="true")
    rules = [Rule("s", "minLength", "Bay", "Bay.empty", 1), Rule("t", "maxCount", "Bay", "Bay.empty", 1), Rule("u", "minCount", "Bay", "Bay.none", 1)]
    found = xmlfiles.places(validate(scan, rules), scan)
    assert _set(found, "SOURCE_SHAPE", "ID", "KEY", "SOURCE_LINE") == {("s", "b", "Bay.empty", 5), ("t", "b", "Bay.empty", 5), ("u", "b", "Bay.none", 4)}
    text = (tmp_path / "a.xml").read_bytes()
    assert all(text[r["SOURCE_BYTE"] :].startswith(b"<cim:Bay") for r in found.collect())


def test_a_large_document_is_read_in_blocks(tmp_path):
    head, foot = XML.split("  <cim:Substation")[0], "</rdf:RDF>"
    with open(tmp_path / "large.xml", "w") as f:
        f.write(head)
        for i in range(100_000):
            f.write(f'  <cim:Substation rdf:ID="_S{i}"><cim:name>{"n" * 300}</cim:name></cim:Substation>\n')
        f.write(foot)
    assert (tmp_path / "large.xml").stat().st_size > 35_000_000
    (document,) = xmlfiles.documents(xmlfiles.files_of(str(tmp_path)))
    tracemalloc.start()
    rows = sum(batch.num_rows for batch in xmlfiles.facts(document, True, True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 200_000 + 2 + 1 + 2 + 1 and peak < 30_000_000


def test_documents_as_a_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()

    def taken():
        rows = xmlfiles.registered(spark).readStream.format("cimxml").option("progress", str(tmp_path / "lists")).load(str(inbox))
        rows.writeStream.format("parquet").option("path", str(tmp_path / "table")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(str(tmp_path / "table"))

    (inbox / "a.xml").write_text(XML)
    n = taken().count()
    assert n > 0 and taken().count() == n  # nothing is taken twice
    with zipfile.ZipFile(inbox / "0.zip", "w") as z:
        z.writestr("x.xml", XML)
        z.writestr("y.xml", XML)
    (inbox / "b.xml").write_text(XML)
    both = taken()
    assert both.count() == 4 * n and both.select("_ord").distinct().count() == 4 * n
    with pytest.raises(Exception, match="progress"):
        xmlfiles.registered(spark).readStream.format("cimxml").load(str(inbox)).writeStream.format("noop").trigger(availableNow=True).start().awaitTermination()


@pytest.mark.parametrize("packaging", sink.PACKAGINGS)
def test_packagings_read_back(spark, tmp_path, packaging):
    out = tmp_path / "out"
    sink.write_documents(model.graph(spark, ROWS), str(out), {"cim": "http://c#"}, packaging)
    want = {"xml": {"one.xml", "j.xml"}, "zip_each": {"one.zip", "j.zip"}, "zip_all": {"all.zip"}}[packaging]
    assert {p.name for p in out.iterdir() if not p.name.startswith(".")} == want
    for name in want - {"one.xml", "j.xml"}:
        with zipfile.ZipFile(out / name) as z:
            assert z.testzip() is None and set(z.namelist()) <= {"one.xml", "j.xml"}
    assert FACTS <= _set(_read(spark, out), "ID", "KEY", "VALUE")
    sink.write_documents(model.graph(spark, ROWS[:4]), str(out), {"cim": "http://c#"}, packaging, overwrite=True)
    assert _set(_read(spark, out).where("KEY = 'name'"), "ID") == {("a",)}


def test_many_objects_make_several_documents(spark, tmp_path):
    rows = [(f"o{i}", "Type", "Bay", "i") for i in range(40)] + [("x", "label", "same.xml", "i"), ("y", "label", "same.xml", "j"), ("z", "Type", "Bay", "j")]
    sink.write_documents(model.graph(spark, rows), str(tmp_path / "o"), {"cim": "http://c#"}, objects_per_file=10)
    names = {p.name for p in (tmp_path / "o").iterdir() if not p.name.startswith(".")}
    assert "same-j.xml" in names and len(names) > 2
    assert _set(_read(spark, tmp_path / "o").where("VALUE = 'Bay'"), "ID") == {(f"o{i}",) for i in range(40)} | {("z",)}


def test_only_accepted_attempts_are_kept(tmp_path):
    batch = lambda *rows: iter([pa.RecordBatch.from_pylist([{"document": d, "xml": x} for d, x in rows])])
    for packaging in sink.PACKAGINGS:
        path = tmp_path / packaging
        writer = sink.DocumentWriter({"path": str(path), "packaging": packaging}, False)
        writer.write(batch(("a.xml", "lost"), ("b.xml", "lost")))  # this attempt was lost after it wrote

        def broken():
            yield from batch(("a.xml", "half"))
            raise RuntimeError("the executor went")

        with pytest.raises(RuntimeError):
            writer.write(broken())
        kept = [writer.write(batch(("a.xml", "one"), ("a.xml", "two"))), writer.write(batch(("b.xml", "three")))]
        assert not [p for p in path.iterdir() if p.name != "_attempts"]  # nothing is seen before the commit
        writer.commit(kept + [None])
        assert not (path / "_attempts").exists()
        if packaging == "xml":
            assert {p.name: p.read_text() for p in path.iterdir() if not p.name.startswith(".")} == {"a.xml": "one\ntwo\n", "b.xml": "three\n"}
        if packaging == "zip_all":
            assert sink.join_members(str(path), "all.zip") == 2
            with zipfile.ZipFile(path / "all.zip") as z:
                assert z.testzip() is None and {n: z.read(n) for n in z.namelist()} == {"a.xml": b"one\ntwo\n", "b.xml": b"three\n"}
        again = sink.DocumentWriter({"path": str(path), "packaging": packaging}, False)
        lost = again.write(batch(("c.xml", "never")))
        again.abort([lost])
        assert not (path / "_attempts").exists()
        twice = sink.DocumentWriter({"path": str(path), "packaging": packaging}, False)
        with pytest.raises(ValueError, match="two tasks"):
            twice.commit([twice.write(batch(("d.xml", "1"))), twice.write(batch(("d.xml", "2")))])
    with pytest.raises(ValueError, match="packaging"):
        sink.DocumentWriter({"path": "x", "packaging": "tar"}, False)


def test_headers_of_large_members():
    size, packed, at = 5 << 32, 3, 6 << 32
    entry = sink._header(b"PK\x01\x02", b"n", 7, size, packed, at)
    end = b"PK\x05\x06" + bytes(4) + b"\x01\x00\x01\x00" + len(entry).to_bytes(4, "little") + bytes(6)
    info = zipfile.ZipFile(io.BytesIO(entry + end)).infolist()[0]
    assert (info.file_size, info.compress_size, info.header_offset, info.CRC, info.filename) == (size, packed, at, 7, "n")


def test_versions_are_seen_whole(spark, tmp_path):
    table = str(tmp_path / "t")
    with pytest.raises(ValueError, match="nothing is published"):
        versions.read(spark, table)
    assert versions.replace(spark.range(5), table) == 1
    before = versions.read(spark, table)
    folders = versions._folders(spark, table, 1)
    spark.range(100).write.parquet(f"{table}/versions/being-written")  # a writer between writing and publishing
    assert versions.read(spark, table).count() == 5
    versions._publish(spark, table, 2, ["being-written"])
    assert before.count() == 5 and versions.read(spark, table).count() == 100 and versions.read(spark, table, 1).count() == 5
    with pytest.raises(versions.Conflict):
        versions._publish(spark, table, 2, folders)
    assert versions.append(spark.range(7), table) == 3 and versions.read(spark, table).count() == 107
    assert versions.replace(spark.range(1), table) == 4
    gone = versions.clean(spark, table, keep=1)
    assert len(gone) == 3 and versions.numbers(spark, table) == [4] and versions.read(spark, table).count() == 1


def test_sheets_with_gaps_shared_texts_and_kinds(spark, tmp_path):
    from quadweave.sources import workbooks

    main, rel, package = workbooks._MAIN, workbooks._REL, workbooks._PACKAGE
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}"><Relationship Id="a" Type="x/officeDocument" Target="/xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Bay" sheetId="1" r:id="q"/><sheet name="Raw" sheetId="2" r:id="w"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}"><Relationship Id="q" Type="s" Target="worksheets/s1.xml"/><Relationship Id="w" Type="s" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>ID</t></si><si><r><t>na</t></r><r><t>me</t></r><rPh><t>zz</t></rPh></si><si><t>b1</t></si></sst>')
        z.writestr("xl/worksheets/s1.xml", f'<worksheet xmlns="{main}"><sheetData><row><c r="B1" t="s"><v>0</v></c><c t="s"><v>1</v></c><c r="AA1" t="str"><v>on</v></c><c r="AC1" t="inlineStr"><is><t>many</t></is></c></row><row><c r="A2"><v>9</v></c><c r="B2" t="s"><v>2</v></c><c r="AA2" t="b"><v>1</v></c><c><v>4.5</v></c><c t="inlineStr"><is><t>[\'a\', \'b\']</t></is></c></row><row><c r="C3"><v>1</v></c></row><row/></sheetData></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f'<worksheet xmlns="{main}"><sheetData><row>{"".join(f"<c t=\'inlineStr\'><is><t>{n}</t></is></c>" for n in ("ID", "KEY", "VALUE"))}</row><row><c t="inlineStr"><is><t>r</t></is></c><c t="inlineStr"><is><t>k</t></is></c><c><v>7</v></c></row></sheetData></worksheet>')
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        z.writestr("book.xlsx", inner.getvalue())
        z.writestr("sub/Line.csv", '\ufeffID,name,,Type\r\nl1,"a ""b""\nc",x,Pole\r\nl2,,,\r\n,lost,,\r\n')
    g = workbooks.read_sheets(spark, str(tmp_path), facts_sheet="Raw", instance_id="i")
    assert _set(g, "ID", "KEY", "VALUE", "INSTANCE_ID") == {
        ("b1", "on", "true", "i"), ("b1", "many", "a", "i"), ("b1", "many", "b", "i"), ("b1", "Type", "Bay", "i"), ("r", "k", "7", "i"),
        ("l1", "name", 'a "b"\nc', "i"), ("l1", "Type", "Pole", "i"),
    }
    assert _set(workbooks.read_sheets(spark, str(tmp_path), sheets=["Bay"], multivalue=False).where("KEY = 'many'"), "VALUE") == {("['a', 'b']",)}
    assert [workbooks.column_number(c) for c in ("A1", "Z9", "AA1", "XFD1")] == [0, 25, 26, 16383]
    assert workbooks.registered(spark).read.format("sheets").load(str(tmp_path)).rdd.getNumPartitions() == 3


def test_workbooks_go_on_in_further_sheets(spark, tmp_path):
    from quadweave.sinks import xlsx
    from quadweave.sources import workbooks

    view = spark.range(25).selectExpr("concat('o', id) AS ID", "id AS n", "CASE WHEN id % 2 = 0 THEN concat('<', id, char(7)) END AS text").repartition(4)
    name = "a/very long name that is longer than a sheet's"
    xlsx.write_workbook({name: view, name + "!": view.limit(0)}, str(tmp_path / "w.xlsx"), most_rows=10)
    cells = workbooks.registered(spark).read.format("sheets").load(str(tmp_path))
    assert {r["SHEET"]: r["n"] for r in cells.groupBy("SHEET").agg({"ROW": "max"}).toDF("SHEET", "n").collect()} == {"a_very long name that is longer": 11, "a_very long name that is lo (2)": 11, "a_very long name that is lo (3)": 6}
    assert _set(cells.where("KEY = 'text'"), "ID", "VALUE") == {(f"o{i}", f"<{i}") for i in range(0, 25, 2)} and cells.where("KEY = 'n'").count() == 25
    with zipfile.ZipFile(tmp_path / "w.xlsx") as z:
        assert z.testzip() is None and z.read("xl/workbook.xml").decode().count("<sheet ") == 4
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["w.xlsx"]
    with pytest.raises(Exception, match="32767 characters"):
        xlsx.write_workbook({"x": spark.createDataFrame([("a", "x" * 40_000)], "ID string, t string")}, str(tmp_path / "v.xlsx"))


def test_all_differences_are_written(spark, tmp_path):
    from quadweave.operators import diff

    old, new = model.graph(spark, [("a", "Type", "Bay", "i"), ("a", "k", "1", "i")]), model.graph(spark, [("a", "Type", "Bay", "i"), ("a", "k", "2", "i"), *((f"n{i}", "Type", "Pole", "i") for i in range(9))])
    text = diff.diff_text(old, new)
    assert text.startswith("@@ object a\n- k: 1\n+ k: 2\n@@ Pole n0\n+ Type: Pole") and text.count("\n") == 2 + 18
    with pytest.raises(ValueError, match="write_diff"):
        diff.diff_text(old, new, most=20)
    diff.write_diff(old, new, str(tmp_path / "d"))
    parts = sorted((tmp_path / "d").glob("part-*"))
    assert "".join(p.read_text() for p in parts).splitlines() == text.splitlines()


def test_violations_with_what_is_known_of_the_run(spark, tmp_path):
    from datetime import datetime, timezone

    from quadweave.sinks import violations as v
    from quadweave.sources import workbooks

    rules = [Rule("s", "minLength", "Bay", "name", 2), Rule("t", "maxCount", "Bay", "name", 1), Rule("t", "odd", "Bay", "name")]
    found = validate(model.graph(spark, ROWS), rules[:2])
    meta = v.run_metadata(spark, rules, ["Q"], started=datetime.now(timezone.utc), source="one.xml")
    assert {("node_shapes", "2"), ("constraints", "3"), ("skipped_shapes", "Q"), ("unknown_components", "odd"), ("source", "one.xml")} <= _set(meta, "KEY", "VALUE")
    v.write_violations(found, str(tmp_path / "v"), meta)
    assert spark.read.csv(str(tmp_path / "v"), header=True).count() == found.count() == 1
    assert spark.read.csv(str(tmp_path / "v_meta"), header=True).where("KEY = 'skipped_shapes'").first()["VALUE"] == "Q"
    v.violations_workbook(found, str(tmp_path / "w.xlsx"), meta)
    cells = workbooks.registered(spark).read.format("sheets").load(str(tmp_path / "w.xlsx"))
    assert ("violations", "c") in _set(cells, "SHEET", "ID") and _set(cells.where("SHEET = 'metadata' AND VALUE = 'Q'"), "KEY") == {("VALUE",)}


def test_workbooks_of_very_many_sheets(spark, tmp_path):
    """Names of sheets take time in proportion to their number, and few tasks read them."""
    import time

    from quadweave.sinks import xlsx
    from quadweave.sources import workbooks

    begun = time.monotonic()
    names = xlsx._names(["Order", "order"] * 2_000)
    assert time.monotonic() - begun < 10
    assert len({n.lower() for n in names}) == 4_000 and names[:5] == ["Order", "order (2)", "Order (3)", "order (4)", "Order (5)"]
    xlsx.write_workbook({"v": spark.range(600).selectExpr("cast(id as string) ID", "cast(id as string) t")}, str(tmp_path / "w.xlsx"), most_rows=1)
    cells = workbooks.registered(spark).read.format("sheets").load(str(tmp_path))
    assert cells.rdd.getNumPartitions() == 200
    assert {(r["SHEET"], r["ID"], r["VALUE"], r["_ord"] >> 40) for r in cells.collect()} == {(n, str(i), str(i), k) for k, (n, i) in enumerate(zip(xlsx._names(["v"] * 600), sorted(range(600), key=str)))}


def test_small_documents_share_a_task(tmp_path, monkeypatch):
    """An archive of many documents is opened once by a task and not once for each; large documents have a task each."""
    head = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:c="http://c#">'
    for a in range(3):
        with zipfile.ZipFile(tmp_path / f"{a}.zip", "w") as archive:
            for i in range(40):
                archive.writestr(f"d{i}.xml", f'{head}<c:O rdf:ID="_{a}-{i}"><c:O.n>{i}</c:O.n></c:O></rdf:RDF>')
    (tmp_path / "plain.xml").write_text(f'{head}<c:O rdf:ID="_plain"/></rdf:RDF>')
    found = xmlfiles.documents(xmlfiles.files_of(str(tmp_path)))
    assert len(found) == 121 and [d.place for d in found] == list(range(121))
    (run,) = xmlfiles.BatchReader({"path": str(tmp_path)}).partitions()
    assert run.documents == found
    alone = [row for d in found for batch in xmlfiles.facts(d, True, True) for row in batch.to_pylist()]
    opened = []
    plain = zipfile.ZipFile
    monkeypatch.setattr(xmlfiles.zipfile, "ZipFile", lambda *a: opened.append(1) or plain(*a))
    assert [row for batch in xmlfiles.facts_of(found, True, True) for row in batch.to_pylist()] == alone and len(opened) == 3
    assert len({r["ID"] for r in alone if r["KEY"] == "Type"}) == 121 * 3  # objects, labels and namespaces
    monkeypatch.setattr(xmlfiles, "LEAST", 50)
    monkeypatch.setattr(xmlfiles, "MOST", 50)
    assert [len(r.documents) for r in xmlfiles.shared(found)] == [1] * 121


def test_objects_of_a_document_are_listed_some_at_a_time(monkeypatch):
    from quadweave.sources import cimxml

    monkeypatch.setattr(cimxml, "BATCH", 10)
    text = "<r>\n" + "".join(f'<c:O rdf:ID="_o{i}">\n</c:O>\n' for i in range(25)) + "</r>"
    batches = list(cimxml._lines("x", memoryview(text.encode())))
    assert [b.num_rows for b in batches] == [10, 10, 5]
    rows = [r for b in batches for r in b.to_pylist()]
    assert [(r["ID"], r["SOURCE_LINE"], r["SOURCE_SNIPPET"]) for r in rows] == [(f"o{i}", 2 + 2 * i, f'<c:O rdf:ID="_o{i}">') for i in range(25)]
