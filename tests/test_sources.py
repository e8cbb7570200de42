"""Readers and writers: round trips and defined cases."""

import io
import json
import zipfile

import pytest

from tmloom.sources import backup, catalogue, delimited, docx, ingest, store, tmx, xlsx

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def make_docx(body, **parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        for name, xml in parts.items():
            z.writestr(f"word/{name}.xml", xml)
    return out.getvalue()


def p(*runs):
    return "<w:p>" + "".join(runs) + "</w:p>"


def r(text, props=""):
    return f'<w:r><w:rPr>{props}</w:rPr><w:t xml:space="preserve">{text}</w:t></w:r>'


def test_docx_scan(spark, tmp_path):
    body = (p(r("First one. "), r("Bold", "<w:b/>"), r(" two.")) + p()
            + "<w:tbl><w:tr><w:tc>" + p(r("Cell")) + "</w:tc><w:tc><w:tcPr><w:vMerge/></w:tcPr>" + p(r("hidden")) + "</w:tc></w:tr></w:tbl>"
            + p(r("Old "), '<w:ins w:author="a" w:date="2024-01-01T00:00:00Z">' + r("new") + "</w:ins>", '<w:del w:author="b"><w:r><w:delText>gone</w:delText></w:r></w:del>'))
    notes = f'<w:footnotes {W}><w:footnote w:type="separator" w:id="-1">{p(r("x"))}</w:footnote><w:footnote w:id="2">{p(r("A note."))}</w:footnote></w:footnotes>'
    comments = f'<w:comments {W} xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml"><w:comment w:id="7"><w:p w14:paraId="AA">{r("Check this")}</w:p></w:comment></w:comments>'
    ext = '<w15:commentsEx xmlns:w15="http://schemas.microsoft.com/office/word/2012/wordml"><w15:commentEx w15:paraId="AA" w15:done="1"/></w15:commentsEx>'
    (tmp_path / "a.docx").write_bytes(make_docx(body, footnotes=notes, comments=comments, commentsExtended=ext))
    (tmp_path / "b.docx").write_bytes(b"broken")
    (tmp_path / "c.odt").write_bytes(b"text")
    rows = docx.read_docx(spark, str(tmp_path)).collect()
    texts = [(x.kind, x.text) for x in rows if x.error is None]
    assert texts == [("body", "First one."), ("body", "<1>Bold</1> two."), ("body", "Cell"), ("body", "Old new"), ("footnote", "A note."), ("comment", "Check this")]
    assert len([x for x in rows if x.error]) == 2
    assert [x.done for x in rows if x.kind == "comment"] == [True]
    assert [f["type"] for f in json.loads(next(x.fragments for x in rows if x.fragments))] == ["normal", "ins", "del"]
    assert [(x.table, x.row, x.cell) for x in rows if x.text == "Cell"] == [(0, 0, 0)]


def test_docx_round_trip(spark):
    data = make_docx(p(r("Hello "), r("world", "<w:b/>"), r(".")) + p(r("Second.")))
    out = docx.rewrite_body(data, {0: ("Hallo <1>Welt</1>.", {"1": {"type": "bold"}})})
    assert [x[8] for x in docx.Document(out).scan()] == ["Hallo <1>Welt</1>.", "Second."]


M = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def make_xlsx(sheet, shared="", active=0):
    out = io.BytesIO()
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {M} xmlns:r="{rel}"><bookViews><workbookView activeTab="{active}"/></bookViews><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {M}>{shared}</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {M}><cellXfs><xf/><xf quotePrefix="1"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {M}><sheetData>{sheet}</sheetData></worksheet>")
    return out.getvalue()


def test_xlsx(spark, tmp_path):
    cells = ('<c r="A1" t="s"><v>0</v></c><c r="B1"><v>12</v></c><c r="C1" t="s"><v>1</v></c><c r="D1" t="s" s="1"><v>1</v></c>'
             '<c r="E1" t="str"><f>A1</f><v>x</v></c><c r="AA10" t="inlineStr"><is><t>In line</t></is></c>')
    data = make_xlsx(f"<row>{cells}</row>", "<si><t>One. Two!</t></si><si><t>1.200,50 €</t></si>")
    (tmp_path / "a.xlsx").write_bytes(data)
    (tmp_path / "b.xlsx").write_bytes(b"no zip")
    df = xlsx.read_xlsx(spark, str(tmp_path))
    rows = df.collect()
    assert [(x.row, x.col, x.sentence_index, x.is_tail, x.text) for x in rows if not x.error] == [
        (1, 1, 0, False, "One."), (1, 1, 1, True, "Two!"), (1, 4, 0, True, "1.200,50 €"), (10, 27, 0, True, "In line")]
    assert sum(x.error is not None for x in rows) == 1
    done = df.filter("error is null").selectExpr("*", "case when text = 'One.' then '<1>Eins</1> &amp;' end as target")
    values = {(x.row, x.col): x.value for x in xlsx.merged_cells(done).collect()}
    assert values[1, 1] == "Eins & Two!"
    assert [c[3] for c in xlsx.cells(xlsx.rewrite(data, values))][0] == "Eins & Two!"


def test_tmx(spark, tmp_path):
    text = """<?xml version="1.0"?><tmx><body>
    <tu><tuv xml:lang="en-US"><seg>Open  <bpt i="1">b</bpt>it<ept i="1">b</ept> <ph x="2"/></seg></tuv><tuv xml:lang="DE"><seg>Öffne es</seg></tuv></tu>
    <tu><tuv xml:lang="en"><seg>Only one</seg></tuv></tu>
    <tu><tuv xml:lang="fr"><seg>Un</seg></tuv><tuv xml:lang="it"><seg>Uno</seg></tuv></tu></body></tmx>"""
    (tmp_path / "a.tmx").write_text(text)
    (tmp_path / "b.tmx").write_text(text[:-30])
    rows = tmx.read_tmx(spark, str(tmp_path)).collect()
    good = [(x.source_text, x.target_text) for x in rows if x.path.endswith("a.tmx")]
    assert good == [("Open <1>it</1> <2 />", "Öffne es"), ("Un", "Uno")]
    assert any(x.error for x in rows if x.path.endswith("b.tmx"))
    df = spark.createDataFrame([("A <1>&</1> B", "C < D"), ("x", None), ("", "y")], "source string, target string").coalesce(1)
    tmx.write_tmx(df, str(tmp_path / "out"))
    back = tmx.read_tmx(spark, str(tmp_path / "out" / "*.txt")).collect()
    assert [(x.source_text, x.target_text) for x in back] == [("A & B", "C < D")]


def test_glossary(spark, tmp_path):
    assert delimited.delimiter("a;b;c,d") == ";" and delimited.delimiter("a") == "," and delimited.delimiter("a\tb;c") == "\t"
    f = tmp_path / "g.csv"
    f.write_text('﻿Quelle;Target;Comment\n "Haus" ;house;n\n;x;\nTür;;\n', encoding="utf-8")
    got = delimited.read_glossary(spark, str(f))
    assert [tuple(x) for x in got.collect()] == [('"Haus"', "house", "n")]
    out = str(tmp_path / "out")
    df = spark.createDataFrame([('say "a"', "x, y", None)], "source_term string, target_term string, note string")
    delimited.write_glossary(df, out)
    assert [tuple(x)[:2] for x in delimited.read_glossary(spark, out).collect()] == [('say "a"', "x, y")]


def test_backup(spark, tmp_path):
    t = {"projects": spark.createDataFrame([("p1", "One"), ("p2", "Two")], "id string, project_name string"),
         "project_files": spark.createDataFrame([("f1", "p1"), ("f2", "p2")], "id string, project_id string"),
         "segments": spark.createDataFrame([("s1", "p1", "f1"), ("s2", "p1", "f9"), ("s3", "p2", "f2"), ("s4", "p1", None)], "id string, project_id string, file_id string")}
    path = str(tmp_path / "b")
    backup.write_backup(t, t["projects"].filter("id = 'p1'"), path)
    a, b = backup.restore_backup(spark, path, "copy"), backup.restore_backup(spark, path, "copy")
    seg = a["segments"].collect()
    assert len(seg) == 3 and sorted(map(tuple, seg), key=str) == sorted(map(tuple, b["segments"].collect()), key=str)
    files = {x.id for x in a["project_files"].collect()}
    assert {x.file_id for x in seg} == files | {None} and not {x.id for x in seg} & {"s1", "s2", "s4"}
    assert {x.project_id for x in seg} == {x.id for x in a["projects"].collect()}
    assert {x.id for x in backup.restore_backup(spark, path, "other")["segments"].collect()}.isdisjoint({x.id for x in seg})
    assert backup.list_backups(spark, path).count() > 0


REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
MC = "http://schemas.openxmlformats.org/markup-compatibility/2006"


def rich_docx():
    box = "<w:txbxContent>" + p(r("In the box")) + "</w:txbxContent>"
    body = (p(r("First one. "), r("Bold", "<w:b/>"), r(" two at 1.5 and 1.200,50. "), '<w:r><w:footnoteReference w:id="2"/></w:r>', f'<w:hyperlink xmlns:r="{REL}" r:id="rId9">' + r("link") + "</w:hyperlink>", r(" end."))
            + f'<w:p><w:r><mc:AlternateContent xmlns:mc="{MC}"><mc:Choice><w:drawing>{box}</w:drawing></mc:Choice><mc:Fallback><w:pict>{box}</w:pict></mc:Fallback></mc:AlternateContent></w:r>{r("with box")}</w:p>')
    return make_docx(body, footnotes=f'<w:footnotes {W}><w:footnote w:id="2">{p(r("A note."))}</w:footnote></w:footnotes>')


def test_docx_boxes_numbers_and_notes():
    rows = [(x[0], x[8]) for x in docx.Document(rich_docx()).scan()]
    assert rows == [("body", "First one."), ("body", "<1>Bold</1> two at 1.5 and 1.200,50."), ("body", "<2/><3>link</3> end."), ("body", "<1/>with box"), ("shape", "In the box"), ("footnote", "A note.")]


def test_docx_write_back_keeps_notes_links_and_drawings(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(rich_docx())
    df = docx.read_docx(spark, str(tmp_path)).selectExpr("*", """case when text = 'First one.' then 'Erstens.' when text like '%link%' then '<3>Verweis</3> Ende.' when text = 'In the box' then 'Im Kasten'
        when text = 'A note.' then 'Eine Note.' end as target""")
    out = docx.write_docx(spark, df, str(tmp_path)).collect()
    assert len(out) == 1
    data = bytes(out[0].content)
    rows = [(x[0], x[8]) for x in docx.Document(data).scan()]
    # the note that the translation lost stands before it, as it stood in the first half
    assert rows == [("body", "Erstens."), ("body", "<1>Bold</1> two at 1.5 and 1.200,50."), ("body", "<2/><3>Verweis</3> Ende."), ("body", "<1/>with box"), ("shape", "Im Kasten"), ("footnote", "Eine Note.")]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        xml = z.read("word/document.xml").decode()
    assert xml.count("footnoteReference") == 1 and "rId9" in xml and xml.count("Choice>") == 2


def test_docx_sections_and_headers():
    sect = f'<w:sectPr xmlns:r="{REL}"><w:headerReference r:id="h1"/></w:sectPr>'
    body = p("<w:pPr><w:sectPr/></w:pPr>", r("One")) + p(r("Two")) + sect
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(make_docx(body, header1=f"<w:hdr {W}>{p(r('Top'))}</w:hdr>"))) as a, zipfile.ZipFile(out, "w") as b:
        for n in a.namelist():
            b.writestr(n, a.read(n))
        b.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="h1" Target="header1.xml"/></Relationships>')
    assert [(x[0], x[2], x[8]) for x in docx.Document(out.getvalue()).scan()] == [("body", 0, "One"), ("body", 1, "Two"), ("header", 1, "Top")]


def test_units_and_chunks_of_an_exchange_file(spark, tmp_path):
    unit = '<tu><tuv xml:lang="en"><seg>Open  it</seg></tuv><tuv xml:lang="de"><seg>Öffne es</seg></tuv></tu>'
    (tmp_path / "a.tmx").write_text("<tmx><body>" + unit * 3 + "</body></tmx>")
    units, chunks = ingest.memory_of(spark, str(tmp_path / "a.tmx"), "p", "f")
    got = units.collect()
    import hashlib
    assert len(got) == 3 and {(x.project_id, x.source_hash, x.source_text, x.target_text, x.origin_type) for x in got} == {
        ("p", hashlib.sha256(b"Open it").hexdigest(), "Open it", "Öffne es", "mandatory")}
    assert [(x.content, x.rich_content, x.file_id) for x in chunks.collect()] == [("Open it", "Öffne es", "f")] * 3 and chunks.select("chunk_index").distinct().count() == 3
    mine = spark.createDataFrame([("p", "h", "mine", "meins", "User"), ("p", "h", "old", "alt", "mandatory")], units.schema)
    old = spark.createDataFrame([("f", "gone", None, 0), ("g", "stays", None, 1)], "file_id string, content string, rich_content string, chunk_index long")
    u, c = ingest.reingested(mine, old, units, chunks, spark.createDataFrame([("f",)], "id string"))
    assert sorted(x.source_text for x in u.collect()) == ["Open it"] * 3 + ["mine"] and sorted(x.content for x in c.collect()) == ["Open it"] * 3 + ["stays"]


def test_one_file(spark, tmp_path):
    df = spark.createDataFrame([(f"s{i}", f"t{i}") for i in range(20)], "source string, target string").repartition(4)
    tmx.write_tmx(df, str(tmp_path / "one"), single=True)
    assert len(list((tmp_path / "one").glob("part-*"))) == 1 and tmx.read_tmx(spark, str(tmp_path / "one")).count() == 20


def test_new_project(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(make_docx(p(r("One. Two.")) + p(r("Three"))))
    (tmp_path / "b.xlsx").write_bytes(make_xlsx('<row><c r="A1" t="s"><v>0</v></c></row>', "<si><t>Cell one. Cell two.</t></si>"))
    (tmp_path / "c.odt").write_bytes(b"x")
    (tmp_path / "d.docx").write_bytes(b"x")
    seg, bad = ingest.create_project(spark, str(tmp_path), "p")
    rows = sorted(seg.collect(), key=lambda x: x.segment_index)
    assert [(x.segment_index, x.source_content, x.status) for x in rows] == [(0, "One.", "draft"), (1, "Two.", "draft"), (2, "Three", "draft"), (3, "Cell one.", "draft"), (4, "Cell two.", "draft")]
    assert len({x.id for x in rows}) == 5 and len({x.file_id for x in rows}) == 2 and bad.count() == 2
    assert {x.id for x in ingest.create_project(spark, str(tmp_path), "p")[0].collect()} == {x.id for x in rows}
    assert sorted(x.content for x in ingest.context_chunks(spark, str(tmp_path), "p").collect()) == ["Cell one.", "Cell two.", "One.", "Three", "Two."]


def test_files_as_they_arrive(spark, tmp_path):
    from tmloom.streaming import usage
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.docx").write_bytes(make_docx(p(r("One."))))
    start = lambda: usage.new_files(spark, str(folder)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    start().awaitTermination()
    (folder / "b.docx").write_bytes(make_docx(p(r("Two."))))
    start().awaitTermination()
    assert sorted(x.text for x in spark.read.parquet(str(tmp_path / "out")).collect()) == ["One.", "Two."]


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}")
    s.put("a/b.bin", b"\x00\xff1")
    s.copy("a/b.bin", "c/d.bin")
    assert s.get("c/d.bin") == b"\x00\xff1" and s.names("c") == ["d.bin"] and s.get("no") is None
    s.delete("a")
    s.delete("a")
    assert s.get("a/b.bin") is None and s.get("c/d.bin")
    for bad in ("../x", "a/../../x", "", "/"):
        with pytest.raises(ValueError):
            s.path(bad)


def test_catalogue_and_last_fingerprint(spark, tmp_path):
    import os
    (tmp_path / "m.json").write_text(json.dumps({"models": [{"id": "a", "usage": "mt", "input_cost_per_m": 1.5}, {"id": "b", "usage": "bg", "context_window": 10}]}))
    m = catalogue.read_models(spark, str(tmp_path / "m.json"))
    assert [(x.pos, x.id, x.is_default) for x in m.orderBy("pos").collect()] == [(0, "a", True), (1, "b", False)] and [x.id for x in catalogue.selectable(m).collect()] == ["a"]
    h = tmp_path / "h"
    h.mkdir()
    assert backup.last_fingerprint(spark, str(h)) is None
    for n, t in (("x.hash", 100), ("y.hash", 200)):
        (h / n).write_text(n + "\n")
        os.utime(h / n, (t, t))
    assert backup.last_fingerprint(spark, str(h)) == "y.hash"
