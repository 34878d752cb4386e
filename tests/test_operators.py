import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from vellumix.functions.tree import parse
from vellumix.operators import extraction, library, ordered, planning
from vellumix.sources import images, office, xml
from vellumix.streaming import pages as streaming


def rows(spark, schema, *values):
    return spark.createDataFrame(list(values), schema)


def test_paragraph_numbers_jump_forward_only(spark):
    blocks = rows(spark, "doc string, pos int, ex int", ("a", 1, None), ("a", 2, 5), ("a", 3, 2), ("a", 4, None), ("b", 1, 1), ("b", 2, 2))
    got = {(r.doc, r.pos): (r.value, r.jump) for r in ordered.number_paragraphs(blocks, "doc", "pos", "ex").collect()}
    assert got == {("a", 1): (1, False), ("a", 2): (5, True), ("a", 3): (6, True), ("a", 4): (7, False), ("b", 1): (1, False), ("b", 2): (2, False)}


def test_claims_group_and_complain(spark):
    blocks = rows(spark, "doc string, pos int, text string", ("a", 1, "preface"), ("a", 2, "1. one"), ("a", 3, "more"), ("a", 4, " 3、three"), ("b", 1, "1．x"), ("b", 2, "2. y"))
    claims = ordered.group_claims(blocks, "doc", "pos", "text")
    assert [r.claim_ord for r in claims.orderBy("doc", "pos").collect()] == [0, 1, 1, 2, 1, 2]
    assert [(r.doc, r.nums) for r in ordered.claim_issues(claims, "doc", "pos", "text").collect()] == [("a", "1,3")]


def test_caption_chain_stops_after_three(spark):
    blocks = rows(spark, "doc string, pos int, kind string, text string", *[("a", i, k, x) for i, (k, x) in enumerate([("image", ""), ("paragraph", "Fig. 1 a"), ("paragraph", "图2"), ("paragraph", "来源：b"), ("paragraph", "Figure 3"), ("image", ""), ("heading", "图4"), ("paragraph", "图5")])])
    got = [r.role for r in ordered.mark_captions(blocks, "doc", "pos", "kind", "text").orderBy("pos").collect()]
    assert got == [None, "caption", "caption", "image_footnote", None, None, None, None]


def test_names_cascade(spark):
    inputs = rows(spark, "ord long, name string, source_ext string, slot string", (1, "a", "docx", ""), (2, "a", "pdf", ""), (3, "a", "pdf", ""), (4, "a (2)", None, ""), (5, "a", None, ""), (6, "a", "docx", ""), (7, "a", "docx", ".html"))
    got = {r.ord: r.final_name for r in library.registered_names(inputs).collect()}
    assert got == {1: "a", 2: "a (pdf)", 3: "a (pdf) (2)", 4: "a (2)", 5: "a (3)", 6: "a (4)", 7: "a"}
    assert {r.ord: r.final_name for r in library.registered_names(inputs.repartition(5)).collect()} == got


def test_library_guards(spark):
    records = rows(spark, "id string, created_at string, updated_at string, title string, tags array<string>", ("r1", "2026-01-02", "x", "乙", ["t"]), ("r2", "2026-01-01", "x", "丙", []), ("r3", "2026-01-03", "x", "甲", []))
    with pytest.raises(ValueError):
        library.page(records, "name")
    with pytest.raises(ValueError):
        library.page(records, "title", offset=-1)
    assert [r.title for r in library.page(records, "title", descending=False).collect()] == ["丙", "甲", "乙"]
    assert [r.id for r in library.page(records, limit=1, offset=1).collect()] == ["r1"]
    with pytest.raises(ValueError):
        library.matches_facets(records, {"colour": "red"})


def test_tags(spark):
    got = rows(spark, "t array<string>", ([" a ", "", "b", "a"],)).select(library.tags(F.col("t")).alias("t")).first().t
    assert got == ["a", "b"]


def test_report_and_cap(spark):
    losses = rows(spark, "kind string, detail string", *[("k", f"d{i}") for i in range(10)], ("k", " d3  "), ("k", None))
    r = planning.loss_report(losses).first()
    assert r.total == 12 and r.details.startswith("d3×2, d0, d1") and r.details.endswith(" …")
    lines = rows(spark, "doc string, ord int, line string", *[("a", i, f"w{i % 5}") for i in range(9)])
    got = [r.line for r in planning.capped(lines, "doc", "ord", "line", 3).orderBy("n").collect()]
    assert got == ["w0", "w1", "more: 3"]


HTML = """<html><head><title>T</title></head><body><nav>x</nav><div class="postNav">prev</div><article><h1>Head</h1><p>One <b>bold<p>two</b> <i>it</i><br><br><br>end<br></p>
<ul><li>a<li>b <a href="/q">q</a></ul><table><tr><th>h<td>1|2<tr><td>x</table><pre>c
 d</pre><p><img data-src="i/p.png" alt="pic"></p><p>未经授权不得转载</p><div class="ad-slot">buy</div><p> </p><span hidden>no</span></article></body></html>"""


def test_extraction(spark):
    df = rows(spark, "page_id long, url string, html string", (1, "https://h.org/a/", HTML), (2, "https://x.zhihu.com/", "<div class='RichContent-inner'><p>z</p></div>"), (3, None, None), (4, "u", "<div>" * 20000))
    got = {r.page_id: r for r in extraction.extract_pages(df).collect()}
    assert got[1].extraction == "fallback:article" and got[1].images == ["https://h.org/a/i/p.png"]
    assert got[1].markdown.split("\n\n") == ["# Head", "One **bold**", "**two** *it*", "end", "- a\n- b [q](/q)", "| h | 1\\|2 |\n| --- | --- |\n| x |  |", "```\nc\n d\n```", "![pic](https://h.org/a/i/p.png)", "no"]
    assert dict(got[1].removed)["attribute"] == 1 and dict(got[1].removed)["text"] == 1
    assert got[2].extraction == "site:zhihu.com" and got[3].extraction == "fallback:empty" and got[4].title is None or got[4].markdown is not None
    kinds = [b["type"] for b in json.loads(got[1].blocks)]
    assert kinds == ["heading", "text", "text", "list", "table", "code", "image", "text"]


def test_noise_spares_most_of_the_text():
    root = parse("<div class='share'>" + "x" * 60 + "</div><div id='relatePost'>y</div>")
    assert extraction.clean(root)["attribute"] == 1 and "x" * 60 in root.text()


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/"), body)
    return out.getvalue()


REL = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def shape(text, kind=None):
    place = f'<p:nvPr><p:ph type="{kind}"/></p:nvPr>' if kind else "<p:nvPr/>"
    return f"<p:sp><p:nvSpPr>{place}</p:nvSpPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>"


def test_office_files(spark):
    book = zipped(**{
        "xl__workbook.xml": f'<workbook {S}><sheets><sheet name="N" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl___rels__workbook.xml.rels": REL.format('<Relationship Id="r1" Type="x/worksheet" Target="worksheets/s.xml"/>'),
        "xl__sharedStrings.xml": f"<sst {S}><si><t>hi</t></si></sst>",
        "xl__styles.xml": f'<styleSheet {S}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl__worksheets__s.xml": f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2.5</v></c></row><row/><row><c r="A3" s="1"><v>45292.5</v></c><c r="B3" t="b"><v>1</v></c></row></sheetData></worksheet>',
    })
    deck = zipped(**{
        "ppt__slides__slide10.xml": f"<p:sld {P}>{shape('body')}{shape('more')}</p:sld>", "ppt__slides__slide2.xml": f"<p:sld {P}>{shape('b')}{shape('T', 'title')}</p:sld>",
        "ppt__slides___rels__slide2.xml.rels": REL.format('<Relationship Id="n" Type="x/notesSlide" Target="../notesSlides/n.xml"/>'), "ppt__notesSlides__n.xml": f"<p:notes {P}>{shape('said', 'body')}</p:notes>",
    })
    text = zipped(**{
        "word__styles.xml": f'<w:styles {W}><w:style w:styleId="H"><w:name w:val="heading 2"/></w:style></w:styles>',
        "word__document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="H"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:delText>x</w:delText></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>',
    })
    files = rows(spark, "path string, content binary", ("b", bytearray(book)), ("bad", bytearray(b"no zip")), ("evil", bytearray(zipped(**{"..__x": "1"}))), ("none", None))
    cells = {(r.path, r.row_idx): (r.cells, r.error) for r in office.read_sheets(files).collect()}
    assert cells["b", 0] == (["hi", "", "2.5"], None) and cells["b", 1][0] == ["2024-01-01 12:00:00", "true", ""]
    assert "BadZipFile" in cells["bad", None][1] and "unsafe" in cells["evil", None][1]
    decks = office.read_slides(rows(spark, "path string, content binary", ("d", bytearray(deck)))).collect()
    assert [(r.slide_num, r.title, r.bodies, r.notes) for r in decks] == [(2, "T", ["b"], "said"), (10, "body", ["more"], "")]
    words = office.read_word(rows(spark, "path string, content binary", ("w", bytearray(text)))).collect()
    assert [(r.kind, r.text, r.level) for r in words] == [("heading", "Head", 2), ("paragraph", "a\tb", None), ("table", "", None)] and words[2].rows == [["c"]]


def test_xml_scanner(spark):
    df = rows(spark, "doc_id long, xml string", (1, "<a x='1'>t<b/><![CDATA[<c>]]></a>"), (2, "<a><b></a>"), (3, "<!DOCTYPE a [<!ENTITY e 'x'>]><a>&e;</a>"), (4, "<a>" * 70 + "</a>" * 70), (5, None))
    out = xml.scan(df).collect()
    assert [(r.node_id, r.parent_id, r.ord, r.depth, r.name, r.value) for r in out if r.doc_id == 1] == [(0, None, 0, 0, "a", None), (1, 0, 0, 1, "#text", "t"), (2, 0, 1, 1, "b", None), (3, 0, 2, 1, "#text", "<c>")]
    assert all(any(r.error for r in out if r.doc_id == i) for i in (2, 3, 4, 5))
    names = rows(spark, "t string", ("﻿<?xml v?><!-- <z> --><!DOCTYPE q [<!ELEMENT q ANY>]>\n<q:r a='1'/>",), ("text",), (None,)).select(xml.root_name("t").alias("n")).collect()
    assert [r.n for r in names] == ["q:r", None, None]


def test_image_headers(spark):
    jpg = b"\xff\xd8\xff\xe0\x00\x10JFIF\x00\x01\x01\x02\x00\x64\x00\x64\x00\x00\xff\xc0\x00\x0b\x08\x00\x10\x00\x20\x01\x01\x11\x00\xff\xd9"
    assert images.facts(jpg) == ("jpg", 32, 16, 254.0, False)
    assert images.facts(images.with_density(jpg, 300))[3] == 300.0
    bare = jpg[:2] + jpg[20:]
    assert images.facts(bare)[3] is None and images.facts(images.with_density(bare, 96))[3] == 96.0
    frame = b"\x2c" + bytes(8) + b"\x00\x02\x01\x00\x00"
    assert images.facts(b"GIF89a\x02\x00\x03\x00\x00\x00\x00" + frame + frame + b";") == ("gif", 2, 3, None, True)
    assert images.facts(b"") == (None, None, None, None, False) and images.facts(b"\xff\xd8\xff")[0] == "jpg"
    assert images.read_images(rows(spark, "path string, content binary", ("x", bytearray(jpg)), ("n", None))).count() == 2


def test_streaming_skips_what_is_there(spark, tmp_path):
    source, results = f"{tmp_path}/in", f"{tmp_path}/out"
    rows(spark, streaming.SCHEMA, (1, "https://h/", HTML), (2, "https://h/", HTML)).write.parquet(source)
    streaming.run(spark, source, results, f"{tmp_path}/c1").awaitTermination()
    rows(spark, streaming.SCHEMA, (2, "https://h/", HTML), (3, "https://h/", HTML)).write.mode("append").parquet(source)
    streaming.run(spark, source, results, f"{tmp_path}/c1").awaitTermination()
    assert sorted(r.page_id for r in spark.read.parquet(results).collect()) == [1, 2, 3]
