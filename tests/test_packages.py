from __future__ import annotations

import io
import zipfile
import zlib

import pytest

from pagewright.sources import docx, pdf, xlsx
from pagewright.sources.decode import PARTS, decode, decode_one, sniffed, zip_flavor
from pagewright.sources.model import DecodeError

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def package(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def rels(*items: tuple[str, str, str]) -> str:
    rows = "".join(f'<Relationship Id="{i}" Type="x/{t}" Target="{x}"{" TargetMode=" + chr(34) + "External" + chr(34) if "://" in x else ""}/>' for i, t, x in items)
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rows}</Relationships>'


def workbook(sheet: str, **more: str) -> bytes:
    parts = {
        "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="People" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": rels(("r1", "worksheet", "worksheets/s1.xml")),
        "xl/worksheets/s1.xml": f"<worksheet {S}>{sheet}</worksheet>",
    }
    return package(parts | more)


def cells(data: bytes):
    return [(p.content, p.hints[0].kind) for p in xlsx.decode(data).primitives]


TEXT = '<c r="{}" t="inlineStr"><is><t>{}</t></is></c>'


def test_sheet_with_guessed_header():
    rows = f'<sheetData><row r="1">{TEXT.format("A1", "Name")}{TEXT.format("B1", "Age")}</row><row r="2">{TEXT.format("A2", "Alice")}<c r="B2"><v>30</v></c></row></sheetData>'
    d = xlsx.decode(workbook(rows))
    assert cells(workbook(rows)) == [("People", "heading"), ("Name", "table_header"), ("Age", "table_header"), ("Alice", "table_cell"), ("30", "table_cell")]
    assert [w.kind for w in d.warnings] == ["heuristic_inference"]
    assert {(p.origin, p.space) for p in d.primitives} == {("reconstructed", "logical_grid")}


def test_cell_types_formats_and_merges():
    styles = f'<styleSheet {S}><numFmts><numFmt numFmtId="200" formatCode="yyyy-mm-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="200"/><xf numFmtId="10"/></cellXfs></styleSheet>'
    rows = (
        '<sheetData><row r="1"><c r="A1" t="b"><v>1</v></c><c r="B1" t="e"><v>DIV/0</v></c><c r="C1" s="1"><v>43831</v></c></row>'
        '<row r="2"><c r="A2" s="2"><v>0.5</v></c><c r="B2"><f>A1</f></c><c r="C2" t="s"><v>9</v></c></row></sheetData>'
        '<mergeCells><mergeCell ref="A1:A2"/></mergeCells>'
    )
    d = xlsx.decode(workbook(rows, **{"xl/styles.xml": styles}))
    assert [p.content for p in d.primitives] == ["People", "true", "#ERR:DIV/0", "2020-01-01"]
    assert d.primitives[1].hints[0].rowspan == 2
    assert [w.kind for w in d.warnings] == ["partial_extraction", "partial_extraction"]


def test_links_comments_and_named_tables():
    rows = f'<sheetData><row r="1">{TEXT.format("A1", "h")}</row><row r="2">{TEXT.format("A2", "v")}</row></sheetData><hyperlinks><hyperlink ref="A2" r:id="l"/></hyperlinks>'
    more = {
        "xl/worksheets/_rels/s1.xml.rels": rels(("l", "hyperlink", "http://x.y/"), ("c", "comments", "../c.xml"), ("t", "table", "../t.xml")),
        "xl/c.xml": f'<comments {S}><authors><author>Ann</author></authors><commentList><comment ref="C3" authorId="0"><text><t>look</t></text></comment></commentList></comments>',
        "xl/t.xml": f'<table {S} ref="A1:A2" headerRowCount="1"/>',
    }
    d = xlsx.decode(workbook(rows, **more))
    assert [(p.content, [h.kind for h in p.hints]) for p in d.primitives] == [
        ("People", ["heading"]), ("h", ["table_header"]), ("v", ["table_cell", "link"]), ("[note: Ann: look]", [])
    ]


def document(body: str, **more: str) -> bytes:
    return package({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"} | more)


def para(text: str, style: str = "", more: str = "") -> str:
    return f'<w:p><w:pPr>{f"<w:pStyle w:val={chr(34)}{style}{chr(34)}/>" if style else ""}{more}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'


def test_headings_lists_and_tables():
    styles = (
        f'<w:styles {W}><w:style w:styleId="H"><w:name w:val="x"/><w:pPr><w:outlineLvl w:val="1"/></w:pPr></w:style>'
        '<w:style w:styleId="K"><w:name w:val="y"/><w:basedOn w:val="H"/></w:style></w:styles>'
    )
    numbering = f'<w:numbering {W}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="5"><w:abstractNumId w:val="0"/></w:num></w:numbering>'
    table = (
        "<w:tbl><w:tr><w:tc><w:tcPr><w:vMerge w:val='restart'/></w:tcPr><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr>"
        "<w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    )
    body = para("Title", "K") + para("item", more='<w:numPr><w:ilvl w:val="0"/><w:numId w:val="5"/></w:numPr>') + para("text") + table
    d = docx.decode(document(body, **{"word/styles.xml": styles, "word/numbering.xml": numbering}))
    assert [(p.content, p.hints[0].kind) for p in d.primitives] == [
        ("Title", "heading"), ("item", "list_item"), ("text", "paragraph"), ("a", "table_cell"), ("b", "table_cell"), ("c", "table_cell")
    ]
    assert d.primitives[0].hints[0].level == 2 and d.primitives[1].hints[0].ordered
    assert (d.primitives[3].hints[0].rowspan, d.primitives[5].hints[0].row, d.primitives[5].hints[0].col) == (2, 1, 1)
    assert not d.warnings


def test_changes_notes_and_page_breaks():
    body = (
        "<w:p><w:del><w:r><w:t>gone</w:t></w:r></w:del><w:ins><w:r><w:t>new</w:t></w:r></w:ins></w:p>"
        '<w:p><w:r><w:br w:type="page"/><w:t>next</w:t></w:r></w:p>'
    )
    more = {
        "word/_rels/document.xml.rels": rels(("n", "footnotes", "footnotes.xml")),
        "word/footnotes.xml": f'<w:footnotes {W}><w:footnote w:type="separator" w:id="0"><w:p/></w:footnote><w:footnote w:id="2"><w:p><w:r><w:t>note</w:t></w:r></w:p></w:footnote></w:footnotes>',
    }
    d = docx.decode(document(body, **more))
    assert [(p.content, p.page) for p in d.primitives[:2]] == [("new", 0), ("next", 1)]
    assert d.primitives[2].hints[0].kind == "footnote" and d.primitives[2].hints[0].text == "2"
    assert d.page_count == 2 and d.page_basis == "explicit_breaks"
    assert [w.kind for w in d.warnings] == ["tracked_change_resolved"] * 2


def page(content: str, extra: str = "", packed: bool = False, trailer: str = "") -> bytes:
    data = zlib.compress(content.encode("latin-1")) if packed else content.encode("latin-1")
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 600 800] >>",
        f"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> {extra} >>".encode(),
        f"<< /Length {len(data)} {'/Filter /FlateDecode' if packed else ''} >>\nstream\n".encode() + data + b"\nendstream",
        b"<< /Type /Font /Subtype /Type1 /BaseFont /ABCDEF+Helvetica-Bold >>",
    ]
    out = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n" % (i + 1) + o + b"\nendobj\n" for i, o in enumerate(objects))
    return out + f"trailer << /Root 1 0 R {trailer} >>\n%%EOF".encode()


GRID = "".join(f"{x0} {y0} m {x1} {y1} l S " for x0, y0, x1, y1 in [(100, 500, 300, 500), (100, 450, 300, 450), (100, 400, 300, 400), (100, 400, 100, 500), (200, 400, 200, 500), (300, 400, 300, 500)])


@pytest.mark.parametrize("packed", [False, True])
def test_page_of_text_rules_and_links(packed):
    text = "BT /F1 24 Tf 72 700 Td (Big) Tj ET BT /F1 10 Tf 72 650 Td [(Bo) -10 (dy)] TJ 0 -30 Td (\\050x\\051) Tj ET " + GRID
    text += "BT /F1 10 Tf 110 470 Td (A) Tj 100 0 Td (B) Tj -100 -50 Td (C) Tj 100 0 Td (D) Tj ET"
    link = "/Annots [<< /Subtype /Link /Rect [70 645 100 665] /A << /URI (http://x.y) >> >>]"
    d = pdf.decode(page(text, link, packed))
    texts = [p for p in d.primitives if p.kind == "text"]
    assert [p.content for p in texts] == ["Big", "Body", "(x)", "A", "B", "C", "D"]
    assert texts[0].is_bold and texts[0].font_name == "Helvetica-Bold" and texts[0].font_size == 24
    assert [h.url for h in texts[1].hints] == ["http://x.y"]
    assert all(0 <= p.x <= 1 and 0 <= p.y <= 1 for p in d.primitives)
    r = decode_one(page(text, link, packed), "pdf", list(PARTS))
    assert [(n["row"], n["col"], n["text"]) for n in r["nodes"] if n["kind"] == "table_cell"] == [(0, 0, "A"), (0, 1, "B"), (1, 0, "C"), (1, 1, "D")]
    assert any(n["kind"] == "heading" and n["text"] == "Big" for n in r["nodes"])


def test_encrypted_and_broken_files():
    d = pdf.decode(page("", trailer="/Encrypt 9 0 R"))
    assert d.encrypted and not d.primitives
    for data in (b"", b"x", b"%PDF-1.4 nothing"):
        with pytest.raises(DecodeError):
            pdf.decode(data)
    assert decode_one(b"PK\x03\x04broken", "docx", ["text"])["error"]


def test_formats_are_told_by_bytes_first(spark):
    book = workbook(f'<sheetData><row r="1">{TEXT.format("A1", "x")}</row></sheetData>')
    rows = [
        (1, "a.pdf", bytearray(page("BT /F1 10 Tf 9 9 Td (p) Tj ET"))),
        (2, "b.txt", bytearray(book)),
        (3, "c.pdf", bytearray(document(para("d")))),
        (4, "d.bin", bytearray(b"<!DOCTYPE html><p>h")),
        (5, "e.html", bytearray(b"<p>no head")),
        (6, "f.bin", bytearray(b"?")),
        (7, None, None),
    ]
    raw = spark.createDataFrame(rows, "doc_id long, path string, content binary")
    found = {r.doc_id: r.f for r in raw.select("doc_id", sniffed(raw.content, raw.path).alias("f")).collect()}
    assert found == {1: "pdf", 2: "xlsx", 3: "docx", 4: "html", 5: "html", 6: None, 7: None}
    assert zip_flavor(book) == "xlsx" and zip_flavor(b"PK") is None
    got = {r.doc_id: (r.error is None, r.text) for r in decode(raw, ["text", "primitives"]).collect()}
    assert [got[i][0] for i in range(1, 8)] == [True, True, True, True, True, False, False]
    assert got[4][1] == "h\n"
