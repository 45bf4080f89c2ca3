"""Office and PDF files made of table rows, as inputs of queries whose right answers the rows tell."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OFFICE = "http://schemas.openxmlformats.org"
_WORD = f'xmlns:w="{_OFFICE}/wordprocessingml/2006/main" xmlns:r="{_OFFICE}/officeDocument/2006/relationships"'
_SHEET = f'xmlns="{_OFFICE}/spreadsheetml/2006/main" xmlns:r="{_OFFICE}/officeDocument/2006/relationships"'


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def _relations(items: list[tuple[str, str, str]]) -> str:
    rows = "".join(
        f'<Relationship Id="{i}" Type="x/{kind}" Target="{target}"{" TargetMode='External'" if "://" in target else ""}/>'
        for i, kind, target in items
    )
    return f'<Relationships xmlns="{_OFFICE}/package/2006/relationships">{rows}</Relationships>'


def workbook(doc: int, rows: list[dict]) -> bytes:
    """Two sheets: accounts with cells of every type, links and notes; and a sheet of merged cells and a formula.

    Odd documents count days from 1904.
    """
    heads = ["Key", "Name", "Balance", "Since", "Active", "Segment"]
    shared = [*heads, *[r["name"] for r in rows]]
    cell = "".join
    lines = ['<row r="1">' + cell(f'<c r="{"ABCDEF"[i]}1" t="s"><v>{i}</v></c>' for i in range(6)) + "</row>"]
    for i, r in enumerate(rows):
        n = i + 2
        lines.append(
            f'<row r="{n}"><c r="A{n}"><v>{r["key"]}</v></c><c r="B{n}" t="s"><v>{i + 6}</v></c><c r="C{n}" s="2"><v>{r["balance"]!r}</v></c>'
            f'<c r="D{n}" s="1"><v>{36526 + r["key"] % 1000}</v></c><c r="E{n}" t="b"><v>{int(r["balance"] > 0)}</v></c>'
            f'<c t="inlineStr"><is><t>{escape(r["segment"])}</t></is></c></row>'
        )
    linked = [(i + 2, r["key"]) for i, r in enumerate(rows) if r["key"] % 5 == 0]
    noted = [(i + 2, r["key"]) for i, r in enumerate(rows) if r["key"] % 7 == 0]
    links = cell(f'<hyperlink ref="B{n}" r:id="l{k}"/>' for n, k in linked)
    notes = cell(f'<comment ref="C{n}" authorId="{k % 2}"><text><r><t>check </t></r><r><t>{k}</t></r></text></comment>' for n, k in noted)
    return _zipped(
        {
            "xl/workbook.xml": f'<workbook {_SHEET}><workbookPr date1904="{doc % 2}"/><sheets><sheet name="Accounts" r:id="a"/><sheet name="Sums" r:id="b"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": _relations([("a", "worksheet", "worksheets/s1.xml"), ("b", "worksheet", "worksheets/s2.xml")]),
            "xl/sharedStrings.xml": f"<sst {_SHEET}>{cell(f'<si><t>{escape(x)}</t></si>' for x in shared)}</sst>",
            "xl/styles.xml": f'<styleSheet {_SHEET}><numFmts><numFmt numFmtId="200" formatCode="yyyy-mm-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="200"/><xf numFmtId="4"/></cellXfs></styleSheet>',
            "xl/worksheets/s1.xml": f"<worksheet {_SHEET}><sheetData>{cell(lines)}</sheetData>{f'<hyperlinks>{links}</hyperlinks>' if links else ''}</worksheet>",
            "xl/worksheets/_rels/s1.xml.rels": _relations([("c", "comments", "../c.xml"), *[(f"l{k}", "hyperlink", f"http://x.y/{k}") for _, k in linked]]),
            "xl/c.xml": f"<comments {_SHEET}><authors><author>Ann</author><author>Author</author></authors><commentList>{notes}</commentList></comments>",
            "xl/worksheets/s2.xml": f'<worksheet {_SHEET}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>Total</t></is></c><c r="C1"><v>{len(rows)}</v></c></row>'
            f'<row r="2"><c r="C2" t="str"><f>C1</f><v>n {len(rows)}</v></c></row><row r="3"><c r="A3" t="e"><v>N/A</v></c><c r="C3"><f>C2</f></c></row></sheetData>'
            '<mergeCells count="1"><mergeCell ref="A1:B2"/></mergeCells></worksheet>',
        }
    )


def report(doc: int, rows: list[dict]) -> bytes:
    """A heading through an inherited style, and for each row a paragraph with changes, a link and a note, a numbered item and
    a line of a table; ten rows a page."""
    run = lambda text, more="": f"<w:r>{f'<w:rPr>{more}</w:rPr>' if more else ''}<w:t xml:space='preserve'>{escape(text)}</w:t></w:r>"
    body = [f'<w:p><w:pPr><w:pStyle w:val="K"/></w:pPr>{run(f"Report {doc}")}</w:p>']
    links, notes = [], []
    for i, r in enumerate(rows):
        key = r["key"]
        if i and i % 10 == 0:
            body.append('<w:p><w:r><w:br w:type="page"/></w:r></w:p>')
        said = f"<w:del><w:r><w:delText>old</w:delText></w:r></w:del><w:ins>{run('new ')}</w:ins>" if key % 3 == 0 else ""
        mark = f'<w:r><w:footnoteReference w:id="{key + 1}"/></w:r>' if key % 4 == 0 else ""
        if key % 4 == 0:
            notes.append(f'<w:footnote w:id="{key + 1}"><w:p>{run(f"note {key}")}</w:p></w:footnote>')
        body.append(f"<w:p>{said}{run(r['name'], '<w:b/>')}{mark}</w:p>")
        if key % 5 == 0:
            links.append((f"l{key}", "hyperlink", f"http://x.y/{key}"))
            body.append(f'<w:p><w:hyperlink r:id="l{key}">{run(f"see {key}")}</w:hyperlink></w:p>')
        body.append(f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{key % 2}"/><w:numId w:val="5"/></w:numPr></w:pPr>{run(f"item {key}")}</w:p>')
    lines = "".join(
        f"<w:tr><w:tc><w:p>{run(r['name'])}</w:p></w:tc><w:tc><w:tcPr><w:gridSpan w:val='{2 - r['key'] % 2}'/></w:tcPr><w:p>{run(str(r['key']))}</w:p></w:tc>"
        + (f"<w:tc><w:p>{run('odd')}</w:p></w:tc>" if r["key"] % 2 else "") + "</w:tr>"
        for r in rows
    )
    return _zipped(
        {
            "word/document.xml": f"<w:document {_WORD}><w:body>{''.join(body)}<w:tbl>{lines}</w:tbl></w:body></w:document>",
            "word/_rels/document.xml.rels": _relations([*links, ("n", "footnotes", "footnotes.xml")]),
            "word/footnotes.xml": f'<w:footnotes {_WORD}><w:footnote w:type="separator" w:id="0"><w:p/></w:footnote>{"".join(notes)}</w:footnotes>',
            "word/styles.xml": f'<w:styles {_WORD}><w:style w:styleId="H"><w:name w:val="x"/><w:pPr><w:outlineLvl w:val="1"/></w:pPr></w:style><w:style w:styleId="K"><w:name w:val="y"/><w:basedOn w:val="H"/></w:style></w:styles>',
            "word/numbering.xml": f'<w:numbering {_WORD}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:num w:numId="5"><w:abstractNumId w:val="0"/></w:num></w:numbering>',
        }
    )


def _show(x: float, y: float, size: int, text: str, font: str = "F1") -> str:
    shown = text.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")
    return f"BT /{font} {size} Tf {x} {y} Td ({shown}) Tj ET "


def _pdf(pages: list[tuple[str, str]]) -> bytes:
    """A file of pages of 600 by 800 points, each (content, more entries of its dictionary)."""
    n = len(pages)
    objects = [
        "<< /Type /Catalog /Pages 2 0 R >>",
        f"<< /Type /Pages /Kids [{' '.join(f'{5 + 2 * k} 0 R' for k in range(n))}] /Count {n} /MediaBox [0 0 600 800] >>",
        "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
        "<< /Type /Font /Subtype /Type1 /BaseFont /ABCDEF+Helvetica-Bold >>",
    ]
    for k, (body, extra) in enumerate(pages):
        objects.append(f"<< /Type /Page /Parent 2 0 R /Contents {6 + 2 * k} 0 R /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> {extra} >>")
        objects.append(f"<< /Length {len(body)} >>\nstream\n{body}\nendstream")
    made = "%PDF-1.4\n" + "".join(f"{i + 1} 0 obj\n{x}\nendobj\n" for i, x in enumerate(objects)) + "trailer << /Root 1 0 R >>\n%%EOF"
    return made.encode("latin-1")


def _ruled(rows: list[tuple[str, str]]) -> str:
    """A ruled table of two columns from y = 700 down, 20 points a row."""
    line = lambda x0, y0, x1, y1: f"{x0} {y0} m {x1} {y1} l S "
    low = 700 - 20 * len(rows)
    rules = [line(60, 700 - 20 * k, 540, 700 - 20 * k) for k in range(len(rows) + 1)] + [line(x, low, x, 700) for x in (60, 300, 540)]
    cells = [_show(66, 686 - 20 * k, 10, a) + _show(306, 686 - 20 * k, 10, b) for k, (a, b) in enumerate(rows)]
    return "".join(rules + cells)


def _paged(rows: list[dict], most: int = 20) -> list[list[dict]]:
    return [rows[i : i + most] for i in range(0, len(rows), most)]


def statement(doc: int, rows: list[dict]) -> bytes:
    """Pages of a large heading with a link, a line of text, a ruled table of two columns and a page number."""
    pages = []
    for number, some in enumerate(_paged(rows), 1):
        body = _show(60, 760, 24, f"Accounts {doc}", "F2") + _show(60, 730, 10, f"Page for document {doc} follows here.")
        body += _ruled([(r["name"], f"{r['balance']:.2f}") for r in some]) + _show(290, 30, 10, str(number))
        pages.append((body, f"/Annots [<< /Subtype /Link /Rect [55 755 400 785] /A << /URI (http://x.y/{doc}/{number}) >> >>]"))
    return _pdf(pages)


def ledger(doc: int, rows: list[dict]) -> bytes:
    """One ruled table over all pages, its header row again on each."""
    heads = ("Name", "Balance")
    return _pdf([(_ruled([heads, *[(r["name"], f"{r['balance']:.2f}") for r in some]]), "") for some in _paged(rows)])


def banner(doc: int, rows: list[dict]) -> bytes:
    """A ruled table on each page whose first row is one cell over both columns."""
    pages = []
    for number, some in enumerate(_paged(rows), 1):
        line = lambda x0, y0, x1, y1: f"{x0} {y0} m {x1} {y1} l S "
        rules = line(60, 720, 540, 720) + line(60, 720, 60, 700) + line(540, 720, 540, 700)
        pages.append((rules + _show(66, 706, 10, f"Accounts {doc}, page {number}") + _ruled([(r["name"], f"{r['balance']:.2f}") for r in some]), ""))
    return _pdf(pages)


def listing(doc: int, rows: list[dict]) -> bytes:
    """Lines of key, name and balance without rules; every fifth line has no balance."""
    pages = []
    for some in _paged(rows):
        shown = [(700 - 20 * k, r, k % 5 == 3) for k, r in enumerate(some)]
        pages.append(("".join(
            _show(60, y, 10, str(r["key"])) + _show(200, y, 10, r["name"]) + ("" if bare else _show(400, y, 10, f"{r['balance']:.2f}")) for y, r, bare in shown
        ), ""))
    return _pdf(pages)


def essay(doc: int, rows: list[dict]) -> bytes:
    """One paragraph over all pages, a line for each row; on the last page another one after a gap."""
    pages = []
    for number, some in enumerate(parts := _paged(rows)):
        lines = "".join(_show(60, 700 - 12 * k, 10, f"and account {r['key']:012d} of {r['name']}") for k, r in enumerate(some))
        pages.append((lines + (_show(60, 200, 10, "The end.") if number == len(parts) - 1 else ""), ""))
    return _pdf(pages)


def made(rows: DataFrame, make: Callable[[int, list[dict]], bytes]) -> DataFrame:
    """doc_id, content: a file for each doc_id of rows (doc_id, key, name, balance, segment), its rows in order of key."""
    parts = F.array_sort(F.collect_list(F.struct("key", "name", "balance", "segment")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, held = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([make(*x) for x in zip(docs, held)], pa.binary())], ["doc_id", "content"])

    return rows.groupBy("doc_id").agg(parts.alias("r")).mapInArrow(run, "doc_id long, content binary")
