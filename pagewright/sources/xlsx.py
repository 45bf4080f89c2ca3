"""XLSX to primitives: a sheet is a page, a cell is a text in a grid."""

from __future__ import annotations

import dataclasses
import re
from xml.etree import ElementTree

from pagewright.functions import numfmt
from pagewright.sources.model import DecodeError, Decoded, Hint, Primitive, Warning_, nfc
from pagewright.sources.package import Package, attribute, child, children, local

_REF = re.compile(r"\$?([A-Za-z]{1,3})\$?([1-9][0-9]*)$")

#: Authors that stand for none, and what an old reader shows in place of a threaded comment.
NOBODY = frozenset(["", "author", "unknown", "none", "tc"])
STUB = ("threaded comment", ("your version of excel", "newer version of excel"))


def cell_ref(text: str) -> tuple[int, int] | None:
    """A1 to (row, column) from 0."""
    m = _REF.match(text.strip())
    if not m:
        return None
    col = 0
    for ch in m[1].upper():
        col = col * 26 + ord(ch) - 64
    return int(m[2]) - 1, col - 1


def cell_range(text: str) -> tuple[int, int, int, int] | None:
    """A1:B2, or one cell, to (top, left, bottom, right)."""
    first, _, last = text.partition(":")
    a, b = cell_ref(first), cell_ref(last or first)
    return (min(a[0], b[0]), min(a[1], b[1]), max(a[0], b[0]), max(a[1], b[1])) if a and b else None


def _strings(e: ElementTree.Element | None) -> str:
    """Text of runs, without phonetic guides."""
    out = []
    for c in e if e is not None else ():
        name = local(c.tag)
        if name == "t":
            out.append(c.text or "")
        elif name != "rPh":
            out.append(_strings(c))
    return "".join(out)


@dataclasses.dataclass
class _Area:
    """A named table of a sheet."""

    top: int
    left: int
    bottom: int
    right: int
    heads: int

    def holds(self, row: int, col: int) -> bool:
        return self.top <= row <= self.bottom and self.left <= col <= self.right


class _Book:
    def __init__(self, data: bytes):
        self.package = Package(data)
        book = self.package.xml("xl/workbook.xml")
        if book is None:
            raise DecodeError("no xl/workbook.xml")
        relations = self.package.relations("xl/workbook.xml")
        self.sheets = [
            (s.get("name", ""), relations.get(attribute(s, "id") or "", ("", "", False))[1])
            for s in children(child(book, "sheets"), "sheet")
        ]
        properties = child(book, "workbookPr")
        self.date_1904 = properties is not None and properties.get("date1904") in ("1", "true")
        strings = self.package.xml("xl/sharedStrings.xml", needed=False)
        self.strings = [_strings(s) for s in children(strings, "si")]
        styles = self.package.xml("xl/styles.xml", needed=False)
        own = {int(f.get("numFmtId", -1)): f.get("formatCode", "") for f in children(child(styles, "numFmts"), "numFmt")}
        self.codes = [
            own.get(i, numfmt.BUILTIN.get(i, "General"))
            for i in (int(x.get("numFmtId", 0)) for x in children(child(styles, "cellXfs"), "xf"))
        ]
        self.warnings = self.package.warnings

    def value(self, c: ElementTree.Element, sheet: str, page: int) -> str:
        kind, v, inline = c.get("t", "n"), child(c, "v"), child(c, "is")
        text = v.text or "" if v is not None else ""
        if child(c, "f") is not None and v is None and inline is None:
            self.warnings.append(Warning_("partial_extraction", f"a formula of sheet {sheet} has no stored value", page))
            return ""
        if kind == "s":
            if not text.strip().isdigit():
                self.warnings.append(Warning_("malformed_content", f"shared string {text!r} of sheet {sheet} is no number", page))
                return ""
            if int(text) >= len(self.strings):
                self.warnings.append(Warning_("partial_extraction", f"shared string {text} of sheet {sheet} does not exist", page))
                return ""
            return self.strings[int(text)]
        if kind == "inlineStr":
            return _strings(inline)
        if kind == "b":
            return {"1": "true", "0": "false"}.get(text, text)
        if kind == "e":
            return f"#ERR:{text}"
        if kind in ("str", "d"):
            return text
        style = c.get("s", "")
        code = self.codes[int(style)] if style.isdigit() and int(style) < len(self.codes) else "General"
        if not text or code.strip().lower() == "general" or code == "@":
            return text
        try:
            shown, trouble = numfmt.format_value(float(text), code, self.date_1904)
        except ValueError:
            self.warnings.append(Warning_("malformed_content", f"{text!r} of sheet {sheet} is no number", page))
            return text
        if trouble:
            self.warnings.append(Warning_("partial_extraction", f"{text} of sheet {sheet}: {trouble}", page))
        return shown

    def comments(self, relations: dict) -> dict[tuple[int, int], str]:
        """Notes by cell; a threaded comment stands before an old one."""
        people = self.package.xml("xl/persons/person.xml", needed=False)
        names = {p.get("id"): p.get("displayName", "") for p in children(people, "person")}
        old: dict[tuple[int, int], str] = {}
        threads: dict[tuple[int, int], list[str]] = {}
        for kind, target, external in relations.values():
            if external:
                continue
            if kind == "comments":
                root = self.package.xml(target)
                authors = [a.text or "" for a in children(child(root, "authors"), "author")]
                for c in children(child(root, "commentList"), "comment"):
                    at, who, text = cell_ref(c.get("ref", "")), c.get("authorId", ""), _strings(child(c, "text")).strip()
                    low = text.lower()
                    if at and text and not (STUB[0] in low and any(x in low for x in STUB[1])):
                        author = authors[int(who)] if who.isdigit() and int(who) < len(authors) else ""
                        old[at] = self.note(author, text)
            elif kind == "threadedComment":
                for c in children(self.package.xml(target), "threadedComment"):
                    at, text = cell_ref(c.get("ref", "")), (getattr(child(c, "text"), "text", "") or "").strip()
                    if at and text:
                        threads.setdefault(at, []).append(self.note(names.get(c.get("personId"), ""), text))
        return old | {at: " | ".join(x) for at, x in threads.items()}

    @staticmethod
    def note(author: str, text: str) -> str:
        author = author.strip()
        return text if author.lower() in NOBODY or author.lower().startswith("tc=") else f"{author}: {text}"

    def areas(self, relations: dict, page: int) -> list[_Area]:
        out = []
        for kind, target, _ in relations.values():
            root = self.package.xml(target, page) if kind == "table" else None
            bounds = cell_range(root.get("ref", "")) if root is not None else None
            if bounds:
                out.append(_Area(*bounds, int(root.get("headerRowCount", "1"))))
        return sorted(out, key=lambda a: (a.top, a.left))

    def sheet(self, page: int, name: str, path: str, order: int) -> list[Primitive]:
        root = self.package.xml(path, page)
        if root is None:
            return []
        relations = self.package.relations(path)
        notes, areas = self.comments(relations), self.areas(relations, page)
        merged = [r for m in children(child(root, "mergeCells"), "mergeCell") if (r := cell_range(m.get("ref", "")))]
        links = []
        for h in children(child(root, "hyperlinks"), "hyperlink"):
            bounds, at = cell_range(h.get("ref", "")), attribute(h, "id")
            target = relations[at][1] if at in relations else f"#{h.get('location')}" if h.get("location") else None
            if bounds and target:
                links.append((bounds, target))
            elif bounds:
                self.warnings.append(Warning_("unresolved_relationship", f"a link of sheet {name} leads nowhere", page))
        cells: dict[tuple[int, int], tuple[str, str | None]] = {}
        last = -1
        for r in children(child(root, "sheetData"), "row"):
            row = int(r.get("r")) - 1 if (r.get("r") or "").isdigit() else last + 1
            col, last = -1, row
            for c in children(r, "c"):
                if c.get("r") is not None:
                    at = cell_ref(c.get("r"))
                    if at is None:
                        raise DecodeError(f"{c.get('r')!r} is no cell")
                    row, col = at
                else:
                    col += 1
                cells[row, col] = (self.value(c, name, page), c.get("t"))
        rows = max([last + 1, *(r + 1 for r, _ in [*cells, *notes])], default=0)
        cols = max((c + 1 for _, c in [*cells, *notes]), default=0)
        if not rows or not cols:
            return []
        first = [kind for (r, _), (_, kind) in cells.items() if r == 0]
        heads = not areas and last > 0 and bool(first) and all(k in ("s", "str", "inlineStr") for k in first)
        if heads:
            self.warnings.append(Warning_("heuristic_inference", f"row 1 of sheet {name} is read as a header", page))
        out = []
        if name.strip():
            out.append(self.text(page, order, 0, 0, 1, 0, name, 14.0, True, [Hint("heading", level=1)]))
        covered = {(r, c) for a, b, d, e in merged for r in range(a, d + 1) for c in range(b, e + 1) if (r, c) != (a, b)}
        spans = {(a, b): (d - a + 1, e - b + 1) for a, b, d, e in merged}
        for (row, col) in [*cells, *sorted(k for k in notes if k not in cells)]:
            content, note = cells.get((row, col), ("", None))[0], notes.get((row, col))
            if not content and note is None or (row, col) in covered:
                continue
            if note:
                content = f"{content} [note: {note}]".strip().replace("\n", " ") if not content else f"{content} [note: {note.replace(chr(10), ' ')}]"
            high, wide = spans.get((row, col), (1, 1))
            area = next((a for a in areas if a.holds(row, col)), None)
            if area and row < area.top + area.heads:
                hints = [Hint("table_header", col=col - area.left)]
            elif area:
                hints = [Hint("table_cell", row=row - area.top, col=col - area.left, rowspan=high, colspan=wide)]
            elif heads and row == 0:
                hints = [Hint("table_header", col=col)]
            else:
                hints = [] if areas else [Hint("table_cell", row=row, col=col, rowspan=high, colspan=wide)]
            hints += [Hint("link", url=u) for (a, b, d, e), u in links if a <= row <= d and b <= col <= e][:1]
            bold = any(h.kind == "table_header" for h in hints)
            out.append(self.text(page, order + len(out), col / cols, row / rows, wide / cols, high / rows, content, 11.0, bold, hints))
        return out

    @staticmethod
    def text(page: int, order: int, x: float, y: float, w: float, h: float, content: str, size: float, bold: bool, hints: list) -> Primitive:
        return Primitive("text", page, order, x, y, w, h, nfc(content), size, "", bold, origin="reconstructed", space="logical_grid", hints=hints)


def decode(data: bytes) -> Decoded:
    """Hidden rows and columns are kept, booleans are lower case, and errors begin with #ERR:."""
    book = _Book(data)
    out: list[Primitive] = []
    for page, (name, path) in enumerate(book.sheets):
        out += book.sheet(page, name, path, len(out))
    return Decoded("xlsx", len(book.sheets), "workbook_sheets", None, False, out, book.warnings)
