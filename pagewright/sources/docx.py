"""DOCX to primitives: paragraphs, lists, tables and notes in story order."""

from __future__ import annotations

import dataclasses
import re
from xml.etree import ElementTree

from pagewright.sources.model import DecodeError, Decoded, Hint, Primitive, Warning_, nfc
from pagewright.sources.package import Package, attribute, child, children, local

#: Height of a paragraph, indent of a list level, deepest chain of styles.
STEP, INDENT, DEEPEST = 0.02, 0.03, 10

#: Numbering formats without a number, stories after the body in their order.
UNNUMBERED = frozenset(["bullet", "none"])
STORIES = {"header": "page_header", "footer": "page_footer", "footnotes": "footnote", "endnotes": "footnote", "comments": "sidebar"}
IMAGE_TYPES = {"png": "png", "jpg": "jpeg", "jpeg": "jpeg", "gif": "gif", "bmp": "bmp", "tif": "tiff", "tiff": "tiff"}


@dataclasses.dataclass
class _Style:
    name: str = ""
    level: int | None = None
    bold: bool = False
    italic: bool = False
    size: float | None = None
    list_id: str | None = None
    list_level: int | None = None


def _value(e: ElementTree.Element | None) -> str | None:
    return attribute(e, "val") if e is not None else None


def _on(e: ElementTree.Element | None) -> bool:
    return e is not None and (_value(e) or "1").lower() not in ("0", "false", "off")


class _Document:
    def __init__(self, data: bytes):
        self.package = Package(data)
        self.warnings = self.package.warnings
        self.said: set[str] = set()
        self.relations = self.package.relations("word/document.xml")
        self.styles = self._styles(self.package.xml("word/styles.xml", needed=False))
        self.numbering = self._numbering(self.package.xml("word/numbering.xml", needed=False))
        self.out: list[Primitive] = []
        self.page, self.y, self.story = 0, 0.0, None
        self.ids: dict[str, tuple] = self.relations

    def warn(self, kind: str, key: str, message: str) -> None:
        if key not in self.said:
            self.said.add(key)
            self.warnings.append(Warning_(kind, message, self.page))

    def _styles(self, root: ElementTree.Element | None) -> dict[str, _Style]:
        raw = {attribute(s, "styleId"): s for s in children(root, "style")}

        def resolve(key: str, depth: int) -> _Style:
            s = raw.get(key)
            if s is None or depth > DEEPEST:
                return _Style()
            based = _value(child(s, "basedOn"))
            base = resolve(based, depth + 1) if based and based != key else _Style()
            outline = _value(child(s, "pPr", "outlineLvl"))
            run, numbers = child(s, "rPr"), child(s, "pPr", "numPr")
            size = _value(child(run, "sz"))
            return _Style(
                _value(child(s, "name")) or "",
                int(outline) if outline and outline.isdigit() else base.level,
                _on(child(run, "b")) if child(run, "b") is not None else base.bold,
                _on(child(run, "i")) if child(run, "i") is not None else base.italic,
                float(size) / 2 if size else base.size,
                _value(child(numbers, "numId")) or base.list_id,
                int(_value(child(numbers, "ilvl")) or 0) if numbers is not None else base.list_level,
            )

        return {k: resolve(k, 0) for k in raw if k}

    def _numbering(self, root: ElementTree.Element | None) -> dict[tuple[str, int], bool]:
        """(list, level) to whether its items are numbered."""
        kinds = {
            attribute(a, "abstractNumId"): {
                int(attribute(x, "ilvl") or 0): (_value(child(x, "numFmt")) or "decimal") not in UNNUMBERED for x in children(a, "lvl")
            }
            for a in children(root, "abstractNum")
        }
        out = {}
        for n in children(root, "num"):
            key, of = attribute(n, "numId"), _value(child(n, "abstractNumId"))
            if of not in kinds:
                self.warnings.append(Warning_("unresolved_style", f"numbering {key} names no definition", None))
            for level, ordered in kinds.get(of, {}).items():
                out[key, level] = ordered
        return out

    def level(self, style: _Style | None) -> int | None:
        if style is None:
            return None
        if style.level is not None and style.level < 9:
            return min(style.level + 1, 6)
        name = style.name.lower()
        digits = re.sub("[^0-9]", "", name) if name.startswith(("heading", "titre")) else ""
        if digits:
            self.warn("heuristic_inference", f"style:{name}", f"style {style.name} is read as a heading by its name")
        return min(max(int(digits), 1), 6) if digits else None

    def emit(self, text: str, hints: list[Hint], left: float = 0.0, size: float = 11.0, bold=False, italic=False, **more) -> None:
        kind = more.pop("kind", "text")
        self.out.append(
            Primitive(
                kind, self.page, len(self.out), left, min(self.y, 1.0), 1.0 - left, STEP, nfc(text), size, "", bold, italic,
                origin="reconstructed", space="logical_page", hints=hints, **more,
            )
        )
        self.y += STEP

    def runs(self, p: ElementTree.Element) -> tuple[str, list[tuple[str, bool, bool]], list[str], list]:
        """Text of a paragraph, its runs with bold and italic, link targets, and pictures."""
        text: list[str] = []
        runs, links, pictures = [], [], []

        def walk(e: ElementTree.Element) -> None:
            for c in e:
                name = local(c.tag)
                if name in ("del", "moveFrom"):
                    self.warn("tracked_change_resolved", f"del:{self.story}", "deleted text is left out")
                elif name in ("ins", "moveTo"):
                    self.warn("tracked_change_resolved", f"ins:{self.story}", "inserted text is taken in")
                    walk(c)
                elif name == "hyperlink":
                    at = attribute(c, "id")
                    target = self.ids.get(at, (None, None, None))[1] if at else None
                    anchor = attribute(c, "anchor")
                    if target or anchor:
                        links.append(target or f"#{anchor}")
                    else:
                        self.warn("unresolved_relationship", f"link:{at}", f"link {at} leads nowhere")
                    walk(c)
                elif name == "r":
                    start, properties = len(text), child(c, "rPr")
                    for x in c:
                        kind = local(x.tag)
                        if kind == "t":
                            text.append(x.text or "")
                        elif kind == "tab":
                            text.append("\t")
                        elif kind in ("br", "cr"):
                            if attribute(x, "type") == "page":
                                self.page, self.y = self.page + 1, 0.0
                            else:
                                text.append("\n")
                        elif kind == "lastRenderedPageBreak":
                            self.rendered += 1
                        elif kind in ("footnoteReference", "endnoteReference"):
                            text.append(f"[{attribute(x, 'id')}]")
                        elif kind in ("drawing", "pict", "object"):
                            pictures.append(x)
                        elif kind == "AlternateContent":
                            pictures.extend(d for d in x.iter() if local(d.tag) in ("drawing", "pict"))
                    made = "".join(text[start:])
                    if made:
                        runs.append((made, _on(child(properties, "b")), _on(child(properties, "i"))))
                elif name in ("smartTag", "sdt", "sdtContent", "fldSimple", "customXml"):
                    walk(c)
                elif name == "oMath" or name == "oMathPara":
                    self.warn("unsupported_element", "math", "formulas are left out")

        walk(p)
        return "".join(text), runs, links, pictures

    rendered = 0

    def paragraph(self, p: ElementTree.Element, cell: Hint | None = None) -> None:
        properties = child(p, "pPr")
        key = _value(child(properties, "pStyle"))
        style = self.styles.get(key) if key else None
        if key and style is None:
            self.warn("unresolved_style", f"style:{key}", f"style {key} does not exist")
        text, runs, links, pictures = self.runs(p)
        for x in pictures:
            self.picture(x)
        if not text.strip():
            return
        numbers = child(properties, "numPr")
        list_id = _value(child(numbers, "numId")) or (style.list_id if style else None)
        depth = int(_value(child(numbers, "ilvl")) or (style.list_level if style and style.list_level else 0) or 0)
        level, left = self.level(style), 0.0
        if cell is not None:
            hint = dataclasses.replace(cell)
        elif self.story:
            hint = Hint(STORIES[self.story], text=self.note)
        elif level:
            hint = Hint("heading", level=level)
        elif list_id and list_id != "0":
            if (list_id, depth) not in self.numbering:
                self.warn("unresolved_style", f"list:{list_id}:{depth}", f"list {list_id} has no level {depth}")
            hint = Hint("list_item", depth=depth, ordered=self.numbering.get((list_id, depth), False))
            left = INDENT * (depth + 1)
        else:
            hint = Hint("paragraph")
        bold = bool(runs) and all(b or bool(style and style.bold) for _, b, _ in runs)
        italic = bool(runs) and all(i or bool(style and style.italic) for _, _, i in runs)
        hints = [hint, *[Hint("link", url=u) for u in dict.fromkeys(links)]]
        size = style.size if style and style.size else {1: 24.0, 2: 20.0, 3: 16.0}.get(level, 11.0)
        self.emit(text.strip(), hints, left, size, bold or bool(level), italic)

    note: str | None = None

    def picture(self, x: ElementTree.Element) -> None:
        alt = next((attribute(d, "descr") or attribute(d, "title") for d in x.iter() if local(d.tag) == "docPr"), None)
        at = next((attribute(d, "embed") or attribute(d, "id") for d in x.iter() if local(d.tag) in ("blip", "imagedata")), None)
        target = self.ids.get(at, (None, None, None))[1] if at else None
        if target is None or target not in self.package.names:
            self.warn("missing_media", f"image:{at}", f"image {at} is missing")
            return
        kind = IMAGE_TYPES.get(target.rpartition(".")[2].lower(), "unknown")
        self.out.append(
            Primitive(
                "image", self.page, len(self.out), 0.0, min(self.y, 1.0), 1.0, STEP, None, None, kind,
                data=self.package.read(target, self.page), alt_text=alt, origin="reconstructed", space="logical_page",
            )
        )
        self.y += STEP

    def table(self, t: ElementTree.Element) -> None:
        """Cells with their spans; a vertical merge counts the rows that go on with it. Inner tables are read as text."""
        grid: list[list[list]] = []
        open_at: dict[int, list] = {}
        for row, r in enumerate(children(t, "tr")):
            grid.append([])
            col = int(_value(child(r, "trPr", "gridBefore")) or 0)
            head = _on(child(r, "trPr", "tblHeader"))
            for c in children(r, "tc"):
                wide = max(int(_value(child(c, "tcPr", "gridSpan")) or 1), 1)
                merge = child(c, "tcPr", "vMerge")
                if merge is not None and (_value(merge) or "continue") == "continue" and col in open_at:
                    open_at[col][1].rowspan += 1
                else:
                    hint = Hint("table_header", col=col) if head and row == 0 else Hint("table_cell", row=row, col=col, rowspan=1, colspan=wide)
                    hint.rowspan = hint.rowspan or 1
                    entry = [c, hint]
                    grid[-1].append(entry)
                    open_at.pop(col, None)
                    if merge is not None:
                        open_at[col] = entry
                col += wide
        for r in grid:
            for c, hint in r:
                for p in c.iter():
                    if local(p.tag) == "p":
                        self.paragraph(p, hint)
                    elif local(p.tag) == "tbl":
                        self.warn("partial_extraction", "inner_table", "a table within a cell is read as its text")

    def body(self, e: ElementTree.Element | None) -> None:
        for c in e if e is not None else ():
            name = local(c.tag)
            if name == "p":
                self.paragraph(c)
            elif name == "tbl":
                self.table(c)
            elif name == "sdt":
                self.body(child(c, "sdtContent"))
            elif name in ("ins", "customXml", "smartTag"):
                self.body(c)

    def stories(self) -> None:
        parts = sorted(
            ((list(STORIES).index(kind), target, kind) for kind, target, external in self.relations.values() if kind in STORIES and not external)
        )
        for _, target, kind in parts:
            root = self.package.xml(target)
            self.story, self.ids, self.note = kind, self.package.relations(target), None
            if kind in ("header", "footer"):
                self.body(root)
            else:
                for n in root if root is not None else ():
                    if attribute(n, "type") in (None, "normal"):
                        self.note = attribute(n, "id")
                        self.body(n)
        self.story, self.note = None, None

    def pages(self) -> tuple[int, str]:
        """Pages by layout marks, else by breaks, else by the application's own count; never fewer than were seen."""
        app = self.package.xml("docProps/app.xml", needed=False)
        stated = getattr(child(app, "Pages"), "text", None) if app is not None else None
        seen = self.page + 1
        if self.rendered:
            return max(self.rendered + 1, seen), "rendered_page_breaks"
        if self.page:
            return seen, "explicit_breaks"
        if stated and stated.strip().isdigit():
            return max(int(stated), seen), "application_metadata"
        return seen, "single_logical_page"


def decode(data: bytes) -> Decoded:
    d = _Document(data)
    root = d.package.xml("word/document.xml")
    if root is None:
        raise DecodeError("no word/document.xml")
    d.body(child(root, "body"))
    count, basis = d.pages()
    d.stories()
    core = d.package.xml("docProps/core.xml", needed=False)
    title = next((e.text for e in core if local(e.tag) == "title"), None) if core is not None else None
    return Decoded("docx", count, basis, (title or "").strip() or None, False, d.out, d.warnings)
