"""HTML to primitives: a forgiving tree, then a walk over its visible blocks in document order."""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pagewright.sources.model import DecodeError, Decoded, Hint, Primitive, Warning_, nfc

#: Elements without content, without visible text, and those whose text is no part of the text around.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript svg template iframe object embed applet link meta head".split())
APART = frozenset("ul ol dl table details".split())
CONTAINERS = frozenset("html body div main header footer aside nav form".split())
SPEAKS_FOR_ITSELF = frozenset(
    "h1 h2 h3 h4 h5 h6 p blockquote pre li dt dd td th a article section img summary".split()
)
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split()
)
HEADING_SIZES = {1: 24.0, 2: 20.0, 3: 16.0, 4: 14.0, 5: 12.0, 6: 11.0}
SILENT_INPUTS = frozenset("hidden checkbox radio submit reset button image file".split())
LIST_STYLES = {
    **dict.fromkeys("disc circle square none disclosure-open disclosure-closed".split(), False),
    **dict.fromkeys(
        "decimal decimal-leading-zero lower-roman upper-roman lower-alpha upper-alpha lower-latin upper-latin lower-greek "
        "armenian georgian".split(),
        True,
    ),
}
ARIA = {
    "list": "list", "listitem": "item", "table": "table", "grid": "table", "treegrid": "table", "rowgroup": "group",
    "row": "row", "columnheader": "head_cell", "cell": "cell", "gridcell": "cell", "rowheader": "cell",
}
DISPLAY = {
    "list-item": "item", "table": "table", "inline-table": "table", "table-header-group": "head_group",
    "table-row-group": "group", "table-footer-group": "group", "table-caption": "caption", "table-row": "row",
    "table-cell": "cell",
}
TAGS = {
    "ul": "list", "ol": "ordered_list", "li": "item", "table": "table", "thead": "head_group", "tbody": "group",
    "tfoot": "group", "caption": "caption", "tr": "row", "td": "cell", "th": "head_cell",
}
NOTES = {
    "heading": "heading", "paragraph": "paragraph", "blockquote": "block_quote", "code": "code_block", "note": "sidebar",
    "doc-note": "sidebar", "complementary": "sidebar",
}
UNSUPPORTED_DISPLAY = frozenset("flex inline-flex grid inline-grid contents".split())

#: Height of a block in a page that has no layout, deepest element that is read, widest span of a cell.
STEP, DEEPEST, WIDEST = 0.02, 128, 256

#: What a block is and how it is set: kind, left edge, size, font, bold, italic.
_SET = {
    "paragraph": ("paragraph", 0.0, 11.0, "", False, False),
    "summary": ("paragraph", 0.0, 11.0, "", True, False),
    "block_quote": ("block_quote", 0.05, 11.0, "", False, True),
    "code_block": ("code_block", 0.0, 10.0, "monospace", False, False),
    "sidebar": ("sidebar", 0.03, 11.0, "", False, False),
}
_BLOCK_TAGS = {
    "p": "paragraph", "blockquote": "block_quote", "pre": "code_block", "summary": "summary", "label": "paragraph",
    "button": "paragraph",
}

RTL = re.compile("[֐-ࣿיִ-﷿ﹰ-﻿]")


class Element:
    __slots__ = ("attrs", "children", "style", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []
        self.style = list(_declarations(self.attrs.get("style")))

    def elements(self) -> Iterator[Element]:
        return (c for c in self.children if isinstance(c, Element))


def _declarations(style: str | None) -> Iterator[tuple[str, str]]:
    for part in (style or "").split(";"):
        name, colon, value = part.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        if colon and name and value:
            yield name, value


class _Tree(HTMLParser):
    """Builds the tree and supplies the end tags that writers leave out."""

    #: A start tag ends these open elements, up to the nearest of the fences.
    ENDS = {
        "li": ({"li"}, {"ul", "ol", "menu"}),
        "dt": ({"dt", "dd"}, {"dl"}),
        "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}),
        "th": ({"td", "th"}, {"tr", "table"}),
        "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
        "option": ({"option"}, {"select", "datalist"}),
        "optgroup": ({"option", "optgroup"}, {"select"}),
    }
    ENDS["thead"] = ENDS["tfoot"] = ENDS["tbody"]
    FENCES = frozenset("table td th caption html body button object".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root, self.body, self.head = Element("html"), Element("body"), Element("head")
        self.root.children = [self.head, self.body]
        self.open = [self.body]
        self.in_head = True  # until an element or text that belongs in the body

    def _close(self, names: set[str] | frozenset[str], fences: set[str] | frozenset[str]) -> bool:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in names:
                del self.open[i:]
                return True
            if self.open[i].tag in fences:
                return False
        return False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        held = {k: v or "" for k, v in reversed(attrs)}
        if tag in ("html", "body", "head"):
            if tag == "head":
                self.in_head = True
            else:
                self.in_head = self.in_head and tag == "html"
                target = self.root if tag == "html" else self.body
                target.attrs = held | target.attrs
                target.style = list(_declarations(target.attrs.get("style")))
            return
        if self.in_head and tag not in ("title", "meta", "link", "style", "script", "base", "noscript", "template"):
            self.in_head = False
            self.open = [self.body]
        if tag in ENDS_PARAGRAPH:
            self._close({"p"}, self.FENCES)
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and self.open[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.open.pop()
        if tag in self.ENDS:
            names, fences = self.ENDS[tag]
            while self._close(names, fences):
                pass
        element = Element(tag, held)
        parent = self.head if self.in_head and len(self.open) == 1 else self.open[-1]
        parent.children.append(element)
        if tag not in VOID:
            self.open.append(element)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and len(self.open) > 1 and self.open[-1].tag == tag and tag in ("svg", "path", "g", "use"):
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag == "head":
            self.in_head, self.open = False, [self.body]
        elif tag in ("html", "body"):
            self.in_head = False
        elif tag == "table":
            self._close({"table"}, set())
        else:
            self._close({tag}, self.FENCES - {tag})

    def handle_data(self, data: str) -> None:
        if self.in_head and len(self.open) == 1:
            if not data.strip():
                return
            self.in_head = False
        self.open[-1].children.append(data)


def parse(text: str) -> Element:
    tree = _Tree()
    tree.feed(text)
    tree.close()
    return tree.root


def _hidden(e: Element) -> bool:
    out = "hidden" in e.attrs
    for name, value in e.style:
        out |= (name, value) in (("display", "none"), ("visibility", "hidden"), ("visibility", "collapse"), ("content-visibility", "hidden"))
    return out


def _role(e: Element) -> str | None:
    """list, item, table, ... by ARIA role, or by CSS display; not by the tag."""
    named = ARIA.get(e.attrs.get("role", "").strip().lower())
    return named or DISPLAY.get(dict(e.style).get("display", ""))


def _note(e: Element) -> str | None:
    return NOTES.get(e.attrs.get("role", "").strip().lower())


def _space(e: Element, inherited: str) -> str:
    if e.tag == "pre":
        return "keep"
    for name, value in e.style:
        if name == "white-space":
            inherited = {
                "pre": "keep", "pre-wrap": "keep", "break-spaces": "keep", "pre-line": "lines", "normal": "join", "nowrap": "join",
            }.get(value, inherited)
    return inherited


class _Text:
    """Collects text under the white-space rule that holds where it stands."""

    def __init__(self):
        self.parts: list[str] = []
        self.last = ""

    def add(self, text: str, mode: str) -> None:
        if mode == "keep":
            made = text
        else:
            # Runs of white space become one space; "lines" keeps line breaks, one for each run of them.
            pattern = r"\s+" if mode == "join" else r"[^\S\r\n]+"
            made = re.sub(pattern, " ", text)
            if mode == "lines":
                made = re.sub(r"[\r\n]+", "\n", made)
            if made[:1] == " " and self.last == " " or made[:1] == "\n" and self.last == "\n" and mode == "lines":
                made = made[1:]
        if made:
            self.parts.append(made)
            self.last = made[-1]

    def line_break(self) -> None:
        if self.last != "\n":
            self.parts.append("\n")
            self.last = "\n"

    def read(self, e: Element, mode: str, inline: bool) -> None:
        for child in e.children:
            if isinstance(child, str):
                self.add(child, mode)
            elif child.tag in UNSEEN or _hidden(child):
                continue
            elif child.tag == "br":
                self.line_break()
            elif child.tag in APART or _role(child):
                continue
            elif inline and (child.tag in SPEAKS_FOR_ITSELF or child.tag in CONTAINERS):
                continue
            else:
                self.read(child, _space(child, mode), inline)


def _text(e: Element, mode: str, inline: bool = False) -> str:
    held = _Text()
    held.read(e, mode, inline)
    made = nfc("".join(held.parts))
    return made if mode == "keep" else made.strip()


@dataclasses.dataclass(frozen=True)
class _Context:
    lang: str | None = None
    direction: str = "ltr"
    auto: bool = False
    space: str = "join"
    ordered: bool | None = None


class _Table:
    def __init__(self):
        self.row = self.col = 0
        self.head = False
        self.taken: set[tuple[int, int]] = set()

    def skip(self) -> None:
        while (self.row, self.col) in self.taken:
            self.col += 1


class _Walk:
    def __init__(self):
        self.out: list[Primitive] = []
        self.warnings: list[Warning_] = []
        self.order, self.y, self.depth = 0, 0.0, 0
        self.lists: list[bool] = []
        self.tables: list[_Table] = []
        self.said: set[str] = set()

    def warn(self, kind: str, key: str, message: str) -> None:
        if key not in self.said:
            self.said.add(key)
            self.warnings.append(Warning_(kind, message, 0))

    def emit(self, text: str, c: _Context, hint: Hint | None, left=0.0, size=11.0, font="", bold=False, italic=False, height=STEP, step=True, **more) -> None:
        direction = c.direction
        if c.auto and direction != "ttb":
            rtl, ltr = bool(RTL.search(text)), any(ch.isalpha() and not RTL.match(ch) for ch in text)
            direction = "mixed" if rtl and ltr else "rtl" if rtl else "ltr" if ltr else direction
        # A block with a margin on both sides keeps it on both.
        width = {0.05: 0.9, 0.03: 0.94}.get(left, 1.0 - left) if hint and hint.kind in ("block_quote", "sidebar") else 1.0 - left
        self.out.append(
            Primitive(
                more.pop("kind", "text"), 0, self.order, left, self.y, width, height, text, size, font, bold, italic,
                direction, c.lang, hints=[hint] if hint else [], **more,
            )
        )
        self.order += 1
        if step:
            self.y += STEP

    def block(self, text: str, c: _Context, name: str) -> None:
        if text:
            kind, left, size, font, bold, italic = _SET[name]
            self.emit(text, c, Hint(kind), left, size, font, bold, italic)

    def heading(self, text: str, c: _Context, level: int) -> None:
        if text:
            self.emit(text, c, Hint("heading", level=level), size=HEADING_SIZES[level], bold=True)

    def item(self, text: str, c: _Context) -> None:
        if text:
            depth = max(len(self.lists) - 1, 0)
            ordered = self.lists[-1] if self.lists else bool(c.ordered)
            self.emit(text, c, Hint("list_item", depth=depth, ordered=ordered), left=0.03 * (depth + 1))

    def context(self, e: Element, c: _Context) -> _Context:
        direction, auto, ordered = c.direction, c.auto, c.ordered
        lang = e.attrs.get("lang", "").strip() or c.lang
        named = e.attrs.get("dir", "").strip().lower()
        if named in ("rtl", "ltr"):
            direction, auto = named, False
        elif named == "auto":
            auto = True
        elif named:
            self.warn("unsupported_element", f"dir:{named}", f"dir={named} is not supported")
        for name, value in e.style:
            if name == "direction" and value in ("rtl", "ltr"):
                direction, auto = value, False
            elif name == "writing-mode" and value in ("vertical-rl", "vertical-lr", "tb", "tb-rl"):
                direction, auto = "ttb", False
            elif name == "writing-mode" and value == "horizontal-tb":
                direction, auto = "ltr", False
            elif name == "list-style-type" and value in LIST_STYLES:
                ordered = LIST_STYLES[value]
            elif (
                name == "direction"
                or name == "writing-mode" and value.startswith("sideways")
                or name == "display" and value in UNSUPPORTED_DISPLAY
                or name == "position" and value != "static"
                or name in ("float", "transform") and value != "none"
                or name in ("column-count", "column-width", "columns", "list-style-type")
            ):
                self.warn("unsupported_element", f"{name}:{value}", f"CSS {name}:{value} is not rendered")
        return _Context(lang, direction, auto, _space(e, c.space), ordered)

    def children(self, e: Element, c: _Context) -> None:
        for child in e.elements():
            self.node(child, c)

    def node(self, e: Element, outer: _Context) -> None:
        if self.depth >= DEEPEST:
            self.warn("truncated_content", "depth", f"elements deeper than {DEEPEST} are left out")
            return
        if e.tag in UNSEEN or _hidden(e):
            return
        self.depth += 1
        c = self.context(e, outer)
        role = _role(e)
        if role:
            if e.attrs.get("role", "").strip().lower() not in ARIA:
                shown = dict(e.style)["display"]
                self.warn("heuristic_inference", f"css:{e.tag}:{shown}", f"<{e.tag}> is read as {role} by display:{shown}")
            self.structure(role, e, c)
        elif e.tag in TAGS:
            self.structure(TAGS[e.tag], e, c)
        else:
            self.plain(e, c)
        self.depth -= 1

    def structure(self, role: str, e: Element, c: _Context) -> None:
        table = self.tables[-1] if self.tables else None
        if role in ("list", "ordered_list"):
            self.lists.append(role == "ordered_list" or bool(c.ordered))
            self.children(e, c)
            self.lists.pop()
        elif role == "item":
            self.item(_text(e, c.space), c)
            for child in e.elements():
                if child.tag in ("ul", "ol") or _role(child) == "list":
                    self.node(child, c)
        elif role == "table":
            self.tables.append(_Table())
            late = [x for x in e.elements() if dict(x.style).get("caption-side") == "bottom" and self.is_caption(x)]
            for child in [x for x in e.elements() if x not in late] + late:
                self.node(child, c)
            self.tables.pop()
        elif role in ("group", "head_group"):
            was = table.head if table else False
            if table:
                table.head = role == "head_group"
            self.children(e, c)
            if table:
                table.head = was
        elif role == "row":
            if table:
                table.col = 0
                table.skip()
            self.children(e, c)
            if table:
                table.row += 1
        elif role == "caption":
            self.block(_text(e, c.space), c, "paragraph")
        else:
            self.cell(e, c, table, role == "head_cell")

    @staticmethod
    def is_caption(e: Element) -> bool:
        return e.tag == "caption" or _role(e) == "caption"

    def cell(self, e: Element, c: _Context, table: _Table | None, head: bool) -> None:
        row, col = (table.row, table.col) if table else (0, 0)
        spans = []
        for name in ("rowspan", "colspan"):
            raw = e.attrs.get(name, "1")
            asked = int(raw) if re.fullmatch(r"\+?[0-9]+", raw) else 1
            spans.append(min(max(asked, 1), WIDEST))
            if spans[-1] != asked:
                self.warnings.append(Warning_("truncated_content", f"{name}={asked} at row {row}, col {col} is read as {spans[-1]}", 0))
        head = head or bool(table and table.head)
        text = _text(e, c.space)
        if text:
            hint = Hint("table_header", col=col) if head else Hint("table_cell", row=row, col=col, rowspan=spans[0], colspan=spans[1])
            self.emit(text, c, hint, bold=head)
        if table:
            table.taken |= {(r, k) for r in range(row + 1, row + spans[0]) for k in range(col, col + spans[1])}
            table.col += spans[1]
            table.skip()

    def plain(self, e: Element, c: _Context) -> None:
        tag = e.tag
        if re.fullmatch("h[1-6]", tag):
            self.heading(_text(e, c.space), c, int(tag[1]))
        elif tag in _BLOCK_TAGS:
            self.block(_text(e, c.space), c, _BLOCK_TAGS[tag])
        elif tag in ("dt", "dd"):
            text = _text(e, c.space)
            if text:
                inner = tag == "dd"
                self.emit(text, c, Hint("list_item", depth=int(inner), ordered=False), left=0.03 * inner, bold=not inner)
        elif tag == "img":
            self.emit("", c, None, kind="image", alt_text=e.attrs.get("alt"), size=None)
        elif tag == "hr":
            self.y += STEP
        elif tag == "a":
            text = _text(e, c.space)
            if text:
                self.emit(text, c, Hint("link", url=e.attrs["href"]) if "href" in e.attrs else None)
        elif tag in ("article", "section"):
            self.emit("", c, Hint("section_start", text=e.attrs.get("aria-label")), size=0.0, height=0.0)
            self.children(e, c)
            self.emit("", c, Hint("section_end"), size=0.0, height=0.0, step=False)
        elif tag == "select":
            self.lists.append(False)
            self.children(e, c)
            self.lists.pop()
        elif tag == "option":
            self.item(_text(e, c.space), c)
        elif tag == "input":
            if e.attrs.get("type", "text").lower() not in SILENT_INPUTS:
                self.block((e.attrs.get("value") or e.attrs.get("placeholder", "")).strip(), c, "paragraph")
        elif tag == "textarea":
            self.block(_text(e, c.space).strip(), c, "paragraph")
        elif tag in ("dl", "details", "form"):
            self.children(e, c)
        else:
            note = _note(e)
            if note or tag in CONTAINERS:
                text = _text(e, c.space, inline=True)
                kind = note or ("sidebar" if tag == "aside" else "paragraph")
                if text and not note and tag in ("div", "main", "header", "footer", "nav"):
                    self.warn("heuristic_inference", f"container:{tag}:{kind}", f"text of <{tag}> is read as a {kind}")
                if kind == "heading":
                    level = e.attrs.get("aria-level", "1")
                    self.heading(text, c, min(max(int(level) if level.isdigit() else 1, 1), 6))
                else:
                    self.block(text, c, kind)
            self.children(e, c)


def _find(e: Element, tag: str) -> Element | None:
    stack = [e]
    while stack:
        x = stack.pop()
        if x.tag == tag:
            return x
        stack.extend(reversed(list(x.elements())))
    return None


def decode(data: bytes) -> Decoded:
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError as e:
        raise DecodeError(f"not UTF-8: {e}") from None
    root = parse(text)
    walk = _Walk()
    walk.node(root, _Context())
    found = _find(root, "title")
    title = "".join(x for x in found.children if isinstance(x, str)).strip() if found else ""
    return Decoded("html", 1, "single_logical_page", title or None, False, walk.out, walk.warnings)
