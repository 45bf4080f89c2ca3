"""Primitives of one document to its tree of nodes, flat and in document order."""

from __future__ import annotations

import dataclasses
import itertools

import regex

from pagewright.functions import text as t
from pagewright.sources.model import Hint, Primitive, Warning_

#: Roles of hints; the first rank that a primitive has decides, within it the first hint.
RANKS = [
    {"section_start", "section_end"},
    {"table_cell", "table_header", "table_continuation", "in_table"},
    {"list_item"},
    {"page_header", "page_footer"},
    {"heading", "document_title"},
    {"paragraph"},
    {"code_block"},
    {"block_quote"},
    {"footnote"},
    {"sidebar"},
]
_RANK = {kind: i for i, kinds in enumerate(RANKS) for kind in kinds}

#: A text joins the one before it unless it begins this far below, in heights and in pages, or its font differs by this.
GAP_HEIGHTS, GAP_PAGE, FONT_RATIO = 1.8, 0.015, 1.10


#: Roles of texts that stand on a page and not in its content, and of texts in tables.
RUNNING, TABULAR = RANKS[3], RANKS[1]

#: A paragraph may go on behind a page break where its next text begins this near to its left edge, in pages, is as wide
#: within this share, and as large within this many points; not behind ! or ?, nor behind a full stop after a word of more
#: than this many letters, which no abbreviation has.
SAME_LEFT, SAME_WIDTH, SAME_SIZE, SHORT_WORD = 0.02, 0.10, 0.1, 4

_GOES_ON = regex.compile(t.CONTINUES)


@dataclasses.dataclass
class Node:
    kind: str
    x: float = 0.0
    y: float = 0.0
    width: float = 0.0
    height: float = 0.0
    page_start: int = 0
    page_end: int = 1
    text: str | None = None
    level: int | None = None
    row: int | None = None
    col: int | None = None
    rowspan: int | None = None
    colspan: int | None = None
    ordered: bool | None = None
    confidence: float = 1.0
    source: str = "format-derived"
    metadata: dict = dataclasses.field(default_factory=dict)
    children: list = dataclasses.field(default_factory=list)

    def cover(self, other) -> None:
        """Grow to hold a node or primitive."""
        if not (self.width or self.height or self.x or self.y):
            self.x, self.y, self.width, self.height = other.x, other.y, other.width, other.height
            return
        right, low = max(self.x + self.width, other.x + other.width), max(self.y + self.height, other.y + other.height)
        self.x, self.y = min(self.x, other.x), min(self.y, other.y)
        self.width, self.height = right - self.x, low - self.y


def primary(p: Primitive) -> Hint | None:
    ranked = [(_RANK[h.kind], i) for i, h in enumerate(p.hints) if h.kind in _RANK]
    return p.hints[min(ranked)[1]] if ranked else None


def _source(p: Primitive, h: Hint | None) -> str:
    return f"heuristic:{h.detector}" if h is not None and h.detector else "format-derived"


def _notes(p: Primitive) -> dict:
    """What inline hints say; the first of a kind counts."""
    out: dict[str, str] = {}
    for h in p.hints:
        if h.kind == "link" and h.url:
            out.setdefault("link", h.url)
        elif h.kind == "expanded_text" and h.text:
            out.setdefault("expanded", h.text)
        elif h.kind in ("strong", "emphasis"):
            out.setdefault(h.kind, "true")
    return out


class Assembler:
    """Takes primitives in reading order; one text, one table and one list are open at most, and a stack of sections."""

    def __init__(self):
        self.root = Node("document")
        self.stack: list[Node] = []
        self.artifacts: list[Node] = []
        self.warnings: list[Warning_] = []
        self.open_text: tuple[Node, Primitive] | None = None
        self.open_table: Node | None = None
        self.cells: dict[tuple[int, int], Node] = {}
        self.table_base: tuple[int, int] | None = None
        self.open_list: Node | None = None
        self.repeated: set[int] = set()  # texts of a header row that stands again on a later page

    def add(self, node: Node) -> None:
        (self.stack[-1] if self.stack else self.root).children.append(node)

    def close_text(self) -> None:
        if self.open_text:
            node = self.open_text[0]
            self.open_text = None
            if node.text:
                self.add(node)

    def close_list(self) -> None:
        if self.open_list:
            node, self.open_list = self.open_list, None
            self.add(node)

    def close_table(self) -> None:
        """Rows in order; the table's height is the number of rows present, its width the last column."""
        if self.open_table is None:
            return
        table, self.open_table = self.open_table, None
        rows = sorted({r for r, _ in self.cells})
        wide = max(c for _, c in self.cells) + 1
        table.row, table.col = len(rows), wide
        for r in rows:
            line = Node("table_row", row=r, page_start=table.page_start, page_end=table.page_end)
            for (rr, c), cell in sorted(self.cells.items(), key=lambda x: x[0]):
                if rr == r:
                    cell.colspan = min(cell.colspan or 1, wide - c)
                    cell.rowspan = min(cell.rowspan or 1, max(rows[-1] - r + 1, 1))
                    line.cover(cell)
                    line.children.append(cell)
            table.children.append(line)
        self.cells = {}
        self.table_base = None
        self.add(table)

    def close_all(self) -> None:
        self.close_text()
        self.close_table()
        self.close_list()

    def node(self, p: Primitive, kind: str, h: Hint | None, **more) -> Node:
        return Node(
            kind, p.x, p.y, p.width, p.height, p.page, p.page + 1, confidence=h.confidence if h else 1.0,
            source=_source(p, h), metadata=_notes(p), **more,
        )

    def text(self, p: Primitive, kind: str, h: Hint | None, level: int | None = None, joins: bool = True) -> None:
        if not p.content:
            return
        if self.open_text and joins:
            node, last = self.open_text
            gap = p.y - (last.y + last.height)
            sizes = sorted((p.font_size or 1.0, last.font_size or 1.0))
            near = p.page != last.page or not (gap > GAP_HEIGHTS * last.height and gap > GAP_PAGE)
            if node.kind == kind and node.level == level and near and sizes[1] <= FONT_RATIO * max(sizes[0], 1e-6):
                node.text = f"{node.text} {p.content}"
                node.cover(p)
                node.page_end = max(node.page_end, p.page + 1)
                node.confidence = min(node.confidence, h.confidence if h else 1.0)
                self.open_text = (node, p)
                return
        self.close_text()
        self.open_text = (self.node(p, kind, h, text=p.content, level=level), p)

    def cell(self, p: Primitive, h: Hint, row: int, head: bool) -> None:
        self.close_text()
        self.close_list()
        if row == 0 and h.col == 0 and (0, 0) in self.cells:
            self.close_table()
        if self.open_table is None:
            self.open_table = self.node(p, "table", h)
            self.open_table.metadata = {}
        table = self.open_table
        table.cover(p)
        table.page_end = max(table.page_end, p.page + 1)
        held = self.cells.get((row, h.col))
        if held:
            held.text = f"{held.text} {p.content}" if p.content else held.text
            held.cover(p)
            return
        made = self.node(p, "table_cell", h, text=p.content or "", row=row, col=h.col, rowspan=h.rowspan or 1, colspan=h.colspan or 1)
        if head:
            made.metadata["header"] = "true"
        self.cells[row, h.col] = made

    def turn(self, page: list[Primitive]) -> None:
        """Before a page's primitives: what is open stays open only where the page's first content goes on with it."""
        content = ((p, primary(p)) for p in page if p.kind in ("text", "image"))
        first, h = next(((p, h) for p, h in content if h is None or h.kind not in RUNNING), (None, None))
        kind = h.kind if h else None
        if self.open_table is not None:
            if kind in TABULAR:
                self.repeated = self.heads_again(page)
                self.table_base = None
            else:
                self.close_table()
        if self.open_list is not None:
            deepest = max((c.level or 0 for c in self.open_list.children), default=0)
            if kind != "list_item":
                self.close_list()
            elif (h.depth or 0) > deepest + 1:
                self.warnings.append(Warning_("heuristic_inference", f"a list goes from depth {deepest} to {h.depth} over a page break", first.page))
        if self.open_text and not (first is not None and h is None and self.runs_on(first)):
            self.close_text()

    def runs_on(self, p: Primitive) -> bool:
        """Whether a bare text that begins a page goes on with the open paragraph: by how it begins, else by its place."""
        node, last = self.open_text
        if p.kind != "text" or node.kind != "paragraph" or not node.text:
            return False
        if _GOES_ON.search(p.content or ""):
            return True
        end = node.text.split()[-1:] or [""]
        if end[0].endswith(("!", "?")) or end[0].endswith(".") and len(end[0]) > SHORT_WORD:
            return False
        alike = abs(node.width - p.width) <= SAME_WIDTH * max(node.width, p.width)
        sized = last.font_size is not None and p.font_size is not None and abs(last.font_size - p.font_size) < SAME_SIZE
        return abs(node.x - p.x) <= SAME_LEFT and alike and sized

    def heads_again(self, page: list[Primitive]) -> set[int]:
        """The texts of the page's first row, if they are those of the open table's, column by column."""
        tabular = [(p, primary(p)) for p in page if p.kind == "text" and (h := primary(p)) and h.kind in TABULAR]
        top = [(p, h) for p, h in tabular if h.kind == "table_header" or h.row == 0]
        said: dict[int, str] = {}
        for p, h in top:
            said[h.col] = f"{said[h.col]} {p.content}" if h.col in said else p.content or ""
        heads = {c: n.text or "" for (r, c), n in self.cells.items() if r == 0}
        same = {c: x.strip() for c, x in said.items()} == {c: x.strip() for c, x in heads.items()}
        return {id(p) for p, _ in top} if said and same and len(tabular) > len(top) else set()

    def take(self, p: Primitive) -> None:
        h = primary(p)
        if id(p) in self.repeated:
            self.open_table.page_end = max(self.open_table.page_end, p.page + 1)
            return
        kind = h.kind if h else None
        if p.kind == "image":
            self.close_all()
            made = self.node(p, "image", None, text=p.alt_text)
            if p.data:
                made.metadata["data"] = p.data.hex()
            self.add(made)
        elif p.kind != "text":
            self.close_text()
        elif kind == "section_start":
            self.close_all()
            self.stack.append(self.node(p, "section", h, text=h.text, level=len(self.stack) + 1))
        elif kind == "section_end":
            self.close_all()
            if self.stack:
                self.close_section()
            else:
                self.warnings.append(Warning_("unexpected_structure", "a section ends that did not begin", p.page))
        elif kind in ("table_cell", "table_header"):
            self.cell(p, h, 0 if kind == "table_header" else h.row, kind == "table_header")
        elif kind == "table_continuation":
            if self.table_base is None or self.table_base[0] != p.page:
                above = 1 if self.repeated else 0  # the header row that is not taken again
                self.table_base = (p.page, max((r for r, _ in self.cells), default=-1) + 1 - above)
            self.cell(p, dataclasses.replace(h), h.row + self.table_base[1], False)
        elif kind == "in_table" and self.open_table is not None:
            self.cell(p, h, h.row, False)
        elif kind == "list_item":
            self.close_text()
            self.close_table()
            if self.open_list and self.open_list.ordered != h.ordered and h.depth == 0:
                self.close_list()
            if self.open_list is None:
                self.open_list = self.node(p, "list", h, ordered=h.ordered)
                self.open_list.metadata = {}
            self.open_list.cover(p)
            self.open_list.page_end = p.page + 1
            self.open_list.children.append(self.node(p, "list_item", h, text=p.content, level=h.depth))
        elif kind in ("page_header", "page_footer"):
            self.close_text()
            self.artifacts.append(self.node(p, kind, h, text=p.content))
        elif kind == "footnote":
            self.close_text()
            made = self.node(p, "footnote", h, text=p.content)
            made.metadata["id"] = h.text or ""
            self.add(made)
        elif kind == "sidebar":
            self.close_all()
            made = self.node(p, "paragraph", h, text=p.content)
            made.metadata["role"] = "sidebar"
            if p.content:
                self.add(made)
        else:
            self.close_table()
            self.close_list()
            name = {"heading": "heading", "document_title": "heading", "code_block": "code_block", "block_quote": "block_quote"}
            level = 1 if kind == "document_title" else h.level if kind == "heading" else None
            # A paragraph that its format marks is one of its own.
            self.text(p, name.get(kind, "paragraph"), h, level, joins=kind != "paragraph")

    def close_section(self) -> None:
        section = self.stack.pop()
        for c in section.children:
            section.cover(c)
            section.page_end = max(section.page_end, c.page_end)
        self.add(section)

    def finish(self) -> Node:
        self.close_all()
        if self.stack:
            self.warnings.append(Warning_("partial_extraction", f"{len(self.stack)} sections were still open at the end", None))
        while self.stack:
            self.close_section()
        for c in self.root.children:
            self.root.cover(c)
            self.root.page_end = max(self.root.page_end, c.page_end)
        return self.root


def assemble(primitives: list[Primitive]) -> tuple[Node, list[Node], list[Warning_]]:
    a = Assembler()
    for number, page in enumerate([*g] for _, g in itertools.groupby(primitives, key=lambda p: p.page)):
        a.repeated = set()
        if number:
            a.turn(page)
        for p in page:
            a.take(p)
    root = a.finish()
    return root, a.artifacts, a.warnings


def flatten(root: Node) -> list[dict]:
    """Rows of the tree in preorder, with their numbers and their parents'."""
    out: list[dict] = []

    def walk(n: Node, parent: int | None, depth: int) -> None:
        number = len(out)
        held = {f.name: getattr(n, f.name) for f in dataclasses.fields(n) if f.name != "children"}
        out.append(held | {"node_id": number, "parent_id": parent, "depth": depth})
        for c in n.children:
            walk(c, number, depth + 1)

    walk(root, None, 0)
    return out
