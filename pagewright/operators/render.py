"""A document's tree as plain text, Markdown or JSON."""

from __future__ import annotations

import json

from pagewright.operators.assemble import Node


class _Out:
    def __init__(self):
        self.text = ""

    def gap(self) -> None:
        if self.text:
            self.text = self.text.rstrip("\n") + "\n\n" if not self.text.endswith("\n\n") else self.text

    def line(self, text: str) -> None:
        self.text += text + "\n"


def grid(table: Node) -> list[list[str]]:
    """Texts by row and column; a missing cell is empty, a line break in a cell is a space in no format."""
    wide = table.col or 0
    out = []
    for row in table.children:
        line = [""] * wide
        for c in row.children:
            if c.col < wide:
                line[c.col] = c.text or ""
        out.append(line)
    return out


def widths(rows: list[list[str]]) -> list[int]:
    """Widest cell of each column in bytes, at least three."""
    return [max(3, *(len(c.encode()) for c in column)) for column in zip(*rows)]


def _table(out: _Out, table: Node, markdown: bool) -> None:
    rows = grid(table)
    if not rows or not rows[0]:
        return
    wide = widths(rows)
    for i, row in enumerate(rows):
        cells = [c.ljust(w) for c, w in zip(row, wide)]
        out.line(f"| {' | '.join(cells)} |" if markdown else " | ".join(cells))
        if i == 0:
            rule = ["-" * w for w in wide]
            out.line(f"| {' | '.join(rule)} |" if markdown else "-+-".join(rule))
    out.text += "\n"


def _node(out: _Out, n: Node, markdown: bool) -> None:
    text = (n.text or "").strip()
    if n.kind in ("document", "section"):
        for c in n.children:
            _node(out, c, markdown)
    elif n.kind == "heading":
        out.gap()
        out.line(f"{'#' * min(n.level or 1, 6)} {text}" if markdown else text)
        out.gap()
    elif n.kind == "paragraph":
        out.gap()
        out.line(text)
    elif n.kind == "list":
        out.gap()
        for i, c in enumerate(n.children, 1):
            out.line(f"{f'{i}.' if n.ordered else '-'} {(c.text or '').strip()}")
    elif n.kind == "table":
        out.gap()
        _table(out, n, markdown)
    elif n.kind == "code_block":
        out.gap()
        out.line(f"```\n{text}\n```" if markdown else text)
    elif n.kind == "block_quote":
        out.gap()
        for line in (n.text or "").splitlines():
            out.line(f"> {line}")
    elif n.kind == "footnote":
        name = n.metadata.get("id", "")
        out.line(f"[^{name}]: {text}" if markdown else f"[{name}] {text}")
    elif n.kind == "image":
        if markdown:
            out.line(f"![{n.text if n.text is not None else 'image'}]()")
        elif n.text:
            out.line(f"[Image: {n.text}]")


def render(root: Node, markdown: bool = False) -> str:
    """The whole text; a mark stands before each page after the first."""
    out, page = _Out(), 0
    for c in root.children:
        for p in range(page, c.page_start):
            out.gap()
            out.line(f"---\n_page {p + 2}_" if markdown else f"--- page {p + 2} ---")
        if c.page_start > page:
            out.text += "\n"
            page = c.page_start
        _node(out, c, markdown)
        page = max(page, c.page_end - 1)
    text = out.text.rstrip()
    return text + "\n" if text else ""


def by_page(root: Node, pages: int, markdown: bool = False) -> list[str]:
    """Each page's own text; a node that runs over pages stands on its first."""
    held = [_Out() for _ in range(max(pages, 1))]

    def place(n: Node) -> None:
        if n.kind in ("document", "section"):
            for c in n.children:
                place(c)
        else:
            _node(held[min(n.page_start, len(held) - 1)], n, markdown)

    place(root)
    return [o.text.strip("\n") for o in held]


def to_json(root: Node, facts: dict, warnings: list) -> str:
    """source, elements and warnings; ids count the elements of each page; what is sure and the format's own says nothing."""
    counts: dict[int, int] = {}

    def node(n: Node) -> dict:
        number = counts.get(n.page_start, 0)
        counts[n.page_start] = number + 1
        held: dict = {"id": f"e-{n.page_start}-{number}", "type": n.kind}
        if n.kind == "table":
            rows = grid(n)
            held |= {"rows": n.row, "cols": n.col, "headers": rows[0] if rows else [], "data": rows[1:]}
            cells = [c for r in n.children for c in r.children]
            if any((c.rowspan or 1) > 1 or (c.colspan or 1) > 1 for c in cells):
                held["cells"] = [{k: getattr(c, k) for k in ("row", "col", "rowspan", "colspan", "text")} for c in cells]
        else:
            held |= {k: v for k in ("level", "text", "ordered") if (v := getattr(n, k)) is not None}
        held |= {
            "bbox": {"x": round(n.x, 4), "y": round(n.y, 4), "w": round(n.width, 4), "h": round(n.height, 4)},
            "page": n.page_start,
        }
        if round(n.confidence, 2) != 1.0:
            held["confidence"] = round(n.confidence, 2)
        if n.source != "format-derived":
            held["source"] = n.source
        if n.children and n.kind != "table":
            held["children"] = [node(c) for c in n.children]
        return held

    elements = [node(c) for c in root.children]
    said = [{"kind": w.kind, "message": w.message, **({"page": w.page} if w.page is not None else {})} for w in warnings]
    return json.dumps({"source": facts, "elements": elements, "warnings": said}, ensure_ascii=False)
