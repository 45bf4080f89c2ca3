"""Structure of pages whose format names none: headings, lists, page numbers and tables by how they are set."""

from __future__ import annotations

import re
import statistics
from collections import Counter, defaultdict
from collections.abc import Callable

from pagewright.functions import text as t
from pagewright.sources.model import Decoded, Hint, Primitive, Warning_

#: A page with fewer hinted texts than this share is examined.
HINTED_SHARE = 0.8

#: Sureness of what is found.
SURE = {"heading": 0.8, "heading_caps": 0.72, "heading_bold": 0.71, "heading_plain": 0.5, "list": 0.75, "paragraph": 0.7, "lattice": 0.85, "stream": 0.65}

#: Tolerance of ruling lines, in pages, and shortest line that counts.
SNAP, SHORTEST = 0.004, 0.01

#: How far from its column's edge a text of a table without rules may begin, in pages.
ALIGNED = 0.02

#: Least share of filled cells of a table without rules.
FILLED = 0.3

_BULLET = re.compile(t.LIST_BULLET)
_ORDERED = re.compile(t.LIST_ORDERED)


def barriers_of(page: list[Primitive]) -> list[Primitive]:
    """Rules that stand upright between texts: over three times as high as wide, and over 2 % of the page high."""
    return [p for p in page if p.kind == "line" and p.height > 3 * p.width and p.height > 0.02]


def _parted(line: list[Primitive], p: Primitive, barriers: list[Primitive]) -> bool:
    """Whether a rule that is as high as half of the text or more stands between it and the nearest text of the line."""
    near = min(line, key=lambda q: abs(q.x + q.width / 2 - p.x - p.width / 2))
    left, right = sorted((near, p), key=lambda q: q.x)
    high = [min(b.y + b.height, p.y + p.height) - max(b.y, p.y) for b in barriers if left.x + left.width - SNAP <= b.x <= right.x + SNAP]
    return any(h > 0.5 * p.height for h in high)


def lines_of(texts: list[Primitive], barriers: list[Primitive] = ()) -> list[list[Primitive]]:
    """Visual lines: texts that share more than half of the smaller height and no rule parts, left to right, top down."""
    out: list[list[Primitive]] = []
    reached: list[list[Primitive]] = []  # lines that a text this far down can still be on
    for p in sorted(texts, key=lambda p: (p.y, p.x)):
        reached = [line for line in reached if line[0].y + line[0].height > p.y]
        for line in reversed(reached):
            a = line[0]
            shared = min(a.y + a.height, p.y + p.height) - max(a.y, p.y)
            if shared > 0.5 * min(a.height, p.height) and not (barriers and _parted(line, p, barriers)):
                line.append(p)
                break
        else:
            out.append([p])
            reached.append(out[-1])
    return [sorted(line, key=lambda p: p.x) for line in out]


def columns_of(texts: list[Primitive], gap: float = 0.03, least: float = 0.05) -> list[tuple[float, float]]:
    """Column bounds: the texts' extents united over gaps up to `gap`, those narrower than `least` left out."""
    out: list[list[float]] = []
    for a, b in sorted((p.x, p.x + p.width) for p in texts):
        if out and a <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out if b - a >= least]


def reading_order(texts: list[Primitive]) -> list[Primitive]:
    """Column by column where a page has columns side by side, else line by line."""
    columns = columns_of(texts)
    if len(columns) < 2:
        return [p for line in lines_of(texts) for p in line]
    where = lambda p: max(range(len(columns)), key=lambda i: min(p.x + p.width, columns[i][1]) - max(p.x, columns[i][0]))
    split = defaultdict(list)
    for p in texts:
        split[where(p)].append(p)
    return [p for i in range(len(columns)) for line in lines_of(split[i]) for p in line]


def nearest_order(boxes: list[Primitive], flow: float = 0.5) -> list[Primitive]:
    """A chain from the top left: each time the box nearest to the last, by a distance that weighs down against across.

    flow runs from -1, where only the way across counts, to 1, where only the way down does. Ties go to the upper, then the
    left box.
    """
    rest = sorted(boxes, key=lambda p: (p.y, p.x))
    out: list[Primitive] = []
    down, across = (1 + flow) / 2, (1 - flow) / 2
    while rest:
        last = out[-1] if out else None

        def far(p: Primitive, last: Primitive | None = last) -> tuple:
            dx, dy = (abs(p.x - last.x), abs(p.y - last.y)) if last else (p.x, p.y)
            return down * dy + across * dx, p.y, p.x

        out.append(rest.pop(min(range(len(rest)), key=lambda i: far(rest[i]))))
    return out


def _anchors(lines: list[list[Primitive]]) -> list[tuple[int, int]]:
    """Runs of at least three lines of as many texts each, two or more, of which 60 % begin at their column's edge."""
    out, first = [], 0
    for at in range(1, len(lines) + 1):
        if at < len(lines) and len(lines[at]) == len(lines[first]):
            continue
        run = lines[first:at]
        if len(run) >= 3 and len(run[0]) >= 2:
            edges = [min(p.x for p in column) for column in zip(*run)]
            near = sum(abs(p.x - e) <= ALIGNED for x in run for p, e in zip(x, edges))
            if near >= 0.6 * len(run) * len(edges):
                out.append((first, at))
        first = at
    return out


def _placed(line: list[Primitive], columns: list[tuple[float, float]]) -> list[int] | None:
    """The column of each text: the one whose left edge, middle or right edge it shares, without reaching the next one.

    None where a text has no column or two have the same.
    """
    out = []
    for p in line:
        offs = [min(abs(p.x - a), abs(p.x + p.width / 2 - (a + b) / 2), abs(p.x + p.width - b)) for a, b in columns]
        c = min(range(len(columns)), key=offs.__getitem__)
        if offs[c] > ALIGNED or c + 1 < len(columns) and p.x + p.width > columns[c + 1][0] + ALIGNED:
            return None
        out.append(c)
    return out if len(set(out)) == len(out) else None


def stream_tables(lines: list[list[Primitive]]) -> list[list[tuple[int, int, Primitive]]]:
    """Tables without rules, each as (row, column, text).

    A run of full lines gives the columns. Lines above and below it, with cells left empty, belong to the table as far as
    their texts stand in its columns and no gap of over twice the middle one lies between; a line of one text only where
    fuller ones follow. A table of which under 30 % of the cells are filled is none.
    """
    out, used = [], 0
    gaps = [b[0].y - a[0].y for a, b in zip(lines, lines[1:])]
    for first, last in _anchors(lines):
        if first < used:
            continue
        run = lines[first:last]
        columns = [(min(p.x for p in c), max(p.x + p.width for p in c)) for c in zip(*run)]
        widest = 2 * statistics.median(gaps[first : last - 1])
        rows = [list(range(len(columns)))] * len(run)
        for step in (-1, 1):
            at, held = (first - 1, []) if step < 0 else (last, [])
            while used <= at < len(lines) and gaps[at if step < 0 else at - 1] <= widest and (placed := _placed(lines[at], columns)):
                held.append(placed)
                at += step
            while held and len(held[-1]) < 2:
                held.pop()
            if step < 0:
                first, rows = first - len(held), [*held[::-1], *rows]
            else:
                last, rows = last + len(held), [*rows, *held]
        if sum(map(len, rows)) >= FILLED * len(rows) * len(columns):
            out.append([(r, c, p) for r, (line, places) in enumerate(zip(lines[first:last], rows)) for c, p in zip(places, line)])
            used = last
    return out


def _grid(values: list[float]) -> list[float]:
    out: list[list[float]] = []
    for v in sorted(values):
        if out and v - sum(out[-1]) / len(out[-1]) <= SNAP:
            out[-1].append(v)
        else:
            out.append([v])
    return [sum(c) / len(c) for c in out]


def lattice(lines: list[Primitive]) -> list[tuple[list[float], list[float], list[Primitive]]]:
    """Tables that ruling lines draw: row edges, column edges and lines of each group of lines that touch one another."""
    across = [p for p in lines if p.width >= SHORTEST and p.height <= SNAP]
    down = [p for p in lines if p.height >= SHORTEST and p.width <= SNAP]
    every = across + down
    parent = list(range(len(every)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, h in enumerate(across):
        for j, v in enumerate(down, len(across)):
            if h.x - SNAP <= v.x <= h.x + h.width + SNAP and v.y - SNAP <= h.y <= v.y + v.height + SNAP:
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i, p in enumerate(every):
        groups[root(i)].append(p)
    out = []
    for g in groups.values():
        rows = _grid([p.y for p in g if p.height <= SNAP])
        cols = _grid([p.x for p in g if p.width <= SNAP])
        if len(rows) >= 2 and len(cols) >= 2 and len(rows) + len(cols) > 4:
            out.append((rows, cols, g))
    return sorted(out, key=lambda g: (g[0][0], g[1][0]))


def _cell(edges: list[float], at: float) -> int | None:
    return next((i for i, (a, b) in enumerate(zip(edges, edges[1:])) if a - SNAP <= at <= b + SNAP), None)


def merged_cells(rows: list[float], cols: list[float], lines: list[Primitive]) -> dict[tuple[int, int], tuple[int, int, int, int]]:
    """Each place of a ruled grid to its cell's row, column, rowspan and colspan: places that no rule parts are one cell.

    Places that together are no rectangle stay cells of their own.
    """
    upright, flat = defaultdict(list), defaultdict(list)
    for p in lines:
        if p.width <= SNAP:
            upright[min(range(len(cols)), key=lambda i, p=p: abs(cols[i] - p.x))].append((p.y - SNAP, p.y + p.height + SNAP))
        if p.height <= SNAP:
            flat[min(range(len(rows)), key=lambda i, p=p: abs(rows[i] - p.y))].append((p.x - SNAP, p.x + p.width + SNAP))
    wall = lambda held, at: any(a <= at <= b for a, b in held)
    middle = lambda edges, i: (edges[i] + edges[i + 1]) / 2
    places = {(r, c) for r in range(len(rows) - 1) for c in range(len(cols) - 1)}
    out: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    for place in sorted(places):
        if place in out:
            continue
        found, rest = {place}, [place]
        while rest:
            r, c = rest.pop()
            open_ = [
                ((r, c + 1), upright[c + 1], middle(rows, r)), ((r, c - 1), upright[c], middle(rows, r)),
                ((r + 1, c), flat[r + 1], middle(cols, c)), ((r - 1, c), flat[r], middle(cols, c)),
            ]
            more = [x for x, held, at in open_ if x in places and x not in found and not wall(held, at)]
            found.update(more)
            rest += more
        top, left = min(r for r, _ in found), min(c for _, c in found)
        high, wide = max(r for r, _ in found) - top + 1, max(c for _, c in found) - left + 1
        whole = high * wide == len(found)
        for r, c in found:
            out[r, c] = (top, left, high, wide) if whole else (r, c, 1, 1)
    return out


def _reached(at: int, n: int, edges: list[float], low: float, high: float, free: Callable[[int], bool]) -> tuple[int, int]:
    """First row or column and number of them that a text from low to high covers, from its cell of n on over free ones."""
    first, last = at, at + n - 1
    while first > 0 and low < edges[first] - SNAP and free(first - 1):
        first -= 1
    while last + 2 < len(edges) and high > edges[last + 1] + SNAP and free(last + 1):
        last += 1
    return first, last - first + 1


def ruled_cells(rows: list[float], cols: list[float], lines: list[Primitive], texts: list[Primitive]) -> list[tuple[Primitive, int, int, int, int]]:
    """Texts of a ruled table with row, column, rowspan and colspan.

    A cell is what rules enclose; where its text reaches over a rule into places that hold no text, these belong to it.
    """
    cells = merged_cells(rows, cols, lines)
    held = []
    for p in texts:
        r, c = _cell(rows, p.y + p.height / 2), _cell(cols, p.x + p.width / 2)
        if r is not None and c is not None:
            held.append((p, *cells[r, c]))
    taken = {(r + i, c + k) for _, r, c, high, wide in held for i in range(high) for k in range(wide)}
    out = []
    for p, r, c, high, wide in held:
        left, across = _reached(c, wide, cols, p.x, p.x + p.width, lambda k: all((r + i, k) not in taken for i in range(high)))  # noqa: B023
        top, down = _reached(r, high, rows, p.y, p.y + p.height, lambda i: all((i, left + k) not in taken for k in range(across)))  # noqa: B023
        out.append((p, top, left, down, across))
    return out


def find_tables(page: list[Primitive], body: float, levels: dict[float, int]) -> None:
    """Cells of ruled tables, then of those that only their alignment shows."""
    texts = [p for p in page if p.kind == "text" and not p.hints]
    for rows, cols, lines in lattice([p for p in page if p.kind == "line"]):
        for p, r, c, high, wide in ruled_cells(rows, cols, lines, [p for p in texts if not p.hints]):
            p.hints.insert(0, Hint("table_cell", row=r, col=c, rowspan=high, colspan=wide, confidence=SURE["lattice"], detector="table"))
    for table in stream_tables(lines_of([p for p in texts if not p.hints])):
        for r, c, p in table:
            p.hints.append(Hint("table_cell", row=r, col=c, rowspan=1, colspan=1, confidence=SURE["stream"], detector="table"))


def _sound(text: str) -> bool:
    n = len(text.strip())
    return 0 < n <= 100 and not re.search(r"[?!]$|(?:^|[^0-9])\.$", text.strip()) and not (n > 50 and "," in text)


#: What looks at the texts of a page that its format says little about, in this order: each gets the page's primitives, the
#: body size and the heading levels by size, and puts hints on primitives that have none. More can be added.
DETECTORS: list = []


def _leading_table(texts: list[Primitive]) -> list[Hint]:
    """The cells of the table that a page's content begins with, if it begins with one."""
    out: list[Hint] = []
    for p in texts:
        h = next((h for h in p.hints if h.kind != "link"), None)
        if h is not None and h.kind == "page_footer":
            continue
        if h is None or h.kind != "table_cell" or (h.row, h.col) == (0, 0) and out and (h.row, h.col) < (out[-1].row, out[-1].col):
            break
        out.append(h)
    return out


def continue_table(texts: list[Primitive], wide: int | None) -> int | None:
    """Make a table that begins a page go on with one of as many columns that ended the page before.

    wide: that table's columns, None without one. Returns the same of this page.
    """
    leading = _leading_table(texts)
    columns = len({h.col for h in leading})
    if wide and columns == wide:
        for h in leading:
            h.kind = "table_continuation"
    tail: set[int] = set()
    for p in reversed(texts):
        h = next((h for h in p.hints if h.kind != "link"), None)
        if h is not None and h.kind == "page_footer":
            continue
        if h is None or h.kind not in ("table_cell", "table_continuation"):
            break
        tail.add(h.col)
        if h.kind == "table_cell" and (h.row, h.col) == (0, 0):
            break
    return len(tail) or None


def enrich(d: Decoded) -> tuple[list[Primitive], list[Warning_]]:
    """The primitives in reading order, with hints where their format gave none, and what was guessed.

    Only pages that were laid out are touched, and of these only those with few hints. Body size is the most frequent
    size, of equal counts the smaller.
    """
    if d.format != "pdf":
        return d.primitives, []
    pages = defaultdict(list)
    for p in d.primitives:
        pages[p.page].append(p)
    sizes = Counter(round((p.font_size or 0) * 10) for p in d.primitives if p.kind == "text")
    body = min(sizes, key=lambda s: (-sizes[s], s)) / 10 if sizes else 0.0
    large = sorted({s / 10 for s in sizes if s / 10 > body * 1.1}, reverse=True)
    levels: dict[float, int] = {}
    kept: list[float] = []
    for s in large:
        if not kept or kept[-1] - s >= 0.5:
            kept.append(s)
        levels[s] = min(len(kept), 6)
    out, warnings, wide = [], [], None
    for number in sorted(pages):
        page = pages[number]
        texts = [p for p in page if p.kind == "text"]
        role = [p for p in texts if any(h.kind != "link" for h in p.hints)]
        if texts and len(role) < HINTED_SHARE * len(texts):
            links = {id(p): p.hints for p in texts}
            for p in texts:
                p.hints = []
            for detect in DETECTORS:
                detect(page, body, levels)
            for p in texts:
                p.hints += links[id(p)]
            warnings.append(Warning_("heuristic_inference", "structure is read from the layout", number))
        ordered = reading_order(texts)
        wide = continue_table(ordered, wide)
        out += ordered + [p for p in page if p.kind != "text"]
    return out, warnings


def find_blocks(page: list[Primitive], body: float, levels: dict[float, int]) -> None:
    """Page numbers, list items, headings by size, capitals or weight, and the first lines of paragraphs."""
    lines = lines_of([p for p in page if p.kind == "text" and not p.hints], barriers_of(page))
    gaps = [b[0].y - (a[0].y + a[0].height) for a, b in zip(lines, lines[1:])]
    positive = [g for g in gaps if g > 0]
    wide = 1.5 * statistics.median(positive) if positive else 0.0
    other = False  # whether the line before is of another kind
    for i, line in enumerate(lines):
        first = line[0]
        text = " ".join(p.content or "" for p in line).strip()
        size = round((first.font_size or 0) * 10) / 10
        bold = all(p.is_bold for p in line)
        hint = None
        if re.fullmatch("[0-9]{1,3}", text) and first.y + first.height >= 0.88:
            hint = Hint("page_footer", confidence=0.8, detector="page_number")
        elif _BULLET.search(text) or _ORDERED.search(text):
            ordered = not _BULLET.search(text)
            depth = min(int(first.x / 0.03), 5)
            hint = Hint("list_item", depth=depth, ordered=ordered, confidence=SURE["list"], detector="list")
        elif size in levels and _sound(text):
            hint = Hint("heading", level=levels[size], confidence=SURE["heading"] if bold else SURE["heading_plain"], detector="heading")
        elif bold and text.isupper() and _sound(text) and len(text) > 1:
            hint = Hint("heading", level=min(len(set(levels.values())) + 1, 6), confidence=SURE["heading_caps"], detector="heading")
        elif bold and not first.is_italic and size == body and 1 < len(text.split()) <= 8 and _sound(text) and text[:1].isupper() and len(lines) > 1:
            hint = Hint("heading", level=min(len(set(levels.values())) + 2, 6), confidence=SURE["heading_bold"], detector="heading")
        # A page's first line stays bare: it may go on with the paragraph before the break.
        begins = i > 0 and gaps[i - 1] > wide or other
        other = hint is not None
        if hint is None and begins:
            hint = Hint("paragraph", confidence=SURE["paragraph"], detector="paragraph")
        if hint is not None:
            for p in line:
                if hint.kind != "paragraph" or p is first:
                    p.hints.append(hint)


DETECTORS += [find_tables, find_blocks]
