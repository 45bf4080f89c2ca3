from __future__ import annotations

import random

from pagewright import cli
from pagewright.operators import detect
from pagewright.sources.model import Decoded, Primitive


def text(content, x, y, size=10.0, bold=False, width=0.1):
    return Primitive("text", 0, 0, x, y, width, 0.02, content, size, "F", bold, origin="observed", space="physical_page")


def roles(primitives):
    out, _ = detect.enrich(Decoded("pdf", 1, "physical_pages", primitives=primitives))
    return [(p.content, p.hints[0].kind if p.hints else None) for p in out]


def test_blocks_of_a_plain_page():
    page = [
        text("Title", 0.1, 0.05, 20), text("First line", 0.1, 0.12, width=0.6), text("goes on", 0.1, 0.145, width=0.6),
        text("A bold head", 0.1, 0.3, bold=True), text("1. item", 0.1, 0.4), text("• other", 0.1, 0.425), text("7", 0.5, 0.95),
    ]
    assert roles(page) == [
        ("Title", "heading"), ("First line", "paragraph"), ("goes on", None), ("A bold head", "heading"), ("1. item", "list_item"),
        ("• other", "list_item"), ("7", "page_footer"),
    ]


def test_table_without_rules():
    page = [text(f"r{r}c{c}", 0.1 + 0.3 * c, 0.2 + 0.03 * r) for r in range(4) for c in range(3)]
    out, _ = detect.enrich(Decoded("pdf", 1, "physical_pages", primitives=page))
    assert {(p.content, p.hints[0].row, p.hints[0].col) for p in out} == {(f"r{r}c{c}", r, c) for r in range(4) for c in range(3)}


def rule(x0, y0, x1, y1):
    return Primitive("line", 0, 0, x0, y0, x1 - x0, y1 - y0)


def cells(page):
    out, _ = detect.enrich(Decoded("pdf", 1, "physical_pages", primitives=page))
    return {(p.content, h.row, h.col, h.rowspan, h.colspan) for p in out for h in p.hints if h.kind == "table_cell"}


def test_table_without_rules_keeps_lines_with_empty_cells():
    page = [text(f"r{r}c{c}", 0.1 + 0.3 * c, 0.2 + 0.03 * r) for r in range(6) for c in range(3) if (r, c) not in {(1, 2), (5, 1)}]
    page.append(text("A caption further down", 0.1, 0.6, width=0.5))
    assert cells(page) == {(f"r{r}c{c}", r, c, 1, 1) for r in range(6) for c in range(3) if (r, c) not in {(1, 2), (5, 1)}}


def test_hardly_filled_columns_are_no_table():
    lines = [[text("a", 0.1, 0.1 + 0.03 * r), text("b", 0.5, 0.1 + 0.03 * r)] for r in range(3)]
    assert len(detect.stream_tables(lines)) == 1
    assert detect.stream_tables(lines[:2]) == []
    assert detect.stream_tables([[text("a", 0.1 + 0.1 * r, 0.1 + 0.03 * r), text("b", 0.5 + 0.1 * r, 0.1 + 0.03 * r)] for r in range(3)]) == []


def test_ruled_cells_span_where_no_rule_parts_them():
    flat = [rule(0.1, y, 0.7, y) for y in (0.1, 0.2, 0.4)] + [rule(0.3, 0.3, 0.7, 0.3)]
    upright = [rule(0.1, 0.1, 0.1, 0.4), rule(0.3, 0.2, 0.3, 0.4), rule(0.5, 0.1, 0.5, 0.4), rule(0.7, 0.1, 0.7, 0.4)]
    page = [text("wide", 0.15, 0.14), text("one", 0.55, 0.14), text("high", 0.15, 0.32), text("a", 0.35, 0.24), text("b", 0.55, 0.34)]
    assert cells(flat + upright + page) == {
        ("wide", 0, 0, 1, 2), ("one", 0, 2, 1, 1), ("high", 1, 0, 2, 1), ("a", 1, 1, 1, 1), ("b", 2, 2, 1, 1),
    }


def test_text_over_a_rule_takes_the_free_place():
    lines = [rule(0.1, y, 0.7, y) for y in (0.1, 0.2, 0.3)] + [rule(x, 0.1, x, 0.3) for x in (0.1, 0.3, 0.5, 0.7)]
    page = [text("reaches over", 0.12, 0.14, width=0.3), text("c", 0.55, 0.14), text("d", 0.12, 0.24, width=0.25), text("e", 0.38, 0.24)]
    assert cells(lines + page) == {("reaches over", 0, 0, 1, 2), ("c", 0, 2, 1, 1), ("d", 1, 0, 1, 1), ("e", 1, 1, 1, 1)}


def test_a_rule_parts_lines_and_many_columns_do_not():
    side = [text("left", 0.1, 0.2, width=0.3), text("right", 0.6, 0.2, width=0.3)]
    assert len(detect.lines_of(side)) == 1
    assert len(detect.lines_of(side, detect.barriers_of([rule(0.5, 0.1, 0.5, 0.4)]))) == 2
    steps = [text(str(i), 0.1 + 0.1 * i, 0.2 + 0.0115 * i) for i in range(6)] + [text("end", 0.9, 0.2)]
    assert ["0", "end"] in [[p.content for p in line if p.content in ("0", "end")] for line in detect.lines_of(steps)]


def test_columns_are_read_one_after_the_other():
    page = [text(f"{side}{i}", x, 0.1 + 0.05 * i, width=0.35) for i in range(3) for side, x in (("l", 0.05), ("r", 0.6))]
    assert [p.content for p in detect.reading_order(page)] == ["l0", "l1", "l2", "r0", "r1", "r2"]
    assert [p.content for p in detect.nearest_order(page, 1.0)][:2] == ["l0", "r0"]
    assert [p.content for p in detect.nearest_order(page, -1.0)] == ["l0", "l1", "l2", "r0", "r1", "r2"]


def test_orders_keep_all_texts():
    rng = random.Random(1)
    page = [text(str(i), rng.random() * 0.9, rng.random() * 0.9) for i in range(60)]
    for made in (detect.reading_order(page), detect.nearest_order(page)):
        assert sorted(p.content for p in made) == sorted(p.content for p in page)


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.html").write_text("<title>t</title><h1>Head</h1><p>the text, the end")
    (tmp_path / "b.bin").write_bytes(b"?")
    for command, wanted in [
        (["process", "--format", "markdown", str(tmp_path)], "# Head"), (["search", "the", str(tmp_path)], '"col_start": 10'),
        (["inspect", str(tmp_path)], '"headings": 1'), (["pages", str(tmp_path)], '"pages_total": 1'), (["health", str(tmp_path)], '"decode_failed"'),
    ]:
        assert cli.main(command) == 0
        assert wanted in capsys.readouterr().out
