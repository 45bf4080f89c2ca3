from __future__ import annotations

from pagewright.operators.assemble import assemble, flatten
from pagewright.operators.render import render
from pagewright.plans import documents
from pagewright.sources import html
from pagewright.sources.decode import PARTS, decode_one


def kinds(text):
    return [(p.content, p.hints[0].kind if p.hints else None) for p in html.decode(text.encode()).primitives]


def test_page_with_section_and_table():
    d = html.decode(
        b"<html lang=en><title> News </title><body><article aria-label=x><h1>Update</h1><p>One\n  two.</p>"
        b"<table><tr><th>Name<th>Status<tr><td>Alice<td>Active</table></article></body></html>"
    )
    assert d.title == "News" and not d.warnings
    assert [p.hints[0].kind for p in d.primitives] == [
        "section_start", "heading", "paragraph", "table_header", "table_header", "table_cell", "table_cell", "section_end"
    ]
    assert d.primitives[2].content == "One two." and d.primitives[2].lang == "en"
    assert [p.order for p in d.primitives] == list(range(8))


def test_end_tags_may_be_missing():
    assert kinds("<p><b>a<br><p>b<ul><li>c<li>d<ul><li>e</ul></ul>f") == [
        ("f", "paragraph"), ("a", "paragraph"), ("b", "paragraph"), ("c", "list_item"), ("d", "list_item"), ("e", "list_item")
    ]


def test_hidden_and_silent_elements():
    text = "<p hidden>a</p><p style='display:none'>b</p><script>c</script><p>d<span style='visibility:hidden'>e</span></p>"
    assert kinds(text) == [("d", "paragraph")]
    assert kinds("<input type=hidden value=a><input placeholder=b><input value=c placeholder=d>") == [("b", "paragraph"), ("c", "paragraph")]


def test_roles_and_display():
    assert kinds("<div role=heading aria-level=3>a</div><div role=list><div role=listitem>b</div></div>") == [("a", "heading"), ("b", "list_item")]
    d = html.decode(b"<div style='display:table'><div style='display:table-row'><div style='display:table-cell'>x</div></div></div>")
    assert [p.hints[0].kind for p in d.primitives] == ["table_cell"]
    assert {w.kind for w in d.warnings} == {"heuristic_inference"}


def test_spans_are_bounded_and_block_cells():
    d = html.decode(b"<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td colspan=999>d</table>")
    assert [(p.content, p.hints[0].row, p.hints[0].col) for p in d.primitives] == [("a", 0, 0), ("b", 0, 1), ("c", 1, 1), ("d", 2, 0)]
    assert d.primitives[-1].hints[0].colspan == 256 and d.warnings[0].kind == "truncated_content"


def test_white_space_rules():
    assert kinds("<pre>a\n  b</pre>") == [("a\n  b", "code_block")]
    assert kinds("<p style='white-space:pre-line'>a  b\n\nc</p>") == [("a b\nc", "paragraph")]
    assert kinds("<p>é</p>".replace("é", "é")) == [("é", "paragraph")]


def test_links_outside_of_text_keep_their_target():
    d = html.decode(b"<div><a href=/x>go</a></div><p>in <a href=/y>text</a></p>")
    assert [(p.content, [h.url for h in p.hints if h.kind == "link"]) for p in d.primitives] == [("go", ["/x"]), ("in text", [])]


def test_deep_elements_warn():
    d = html.decode(("<div>" * 200 + "x").encode())
    assert [w.kind for w in d.warnings].count("truncated_content") == 1


def test_rendered_forms():
    root, _, _ = assemble(html.decode(b"<h2>T</h2><ol><li>a<li>b</ol><blockquote>q</blockquote><img alt=pic>").primitives)
    assert render(root) == "T\n\n1. a\n2. b\n\n> q\n[Image: pic]\n"
    assert render(root, True) == "## T\n\n1. a\n2. b\n\n> q\n![pic]()\n"
    assert [n["kind"] for n in flatten(root)] == ["document", "heading", "list", "list_item", "list_item", "block_quote", "image"]


def test_a_broken_document_is_a_row_with_an_error():
    r = decode_one(b"\xff\xfe", "html", list(PARTS))
    assert r["error"].startswith("not UTF-8") and r["nodes"] is None
    assert decode_one(b"x", None, ["text"])["error"] and decode_one(None, "html", ["text"])["error"]
    assert decode_one(b"", "html", ["text"]) == {"error": None, "format": "html", "text": ""}


def test_conversation_pages_hold_whole_turns(spark, tmp_path):
    late = " " * 60 + "late & <b> " + "x" * 90 + " end"
    rows = [(1, 0, "user", late), (1, 1, "assistant", " "), (1, 2, "user", "short")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    made = documents._conversations(spark, str(tmp_path))
    texts = {r.row: r.text for r in made.cells().filter("col = 1 and row > 0").collect()}
    assert texts[1] == late.strip() and texts[3] == "short"
    assert documents.QUERIES["html_tables"][0](spark, str(tmp_path)).first().n_cells == 3 + 3 + 2
