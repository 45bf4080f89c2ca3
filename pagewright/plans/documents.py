"""Queries over decoded documents, with SQL where the pages are plain enough for patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.api import Corpus
from pagewright.operators import structure
from pagewright.plans.tables import read
from pagewright.streaming.pages import page_batch

#: Entities back to characters, the ampersand last.
_PLAIN = "replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


def corpus(s, d) -> Corpus:
    return Corpus.of_html(read(s, d, "pages").select("page_id", "html"), "page_id", "html")


def _events(s, d):
    return read(s, d, "events").select(
        F.col("user_id").alias("doc_id"), F.floor(F.col("value") * 10).cast("int").alias("page"), F.col("event_id").alias("order"), F.col("event_type").alias("content")
    )


def _conversations(s, d):
    """Conversations as HTML documents: a heading, a table of the turns and a list."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    held = read(s, d, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    clean = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    rows = F.array_join(F.transform("t", lambda t: F.concat(F.lit("<tr><td>"), t["role"], F.lit("<td colspan=2>"), clean(t["text"]))), "")
    items = F.array_join(F.transform("t", lambda t: F.concat(F.lit("<li>"), t["role"])), "")
    html = F.concat(
        F.lit("<html><body><section aria-label=s><h1>Conversation "), F.col("conv_id"), F.lit("</h1><table><tr><th>role<th>a<th>b"), rows,
        F.lit("</table></section><ol>"), items, F.lit("</ol><a href='/x'>x</a><a href='/y'>y</a><div style='display:none'>no</div></body></html>"),
    )
    return Corpus.of_html(held.select("conv_id", html.alias("html")), "conv_id", "html")


_TURNS = "FROM conversations GROUP BY conv_id"

QUERIES = {
    "outline_h1": (
        lambda s, d: corpus(s, d).outline().select("page_id", "level", "text"),
        f"SELECT page_id, 1 AS level, trim({_PLAIN.format("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")}) AS text FROM pages",
    ),
    "html_title": (
        lambda s, d: corpus(s, d).metadata().select("page_id", "title", "page_count"),
        f"SELECT page_id, trim({_PLAIN.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}) AS title, 1 AS page_count FROM pages",
    ),
    "html_block_counts": (
        lambda s, d: structure.kind_counts(corpus(s, d).nodes(), "page_id").select("page_id", "headings", "tables", "lists", "images"),
        """SELECT page_id, CAST(len(regexp_extract_all(html, '<h1>')) AS BIGINT) AS headings, CAST(0 AS BIGINT) AS tables,
                  CAST(len(regexp_extract_all(html, '<ul>')) AS BIGINT) AS lists, CAST(0 AS BIGINT) AS images FROM pages""",
    ),
    "html_list_items": (
        lambda s, d: corpus(s, d).nodes().filter("kind = 'list_item'").groupBy("page_id").agg(F.count("*").alias("items"), F.max("level").alias("depth")),
        "SELECT page_id, CAST(len(regexp_extract_all(html, '<li>')) AS BIGINT) AS items, 0 AS depth FROM pages",
    ),
    "html_primitives": (lambda s, d: corpus(s, d).primitives().select("page_id", "order", "kind", "content", "font_size", "is_bold"), None),
    "html_text": (lambda s, d: corpus(s, d).text(), None),
    "html_markdown": (lambda s, d: corpus(s, d).markdown(), None),
    "html_json": (lambda s, d: corpus(s, d).json(), None),
    "html_chunks": (lambda s, d: corpus(s, d).chunks(), None),
    "html_search": (lambda s, d: corpus(s, d).search("the"), None),
    "html_warnings": (lambda s, d: corpus(s, d).warnings(), None),
    "html_inspect": (lambda s, d: corpus(s, d).inspect(), None),
    "html_processability": (lambda s, d: corpus(s, d).processability(), None),
    "html_sections": (lambda s, d: structure.subtree_text(corpus(s, d).nodes(), "page_id", "section"), None),
    "html_tables": (
        lambda s, d: _conversations(s, d).tables().select("conv_id", "rows", "cols", "first_page", F.size("cells").alias("n_cells")),
        f"""SELECT conv_id, CAST(count(*) + 1 AS INTEGER) AS rows, 3 AS cols, 1 AS first_page,
                   CAST(3 + count(*) + count(*) FILTER (WHERE trim(text) <> '') AS INTEGER) AS n_cells {_TURNS}""",
    ),
    "html_cells": (
        lambda s, d: _conversations(s, d).cells().filter("col = 0 and row > 0").select("conv_id", "row", "text"),
        "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS row, role AS text FROM conversations",
    ),
    "html_links": (
        lambda s, d: _conversations(s, d).links().select("conv_id", "page", "url", "text"),
        f"SELECT conv_id, 1 AS page, '/' || x AS url, x AS text FROM (SELECT conv_id, unnest(['x', 'y']) AS x {_TURNS})",
    ),
    "html_counts": (
        lambda s, d: structure.kind_counts(_conversations(s, d).nodes(), "conv_id").select("conv_id", "tables", "headings", "lists", "paragraphs"),
        f"""SELECT conv_id, CAST(1 AS BIGINT) AS tables, CAST(1 AS BIGINT) AS headings, CAST(1 AS BIGINT) AS lists, CAST(1 AS BIGINT) AS paragraphs {_TURNS}""",
    ),
    "page_flush": (
        lambda s, d: page_batch(_events(s, d)).select("doc_id", "page", "n", "late", "truncated"),
        """WITH e AS (SELECT user_id AS doc_id, CAST(floor(value * 10) AS INTEGER) AS page, event_id FROM events),
           o AS (SELECT *, max(page) OVER (PARTITION BY doc_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS open FROM e)
           SELECT doc_id, open AS page, CAST(count(*) AS INTEGER) AS n, CAST(count(*) FILTER (WHERE page < open) AS INTEGER) AS late,
                  count(*) >= 50000 AS truncated FROM o GROUP BY doc_id, open""",
    ),
}
