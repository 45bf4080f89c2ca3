"""Queries over decoded XLSX, DOCX and PDF files, which are made of table rows; their SQL reads the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.api import Corpus
from pagewright.plans import samples
from pagewright.plans.tables import read

#: Rows of a table in one file: the files grow in number with the table.
ROWS = 50


def _customers(s, d):
    return read(s, d, "customer").select(
        F.expr(f"c_custkey div {ROWS}").alias("doc_id"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"),
        F.col("c_acctbal").cast("double").alias("balance"), F.col("c_mktsegment").alias("segment"),
    )


def _suppliers(s, d):
    return read(s, d, "supplier").select(
        F.floor(F.col("s_suppkey") / ROWS).alias("doc_id"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"),
        F.col("s_acctbal").cast("double").alias("balance"), F.lit("").alias("segment"),
    )


def books(s, d) -> Corpus:
    return Corpus(samples.made(_customers(s, d), samples.workbook))


def reports(s, d) -> Corpus:
    return Corpus(samples.made(_suppliers(s, d), samples.report))


def statements(s, d) -> Corpus:
    return Corpus(samples.made(_customers(s, d), samples.statement))


def ledgers(s, d) -> Corpus:
    return Corpus(samples.made(_customers(s, d), samples.ledger))


def banners(s, d) -> Corpus:
    return Corpus(samples.made(_customers(s, d), samples.banner))


def listings(s, d) -> Corpus:
    return Corpus(samples.made(_customers(s, d), samples.listing))


def essays(s, d) -> Corpus:
    return Corpus(samples.made(_customers(s, d), samples.essay))


def _cells(tables, *more):
    return tables.select("doc_id", "first_page", F.explode("cells").alias("c")).select("doc_id", *more, "c.row", "c.col", "c.text")


_C = f"""c AS (SELECT c_custkey // {ROWS} AS doc_id, c_custkey AS key, c_name AS name, CAST(c_acctbal AS DOUBLE) AS balance, c_mktsegment AS segment,
           row_number() OVER (PARTITION BY c_custkey // {ROWS} ORDER BY c_custkey) AS n FROM customer)"""
_S = f"""c AS (SELECT s_suppkey // {ROWS} AS doc_id, s_suppkey AS key, s_name AS name,
           row_number() OVER (PARTITION BY s_suppkey // {ROWS} ORDER BY s_suppkey) AS n FROM supplier)"""
_PAGE = "CAST((n - 1) // 20 AS INTEGER)"

QUERIES = {
    "xlsx_cells": (
        lambda s, d: _cells(books(s, d).tables().filter("first_page = 1")),
        f"""WITH {_C}, x AS (
                SELECT doc_id, n, unnest([key::VARCHAR, name,
                    format('{{:,.2f}}', balance) || CASE WHEN key % 14 = 0 THEN ' [note: Ann: check ' || key || ']' WHEN key % 7 = 0 THEN ' [note: check ' || key || ']' ELSE '' END,
                    strftime(DATE '1899-12-30' + CAST(36526 + key % 1000 + CASE WHEN doc_id % 2 = 1 THEN 1462 ELSE 0 END AS INTEGER), '%Y-%m-%d'),
                    CASE WHEN balance > 0 THEN 'true' ELSE 'false' END, segment]) AS text, unnest(range(6)) AS col FROM c
                UNION ALL SELECT DISTINCT doc_id, 0, unnest(['Key', 'Name', 'Balance', 'Since', 'Active', 'Segment']), unnest(range(6)) FROM c
            ) SELECT doc_id, CAST(n AS INTEGER) AS row, CAST(col AS INTEGER) AS col, text FROM x""",
    ),
    "xlsx_spans": (
        lambda s, d: books(s, d).tables().filter("first_page = 2").select("doc_id", "cols", F.explode("cells").alias("c")).select("doc_id", "cols", "c.*"),
        f"""WITH {_C}, t AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
            SELECT doc_id, 3 AS cols, r.row, r.col, r.rowspan, r.colspan, r.text FROM (SELECT doc_id, unnest([
                {{'row': 0, 'col': 0, 'rowspan': 2, 'colspan': 2, 'text': 'Total'}}, {{'row': 0, 'col': 2, 'rowspan': 1, 'colspan': 1, 'text': n::VARCHAR}},
                {{'row': 1, 'col': 2, 'rowspan': 1, 'colspan': 1, 'text': 'n ' || n}}, {{'row': 2, 'col': 0, 'rowspan': 1, 'colspan': 1, 'text': '#ERR:N/A'}}]) AS r FROM t)""",
    ),
    "xlsx_links": (
        lambda s, d: books(s, d).links().select("doc_id", "page", "url", "text"),
        f"WITH {_C} SELECT doc_id, 1 AS page, 'http://x.y/' || key AS url, name AS text FROM c WHERE key % 5 = 0",
    ),
    "xlsx_sheets": (
        lambda s, d: books(s, d).outline().select("doc_id", "level", "text", "page"),
        f"WITH {_C} SELECT doc_id, 1 AS level, x AS text, CAST(p AS INTEGER) AS page FROM (SELECT DISTINCT doc_id, unnest(['Accounts', 'Sums']) AS x, unnest([1, 2]) AS p FROM c)",
    ),
    "xlsx_metadata": (
        lambda s, d: books(s, d).metadata().select("doc_id", "format", "page_count", "page_basis", "encrypted"),
        f"WITH {_C} SELECT DISTINCT doc_id, 'xlsx' AS format, 2 AS page_count, 'workbook_sheets' AS page_basis, false AS encrypted FROM c",
    ),
    "xlsx_warnings": (
        lambda s, d: books(s, d).warnings().groupBy("doc_id", "kind", "page").agg(F.count("*").alias("n")),
        f"""WITH {_C} SELECT doc_id, x AS kind, CAST(p AS INTEGER) AS page, CAST(1 AS BIGINT) AS n
            FROM (SELECT DISTINCT doc_id, unnest(['heuristic_inference', 'partial_extraction']) AS x, unnest([0, 1]) AS p FROM c)""",
    ),
    "xlsx_processability": (
        lambda s, d: books(s, d).processability().select("doc_id", "health", "is_processable", "degradations", "pages_total", "pages_with_content", "warning_count"),
        f"""WITH {_C} SELECT DISTINCT doc_id, 'degraded' AS health, true AS is_processable, 'approximate_pagination,partial_extraction' AS degradations,
            2 AS pages_total, 2 AS pages_with_content, CAST(2 AS BIGINT) AS warning_count FROM c""",
    ),
    "docx_outline": (
        lambda s, d: reports(s, d).outline().select("doc_id", "level", "text", "page"),
        f"WITH {_S} SELECT DISTINCT doc_id, 2 AS level, 'Report ' || doc_id AS text, 1 AS page FROM c",
    ),
    "docx_paragraphs": (
        lambda s, d: reports(s, d).nodes().filter("kind = 'paragraph'").select("doc_id", (F.col("page_start") + 1).alias("page"), F.trim("text").alias("text")),
        f"""WITH {_S} SELECT doc_id, CAST((n - 1) // 10 + 1 AS INTEGER) AS page, CASE WHEN key % 3 = 0 THEN 'new ' ELSE '' END || name || CASE WHEN key % 4 = 0 THEN '[' || (key + 1) || ']' ELSE '' END AS text FROM c
            UNION ALL SELECT doc_id, CAST((n - 1) // 10 + 1 AS INTEGER), 'see ' || key FROM c WHERE key % 5 = 0""",
    ),
    "docx_list_items": (
        lambda s, d: reports(s, d).nodes().filter("kind = 'list_item'").select("doc_id", "level", "text"),
        f"WITH {_S} SELECT doc_id, CAST(key % 2 AS INTEGER) AS level, 'item ' || key AS text FROM c",
    ),
    "docx_cells": (
        lambda s, d: reports(s, d).cells().filter("text <> ''").select("doc_id", "row", "col", "colspan", "text"),
        f"""WITH {_S} SELECT doc_id, CAST(n - 1 AS INTEGER) AS row, 0 AS col, 1 AS colspan, name AS text FROM c
            UNION ALL SELECT doc_id, CAST(n - 1 AS INTEGER), 1, CAST(2 - key % 2 AS INTEGER), key::VARCHAR FROM c
            UNION ALL SELECT doc_id, CAST(n - 1 AS INTEGER), 2, 1, 'odd' FROM c WHERE key % 2 = 1""",
    ),
    "docx_footnotes": (
        lambda s, d: reports(s, d).nodes().filter("kind = 'footnote'").select("doc_id", F.col("metadata")["id"].alias("id"), "text"),
        f"WITH {_S} SELECT doc_id, CAST(key + 1 AS VARCHAR) AS id, 'note ' || key AS text FROM c WHERE key % 4 = 0",
    ),
    "docx_links": (
        lambda s, d: reports(s, d).links().select("doc_id", "url", "text"),
        f"WITH {_S} SELECT doc_id, 'http://x.y/' || key AS url, 'see ' || key AS text FROM c WHERE key % 5 = 0",
    ),
    "docx_metadata": (
        lambda s, d: reports(s, d).metadata().select("doc_id", "format", "page_count", "page_basis"),
        f"""WITH {_S} SELECT doc_id, 'docx' AS format, CAST((count(*) - 1) // 10 + 1 AS INTEGER) AS page_count,
            CASE WHEN count(*) > 10 THEN 'explicit_breaks' ELSE 'single_logical_page' END AS page_basis FROM c GROUP BY doc_id""",
    ),
    "docx_warnings": (
        lambda s, d: reports(s, d).warnings().groupBy("doc_id", "kind").agg(F.count("*").alias("n")),
        f"WITH {_S} SELECT DISTINCT doc_id, 'tracked_change_resolved' AS kind, CAST(2 AS BIGINT) AS n FROM c WHERE key % 3 = 0",
    ),
    "pdf_cells": (
        lambda s, d: _cells(statements(s, d).tables(), F.col("first_page").alias("page")),
        f"""WITH {_C} SELECT doc_id, {_PAGE} + 1 AS page, CAST((n - 1) % 20 AS INTEGER) AS row, 0 AS col, name AS text FROM c
            UNION ALL SELECT doc_id, {_PAGE} + 1, CAST((n - 1) % 20 AS INTEGER), 1, format('{{:.2f}}', balance) FROM c""",
    ),
    "pdf_outline": (
        lambda s, d: statements(s, d).outline().select("doc_id", "level", "text", "page"),
        f"WITH {_C} SELECT DISTINCT doc_id, 1 AS level, 'Accounts ' || doc_id AS text, {_PAGE} + 1 AS page FROM c",
    ),
    "pdf_links": (
        lambda s, d: statements(s, d).links().select("doc_id", "page", "url", "text"),
        f"WITH {_C} SELECT DISTINCT doc_id, {_PAGE} + 1 AS page, 'http://x.y/' || doc_id || '/' || ({_PAGE} + 1) AS url, 'Accounts ' || doc_id AS text FROM c",
    ),
    "pdf_texts": (
        lambda s, d: statements(s, d).primitives().filter("kind = 'text'").select(
            "doc_id", "page", "content", "font_name", "font_size", "is_bold", F.round("x", 4).alias("x"), "origin", "space"
        ),
        f"""WITH {_C}, p AS (SELECT DISTINCT doc_id, {_PAGE} AS page FROM c), t AS (
                SELECT doc_id, page, 'Accounts ' || doc_id AS content, 'Helvetica-Bold' AS font, 24 AS size, true AS bold, 60 AS x FROM p
                UNION ALL SELECT doc_id, page, 'Page for document ' || doc_id || ' follows here.', 'Helvetica', 10, false, 60 FROM p
                UNION ALL SELECT doc_id, page, (page + 1)::VARCHAR, 'Helvetica', 10, false, 290 FROM p
                UNION ALL SELECT doc_id, {_PAGE}, name, 'Helvetica', 10, false, 66 FROM c
                UNION ALL SELECT doc_id, {_PAGE}, format('{{:.2f}}', balance), 'Helvetica', 10, false, 306 FROM c
            ) SELECT doc_id, page, content, font AS font_name, CAST(size AS DOUBLE) AS font_size, bold AS is_bold, round(x / 600, 4) AS x,
                     'observed' AS origin, 'physical_page' AS space FROM t""",
    ),
    "pdf_rules": (
        lambda s, d: statements(s, d).primitives().filter("kind = 'line'").groupBy("doc_id", "page").agg(
            F.count("*").alias("n"), F.round(F.min("x"), 4).alias("x"), F.round(F.max("width"), 4).alias("width"), F.round(F.max("height"), 4).alias("height")
        ),
        f"""WITH {_C} SELECT doc_id, {_PAGE} AS page, count(*) + 4 AS n, 0.1 AS x, 0.8 AS width, round(count(*) * 20 / 800, 4) AS height FROM c GROUP BY 1, 2""",
    ),
    "pdf_metadata": (
        lambda s, d: statements(s, d).metadata().select("doc_id", "format", "page_count", "page_basis", "encrypted"),
        f"WITH {_C} SELECT doc_id, 'pdf' AS format, CAST((count(*) - 1) // 20 + 1 AS INTEGER) AS page_count, 'physical_pages' AS page_basis, false AS encrypted FROM c GROUP BY doc_id",
    ),
    "pdf_search": (
        lambda s, d: statements(s, d).search("ACCOUNTS").select("doc_id", "page", "match_text"),
        f"WITH {_C} SELECT DISTINCT doc_id, {_PAGE} + 1 AS page, 'Accounts' AS match_text FROM c",
    ),
    "pdf_artifacts": (
        lambda s, d: statements(s, d).decoded("artifacts").select("doc_id", F.explode("artifacts").alias("a")).select("doc_id", "a.kind", "a.text"),
        f"WITH {_C} SELECT DISTINCT doc_id, 'page_footer' AS kind, CAST({_PAGE} + 1 AS VARCHAR) AS text FROM c",
    ),
    "pdf_cross_page_tables": (
        lambda s, d: ledgers(s, d).tables().select("doc_id", "rows", "cols", "first_page", "last_page", "is_cross_page"),
        f"""WITH {_C} SELECT doc_id, CAST(count(*) + 1 AS INTEGER) AS rows, 2 AS cols, 1 AS first_page, CAST((count(*) - 1) // 20 + 1 AS INTEGER) AS last_page,
            count(*) > 20 AS is_cross_page FROM c GROUP BY doc_id""",
    ),
    "pdf_cross_page_cells": (
        lambda s, d: _cells(ledgers(s, d).tables()),
        f"""WITH {_C} SELECT doc_id, CAST(n AS INTEGER) AS row, 0 AS col, name AS text FROM c
            UNION ALL SELECT doc_id, CAST(n AS INTEGER), 1, format('{{:.2f}}', balance) FROM c
            UNION ALL SELECT DISTINCT doc_id, 0, unnest([0, 1]), unnest(['Name', 'Balance']) FROM c""",
    ),
    "pdf_spans": (
        lambda s, d: banners(s, d).cells().select("doc_id", "row", "col", "rowspan", "colspan", "text"),
        f"""WITH {_C} SELECT doc_id, CAST(n + {_PAGE} AS INTEGER) AS row, 0 AS col, 1 AS rowspan, 1 AS colspan, name AS text FROM c
            UNION ALL SELECT doc_id, CAST(n + {_PAGE} AS INTEGER), 1, 1, 1, format('{{:.2f}}', balance) FROM c
            UNION ALL SELECT DISTINCT doc_id, 21 * {_PAGE}, 0, 1, 2, 'Accounts ' || doc_id || ', page ' || ({_PAGE} + 1) FROM c""",
    ),
    "pdf_unruled_cells": (
        lambda s, d: listings(s, d).cells().select("doc_id", "row", "col", "text"),
        f"""WITH {_C}, x AS (SELECT *, count(*) OVER (PARTITION BY doc_id, {_PAGE}) AS lines FROM c)
            SELECT doc_id, CAST(n - 1 AS INTEGER) AS row, 0 AS col, key::VARCHAR AS text FROM x WHERE lines > 2
            UNION ALL SELECT doc_id, CAST(n - 1 AS INTEGER), 1, name FROM x WHERE lines > 2
            UNION ALL SELECT doc_id, CAST(n - 1 AS INTEGER), 2, format('{{:.2f}}', balance) FROM x WHERE lines > 2 AND (n - 1) % 20 % 5 <> 3""",
    ),
    "pdf_cross_page_paragraphs": (
        lambda s, d: essays(s, d).nodes().filter("kind = 'paragraph'").select("doc_id", "text", (F.col("page_end") - F.col("page_start")).alias("pages")),
        f"""WITH {_C}, p AS (SELECT doc_id, max({_PAGE}) + 1 AS pages, string_agg('and account ' || lpad(key::VARCHAR, 12, '0') || ' of ' || name, ' ' ORDER BY key) AS text FROM c GROUP BY doc_id)
            SELECT doc_id, text, pages FROM p UNION ALL SELECT doc_id, 'The end.', 1 FROM p""",
    ),
}
