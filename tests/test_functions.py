from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from pagewright.functions import numfmt, text
from pagewright.operators import pages, structure
from pagewright.operators.sequence import islands

CASES = [
    (1234.567, "#,##0.00", "1,234.57"), (0.256, "0%", "26%"), (12345, "0.00E+00", "1.23E+04"), (96.25, "# ?/?", "96 1/4"),
    (-5, "0.00;(0.00)", "(5.00)"), (0, "0;-0;zero", "zero"), (43831, "yyyy-mm-dd", "2020-01-01"), (43831.5, "m/d/yyyy h:mm", "1/1/2020 12:00"),
    (1.5, "[h]:mm:ss", "36:00:00"), (1e12, "General", "1E+12"), (60, "d-mmm-yy", "29-Feb-00"), (0.75, "h:mm AM/PM", "6:00 PM"),
    (1234567, "#,##0,", "1,235"), (5, "000", "005"), (12, '"x"0" y"', "x12 y"), (150, "[>=100]0.0;0.00", "150.0"),
    (50, "[>=100]0.0;0.00", "50.00"), (123456, "##0.0E+0", "123.5E+3"), (1.005, "0.00", "1.00"), (-0.001, "0.00", "0.00"),
    (61, "d-mmm-yyyy", "1-Mar-1900"), (5551234, "000-0000", "555-1234"), (1, "#.##", "1."), (7, "@", "7"), (-1, "General", "-1"),
    (0.0001, "General", "0.0001"), (0.00001, "General", "1E-05"), (12345678901.5, "General", "12345678902"),
]


@pytest.mark.parametrize(("value", "code", "shown"), CASES)
def test_number_formats(value, code, shown):
    assert numfmt.format_value(value, code)[0] == shown


def test_dates_outside_the_calendar_fall_back():
    assert numfmt.format_value(-1, "yyyy") == ("-1", "a number outside the calendar")
    assert numfmt.format_value(0, "yyyy-mm-dd", date_1904=True)[0] == "1904-01-01"
    assert numfmt.format_text("x", '0;0;0;"<"@">"') == "<x>"


def test_list_grammars(spark):
    lines = ["1. a", "(iv) b", "• c", "- d", "-", "100. e", "abcd. f", "xxi) g", "", "word", "12) h", "(12) i", "a.b"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string")
    got = rows.select("x", text.list_kind(F.col("x")).alias("k"), text.starts_list_marker(F.col("x")).alias("m")).collect()
    assert {r.x for r in got if r.k == "ordered"} == {"1. a", "(iv) b", "12) h", "(12) i"}
    assert {r.x for r in got if r.k == "bullet"} == {"• c", "- d"}
    assert {r.x for r in got if r.m} == {"1. a", "(iv) b", "• c", "- d", "100. e", "abcd. f", "xxi) g", "12) h", "(12) i"}


def test_headings(spark):
    good, bad = ["A plan", "Section 3.", "J. Smith", "U.S. Army"], ["A. B. Smith", "What?", "It ends.", "One. Two", "", "x" * 101, "a, " * 20]
    rows = spark.createDataFrame([(x,) for x in good + bad], "x string")
    assert {r.x for r in rows.filter(text.heading_is_sound(F.col("x"))).collect()} == set(good)


def test_search_overlaps_and_nulls(spark):
    held = spark.createDataFrame([(1, "xaAaa\r\nAA"), (2, None), (3, ""), (4, "ÄÄ ää\n"), (5, "a.a+a")], "doc_id long, text string")
    got = [(r.doc_id, r.line, r.col_start, r.match_text) for r in pages.search(held, ["doc_id"], "aa").orderBy("doc_id", "line", "col_start").collect()]
    assert got == [(1, 1, 1, "aA"), (1, 1, 2, "Aa"), (1, 1, 3, "aa"), (1, 2, 0, "AA")]
    assert [r.col_start for r in pages.search(held, ["doc_id"], "ä").collect()] == [3, 4]
    assert [r.col_start for r in pages.search(held, ["doc_id"], "a+").collect()] == [2]
    assert pages.search(held, ["doc_id"], "").count() == 0


def test_islands_and_owners(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate("aabba")], "k int, i int, v string")
    got = islands(rows, ["k"], ["i"], lambda w: F.col("v") != F.lag("v").over(w)).orderBy("i").collect()
    assert [r.island for r in got] == [0, 0, 1, 1, 2]
    nodes = spark.createDataFrame(
        [(1, 0, 0, "document"), (1, 1, 1, "table"), (1, 2, 2, "table_row"), (1, 3, 3, "table_cell"), (1, 4, 1, "paragraph"), (1, 5, 1, "table"), (1, 6, 2, "table_row")],
        "d int, node_id int, depth int, kind string",
    )
    got = structure.within(nodes, "d", "table").orderBy("node_id").collect()
    assert [r.owner for r in got] == [None, 1, 1, 1, None, 5, 5]


def test_cell_references(spark):
    rows = spark.createDataFrame([("A1",), ("$C$10",), ("ZZ3",), ("1A",), (None,), ("A0",)], "x string")
    got = {r.x: (r.c.row, r.c.col) if r.c else None for r in rows.select("x", text.cell_ref(F.col("x")).alias("c")).collect()}
    assert got == {"A1": (0, 0), "$C$10": (9, 2), "ZZ3": (2, 701), "1A": None, None: None, "A0": None}


def test_language_by_letters():
    said = {"漢字": "zh", "漢字かな": "ja", "한국": "ko", "か한": "ja", "か한국": "ko", "عربي": "ar", "עברית": "he", "plain": None, "": None, "עע عع": "he"}
    count = lambda s: lambda letters: len(re.findall(letters, s))
    assert {s: text.language_of_letters(count(s)) for s in said} == said
