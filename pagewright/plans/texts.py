"""Queries over texts and page texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import text as t
from pagewright.operators import pages as p
from pagewright.operators import sequence as q
from pagewright.plans.tables import LINES_SQL, lines, read


def _both(pattern: str) -> str:
    """A pattern as an SQL literal."""
    return pattern.replace("'", "''")


_LIST_SQL = f"""
    CASE WHEN regexp_matches(text, '{_both(t.LIST_BULLET)}') THEN 'bullet'
         WHEN regexp_matches(text, '{_both(t.LIST_ORDERED)}') THEN 'ordered' END
"""
_TRIMMED = "trim(text, ' ')"
_SPACED = "trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"


def search_hits(s, d):
    return p.search(read(s, d, "documents").select("doc_id", "text"), ["doc_id"], "The").select(
        "doc_id", "line", "col_start", "match_text"
    )


def search_first(s, d):
    turns = read(s, d, "conversations").select("conv_id", "turn", "text")
    hits = p.search(turns, ["conv_id", "turn"], "on ").select("conv_id", "turn", "line", "col_start")
    return p.first_hits(hits, ["conv_id", "turn", "line", "col_start"], 20)


def search_page(s, d):
    turns = read(s, d, "conversations").filter("turn = 1").select("conv_id", "turn", "text")
    return p.search(turns, ["conv_id", "turn"], "er").select("conv_id", "turn", "line", "col_start")


def _search_sql(source: str, keys: str, needle: str) -> str:
    """Places of a needle that cannot overlap itself, by the lengths of the pieces between."""
    n = len(needle)
    return f"""
        raw AS (SELECT {keys}, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM {source}),
        ln AS (SELECT {keys}, unnest(l) AS x, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS line FROM raw),
        pc AS (
            SELECT {keys}, line, x, string_split(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{needle}') AS a
            FROM ln
        ), hit AS (
            SELECT {keys}, line, x, unnest(list_transform(range(1, len(a)), lambda i: CAST(
                list_sum(list_transform(a[1 : i], lambda p: length(p))) + (i - 1) * {n} AS INTEGER))) AS col_start
            FROM pc WHERE len(a) > 1
        )
    """


#: Texts of several scripts; the last has Han letters, one kana and more Hangul.
_SCRIPTS = ["漢字 ", "漢字かな ", "한국 ", "عربي ", "עברית ", "", "漢字か한국 "]

QUERIES = {
    "search_hits": (
        search_hits,
        f"WITH {_search_sql('documents', 'doc_id', 'the')} SELECT doc_id, line, col_start, substr(x, col_start + 1, 3) AS match_text FROM hit",
    ),
    "search_first": (
        search_first,
        f"""WITH {_search_sql("conversations", "conv_id, turn", "on ")}
            SELECT conv_id, turn, line, col_start, (SELECT count(*) FROM hit) AS total FROM hit
            ORDER BY conv_id, turn, line, col_start LIMIT 20""",
    ),
    "search_page": (
        search_page,
        f"""WITH {_search_sql("(SELECT * FROM conversations WHERE turn = 1)", "conv_id, turn", "er")}
            SELECT conv_id, turn, line, col_start FROM hit""",
    ),
    "chunks": (
        lambda s, d: p.chunks(read(s, d, "conversations"), ["conv_id", "turn"]),
        "SELECT conv_id, turn, text, CAST(length(text) AS INTEGER) AS char_count FROM conversations WHERE trim(text) <> ''",
    ),
    "chunk_for_page": (
        lambda s, d: p.chunks(read(s, d, "conversations").filter("turn = 2"), ["conv_id", "turn"]),
        "SELECT conv_id, turn, text, CAST(length(text) AS INTEGER) AS char_count FROM conversations WHERE turn = 2 AND trim(text) <> ''",
    ),
    "pages_summary": (
        lambda s, d: p.page_summary(read(s, d, "conversations"), "conv_id"),
        """SELECT conv_id, count(*) AS pages_total, count(*) FILTER (WHERE trim(text) <> '') AS pages_with_content,
                  CAST(sum(length(text)) AS BIGINT) AS char_count, CAST(max(length(text)) AS BIGINT) AS longest_page
           FROM conversations GROUP BY conv_id""",
    ),
    "join_pages": (
        lambda s, d: p.join_pages(read(s, d, "conversations"), "conv_id", "turn"),
        "SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id",
    ),
    "text_lines": (
        lambda s, d: lines(s, d).groupBy("doc_id").agg(
            F.count("*").alias("n_lines"), F.max(F.char_length("text")).alias("longest"), F.count_if(F.col("text") == "").alias("blank")
        ),
        f"""WITH {LINES_SQL} SELECT doc_id, count(*) AS n_lines, CAST(max(length(text)) AS INTEGER) AS longest,
            count(*) FILTER (WHERE text = '') AS blank FROM lines GROUP BY doc_id""",
    ),
    "list_prefix": (
        lambda s, d: lines(s, d).withColumn("kind", t.list_kind(F.col("text"))).groupBy("kind").agg(
            F.count("*").alias("n"), F.sum("line").alias("lines")
        ),
        f"WITH {LINES_SQL}, k AS (SELECT line, {_LIST_SQL} AS kind FROM lines) SELECT kind, count(*) AS n, CAST(sum(line) AS BIGINT) AS lines FROM k GROUP BY kind",
    ),
    "list_marker": (
        lambda s, d: lines(s, d).groupBy("doc_id").agg(F.count_if(t.starts_list_marker(F.col("text"))).alias("markers")),
        f"WITH {LINES_SQL} SELECT doc_id, count(*) FILTER (WHERE regexp_matches(text, '{_both(t.MARKER)}')) AS markers FROM lines GROUP BY doc_id",
    ),
    "definition_prefix": (
        lambda s, d: lines(s, d).withColumn("term", t.definition_term(F.col("text"))).filter("term is not null").select("doc_id", "line", "term"),
        f"""WITH {LINES_SQL} SELECT doc_id, line, regexp_extract(text, '{_both(t.DEFINITION)}', 1) AS term
            FROM lines WHERE regexp_matches(text, '{_both(t.DEFINITION)}')""",
    ),
    "heading_valid": (
        lambda s, d: lines(s, d).withColumn("sound", t.heading_is_sound(F.col("text"))).select("doc_id", "line", "sound"),
        f"""WITH {LINES_SQL}, m AS (
                SELECT doc_id, line, {_TRIMMED} AS v, regexp_replace({_TRIMMED}, '(^|\\.)[A-Z]\\. ', '\\1# ', 'g') AS plain FROM lines
            )
            SELECT doc_id, line, length(v) BETWEEN 1 AND 100 AND NOT regexp_matches(v, '[?!]$')
                   AND NOT regexp_matches(v, '(?:^|[^0-9])\\.$') AND NOT regexp_matches(plain, '\\. [A-Z]')
                   AND NOT (length(v) > 50 AND contains(v, ',')) AS sound
            FROM m""",
    ),
    "continuation_text": (
        lambda s, d: lines(s, d).groupBy("doc_id").agg(F.count_if(t.is_continuation(F.col("text"))).alias("n")),
        f"WITH {LINES_SQL} SELECT doc_id, count(*) FILTER (WHERE regexp_matches(text, '{_both(t.CONTINUES)}')) AS n FROM lines GROUP BY doc_id",
    ),
    "text_direction": (
        lambda s, d: read(s, d, "documents").select("doc_id", t.direction(F.col("text")).alias("direction")),
        f"""SELECT doc_id, CASE WHEN regexp_matches(text, '{t.RTL}') AND regexp_matches(text, '{t.LTR}') THEN 'mixed'
                 WHEN regexp_matches(text, '{t.RTL}') THEN 'rtl' WHEN regexp_matches(text, '{t.LTR}') THEN 'ltr' ELSE 'unknown' END AS direction
            FROM documents""",
    ),
    "script_language": (
        lambda s, d: read(s, d, "part").select(
            "p_partkey", t.script_language(F.concat(F.element_at(F.array(*map(F.lit, _SCRIPTS)), (F.col("p_partkey") % 7 + 1).cast("int")), "p_name")).alias("lang")
        ),
        "SELECT p_partkey, ['zh', 'ja', 'ko', 'ar', 'he', NULL, 'ko'][p_partkey % 7 + 1] AS lang FROM part",
    ),
    "whitespace_collapse": (
        lambda s, d: read(s, d, "documents").select("doc_id", t.collapse_space(F.col("text")).alias("text")),
        f"SELECT doc_id, {_SPACED} AS text FROM documents",
    ),
    "repeated_artifacts": (
        # A source stands for a document and its rows for the pages.
        lambda s, d: p.repeated_lines(
            lines(s, d).join(read(s, d, "documents").select("doc_id", "source"), "doc_id"), "source", "doc_id", "text"
        ),
        f"""WITH {LINES_SQL}, n AS (
                SELECT source, doc_id, {_SPACED.replace("text", "lines.text")} AS line FROM lines JOIN documents USING (doc_id)
            )
            SELECT source, line, count(DISTINCT doc_id) AS pages FROM n
            WHERE length(line) > 3 AND NOT regexp_matches(line, '^[0-9 ]+$') GROUP BY source, line HAVING count(DISTINCT doc_id) >= 2""",
    ),
    "suppressed_artifacts": (
        lambda s, d: _suppressed(s, d),
        f"""WITH {LINES_SQL}, n AS (
                SELECT source, doc_id, {_SPACED.replace("text", "lines.text")} AS line FROM lines JOIN documents USING (doc_id)
            ), r AS (
                SELECT source, line FROM n WHERE length(line) > 3 AND NOT regexp_matches(line, '^[0-9 ]+$')
                GROUP BY source, line HAVING count(DISTINCT doc_id) >= 2
            )
            SELECT source, count(*) AS kept FROM n ANTI JOIN r USING (source, line) GROUP BY source""",
    ),
    "list_groups": (
        lambda s, d: q.islands(
            lines(s, d).withColumn("kind", F.coalesce(t.list_kind(F.col("text")), F.lit("text"))),
            ["doc_id"], ["line"], lambda w: F.col("kind") != F.lag("kind").over(w), "list_group",
        ).groupBy("doc_id", "list_group", "kind").agg(F.count("*").alias("n")),
        f"""WITH {LINES_SQL}, k AS (SELECT doc_id, line, coalesce({_LIST_SQL}, 'text') AS kind FROM lines),
            b AS (SELECT *, CASE WHEN kind <> lag(kind) OVER (PARTITION BY doc_id ORDER BY line) THEN 1 ELSE 0 END AS brk FROM k),
            i AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY doc_id ORDER BY line) AS INTEGER) AS list_group FROM b)
            SELECT doc_id, list_group, kind, count(*) AS n FROM i GROUP BY ALL""",
    ),
    "text_truncated": (
        lambda s, d: read(s, d, "documents").select(
            "doc_id", t.truncate(F.col("text"), 40).alias("text"), t.size_label(F.octet_length("text")).alias("size")
        ),
        """SELECT doc_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 39) || '…' ELSE text END AS text,
                  CASE WHEN octet_length(encode(text)) < 1024 THEN octet_length(encode(text)) || ' B'
                       ELSE format('{:.1f} KB', octet_length(encode(text)) / 1024.0) END AS size FROM documents""",
    ),
    "format_sniff": (
        lambda s, d: read(s, d, "pages").select("page_id", t.format_by_bytes(F.col("html").cast("binary")).alias("format")),
        """SELECT page_id, CASE WHEN starts_with(html, '%PDF-') THEN 'pdf'
                WHEN contains(lower(substr(html, 1, 2048)), '<!doctype html') OR contains(lower(substr(html, 1, 2048)), '<html') THEN 'html' END AS format
           FROM pages""",
    ),
    "format_extension": (
        lambda s, d: read(s, d, "documents").select(
            "doc_id",
            t.format_by_extension(
                F.concat(F.lit("a.b/f."), F.element_at(F.array(*[F.lit(x) for x in ("PDF", "docm", "xls", "htm", "txt")]), (F.col("doc_id") % 5 + 1).cast("int")))
            ).alias("format"),
        ),
        "SELECT doc_id, (['pdf', 'docx', 'xlsx', 'html', NULL])[CAST(doc_id % 5 + 1 AS INTEGER)] AS format FROM documents",
    ),
    "font_flags": (
        lambda s, d: _fonts(s, d),
        """WITH f AS (SELECT p_partkey, (['ABCDEF+Arial-BoldMT', 'Times-Italic', 'Helvetica-SemiLightBold', 'GHIJKL+Georgia-BlackOblique', 'Courier'])[CAST(p_partkey % 5 + 1 AS INTEGER)] AS name FROM part)
           SELECT p_partkey, regexp_replace(name, '^[A-Z]{6}[+]', '') AS font,
                  regexp_matches(lower(name), 'bold|black|heavy') AND NOT regexp_matches(lower(name), 'semilight|light|regular') AS bold,
                  regexp_matches(lower(name), 'italic|oblique') AS italic FROM f""",
    ),
    "hex_color": (
        lambda s, d: read(s, d, "part").select(
            "p_partkey", t.hex_color(F.lpad(F.hex((F.col("p_partkey") * 7919) % 16777216), 6, "0")).alias("c")
        ).select("p_partkey", "c.r", "c.g", "c.b"),
        """WITH n AS (SELECT p_partkey, (p_partkey * 7919) % 16777216 AS v FROM part)
           SELECT p_partkey, CAST(v // 65536 AS INTEGER) AS r, CAST(v // 256 % 256 AS INTEGER) AS g, CAST(v % 256 AS INTEGER) AS b FROM n""",
    ),
    "a1_ref": (
        lambda s, d: read(s, d, "part").select("p_partkey", t.cell_ref(_ref(F.col("p_partkey"))).alias("at")).select("p_partkey", "at.row", "at.col"),
        "SELECT p_partkey, CAST(p_partkey % 500 AS INTEGER) AS row, CAST(p_partkey * 7 % 702 AS INTEGER) AS col FROM part",
    ),
    "image_fingerprint": (
        lambda s, d: read(s, d, "documents").groupBy(t.image_fingerprint(F.col("text").cast("binary")).alias("f")).agg(
            F.count("*").alias("n"), F.min("doc_id").alias("doc_id")
        ).select("doc_id", "n"),
        """SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents
           GROUP BY octet_length(encode(text)), hex(encode(text))[1 : 512]""",
    ),
    "warnings_tally": (
        lambda s, d: p.warning_counts(_warnings(s, d), "doc_id", "kind"),
        f"""WITH w AS ({{w}}) SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}" for k in p.REPORTED)},
            count(*) FILTER (WHERE kind IN ({", ".join(f"'{k}'" for k in p.OTHER)})) AS other_warnings, count(*) AS warning_count
            FROM w GROUP BY doc_id""",
    ),
    "processability": (lambda s, d: _health(s, d), None),
    "health_ranking": (
        lambda s, d: _health(s, d).groupBy("health").agg(
            F.count("*").alias("documents"), F.sum("warning_count").alias("warnings")
        ).withColumn("rank", F.element_at(F.create_map(F.lit("ok"), F.lit(0), F.lit("degraded"), F.lit(1), F.lit("blocked"), F.lit(2)), F.col("health"))),
        None,
    ),
    "best_hint": (
        lambda s, d: p.best_hint(_hints(s, d), ["doc", "id"]),
        """WITH h AS ({h}) SELECT doc, id, arg_min(kind, struct_pack(a := -confidence, b := detector, c := kind)) AS kind,
               max(confidence) AS confidence FROM h GROUP BY doc, id""",
    ),
    "link_runs": (
        lambda s, d: p.link_runs(_spans(s, d), ["doc"], "o", "url", "t").withColumnRenamed("first", "o"),
        """WITH x AS (SELECT l_orderkey AS doc, l_linenumber AS o, min(CASE WHEN l_suppkey % 3 > 0 THEN 'u' || (l_suppkey % 3) END) AS url,
                  min(l_returnflag) AS t FROM lineitem GROUP BY 1, 2),
           r AS (SELECT *, o - row_number() OVER (PARTITION BY doc, url ORDER BY o) AS g FROM x WHERE url IS NOT NULL)
           SELECT doc, url, string_agg(t, ' ' ORDER BY o) AS text, min(o) AS o, count(*) AS n FROM r GROUP BY doc, url, g""",
    ),
}


def _suppressed(s, d):
    held = lines(s, d).join(read(s, d, "documents").select("doc_id", "source"), "doc_id")
    rules = p.repeated_lines(held, "source", "doc_id", "text")
    return p.without_lines(held, rules, "source", "text").groupBy("source").agg(F.count("*").alias("kept"))


def _fonts(s, d):
    names = ["ABCDEF+Arial-BoldMT", "Times-Italic", "Helvetica-SemiLightBold", "GHIJKL+Georgia-BlackOblique", "Courier"]
    name = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("p_partkey") % 5 + 1).cast("int"))
    held = read(s, d, "part").select("p_partkey", name.alias("name"))
    return held.select(
        "p_partkey", t.clean_font(F.col("name")).alias("font"), t.is_bold_font(F.col("name")).alias("bold"), t.is_italic_font(F.col("name")).alias("italic")
    )


def _ref(n):
    """A1 name of column n * 7 % 702 and row n % 500."""
    col = n * 7 % 702
    letter = lambda c: F.char(c + 65)
    name = F.when(col < 26, letter(col)).otherwise(F.concat(letter(F.floor(col / 26) - 1), letter(col % 26)))
    return F.concat(name, (n % 500 + 1).cast("string"))


_KINDS = [*p.REPORTED, *p.OTHER, *p.SILENT]
_WARNINGS_SQL = f"""SELECT event_id // 8 AS doc_id, ([{", ".join(f"'{k}'" for k in _KINDS)}])[CAST(user_id % {len(_KINDS)} + 1 AS INTEGER)] AS kind
    FROM events"""


def _warnings(s, d):
    kinds = F.array(*[F.lit(k) for k in _KINDS])
    return read(s, d, "events").select(
        F.floor(F.col("event_id") / 8).alias("doc_id"), F.element_at(kinds, (F.col("user_id") % len(_KINDS) + 1).cast("int")).alias("kind")
    )


def _health(s, d):
    docs = read(s, d, "documents").select(
        "doc_id",
        (F.col("doc_id") % 41 != 7).alias("readable"),
        (F.col("doc_id") % 37 != 5).alias("decoded"),
        F.lit(3).alias("pages_total"),
        F.when(F.col("n_chars") < 60, 0).otherwise(3).alias("pages_with_content"),
        (F.col("doc_id") % 3 > 0).alias("observed_pages"),
        F.when(F.col("lang") == "de", 1).otherwise(0).alias("heuristic_pages"),
    )
    return p.processability(docs, p.warning_counts(_warnings(s, d), "doc_id", "kind"), "doc_id")


_names_sql = ", ".join(
    ["CASE WHEN doc_id % 3 = 0 THEN 'approximate_pagination' END", "CASE WHEN lang = 'de' THEN 'heuristic_structure' END"]
    + [f"CASE WHEN {k} > 0 THEN '{k}' END" for k in [*p.REPORTED, "other_warnings"]]
)
_HEALTH_SQL = f"""
    WITH c AS (
        SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}" for k in p.REPORTED)},
               count(*) FILTER (WHERE kind IN ({", ".join(f"'{k}'" for k in p.OTHER)})) AS other_warnings, count(*) AS warning_count
        FROM ({_WARNINGS_SQL}) GROUP BY doc_id
    ), j AS (
        SELECT d.doc_id, CASE WHEN d.doc_id % 41 = 7 THEN 'encrypted' WHEN d.doc_id % 37 = 5 THEN 'decode_failed'
                    WHEN n_chars < 60 THEN 'empty_content' ELSE '' END AS blockers,
               d.doc_id % 41 <> 7 AND d.doc_id % 37 <> 5 AS known, n_chars, lang, c.* EXCLUDE (doc_id)
        FROM documents d LEFT JOIN c USING (doc_id)
    ), n AS (
        SELECT doc_id, blockers, CAST(3 AS INTEGER) AS pages_total,
               CAST(CASE WHEN known AND n_chars >= 60 THEN 3 ELSE 0 END AS INTEGER) AS pages_with_content,
               CASE WHEN known THEN coalesce(warning_count, 0) ELSE 0 END AS warning_count,
               CASE WHEN known THEN array_to_string(list_filter([{_names_sql}], lambda x: x IS NOT NULL), ',') ELSE '' END AS degradations
        FROM j
    ), r AS (
        SELECT doc_id, CASE WHEN blockers <> '' THEN 'blocked' WHEN degradations <> '' THEN 'degraded' ELSE 'ok' END AS health,
               blockers = '' AS is_processable, blockers, degradations, pages_total, pages_with_content, warning_count FROM n
    )
"""


def _hints(s, d):
    kinds = F.array(*[F.lit(k) for k in ("paragraph", "heading", "list", "table")])
    return read(s, d, "lineitem").select(
        F.col("l_orderkey").alias("doc"),
        (F.col("l_partkey") % 3).alias("id"),
        F.element_at(kinds, (F.col("l_suppkey") % 4 + 1).cast("int")).alias("kind"),
        F.element_at(F.array(*[F.lit(c) for c in (0.7, 0.8, 0.75, 0.5)]), (F.col("l_suppkey") % 4 + 1).cast("int")).alias("confidence"),
        (F.col("l_linenumber") % 2).alias("detector"),
    )


_HINTS_SQL = """SELECT l_orderkey AS doc, l_partkey % 3 AS id, (['paragraph', 'heading', 'list', 'table'])[CAST(l_suppkey % 4 + 1 AS INTEGER)] AS kind,
    CAST(([0.7, 0.8, 0.75, 0.5])[CAST(l_suppkey % 4 + 1 AS INTEGER)] AS DOUBLE) AS confidence, l_linenumber % 2 AS detector FROM lineitem"""


def _spans(s, d):
    return read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("o")).agg(
        F.min(F.when(F.col("l_suppkey") % 3 > 0, F.concat(F.lit("u"), (F.col("l_suppkey") % 3).cast("string")))).alias("url"),
        F.min("l_returnflag").alias("t"),
    )


QUERIES["warnings_tally"] = (QUERIES["warnings_tally"][0], QUERIES["warnings_tally"][1].replace("{w}", _WARNINGS_SQL))
QUERIES["best_hint"] = (QUERIES["best_hint"][0], QUERIES["best_hint"][1].replace("{h}", _HINTS_SQL))
QUERIES["processability"] = (QUERIES["processability"][0], f"{_HEALTH_SQL} SELECT * FROM r")
QUERIES["health_ranking"] = (
    QUERIES["health_ranking"][0],
    f"""{_HEALTH_SQL} SELECT health, count(*) AS documents, CAST(sum(warning_count) AS BIGINT) AS warnings,
        CAST(CASE health WHEN 'ok' THEN 0 WHEN 'degraded' THEN 1 ELSE 2 END AS INTEGER) AS rank FROM r GROUP BY health""",
)
