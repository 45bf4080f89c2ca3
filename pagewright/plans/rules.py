"""Queries over single rules of page analysis, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagewright.operators import sequence as q
from pagewright.plans.tables import BOXES_SQL, boxes, read


def target_cols(s, d):
    """Columns of a character grid: the 90th of 100 characters-per-width ratios, an element and no mean, within 60 to 250."""
    ratio = boxes(s, d).select(F.floor(F.col("doc") / 80).alias("page"), ((F.col("id") * 7 + 3) / F.col("box.width")).alias("r"))
    held = ratio.groupBy("page").agg(F.array_sort(F.collect_list("r")).alias("r"))
    at = F.least(F.floor(F.size("r") * 0.9) + 1, F.size("r")).cast("int")
    return held.select("page", F.least(F.greatest(F.round(F.element_at("r", at)), F.lit(60.0)), F.lit(250.0)).cast("int").alias("cols"))


def majority_cells(s, d):
    """Each text's cell by the most of its characters, of as many the upper left."""
    votes = read(s, d, "lineitem").select(
        F.floor(F.col("l_orderkey") / 8).alias("text"), (F.col("l_partkey") % 4).cast("int").alias("row"), (F.col("l_suppkey") % 3).cast("int").alias("col")
    )
    n = votes.groupBy("text", "row", "col").agg(F.count("*").alias("n"))
    best = F.min_by(F.struct("row", "col", "n"), F.struct(-F.col("n"), F.col("row"), F.col("col"))).alias("b")
    return n.groupBy("text").agg(best).select("text", "b.row", "b.col", "b.n")


def header_rows(s, d):
    """Whether row 0 of a table is a header: all bold, or set over a tenth larger than the body, or in another font."""
    c = read(s, d, "lineitem").select(
        F.floor(F.col("l_orderkey") / 20).alias("t"), (F.col("l_linenumber") == 1).alias("top"), (F.col("l_partkey") % 5 > 0).alias("bold"),
        (F.col("l_quantity") + F.when(F.col("l_linenumber") == 1, F.col("l_orderkey") % 7).otherwise(0)).alias("size"), F.col("l_returnflag").alias("font"),
    )
    fonts = c.groupBy("t", "top", "font").agg(F.count("*").alias("n")).groupBy("t").agg(
        F.min_by(F.when(F.col("top"), F.col("font")), F.when(F.col("top"), F.struct(-F.col("n"), F.col("font")))).alias("f0"),
        F.min_by(F.when(~F.col("top"), F.col("font")), F.when(~F.col("top"), F.struct(-F.col("n"), F.col("font")))).alias("f1"),
    )
    rules = c.groupBy("t").agg(
        F.bool_and(F.when(F.col("top"), F.col("bold"))).alias("all_bold"),
        (F.avg(F.when(F.col("top"), F.col("size"))) > 1.1 * F.avg(F.when(~F.col("top"), F.col("size")))).alias("larger"),
    )
    return rules.join(fonts, "t").filter("f0 is not null and f1 is not null").select("t", "all_bold", "larger", (F.col("f0") != F.col("f1")).alias("other_font"))


def snapped_rules(s, d):
    """Ruling segments on a character grid of 100 by 50: across, down, or neither."""
    b = F.col("box")
    seg = boxes(s, d).select("doc", "id", (b["x"] * 100).alias("c0"), ((b["x"] + F.when(F.col("id") % 2 == 0, b["width"]).otherwise(0.002)) * 100).alias("c1"),
                             (b["y"] * 50).alias("r0"), ((b["y"] + F.when(F.col("id") % 3 == 0, b["height"]).otherwise(0.001)) * 50).alias("r1"))
    dc, dr = F.col("c1") - F.col("c0"), F.col("r1") - F.col("r0")
    kind = F.when((dr < 0.5) & (dc >= 0.5), "across").when((dc < 0.5) & (dr >= 0.5), "down")
    return seg.withColumn("kind", kind).filter("kind is not null").groupBy("doc", "kind").agg(F.count("*").alias("n"))


def merged_runs(s, d):
    """Runs of one style with at most two columns between them are one run."""
    r = boxes(s, d).groupBy(F.floor(F.col("doc") / 10).alias("line"), F.floor(F.col("box.x") * 80).cast("int").alias("c")).agg(
        F.min("id").alias("id"), F.max(F.floor(F.col("box.width") * 20 + 1)).cast("int").alias("n")
    ).withColumn("style", F.col("id") % 3)
    w = Window.partitionBy("line").orderBy("c")
    held = r.withColumn("gap", F.col("c") - F.lag(F.col("c") + F.col("n")).over(w)).withColumn("same", F.col("style") == F.lag("style").over(w))
    runs = q.islands(held, ["line"], ["c"], lambda _: ~F.col("same") | (F.col("gap") > 2), "run")
    return runs.groupBy("line", "run").agg(F.min("c").alias("c"), F.max(F.col("c") + F.col("n")).alias("end"), F.min("style").alias("style"))


def page_counts(s, d):
    """Pages of a document by what was laid out, else by its breaks, else by what its application says; the most of all."""
    o = read(s, d, "orders").select("o_orderkey", (F.col("o_custkey") % 4).alias("rendered"), (F.col("o_orderkey") % 3).alias("breaks"), (F.col("o_custkey") % 7).alias("app"))
    basis = F.when(F.col("rendered") > 0, "rendered").when(F.col("breaks") > 0, "breaks").when(F.col("app") > 0, "application").otherwise("single")
    return o.select("o_orderkey", F.greatest(F.col("rendered") + 1, F.col("breaks") + 1, "app").alias("pages"), basis.alias("basis"))


def inline_markdown(s, d):
    p = read(s, d, "part").select("p_partkey", F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("t"), (F.col("p_partkey") % 2 == 0).alias("b"), (F.col("p_partkey") % 3 == 0).alias("i"), (F.col("p_partkey") % 5 == 0).alias("l"))
    marks = F.concat(F.when(F.col("b"), "**").otherwise(""), F.when(F.col("i"), "*").otherwise(""))
    text = F.when(F.col("l"), F.concat(F.lit("["), "t", F.lit("](/"), "t", F.lit(")"))).otherwise(F.concat(marks, "t", marks))
    return p.select("p_partkey", text.alias("text"))


def unique_warnings(s, d):
    """The first warning of each key, and a summary for keys that came again."""
    e = read(s, d, "events").select("event_id", (F.col("user_id") % 40).alias("scope"), F.col("event_type").alias("kind"))
    return e.groupBy("scope", "kind").agg(F.min("event_id").alias("first"), F.count("*").alias("n")).withColumn("summary", F.col("n") > 1)


def multicolumn(s, d):
    """Whether the left edges of a page's texts stand in two heaps of at least 15 % each, over 0.15 apart."""
    x = boxes(s, d).select(F.floor(F.col("doc") / 20).alias("page"), F.floor(F.col("box.x") * 100 / 5).cast("int").alias("bin"))
    n = x.groupBy("page", "bin").agg(F.count("*").alias("n"))
    every = Window.partitionBy("page")
    heaps = n.withColumn("all", F.sum("n").over(every)).filter(F.col("n") >= 0.15 * F.col("all"))
    return heaps.groupBy("page").agg(F.count("*").alias("heaps"), (F.max("bin") - F.min("bin") > 3).alias("multicolumn"))


def level_lookup(s, d):
    """Each size with the level of the nearest size of the map, at most half a point away."""
    sizes = read(s, d, "lineitem").select(F.floor(F.col("l_orderkey") / 50).alias("doc"), (F.col("l_quantity") + F.col("l_linenumber") / 8).alias("size")).distinct()
    marks = q.level_map(sizes, ["doc"], "size").select("doc", F.col("size").alias("mark"), "level")
    # A mark within half a point lies in the same bin of one point or in a neighbour.
    near = sizes.withColumn("bin", F.explode(F.array(*[F.floor("size") + k for k in (-1, 0, 1)]))).join(
        marks.withColumn("bin", F.floor("mark")), ["doc", "bin"]
    ).filter(F.abs(F.col("size") - F.col("mark")) <= 0.5)
    best = F.min_by("level", F.struct(F.abs(F.col("size") - F.col("mark")), F.col("level"))).alias("level")
    return near.groupBy("doc", "size").agg(best)


_LEVELS = """
    z AS (SELECT DISTINCT l_orderkey // 50 AS doc, l_quantity + l_linenumber / 8 AS size FROM lineitem),
    m AS (SELECT doc, size, row_number() OVER (PARTITION BY doc ORDER BY size DESC) AS k FROM z),
    f AS (
        SELECT doc, k, size AS kept, true AS is_kept, size FROM m WHERE k = 1
        UNION ALL
        SELECT m.doc, m.k, CASE WHEN f.kept - m.size >= 0.5 THEN m.size ELSE f.kept END, f.kept - m.size >= 0.5, m.size
        FROM f JOIN m ON f.doc = m.doc AND m.k = f.k + 1
    ),
    l AS (SELECT doc, size AS mark, least(row_number() OVER (PARTITION BY doc ORDER BY size DESC), 6) AS level FROM f WHERE is_kept)
"""

QUERIES = {
    "target_cols": (
        target_cols,
        f"""WITH {BOXES_SQL}, r AS (SELECT doc // 80 AS page, list_sort(list((id * 7 + 3) / w)) AS r FROM boxes GROUP BY 1)
            SELECT page, CAST(least(greatest(round(r[CAST(least(floor(len(r) * 0.9) + 1, len(r)) AS INTEGER)]), 60), 250) AS INTEGER) AS cols FROM r""",
    ),
    "majority_cell": (
        majority_cells,
        """WITH v AS (
               SELECT l_orderkey // 8 AS text, CAST(l_partkey % 4 AS INTEGER) AS row, CAST(l_suppkey % 3 AS INTEGER) AS col, count(*) AS n
               FROM lineitem GROUP BY 1, 2, 3
           )
           SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY text ORDER BY n DESC, row, col) = 1""",
    ),
    "header_row": (
        header_rows,
        """WITH c AS (
               SELECT l_orderkey // 20 AS t, l_linenumber = 1 AS top, l_partkey % 5 > 0 AS bold,
                      l_quantity + CASE WHEN l_linenumber = 1 THEN l_orderkey % 7 ELSE 0 END AS size, l_returnflag AS font FROM lineitem
           ), f AS (
               SELECT t, top, font FROM c GROUP BY t, top, font QUALIFY row_number() OVER (PARTITION BY t, top ORDER BY count(*) DESC, font) = 1
           ), r AS (
               SELECT t, bool_and(bold) FILTER (WHERE top) AS all_bold, avg(size) FILTER (WHERE top) > 1.1 * avg(size) FILTER (WHERE NOT top) AS larger FROM c GROUP BY t
           )
           SELECT r.t, all_bold, larger, a.font <> b.font AS other_font FROM r JOIN f a ON a.t = r.t AND a.top JOIN f b ON b.t = r.t AND NOT b.top""",
    ),
    "snap_to_grid": (
        snapped_rules,
        f"""WITH {BOXES_SQL}, s AS (
                SELECT doc, (x + CASE WHEN id % 2 = 0 THEN w ELSE 0.002 END) * 100 - x * 100 AS dc, (y + CASE WHEN id % 3 = 0 THEN h ELSE 0.001 END) * 50 - y * 50 AS dr FROM boxes
            ), k AS (SELECT doc, CASE WHEN dr < 0.5 AND dc >= 0.5 THEN 'across' WHEN dc < 0.5 AND dr >= 0.5 THEN 'down' END AS kind FROM s)
            SELECT doc, kind, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY doc, kind""",
    ),
    "merge_runs": (
        merged_runs,
        f"""WITH {BOXES_SQL}, r AS (
                SELECT doc // 10 AS line, CAST(floor(x * 80) AS INTEGER) AS c, min(id) % 3 AS style, CAST(max(floor(w * 20 + 1)) AS INTEGER) AS n FROM boxes GROUP BY 1, 2
            ), g AS (
                SELECT *, CASE WHEN style <> lag(style) OVER w OR c - lag(c + n) OVER w > 2 THEN 1 ELSE 0 END AS brk FROM r WINDOW w AS (PARTITION BY line ORDER BY c)
            ), i AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY line ORDER BY c) AS INTEGER) AS run FROM g)
            SELECT line, run, min(c) AS c, max(c + n) AS "end", min(style) AS style FROM i GROUP BY line, run""",
    ),
    "docx_page_count": (
        page_counts,
        """SELECT o_orderkey, greatest(o_custkey % 4 + 1, o_orderkey % 3 + 1, o_custkey % 7) AS pages,
                  CASE WHEN o_custkey % 4 > 0 THEN 'rendered' WHEN o_orderkey % 3 > 0 THEN 'breaks' WHEN o_custkey % 7 > 0 THEN 'application' ELSE 'single' END AS basis FROM orders""",
    ),
    "inline_markdown": (
        inline_markdown,
        """WITH p AS (SELECT p_partkey, 't' || p_partkey AS t, CASE WHEN p_partkey % 2 = 0 THEN '**' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN '*' ELSE '' END AS m FROM part)
           SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '[' || t || '](/' || t || ')' ELSE m || t || m END AS text FROM p""",
    ),
    "unique_warnings": (
        unique_warnings,
        """SELECT user_id % 40 AS scope, event_type AS kind, min(event_id) AS first, count(*) AS n, count(*) > 1 AS summary FROM events GROUP BY 1, 2""",
    ),
    "multicolumn": (
        multicolumn,
        f"""WITH {BOXES_SQL}, n AS (SELECT doc // 20 AS page, CAST(floor(x * 100 / 5) AS INTEGER) AS bin, count(*) AS n FROM boxes GROUP BY 1, 2),
            h AS (SELECT *, sum(n) OVER (PARTITION BY page) AS total FROM n)
            SELECT page, count(*) AS heaps, max(bin) - min(bin) > 3 AS multicolumn FROM h WHERE n >= 0.15 * total GROUP BY page""",
    ),
    "level_for_size": (
        level_lookup,
        f"""WITH RECURSIVE {_LEVELS}
            SELECT z.doc, z.size, CAST(arg_min(level, struct_pack(a := abs(z.size - mark), b := level)) AS INTEGER) AS level
            FROM z JOIN l ON z.doc = l.doc AND abs(z.size - mark) <= 0.5 GROUP BY z.doc, z.size""",
    ),
}
