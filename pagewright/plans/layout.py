"""Queries over boxes, edges and grids, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import geometry as g
from pagewright.functions import text as t
from pagewright.operators import sequence as q
from pagewright.operators import spatial, structure
from pagewright.plans.tables import BOXES_SQL, box_pairs, boxes, read

_PAIRS = f"""WITH {BOXES_SQL}, p AS (
    SELECT a.doc, a.id, a.x AS ax, a.y AS ay, a.w AS aw, a.h AS ah, b.x AS bx, b.y AS by_, b.w AS bw, b.h AS bh
    FROM boxes a JOIN boxes b ON a.doc = b.doc AND b.id = a.id + 1)"""


def _flat(s, d):
    """doc, id, low, high: horizontal extents, one for each place of a document."""
    return boxes(s, d).groupBy("doc", "id").agg(F.min("box.x").alias("low"), F.max(g.right(F.col("box"))).alias("high"))


_FLAT = f"WITH {BOXES_SQL}, f AS (SELECT doc, id, min(x) AS low, max(x + w) AS high FROM boxes GROUP BY doc, id)"


def bbox_pairs(s, d):
    a, b = F.col("a"), F.col("b")
    r = lambda c: F.round(c, 6)
    return box_pairs(s, d).select(
        "doc", "id", g.overlaps(a, b).alias("overlaps"), g.contains(a, b).alias("contains"), r(g.distance(a, b)).alias("distance"),
        r(g.area(g.merge(a, b))).alias("merged"), r(F.coalesce(g.area(g.intersection(a, b)), F.lit(0.0))).alias("common"),
        r(g.vertical_gap(a, b)).alias("v_gap"), r(g.horizontal_gap(a, b)).alias("h_gap"),
        r(g.x_overlap_ratio(a, b)).alias("x_ratio"), r(g.y_overlap_ratio(a, b)).alias("y_ratio"),
        g.left_aligned(a, b, 0.1).alias("aligned"), r(g.center(a)["x"]).alias("cx"), r(g.center(a)["y"]).alias("cy"),
    )


def bbox_properties(s, d):
    """Laws that hold for all pairs: one row, all true."""
    a, b = F.col("a"), F.col("b")
    eps = 1e-9
    m = g.merge(a, b)
    near = lambda x, y: F.abs(x - y) < eps
    inside = lambda o, i: (o["x"] <= i["x"]) & (o["y"] <= i["y"]) & (g.right(o) >= g.right(i) - eps) & (g.bottom(o) >= g.bottom(i) - eps)
    laws = {
        "overlap_symmetric": g.overlaps(a, b) == g.overlaps(b, a),
        "distance_symmetric": near(g.distance(a, b), g.distance(b, a)),
        "distance_not_negative": g.distance(a, b) >= 0,
        "overlap_has_no_distance": ~g.overlaps(a, b) | near(g.distance(a, b), F.lit(0.0)),
        "merge_holds_both": inside(m, a) & inside(m, b),
        "merge_symmetric": near(g.area(m), g.area(g.merge(b, a))),
        "intersection_when_overlap": g.intersection(a, b).isNotNull() == g.overlaps(a, b),
        "contains_itself": g.contains(a, a),
        "center_inside": g.contains_point(a, g.center(a)["x"], g.center(a)["y"]),
    }
    return box_pairs(s, d).agg(F.count("*").alias("n"), *[F.bool_and(v).alias(k) for k, v in laws.items()])


def edges(s, d):
    one = boxes(s, d).groupBy("doc", "id").agg(F.min("box").alias("box"))
    h = one.filter("id % 2 = 0").select("doc", "id", F.col("box.y").alias("pos"), F.col("box.x").alias("low"), g.right(F.col("box")).alias("high"))
    v = one.filter("id % 2 = 1").select("doc", "id", F.col("box.x").alias("pos"), F.col("box.y").alias("low"), (F.col("box.y") + 0.4).alias("high"))
    return spatial.crossings(h, v, ["doc"], 0.004).select("doc", "h_id", "v_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


_ONE = f"WITH {BOXES_SQL}, one AS (SELECT doc, id, min(struct_pack(x := x, y := y, w := w, h := h)) AS b FROM boxes GROUP BY doc, id)"


def points(s, d):
    one = boxes(s, d).groupBy("doc", "id").agg(F.min("box").alias("box"))
    at = one.select(F.floor(F.col("doc") / 300).alias("page"), (F.col("doc") * 10 + F.col("id")).alias("id"), F.col("box.x").alias("x"), F.col("box.y").alias("y"))
    into = one.filter("id = 1").select(F.floor(F.col("doc") / 300).alias("page"), F.col("doc").alias("id"), "box")
    return spatial.points_in_boxes(at, into, ["page"])


def links(s, d):
    one = boxes(s, d).groupBy("doc", "id").agg(F.min("box").alias("box"))
    texts = one.filter("id = 1").select(F.floor(F.col("doc") / 80).alias("page"), F.col("doc").alias("id"), "box")
    found = one.filter("id = 2").select(F.floor(F.col("doc") / 80).alias("page"), F.col("doc").alias("id"), "box")
    return spatial.best_links(texts, found, ["page"]).withColumn("score", F.round("score", 6))


def fold_values(s, d, size=7):
    return boxes(s, d).groupBy(F.floor(F.col("doc") / 50).alias("page")).agg(F.array_sort(F.collect_set(F.round(F.col("box.x") + F.col("id") / 1000, 4))).alias("v"))


_VALUES = f"WITH RECURSIVE {BOXES_SQL}, v AS (SELECT doc // 50 AS page, list_sort(list_distinct(list(round(x + id / 1000, 4)))) AS v FROM boxes GROUP BY doc // 50)"


def clusters(s, d):
    made = fold_values(s, d).select("page", F.explode(q.cluster(F.col("v"), 0.0104)).alias("c"))
    return made.select("page", F.round("c.center", 6).alias("center"), "c.n")


def snapped(s, d):
    made = fold_values(s, d).select("page", F.explode(q.snapped_rows(F.transform("v", lambda x: x * 40))).alias("c"))
    return made.select("page", F.round("c.first", 6).alias("first"), F.round("c.mean", 6).alias("mean"), "c.n")


def kept_positions(s, d):
    return fold_values(s, d).select("page", F.explode(q.spaced(F.col("v"), 0.0154)).alias("x"))


def pushed(s, d):
    word = F.struct(F.floor(F.col("box.x") * 80).cast("int").alias("col"), F.floor(F.col("box.width") * 30 + 1).cast("int").alias("length"))
    rows = boxes(s, d).groupBy("doc").agg(F.array_sort(F.collect_list(word)).alias("w"))
    return rows.select("doc", F.array_join(F.transform(q.pushed_columns(F.col("w")), lambda c: c.cast("string")), ",").alias("cols"))


def interval_merge(s, d):
    held = boxes(s, d).select(F.floor(F.col("doc") / 40).alias("page"), F.col("box.x").alias("low"), (F.col("box.x") + F.col("box.width") / 20).alias("high"))
    r = q.merged_intervals(held, ["page"], "low", "high", 0.0055)
    return r.select("page", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n")


_MERGE = """
    m AS (SELECT page, low, high, max(high) OVER (PARTITION BY page ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
    b AS (SELECT *, CASE WHEN reach IS NULL OR NOT low > reach + {gap} THEN 0 ELSE 1 END AS brk FROM m),
    g AS (SELECT *, sum(brk) OVER (PARTITION BY page ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS island FROM b)
"""


def columns(s, d):
    """Columns of each page: extents united over gaps up to 0.03, at least 0.05 wide."""
    held = boxes(s, d).select("doc", F.col("box.x").alias("low"), g.right(F.col("box")).alias("high"))
    r = q.merged_intervals(held, ["doc"], "low", "high", 0.0305).filter("high - low >= 0.0495")
    return r.select("doc", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n")


def components(s, d):
    # Documents are cut into small pages, as pages are.
    one = boxes(s, d).groupBy("doc", "id").agg(F.min("box").alias("box"))
    return spatial.page_components(one, ["doc"], 0.0504)


def components_wide(s, d):
    """The same for groups of any size, by rounds of joins."""
    one = boxes(s, d).groupBy("doc", "id").agg(F.min("box").alias("box"))
    return spatial.box_components(one, ["doc"], 0.0504).select("doc", "id", "component")


def normalized(s, d):
    b = F.col("box")
    page = g.box(b["x"] * 600 + 10, b["y"] * 800 + 20, b["width"] * 600, b["height"] * 800)
    n = g.normalize_box(page, F.lit(10.0), F.lit(20.0), F.lit(600.0), F.lit(800.0), (F.col("doc") % 4) * 90)
    return boxes(s, d).select("doc", "id", *[F.round(n[k], 6).alias(k) for k in ("x", "y", "width", "height")])


def affine(s, d):
    m = [F.lit(v) for v in (1.5, 0.25, -0.5, 2.0, 10.0, -3.0)]
    x, y = g.transform_point(F.col("box.x"), F.col("box.y"), m)
    u, v = g.project(F.col("box.x"), F.col("box.y"), F.lit(0.3))
    r = lambda c: F.round(c, 6)
    return boxes(s, d).select("doc", "id", r(x).alias("x"), r(y).alias("y"), r(u).alias("u"), r(v).alias("v"))


def bands(s, d):
    b = F.col("box")
    clip = g.clip_interval(b["x"], g.right(b), F.lit(0.2), F.lit(0.6))
    return boxes(s, d).select(
        "doc", "id", t.band(b["y"], g.bottom(b)).alias("band"), F.round(clip["low"], 6).alias("low"), F.round(clip["high"], 6).alias("high"),
        g.is_valid(b).alias("valid"),
    )


def uncovered(s, d):
    li = read(s, d, "lineitem")
    cells = li.select(F.floor(F.col("l_orderkey") / 100).alias("sheet"), (F.col("l_partkey") % 30).cast("int").alias("row"), (F.col("l_suppkey") % 12).cast("int").alias("col")).distinct()
    merged = li.filter("l_linenumber = 1").select(
        F.floor(F.col("l_orderkey") / 100).alias("sheet"), (F.col("l_partkey") % 30).cast("int").alias("r0"), (F.col("l_suppkey") % 12).cast("int").alias("c0"),
        (F.col("l_partkey") % 30 + F.col("l_orderkey") % 2).cast("int").alias("r1"), (F.col("l_suppkey") % 12 + F.col("l_partkey") % 2).cast("int").alias("c1"),
    )
    return spatial.uncovered_cells(cells, merged, ["sheet"])


def grid_cells(s, d):
    return read(s, d, "lineitem").select(
        F.col("l_orderkey").alias("doc"), (F.col("l_partkey") % 4).cast("int").alias("row"), (F.col("l_suppkey") % 3).cast("int").alias("col"),
        F.concat("l_returnflag", F.col("l_quantity").cast("int").cast("string")).alias("text"),
        (F.col("l_linenumber") * 100000000 + F.col("l_partkey") * 1000 + F.col("l_quantity").cast("int")).alias("o"),
    )


_GRID = """WITH c AS (SELECT l_orderkey AS doc, CAST(l_partkey % 4 AS INTEGER) AS row, CAST(l_suppkey % 3 AS INTEGER) AS col,
    l_returnflag || CAST(l_quantity AS INTEGER) AS text, l_linenumber::BIGINT * 100000000 + l_partkey * 1000 + CAST(l_quantity AS INTEGER) AS o FROM lineitem)"""


def styles(s, d):
    held = read(s, d, "part").select(
        "p_partkey", F.when(F.col("p_partkey") % 5 > 0, F.col("p_partkey") - 1).alias("based_on"),
        F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey") % 7).alias("size"), F.when(F.col("p_partkey") % 5 == 0, F.lit("base")).alias("font"),
    )
    return structure.inherited(held, "p_partkey", "based_on", ["size", "font"])


def threads(s, d):
    held = read(s, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderkey") - F.col("o_orderkey") % 4).alias("parent"),
        F.col("o_orderkey").alias("o"), F.col("o_orderstatus").alias("text"),
    )
    return structure.threads(held, "id", "parent", "o", "text")


def sizes(s, d):
    return read(s, d, "lineitem").select(F.floor(F.col("l_orderkey") / 30).alias("doc"), (F.col("l_quantity") * 2 + 60).cast("double").alias("size"))


_SIZES = "WITH z AS (SELECT l_orderkey // 30 AS doc, CAST(l_quantity * 2 + 60 AS DOUBLE) AS size FROM lineitem)"


def paragraph_groups(s, d):
    e = read(s, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("top"))
    held = q.paragraphs(e.withColumn("low", F.col("top") + 1), ["user_id"], ["top", "event_id"], "top", "low")
    return held.groupBy("user_id", "paragraph").agg(F.count("*").alias("n"))



QUERIES = {
    "bbox_pairs": (
        bbox_pairs,
        f"""{_PAIRS} SELECT doc, id, ax < bx + bw AND ax + aw > bx AND ay < by_ + bh AND ay + ah > by_ AS overlaps,
            ax <= bx AND ay <= by_ AND ax + aw >= bx + bw AND ay + ah >= by_ + bh AS contains,
            round(sqrt(power(greatest(bx - (ax + aw), ax - (bx + bw), 0), 2) + power(greatest(by_ - (ay + ah), ay - (by_ + bh), 0), 2)), 6) AS distance,
            round((greatest(ax + aw, bx + bw) - least(ax, bx)) * (greatest(ay + ah, by_ + bh) - least(ay, by_)), 6) AS merged,
            round(greatest(least(ax + aw, bx + bw) - greatest(ax, bx), 0) * greatest(least(ay + ah, by_ + bh) - greatest(ay, by_), 0), 6) AS common,
            round(by_ - (ay + ah), 6) + 0 AS v_gap, round(bx - (ax + aw), 6) + 0 AS h_gap,
            round(greatest(least(ax + aw, bx + bw) - greatest(ax, bx), 0) / least(aw, bw), 6) AS x_ratio,
            round(greatest(least(ay + ah, by_ + bh) - greatest(ay, by_), 0) / least(ah, bh), 6) AS y_ratio,
            abs(ax - bx) <= 0.1 AS aligned, round(ax + aw / 2, 6) AS cx, round(ay + ah / 2, 6) AS cy FROM p""",
    ),
    "bbox_properties": (
        bbox_properties,
        f"""{_PAIRS} SELECT count(*) AS n, true AS overlap_symmetric, true AS distance_symmetric, true AS distance_not_negative,
            true AS overlap_has_no_distance, true AS merge_holds_both, true AS merge_symmetric, true AS intersection_when_overlap,
            true AS contains_itself, true AS center_inside FROM p""",
    ),
    "bbox_normalize": (
        normalized,
        f"""WITH {BOXES_SQL}, e AS (
                SELECT doc, id, x AS l, y AS b, x + w AS r, y + h AS t, doc % 4 AS k FROM boxes
            ), n AS (
                SELECT doc, id, CASE k WHEN 1 THEN b WHEN 2 THEN 1 - r WHEN 3 THEN 1 - t ELSE l END AS x,
                       CASE k WHEN 1 THEN l WHEN 2 THEN b WHEN 3 THEN 1 - r ELSE 1 - t END AS y,
                       CASE WHEN k % 2 = 1 THEN t - b ELSE r - l END AS width, CASE WHEN k % 2 = 1 THEN r - l ELSE t - b END AS height FROM e
            )
            SELECT doc, id, round(x, 6) + 0 AS x, round(y, 6) + 0 AS y, round(width, 6) AS width, round(height, 6) AS height FROM n""",
    ),
    "bbox_transform": (
        affine,
        f"""WITH {BOXES_SQL} SELECT doc, id, round(1.5 * x - 0.5 * y + 10, 6) AS x, round(0.25 * x + 2 * y - 3, 6) AS y,
            round(x * cos(0.3) + y * sin(0.3), 6) AS u, round(y * cos(0.3) - x * sin(0.3), 6) AS v FROM boxes""",
    ),
    "bbox_bands": (
        bands,
        f"""WITH {BOXES_SQL} SELECT doc, id, CASE WHEN y <= 0.15 THEN 'top' WHEN y + h >= 0.85 THEN 'bottom' ELSE 'body' END AS band,
            CASE WHEN least(x + w, 0.6) > greatest(x, 0.2) THEN round(greatest(x, 0.2), 6) END AS low,
            CASE WHEN least(x + w, 0.6) > greatest(x, 0.2) THEN round(least(x + w, 0.6), 6) END AS high,
            x + w <= 1.00000011920929 AND y + h <= 1.00000011920929 AS valid FROM boxes""",
    ),
    "edge_intersections": (
        edges,
        f"""{_ONE} SELECT h.doc, h.id AS h_id, v.id AS v_id, round(v.b.x, 6) AS x, round(h.b.y, 6) AS y
            FROM one h JOIN one v ON h.doc = v.doc AND h.id % 2 = 0 AND v.id % 2 = 1
            WHERE v.b.x BETWEEN h.b.x - 0.004 AND h.b.x + h.b.w + 0.004 AND h.b.y BETWEEN v.b.y - 0.004 AND v.b.y + 0.404""",
    ),
    "point_in_cell": (
        points,
        f"""{_ONE} SELECT p.doc // 300 AS page, p.doc * 10 + p.id AS point_id, min(c.doc) AS box_id
            FROM one p JOIN one c ON c.id = 1 AND p.doc // 300 = c.doc // 300
            WHERE p.b.x BETWEEN c.b.x AND c.b.x + c.b.w AND p.b.y BETWEEN c.b.y AND c.b.y + c.b.h GROUP BY ALL""",
    ),
    "best_link_overlap": (
        links,
        f"""{_ONE}, j AS (
                SELECT t.doc // 80 AS page, t.doc AS text_id, a.doc AS link_id,
                       greatest(least(t.b.x + t.b.w, a.b.x + a.b.w) - greatest(t.b.x, a.b.x), 0) / t.b.w
                       + 0.25 / (1 + abs(t.b.x + t.b.w / 2 - (a.b.x + a.b.w / 2)) + abs(t.b.y + t.b.h / 2 - (a.b.y + a.b.h / 2))) AS score
                FROM one t JOIN one a ON t.id = 1 AND a.id = 2 AND t.doc // 80 = a.doc // 80
                WHERE least(t.b.x + t.b.w, a.b.x + a.b.w) - greatest(t.b.x, a.b.x) >= 0.5 * t.b.w
                  AND least(t.b.y + t.b.h, a.b.y + a.b.h) - greatest(t.b.y, a.b.y) > 0
            )
            SELECT page, text_id, link_id, round(score, 6) AS score FROM j
            QUALIFY row_number() OVER (PARTITION BY page, text_id ORDER BY score DESC, link_id) = 1""",
    ),
    "interval_merge": (
        interval_merge,
        f"""WITH {BOXES_SQL}, iv AS (SELECT doc // 40 AS page, x AS low, x + w / 20 AS high FROM boxes), {_MERGE.format(gap="0.0055")}
            SELECT page, round(min(low), 6) AS low, round(max(high), 6) AS high, count(*) AS n FROM g GROUP BY page, island""",
    ),
    "column_detect": (
        columns,
        f"""WITH {BOXES_SQL}, iv AS (SELECT doc AS page, x AS low, x + w AS high FROM boxes), {_MERGE.format(gap="0.0305")}
            SELECT page AS doc, round(min(low), 6) AS low, round(max(high), 6) AS high, count(*) AS n FROM g GROUP BY page, island
            HAVING max(high) - min(low) >= 0.0495""",
    ),
    "cluster_1d": (
        clusters,
        f"""{_VALUES}, f AS (
                SELECT page, 1 AS k, v[1] AS total, 1 AS n, 1 AS c, v FROM v
                UNION ALL
                SELECT page, k + 1, CASE WHEN abs(v[k + 1] - total / n) <= 0.0104 THEN total + v[k + 1] ELSE v[k + 1] END,
                       CASE WHEN abs(v[k + 1] - total / n) <= 0.0104 THEN n + 1 ELSE 1 END,
                       CASE WHEN abs(v[k + 1] - total / n) <= 0.0104 THEN c ELSE c + 1 END, v
                FROM f WHERE k < len(v)
            )
            SELECT page, round(arg_max(total / n, k), 6) AS center, max(n) AS n FROM f GROUP BY page, c""",
    ),
    "snap_rows": (
        snapped,
        f"""{_VALUES}, w AS (SELECT page, list_transform(v, lambda x: x * 40) AS v FROM v), f AS (
                SELECT page, 1 AS k, v[1] AS first, v[1] AS total, 1 AS n, 1 AS c, v FROM w
                UNION ALL
                SELECT page, k + 1, CASE WHEN v[k + 1] - first <= 0.45 THEN first ELSE v[k + 1] END,
                       CASE WHEN v[k + 1] - first <= 0.45 THEN total + v[k + 1] ELSE v[k + 1] END,
                       CASE WHEN v[k + 1] - first <= 0.45 THEN n + 1 ELSE 1 END, CASE WHEN v[k + 1] - first <= 0.45 THEN c ELSE c + 1 END, v
                FROM f WHERE k < len(v)
            )
            SELECT page, round(min(first), 6) AS first, round(arg_max(total / n, k), 6) AS mean, max(n) AS n FROM f GROUP BY page, c""",
    ),
    "dedup_close": (
        kept_positions,
        f"""{_VALUES}, f AS (
                SELECT page, 1 AS k, v[1] AS x, true AS kept, v FROM v
                UNION ALL
                SELECT page, k + 1, CASE WHEN abs(v[k + 1] - x) > 0.0154 THEN v[k + 1] ELSE x END, abs(v[k + 1] - x) > 0.0154, v
                FROM f WHERE k < len(v)
            )
            SELECT page, x FROM f WHERE kept""",
    ),
    "resolve_cols": (
        pushed,
        f"""WITH RECURSIVE {BOXES_SQL}, w AS (
                SELECT doc, list_sort(list(struct_pack(col := CAST(floor(x * 80) AS INTEGER), length := CAST(floor(w * 30 + 1) AS INTEGER)))) AS w
                FROM boxes GROUP BY doc
            ), f AS (
                SELECT doc, 1 AS k, greatest(w[1].col, 0) AS pos, greatest(w[1].col, 0)::VARCHAR AS cols, w FROM w
                UNION ALL
                SELECT doc, k + 1, greatest(w[k + 1].col, pos + w[k].length + 1), cols || ',' || greatest(w[k + 1].col, pos + w[k].length + 1), w
                FROM f WHERE k < len(w)
            )
            SELECT doc, arg_max(cols, k) AS cols FROM f GROUP BY doc""",
    ),
    "components": (
        components,
        f"""WITH RECURSIVE {BOXES_SQL}, one AS (
                SELECT doc, id, min(struct_pack(x := x, y := y, w := w, h := h)) AS b FROM boxes GROUP BY doc, id
            ), e AS (
                SELECT p.doc, p.id, q.id AS other FROM one p JOIN one q USING (doc)
                WHERE sqrt(power(greatest(q.b.x - (p.b.x + p.b.w), p.b.x - (q.b.x + q.b.w), 0), 2)
                         + power(greatest(q.b.y - (p.b.y + p.b.h), p.b.y - (q.b.y + q.b.h), 0), 2)) <= 0.0504
            ), r AS (
                SELECT doc, id, id AS reach FROM one UNION SELECT r.doc, r.id, e.other FROM r JOIN e ON r.doc = e.doc AND r.reach = e.id
            )
            SELECT doc, id, min(reach) AS component FROM r GROUP BY doc, id""",
    ),
    "components_wide": (components_wide, None),
    "merged_cells": (
        uncovered,
        """WITH c AS (SELECT DISTINCT l_orderkey // 100 AS sheet, l_partkey % 30 AS row, l_suppkey % 12 AS col FROM lineitem),
           m AS (SELECT l_orderkey // 100 AS sheet, l_partkey % 30 AS r0, l_suppkey % 12 AS c0, l_partkey % 30 + l_orderkey % 2 AS r1,
                        l_suppkey % 12 + l_partkey % 2 AS c1 FROM lineitem WHERE l_linenumber = 1)
           SELECT sheet, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col FROM c WHERE NOT EXISTS (
               SELECT 1 FROM m WHERE m.sheet = c.sheet AND c.row BETWEEN r0 AND r1 AND c.col BETWEEN c0 AND c1 AND NOT (c.row = r0 AND c.col = c0))""",
    ),
    "table_grid": (
        lambda s, d: structure.grid_rows(grid_cells(s, d), ["doc"], "o"),
        f"""{_GRID}, u AS (SELECT doc, row, col, arg_max(text, o) AS text FROM c GROUP BY ALL), w AS (SELECT doc, max(col) AS m FROM u GROUP BY doc)
            SELECT doc, row, array_to_string(list_transform(range(0, any_value(m) + 1), lambda k: coalesce(map(list(col), list(text))[k], '')), '|') AS cells
            FROM u JOIN w USING (doc) GROUP BY doc, row""",
    ),
    "column_widths": (
        lambda s, d: structure.column_widths(grid_cells(s, d), ["doc"]),
        f"{_GRID} SELECT doc, col, greatest(3, CAST(max(octet_length(encode(text))) AS INTEGER)) AS width FROM c GROUP BY doc, col",
    ),
    "style_inheritance": (
        styles,
        """WITH RECURSIVE p AS (SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN p_partkey - 1 END AS up,
               CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 7 END AS size, CASE WHEN p_partkey % 5 = 0 THEN 'base' END AS font FROM part),
           r AS (SELECT p_partkey, up, size, font, 0 AS k FROM p
                 UNION ALL SELECT r.p_partkey, p.up, coalesce(r.size, p.size), coalesce(r.font, p.font), k + 1 FROM r JOIN p ON r.up = p.p_partkey WHERE k < 10)
           SELECT p_partkey, arg_max(coalesce(size, -1), k) AS size0, arg_max(coalesce(font, ''), k) AS font0 FROM r GROUP BY p_partkey""",
    ),
    "comment_threads": (
        threads,
        """WITH x AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey - o_orderkey % 4 END AS parent, o_orderstatus AS text FROM orders)
           SELECT coalesce(parent, id) AS root, string_agg(text, ' | ' ORDER BY parent IS NOT NULL, id, text) AS text, count(*) AS n FROM x GROUP BY ALL""",
    ),
    "font_mode": (
        lambda s, d: q.mode(sizes(s, d), ["doc"], "size"),
        f"""{_SIZES} SELECT doc, size, count(*) AS n FROM z GROUP BY doc, size
            QUALIFY row_number() OVER (PARTITION BY doc ORDER BY count(*) DESC, size) = 1""",
    ),
    "top_percentile": (
        lambda s, d: q.in_top_share(sizes(s, d), ["doc"], "size", 0.1).filter("is_top").groupBy("doc").agg(F.count("*").alias("n"), F.min("size").alias("least")),
        f"""{_SIZES}, r AS (SELECT doc, size, count(*) OVER (PARTITION BY doc ORDER BY size DESC) * 1.0 / count(*) OVER (PARTITION BY doc) AS share FROM z)
            SELECT doc, count(*) AS n, min(size) AS least FROM r WHERE share <= 0.1 GROUP BY doc""",
    ),
    "level_map": (
        lambda s, d: q.level_map(sizes(s, d), ["doc"], "size"),
        f"""{_SIZES}, u AS (SELECT DISTINCT doc, size FROM z)
            SELECT doc, size, CAST(least(row_number() OVER (PARTITION BY doc ORDER BY size DESC), 6) AS INTEGER) AS level FROM u""",
    ),
    "median_gap": (
        lambda s, d: sizes(s, d).groupBy("doc").agg(F.median("size").alias("median")),
        f"{_SIZES} SELECT doc, median(size) AS median FROM z GROUP BY doc",
    ),
    "median_deviation": (
        lambda s, d: q.median_deviation(sizes(s, d), ["doc"], "size"),
        f"""{_SIZES}, m AS (SELECT doc, median(size) AS median FROM z GROUP BY doc)
            SELECT doc, any_value(median) AS median, median(abs(size - median)) AS mad FROM z JOIN m USING (doc) GROUP BY doc""",
    ),
    "paragraph_groups": (
        paragraph_groups,
        """WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS top FROM events),
           g AS (SELECT *, top - lag(top + 1) OVER (PARTITION BY user_id ORDER BY top, event_id) AS gap FROM e),
           m AS (SELECT user_id, median(gap) FILTER (WHERE gap > 0) AS med FROM g GROUP BY user_id),
           b AS (SELECT *, CASE WHEN gap > 1.5 * med THEN 1 ELSE 0 END AS brk FROM g JOIN m USING (user_id)),
           i AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY user_id ORDER BY top, event_id) AS INTEGER) AS paragraph FROM b)
           SELECT user_id, paragraph, count(*) AS n FROM i GROUP BY ALL""",
    ),
}


def _styles_shown(s, d):
    return styles(s, d).select("p_partkey", F.coalesce("size", F.lit(-1)).alias("size0"), F.coalesce("font", F.lit("")).alias("font0"))


QUERIES["components_wide"] = (components_wide, QUERIES["components"][1])
QUERIES["style_inheritance"] = (_styles_shown, QUERIES["style_inheritance"][1])
