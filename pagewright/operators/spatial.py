"""Range joins on pages, with the plane cut into bins so that they become equi joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import geometry as g

#: Width of a bin of the unit page.
BIN = 0.1


def _bins(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(F.floor(low / BIN).cast("int"), F.floor(high / BIN).cast("int")))


def crossings(horizontal: DataFrame, vertical: DataFrame, by: list[str], tolerance: float) -> DataFrame:
    """by, h_id, v_id, x, y: where a horizontal edge (id, pos, low, high) meets a vertical one."""
    h = horizontal.select(
        *by, F.col("id").alias("h_id"), F.col("pos").alias("y"), F.col("low").alias("h_low"), F.col("high").alias("h_high")
    ).withColumn("bin", _bins(F.col("h_low") - tolerance, F.col("h_high") + tolerance))
    v = vertical.select(
        *by, F.col("id").alias("v_id"), F.col("pos").alias("x"), F.col("low").alias("v_low"), F.col("high").alias("v_high")
    ).withColumn("bin", F.floor(F.col("x") / BIN).cast("int"))
    meets = F.col("x").between(F.col("h_low") - tolerance, F.col("h_high") + tolerance) & F.col("y").between(
        F.col("v_low") - tolerance, F.col("v_high") + tolerance
    )
    return h.join(v, [*by, "bin"]).filter(meets).select(*by, "h_id", "v_id", "x", "y")


def points_in_boxes(points: DataFrame, boxes: DataFrame, by: list[str]) -> DataFrame:
    """by, point_id, box_id: each point (id, x, y) with the box (id, box) that holds it, of several the smallest id."""
    p = points.select(*by, F.col("id").alias("point_id"), "x", "y", F.floor(F.col("x") / BIN).cast("int").alias("bin"))
    b = boxes.select(*by, F.col("id").alias("box_id"), "box").withColumn(
        "bin", _bins(F.col("box.x"), g.right(F.col("box")))
    )
    inside = g.contains_point(F.col("box"), F.col("x"), F.col("y"))
    return p.join(b, [*by, "bin"]).filter(inside).groupBy(*by, "point_id").agg(F.min("box_id").alias("box_id"))


def best_links(texts: DataFrame, links: DataFrame, by: list[str]) -> DataFrame:
    """by, text_id, link_id, score: for each text (id, box) the fitting link of the highest score, ties to the least id."""
    t = texts.select(*by, F.col("id").alias("text_id"), F.col("box").alias("t")).withColumn(
        "bin", _bins(F.col("t.x"), g.right(F.col("t")))
    )
    a = links.select(*by, F.col("id").alias("link_id"), F.col("box").alias("a")).withColumn(
        "bin", _bins(F.col("a.x"), g.right(F.col("a")))
    )
    fits = t.join(a, [*by, "bin"]).filter(g.link_fits(F.col("t"), F.col("a")))
    scored = fits.select(*by, "text_id", "link_id", g.link_score(F.col("t"), F.col("a")).alias("score"))
    best = F.min_by(F.struct("link_id", "score"), F.struct(-F.col("score"), F.col("link_id"))).alias("best")
    return scored.groupBy(*by, "text_id").agg(best).select(*by, "text_id", "best.link_id", "best.score")


def uncovered_cells(cells: DataFrame, merged: DataFrame, by: list[str]) -> DataFrame:
    """cells (row, col) without those that a merged range (r0, c0, r1, c1) covers and does not begin at."""
    covered = (
        merged.withColumn("row", F.explode(F.sequence("r0", "r1")))
        .withColumn("col", F.explode(F.sequence("c0", "c1")))
        .filter("row <> r0 or col <> c0")
        .select(*by, "row", "col")
        .distinct()
    )
    return cells.join(covered, [*by, "row", "col"], "left_anti")


def box_components(boxes: DataFrame, by: list[str], gap: float) -> DataFrame:
    """by, id, component: boxes (id, box) that lie within `gap` of each other, through others or not; the least id names.

    Neighbours come from a join on bins; within a group a label spreads to the neighbours of its holders until no label
    of any group changes.
    """
    b = boxes.select(*by, "id", "box")
    reach = b.withColumn("bin", _bins(F.col("box.x") - gap, g.right(F.col("box")) + gap))
    other = reach.select(*by, "bin", F.col("id").alias("other"), F.col("box").alias("far"))
    near = g.distance(F.col("box"), F.col("far")) <= gap
    edges = reach.join(other, [*by, "bin"]).filter(near).select(*by, "id", "other").distinct()
    edges = edges.persist()
    held = [b.select(*by, "id", F.col("id").alias("component"))]
    while True:
        labels = held[-1]
        spread = edges.join(labels.withColumnRenamed("id", "other"), [*by, "other"])
        fresh = spread.groupBy(*by, "id").agg(F.min("component").alias("component")).persist()
        moved = fresh.join(labels.withColumnRenamed("component", "was"), [*by, "id"]).filter("component < was").limit(1).count()
        if len(held) > 1:  # what the step before the last one held has been read for the last time
            held.pop(0).unpersist()
        held.append(fresh)
        if not moved:
            edges.unpersist()
            return fresh


def _labels(page: np.ndarray, ids: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, gap: float) -> np.ndarray:
    """The least id that each box reaches within its page, for boxes of many pages, page after page."""
    least = ids.copy()
    order = np.lexsort((x, page))
    # Behind a box in this order, those of its page that begin before its right edge and the gap: pages stand far apart.
    shift = page * (np.ptp(x) + w.max(initial=0) + gap + 1)
    place = (x + shift)[order]
    reach = np.searchsorted(place, place + w[order] + gap + 1e-6, side="right")
    many = reach - np.arange(len(order)) - 1
    a = np.repeat(order, many)
    b = order[np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(np.arange(len(order)) + 1, many)]
    dx = np.maximum(np.maximum(x[b] - (x[a] + w[a]), x[a] - (x[b] + w[b])), 0)
    dy = np.maximum(np.maximum(y[b] - (y[a] + h[a]), y[a] - (y[b] + h[b])), 0)
    near = (page[a] == page[b]) & (np.sqrt(dx * dx + dy * dy) <= gap)
    a, b = a[near], b[near]
    while len(a):
        low = np.minimum(least[a], least[b])
        before = least.copy()
        np.minimum.at(least, a, low)
        np.minimum.at(least, b, low)
        if (before == least).all():
            break
    return least


def page_components(boxes: DataFrame, by: list[str], gap: float) -> DataFrame:
    """As box_components() for groups that are pages: each is read into one task, where labels spread over arrays.

    One exchange instead of one for each step of the spread. Pages come sorted, so one call labels all whole pages of some
    batches; memory grows with the boxes of a page, not of a document.
    """
    kinds = {f.name: f.dataType.simpleString() for f in boxes.schema.fields}
    names = [*by, "id", "component"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def label(table: pa.Table) -> pa.RecordBatch:
            keys = [table.column(c).to_numpy(zero_copy_only=False) for c in by]
            fresh = np.ones(table.num_rows, bool)
            fresh[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
            columns = [table.column(c).to_numpy() for c in ("id", "x", "y", "width", "height")]
            found = pa.array(_labels(np.cumsum(fresh), *columns, gap))
            return pa.RecordBatch.from_arrays([*[table.column(c).combine_chunks() for c in [*by, "id"]], found], names)

        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
            last = np.all([table.column(c).to_numpy(zero_copy_only=False) == table.column(c)[-1].as_py() for c in by], axis=0)
            cut = int(np.argmax(last))  # where the page that may go on begins
            if cut:
                yield label(table.slice(0, cut))
            rest = table.slice(cut)
        if rest is not None and rest.num_rows:
            yield label(rest)

    flat = boxes.select(*by, "id", "box.x", "box.y", "box.width", "box.height")
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in [*by, "id"]] + [f"component {kinds['id']}"])
    return flat.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema)
