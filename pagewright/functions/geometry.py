"""Boxes, points and pages as column expressions. A box is a struct of x, y, width and height, y growing downward."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Room above 1 that a normalised edge may take.
EDGE_SLACK = 1.1920929e-07


def box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height"))


def from_edges(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return box(left, top, right - left, bottom - top)


def right(b: Column) -> Column:
    return b["x"] + b["width"]


def bottom(b: Column) -> Column:
    return b["y"] + b["height"]


def center(b: Column) -> Column:
    return F.struct((b["x"] + b["width"] / 2).alias("x"), (b["y"] + b["height"] / 2).alias("y"))


def area(b: Column) -> Column:
    return b["width"] * b["height"]


def overlaps(a: Column, b: Column) -> Column:
    """True if the inner areas meet; touching edges do not."""
    return (a["x"] < right(b)) & (right(a) > b["x"]) & (a["y"] < bottom(b)) & (bottom(a) > b["y"])


def intersection(a: Column, b: Column) -> Column:
    """The common box, null if there is none."""
    common = from_edges(
        F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"]), F.least(right(a), right(b)), F.least(bottom(a), bottom(b))
    )
    return F.when(overlaps(a, b), common)


def merge(a: Column, b: Column) -> Column:
    return from_edges(
        F.least(a["x"], b["x"]), F.least(a["y"], b["y"]), F.greatest(right(a), right(b)), F.greatest(bottom(a), bottom(b))
    )


def contains(a: Column, b: Column) -> Column:
    return (a["x"] <= b["x"]) & (a["y"] <= b["y"]) & (right(a) >= right(b)) & (bottom(a) >= bottom(b))


def contains_point(b: Column, x: Column, y: Column) -> Column:
    return x.between(b["x"], right(b)) & y.between(b["y"], bottom(b))


def _apart(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    return F.greatest(low_b - high_a, low_a - high_b, F.lit(0.0))


def distance(a: Column, b: Column) -> Column:
    """Between the nearest edges; 0 for boxes that meet."""
    dx = _apart(a["x"], right(a), b["x"], right(b))
    dy = _apart(a["y"], bottom(a), b["y"], bottom(b))
    return F.sqrt(dx * dx + dy * dy)


def vertical_gap(a: Column, b: Column) -> Column:
    return b["y"] - bottom(a)


def horizontal_gap(a: Column, b: Column) -> Column:
    return b["x"] - right(a)


def _ratio(low: Column, high: Column, least_size: Column) -> Column:
    return F.when(least_size > 0, F.greatest(high - low, F.lit(0.0)) / least_size).otherwise(F.lit(0.0))


def x_overlap_ratio(a: Column, b: Column) -> Column:
    """Common width over the smaller width; 0 if that is 0."""
    return _ratio(F.greatest(a["x"], b["x"]), F.least(right(a), right(b)), F.least(a["width"], b["width"]))


def y_overlap_ratio(a: Column, b: Column) -> Column:
    return _ratio(F.greatest(a["y"], b["y"]), F.least(bottom(a), bottom(b)), F.least(a["height"], b["height"]))


def horizontally_aligned(a: Column, b: Column, threshold: float) -> Column:
    return (F.least(a["width"], b["width"]) > 0) & (x_overlap_ratio(a, b) >= threshold)


def left_aligned(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a["x"] - b["x"]) <= tolerance


def is_valid(b: Column) -> Column:
    """Within the unit page, no negative sides, nothing null or not a number."""
    sides = [b[k] for k in ("x", "y", "width", "height")]
    sound = (right(b) <= 1 + EDGE_SLACK) & (bottom(b) <= 1 + EDGE_SLACK)
    for s in sides:
        sound = sound & (s >= 0) & ~F.isnan(s.cast("double"))
    return F.coalesce(sound, F.lit(False))


def normalize_point(x: Column, y: Column, left: Column, low: Column, width: Column, height: Column, turn: Column) -> list[Column]:
    """Page coordinates, y upward, to 0..1 with y downward, after turning the page clockwise by 0, 90, 180 or 270."""
    u, v = (x - left) / width, (y - low) / height
    turns = F.pmod(turn, F.lit(360))
    new_x = F.when(turns == 90, v).when(turns == 180, 1 - u).when(turns == 270, 1 - v).otherwise(u)
    new_y = F.when(turns == 90, u).when(turns == 180, v).when(turns == 270, 1 - u).otherwise(1 - v)
    return [new_x, new_y]


def normalize_box(b: Column, left: Column, low: Column, width: Column, height: Column, turn: Column) -> Column:
    ax, ay = normalize_point(b["x"], b["y"], left, low, width, height, turn)
    bx, by = normalize_point(right(b), bottom(b), left, low, width, height, turn)
    return from_edges(F.least(ax, bx), F.least(ay, by), F.greatest(ax, bx), F.greatest(ay, by))


def transform_point(x: Column, y: Column, m: list[Column]) -> list[Column]:
    """By an affine matrix a b c d e f: (a x + c y + e, b x + d y + f)."""
    a, b, c, d, e, f = m
    return [a * x + c * y + e, b * x + d * y + f]


def project(x: Column, y: Column, angle: Column) -> list[Column]:
    """Along and across a baseline that is turned by `angle`."""
    return [x * F.cos(angle) + y * F.sin(angle), y * F.cos(angle) - x * F.sin(angle)]


def clip_interval(low: Column, high: Column, least: Column, most: Column) -> Column:
    """(low, high) within bounds, null if nothing is left."""
    a, b = F.greatest(low, least), F.least(high, most)
    return F.when(b > a, F.struct(a.alias("low"), b.alias("high")))


def link_score(text: Column, link: Column) -> Column:
    """How well a link's box fits a text's: share of the text's width, and up to 0.25 for near centres.

    Distances are added to 1 one after the other, as the SQL adds them: scores that are all but equal order alike.
    """
    width = F.greatest(F.least(right(text), right(link)) - F.greatest(text["x"], link["x"]), F.lit(0.0))
    a, b = center(text), center(link)
    apart = 1 + F.abs(a["x"] - b["x"]) + F.abs(a["y"] - b["y"])
    return F.when(text["width"] > 0, width / text["width"]).otherwise(F.lit(0.0)) + F.lit(0.25) / apart


def link_fits(text: Column, link: Column) -> Column:
    """Over at least half of the text's width, and at the same height somewhere."""
    width = F.least(right(text), right(link)) - F.greatest(text["x"], link["x"])
    height = F.least(bottom(text), bottom(link)) - F.greatest(text["y"], link["y"])
    return (text["width"] > 0) & (width >= 0.5 * text["width"]) & (height > 0)
