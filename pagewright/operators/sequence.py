"""Operators over ordered rows: islands, merged intervals, and folds whose state depends on all rows before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, by: list[str], order: list, breaks, name: str = "island") -> DataFrame:
    """rows with a running number that grows where `breaks` holds; the first row of a group is in island 0.

    breaks takes the window and gives the condition, so that it can look at the row before.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    hit = F.when(F.row_number().over(w) == 1, 0).otherwise(F.coalesce(breaks(w), F.lit(False)).cast("int"))
    marked = rows.withColumn("_pw_break", hit)
    return marked.withColumn(name, F.sum("_pw_break").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_pw_break")


def merged_intervals(rows: DataFrame, by: list[str], low: str, high: str, gap: float = 0.0) -> DataFrame:
    """by, low, high, n: intervals united where the next begins within `gap` of the furthest end so far."""
    w = Window.partitionBy(*by).orderBy(low, high)
    reach = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = rows.withColumn("_pw_reach", reach)
    parted = islands(cut, by, [low, high], lambda _: F.col(low) > F.col("_pw_reach") + gap, "_pw_island")
    return parted.groupBy(*by, "_pw_island").agg(
        F.min(low).alias(low), F.max(high).alias(high), F.count("*").alias("n")
    ).drop("_pw_island")


def cluster(values: Column, tolerance: float, least: int = 1) -> Column:
    """1-D clusters of an array of doubles against the running centroid: an array of (center, n), ordered.

    A value joins the open cluster if it lies within tolerance of that cluster's mean so far.
    """
    start = F.expr("cast(array() as array<struct<total:double,n:int>>)")

    def add(held: Column, x: Column) -> Column:
        last = F.try_element_at(held, F.lit(-1))
        joined = F.struct((last["total"] + x).alias("total"), (last["n"] + 1).alias("n"))
        fresh = F.struct(x.alias("total"), F.lit(1).alias("n"))
        near = F.coalesce(F.abs(x - last["total"] / last["n"]) <= tolerance, F.lit(False))
        return F.when(near, F.concat(F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0))), F.array(joined))).otherwise(
            F.concat(held, F.array(fresh))
        )

    made = F.aggregate(F.array_sort(values), start, add)
    kept = F.filter(made, lambda c: c["n"] >= least)
    return F.transform(kept, lambda c: F.struct((c["total"] / c["n"]).alias("center"), c["n"].alias("n")))


def spaced(values: Column, tolerance: float) -> Column:
    """An ordered array without values within tolerance of the last one kept."""
    start = F.expr("cast(array() as array<double>)")
    far = lambda held, x: F.coalesce(F.abs(x - F.try_element_at(held, F.lit(-1))) > tolerance, F.lit(True))
    return F.aggregate(F.array_sort(values), start, lambda h, x: F.when(far(h, x), F.concat(h, F.array(x))).otherwise(h))


def snapped_rows(values: Column, tolerance: float = 0.45) -> Column:
    """1-D groups by distance to the group's first value: an ordered array of (first, mean, n)."""
    start = F.expr("cast(array() as array<struct<first:double,total:double,n:int>>)")

    def add(held: Column, x: Column) -> Column:
        last = F.try_element_at(held, F.lit(-1))
        joined = F.struct(last["first"].alias("first"), (last["total"] + x).alias("total"), (last["n"] + 1).alias("n"))
        fresh = F.struct(x.alias("first"), x.alias("total"), F.lit(1).alias("n"))
        near = F.coalesce(x - last["first"] <= tolerance, F.lit(False))
        return F.when(near, F.concat(F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0))), F.array(joined))).otherwise(
            F.concat(held, F.array(fresh))
        )

    made = F.aggregate(F.array_sort(values), start, add)
    return F.transform(
        made, lambda c: F.struct(c["first"].alias("first"), (c["total"] / c["n"]).alias("mean"), c["n"].alias("n"))
    )


def pushed_columns(words: Column) -> Column:
    """Start columns of the words (col, length) of a row, ordered: each at its own, or one blank behind the word before."""
    start = F.expr("cast(array() as array<struct<col:int,length:int>>)")

    def add(held: Column, w: Column) -> Column:
        last = F.try_element_at(held, F.lit(-1))
        at = F.greatest(w["col"], F.coalesce(last["col"] + last["length"] + 1, F.lit(0)))
        return F.concat(held, F.array(F.struct(at.cast("int").alias("col"), w["length"].cast("int").alias("length"))))

    return F.transform(F.aggregate(words, start, add), lambda w: w["col"])


def paragraphs(rows: DataFrame, by: list[str], order: list, top: str, low: str, factor: float = 1.5) -> DataFrame:
    """rows with `paragraph`: a gap of over `factor` times the group's median gap begins a new one."""
    w = Window.partitionBy(*by).orderBy(*order)
    gapped = rows.withColumn("gap", F.col(top) - F.lag(low).over(w))
    median = gapped.groupBy(*by).agg(F.median(F.when(F.col("gap") > 0, F.col("gap"))).alias("median_gap"))
    held = gapped.join(median, by)
    return islands(held, by, order, lambda _: F.col("gap") > factor * F.col("median_gap"), "paragraph")


def level_map(sizes: DataFrame, by: list[str], size: str, apart: float = 0.5, most: int = 6) -> DataFrame:
    """by, size, level: distinct sizes from large to small, those within `apart` of a kept one left out, levels 1 to most."""
    kept = sizes.groupBy(*by).agg(F.collect_set(F.col(size).cast("double")).alias("all"))
    down = F.reverse(spaced(F.transform("all", lambda x: -x), apart - 1e-12))
    ordered = kept.select(*by, F.posexplode(F.reverse(down)).alias("at", "size"))
    return ordered.select(*by, (-F.col("size")).alias(size), F.least(F.col("at") + 1, F.lit(most)).cast("int").alias("level"))


def mode(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value, n: the most frequent value, of equal counts the least."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(
        F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value), F.max("n").alias("n")
    )


def median_deviation(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, median, mad."""
    middle = rows.groupBy(*by).agg(F.median(value).alias("median"))
    return rows.join(middle, by).groupBy(*by).agg(
        F.first("median").alias("median"), F.median(F.abs(F.col(value) - F.col("median"))).alias("mad")
    )


def in_top_share(rows: DataFrame, by: list[str], size: str, share: float) -> DataFrame:
    """rows with is_top: whether at most `share` of the group's rows are of this size or larger."""
    counts = rows.groupBy(*by, size).agg(F.count("*").alias("_pw_n"))
    down = Window.partitionBy(*by).orderBy(F.desc(size))
    every = Window.partitionBy(*by)
    ranked = counts.withColumn(
        "is_top", F.sum("_pw_n").over(down) / F.sum("_pw_n").over(every) <= share
    ).drop("_pw_n")
    return rows.join(ranked, [*by, size])
