"""Mixing sources by a time-varying curriculum, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A word, as a Java regular expression.
WORD = "[^\\x20\\x09-\\x0D]+"

#: (time, factor) knots of the weight schedules that sources take in turn; between knots the factor runs straight. Each
#: has a mean of 1, 2 or 3 over the training time from 0 to 1: the first fades, the second is steady, the third grows.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 1.5), (1.0, 4.5)))

#: No source gives more than this many times its words.
MOST_REPEATS = 3


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def line_order(key: str, text: str) -> Column:
    """A hash by which a source's documents stand in its line: of key and text, so that repeated or null keys spread."""
    return F.md5(F.concat_ws(" ", F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")))))


def _segments(knots: tuple) -> list[tuple]:
    """(demand before, time, length, weight at its start, slope) of each piece; demand is the weight's integral."""
    out, demand = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        out.append((demand, t0, t1 - t0, w0, (w1 - w0) / (t1 - t0)))
        demand += (w0 + w1) / 2 * (t1 - t0)
    return out


def _total(knots: tuple) -> float:
    return sum((w0 + w1) / 2 * (t1 - t0) for (t0, w0), (t1, w1) in zip(knots, knots[1:]))


def _time_of(share: Column, schedule: Column, schedules: tuple) -> Column:
    """The training time at which a source's cumulative demand reaches this share of its whole demand."""
    out = F.lit(0.0)
    for k, knots in enumerate(schedules):
        at = None
        for demand, t, length, w, slope in _segments(knots):
            need = share * _total(knots) - F.lit(demand)
            # w * x + slope * x * x / 2 = need, in the form without cancellation
            x = 2 * need / (F.lit(w) + F.sqrt(F.greatest(F.lit(w * w) + 2 * slope * need, F.lit(1e-18))))
            time = F.lit(t) + F.least(F.greatest(x, F.lit(0.0)), F.lit(length))
            at = time if at is None else F.when(need >= 0, time).otherwise(at)
        out = F.when(schedule == k, at).otherwise(out)
    return out


def source_targets(sizes: DataFrame, schedules: tuple = SCHEDULES, most: int = MOST_REPEATS) -> DataFrame:
    """From _pw_null, _pw_name, size of each source: source_size, schedule, target.

    All words of the table are shared out by the integrals of the schedules; a target stops at `most` times its source's
    size. With sources in the order in which they would stop as the share per weight rises, the level is that of the
    first source that does not stop. One row for each source.
    """
    weight = F.element_at(F.array(*[F.lit(_total(k)) for k in schedules]), (F.col("schedule") + 1).cast("int"))
    ranked = sizes.select(
        "*", ((F.row_number().over(Window.orderBy("_pw_null", "_pw_name")) - 1) % len(schedules)).alias("schedule")
    ).withColumn("weight", weight)
    ranked = ranked.withColumn("cap", most * F.col("size").cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "_pw_null", "_pw_name")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    words = F.sum("size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    levels = ranked.withColumn("level", words / rest)
    level = F.min_by("level", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("cap") / F.col("weight"))).over(every)
    return levels.select(
        "_pw_null",
        "_pw_name",
        F.col("size").alias("source_size"),
        "schedule",
        F.least("cap", F.coalesce(level * F.col("weight"), "cap")).alias("target"),
    )


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    size: Column | None = None,
    order: Column | None = None,
    schedules: tuple = SCHEDULES,
    most: int = MOST_REPEATS,
) -> DataFrame:
    """docs with size, source_size, target, taken and positions: how often and when in training each document comes.

    size is the number of words of the text unless given. Each source is one line of words, its documents in the order of
    a hash (line_order() unless given, hexadecimal digits); the training reads the line from its beginning, again if the
    target is larger, and stops at the target: at the document whose middle lies behind it. A copy that begins after so
    many words of demand comes at the time when the integral of the schedule has asked for these. A large source is cut
    into buckets by the hash: the words of the buckets before come from a small table, those in a bucket from a window
    over its rows. Rows of equal hash stand in the order of all their other columns, so reruns agree.
    Nulls: a null text has no words, a null source is a source of its own, the last; a null key is a key as any other.
    Documents without words are never taken. Equal rows are taken one by one. Texts of any length count whole. An empty
    table stays empty. Columns of docs that have the name of an added one are replaced; `_pw_` begins no name.
    """
    added = ["size", "source_size", "target", "taken", "positions"]
    kept = [c for c in docs.columns if c not in added]
    measured = docs.select(
        *[F.col(f"`{c}`") for c in kept],
        (word_count(F.col(text)) if size is None else size.cast("long")).alias("size"),
        F.coalesce(F.col(source), F.lit("")).alias("_pw_name"),
        F.col(source).isNull().alias("_pw_null"),
        (line_order(key, text) if order is None else order).alias("_pw_order"),
        F.xxhash64(*[F.col(f"`{c}`") for c in kept]).alias("_pw_tie"),
    )
    buckets = max(1, math.isqrt(docs.count()))
    line = ["_pw_null", "_pw_name"]
    place = [*line, "_pw_bucket"]
    # The order is by hash, buckets are its ranges.
    share = F.conv(F.substring("_pw_order", 1, 8), 16, 10).cast("double") / float(1 << 32)
    measured = measured.withColumn("_pw_bucket", F.least(F.floor(share * buckets), F.lit(buckets - 1)).cast("long"))
    parts = measured.groupBy(*place).agg(F.sum("size").alias("size"))
    targets = source_targets(parts.groupBy(*line).agg(F.sum("size").alias("size")), schedules, most)
    ahead = Window.partitionBy(*line).orderBy("_pw_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.withColumn("_pw_ahead", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
        .drop("size")
        .join(targets, line)
    )
    inside = Window.partitionBy(*place).orderBy("_pw_order", "size", "_pw_tie")
    rows = measured.withColumn(
        "_pw_begin", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).join(offsets, place)
    begin = F.col("_pw_ahead") + F.col("_pw_begin")
    # Copies e = 0, 1, ... are taken while begin + e * source_size + size / 2 < target.
    copies = F.ceil((F.col("target") - begin - F.col("size") / 2) / F.greatest("source_size", F.lit(1)))
    copies = F.when(F.col("size") > 0, F.least(F.greatest(copies, F.lit(0)), F.lit(most))).otherwise(0).cast("int")
    demand = lambda e: F.least((begin + e * F.col("source_size")) / F.col("target"), F.lit(1.0))
    positions = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(most - 1)), lambda e: e < copies),
        lambda e: _time_of(demand(e), F.col("schedule"), schedules),
    )
    return rows.select(
        *[F.col(f"`{c}`") for c in kept],
        "size",
        "source_size",
        "target",
        (F.col("size") * copies).alias("taken"),
        positions.alias("positions"),
    )


def training_order(mixed: DataFrame) -> DataFrame:
    """A row for each copy that mix() takes, range-sorted by its position; without the columns of mix()."""
    kept = [c for c in mixed.columns if c not in ("size", "source_size", "target", "taken", "positions")]
    copies = mixed.withColumn("_pw_position", F.explode("positions")).orderBy("_pw_position")
    return copies.select(*[F.col(f"`{c}`") for c in kept])
