"""Queries over page texts: search, chunks, summaries, repeated lines, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import text as t

#: Kinds of warnings in the order in which a report names them, and those that count as other.
REPORTED = [
    "partial_extraction", "missing_part", "unresolved_style", "unresolved_relationship", "missing_media",
    "truncated_content", "malformed_content", "filtered_artifact", "suspected_artifact",
]
OTHER = ["tracked_change_resolved", "unsupported_element", "unexpected_structure"]
SILENT = ["approximate_pagination", "heuristic_inference"]


def page_lines(pages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, line (from 1), snippet."""
    return pages.select(*keys, F.posexplode(t.lines(F.col(text))).alias("at", "snippet")).select(
        *keys, (F.col("at") + 1).cast("int").alias("line"), "snippet"
    )


def search(pages: DataFrame, keys: list[str], query: str, text: str = "text") -> DataFrame:
    """keys, line, col_start, match_text, snippet: all hits, overlapping ones too, with A to Z and a to z alike.

    A folded line is cut before each place where the needle begins, and the lengths of the pieces give the places. Texts
    without the needle leave before lines are made. An empty query has no hits.
    """
    needle = query.translate({c: c + 32 for c in range(65, 91)})
    if not needle:
        return page_lines(pages.filter(F.lit(False)), keys, text).select(
            *keys, "line", F.lit(0).alias("col_start"), F.col("snippet").alias("match_text"), "snippet"
        )
    some = pages.filter(t.fold_ascii(F.col(text)).contains(needle))
    held = page_lines(some, keys, text).withColumn("folded", t.fold_ascii(F.col("snippet")))
    held = held.filter(F.col("folded").contains(needle))
    quoted = "".join(f"\\x{{{ord(c):x}}}" for c in needle)
    pieces = F.split("folded", f"(?={quoted})", -1)
    # Pieces begin wherever the needle does, the first at the line itself, which may not. One pass carries the length.
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("hits"))
    walked = F.aggregate(
        pieces,
        start,
        lambda a, p: F.struct(
            (a["at"] + F.char_length(p)).alias("at"),
            F.when((a["at"] > 0) | F.startswith("folded", F.lit(needle)), F.array_append(a["hits"], a["at"])).otherwise(a["hits"]).alias("hits"),
        ),
    )
    hits = walked["hits"]
    return held.select(*keys, "line", F.explode(hits).alias("col_start"), "snippet").select(
        *keys,
        "line",
        F.col("col_start").cast("int").alias("col_start"),
        F.substring("snippet", F.col("col_start") + 1, F.lit(len(needle))).alias("match_text"),
        "snippet",
    )


def first_hits(hits: DataFrame, order: list, limit: int) -> DataFrame:
    """The first hits in order, each with the total before the limit, from one pass over the hits.

    Each task counts its hits and keeps its first ones; only these meet.
    """
    one = F.struct(*order)
    parts = hits.select(one.alias("hit"), F.spark_partition_id().alias("part"))
    first = Window.partitionBy("part").orderBy("hit")
    held = parts.withColumns({"k": F.row_number().over(first), "n": F.count("*").over(Window.partitionBy("part"))})
    few = held.filter(F.col("k") <= limit)
    every = Window.partitionBy()
    total = F.sum(F.when(F.col("k") == 1, F.col("n")).otherwise(0)).over(every)
    return few.withColumn("total", total).orderBy("hit").limit(limit).select("hit.*", "total")


def chunks(pages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, text, char_count of each page that is not blank."""
    return pages.filter(~F.coalesce(F.col(text), F.lit("")).rlike(r"^\s*$")).select(
        *keys, F.col(text).alias("text"), F.char_length(text).alias("char_count")
    )


def join_pages(pages: DataFrame, doc: str, page: str, text: str = "text", between: str = "\n\n") -> DataFrame:
    """doc, text: a document's pages in order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col(text).alias("t"))))
    return pages.groupBy(doc).agg(F.array_join(F.transform(parts, lambda x: x["t"]), between).alias("text"))


def page_summary(pages: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """doc, pages_total, pages_with_content, char_count, longest_page."""
    full = ~F.coalesce(F.col(text), F.lit("")).rlike(r"^\s*$")
    n = F.coalesce(F.char_length(text), F.lit(0)).cast("long")
    return pages.groupBy(doc).agg(
        F.count("*").alias("pages_total"),
        F.count_if(full).alias("pages_with_content"),
        F.sum(n).alias("char_count"),
        F.max(n).alias("longest_page"),
    )


def repeated_lines(lines: DataFrame, doc: str, page: str, line: str, least: int = 2) -> DataFrame:
    """doc, line, pages: lines of a document that stand on at least `least` of its pages and can be running heads."""
    held = lines.withColumn("_pw_line", t.collapse_space(F.col(line)))
    able = (F.char_length("_pw_line") > 3) & ~F.col("_pw_line").rlike("^[0-9 ]+$")
    seen = held.filter(able).groupBy(doc, "_pw_line").agg(F.count_distinct(page).alias("pages"))
    return seen.filter(F.col("pages") >= least).select(doc, F.col("_pw_line").alias("line"), "pages")


def without_lines(lines: DataFrame, rules: DataFrame, doc: str, line: str) -> DataFrame:
    """lines that no rule of their document names."""
    held = lines.withColumn("_pw_line", t.collapse_space(F.col(line)))
    return held.join(rules.select(doc, F.col("line").alias("_pw_line")), [doc, "_pw_line"], "left_anti").drop("_pw_line")


def warning_counts(warnings: DataFrame, doc: str, kind: str) -> DataFrame:
    """doc, a count for each reported kind, other, warning_count."""
    return warnings.groupBy(doc).agg(
        *[F.count_if(F.col(kind) == k).alias(k) for k in REPORTED],
        F.count_if(F.col(kind).isin(OTHER)).alias("other_warnings"),
        F.count("*").alias("warning_count"),
    )


def processability(documents: DataFrame, counts: DataFrame, doc: str) -> DataFrame:
    """A health report for each document: health, is_processable, blockers, degradations, warning_count.

    documents has doc, readable, decoded, pages_total, pages_with_content, observed_pages and heuristic_pages. A document
    that cannot be read or decoded is blocked and nothing else is said about it.
    """
    return health(documents.join(counts, doc, "left").fillna(0, [*REPORTED, "other_warnings", "warning_count"]), doc)


def warning_tallies(warnings: str) -> dict[str, Column]:
    """The counts of warning_counts() of an array of warnings, within its row."""
    many = lambda kinds: F.coalesce(F.size(F.filter(warnings, lambda w: w["kind"].isin(kinds))), F.lit(0)).cast("long")
    return {
        **{k: many([k]) for k in REPORTED},
        "other_warnings": many(OTHER),
        "warning_count": F.coalesce(F.size(warnings), F.lit(0)).cast("long"),
    }


def health(held: DataFrame, doc: str) -> DataFrame:
    """processability() of rows that hold their counts of warnings."""
    names: Column = F.array_compact(
        F.array(
            F.when(~F.col("observed_pages"), "approximate_pagination"),
            F.when(F.col("heuristic_pages") > 0, "heuristic_structure"),
            *[F.when(F.col(k) > 0, k) for k in [*REPORTED, "other_warnings"]],
        )
    )
    blockers = (
        F.when(~F.col("readable"), F.array(F.lit("encrypted")))
        .when(~F.col("decoded"), F.array(F.lit("decode_failed")))
        .when((F.col("pages_total") > 0) & (F.col("pages_with_content") == 0), F.array(F.lit("empty_content")))
        .otherwise(F.expr("cast(array() as array<string>)"))
    )
    known = F.col("readable") & F.col("decoded")
    made = held.withColumns(
        {"blockers": blockers, "degradations": F.when(known, names).otherwise(F.expr("cast(array() as array<string>)"))}
    )
    health = F.when(F.size("blockers") > 0, "blocked").when(F.size("degradations") > 0, "degraded").otherwise("ok")
    return made.select(
        doc,
        health.alias("health"),
        (F.size("blockers") == 0).alias("is_processable"),
        F.array_join("blockers", ",").alias("blockers"),
        F.array_join("degradations", ",").alias("degradations"),
        "pages_total",
        F.when(known, F.col("pages_with_content")).otherwise(0).alias("pages_with_content"),
        F.when(known, F.col("warning_count")).otherwise(0).alias("warning_count"),
    )


def link_runs(spans: DataFrame, by: list[str], order: str, url: str, text: str) -> DataFrame:
    """by, url, text, first, n: spans of one link that follow each other without a gap, as one link."""
    w = Window.partitionBy(*by, url).orderBy(order)
    run = spans.filter(F.col(url).isNotNull()).withColumn("_pw_run", F.col(order) - F.row_number().over(w))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return run.groupBy(*by, url, "_pw_run").agg(
        F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("text"), F.min(order).alias("first"), F.count("*").alias("n")
    ).drop("_pw_run")


def best_hint(hints: DataFrame, by: list[str]) -> DataFrame:
    """by, kind, confidence: of each primitive's hints (kind, confidence, detector) the surest, ties to the first detector."""
    best = F.min_by(F.struct("kind", "confidence"), F.struct(-F.col("confidence"), F.col("detector"), F.col("kind")))
    return hints.groupBy(*by).agg(best.alias("b")).select(*by, "b.kind", "b.confidence")
