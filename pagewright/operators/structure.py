"""Queries over decoded documents: nodes, outline, tables, links, images, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exploded(decoded: DataFrame, key: str, part: str) -> DataFrame:
    """key and the fields of each element of an array of structs."""
    return decoded.select(key, F.explode(part).alias("_pw")).select(key, "_pw.*")


def outline(nodes: DataFrame, key: str) -> DataFrame:
    """key, node_id, level, text, page (from 1) of the headings, in document order by node_id."""
    return nodes.filter("kind = 'heading'").select(
        key, "node_id", "level", F.trim("text").alias("text"), (F.col("page_start") + 1).alias("page")
    )


def within(nodes: DataFrame, key: str, kind: str) -> DataFrame:
    """nodes with `owner`: the nearest node of a kind above, or at, each node; null if none.

    In preorder a node's ancestors are the last nodes before it at each smaller depth, so the nearest one of a kind that is
    still open is found without walking up: it is the last of its kind with no node of its depth or less since.
    """
    order = Window.partitionBy(key).orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    last = nodes.withColumn("_pw_owner", F.last(F.when(F.col("kind") == kind, F.struct("node_id", "depth")), True).over(order))
    span = Window.partitionBy(key, "_pw_owner.node_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    left = F.max(
        ((F.col("depth") <= F.col("_pw_owner.depth")) & (F.col("node_id") != F.col("_pw_owner.node_id"))).cast("int")
    ).over(span)
    return last.withColumn("owner", F.when(F.coalesce(left, F.lit(0)) == 0, F.col("_pw_owner.node_id"))).drop("_pw_owner")


def cells(nodes: DataFrame, key: str) -> DataFrame:
    """key, table_id, row, col, rowspan, colspan, text of table cells."""
    held = within(nodes.filter("kind in ('table', 'table_row', 'table_cell')"), key, "table")
    return held.filter("kind = 'table_cell'").select(
        key, F.col("owner").alias("table_id"), "row", "col", "rowspan", "colspan", "text"
    )


def tables(nodes: DataFrame, key: str) -> DataFrame:
    """key, table_id, rows, cols, first_page, last_page, is_cross_page, cells."""
    inner = F.array_sort(F.collect_list(F.struct("row", "col", "rowspan", "colspan", "text")))
    held = cells(nodes, key).groupBy(key, "table_id").agg(inner.alias("cells"))
    return nodes.filter("kind = 'table'").select(
        key,
        F.col("node_id").alias("table_id"),
        F.col("row").alias("rows"),
        F.col("col").alias("cols"),
        (F.col("page_start") + 1).alias("first_page"),
        F.col("page_end").alias("last_page"),
        (F.col("page_end") > F.col("page_start") + 1).alias("is_cross_page"),
    ).join(held, [key, "table_id"], "left")


def tables_on_page(tables_: DataFrame, page: int) -> DataFrame:
    return tables_.filter(F.lit(page).between(F.col("first_page"), F.col("last_page")))


def links(primitives: DataFrame, key: str) -> DataFrame:
    """key, page, url, text, first: texts of one link that follow each other are one."""
    url = F.get(F.filter("hints", lambda h: h["kind"] == "link"), F.lit(0))["url"]
    spans = primitives.filter("kind = 'text'").withColumn("url", url)
    w = Window.partitionBy(key, "page", "url").orderBy("order")
    run = spans.filter("url is not null").withColumn("_pw_run", F.col("order") - F.row_number().over(w))
    parts = F.array_sort(F.collect_list(F.struct("order", "content")))
    return run.groupBy(key, "page", "url", "_pw_run").agg(
        F.array_join(F.transform(parts, lambda x: x["content"]), " ").alias("text"), F.min("order").alias("first")
    ).select(key, (F.col("page") + 1).alias("page"), "url", "text", "first")


def images(primitives: DataFrame, key: str) -> DataFrame:
    return primitives.filter("kind = 'image'").select(
        key, (F.col("page") + 1).alias("page"), F.col("font_name").alias("format"), "alt_text", "data", "x", "y", "width", "height"
    )


def kind_counts(nodes: DataFrame, key: str) -> DataFrame:
    """key and the number of tables, paragraphs, headings, lists, images and all nodes."""
    many = {"tables": "table", "paragraphs": "paragraph", "headings": "heading", "lists": "list", "images": "image"}
    return nodes.groupBy(key).agg(
        *[F.count_if(F.col("kind") == k).alias(n) for n, k in many.items()],
        F.count("*").alias("nodes"),
        F.max("depth").alias("depth"),
    )


def inspect(decoded: DataFrame, key: str) -> DataFrame:
    """One row for each document: what it holds, without exploding it."""
    size = lambda part, kind: F.size(F.filter(part, lambda n: n["kind"] == kind))
    return decoded.select(
        key,
        "format",
        "error",
        F.col("page_count").alias("pages"),
        *[size("nodes", k).alias(f"{k}s") for k in ("heading", "paragraph", "table", "list", "image")],
        F.size("nodes").alias("nodes"),
        F.aggregate("nodes", F.lit(0), lambda a, n: F.greatest(a, n["depth"])).alias("depth"),
        F.size(F.filter("primitives", lambda x: x["kind"] == "text")).alias("texts"),
        F.size("warnings").alias("warnings"),
    )


def subtree_text(nodes: DataFrame, key: str, kind: str) -> DataFrame:
    """key, owner, text: the texts below each node of a kind, in order."""
    parts = F.array_sort(F.collect_list(F.when(F.coalesce("text", F.lit("")) != "", F.struct("node_id", "text"))))
    return within(nodes, key, kind).filter("owner is not null").groupBy(key, "owner").agg(
        F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text")
    )


def inherited(styles: DataFrame, key: str, parent: str, fields: list[str], deepest: int = 10) -> DataFrame:
    """key and fields: a style's own value of each field, else that of the nearest style it is based on.

    styles is joined with its parents `deepest` times at most, less once no style has a parent left.
    """
    held = styles.select(key, F.col(parent).alias("_pw_up"), *fields)
    up = styles.select(F.col(key).alias("_pw_up"), F.col(parent).alias("_pw_next"), *[F.col(f).alias(f"_pw_{f}") for f in fields])
    for _ in range(deepest):
        joined = held.join(up, "_pw_up", "left")
        held = joined.select(
            key, F.when(F.col("_pw_next") != F.col(key), F.col("_pw_next")).alias("_pw_up"), *[F.coalesce(f, f"_pw_{f}").alias(f) for f in fields]
        )
    return held.select(key, *fields)


def threads(comments: DataFrame, key: str, parent: str, order: str, text: str) -> DataFrame:
    """root, text, n: each comment that answers none with its answers behind it, in order."""
    root = F.coalesce(F.col(parent), F.col(key)).alias("root")
    parts = F.array_sort(F.collect_list(F.struct(F.col(parent).isNotNull().alias("reply"), F.col(order).alias("o"), F.col(text).alias("t"))))
    return comments.groupBy(root).agg(
        F.array_join(F.transform(parts, lambda x: x["t"]), " | ").alias("text"), F.count("*").alias("n")
    )


def grid_rows(cells_: DataFrame, by: list[str], order: str) -> DataFrame:
    """by, row, cells: a row's texts joined by column; of cells at one place the last in order counts."""
    one = cells_.groupBy(*by, "row", "col").agg(F.max_by("text", order).alias("text"))
    wide = one.groupBy(*by).agg((F.max("col") + 1).alias("cols"))
    held = one.groupBy(*by, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("m")).join(wide, by)
    line = F.transform(F.sequence(F.lit(0), F.col("cols") - 1), lambda c: F.coalesce(F.try_element_at("m", c), F.lit("")))
    return held.select(*by, "row", F.array_join(line, "|").alias("cells"))


def column_widths(cells_: DataFrame, by: list[str]) -> DataFrame:
    """by, col, width: widest text of a column in bytes, at least three."""
    return cells_.groupBy(*by, "col").agg(F.greatest(F.lit(3), F.max(F.octet_length("text"))).alias("width"))
