"""Reading the tables, and the synthetic page geometry that queries and their SQL share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import geometry as g

#: The same boxes in SQL: from the keys of lineitem, in hundredths of a page.
BOXES_SQL = """
    boxes AS (
        SELECT l_orderkey AS doc, l_linenumber AS id, CAST(l_partkey % 97 AS DOUBLE) / 100 AS x,
               CAST(l_orderkey % 89 AS DOUBLE) / 100 AS y, CAST(l_suppkey % 23 + 1 AS DOUBLE) / 100 AS w,
               CAST(l_linenumber + 1 AS DOUBLE) / 100 AS h
        FROM lineitem
    )
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, id, box of each row of lineitem."""
    part = lambda c: c.cast("double") / 100
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc"),
        F.col("l_linenumber").alias("id"),
        g.box(
            part(F.col("l_partkey") % 97),
            part(F.col("l_orderkey") % 89),
            part(F.col("l_suppkey") % 23 + 1),
            part(F.col("l_linenumber") + 1),
        ).alias("box"),
    )


def box_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, id, a, b: a box and the next one of its document."""
    all_ = boxes(spark, sf_dir)
    other = all_.select("doc", (F.col("id") - 1).alias("id"), F.col("box").alias("b"))
    return all_.withColumnRenamed("box", "a").join(other, ["doc", "id"])


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line (from 1), text of the lines of documents."""
    from pagewright.operators.pages import page_lines

    held = page_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return held.select("doc_id", "line", F.col("snippet").alias("text"))


LINES_SQL = """
    raw AS (
        SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM documents
    ), cut AS (
        SELECT doc_id, CASE WHEN l[len(l)] = '' THEN l[1 : len(l) - 1] ELSE l END AS l FROM raw
    ), lines AS (
        SELECT doc_id, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS line, unnest(l) AS text FROM cut
    )
"""
