"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.arrow import tidy
from pagewright.llm.staging import free, is_staged, stage

#: Links, or nodes, of which one task makes a forest.
FOREST_ROWS = 1 << 19


class Forest:
    """Union-find over the ids of one table; the root of a tree is its least id."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (p := self.parent.setdefault(x, x)) != x:
            self.parent[x] = x = self.parent[p] if p in self.parent else p
        return x

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist()):
            if (p := self.root(x)) != (q := self.root(y)):
                self.parent[max(p, q)] = min(p, q)

    def batch(self) -> pa.RecordBatch:
        """a, b: each id that is no root, and its root."""
        stars = [(x, r) for x in list(self.parent) if (r := self.root(x)) != x]
        a, b = zip(*stars) if stars else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _stars_of_shares(links: DataFrame) -> DataFrame:
    """a, b: the stars that each share of FOREST_ROWS links makes in one task; together they connect what the links do."""
    held = links if is_staged(links) else stage(links, "links")
    held = held.filter("a is not null and b is not null and a <> b")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            forest.link(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield forest.batch()

    return held.repartition(held.count() // FOREST_ROWS + 1).mapInArrow(run, "a long, b long")


def _are_stars(edges: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u: then every edge leads to its component's root."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into"))
    )
    seen = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return seen.filter("out > 1 or out > 0 and into > 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of the component of each node of the edges (a, b), both long.

    Shares of the edges become stars within a task each. Large-star and small-star steps in turn then join the shares: a
    node hands its larger neighbours, then its smaller ones, on to the least node that it knows, until all edges are those
    of stars; that takes about as many turns as the logarithm of the longest path, and none where all edges are one share.
    Each turn is one written table, and the one before is removed. Least neighbours come from a map-side minimum,
    and a node with very many neighbours is a skewed side of a join that can be split. Nulls and loops take no part; an
    empty table gives no rows.
    """
    held = stage(_stars_of_shares(edges).select(F.col("a").alias("u"), F.col("b").alias("v")), "edges")
    while not _are_stars(held):
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        turned = stage(small.select("e.u", F.col("e.m").alias("v")).filter("u <> v").distinct(), "edges")
        free(held)
        held = turned
    roots = held.select("v").distinct()
    return held.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root"))
    )
