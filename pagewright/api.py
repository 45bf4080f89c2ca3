"""A collection of documents as tables: texts, outline, tables, links, images, search hits, chunks, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import pages as p
from pagewright.operators import structure as s
from pagewright.sources.decode import decode, read_files


class Corpus:
    """Documents with doc_id and content, decoded when a table is asked for.

    Each table decodes what it needs. decoded() with several parts decodes once for all of them; write its result to
    storage when many tables of a large collection are wanted.
    """

    def __init__(self, raw: DataFrame, key: str = "doc_id", content: str = "content", kind: Column | None = None):
        self.raw, self.key, self.content, self.kind = raw, key, content, kind

    @classmethod
    def open(cls, spark: SparkSession, path: str, pattern: str = "*") -> Corpus:
        """Files below a folder; their format is told by their bytes, else by their names."""
        return cls(read_files(spark, path, pattern))

    @classmethod
    def of_html(cls, table: DataFrame, key: str, html: str) -> Corpus:
        return cls(table, key, html, F.lit("html"))

    def decoded(self, *parts: str) -> DataFrame:
        return decode(self.raw, list(parts), self.key, self.content, self.kind)

    def metadata(self) -> DataFrame:
        """What each document is; of PDF files the pages are not read for it."""
        return self.decoded("title", "page_count", "page_basis", "encrypted")

    def errors(self) -> DataFrame:
        return self.decoded("warnings").filter("error is not null").select(self.key, "format", "error")

    def primitives(self) -> DataFrame:
        return s.exploded(self.decoded("primitives"), self.key, "primitives")

    def nodes(self) -> DataFrame:
        return s.exploded(self.decoded("nodes"), self.key, "nodes")

    def warnings(self) -> DataFrame:
        return s.exploded(self.decoded("warnings"), self.key, "warnings")

    def text(self) -> DataFrame:
        return self.decoded("text").select(self.key, "text")

    def markdown(self) -> DataFrame:
        return self.decoded("markdown").select(self.key, "markdown")

    def json(self) -> DataFrame:
        return self.decoded("json").select(self.key, "json")

    def pages(self) -> DataFrame:
        """key, page (from 1), text, markdown."""
        return s.exploded(self.decoded("pages"), self.key, "pages")

    def outline(self) -> DataFrame:
        return s.outline(self.nodes(), self.key)

    def tables(self) -> DataFrame:
        return s.tables(self.nodes(), self.key)

    def cells(self) -> DataFrame:
        return s.cells(self.nodes(), self.key)

    def links(self) -> DataFrame:
        return s.links(self.primitives(), self.key)

    def images(self) -> DataFrame:
        return s.images(self.primitives(), self.key)

    def search(self, query: str, page: int | None = None) -> DataFrame:
        pages = self.pages()
        return p.search(pages if page is None else pages.filter(F.col("page") == page), [self.key, "page"], query)

    def chunks(self) -> DataFrame:
        return p.chunks(self.pages(), [self.key, "page"])

    def page_summary(self) -> DataFrame:
        return p.page_summary(self.pages(), self.key)

    def inspect(self) -> DataFrame:
        return s.inspect(self.decoded("nodes", "primitives", "warnings", "page_count"), self.key)

    def processability(self) -> DataFrame:
        """Health of each document; a failed or encrypted one is blocked."""
        held = self.decoded("encrypted", "page_count", "page_basis", "pages", "warnings")
        filled = F.size(F.filter("pages", lambda x: ~x["text"].rlike(r"^\s*$")))
        guessed = F.size(F.array_distinct(F.transform(F.filter("warnings", lambda w: w["message"].contains("layout")), lambda w: w["page"])))
        documents = held.select(
            self.key,
            (~F.coalesce("encrypted", F.lit(False))).alias("readable"),
            F.col("error").isNull().alias("decoded"),
            F.coalesce("page_count", F.lit(0)).alias("pages_total"),
            F.when(F.col("error").isNull(), filled).otherwise(0).alias("pages_with_content"),
            F.coalesce(F.col("page_basis") == "physical_pages", F.lit(True)).alias("observed_pages"),
            F.when(F.col("error").isNull(), guessed).otherwise(0).alias("heuristic_pages"),
            "warnings",
        )
        counted = p.warning_tallies("warnings")
        return p.health(documents.withColumns(counted).drop("warnings"), self.key)
