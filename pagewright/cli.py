"""Command line: process, inspect, search, pages and health of the documents below a path."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from pagewright.api import Corpus


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pagewright", description=__doc__)
    top.add_argument("--master", default="local[*]")
    sub = top.add_subparsers(dest="command", required=True)
    process = sub.add_parser("process", help="whole documents as JSON, text or Markdown")
    process.add_argument("--format", choices=["json", "text", "markdown"], default="json")
    process.add_argument("--output", help="a folder to write one file for each task to; the standard output if not given")
    search = sub.add_parser("search", help="places of a text")
    search.add_argument("query")
    search.add_argument("--page", type=int)
    search.add_argument("--limit", type=int, default=100)
    sub.add_parser("inspect", help="what each document holds")
    sub.add_parser("pages", help="characters of each page")
    sub.add_parser("health", help="whether each document can be used")
    for name in ("process", "search", "inspect", "pages", "health"):
        sub.choices[name].add_argument("path")
        sub.choices[name].add_argument("--pattern", default="*")
    return top


def answer(corpus: Corpus, args: argparse.Namespace) -> DataFrame:
    """The table that a command asks for."""
    if args.command == "process":
        return {"json": corpus.json, "text": corpus.text, "markdown": corpus.markdown}[args.format]()
    if args.command == "search":
        return corpus.search(args.query, args.page).orderBy(corpus.key, "page", "line", "col_start").limit(args.limit)
    return {"inspect": corpus.inspect, "pages": corpus.page_summary, "health": corpus.processability}[args.command]()


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.master(args.master).appName("pagewright").getOrCreate()
    table = answer(Corpus.open(spark, args.path, args.pattern), args)
    if args.command == "process" and args.output:
        table.select(args.format).write.mode("overwrite").text(args.output)
        return 0
    for row in table.toLocalIterator():
        if args.command == "process":
            print(row[args.format] if row[args.format] is not None else "")
        else:
            print(json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
