"""Decoders on Spark: a table of bytes to one row for each document, with all that was found in it."""

from __future__ import annotations

import dataclasses
import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import text as t
from pagewright.operators.assemble import assemble, flatten
from pagewright.operators.detect import enrich
from pagewright.operators.render import by_page, render, to_json
from pagewright.sources import docx, html, pdf, xlsx
from pagewright.sources.model import NODE, PRIMITIVE, WARNING, Decoded, DecodeError

#: What a decoder is called for; more can be registered.
DECODERS: dict[str, Callable[[bytes], Decoded]] = {"html": html.decode, "xlsx": xlsx.decode, "docx": docx.decode, "pdf": pdf.decode}

#: Parts that say what a document is, and what is called where only these are asked for: pages stay unread.
FACTS = {"title", "page_count", "page_basis", "encrypted"}
OPENERS: dict[str, Callable[[bytes], Decoded]] = {"pdf": lambda data: pdf.decode(data, False)}

#: Columns of a decoded row, by name. Only those asked for are made.
PARTS = {
    "title": "string",
    "page_count": "int",
    "page_basis": "string",
    "encrypted": "boolean",
    "primitives": f"array<{PRIMITIVE}>",
    "nodes": f"array<{NODE}>",
    "artifacts": f"array<{NODE}>",
    "warnings": f"array<{WARNING}>",
    "pages": "array<struct<page:int,text:string,markdown:string>>",
    "text": "string",
    "markdown": "string",
    "json": "string",
}


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """doc_id, path, content of the files below a folder; the id is a hash of the path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "content")


def zip_flavor(data: bytes) -> str | None:
    """docx or xlsx by the first entry under word/ or xl/."""
    try:
        names = zipfile.ZipFile(io.BytesIO(data)).namelist()
    except (zipfile.BadZipFile, OSError, ValueError):
        return None
    return next(({"word": "docx", "xl": "xlsx"}[n.split("/")[0]] for n in names if n.startswith(("word/", "xl/"))), None)


def sniffed(content: Column, path: Column | None = None) -> Column:
    """The format by the bytes; only where these say nothing, by the path's extension."""

    @F.pandas_udf("string")
    def flavor(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else zip_flavor(bytes(b)), na_action="ignore")

    first = t.format_by_bytes(content)
    found = F.when(first == "zip", flavor(F.when(first == "zip", content))).otherwise(first)
    return F.coalesce(found, t.format_by_extension(path)) if path is not None else found


def decode_one(data: bytes | None, kind: str | None, parts: list[str]) -> dict:
    """The parts of one document, and the error if it has none."""
    out: dict = {"error": None, "format": kind} | dict.fromkeys(parts)
    try:
        if data is None or kind not in DECODERS:
            raise DecodeError(f"unsupported format {kind}")
        d = (OPENERS if FACTS.issuperset(parts) and kind in OPENERS else DECODERS)[kind](bytes(data))
    except DecodeError as e:
        return out | {"error": str(e)}
    except Exception as e:  # a decoder met what it did not expect: the document fails, not the job
        return out | {"error": f"{type(e).__name__}: {e}"}
    if FACTS.issuperset(parts):
        return out | {p: getattr(d, p) for p in parts}
    primitives, heuristics = enrich(d)
    root, artifacts, more = assemble(primitives)
    warnings = [*d.warnings, *heuristics, *more]
    pages = list(zip(by_page(root, d.page_count), by_page(root, d.page_count, True))) if "pages" in parts else []
    facts = {"format": d.format, "pages": d.page_count, "title": d.title}
    made = {
        "title": lambda: d.title,
        "page_count": lambda: d.page_count,
        "page_basis": lambda: d.page_basis,
        "encrypted": lambda: d.encrypted,
        "primitives": lambda: [dataclasses.asdict(p) for p in primitives],
        "nodes": lambda: flatten(root),
        "artifacts": lambda: [flatten(a)[0] for a in artifacts],
        "warnings": lambda: [dataclasses.asdict(w) for w in warnings],
        "pages": lambda: [{"page": i + 1, "text": a, "markdown": b} for i, (a, b) in enumerate(pages)],
        "text": lambda: render(root),
        "markdown": lambda: render(root, True),
        "json": lambda: to_json(root, facts, warnings),
    }
    return out | {p: made[p]() for p in parts}


def decode(raw: DataFrame, parts: list[str], key: str = "doc_id", content: str = "content", kind: Column | None = None) -> DataFrame:
    """key, format, error and the parts asked for, one row for each document; texts of HTML may be strings.

    A document is read once and never leaves its task. One that cannot be decoded has an error and nulls.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = f"`{key}` {raw.schema[key].dataType.simpleString()}, format string, error string, " + ", ".join(
        f"{p} {PARTS[p]}" for p in parts
    )
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    data = F.col(content).cast("binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                keys, blobs, kinds = (batch.column(i).slice(at, 64).to_pylist() for i in range(3))
                rows = [{key: k} | decode_one(b, f, parts) for k, b, f in zip(keys, blobs, kinds)]
                for r in rows:
                    for part in ("nodes", "artifacts"):
                        for n in r.get(part) or ():
                            n["metadata"] = list(n["metadata"].items())
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    kind = sniffed(data, F.col("path") if "path" in raw.columns else None) if kind is None else kind
    return raw.select(key, data.alias("_pw_data"), kind.alias("_pw_kind")).mapInArrow(run, schema)
