"""Concatenate-and-cut packing: tokens of all documents in one stream, cut every `length` ids."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.arrow import slices, text_parts, tidy
from pagewright.llm.staging import stage

LENGTH, END_ID = 2048, 1

#: White space, and behind it letters, or other characters before the next white space. White space is Unicode's, so
#: without \x1c to \x1f. A byte-level pre-tokenizer always cuts where such a unit begins and looks at nothing outside
#: it, so the ids of a text are the ids of its units one after another. Letters with a character behind them that may
#: belong to the same token are no unit of their own.
UNIT = re.compile(
    r"[^\S\x1c-\x1f]*+(?:[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af]++(?!\w)|[^\w\s]++(?=\s|\Z)|[\S\x1c-\x1f]++)"
    r"|[^\S\x1c-\x1f]+\Z"
)

#: Bounds on a worker's memory: units remembered, units encoded in one call, and bytes of
#: text or ids that are held at once.
CACHED_UNITS, JOINED_UNITS, HELD_BYTES = 500_000, 10_000, 4 << 20


class UnitTokenizer:
    """ids of texts by a tokenizer file, with the ids of frequent units remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        text = '{"type":"ByteLevel","add_prefix_space":false,"trim_offsets":'
        made = self.tokenizer.to_str().replace(" ", "").replace("\n", "")
        self.splits = f'"normalizer":null,"pre_tokenizer":{text}' in made and '"use_regex":false' not in made
        self.cache: dict[str, bytes] = {}
        if self.splits:  # a byte-level token has a character for each of its bytes
            tokens = {i: t for t, i in self.tokenizer.get_vocab().items()}
            self.widths = np.array([len(tokens.get(i, "")) for i in range(max(tokens) + 1)], np.int64)

    def _plain(self, texts: list[str]) -> list[bytes]:
        batch = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.dtype).tobytes() for x in batch]

    def _joined(self, units: list[str]) -> list[bytes]:
        """As _plain() for units that begin with white space and end without: encoded as one text and cut by bytes."""
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(units)], add_special_tokens=False)[0].ids, self.dtype)
        ends = np.searchsorted(np.cumsum(self.widths[ids]), np.cumsum([len(x.encode()) for x in units])) + 1
        data, size = ids.tobytes(), self.dtype.itemsize
        return [data[a:b] for a, b in zip([0, *(ends[:-1] * size).tolist()], (ends * size).tolist())]

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids, as little-endian integers of self.dtype."""
        out: list[bytes | None] = [None] * len(texts)
        whole = [i for i, x in enumerate(texts) if not self.splits or self.special and self.special.search(x)]
        for i, ids in zip(whole, self._plain([texts[i] for i in whole])):
            out[i] = ids
        units = {i: UNIT.findall(x) for i, x in enumerate(texts) if out[i] is None}
        known = {i: list(map(self.cache.get, x)) for i, x in units.items()}
        missing = {u for i, ids in known.items() if None in ids for u, x in zip(units[i], ids) if x is None}
        inner = [x for x in missing if x[0].isspace() and not x[-1].isspace()]
        other = list(missing.difference(inner))
        found = dict(zip(other, self._plain(other)))
        for cut in slices(np.full(len(inner), 1), JOINED_UNITS):
            found.update(zip(inner[cut], self._joined(inner[cut])))
        if len(self.cache) > CACHED_UNITS and 5 * len(missing) > sum(map(len, units.values())):
            self.cache.clear()
        if len(self.cache) <= CACHED_UNITS:
            self.cache.update(found)
        for i, ids in known.items():
            out[i] = b"".join([found[u] if x is None else x for u, x in zip(units[i], ids)])
        return out


_TOKENIZERS: dict[str, UnitTokenizer] = {}


def tokenizer_for(path: str) -> UnitTokenizer:
    """One per worker process and file."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = UnitTokenizer(path)
    return _TOKENIZERS[path]


def file_order() -> list[Column]:
    """The order of a table's part files and of the blocks of a file, for tables as Spark wrote and reads them.

    Spark deals files to tasks by length. The numbers of part files have more digits where there are many of them, so a
    longer name comes later.
    """
    path = F.col("_metadata.file_path")
    return [F.length(path), path, F.col("_metadata.file_block_start")]


def tokenize(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = END_ID,
    order: Sequence[Column] = (),
) -> DataFrame:
    """part, at, key, n, ids, run: each document's ids with end_id behind them, where they begin in their task's stream,
    and the values of `order`.

    Null and empty texts have the one id end_id.
    """
    kind = docs.schema[key].dataType
    run = F.struct(F.lit(0).alias("_0"), *[c.alias(f"_{i}") for i, c in enumerate(order, 1)])
    rows = docs.select(key, F.col(text).cast("string").alias("_pw_text"), run.alias("run"))

    @tidy
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, units = TaskContext.get().partitionId(), 0, tokenizer_for(tokenizer)
        end = np.array([end_id], units.dtype).tobytes()
        for batch in batches:
            for cut, texts in text_parts(batch.column(1), HELD_BYTES):
                ids = [x + end for x in units.encode([x.decode() for x in texts])]
                n = np.array([len(x) // units.dtype.itemsize for x in ids], np.int64)
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(n), part, np.int32)),
                        pa.array(starts),
                        batch.column(0).slice(cut.start, cut.stop - cut.start),
                        pa.array(n),
                        pa.array(ids, pa.binary()),
                        batch.column(2).slice(cut.start, cut.stop - cut.start),
                    ],
                    ["part", "at", key, "n", "ids", "run"],
                )

    named = f"part int, at long, `{key}` {kind.simpleString()}, n long, ids binary, run {rows.schema['run'].dataType.simpleString()}"
    return rows.mapInArrow(encode, named)


def pack(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    end_id: int = END_ID,
    order: Sequence[Column] = (),
) -> DataFrame:
    """Pieces of documents in sequences of `length` ids; only the last sequence of all can be short.

    First pass: every task tokenizes its documents into one stream, written once, and totals it. The driver holds one
    total for each task and makes their prefix sums, which give each stream its place in the whole. Second pass: windows of
    `length` ids cut the streams; a document across a window's edge gives one record on either side, and a window across
    two streams needs no exchange, as its number and offsets follow from the global place alone.
    order: columns by which runs of a task's rows are put in the whole, such as file_order(); rows of equal values must
    be together in one task, and keep their order. The driver then holds one total for each run.
    Returns key, start, length, doc_tokens, sequence_id, offset, continued, continues, ids (little-endian 32-bit).
    Null and empty texts are the single id end_id; repeated rows are packed each; an empty table gives no rows.
    """
    streams = stage(tokenize(docs, tokenizer, key, text, end_id, order), "tokens")
    runs = streams.groupBy("run", "part").agg(F.min("at").alias("at"), F.max(F.col("at") + F.col("n")).alias("end")).collect()
    bases = np.zeros(max([r.part for r in runs], default=0) + 2, np.int64)
    for r in runs:
        bases[r.part + 1] = max(bases[r.part + 1], r.end)
    bases = np.cumsum(bases)
    runs.sort(key=lambda r: (tuple(r.run), r.part))
    begins = np.array([bases[r.part] + r.at for r in runs], np.int64)
    sizes = np.array([r.end - r.at for r in runs], np.int64)
    by_begin = np.argsort(begins)
    moves = (np.cumsum(sizes) - sizes - begins)[by_begin]  # from the streams one after another to the runs in order
    begins = begins[by_begin]
    kind = docs.schema[key].dataType

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored = tokenizer_for(tokenizer).dtype
        for batch in batches:
            for part in slices(batch.column(3).to_numpy() * 4, HELD_BYTES):
                some = batch.slice(part.start, part.stop - part.start)
                n = some.column(3).to_numpy()
                first = bases[some.column(0).to_numpy()] + some.column(1).to_numpy()
                first = first + moves[np.searchsorted(begins, first, "right") - 1]
                windows = (first + n - 1) // length - first // length + 1
                doc = np.repeat(np.arange(len(n)), windows)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
                window = first[doc] // length + nth
                begin = np.maximum(first[doc], window * length)
                end = np.minimum(first[doc] + n[doc], (window + 1) * length)
                wide = [np.frombuffer(x.as_py(), stored).astype("<u4").tobytes() for x in some.column(4)]
                start = begin - first[doc]
                ids = [wide[d][4 * a : 4 * b] for d, a, b in zip(doc.tolist(), start.tolist(), (end - first[doc]).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(2).take(pa.array(doc)),
                        pa.array(start),
                        pa.array(end - begin),
                        pa.array(n[doc]),
                        pa.array(window),
                        pa.array(begin - window * length),
                        pa.array(start > 0),
                        pa.array(end < first[doc] + n[doc]),
                        pa.array(ids, pa.binary()),
                    ],
                    [key, "start", "length", "doc_tokens", "sequence_id", "offset", "continued", "continues", "ids"],
                )

    return streams.drop("run").mapInArrow(
        cut,
        f"`{key}` {kind.simpleString()}, start long, length long, doc_tokens long, sequence_id long, offset long, "
        "continued boolean, continues boolean, ids binary",
    )


def assemble(pieces: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """sequence_id, n_tokens, ids: whole sequences from the pieces of pack(), the last one filled up with pad_id."""
    pad = F.expr(f"unhex(repeat('{pad_id.to_bytes(4, 'little').hex()}', cast({length} - n_tokens as int)))")
    ordered = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return (
        pieces.groupBy("sequence_id")
        .agg(F.sum("length").alias("n_tokens"), ordered.alias("parts"))
        .select("sequence_id", "n_tokens", "parts", pad.alias("pad"))
        .select(
            "sequence_id",
            "n_tokens",
            F.aggregate("parts", F.unhex(F.lit("")), lambda a, p: F.concat(a, p["ids"]), lambda a: F.concat(a, "pad")).alias("ids"),
        )
    )
